"""Explicit schemas of every record layout; readers never infer."""

CORPUS = "_id STRING, title STRING, text STRING, metadata MAP<STRING,STRING>"
QUERIES = "_id STRING, text STRING"
QRELS = "query_id STRING, corpus_id STRING, score INT"
RUN_FACTS = (
    "dataset_name STRING, shard_id INT, save_path STRING, this_file_path STRING, split STRING, "
    "model_name STRING, time_start STRING, time_end STRING, time_in_minutes DOUBLE, errors INT, "
    "optimization BOOLEAN, do_sample BOOLEAN, p DOUBLE, batch_size INT, prompt_name STRING, run BIGINT"
)
SCORE_CARD = (
    "`model name` STRING, algorithm STRING, `trained on` STRING, "
    "metrics MAP<STRING, MAP<STRING, STRING>>"
)
