"""Catalog queries that read one result several times."""

from catalog import files
from catalog.registry import QUERIES


def test_the_history_that_is_appended_twice_is_computed_once(spark, tmp_path, monkeypatch):
    """Both appended parts read a written history: neither joins nor searches again."""
    rows = [(c, t, "assistant" if t % 2 else "user", f"word{c} word{t} all") for c in range(6) for t in range(4)]
    spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").write.parquet(
        str(tmp_path / "conversations.parquet"))
    plans, append = [], files.outputs.append_history
    monkeypatch.setattr(files.outputs, "append_history",
                        lambda wide, path: plans.append(wide._jdf.queryExecution().toString()) or append(wide, path))
    found = QUERIES["io_metrics_csv"](spark, str(tmp_path))
    assert len(plans) == 2 and not any("Join" in p or "MapInArrow" in p for p in plans)
    assert sorted(r["epoch"] for r in found.select("epoch").collect()) == [0, 2]
