"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from pairloom.llm import (
    bpe, decontamination, fingerprints, language, licenses, lm, merkle, neardup, packing, suffixes, toxicity, warc,
    whitening,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@entry("op8_language_id")
def op8_language_id(spark, sf_dir):
    return language.language_of_documents(table(spark, sf_dir, "documents"))


@entry("op6_minhash")
def op6_minhash(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@entry("op5_packing")
def op5_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@entry("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@entry("op3_licenses")
def op3_licenses(spark, sf_dir):
    return licenses.licenses_of_documents(table(spark, sf_dir, "documents"))


@entry("op4_fingerprint")
def op4_fingerprint(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@entry("op9_warc")
def op9_warc(spark, sf_dir):
    return warc.digest_rows(warc.round_trip(table(spark, sf_dir, "pages")))


@entry("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@entry("op1_suffix_dedup")
def op1_suffix_dedup(spark, sf_dir):
    return suffixes.removed(table(spark, sf_dir, "documents"))


@entry("op7_lm_score")
def op7_lm_score(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"))


@entry("op11_bpe")
def op11_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


MERKLE_SQL = """
WITH RECURSIVE
part AS (
  SELECT doc_id, lang, n_chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
      || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS a,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS z,
    list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda crc, byte: list_reduce([xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, lang, sha256(a || CASE WHEN n_chars IS NULL THEN '-'
      ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || z) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL
      THEN sha256(a || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || z) END AS altered
  FROM part),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
  FROM leaf),
tree(tree, level, i, n, digest) AS (
  SELECT g, 0, i, count(*) OVER (PARTITION BY g), leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i))
  FROM tree WHERE n > 1 GROUP BY tree, level, i // 2),
crown(level, i, n, digest) AS (
  SELECT 0, tree, count(*) OVER (), digest FROM tree WHERE n = 1
  UNION ALL
  SELECT level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i))
  FROM crown WHERE n > 1 GROUP BY level, i // 2),
top AS (SELECT tree, max(level) AS height FROM tree GROUP BY tree),
node AS (
  SELECT tree, level, i, n, digest FROM tree WHERE n > 1
  UNION ALL
  SELECT t.tree, t.height + c.level, c.i, c.n, c.digest FROM top t, crown c WHERE c.n > 1),
climb(leaf_no, tree, level, i, folded, proof) AS (
  SELECT row_number() OVER (ORDER BY g, i), g, 0, i, coalesce(altered, leaf), '' FROM placed
  UNION ALL
  SELECT leaf_no, c.tree, c.level + 1, c.j // 2,
    sha256(CASE WHEN c.j % 2 = 1 THEN s.digest || folded ELSE folded || coalesce(s.digest, '') END),
    proof || coalesce(s.digest, '')
  FROM (SELECT x.*, CASE WHEN x.level = t.height THEN x.tree ELSE x.i END AS j
        FROM climb x JOIN top t USING (tree)) c
  JOIN node own ON own.tree = c.tree AND own.level = c.level AND own.i = c.j
  LEFT JOIN node s ON s.tree = c.tree AND s.level = c.level AND s.i = xor(c.j, 1)),
last AS (SELECT leaf_no, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM climb GROUP BY leaf_no)
SELECT p.doc_id, p.leaf, sub.digest AS subroot, r.digest AS root, sha256(last.proof) AS proof_sha256,
  last.folded AS folded_root, last.folded = r.digest AS verified
FROM (SELECT *, row_number() OVER (ORDER BY g, i) AS leaf_no FROM placed) p
JOIN last USING (leaf_no)
JOIN tree sub ON sub.tree = p.g AND sub.n = 1
JOIN crown r ON r.n = 1
"""


@entry("op12_merkle", MERKLE_SQL)
def op12_merkle(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"))


@entry("op13_whitening")
def op13_whitening(spark, sf_dir):
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))
