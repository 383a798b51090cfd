"""Queries of the text operators over the driver's tables, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from onefold.llm import coding, counting, embeddings, html, minhash, packing, quality, secrets, sharding, substrings
from onefold.llm.common import table, written
from onefold.scratch import scratch_path


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.resharded(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = written(counting.plant(table(spark, sf_dir, "documents")), "trees")
    return counting.recount(trees, counting.masks(trees["text"]))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
     l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
     reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
     c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
     n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT c.x AS vec_id, coalesce(n.n, 0) AS n_links, component_id, c.x = component_id AS kept FROM c LEFT JOIN n ON c.x = n.x
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
     firsts AS (SELECT key, min(doc_id) AS first FROM win GROUP BY key),
     hit AS (SELECT win.doc_id, win.i FROM win JOIN firsts USING (key) WHERE win.doc_id > firsts.first),
     gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM hit) GROUP BY doc_id),
     kept AS (SELECT d.doc_id, len(w) AS n_words, CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END AS k
              FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id)
SELECT doc_id, n_words, n_words - len(k) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.round_trip(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_secret_scan": op2_secret_scan,
        "op3_token_counts": op3_token_counts,
        "op4_minhash": op4_minhash,
        "op5_packing": op5_packing,
        "op6_quality_rules": op6_quality_rules,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_html_text": op10_html_text,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": secrets.sql(), "op7_embedding_dedup": OP7_SQL, "op8_substring_dedup": OP8_SQL}
