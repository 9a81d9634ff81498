"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import contract

    return contract(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import contract

    return contract(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import contract

    return contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .forest_search import contract

    return contract(table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import join

    return join(table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import BASE, judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *BASE, "kept", "llr")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import contract

    return contract(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_sharding": op3_sharding,
        "op4_toxicity": op4_toxicity,
        "op5_forest_search": op5_forest_search,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_license_scans": op7_license_scans,
        "op8_quality_rules": op8_quality_rules,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_secret_scans": op10_secret_scans,
    }


_WORDS = r"regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"

_SUBSTRING_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
wins AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
dup AS (SELECT h FROM wins GROUP BY h HAVING COUNT(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM wins WHERE h IN (SELECT h FROM dup)),
words AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (r, j) GROUP BY r),
lost AS (SELECT r, COUNT(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, COALESCE(n, 0) AS n_removed, sha256(COALESCE(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)"""

_JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.replace("COALESCE(text, '')", "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
shingles AS (SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT r, ws, unnest(range(1, GREATEST(len(ws) - 3, LEAST(len(ws), 1) + 1))) AS i FROM w)),
sizes AS (SELECT r, COUNT(*) AS n FROM shingles GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, COUNT(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (SELECT r AS x, r AS y FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT w.doc_id, COALESCE(n, 0) AS n_shingles, least AS component_id
FROM w LEFT JOIN sizes USING (r) JOIN (SELECT x AS r, MIN(o.doc_id) AS least FROM reach JOIN w o ON o.r = reach.y GROUP BY x) USING (r)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express."""
    return {"op2_substring_dedup": _SUBSTRING_SQL, "op6_ngram_jaccard": _JACCARD_SQL}
