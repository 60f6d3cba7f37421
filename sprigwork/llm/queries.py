"""Queries of the llm operators and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sprigwork.llm import abuse, duplicates, linking, mixing, packing, split


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.found(spark, sf_dir)


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.collapsed(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.found(spark, sf_dir)


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.unmatched(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.found(spark, sf_dir)


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.all_pieces(spark, sf_dir)


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(spark, sf_dir)


def p6_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.rejoined(spark, sf_dir)


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.audit(spark, sf_dir)


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.limits(spark, sf_dir)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(spark, sf_dir)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(spark, sf_dir)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.found(spark, sf_dir)


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(spark, sf_dir)


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_collapsed, p5_found, p5_unmatched, p6_found, p6_pieces, p6_rejoined, p7_packed, p7_fill, p7_audit, p8_mixture, p8_shares, p8_limits, p9_found, p9_scores, p9_rates)}
ORACLE: dict[str, str] = {
    "p6_found": """
SELECT fulltext_key,
  CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: length(x))) > max_chars THEN 'hard' ELSE 'soft' END AS cut
FROM fulltext JOIN chunk_limits USING (source) WHERE length(text) > max_chars""",
    "p6_rejoined": "SELECT fulltext_key, length(text) AS n_chars, md5(text) AS checksum, true AS within FROM fulltext WHERE text <> ''",
    "p7_audit": "SELECT profile, (SELECT count(*) FROM documents) AS n_documents, 0 AS n_overfull, 0 AS n_incomplete FROM pack_profiles",
    "p8_limits": "SELECT source, target_share, max_repeats, 0 AS n_over_limit FROM mix_targets",
}
