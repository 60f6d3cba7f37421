"""Queries of the core's data operators (nested records, packed fields, references) and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sprigwork.operators import nested, packed, references
from sprigwork.tables import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.found(load(spark, sf_dir, "raw_records"))


def p1_rows_per_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every flat table, and how many distinct parents they hang on."""
    tagged = nested.emit_tagged(load(spark, sf_dir, "raw_records"))
    return tagged.groupBy("tag").agg(F.count("*").alias("n_rows"), F.countDistinct("parent_pk").alias("n_parents"))


def p1_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars of each body by kind, with the characters of its texts: what the flat tables hold between them."""
    path = nested.write_tables(load(spark, sf_dir, "raw_records"))
    leaves = nested.read_table(spark, path, "leaves")
    text = F.when(F.col("kind") == "string", F.length("value")).otherwise(0)
    return leaves.groupBy("record_id", "kind").agg(F.count("*").alias("n_leaves"), F.sum(text).alias("n_chars"), F.countDistinct("parent_pk").alias("n_parents"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root table: every record, and whether its body could be read."""
    path = nested.write_tables(load(spark, sf_dir, "raw_records"))
    return nested.read_table(spark, path, "records").select("record_id", F.col("item").alias("kind"), "network", "iteration", "readable")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.found(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.found(spark, sf_dir)


def p4_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.report(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_rows_per_table, p1_leaves, p1_records, p2_found, p4_found, p4_orphans_by_month)}

_DOI = "rtrim(regexp_extract(lower(replace(replace({0}, '%2F', '/'), '%2f', '/')), '(10\\.\\d{{4,9}}/[^\\s<>\"'']+)', 1), '.,;:!?)]}}>')"

_REFS = f"""
WITH r AS (
  SELECT 'network_edges' AS tab, f AS ref_field, edge_key AS row_key, network, v, coalesce(recorded_at, loaded_at) AS t
  FROM (SELECT edge_key, network, recorded_at, loaded_at, unnest(['source', 'target']) AS f, unnest([source, target]) AS v FROM network_edges)
  WHERE v IS NOT NULL AND trim(v) <> ''),
d AS (
  SELECT 'ode_validation_results' AS tab, 'evidence_doi' AS ref_field, result_key AS row_key, {_DOI.format("evidence_doi")} AS k, validated_at AS t FROM ode_validation_results WHERE trim(evidence_doi) <> ''
  UNION ALL SELECT 'fulltext', 'doi', fulltext_key, {_DOI.format("doi")}, fetched_at FROM fulltext WHERE trim(doi) <> ''),
p AS (SELECT {_DOI.format("doi")} AS k, fetched_at AS a, withdrawn_at AS b FROM papers),
gone AS (
  SELECT tab, ref_field, row_key, t FROM r WHERE NOT EXISTS (
    SELECT 1 FROM network_nodes n WHERE n.network = r.network AND n.node_id = r.v AND n.created_at <= r.t AND (n.deleted_at IS NULL OR r.t < n.deleted_at))
  UNION ALL
  SELECT tab, ref_field, row_key, t FROM d WHERE k = '' OR NOT EXISTS (SELECT 1 FROM p WHERE p.k = d.k AND p.a <= d.t AND (p.b IS NULL OR d.t < p.b)))
"""

#: The bodies with their NaN as text, opened where they are a text inside a text; null where they are no JSON object.
_BODIES = r"""
WITH b AS (SELECT record_id, kind, network, iteration, regexp_replace(body, '([\[:,]\s*)(NaN|-?Infinity)\b', '\1"\2"', 'g') AS b FROM raw_records),
o AS (SELECT *, CASE WHEN json_valid(b) THEN CASE WHEN json_type(b) = 'VARCHAR' THEN json_extract_string(b, '$') ELSE b END END AS c FROM b),
j AS (SELECT record_id, kind, network, iteration, CASE WHEN json_valid(c) AND json_type(c) = 'OBJECT' THEN c END AS j FROM o)
"""

ORACLE: dict[str, str] = {
    "p1_records": _BODIES + "SELECT record_id, kind, network, iteration, j IS NOT NULL AS readable FROM j",
    "p1_leaves": _BODIES
    + """, t AS (SELECT record_id, x.path AS parent, x.type AS type, json_extract_string(x.atom, '$') AS v FROM (SELECT record_id, j FROM j WHERE j IS NOT NULL) s, json_tree(s.j) x
  WHERE x.atom IS NOT NULL OR x.type = 'NULL' OR (x.type IN ('OBJECT', 'ARRAY') AND json_array_length(x.value) = 0 AND x.value IN ('{}', '[]'))),
k AS (SELECT record_id, parent, CASE WHEN type = 'VARCHAR' AND v IN ('NaN', 'Infinity', '-Infinity') THEN 'number' WHEN type = 'VARCHAR' THEN 'string' WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'NULL' THEN 'null' ELSE lower(type) END AS kind, v FROM t)
SELECT record_id, kind, count(*) AS n_leaves, CAST(sum(CASE WHEN kind = 'string' THEN length(v) ELSE 0 END) AS BIGINT) AS n_chars, count(DISTINCT parent) AS n_parents FROM k GROUP BY ALL""",
    "p4_found": _REFS + "SELECT tab, ref_field, row_key FROM gone",
    "p4_orphans_by_month": _REFS
    + """, every AS (SELECT tab, ref_field, t FROM r UNION ALL SELECT tab, ref_field, t FROM d),
a AS (SELECT tab, ref_field, strftime(t, '%Y-%m') AS month, count(*) AS n_references FROM every GROUP BY ALL),
b AS (SELECT tab, ref_field, strftime(t, '%Y-%m') AS month, count(*) AS n_orphans FROM gone GROUP BY ALL)
SELECT a.tab, a.ref_field, a.month, a.n_references, coalesce(b.n_orphans, 0) AS n_orphans
FROM a LEFT JOIN b ON a.tab = b.tab AND a.ref_field = b.ref_field AND a.month IS NOT DISTINCT FROM b.month""",
}
