"""Frames that several query modules start from, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprigwork.functions import scalars as S
from sprigwork.tables import load


def sql_expand(col: str, codes: dict[str, str]) -> str:
    cases = " ".join(f"WHEN lower(trim({col})) IN ('{s.lower()}', '{n.lower()}') THEN '{n}'" for s, n in codes.items())
    return f"CASE {cases} ELSE {col} END"


def master(spark, d: str) -> DataFrame:
    """Test-level results of all methods."""
    m = load(spark, d, "master_test_level")
    zero = F.lit(0)
    return m.select(
        "master_key", "network", "species", "method", "test_id", "gene", F.coalesce(S.expand(F.col("perturbation_type"), S.PERTURBATIONS), F.lit("")).alias("perturbation_type"),
        S.direction(F.col("expected_direction")).alias("expected"), S.direction(F.col("predicted_direction")).alias("predicted"), "correct", "ratio", "converged", "iterations", "path_length", "phenotype_node",
        F.coalesce("n_gene_mods", zero).alias("n_mods"), F.coalesce("n_exogenous", zero).alias("n_exo"),
        F.greatest(F.lit(1), F.coalesce("n_gene_mods", zero) + F.coalesce("n_exogenous", zero)).alias("complexity"),
    )


SQL_MASTER = f"""m AS (SELECT master_key, network, species, method, test_id, gene, coalesce({sql_expand("perturbation_type", S.PERTURBATIONS)}, '') AS perturbation_type,
  {sql_expand("expected_direction", S.DIRECTIONS)} AS expected, {sql_expand("predicted_direction", S.DIRECTIONS)} AS predicted, correct, ratio, converged, iterations, path_length, phenotype_node,
  coalesce(n_gene_mods, 0) AS n_mods, coalesce(n_exogenous, 0) AS n_exo, greatest(1, coalesce(n_gene_mods, 0) + coalesce(n_exogenous, 0)) AS complexity FROM master_test_level)"""


def live_nodes(spark, d: str) -> DataFrame:
    """One row for each network and node that was not deleted: type in long form, earliest row first."""
    n = load(spark, d, "network_nodes").where(F.col("deleted_at").isNull() & F.col("network").isNotNull() & F.col("node_id").isNotNull())
    kind = F.coalesce(S.expand(F.col("node_type"), S.NODE_TYPES), F.lit("GENE")).alias("type")
    return n.groupBy("network", F.col("node_id").alias("id")).agg(F.min(F.struct("node_key", kind, "full_name", "is_source")).alias("x")).select("network", "id", "x.type", "x.full_name", "x.is_source")


SQL_NODES = f"""nodes AS (SELECT network, id, type, full_name, is_source FROM (
  SELECT network, node_id AS id, coalesce({sql_expand("node_type", S.NODE_TYPES)}, 'GENE') AS type, full_name, is_source, row_number() OVER (PARTITION BY network, node_id ORDER BY node_key) AS rn
  FROM network_nodes WHERE deleted_at IS NULL AND network IS NOT NULL AND node_id IS NOT NULL) WHERE rn = 1)"""


def net_edges(spark, d: str) -> DataFrame:
    """One row for each network, source and target with both ends named: the sign of the earliest row."""
    e = load(spark, d, "network_edges").where(F.col("network").isNotNull() & (F.length(F.trim("source")) > 0) & (F.length(F.trim("target")) > 0))
    return e.groupBy("network", "source", "target").agg(F.min(F.struct("edge_key", F.when(F.col("sign") > 0, 1).otherwise(-1).alias("sign"))).alias("x")).select("network", "source", "target", F.col("x.sign").alias("sign"), F.col("x.edge_key").alias("edge_key"))


SQL_EDGES = """edges AS (SELECT network, source, target, sign, edge_key FROM (
  SELECT network, source, target, CASE WHEN sign > 0 THEN 1 ELSE -1 END AS sign, edge_key, row_number() OVER (PARTITION BY network, source, target ORDER BY edge_key) AS rn
  FROM network_edges WHERE network IS NOT NULL AND length(trim(source)) > 0 AND length(trim(target)) > 0) WHERE rn = 1)"""
