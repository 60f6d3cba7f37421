"""User-facing calls. Networks come as nodes(network, id, type, ...) and edges(network, source, target, sign)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sprigwork.functions import scalars as S
from sprigwork.operators import evidence, fixpoint, graph, metrics, scenarios
from sprigwork.session import staged
from sprigwork.sources import codecs, exports


def validate(nodes: DataFrame, edges: DataFrame, tests: DataFrame, method: str = "algebraic", params: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Results of all tests, and their metrics by network."""
    results = scenarios.run_tests(tests, fixpoint.network_rows(nodes.select("network", "id"), edges), method, params)
    return results, metrics.summary(results, ["network"])


def sensitivity(nodes: DataFrame, edges: DataFrame, tests: DataFrame, method: str) -> DataFrame:
    """Metrics by network at every point of the method's parameter grid; all points are one job."""
    points = [{"k": k, "n": n} for k, n in fixpoint.ODE_SWEEP] if method == "ode" else [{"alpha": a} for a in fixpoint.RWR_SWEEP]
    results = scenarios.run_tests(tests, fixpoint.network_rows(nodes.select("network", "id"), edges), method, points=points)
    names = nodes.sparkSession.createDataFrame([(i, *map(float, p.values())) for i, p in enumerate(points)], "point int, " + ", ".join(f"{k} double" for k in points[0]))
    return metrics.summary(results, ["point", "network"]).join(names, "point").select("point", *points[0], "network", "total", "accuracy", "kappa", "mcc")


def simulate(nodes: DataFrame, edges: DataFrame, runs: DataFrame, method: str = "algebraic", params: dict[str, float] | None = None) -> DataFrame:
    """Traces of runs(key, network, modifiers, supply[, baseline_modifiers, baseline_supply]) against a baseline of their own, the
    wild type where none is given: (key, step, node, value, baseline); a run that has ended stands at its last value."""
    none = F.create_map().cast(scenarios.EMPTY)
    own = lambda c: F.coalesce(F.col(c), none) if c in runs.columns else none
    nets = fixpoint.network_rows(nodes.select("network", "id"), edges)
    text = runs.select(F.col("key").cast("string").alias("key"), "network", own("modifiers").alias("modifiers"), own("supply").alias("supply"), own("baseline_modifiers").alias("bm"), own("baseline_supply").alias("bs"))
    both = text.select(F.concat(F.lit("r"), "key").alias("key"), "network", "modifiers", "supply").unionByName(text.select(F.concat(F.lit("b"), "key").alias("key"), "network", F.col("bm").alias("modifiers"), F.col("bs").alias("supply")))
    trace = staged(fixpoint.trace_arrow(both, nets, method, params).select(F.substring("key", 1, 1).alias("side"), F.expr("substring(key, 2)").alias("key"), "step", "node", "value"), "trace")
    steps = trace.groupBy("key").agg(F.max("step").alias("last")).select("key", F.explode(F.sequence(F.lit(0), "last")).alias("step"))
    grid = steps.join(trace.select("key", "node").distinct(), "key")
    side = lambda x, name: trace.where(F.col("side") == x).select("key", "step", "node", F.col("value").alias(name))
    held = Window.partitionBy("key", "node").orderBy("step")
    j = grid.join(side("r", "value"), ["key", "step", "node"], "left").join(side("b", "baseline"), ["key", "step", "node"], "left")
    return j.select("key", "step", "node", *[F.last(c, True).over(held).alias(c) for c in ("value", "baseline")])


def _one_phenotype(nodes: DataFrame, phenotype: str) -> DataFrame:
    return nodes.select("network").distinct().withColumn("phenotype", F.lit(phenotype))


def scan(nodes: DataFrame, edges: DataFrame, phenotype: str, method: str = "algebraic", modes: dict[str, float] = S.MODES) -> DataFrame:
    """The phenotype under every single perturbation."""
    free = nodes.where(~F.col("type").isin("PHENOTYPE", "PROCESS")).select("network", "id")
    return scenarios.phenotype_values(scenarios.singles(free, modes), fixpoint.network_rows(nodes.select("network", "id"), edges), _one_phenotype(nodes, phenotype), method)


def epistasis(nodes: DataFrame, edges: DataFrame, phenotype: str, tau: float = 0.1, tau_mask: float = 0.1, method: str = "algebraic") -> DataFrame:
    free = nodes.where(~F.col("type").isin("PHENOTYPE", "PROCESS")).select("network", "id")
    return scenarios.epistasis(free, fixpoint.network_rows(nodes.select("network", "id"), edges), _one_phenotype(nodes, phenotype), method, None, tau, tau_mask)


def gxe(nodes: DataFrame, edges: DataFrame, phenotype: str, env: list[str] | None = None, doses: list[float] | None = None, cross: bool = False, tau: float = 0.1, method: str = "algebraic", params: dict[str, float] | None = None) -> DataFrame:
    """Gene by environment; env limits the levers, an unknown name is an error; params are the method's."""
    levers = nodes.where("type = 'ENVIRONMENT'").select("network", "id")
    if env:
        known = {r[0] for r in levers.where(F.col("id").isin(*env)).select("id").distinct().collect()}
        if unknown := sorted(set(env) - known):
            raise ValueError(f"not a lever: {', '.join(unknown)}")
        levers = levers.where(F.col("id").isin(*env))
    genes = nodes.where(~F.col("type").isin("ENVIRONMENT", "PHENOTYPE", "PROCESS")).select("network", "id")
    table = scenarios.gxe(genes, levers, fixpoint.network_rows(nodes.select("network", "id"), edges), _one_phenotype(nodes, phenotype), doses or [1.0], method, params, tau, {"KO": 0.0, "OE": 2.0})
    return scenarios.gxe_cross(table, tau) if cross else table


def gxe_report(table: DataFrame, saturation: float = 2.0, top: int = 3) -> str:
    """Markdown report of an anchored table: saturation and top hits of each lever (a few rows are collected)."""
    s = scenarios.saturation(table, saturation)
    dose = s.groupBy("network", "env").agg(F.coalesce(F.max(F.when(~F.col("saturated"), F.col("dose"))), F.min("dose")).alias("dose"))
    hits = graph.top_by(table.join(dose, ["network", "env", "dose"]).where("gxe is not null"), ["network", "env"], top, F.abs("gxe").desc(), F.col("gene"))
    part = lambda df, cols: exports.markdown_table([r.asDict() for r in df.select(*cols).orderBy(*cols[:3]).collect()], cols)
    return "## Saturation\n\n" + part(s, ["network", "env", "dose", "swing", "saturated"]) + "\n\n## Top contrasts\n\n" + part(hits, ["network", "env", "gene", "mode", "dose", "gxe"]) + "\n"


def audit(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(network, check, item): floating nodes and edges, wrong source flags, missing or several phenotypes."""
    lost, bad = graph.floating(nodes, edges)
    n = F.count_if(F.col("type") == "PHENOTYPE")
    ph = nodes.groupBy("network").agg(n.alias("n")).where("n <> 1").select("network", F.lit("phenotype count").alias("check"), F.col("n").cast("string").alias("item"))
    wrong = graph.source_mismatch(nodes, edges).select("network", F.lit("source flag").alias("check"), F.col("id").alias("item"))
    return lost.select("network", F.lit("floating node").alias("check"), F.col("node").alias("item")).unionByName(bad.select("network", F.lit("floating edge").alias("check"), F.concat_ws(" > ", "source", "target").alias("item"))).unionByName(ph).unionByName(wrong)


def fix(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return graph.repaired(nodes, edges)


def verify(claims: DataFrame, papers: DataFrame, nodes: DataFrame | None = None, min_supports: int = 1, offline: bool = False) -> DataFrame:
    """Claims settled against papers; offline: only the paper on record and the first search, no second pass."""
    return evidence.resolve(claims, papers, nodes, min_supports, not offline)


def apply_verdicts(edges: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Edges with what verify() found for the claim of the same key: a repaired DOI in the place of the old one, and the verdict."""
    own = resolved.select(F.col("claim").alias(key), F.col("status").alias("verification"), F.col("doi").alias("_doi"))
    return edges.join(own, key, "left").withColumn("previous_doi", F.when(F.col("verification") == "repaired", F.col("doi"))).withColumn("doi", F.when(F.col("verification") == "repaired", F.col("_doi")).otherwise(F.col("doi"))).drop("_doi")


def export_tables(results: DataFrame) -> DataFrame:
    return exports.results_table(results)


def export_cytoscape(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML lines (by network) and SIF lines as text under a path."""
    lines = codecs.graphml_lines(nodes, edges)
    lines.repartitionByRange("network", "part", "name").sortWithinPartitions("network", "part", "name").select("network", "line").write.partitionBy("network").text(f"{path}/graphml")
    codecs.sif_lines(edges).write.partitionBy("network").text(f"{path}/sif")


def export_atlas(nodes: DataFrame, edges: DataFrame, papers: DataFrame, path: str) -> None:
    """All tables as JSON lines tagged by their table."""
    tag = lambda df, name: df.select(F.lit(name).alias("_table"), codecs.slim_json(F.struct("*")).alias("value"))
    tag(nodes, "nodes").unionByName(tag(edges, "edges")).unionByName(tag(papers, "papers")).write.partitionBy("_table").text(path)


def merge(edges: DataFrame, order: str) -> DataFrame:
    """Edges of all networks as one: the first sign in the given order wins, differing signs are marked."""
    return edges.groupBy("source", "target").agg(F.min_by("sign", order).alias("sign"), F.countDistinct("network").alias("n_networks"), (F.countDistinct("sign") > 1).alias("conflict"))
