"""Scenario grids, test runs, epistasis and gene-by-environment tables over the fixpoint simulators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sprigwork.functions import scalars as S
from sprigwork.operators import fixpoint as X
from sprigwork.session import staged

EMPTY = "map<string,double>"


def _map(*pairs: Column) -> Column:
    return F.create_map(*pairs).cast(EMPTY)


def singles(nodes: DataFrame, modes: dict[str, float] = S.MODES) -> DataFrame:
    """(network, node, mode, modifiers, supply) for every perturbable node(network, id) and mode."""
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(float(v)).alias("x")) for m, v in modes.items()])).alias("g")
    return nodes.select("network", F.col("id").alias("node"), grid).select("network", "node", "g.mode", _map(F.col("node"), F.col("g.x")).alias("modifiers"), _map().alias("supply"))


def doubles(nodes: DataFrame, modes: dict[str, float] = S.MODES) -> DataFrame:
    """All pairs of different nodes of a network (first name smaller) with all pairs of modes.

    The pairs are the result that is asked for: an unordered equi-join on the network, as many rows as the scan has runs.
    """
    one = singles(nodes, modes).select("network", "node", "mode", F.map_values("modifiers")[0].alias("x"))
    a = one.select("network", F.col("node").alias("node_a"), F.col("mode").alias("mode_a"), F.col("x").alias("xa"))
    b = one.select("network", F.col("node").alias("node_b"), F.col("mode").alias("mode_b"), F.col("x").alias("xb"))
    return a.join(b, "network").where("node_a < node_b").select("network", "node_a", "mode_a", "node_b", "mode_b", _map(F.col("node_a"), F.col("xa"), F.col("node_b"), F.col("xb")).alias("modifiers"), _map().alias("supply"))


def wild_type(networks: DataFrame) -> DataFrame:
    return networks.select("network", _map().alias("modifiers"), _map().alias("supply"))


def baselines(tests: DataFrame) -> DataFrame:
    """Modifiers and supply of the baseline run: WT none; epistasis its own if it has some; else the mutant without supply."""
    wt, epi = F.lower("comparison_baseline") == "wt", (F.col("comparison_baseline") == "epistasis") & (F.size("baseline_modifiers") > 0)
    return tests.withColumn("b_modifiers", F.when(wt, _map()).when(epi, F.col("baseline_modifiers")).otherwise(F.col("modifiers"))).withColumn("b_supply", F.when(epi, F.col("baseline_exogenous")).otherwise(_map()))


def _key(modifiers: Column, supply: Column) -> Column:
    """One text for each different run of a network's phenotype."""
    text = lambda m: S.map_text(F.coalesce(m, _map()))
    return F.concat_ws("|", "network", "phenotype_node", text(modifiers), text(supply))


def at_points(df: DataFrame, points: list[dict[str, float]]) -> DataFrame:
    """df at every parameter point: columns point (number) and params MAP<name, number>."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("point"), F.create_map(*[F.lit(x) for k, v in p.items() for x in (k, float(v))]).alias("params")) for i, p in enumerate(points)])).alias("_g")
    return df.select("*", grid).select("*", "_g.point", "_g.params").drop("_g")


def run_tests(tests: DataFrame, networks: DataFrame, method: str, params: dict[str, float] | None = None, threshold: float = 0.05, signal_threshold: float = 1e-5, points: list[dict[str, float]] | None = None) -> DataFrame:
    """tests(test, network, phenotype_node, modifiers, supply, comparison_baseline, baseline_modifiers, baseline_exogenous,
    expected) -> one result a test, or with points one a test and parameter point (column point). Each different run is solved
    once, whoever asks for it, and joined back by its key."""
    points = points or [{}]
    asked = baselines(tests).withColumn("run", _key(F.col("modifiers"), F.col("supply"))).withColumn("b_run", _key(F.col("b_modifiers"), F.col("b_supply"))).withColumn("wt_run", _key(_map(), _map()))
    pick = lambda run, m, s: asked.select(F.col(run).alias("key"), "network", "phenotype_node", m.alias("modifiers"), s.alias("supply"))
    # Maps cannot be grouped by; runs of one key are alike, so any one stands for all.
    runs = pick("run", F.col("modifiers"), F.col("supply")).unionByName(pick("b_run", F.col("b_modifiers"), F.col("b_supply"))).unionByName(pick("wt_run", _map(), _map()))
    distinct = runs.groupBy("key").agg(F.first("network").alias("network"), F.first("phenotype_node").alias("phenotype_node"), F.first("modifiers").alias("modifiers"), F.first("supply").alias("supply"))
    runs = at_points(distinct, points).withColumn("key", F.concat_ws("|", "point", "key"))
    end = X.solve_arrow(runs, networks, method, params)
    solved = staged(end.select(F.split_part("key", F.lit("|"), F.lit(1)).cast("int").alias("point"), F.regexp_replace("key", r"^\d+\|", "").alias("key"), "value", "converged", "iterations"), f"runs-{method}")
    at = lambda run, name, more=(): solved.select("point", F.col("key").alias(run), F.col("value").alias(name), *more)
    out = asked.join(at("run", "perturbed_value", ("converged", "iterations")), "run").join(at("b_run", "baseline_value"), ["point", "b_run"]).join(at("wt_run", "wt_value"), ["point", "wt_run"])
    if method == "rwr":
        absolute = F.lower("comparison_baseline") == "wt"
        signal = F.when(absolute, F.col("perturbed_value")).otherwise(F.col("perturbed_value") - F.col("baseline_value"))
        out = out.withColumn("ratio", 1 + signal).withColumn("predicted", S.classify_signal(signal, signal_threshold))
    else:
        out = out.withColumn("ratio", S.safe_ratio(F.col("perturbed_value"), F.col("baseline_value"))).withColumn("predicted", S.classify_ratio(F.col("ratio"), threshold))
    log = F.when(F.col("ratio") == S.INF, F.lit(S.INF)).otherwise(S.safe_log2(F.col("ratio")))
    return out.withColumn("log2_fold_change", log).withColumn("correct", F.col("predicted").eqNullSafe(F.col("expected"))).drop("run", "b_run", "wt_run", "b_modifiers", "b_supply")


def log_fold(value: Column, wild: Column) -> Column:
    """log2(value / wild type), minus infinity where the wild type is not above 0."""
    return F.when(wild > 0, S.safe_log2(F.try_divide(value, wild))).otherwise(F.lit(-S.INF))


def phenotype_values(scenarios: DataFrame, networks: DataFrame, phenotypes: DataFrame, method: str, params: dict[str, float] | None = None) -> DataFrame:
    """scenarios' columns without maps, and value, converged, iterations: the state of the network's phenotype(network, phenotype).

    A network may have several phenotypes: one row each.
    """
    named = [c for c in scenarios.columns if c not in ("modifiers", "supply", "params")]
    asked = scenarios.join(phenotypes, "network").withColumn("key", F.to_json(F.struct(*[F.col(c) for c in (*named, "phenotype")], *(["params"] if "params" in scenarios.columns else []))))
    kinds = dict(scenarios.dtypes)
    solved = X.solve_arrow(asked, networks, method, params, "phenotype")
    back = F.from_json("key", ", ".join(f"`{c}` {kinds[c]}" for c in named) + ", phenotype string")
    return solved.select(back.alias("k"), "value", "converged", "iterations").select("k.*", "value", "converged", "iterations")


def epistasis(nodes: DataFrame, networks: DataFrame, phenotypes: DataFrame, method: str = "algebraic", params: dict[str, float] | None = None, tau: float = 0.1, tau_mask: float = 0.1, modes: dict[str, float] = S.MODES) -> DataFrame:
    """Interaction of every pair: the double's log fold against the singles', which are solved once and joined twice."""
    ph = ["network", "phenotype"]
    wt = phenotype_values(wild_type(networks), networks, phenotypes, method, params).select(*ph, F.col("value").alias("wt"))
    wt = staged(wt, "wild-type")
    one = staged(phenotype_values(singles(nodes, modes), networks, phenotypes, method, params).join(wt, ph).select(*ph, "node", "mode", log_fold(F.col("value"), F.col("wt")).alias("l")), "singles")
    two = phenotype_values(doubles(nodes, modes), networks, phenotypes, method, params).join(wt, ph).select(*ph, "node_a", "mode_a", "node_b", "mode_b", log_fold(F.col("value"), F.col("wt")).alias("l_ab"))
    side = lambda x: one.select(*ph, F.col("node").alias(f"node_{x}"), F.col("mode").alias(f"mode_{x}"), F.col("l").alias(f"l_{x}"))
    j = two.join(side("a"), [*ph, "node_a", "mode_a"]).join(side("b"), [*ph, "node_b", "mode_b"])
    a, b, ab = F.col("l_a"), F.col("l_b"), F.col("l_ab")
    return j.select(*ph, "node_a", "mode_a", "node_b", "mode_b", "l_a", "l_b", "l_ab", S.interaction(a, b, ab).alias("epsilon"), S.masking_distance(a, b, ab).alias("masking_distance"), S.interaction_class(a, b, ab, tau, tau_mask).alias("interaction_class"))


def gxe_grid(genes: DataFrame, levers: DataFrame, doses: list[float], modes: dict[str, float] = S.MODES) -> DataFrame:
    """Gene x mode x lever x dose of each network, with the ambient run (lever null) and the wild type (gene null)."""
    one = singles(genes, modes).select("network", F.col("node").alias("gene"), "mode", "modifiers")
    wt = genes.select("network").distinct().select("network", F.lit(None).cast("string").alias("gene"), F.lit(None).cast("string").alias("mode"), _map().alias("modifiers"))
    dose = F.explode(F.array(*[F.lit(float(x)) for x in doses])).alias("dose")
    env = levers.select("network", F.col("id").alias("env"), dose).select("network", "env", "dose", _map(F.col("env"), F.col("dose")).alias("supply"))
    none = genes.select("network").distinct().select("network", F.lit(None).cast("string").alias("env"), F.lit(None).cast("double").alias("dose"), _map().alias("supply"))
    return one.unionByName(wt).join(env.unionByName(none), "network").select("network", "gene", "mode", "env", "dose", "modifiers", "supply")


def gxe(genes: DataFrame, levers: DataFrame, networks: DataFrame, phenotypes: DataFrame, doses: list[float], method: str = "algebraic", params: dict[str, float] | None = None, tau: float = 0.1, modes: dict[str, float] = S.MODES) -> DataFrame:
    """Anchored table: a gene's log fold under a lever less its log fold at ambient, for all doses in one run."""
    ph = ["network", "phenotype"]
    v = staged(phenotype_values(gxe_grid(genes, levers, doses, modes), networks, phenotypes, method, params), "gxe")
    wt_amb = v.where("gene is null and env is null").select(*ph, F.col("value").alias("wt_ambient"))
    wt_env = v.where("gene is null and env is not null").select(*ph, "env", "dose", F.col("value").alias("wt_env"))
    amb = v.where("gene is not null and env is null").select(*ph, "gene", "mode", F.col("value").alias("gene_ambient"))
    env = v.where("gene is not null and env is not null").select(*ph, "gene", "mode", "env", "dose", F.col("value").alias("gene_env"))
    j = env.join(amb, [*ph, "gene", "mode"]).join(wt_env, [*ph, "env", "dose"]).join(wt_amb, ph)
    l_env, l_amb = log_fold(F.col("gene_env"), F.col("wt_env")), log_fold(F.col("gene_ambient"), F.col("wt_ambient"))
    diff = S.finite_difference(l_env, l_amb)
    return j.select(*ph, "gene", "mode", "env", "dose", "wt_ambient", "wt_env", "gene_ambient", "gene_env", l_amb.alias("l_ambient"), l_env.alias("l_env"), diff.alias("gxe"), F.coalesce(F.abs(diff) > tau, F.lit(False)).alias("significant"))


def gxe_cross(anchored: DataFrame, tau: float = 0.1) -> DataFrame:
    """A gene's log fold under one lever less that under another, for all pairs of a network's levers (first name smaller)."""
    side = lambda x: anchored.select("network", "phenotype", "gene", "mode", "dose", F.col("env").alias(f"env_{x}"), F.col("l_env").alias(f"l_{x}"))
    diff = S.finite_difference(F.col("l_a"), F.col("l_b"))
    return side("a").join(side("b"), ["network", "phenotype", "gene", "mode", "dose"]).where("env_a < env_b").select("network", "phenotype", "gene", "mode", "dose", "env_a", "env_b", "l_a", "l_b", diff.alias("gxe_cross"), F.coalesce(F.abs(diff) > tau, F.lit(False)).alias("significant"))


def saturation(anchored: DataFrame, limit: float = 2.0) -> DataFrame:
    """(network, phenotype, env, dose, swing, saturated): log2 of the wild type's answer to a lever."""
    one = anchored.select("network", "phenotype", "env", "dose", "wt_ambient", "wt_env").distinct()
    swing = F.when((F.col("wt_ambient") > 0) & (F.col("wt_env") > 0), F.log2(F.try_divide(F.col("wt_env"), F.col("wt_ambient"))))
    return one.select("network", "phenotype", "env", "dose", swing.alias("swing"), F.coalesce(F.abs(swing) > limit, F.lit(False)).alias("saturated"))


def changes(trace: DataFrame) -> DataFrame:
    """trace(key, step, node, value) with the change of each node since the step before."""
    w = Window.partitionBy("key", "node").orderBy("step")
    return trace.withColumn("change", F.abs(F.col("value") - F.lag("value").over(w)))


def arrivals(trace: DataFrame, perturbed: DataFrame, tol: float = 1e-4) -> DataFrame:
    """(key, node, arrival): first step at which a node has left its start by more than tol; perturbed(key, node) at step 0."""
    start = trace.where("step = 0").select("key", "node", F.col("value").alias("start"))
    left = trace.join(start, ["key", "node"]).groupBy("key", "node").agg(F.min(F.when(F.abs(F.col("value") - F.col("start")) > tol, F.col("step"))).alias("left"))
    return left.join(perturbed.select("key", "node").distinct().withColumn("own", F.lit(0)), ["key", "node"], "left").select("key", "node", F.coalesce("own", "left").alias("arrival"))


def progress(trace: DataFrame) -> DataFrame:
    """(key, step, progress, max_change): 1 less the state's distance to the end over the start's distance to the end."""
    end = trace.groupBy("key", "node").agg(F.max_by("value", "step").alias("end"))
    dist = changes(trace).join(end, ["key", "node"]).groupBy("key", "step").agg(F.sqrt(F.sum(F.pow(F.col("value") - F.col("end"), F.lit(2)))).alias("dist"), F.max("change").alias("max_change"))
    whole = F.first("dist").over(Window.partitionBy("key").orderBy("step"))
    return dist.select("key", "step", F.when(whole > 0, 1 - F.try_divide(F.col("dist"), whole)).otherwise(1.0).alias("progress"), "max_change")


def chapters(trace: DataFrame, perturbed: DataFrame) -> DataFrame:
    """(key, chapter, first_step, last_step): wave while nodes still arrive, relax until 99 percent of the way, then steady."""
    last = arrivals(trace, perturbed).groupBy("key").agg(F.max("arrival").alias("last"))
    chapter = F.when(F.col("step") <= F.coalesce("last", F.lit(0)), "wave").when(F.col("progress") < 0.99, "relax").otherwise("steady")
    return progress(trace).join(last, "key").groupBy("key", chapter.alias("chapter")).agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"))


def responders(trace: DataFrame) -> DataFrame:
    """(key, node, peak): the largest departure of each node from its start, those that moved at all."""
    start = trace.where("step = 0").select("key", "node", F.col("value").alias("start"))
    return trace.join(start, ["key", "node"]).groupBy("key", "node").agg(F.max(F.abs(F.col("value") - F.col("start"))).alias("peak")).where("peak > 0")
