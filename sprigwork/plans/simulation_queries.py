"""Queries of the simulators, scans and scalar functions over the networks of the tables, and their SQL.

The SQL runs every scenario step by step until it stands still, as the simulators do: with a flag of movement per scenario.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sprigwork.functions import scalars as S
from sprigwork.operators import fixpoint as X
from sprigwork.operators import graph as G
from sprigwork.operators import metrics as M
from sprigwork.operators import scenarios as R
from sprigwork.plans.frames import SQL_EDGES, SQL_NODES, live_nodes, net_edges
from sprigwork.session import staged
from sprigwork.sources import codecs as C
from sprigwork.tables import load

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


#: Runs of a network without a fixed point may grow without bound: values are shown up to this limit.
SHOWN = 1e5
#: Added before rounding, as damped values often lie exactly between two roundings.
NUDGE = 1e-9


def shown(col: str) -> Column:
    return F.round(F.greatest(F.least(F.col(col), F.lit(SHOWN)), F.lit(-SHOWN)) + NUDGE, 6).alias(col)


def sql_shown(expr: str) -> str:
    return f"round(greatest(least({expr}, {SHOWN}), -{SHOWN}) + {NUDGE}, 6)"


FIXED = ("ENVIRONMENT", "PHENOTYPE", "PROCESS")


def networks(spark, d: str) -> DataFrame:
    return staged(X.network_rows(live_nodes(spark, d).select("network", "id"), net_edges(spark, d)), "networks")


def phenotypes(spark, d: str) -> DataFrame:
    """(network, phenotype): of each network the first phenotype by name."""
    return G.phenotypes(live_nodes(spark, d)).groupBy("network").agg(F.min("node").alias("phenotype"))


def genes(spark, d: str) -> DataFrame:
    return live_nodes(spark, d).where(~F.col("type").isin(*FIXED)).select("network", "id")


# ---- the same in SQL

_W = f"""WITH RECURSIVE {SQL_NODES}, {SQL_EDGES}, ph AS (SELECT network, min(id) AS ph FROM nodes WHERE type = 'PHENOTYPE' GROUP BY 1),
ids AS (SELECT network, id FROM nodes UNION SELECT network, source FROM edges UNION SELECT network, target FROM edges),
links AS (SELECT network, source AS s, target AS t, sign AS x FROM edges UNION ALL SELECT network, id, id, 0 FROM ids),
regs AS (SELECT DISTINCT network, target AS id FROM edges)"""
_SINGLES = """, scen AS (SELECT n.network, n.id AS node, mode, m, n.network || '|' || n.id || '|' || mode AS key, ph FROM nodes n JOIN ph ON ph.network = n.network, (VALUES ('KO', 0.0::DOUBLE), ('KD', 0.5), ('OE', 2.0)) v(mode, m) WHERE n.type NOT IN ('ENVIRONMENT', 'PHENOTYPE', 'PROCESS')),
mods AS (SELECT key, node, m FROM scen), sups AS (SELECT key, node, m AS x FROM scen WHERE false)"""
#: Start of a node; its next value from g (pa, ph_: products over activators and inhibitors; sm: signed mean; old) and p (gm, ex, lone).
_STEP = {
    "algebraic": ("CASE WHEN lone THEN greatest(gm + ex, 0.0) ELSE 1.0 END", "product(greatest(v, 0.01)) FILTER (WHERE x = 1) AS pa, product(v) FILTER (WHERE x = -1) AS pi",
                  "greatest(CASE WHEN na > 0 THEN power(pa, 1.0 / na) ELSE 1.0 END * CASE WHEN nh > 0 THEN least(1.0 / greatest(pi, 0.1), 10.0) ELSE 1.0 END * gm + ex, 0.0)", "0.3 * f + 0.7 * old", 100, 1.0),
    "ode": ("CASE WHEN lone THEN greatest(gm + ex, 0.0) ELSE 1.0 END", "product(power(greatest(v, 0.01), 2) * 2.0 / (1.0 + power(greatest(v, 0.01), 2))) FILTER (WHERE x = 1) AS pa, product(2.0 / (1.0 + power(greatest(v, 0.0), 2))) FILTER (WHERE x = -1) AS pi",
            "greatest(coalesce(pa, 1.0) * coalesce(pi, 1.0) * gm + ex, 0.0)", "greatest(0.0, old + (f - old) * 0.1)", 500, 1.0),
    "rwr": ("gm", "avg(x * v) FILTER (WHERE x <> 0) AS pa, 0 AS pi", "gm", "0.85 * pa + 0.15 * gm", 50, 0.0),
}


def sql_solve(method: str) -> str:
    """CTEs inp, st and solved(key, value, converged, iterations) over scen(key, network, ph), mods(key, node, m), sups(key, node, x)."""
    start, parts, f, damped, steps, rest = _STEP[method]
    signal = "(CASE WHEN m.m IS NULL THEN 0.0 WHEN m.m = 0 THEN -1.0 WHEN m.m = 0.5 THEN -0.5 WHEN m.m >= 2 THEN 1.0 ELSE m.m - 1.0 END + CASE WHEN u.x IS NULL THEN 0.0 ELSE least(u.x, 1.0) END)"
    gm = signal if method == "rwr" else "coalesce(m.m, 1.0)"
    return f""", inp AS MATERIALIZED (SELECT s.key, s.network, i.id, CAST({gm} AS DOUBLE) AS gm, CAST(coalesce(u.x, 0.0) AS DOUBLE) AS ex, r.id IS NULL AS lone FROM scen s JOIN ids i ON i.network = s.network
  LEFT JOIN mods m ON m.key = s.key AND m.node = i.id LEFT JOIN sups u ON u.key = s.key AND u.node = i.id LEFT JOIN regs r ON r.network = i.network AND r.id = i.id),
st(key, network, id, v, it, moved) AS (SELECT key, network, id, CAST({start} AS DOUBLE), 0, 1e9::DOUBLE FROM inp UNION ALL
  SELECT key, network, id, new, it, max(abs(new - old)) OVER (PARTITION BY key) FROM (SELECT key, network, id, it, old, CASE WHEN lone THEN f ELSE {damped} END AS new FROM (SELECT g.*, p.gm, p.ex, p.lone, {f} AS f FROM (
    SELECT st.key, st.network, l.t AS id, st.it + 1 AS it, max(v) FILTER (WHERE x = 0) AS old, count(*) FILTER (WHERE x = 1) AS na, count(*) FILTER (WHERE x = -1) AS nh, {parts}
    FROM st JOIN links l ON l.network = st.network AND l.s = st.id WHERE st.it < {steps} AND st.moved >= 1e-4 GROUP BY 1, 2, 3, 4) g JOIN inp p ON p.key = g.key AND p.id = g.id))),
solved AS (SELECT s.key, coalesce(arg_max(st.v, st.it) FILTER (WHERE st.id = s.ph), {rest}) AS value, arg_max(st.moved, st.it) < 1e-4 AS converged, max(st.it) AS iterations FROM scen s JOIN st ON st.key = s.key GROUP BY s.key)"""


def _sql_singles(method: str) -> str:
    return _W + _SINGLES + sql_solve(method) + " SELECT s.network, s.node, s.mode, " + sql_shown("v.value") + " AS value, v.converged, v.iterations FROM scen s JOIN solved v ON v.key = s.key"


def _singles(method: str, params: dict[str, float] | None = None) -> Callable:
    def run(spark, d: str) -> DataFrame:
        v = R.phenotype_values(R.singles(genes(spark, d)), networks(spark, d), phenotypes(spark, d), method, params)
        return v.select("network", "node", "mode", shown("value"), "converged", "iterations")

    return run


@query(_sql_singles("algebraic"))
def sim1_algebraic(spark, d: str) -> DataFrame:
    """Every single perturbation of every network, algebraic (SIM1, SIM11)."""
    return _singles("algebraic")(spark, d)


@query(_sql_singles("ode"))
def sim2_ode(spark, d: str) -> DataFrame:
    return _singles("ode")(spark, d)


@query(_sql_singles("rwr"))
def sim3_walk(spark, d: str) -> DataFrame:
    return _singles("rwr")(spark, d)


def domain_tests(spark, d: str) -> DataFrame:
    """The reconciled tests as scenarios of their own networks; each network's phenotype is the first by name."""
    s = load(spark, d, "reconciled_perturbations")
    ph = phenotypes(spark, d).withColumnRenamed("phenotype", "phenotype_node")
    none = F.create_map().cast(R.EMPTY)
    mods, sup = F.coalesce("gene_modifiers", none), F.coalesce("exogenous_supply", none)
    base = S.infer_baseline(F.col("comparison_baseline"), F.col("perturbation_type"), mods, sup)
    return s.join(ph, "network").select(F.col("pert_key").alias("test"), "network", "phenotype_node", mods.alias("modifiers"), sup.alias("supply"), base.alias("comparison_baseline"), none.alias("baseline_modifiers"), none.alias("baseline_exogenous"), S.direction(F.col("expected_direction")).alias("expected"), S.complexity_score(mods, sup).alias("complexity"))


_TESTS = """, t AS (SELECT r.pert_key, r.network, ph, gene_modifiers AS gm, exogenous_supply AS xs,
  CASE WHEN lower(trim(expected_direction)) IN ('up', 'increased') THEN 'increased' WHEN lower(trim(expected_direction)) IN ('dn', 'decreased') THEN 'decreased' WHEN lower(trim(expected_direction)) IN ('nc', 'unchanged') THEN 'unchanged' ELSE expected_direction END AS expected,
  CASE WHEN coalesce(comparison_baseline, 'WT') = 'epistasis' THEN 'epistasis' WHEN (coalesce(len(map_keys(exogenous_supply)), 0) > 0 AND coalesce(len(list_filter(map_values(gene_modifiers), lambda x: x <> 1.0)), 0) > 0) OR lower(coalesce(perturbation_type, '')) LIKE '%rescue%' OR lower(coalesce(perturbation_type, '')) LIKE '%ko+exogenous%' THEN 'mutant' ELSE coalesce(comparison_baseline, 'WT') END AS base
  FROM reconciled_perturbations r JOIN ph ON ph.network = r.network),
scen AS (SELECT 'p' || pert_key AS key, network, ph FROM t UNION ALL SELECT 'b' || pert_key, network, ph FROM t WHERE lower(base) <> 'wt' UNION ALL SELECT 'w' || network, network, ph FROM ph),
mods AS (SELECT k || pert_key AS key, e.key AS node, e.value AS m FROM (SELECT pert_key, unnest(map_entries(gm)) AS e FROM t), (VALUES ('p'), ('b')) v(k)), sups AS (SELECT 'p' || pert_key AS key, e.key AS node, e.value AS x FROM (SELECT pert_key, unnest(map_entries(xs)) AS e FROM t))"""


def _sql_tests(method: str) -> str:
    ratio = "CASE WHEN lower(base) = 'wt' THEN 1 + pv ELSE 1 + (pv - bv) END" if method == "rwr" else "CASE WHEN bv = 0 THEN CASE WHEN pv > 0 THEN 'Infinity'::DOUBLE ELSE 1.0 END ELSE pv / bv END"
    label = "CASE WHEN CASE WHEN lower(base) = 'wt' THEN pv ELSE pv - bv END > 0.00001 THEN 'increased' WHEN CASE WHEN lower(base) = 'wt' THEN pv ELSE pv - bv END < -0.00001 THEN 'decreased' ELSE 'unchanged' END" if method == "rwr" else "CASE WHEN ratio > 1.05 THEN 'increased' WHEN ratio < 0.95 THEN 'decreased' ELSE 'unchanged' END"
    return _W + _TESTS + sql_solve(method) + f""", r AS (SELECT t.*, w.value AS wv, p.value AS pv, coalesce(b.value, w.value) AS bv, p.converged, p.iterations FROM t JOIN solved p ON p.key = 'p' || t.pert_key JOIN solved w ON w.key = 'w' || t.network LEFT JOIN solved b ON b.key = 'b' || t.pert_key),
q AS (SELECT *, {ratio} AS ratio FROM r), l AS (SELECT *, {label} AS predicted FROM q)
SELECT pert_key AS test, network, base AS comparison_baseline, {sql_shown('wv')} AS wt_value, {sql_shown('pv')} AS perturbed_value, {sql_shown('bv')} AS baseline_value, {sql_shown('ratio')} AS ratio, predicted, expected, predicted IS NOT DISTINCT FROM expected AS correct, converged, iterations FROM l"""


def _tests(method: str) -> Callable:
    def run(spark, d: str) -> DataFrame:
        out = R.run_tests(domain_tests(spark, d), networks(spark, d), method)
        return out.select("test", "network", "comparison_baseline", shown("wt_value"), shown("perturbed_value"), shown("baseline_value"), shown("ratio"), "predicted", "expected", "correct", "converged", "iterations")

    return run


QUERIES |= {"sim6_tests_algebraic": _tests("algebraic"), "sim6_tests_ode": _tests("ode"), "sim7_tests_walk": _tests("rwr")}
ORACLE |= {"sim6_tests_algebraic": _sql_tests("algebraic"), "sim6_tests_ode": _sql_tests("ode"), "sim7_tests_walk": _sql_tests("rwr")}


@query()
def sim19_validation_report(spark, d: str) -> DataFrame:
    """All three methods over all reconciled tests, with their metrics."""
    out = None
    for name, method in (("Algebraic", "algebraic"), ("ODE", "ode"), ("RWR", "rwr")):
        one = _tests(method)(spark, d).select(F.lit(name).alias("method"), "expected", "predicted")
        out = one if out is None else out.unionByName(one)
    return M.summary(out, ["method"])


def _sweep(spark, d: str, method: str, points: list[dict[str, float]]) -> DataFrame:
    """Metrics of all reconciled tests at every parameter point: all points are one job."""
    results = R.run_tests(domain_tests(spark, d), networks(spark, d), method, points=points)
    names = spark.createDataFrame([(i, *map(float, p.values())) for i, p in enumerate(points)], "point int, " + ", ".join(f"{k} double" for k in points[0]))
    return M.summary(results, ["point"]).join(F.broadcast(names), "point").select("point", *points[0], "total", "accuracy", "kappa", "mcc")


@query()
def sim8_ode_sweep(spark, d: str) -> DataFrame:
    return _sweep(spark, d, "ode", [{"k": k, "n": n} for k, n in X.ODE_SWEEP])


@query()
def sim9_walk_sweep(spark, d: str) -> DataFrame:
    return _sweep(spark, d, "rwr", [{"alpha": a} for a in X.RWR_SWEEP])


@query()
def win1_best_sweep_point(spark, d: str) -> DataFrame:
    """First point of the highest accuracy in the sweep's order."""
    return sim9_walk_sweep(spark, d).orderBy(F.col("accuracy").desc(), "point").limit(1)


@query(_sql_singles("algebraic").replace("0.3 * f + 0.7 * old", "(1 - 0.8) * f + 0.8 * old").replace("st.it < 100", "st.it < 150"))
def sim10_parameter_override(spark, d: str) -> DataFrame:
    """Singles with propagation parameters of their own."""
    return _singles("algebraic", {"damping": 0.8, "steps": 150})(spark, d)


@query(
    _sql_singles("algebraic")
    .replace("product(greatest(v, 0.01)) FILTER (WHERE x = 1) AS pa", "min(greatest(v, 0.01)) FILTER (WHERE x = 1) AS pa").replace("power(pa, 1.0 / na)", "pa")
    .replace("product(v) FILTER (WHERE x = -1) AS pi", "product(greatest(0.0, least(2.0 - v, 1.0))) FILTER (WHERE x = -1) AS pi").replace("least(1.0 / greatest(pi, 0.1), 10.0)", "pi")
)
def sca3_function_menu(spark, d: str) -> DataFrame:
    """Singles where every node has functions of its own: the smallest activator, linear inhibition (SCA3, SIM10)."""
    nets = networks(spark, d)
    menu = nets.select("network", F.explode("ids").alias("id"), F.lit("min_pool").alias("activation"), F.lit("linear_clamp").alias("inhibition"))
    v = R.phenotype_values(R.singles(genes(spark, d)), staged(X.with_menu(nets, menu), "menu"), phenotypes(spark, d), "algebraic")
    return v.select("network", "node", "mode", shown("value"), "converged", "iterations")


@query(_W + _TESTS.replace("SELECT 'p' || pert_key AS key, e.key AS node, e.value AS x FROM (SELECT pert_key, unnest(map_entries(xs)) AS e FROM t))", "SELECT key, node, sum(x) AS x FROM (SELECT 'p' || pert_key AS key, e.key AS node, e.value AS x FROM (SELECT pert_key, unnest(map_entries(xs)) AS e FROM t) UNION ALL SELECT 'p' || u.pert_key, g.target, g.sign * u.e.value FROM (SELECT pert_key, network, unnest(map_entries(xs)) AS e FROM t) u JOIN edges g ON g.network = u.network AND g.source = u.e.key) GROUP BY 1, 2)")
       + sql_solve("algebraic") + " SELECT t.pert_key AS test, " + sql_shown("p.value") + " AS value, p.converged, p.iterations FROM t JOIN solved p ON p.key = 'p' || t.pert_key")
def sim4_influences(spark, d: str) -> DataFrame:
    """Tests whose supplies also act, with the sign of the edge, on the nodes that the supplied node regulates (SIM4)."""
    t = domain_tests(spark, d).select(F.col("test").alias("key"), "network", "modifiers", "supply", "phenotype_node")
    acts = net_edges(spark, d).select("network", F.col("target").alias("node"), "source", "sign")
    solved = X.solve_arrow(X.with_influences(t, acts), networks(spark, d), "algebraic")
    return solved.select(F.col("key").cast("bigint").alias("test"), shown("value"), "converged", "iterations")


def _epistasis(spark, d: str) -> DataFrame:
    return R.epistasis(genes(spark, d), networks(spark, d), phenotypes(spark, d))


@query()
def sim13_epistasis(spark, d: str) -> DataFrame:
    """All doubles of all networks against their singles (SIM12, SIM13, JN9, JN10, SCA15, SCA16)."""
    e = _epistasis(spark, d)
    return e.select("network", "node_a", "mode_a", "node_b", "mode_b", *[F.round(c, 6).alias(c) for c in ("l_a", "l_b", "l_ab", "epsilon", "masking_distance")], "interaction_class")


@query()
def agg29_interaction_counts(spark, d: str) -> DataFrame:
    return _epistasis(spark, d).groupBy("network", "interaction_class").agg(F.count("*").alias("n"))


@query()
def srt5_strongest_interactions(spark, d: str) -> DataFrame:
    """The five strongest interactions of each network."""
    e = _epistasis(spark, d).where(~F.col("interaction_class").isin("additive", "masking", "undefined"))
    return G.top_by(e, ["network"], 5, F.abs("epsilon").desc_nulls_last(), *[F.col(c) for c in ("node_a", "mode_a", "node_b", "mode_b")]).select("network", "node_a", "mode_a", "node_b", "mode_b", F.round("epsilon", 6).alias("epsilon"), "interaction_class")


DOSES = [0.25, 0.5, 1.0, 2.0]


def _gxe(spark, d: str, method: str = "algebraic") -> DataFrame:
    levers = live_nodes(spark, d).where("type = 'ENVIRONMENT'").select("network", "id")
    return R.gxe(genes(spark, d), levers, networks(spark, d), phenotypes(spark, d), DOSES, method, modes={"KO": 0.0, "OE": 2.0})


_GXE = """, env AS (SELECT network, id AS env FROM nodes WHERE type = 'ENVIRONMENT'), gene AS (SELECT network, id AS gene FROM nodes WHERE type NOT IN ('ENVIRONMENT', 'PHENOTYPE', 'PROCESS')),
ge AS (SELECT network, gene, mode, m FROM gene, (VALUES ('KO', 0.0::DOUBLE), ('OE', 2.0)) v(mode, m) UNION ALL SELECT DISTINCT network, '', '', 1.0 FROM gene),
ee AS (SELECT network, env, dose FROM env, (VALUES (0.25::DOUBLE), (0.5), (1.0), (2.0)) v(dose) UNION ALL SELECT DISTINCT network, '', 0.0 FROM gene),
scen AS (SELECT ge.network, gene, mode, m, env, dose, ge.network || '|' || gene || '|' || mode || '|' || env || '|' || dose AS key, ph FROM ge JOIN ee ON ee.network = ge.network JOIN ph ON ph.network = ge.network),
mods AS (SELECT key, gene AS node, m FROM scen WHERE gene <> ''), sups AS (SELECT key, env AS node, dose AS x FROM scen WHERE env <> '')"""
_GXE_END = """, v AS (SELECT s.*, value FROM scen s JOIN solved o ON o.key = s.key),
w AS (SELECT a.network, a.gene, a.mode, a.env, a.dose, CASE WHEN we.value > 0 THEN CASE WHEN a.value / we.value <= 0 THEN '-Infinity'::DOUBLE ELSE log2(a.value / we.value) END ELSE '-Infinity'::DOUBLE END AS le, CASE WHEN wa.value > 0 THEN CASE WHEN b.value / wa.value <= 0 THEN '-Infinity'::DOUBLE ELSE log2(b.value / wa.value) END ELSE '-Infinity'::DOUBLE END AS la
  FROM v a JOIN v b ON b.network = a.network AND b.gene = a.gene AND b.mode = a.mode AND b.env = '' JOIN v we ON we.network = a.network AND we.gene = '' AND we.env = a.env AND we.dose = a.dose JOIN v wa ON wa.network = a.network AND wa.gene = '' AND wa.env = '' WHERE a.gene <> '' AND a.env <> '')
SELECT network, gene, mode, env, dose, round(la, 6) AS l_ambient, round(le, 6) AS l_env, CASE WHEN isfinite(le) AND isfinite(la) THEN round(le - la, 6) END AS gxe, coalesce(isfinite(le) AND isfinite(la) AND abs(le - la) > 0.1, false) AS significant FROM w"""


@query(_W + _GXE + sql_solve("algebraic") + _GXE_END)
def sim14_gxe(spark, d: str) -> DataFrame:
    """Anchored table of all networks over all doses in one run (SIM14, SIM15, JN12, SCA17)."""
    return _gxe(spark, d).select("network", "gene", "mode", "env", "dose", *[F.round(c, 6).alias(c) for c in ("l_ambient", "l_env", "gxe")], "significant")


@query(_W + _GXE + sql_solve("algebraic") + _GXE_END[: _GXE_END.rindex("SELECT network, gene")] + "SELECT a.network, a.gene, a.mode, a.dose, a.env AS env_a, b.env AS env_b, CASE WHEN isfinite(a.le) AND isfinite(b.le) THEN round(a.le - b.le, 6) END AS gxe_cross, coalesce(isfinite(a.le) AND isfinite(b.le) AND abs(a.le - b.le) > 0.1, false) AS significant FROM w a JOIN w b ON b.network = a.network AND b.gene = a.gene AND b.mode = a.mode AND b.dose = a.dose AND a.env < b.env")
def jn11_gxe_cross(spark, d: str) -> DataFrame:
    return R.gxe_cross(_gxe(spark, d)).select("network", "gene", "mode", "dose", "env_a", "env_b", F.round("gxe_cross", 6).alias("gxe_cross"), "significant")


@query()
def agg30_engine_agreement(spark, d: str) -> DataFrame:
    key = ["network", "gene", "mode", "env", "dose"]
    a, o = _gxe(spark, d), _gxe(spark, d, "ode")
    j = a.select(*key, F.col("gxe").alias("a")).join(o.select(*key, F.col("gxe").alias("o")), key)
    both = (F.abs("a") > 0.1) & (F.abs("o") > 0.1)
    return j.groupBy("network", "env").agg(F.count_if(both).alias("n_both"), F.count_if(both & ((F.col("a") > 0) == (F.col("o") > 0))).alias("n_agree"))


@query(_W + _GXE + sql_solve("algebraic") + ", v AS (SELECT s.*, value FROM scen s JOIN solved o ON o.key = s.key WHERE gene = ''), q AS (SELECT a.network, a.env, a.dose, CASE WHEN a.value > 0 AND b.value > 0 THEN log2(a.value / b.value) END AS swing FROM v a JOIN v b ON b.network = a.network AND b.env = '' WHERE a.env <> '') SELECT network, env, dose, round(swing, 6) AS swing, coalesce(abs(swing) > 2, false) AS saturated FROM q")
def agg31_saturation(spark, d: str) -> DataFrame:
    return R.saturation(_gxe(spark, d)).select("network", "env", "dose", F.round("swing", 6).alias("swing"), "saturated")


@query()
def srt3_top_hits(spark, d: str) -> DataFrame:
    """The three largest contrasts of each lever at its largest unsaturated dose, else its smallest."""
    t = staged(_gxe(spark, d), "anchored")
    s = R.saturation(t)
    dose = s.groupBy("network", "env").agg(F.coalesce(F.max(F.when(~F.col("saturated"), F.col("dose"))), F.min("dose")).alias("dose"))
    hits = t.join(dose, ["network", "env", "dose"]).where("gxe is not null")
    return G.top_by(hits, ["network", "env"], 3, F.abs("gxe").desc(), F.col("gene"), F.col("mode")).select("network", "env", "dose", "gene", "mode", F.round("gxe", 6).alias("gxe"))


# ---- traced runs: of each network the knock-out of its best connected gene


def _seeds(spark, d: str) -> DataFrame:
    """(key, node): of each network the gene of the highest degree, of equals the first by name."""
    deg = G.degrees(net_edges(spark, d)).select("network", "node", "degree").join(genes(spark, d).select("network", F.col("id").alias("node")), ["network", "node"])
    return G.top_by(deg, ["network"], 1, F.col("degree").desc(), F.col("node")).select(F.col("network").alias("key"), "node")


def _traced(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """The trace (key, step, node, value), and the perturbed nodes (key, node)."""
    seeds = staged(_seeds(spark, d), "seeds")
    one = F.create_map(F.col("node"), F.lit(0.0))
    runs = seeds.select("key", F.col("key").alias("network"), one.alias("modifiers"), F.create_map().cast(R.EMPTY).alias("supply"))
    return staged(X.trace_arrow(runs, networks(spark, d), "algebraic"), "trace"), seeds


_SEEDS = """, deg AS (SELECT network, node, count(*) AS n FROM (SELECT network, source AS node FROM edges UNION ALL SELECT network, target FROM edges) GROUP BY ALL),
scen AS (SELECT network, network AS key, node, '' AS ph FROM (SELECT g.network, g.id AS node, row_number() OVER (PARTITION BY g.network ORDER BY n DESC, g.id) AS rn FROM nodes g JOIN deg ON deg.network = g.network AND deg.node = g.id WHERE g.type NOT IN ('ENVIRONMENT', 'PHENOTYPE', 'PROCESS')) WHERE rn = 1),
mods AS (SELECT key, node, 0.0::DOUBLE AS m FROM scen), sups AS (SELECT key, node, 0.0::DOUBLE AS x FROM scen WHERE false)"""
_TRACE = _W + _SEEDS + sql_solve("algebraic")


@query(_TRACE + f" SELECT key AS network, it AS step, id AS node, {sql_shown('v')} AS value FROM st")
def sim16_trace(spark, d: str) -> DataFrame:
    return _traced(spark, d)[0].select(F.col("key").alias("network"), "step", "node", shown("value"))


@query(_TRACE + ", s0 AS (SELECT key, id, v FROM st WHERE it = 0) SELECT st.key AS network, st.id AS node, CASE WHEN scen.key IS NOT NULL THEN 0 ELSE min(st.it) FILTER (WHERE abs(st.v - s0.v) > 1e-4) END AS arrival FROM st JOIN s0 ON s0.key = st.key AND s0.id = st.id LEFT JOIN scen ON scen.key = st.key AND scen.node = st.id GROUP BY st.key, st.id, scen.key")
def win6_arrival(spark, d: str) -> DataFrame:
    """First step at which a node has left its start by more than the tolerance; the perturbed node at step 0."""
    return R.arrivals(*_traced(spark, d)).select(F.col("key").alias("network"), "node", "arrival")


@query(_TRACE + ", e AS (SELECT key, id, arg_max(v, it) AS v FROM st GROUP BY ALL), c AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY key, id ORDER BY it)) AS ch FROM st), dd AS (SELECT c.key, c.it, sqrt(sum(power(c.v - e.v, 2))) AS dist, max(ch) AS mc FROM c JOIN e ON e.key = c.key AND e.id = c.id GROUP BY 1, 2), w AS (SELECT *, first_value(dist) OVER (PARTITION BY key ORDER BY it) AS whole FROM dd) SELECT key AS network, it AS step, round(CASE WHEN whole > 0 THEN 1 - dist / whole ELSE 1.0 END, 6) AS progress, " + sql_shown("mc") + " AS max_change FROM w")
def win7_progress(spark, d: str) -> DataFrame:
    """How far the state has come at each step: 1 less its distance to the end over the start's distance to the end."""
    return R.progress(_traced(spark, d)[0]).select(F.col("key").alias("network"), "step", F.round("progress", 6).alias("progress"), shown("max_change"))


@query(_TRACE + ", s0 AS (SELECT key, id, v FROM st WHERE it = 0), a AS (SELECT st.key, st.id, CASE WHEN max(scen.key) IS NOT NULL THEN 0 ELSE min(st.it) FILTER (WHERE abs(st.v - s0.v) > 1e-4) END AS arrival FROM st JOIN s0 ON s0.key = st.key AND s0.id = st.id LEFT JOIN scen ON scen.key = st.key AND scen.node = st.id GROUP BY 1, 2), l AS (SELECT key, coalesce(max(arrival), 0) AS last FROM a GROUP BY 1), "
       "e AS (SELECT key, id, arg_max(v, it) AS v FROM st GROUP BY ALL), dd AS (SELECT st.key, st.it, sqrt(sum(power(st.v - e.v, 2))) AS dist FROM st JOIN e ON e.key = st.key AND e.id = st.id GROUP BY 1, 2), w AS (SELECT *, first_value(dist) OVER (PARTITION BY key ORDER BY it) AS whole FROM dd), c AS (SELECT w.key, it, CASE WHEN it <= last THEN 'wave' WHEN CASE WHEN whole > 0 THEN 1 - dist / whole ELSE 1.0 END < 0.99 THEN 'relax' ELSE 'steady' END AS chapter FROM w JOIN l ON l.key = w.key) "
       "SELECT key AS network, chapter, min(it) AS first_step, max(it) AS last_step FROM c GROUP BY 1, 2")
def sim18_chapters(spark, d: str) -> DataFrame:
    """Steps of each run by chapter: wave, relax, steady."""
    return R.chapters(*_traced(spark, d)).withColumnRenamed("key", "network")


@query(_TRACE + ", s0 AS (SELECT key, id, v FROM st WHERE it = 0), p AS (SELECT st.key AS network, st.id AS node, least(max(abs(st.v - s0.v)), 1e5) AS peak FROM st JOIN s0 ON s0.key = st.key AND s0.id = st.id GROUP BY 1, 2) SELECT network, node, round(peak, 6) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY network ORDER BY round(peak, 6) DESC, node) AS rn FROM p WHERE round(peak, 6) > 0) WHERE rn <= 28")
def srt6_responders(spark, d: str) -> DataFrame:
    """Of each network the nodes of the largest departure from the start, at most 28 (GRF10's budget)."""
    peak = R.responders(_traced(spark, d)[0]).select(F.col("key").alias("network"), "node", shown("peak")).where("peak > 0")
    return G.top_by(peak, ["network"], 28, F.col("peak").desc(), F.col("node"))


def _active(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Members (network, node, role) of the active subgraph of each network, and the edges of all networks."""
    trace, seeds = _traced(spark, d)
    edges = staged(net_edges(spark, d), "edges")
    moved = R.responders(trace).where("peak > 1e-4").select(F.col("key").alias("network"), "node", "peak")
    seeds = seeds.withColumnRenamed("key", "network")
    ph = phenotypes(spark, d).withColumnRenamed("phenotype", "node")
    members = G.active_members(edges, moved, seeds, ph)
    return G.bridged(edges, members), edges


@query()
def grf10_active_subgraph(spark, d: str) -> DataFrame:
    """Members of each network's active subgraph with what they are there for: core, spine, responder or bridge (GRF10, GRF11)."""
    return _active(spark, d)[0]


@query()
def grf10_active_edges(spark, d: str) -> DataFrame:
    """Edges among the members."""
    members, edges = _active(spark, d)
    return G.induced(edges, members).select("network", "source", "target", "sign")


# ---- scalar functions over whole tables

_V = "SELECT pert_key, map_values(gene_modifiers) AS v FROM reconciled_perturbations WHERE gene_modifiers IS NOT NULL"
_FL = "list_transform(v, lambda x: greatest(x, 0.01))"
_PROD = "CASE WHEN len({0}) = 0 THEN 1.0 ELSE list_product({0}) END"


@query(
    f"WITH t AS ({_V}) SELECT pert_key, round(CASE WHEN len(v) = 0 THEN 1.0 ELSE power(list_product({_FL}), 1.0 / len(v)) END, 6) AS geomean, round(CASE WHEN len(v) = 0 THEN 1.0 ELSE list_avg({_FL}) END, 6) AS arithmean, round(CASE WHEN len(v) = 0 THEN 1.0 ELSE list_max({_FL}) END, 6) AS max_pool, round(CASE WHEN len(v) = 0 THEN 1.0 ELSE list_min({_FL}) END, 6) AS min_pool, "
    f"round(CASE WHEN len(v) = 0 THEN 1.0 ELSE least(1.0 / greatest(list_product(v), 0.1), 10.0) END, 6) AS bounded_inverse, round({_PROD.format('list_transform(v, lambda x: least(1.0 / greatest(x, 0.1), 10.0))')}, 6) AS independent_inverse, round({_PROD.format('list_transform(v, lambda x: greatest(0.0, least(2.0 - x, 1.0)))')}, 6) AS linear_clamp FROM t"
)
def sca1_node_functions(spark, d: str) -> DataFrame:
    """The menu of activations and inhibitions over the values of each test (SCA1, SCA2)."""
    v = F.map_values("gene_modifiers")
    t = load(spark, d, "reconciled_perturbations").where("gene_modifiers is not null")
    return t.select("pert_key", *[F.round(f(v), 6).alias(n) for n, f in S.ACTIVATIONS.items()], *[F.round(f(v), 6).alias(n) for n, f in S.INHIBITIONS.items()])


@query("SELECT result_key, round(CASE WHEN perturbed_value <= 0 THEN 0.0 ELSE power(perturbed_value, 2) * 5.0 / (4.0 + power(perturbed_value, 2)) END, 6) AS act, round(5.0 / (4.0 + CASE WHEN perturbed_value <= 0 THEN 0.0 ELSE power(perturbed_value, 2) END), 6) AS inh FROM ode_validation_results WHERE perturbed_value IS NOT NULL")
def sca4_hill(spark, d: str) -> DataFrame:
    x, k, n = F.col("perturbed_value"), F.lit(2.0), F.lit(2.0)
    return load(spark, d, "ode_validation_results").where("perturbed_value is not null").select("result_key", F.round(S.hill_activation(x, k, n), 6).alias("act"), F.round(S.hill_inhibition(x, k, n), 6).alias("inh"))


@query("SELECT result_key, CASE WHEN gene_modifier = 0 THEN -1.0::DOUBLE WHEN gene_modifier = 0.5 THEN -0.5 WHEN gene_modifier >= 2 THEN 1.0 ELSE round(gene_modifier - 1, 6) END AS signal FROM ode_validation_results")
def sca5_modifier_signal(spark, d: str) -> DataFrame:
    return load(spark, d, "ode_validation_results").select("result_key", F.round(S.modifier_signal(F.col("gene_modifier")), 6).alias("signal"))


@query("WITH r AS (SELECT result_key, CASE WHEN wt_value = 0 THEN CASE WHEN perturbed_value > 0 THEN 'Infinity'::DOUBLE ELSE 1.0 END ELSE perturbed_value / wt_value END AS r FROM ode_validation_results) SELECT result_key, round(r, 6) AS ratio, CASE WHEN r > 1.05 THEN 'increased' WHEN r < 0.95 THEN 'decreased' ELSE 'unchanged' END AS direction, round(CASE WHEN r <= 0 THEN '-Infinity'::DOUBLE ELSE log2(r) END, 6) AS log2fc, CASE WHEN r - 1 > 0.00001 THEN 'increased' WHEN r - 1 < -0.00001 THEN 'decreased' ELSE 'unchanged' END AS signal_direction FROM r")
def sca6_classification(spark, d: str) -> DataFrame:
    """Ratio with zero baselines, direction, safe logarithm, signal direction (SCA6 to SCA9)."""
    r = load(spark, d, "ode_validation_results").select("result_key", S.safe_ratio(F.col("perturbed_value"), F.col("wt_value")).alias("r"))
    return r.select("result_key", F.round("r", 6).alias("ratio"), S.classify_ratio(F.col("r")).alias("direction"), F.round(S.safe_log2(F.col("r")), 6).alias("log2fc"), S.classify_signal(F.col("r") - 1).alias("signal_direction"))


@query("WITH t AS (SELECT pert_key, CAST(greatest(1, coalesce(len(list_filter(map_values(gene_modifiers), lambda x: x <> 1.0)), 0) + coalesce(len(map_keys(exogenous_supply)), 0)) AS INTEGER) AS s FROM reconciled_perturbations) SELECT pert_key, s AS score, CASE WHEN s <= 1 THEN 'easy' WHEN s = 2 THEN 'medium' ELSE 'hard' END AS label FROM t")
def sca10_complexity(spark, d: str) -> DataFrame:
    s = S.complexity_score(F.col("gene_modifiers"), F.col("exogenous_supply"))
    return load(spark, d, "reconciled_perturbations").select("pert_key", s.alias("score"), S.complexity_label(s).alias("label"))


@query(
    "SELECT pert_key, CASE WHEN lower(trim(perturbation_type)) IN ('ko', 'knockout', 'loss_of_function', 'lof', 'null') THEN 0.0::DOUBLE WHEN lower(trim(perturbation_type)) IN ('kd', 'knockdown', 'rnai', 'heterozygous', 'hypomorph') THEN 0.5 WHEN lower(trim(perturbation_type)) IN ('oe', 'overexpression', 'gain_of_function', 'gof') THEN 2.0 WHEN perturbation_type LIKE '%double%' AND perturbation_type LIKE '%ko%' THEN 0.0 ELSE 1.0 END AS modifier, "
    "CASE WHEN coalesce(comparison_baseline, 'WT') = 'epistasis' THEN 'epistasis' WHEN (coalesce(len(map_keys(exogenous_supply)), 0) > 0 AND coalesce(len(list_filter(map_values(gene_modifiers), lambda x: x <> 1.0)), 0) > 0) OR lower(coalesce(perturbation_type, '')) LIKE '%rescue%' OR lower(coalesce(perturbation_type, '')) LIKE '%ko+exogenous%' THEN 'mutant' ELSE coalesce(comparison_baseline, 'WT') END AS baseline FROM reconciled_perturbations"
)
def sca12_inference(spark, d: str) -> DataFrame:
    """Modifier and baseline that a test implies (SCA12, SCA13)."""
    return load(spark, d, "reconciled_perturbations").select("pert_key", S.infer_modifier(F.col("perturbation_type")).alias("modifier"), S.infer_baseline(F.col("comparison_baseline"), F.col("perturbation_type"), F.col("gene_modifiers"), F.col("exogenous_supply")).alias("baseline"))


@query("SELECT result_key, CASE WHEN gene_modifier IS NULL THEN 'knockout' WHEN gene_modifier = 0 THEN 'knockout' WHEN gene_modifier >= 2 THEN 'overexpression' WHEN gene_modifier > 0 AND gene_modifier < 1 THEN 'knockdown' ELSE 'other' END AS kind FROM ode_validation_results")
def sca14_infer_type(spark, d: str) -> DataFrame:
    return load(spark, d, "ode_validation_results").select("result_key", S.infer_type(F.lit(None).cast("string"), F.col("gene_modifier"), F.lit(False)).alias("kind"))


_AB = "SELECT result_key, log2_fold_change AS a, lag(log2_fold_change) OVER (PARTITION BY network ORDER BY result_key) AS b, lead(log2_fold_change) OVER (PARTITION BY network ORDER BY result_key) AS ab FROM ode_validation_results"


@query(f"WITH t AS ({_AB}), f AS (SELECT *, coalesce(isfinite(a) AND isfinite(b) AND isfinite(ab), false) AS ok FROM t) SELECT result_key, CASE WHEN ok THEN round(ab - a - b, 6) END AS epsilon, CASE WHEN NOT ok THEN 'undefined' WHEN abs(ab - a - b) <= 0.1 THEN 'additive' WHEN least(abs(ab - a), abs(ab - b)) <= 0.1 THEN 'masking' WHEN abs(ab) < least(abs(a), abs(b)) - 0.1 THEN 'buffering' WHEN abs(ab) > greatest(abs(a), abs(b)) + 0.1 THEN 'synergy' ELSE 'reshaping' END AS class FROM f")
def sca16_interaction_class(spark, d: str) -> DataFrame:
    """Interaction of neighbouring results, as numbers to classify (SCA15, SCA16)."""
    w = Window.partitionBy("network").orderBy("result_key")
    x = F.col("log2_fold_change")
    t = load(spark, d, "ode_validation_results").select("result_key", x.alias("a"), F.lag(x).over(w).alias("b"), F.lead(x).over(w).alias("ab"))
    a, b, ab = F.col("a"), F.col("b"), F.col("ab")
    return t.select("result_key", F.round(S.interaction(a, b, ab), 6).alias("epsilon"), S.interaction_class(a, b, ab).alias("class"))


@query("SELECT edge_key, CASE WHEN sign > 0 THEN 'activates' WHEN sign < 0 THEN 'inhibits' ELSE 'regulates' END AS verb, CASE WHEN lower(trim(effect)) IN ('+', 'activation', 'activates', 'positive', '1', '1.0') THEN 1 ELSE -1 END AS strict_sign FROM network_edges")
def sca19_sign_spellings(spark, d: str) -> DataFrame:
    return load(spark, d, "network_edges").select("edge_key", S.effect_verb(F.col("sign")).alias("verb"), S.sign_strict(F.coalesce("effect", F.lit(""))).alias("strict_sign"))


@query("SELECT result_key, round(least(greatest(log2(greatest(perturbed_value, 0.000001) / greatest(wt_value, 0.000001)), -3.0), 3.0) / 3.0, 6) AS magnitude FROM ode_validation_results WHERE perturbed_value IS NOT NULL AND wt_value IS NOT NULL")
def sca20_signed_magnitude(spark, d: str) -> DataFrame:
    t = load(spark, d, "ode_validation_results").where("perturbed_value is not null and wt_value is not null")
    return t.select("result_key", F.round(S.signed_magnitude(F.col("perturbed_value"), F.col("wt_value")), 6).alias("magnitude"))


@query(r"""WITH b AS (SELECT record_id, regexp_replace(body, '([\[:,]\s*)(NaN|-?Infinity)\b', '\1"\2"', 'g') AS b FROM raw_records), a AS (SELECT record_id, try_cast(json_extract_string(CASE WHEN json_valid(b) THEN b END, '$.ode.accuracy') AS DOUBLE) AS a FROM b)
SELECT record_id, round(CASE WHEN a <= 1.5 THEN a * 100 ELSE a END, 4) AS percent FROM a WHERE a IS NOT NULL AND NOT isnan(a)""")
def sca21_accuracy_unit(spark, d: str) -> DataFrame:
    a = load(spark, d, "raw_records").select("record_id", C.safe_get(F.col("body"), "$.ode.accuracy", "").alias("t")).select("record_id", F.expr("try_cast(t as double)").alias("a")).where("a is not null and not isnan(a)")
    return a.select("record_id", F.round(S.as_percent(F.col("a")), 4).alias("percent"))


@query("SELECT pert_key, coalesce(array_to_string(list_transform(list_sort(map_keys(exogenous_supply)), lambda k: k || '=' || CAST(exogenous_supply[k] AS VARCHAR)), '; '), NULL) AS supply_text, array_to_string(network_gene, ' > ') AS path_text FROM reconciled_perturbations")
def arr1_map_text(spark, d: str) -> DataFrame:
    return load(spark, d, "reconciled_perturbations").select("pert_key", S.map_text(F.col("exogenous_supply")).alias("supply_text"), S.path_text(F.col("network_gene")).alias("path_text"))


@query("SELECT kb_id, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(kb_node, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) % 10 AS INTEGER) AS bucket FROM kb_nodes")
def sca23_series_bucket(spark, d: str) -> DataFrame:
    return load(spark, d, "kb_nodes").select("kb_id", S.series_bucket(F.col("kb_node")).alias("bucket"))


_AXIS = r"(?:^|[^a-z])(?:temperature|temp|light|water|nitrogen|nitrate|phosphate|humidity|ph|photoperiod|day_?length|salinity|density|co2)(?:$|[^a-z])"
_SAID = r"(?:^|[^a-z])(?:high|low|long|short|cold|warm|hot|heat|dark|red|blue|far|deficit|excess|increased?|decreased?|elevated|reduced|limited|stress|shade|drought)(?:$|[^a-z])"


@query(f"SELECT doc_id, regexp_matches(lower(text), '{_AXIS}') AND NOT regexp_matches(lower(text), '{_SAID}') AS ambiguous FROM documents WHERE text IS NOT NULL")
def sca18_ambiguous_axis(spark, d: str) -> DataFrame:
    return load(spark, d, "documents").where("text is not null").select("doc_id", S.ambiguous_axis(F.col("text")).alias("ambiguous"))
