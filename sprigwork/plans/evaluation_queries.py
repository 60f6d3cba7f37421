"""Queries of the evaluation operators (AGG, WIN, parts of SRT and SCA) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sprigwork.functions import scalars as S
from sprigwork.operators import metrics as M
from sprigwork.plans.frames import SQL_EDGES, SQL_MASTER, SQL_NODES, live_nodes, master, net_edges
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


KEYS = ["network", "method"]
_L = M.LABELS


def _conf(keys: str, base: str = "m") -> str:
    known = lambda c: f"CASE WHEN {c} IN ('increased', 'decreased', 'unchanged') THEN {c} ELSE 'unchanged' END"
    cells = ", ".join(f"count(*) FILTER (WHERE {known('expected')} = '{a}' AND {known('predicted')} = '{b}') AS c{i}{j}" for i, a in enumerate(_L) for j, b in enumerate(_L))
    return f"conf AS (SELECT {keys}, {cells}, count(*) AS total, count(*) FILTER (WHERE expected IS NOT DISTINCT FROM predicted) AS n_correct FROM {base} GROUP BY {keys})"


_R = [f"CAST(c{i}0 + c{i}1 + c{i}2 AS DOUBLE)" for i in range(3)]
_C = [f"CAST(c0{j} + c1{j} + c2{j} AS DOUBLE)" for j in range(3)]
_PE = "(" + " + ".join(f"{_R[i]} * {_C[i]} / (CAST(total AS DOUBLE) * total)" for i in range(3)) + ")"
_PO = "(CAST(n_correct AS DOUBLE) / total)"
_KAPPA = f"CASE WHEN {_PE} = 1 THEN 0.0 ELSE ({_PO} - {_PE}) / (1 - {_PE}) END"


def _mcc() -> str:
    each, used = [], []
    for i in range(3):
        tp, n = f"CAST(c{i}{i} AS DOUBLE)", "CAST(total AS DOUBLE)"
        fp, fn = f"({_C[i]} - {tp})", f"({_R[i]} - {tp})"
        tn = f"({n} - {tp} - {fp} - {fn})"
        d = f"sqrt(({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))"
        each.append(f"CASE WHEN {d} > 0 THEN ({tp} * {tn} - {fp} * {fn}) / {d} ELSE 0.0 END")
        used.append(f"CASE WHEN {d} > 0 THEN 1 ELSE 0 END")
    return f"CASE WHEN {' + '.join(used)} > 0 THEN ({' + '.join(each)}) / ({' + '.join(used)}) ELSE 0.0 END"


_MCC = _mcc()
_KAPPA_BAND = f"CASE WHEN ({_KAPPA}) < 0 THEN 'below-chance' " + " ".join(f"WHEN ({_KAPPA}) < {x} THEN '{label}'" for x, label in S.KAPPA_BANDS) + " ELSE 'almost perfect' END"
WITH_M = f"WITH {SQL_MASTER}"


def _kappa_ci() -> tuple[str, str]:
    n = "CAST(total AS DOUBLE)"
    r, c = [f"({x} / {n})" for x in _R], [f"({x} / {n})" for x in _C]
    po = f"((c00 + c11 + c22) / {n})"
    pe = "(" + " + ".join(f"{r[i]} * {c[i]}" for i in range(3)) + ")"
    k = f"(({po} - {pe}) / nullif(1 - {pe}, 0))"
    a = " + ".join(f"c{i}{i} / {n} * power(1 - ({r[i]} + {c[i]}) * (1 - {k}), 2)" for i in range(3))
    b = " + ".join(f"c{i}{j} / {n} * power({c[i]} + {r[j]}, 2)" for i in range(3) for j in range(3) if i != j)
    var = f"(({a} + power(1 - {k}, 2) * ({b}) - power({k} - {pe} * (1 - {k}), 2)) / nullif({n} * power(1 - {pe}, 2), 0))"
    bound = lambda s: f"CASE WHEN {pe} = 1 THEN 0.0 WHEN {var} < 0 THEN {k} ELSE round({k} {s} 1.96 * sqrt(greatest({var}, 0.0)), 4) END"
    return bound("-"), bound("+")


_LOW, _HIGH = _kappa_ci()


@query(f"{WITH_M}, {_conf('network, method')} " + " UNION ALL ".join(f"SELECT network, method, '{a}' AS expected, '{b}' AS predicted, c{i}{j} AS n FROM conf" for i, a in enumerate(_L) for j, b in enumerate(_L)))
def agg1_confusion_matrix(spark, d: str) -> DataFrame:
    return M.confusion_long(master(spark, d), KEYS)


@query(
    f"{WITH_M}, {_conf('network, method')}, t AS ("
    + " UNION ALL ".join(f"SELECT network, method, '{a}' AS label, CAST(c{i}{i} AS DOUBLE) AS tp, {_C[i]} AS col, {_R[i]} AS rw FROM conf" for i, a in enumerate(_L))
    + "), u AS (SELECT *, CASE WHEN col > 0 THEN tp / col ELSE 0.0 END AS p, CASE WHEN rw > 0 THEN tp / rw ELSE 0.0 END AS r FROM t) "
    "SELECT network, method, label, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1, CAST(rw AS BIGINT) AS support FROM u"
)
def agg2_per_class(spark, d: str) -> DataFrame:
    return M.per_class(master(spark, d), KEYS)


@query(f"{WITH_M} SELECT method, count(*) AS n, count(*) FILTER (WHERE expected IS NOT DISTINCT FROM predicted) AS n_correct, round(count(*) FILTER (WHERE expected IS NOT DISTINCT FROM predicted) * 100.0 / count(*), 1) AS accuracy FROM m GROUP BY method")
def agg3_accuracy(spark, d: str) -> DataFrame:
    return M.accuracy_by(master(spark, d), ["method"])


@query(f"{WITH_M}, {_conf('network, method')} SELECT network, method, total, round({_KAPPA}, 4) AS kappa FROM conf")
def agg4_kappa(spark, d: str) -> DataFrame:
    return M.confusion(master(spark, d), KEYS).select(*KEYS, "total", F.round(M.kappa(), 4).alias("kappa"))


@query(f"{WITH_M}, {_conf('network, method')} SELECT network, method, round({_MCC}, 4) AS mcc FROM conf")
def agg5_mcc(spark, d: str) -> DataFrame:
    return M.confusion(master(spark, d), KEYS).select(*KEYS, F.round(M.mcc(), 4).alias("mcc"))


@query(f"{WITH_M} SELECT method, perturbation_type, count(*) AS n, count(*) FILTER (WHERE expected IS NOT DISTINCT FROM predicted) AS n_correct, round(count(*) FILTER (WHERE expected IS NOT DISTINCT FROM predicted) * 100.0 / count(*), 1) AS accuracy FROM m GROUP BY ALL")
def agg6_accuracy_by_type(spark, d: str) -> DataFrame:
    return M.accuracy_by(master(spark, d), ["method", "perturbation_type"])


@query(f"{WITH_M} SELECT network, method, count(*) AS total, count(*) FILTER (WHERE NOT coalesce(converged, false)) AS non_converged, round(count(*) FILTER (WHERE coalesce(converged, false)) * 100.0 / count(*), 1) AS convergence_rate FROM m GROUP BY ALL")
def agg7_convergence(spark, d: str) -> DataFrame:
    return M.convergence(master(spark, d), KEYS)


@query(f"{WITH_M}, {_conf('network, method')} SELECT network, method, total, n_correct, round(n_correct * 100.0 / total, 1) AS accuracy, round({_KAPPA}, 4) AS kappa, round({_MCC}, 4) AS mcc, {_LOW} AS kappa_low, {_HIGH} AS kappa_high, {_KAPPA_BAND} AS kappa_band FROM conf")
def agg8_kappa_interval(spark, d: str) -> DataFrame:
    return M.summary(master(spark, d), KEYS)


_SIZES = f"{SQL_NODES}, {SQL_EDGES}, sizes AS (SELECT network, n_nodes, coalesce(n_edges, 0) AS n_edges FROM (SELECT network, count(*) AS n_nodes FROM nodes GROUP BY 1) LEFT JOIN (SELECT network, count(*) AS n_edges FROM edges GROUP BY 1) USING (network))"


def network_sizes(spark, d: str) -> DataFrame:
    n = live_nodes(spark, d).groupBy("network").agg(F.count("*").alias("n_nodes"))
    e = net_edges(spark, d).groupBy("network").agg(F.count("*").alias("n_edges"))
    return n.join(e, "network", "left").select("network", "n_nodes", F.coalesce("n_edges", F.lit(0).cast("bigint")).alias("n_edges"))


def _band(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN 'below-random' " + " ".join(f"WHEN {x} < {limit} THEN '{label}'" for limit, label in S.FRS_BANDS) + " ELSE 'exceptional' END"


_RIGOR = (
    f"{WITH_M}, {_SIZES}, {_conf('network, method')}, eff AS (SELECT network, method, CAST(sum(complexity) AS BIGINT) AS t_effective, round(avg(path_length) FILTER (WHERE path_length >= 0), 2) AS mean_path_length FROM m GROUP BY ALL), "
    f"j AS (SELECT network, method, n_nodes, n_edges, total, t_effective, mean_path_length, {_KAPPA} AS k FROM conf JOIN eff USING (network, method) JOIN sizes USING (network)), "
    "s AS (SELECT *, round(CASE WHEN total * (n_nodes + n_edges) > 1 THEN k * log2(total * (n_nodes + n_edges)) ELSE 0.0 END, 4) AS frs, round(CASE WHEN t_effective * (n_nodes + n_edges) > 1 THEN k * log2(t_effective * (n_nodes + n_edges)) ELSE 0.0 END, 4) AS dars FROM j) "
    f"SELECT network, method, n_nodes, n_edges, total, t_effective, mean_path_length, round(k, 4) AS kappa, frs, {_band('frs')} AS frs_band, dars, {_band('dars')} AS dars_band FROM s"
)


@query(_RIGOR)
def agg9_rigor_scores(spark, d: str) -> DataFrame:
    """AGG9, AGG10, AGG12, AGG13, AGG14 in one report."""
    return M.rigor(master(spark, d), network_sizes(spark, d), KEYS, ["network"])


_STRATA = (
    f"{WITH_M}, ms AS (SELECT *, CASE WHEN complexity <= 1 THEN 'easy' WHEN complexity = 2 THEN 'medium' ELSE 'hard' END AS stratum FROM m), {_conf('network, method, stratum', 'ms')}, "
    "every AS (SELECT network, method, stratum FROM (SELECT DISTINCT network, method FROM m), (SELECT unnest(['easy', 'medium', 'hard']) AS stratum)) "
    f"SELECT network, method, stratum, coalesce(total, 0) AS n, coalesce(n_correct, 0) AS n_correct, round(n_correct * 100.0 / total, 1) AS accuracy, CASE WHEN total >= 5 THEN round({_KAPPA}, 4) END AS kappa FROM every LEFT JOIN conf USING (network, method, stratum)"
)


@query(_STRATA)
def agg11_stratified(spark, d: str) -> DataFrame:
    return M.stratified(master(spark, d), KEYS)


@query()
def agg15_bootstrap(spark, d: str) -> DataFrame:
    """Seeded hash draws; no SQL twin (the draws are not portable), tested for width and coverage."""
    return M.bootstrap(master(spark, d), ["method"])


def _pairs(spark, d: str, a: str, b: str) -> DataFrame:
    """Each network's tests under two methods; of repeated rows the smallest key counts."""
    m = M.best_by(master(spark, d), ["network", "test_id", "method"], F.col("master_key")).select("network", "test_id", "method", F.coalesce("correct", F.lit(False)).alias("r"))
    return m.where(F.col("method") == a).select("network", "test_id", F.col("r").alias("right_a")).join(m.where(F.col("method") == b).select("network", "test_id", F.col("r").alias("right_b")), ["network", "test_id"])


@query(
    f"{WITH_M}, one AS (SELECT * FROM (SELECT network, test_id, method, coalesce(correct, false) AS r, row_number() OVER (PARTITION BY network, test_id, method ORDER BY master_key) AS rn FROM m) WHERE rn = 1), "
    "p AS (SELECT x.r AS ra, y.r AS rb FROM one x JOIN one y ON x.network = y.network AND x.test_id = y.test_id WHERE x.method = 'Algebraic' AND y.method = 'ODE'), "
    "k AS (SELECT count(*) AS n_paired, count(*) FILTER (WHERE ra AND rb) AS a, count(*) FILTER (WHERE ra AND NOT rb) AS b, count(*) FILTER (WHERE NOT ra AND rb) AS c, count(*) FILTER (WHERE NOT ra AND NOT rb) AS d FROM p) "
    "SELECT n_paired, a, b, c, d, round(CASE WHEN b + c = 0 THEN 0.0 WHEN b + c >= 25 THEN power(abs(b - c) - 1, 2) / (b + c) ELSE CAST(least(b, c) AS DOUBLE) END, 4) AS statistic, CASE WHEN b + c = 0 THEN 'none' WHEN b + c >= 25 THEN 'chi_square' ELSE 'exact' END AS test_type FROM k"
)
def agg16_mcnemar(spark, d: str) -> DataFrame:
    return M.mcnemar(_pairs(spark, d, "Algebraic", "ODE"), []).drop("p_value")


@query(
    f"{WITH_M}, n AS (SELECT network, method, count(*) AS n, count(*) FILTER (WHERE expected = predicted) AS same FROM m GROUP BY ALL), a AS (SELECT network, method, expected AS l, count(*) AS x FROM m GROUP BY ALL), b AS (SELECT network, method, predicted AS l, count(*) AS y FROM m GROUP BY ALL), "
    "pe AS (SELECT a.network, a.method, sum(x * y) AS xy FROM a JOIN b ON a.network = b.network AND a.method = b.method AND a.l = b.l GROUP BY ALL), z AS (SELECT n.network, n.method, n, same, coalesce(xy, 0) / (CAST(n AS DOUBLE) * n) AS e FROM n LEFT JOIN pe ON n.network = pe.network AND n.method = pe.method) "
    "SELECT network, method, n, round(CASE WHEN e >= 1 THEN 0.0 ELSE (CAST(same AS DOUBLE) / n - e) / (1 - e) END, 4) AS kappa FROM z"
)
def agg17_observed_kappa(spark, d: str) -> DataFrame:
    return M.observed_kappa(master(spark, d), KEYS)


_ACC = "count(*) AS n, count(*) FILTER (WHERE expected IS NOT DISTINCT FROM predicted) AS n_correct, round(count(*) FILTER (WHERE expected IS NOT DISTINCT FROM predicted) * 100.0 / count(*), {0}) AS accuracy"


@query(f"{WITH_M} SELECT network, method, {_ACC.format(1)} FROM m GROUP BY ALL")
def agg18_accuracy_by_network(spark, d: str) -> DataFrame:
    return M.accuracy_by(master(spark, d), KEYS)


@query(f"{WITH_M}, ml AS (SELECT *, CASE WHEN complexity <= 1 THEN 'easy' WHEN complexity = 2 THEN 'medium' ELSE 'hard' END AS label FROM m) SELECT method, label, complexity, {_ACC.format(2)} FROM ml GROUP BY ALL")
def agg19_accuracy_by_complexity(spark, d: str) -> DataFrame:
    return M.accuracy_by(master(spark, d).withColumn("label", S.complexity_label(F.col("complexity"))), ["method", "label", "complexity"], 2)


@query(f"{WITH_M}, mp AS (SELECT *, least(path_length, 7) AS path FROM m WHERE path_length >= 0) SELECT method, path, {_ACC.format(2)} FROM mp GROUP BY ALL")
def agg20_accuracy_by_path(spark, d: str) -> DataFrame:
    return M.accuracy_by(master(spark, d).where("path_length >= 0").withColumn("path", F.least("path_length", F.lit(7))), ["method", "path"], 2)


@query(
    f"{WITH_M}, ml AS (SELECT *, CASE WHEN complexity <= 1 THEN 'easy' WHEN complexity = 2 THEN 'medium' ELSE 'hard' END AS label, least(path_length, 7) AS path FROM m) "
    f"SELECT method, network, label, path, CAST(grouping(network, label, path) AS BIGINT) AS level, {_ACC.format(2)} FROM ml GROUP BY GROUPING SETS ((method, network), (method, label), (method, path))"
)
def agg18_20_grouping_sets(spark, d: str) -> DataFrame:
    """The three accuracy reports as one pass."""
    m = master(spark, d).withColumn("label", S.complexity_label(F.col("complexity"))).withColumn("path", F.least("path_length", F.lit(7)))
    right = F.count_if(F.col("expected").eqNullSafe(F.col("predicted")))
    g = m.groupingSets([["method", "network"], ["method", "label"], ["method", "path"]], "method", "network", "label", "path")
    level = (F.grouping("network") * 4 + F.grouping("label") * 2 + F.grouping("path")).cast("bigint").alias("level")
    return g.agg(level, F.count("*").alias("n"), right.alias("n_correct"), F.round(right * 100.0 / F.count("*"), 2).alias("accuracy"))


@query(
    f"{WITH_M}, {_SIZES}, g AS (SELECT network, method, count(*) AS n, round(count(*) FILTER (WHERE expected IS NOT DISTINCT FROM predicted) * 100.0 / count(*), 1) AS accuracy FROM m GROUP BY ALL) "
    "SELECT network, n_nodes, n_edges, max(n) FILTER (WHERE method = 'Algebraic') AS n_algebraic, max(accuracy) FILTER (WHERE method = 'Algebraic') AS acc_algebraic, max(n) FILTER (WHERE method = 'ODE') AS n_ode, max(accuracy) FILTER (WHERE method = 'ODE') AS acc_ode, "
    "max(n) FILTER (WHERE method = 'RWR') AS n_rwr, max(accuracy) FILTER (WHERE method = 'RWR') AS acc_rwr FROM g JOIN sizes USING (network) GROUP BY network, n_nodes, n_edges"
)
def agg21_network_summary(spark, d: str) -> DataFrame:
    g = M.accuracy_by(master(spark, d), KEYS)
    at = lambda c, m: F.max(F.when(F.col("method") == m, F.col(c)))
    wide = g.groupBy("network").agg(*[at(c, m).alias(f"{n}_{m.lower()}") for m in ("Algebraic", "ODE", "RWR") for c, n in (("n", "n"), ("accuracy", "acc"))])
    return wide.join(network_sizes(spark, d), "network").select("network", "n_nodes", "n_edges", *[f"{n}_{m}" for m in ("algebraic", "ode", "rwr") for n in ("n", "acc")])


@query(
    _RIGOR.split("SELECT network, method, n_nodes, n_edges, total, t_effective, mean_path_length, round(k, 4)")[0] + "SELECT network, method AS best_method, dars AS best_dars FROM (SELECT *, row_number() OVER (PARTITION BY network ORDER BY dars DESC, method) AS rn FROM s) WHERE rn = 1"
)
def agg23_best_method(spark, d: str) -> DataFrame:
    """Best method of each network by DARS, ties by name."""
    return M.best_by(agg9_rigor_scores(spark, d), ["network"], F.col("dars").desc(), F.col("method")).select("network", F.col("method").alias("best_method"), F.col("dars").alias("best_dars"))



@query(_STRATA.replace("SELECT network, method, stratum, coalesce(total, 0) AS n,", "SELECT method, measure, stratum, value FROM (SELECT 'n' AS measure, method, stratum, CAST(sum(coalesce(total, 0)) AS DOUBLE) AS value FROM every LEFT JOIN conf USING (network, method, stratum) GROUP BY ALL UNION ALL SELECT 'n_correct', method, stratum, CAST(sum(coalesce(n_correct, 0)) AS DOUBLE) FROM every LEFT JOIN conf USING (network, method, stratum) GROUP BY ALL) --"))
def agg24_stratified_long(spark, d: str) -> DataFrame:
    s = M.stratified(master(spark, d), KEYS).groupBy("method", "stratum").agg(F.sum("n").cast("double").alias("n"), F.sum("n_correct").cast("double").alias("n_correct"))
    return s.unpivot(["method", "stratum"], ["n", "n_correct"], "measure", "value")


@query(
    f"{WITH_M}, g AS (SELECT network, method, count(*) FILTER (WHERE expected IS NOT DISTINCT FROM predicted) * 100.0 / count(*) AS a FROM m GROUP BY ALL), b AS (SELECT network, max(a) AS a FROM g GROUP BY 1) "
    "SELECT count(*) AS n_networks, round(min(a), 4) AS min_best, round(max(a), 4) AS max_best, round(avg(a), 4) AS mean_best FROM b"
)
def agg34_best_accuracy_spread(spark, d: str) -> DataFrame:
    g = M.confusion(master(spark, d), KEYS).select("network", M.accuracy().alias("a")).groupBy("network").agg(F.max("a").alias("a"))
    return g.agg(F.count("*").alias("n_networks"), F.round(F.min("a"), 4).alias("min_best"), F.round(F.max("a"), 4).alias("max_best"), F.round(F.avg("a"), 4).alias("mean_best"))


@query(
    "WITH r AS (SELECT *, CASE WHEN regexp_matches(lower(coalesce(phenotype_node, '')), 'root|lateral') THEN 'root' WHEN regexp_matches(lower(coalesce(phenotype_node, '')), 'leaf|rosette|petal') THEN 'leaf' WHEN regexp_matches(lower(coalesce(phenotype_node, '')), 'stem|wood|tiller|bud') THEN 'stem' ELSE 'other' END AS bucket FROM ode_validation_results) "
    "SELECT bucket, count(*) AS n, count(*) FILTER (WHERE coalesce(correct, false)) AS n_correct FROM r GROUP BY 1"
)
def agg35_keyword_buckets(spark, d: str) -> DataFrame:
    p = F.lower(F.coalesce("phenotype_node", F.lit("")))
    bucket = F.when(p.rlike("root|lateral"), "root").when(p.rlike("leaf|rosette|petal"), "leaf").when(p.rlike("stem|wood|tiller|bud"), "stem").otherwise("other")
    return load(spark, d, "ode_validation_results").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("correct", F.lit(False))).alias("n_correct"))


# ---- windows and ranking


@query(
    f"{WITH_M}, g AS (SELECT network, method, count(*) FILTER (WHERE expected IS NOT DISTINCT FROM predicted) * 100.0 / count(*) AS a FROM m GROUP BY ALL), {_conf('network, method')}, j AS (SELECT network, method, round(a, 1) AS accuracy, round({_MCC}, 4) AS mcc FROM g JOIN conf USING (network, method)) "
    "SELECT network, method, accuracy, mcc FROM (SELECT *, row_number() OVER (PARTITION BY network ORDER BY accuracy DESC, mcc DESC, CASE method WHEN 'Algebraic' THEN 0 WHEN 'ODE' THEN 1 ELSE 2 END) AS rn FROM j) WHERE rn = 1"
)
def win2_best_method(spark, d: str) -> DataFrame:
    order = F.when(F.col("method") == "Algebraic", 0).when(F.col("method") == "ODE", 1).otherwise(2)
    return M.best_by(M.summary(master(spark, d), KEYS).select(*KEYS, "accuracy", "mcc"), ["network"], F.col("accuracy").desc(), F.col("mcc").desc(), order)


@query(
    "SELECT doi, paper_key, year FROM (SELECT doi, paper_key, year, row_number() OVER (PARTITION BY lower(trim(doi)) ORDER BY CASE WHEN withdrawn_at IS NULL THEN 0 ELSE 1 END, coalesce(year, 9999), paper_key) AS rn FROM papers WHERE length(trim(doi)) > 0) WHERE rn = 1"
)
def win4_primary_paper(spark, d: str) -> DataFrame:
    """Of the rows of one DOI spelling the one to cite: not withdrawn first, oldest year, smallest key."""
    p = load(spark, d, "papers").where(F.length(F.trim("doi")) > 0).withColumn("k", F.lower(F.trim("doi")))
    return M.best_by(p, ["k"], F.when(F.col("withdrawn_at").isNull(), 0).otherwise(1), F.coalesce("year", F.lit(9999)), F.col("paper_key")).select("doi", "paper_key", "year")


@query("SELECT network, kind, record_id, iteration FROM (SELECT network, kind, record_id, iteration, row_number() OVER (PARTITION BY network, kind ORDER BY iteration DESC NULLS LAST, record_id DESC) AS rn FROM raw_records) WHERE rn = 1")
def win5_last_iteration(spark, d: str) -> DataFrame:
    return M.best_by(load(spark, d, "raw_records").select("network", "kind", "record_id", "iteration"), ["network", "kind"], F.col("iteration").desc_nulls_last(), F.col("record_id").desc())


@query("SELECT network, node_key, 'N' || lpad(CAST(row_number() OVER (PARTITION BY network ORDER BY node_key) AS VARCHAR), 5, '0') AS new_id FROM network_nodes")
def win9_renumber(spark, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("network").orderBy("node_key"))
    return load(spark, d, "network_nodes").select("network", "node_key", F.concat(F.lit("N"), F.lpad(rn.cast("string"), 5, "0")).alias("new_id"))


@query(
    "WITH a AS (SELECT network, method, avg(CASE WHEN correct THEN 100.0 ELSE 0.0 END) AS a FROM master_test_level GROUP BY ALL) SELECT network, method, round(a, 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY network ORDER BY a DESC, method) AS rn FROM a) WHERE rn = 1"
)
def win1_best_of_sweep(spark, d: str) -> DataFrame:
    a = load(spark, d, "master_test_level").groupBy("network", "method").agg(F.avg(F.when(F.col("correct"), 100.0).otherwise(0.0)).alias("a"))
    return M.best_by(a, ["network"], F.col("a").desc(), F.col("method")).select("network", "method", F.round("a", 6).alias("accuracy"))


@query()
def win8_keep_or_revert(spark, d: str) -> DataFrame:
    """Refinement rounds in order: a round is kept if it gains half a point on the best so far; two low gains end it.

    The state is an ordered fold, so it runs as one aggregate over each network's rounds (at most some dozens).
    """
    acc = load(spark, d, "raw_records").where("kind = 'accuracy_metrics'").select("network", "iteration", "record_id", F.expr("try_cast(get_json_object(body, '$.ode.accuracy') as double)").alias("a")).where("a is not null")
    rounds = acc.groupBy("network").agg(F.sort_array(F.collect_list(F.struct("iteration", "record_id", F.round(S.as_percent(F.col("a")), 4).alias("a")))).alias("rounds"))
    start = F.struct(F.lit(-1e9).alias("best"), F.lit(0).alias("kept"), F.lit(0).alias("low"), F.lit(False).alias("over"))

    def step(s, r):
        gain = r["a"] - s["best"] >= 0.5
        go_on = F.struct(F.when(gain, r["a"]).otherwise(s["best"]).alias("best"), (s["kept"] + F.when(gain, 1).otherwise(0)).alias("kept"), F.when(gain, 0).otherwise(s["low"] + 1).alias("low"), (F.when(gain, 0).otherwise(s["low"] + 1) >= 2).alias("over"))
        return F.when(s["over"], s).otherwise(go_on)

    return rounds.select("network", F.size("rounds").alias("n_rounds"), F.aggregate("rounds", start, step).alias("s")).select("network", "n_rounds", "s.best", "s.kept", "s.over")


# ---- sorts and limits


@query("SELECT result_key, log2_fold_change FROM ode_validation_results WHERE log2_fold_change IS NOT NULL ORDER BY abs(log2_fold_change) DESC NULLS LAST, result_key LIMIT 100")
def srt1_largest_effects(spark, d: str) -> DataFrame:
    r = load(spark, d, "ode_validation_results").where("log2_fold_change is not null").select("result_key", "log2_fold_change")
    return r.orderBy(F.abs("log2_fold_change").desc_nulls_last(), "result_key").limit(100)


@query("SELECT result_key, ratio, row_number() OVER (PARTITION BY network ORDER BY ratio NULLS LAST, result_key) AS place FROM ode_validation_results")
def srt2_order_with_infinity(spark, d: str) -> DataFrame:
    w = Window.partitionBy("network").orderBy(F.col("ratio").asc_nulls_last(), "result_key")
    return load(spark, d, "ode_validation_results").select("result_key", "ratio", F.row_number().over(w).cast("bigint").alias("place"))


@query(f"{WITH_M} SELECT network, method, master_key FROM (SELECT *, row_number() OVER (PARTITION BY network, method ORDER BY master_key) AS rn FROM m WHERE NOT coalesce(correct, false)) WHERE rn <= 15")
def srt7_failure_list(spark, d: str) -> DataFrame:
    w = Window.partitionBy("network", "method").orderBy("master_key")
    return master(spark, d).where(~F.coalesce("correct", F.lit(False))).withColumn("rn", F.row_number().over(w)).where("rn <= 15").select("network", "method", "master_key")
