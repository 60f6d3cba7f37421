import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sprigwork.functions import scalars as S
from sprigwork.operators import fixpoint as X
from sprigwork.operators import scenarios as R


def network(spark, edges):
    e = spark.createDataFrame([("n", s, t, x) for s, t, x in edges], "network string, source string, target string, sign int")
    return X.network_rows(e.select("network", F.col("source").alias("id")).limit(0), e)


def scenarios(spark, rows):
    return spark.createDataFrame([(k, "n", m, s, "P") for k, m, s in rows], "key string, network string, modifiers map<string,double>, supply map<string,double>, phenotype_node string")


LOOP = [("A", "B", 1), ("B", "A", -1), ("B", "P", 1), ("A", "P", -1), ("X", "Y", 1)]
RUNS = [("wt", {}, {}), ("ko", {"A": 0.0}, {}), ("oe", {"A": 2.0}, {}), ("kd", {"B": 0.5}, {"B": 0.3}), ("far", {"X": 0.0}, {}), ("null", None, None), ("odd", {"nowhere": 0.0}, {"P": 2.0})]


@pytest.mark.parametrize("method", X.METHODS)
def test_engines_agree(spark, method):
    net, scen = network(spark, LOOP), scenarios(spark, RUNS)
    a = {r.key: (r.value, r.converged, r.iterations) for r in X.with_node(X.solve_expr(scen, net, method), "P").collect()}
    b = {r.key: (r.value, r.converged, r.iterations) for r in X.solve_arrow(scen, net, method).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == pytest.approx(b[k][0], abs=1e-9) and a[k][1:] == b[k][1:]
    rest = 0.0 if method == "rwr" else 1.0
    assert a["wt"][0] == a["null"][0] == pytest.approx(rest) and a["far"][0] == pytest.approx(rest, abs=1e-3)


def test_damping_keeps_the_old_value(spark):
    one = X.solve_expr(scenarios(spark, [("oe", {"A": 2.0}, {})]), network(spark, [("A", "P", 1)]), "algebraic", {"steps": 1})
    assert X.with_node(one, "P").first().value == pytest.approx(0.3 * 2 + 0.7)


def test_epistasis_is_symmetric_and_vanishes_without_a_way(spark):
    net = network(spark, [("A", "P", 1), ("B", "P", 1), ("X", "Y", 1)])
    nodes = spark.createDataFrame([("n", x) for x in "ABX"], "network string, id string")
    ph = spark.createDataFrame([("n", "P")], "network string, phenotype string")
    rows = R.epistasis(nodes, net, ph).collect()
    assert len(rows) == 3 * 9 and all(r.node_a < r.node_b for r in rows)
    assert all(abs(r.epsilon) <= 1e-2 for r in rows if "X" in (r.node_a, r.node_b) and r.epsilon is not None)


def by_hand(edges, method, mods, sup, steps):
    """The three updates over dictionaries, one node after the other, all reading the state before the step."""
    ids = sorted({x for s, t, _ in edges for x in (s, t)})
    act, inh = {i: [s for s, t, x in edges if t == i and x > 0] for i in ids}, {i: [s for s, t, x in edges if t == i and x < 0] for i in ids}
    lone = {i for i in ids if not act[i] and not inh[i]}
    if method == "rwr":
        signal = lambda m: -1.0 if m == 0 else -0.5 if m == 0.5 else 1.0 if m >= 2 else m - 1
        start = {i: (signal(mods[i]) if i in mods else 0.0) + (min(sup[i], 1.0) if i in sup else 0.0) for i in ids}
        v = dict(start)
    else:
        v = {i: max(mods.get(i, 1.0) + sup.get(i, 0.0), 0.0) if i in lone else 1.0 for i in ids}
    hill = lambda x: x**2 * 2 / (1 + x**2)
    for n in range(1, steps + 1):
        new = {}
        for i in ids:
            if method == "rwr":
                total = sum(v[s] for s in act[i]) - sum(v[s] for s in inh[i])
                new[i] = start[i] if i in lone else 0.85 * total / (len(act[i]) + len(inh[i])) + 0.15 * start[i]
                continue
            if method == "algebraic":
                f = math.prod(max(v[s], 0.01) for s in act[i]) ** (1 / len(act[i])) if act[i] else 1.0
                f *= min(1 / max(math.prod(v[s] for s in inh[i]), 0.1), 10.0) if inh[i] else 1.0
            else:
                f = math.prod(hill(max(v[s], 0.01)) for s in act[i]) * math.prod(2 / (1 + v[s] ** 2) for s in inh[i])
            f = max(f * mods.get(i, 1.0) + sup.get(i, 0.0), 0.0)
            new[i] = f if i in lone else 0.3 * f + 0.7 * v[i] if method == "algebraic" else max(0.0, v[i] + (f - v[i]) * 0.1)
        moved = max(abs(new[i] - v[i]) for i in ids)
        v = new
        if moved < 1e-4:
            return v, True, n
    return v, False, steps


@pytest.mark.parametrize("method", X.METHODS)
def test_engine_equals_plain_loops(spark, method):
    edges = [("A", "B", 1), ("C", "B", 1), ("B", "A", -1), ("B", "P", 1), ("A", "P", -1), ("C", "P", -1), ("P", "D", 1), ("D", "C", -1)]
    runs = [("a", {"A": 0.0}, {}), ("b", {"B": 2.0, "C": 0.5}, {}), ("c", {"D": 0.1}, {"P": 0.7}), ("d", {}, {"C": 3.0})]
    got = {r.key: r for r in X.solve_expr(scenarios(spark, runs), network(spark, edges), method).collect()}
    for key, mods, sup in runs:
        state, done, n = by_hand(edges, method, mods, sup, X.DEFAULTS[method]["steps"])
        assert (got[key].converged, got[key].iterations) == (done, n)
        assert dict(zip(got[key].ids, got[key].state)) == pytest.approx(state, abs=1e-9)


def test_parts_of_a_network_and_parameters_of_a_scenario(spark, monkeypatch):
    monkeypatch.setattr(X, "PART", 3)
    net = network(spark, LOOP)
    rows = [(f"{i}", "n" if i % 7 else "gone", {"A": i / 10}, {}, "P", {"damping": 0.5} if i % 2 else None) for i in range(40)]
    scen = spark.createDataFrame(rows, "key string, network string, modifiers map<string,double>, supply map<string,double>, phenotype_node string, params map<string,double>")
    got = {r.key: (r.value, r.iterations) for r in X.solve_arrow(scen, net, "algebraic").collect()}
    assert set(got) == {str(i) for i in range(40) if i % 7}
    for damping, odd in ((0.7, 0), (0.5, 1)):
        one = {r.key: (r.value, r.iterations) for r in X.with_node(X.solve_expr(scen.drop("params"), net, "algebraic", {"damping": damping}), "P").collect()}
        assert all(got[k] == (pytest.approx(v[0], abs=1e-9), v[1]) for k, v in one.items() if int(k) % 2 == odd and k in got)


@pytest.mark.parametrize("activation", list(X.ACTIVATION))
@pytest.mark.parametrize("inhibition", list(X.INHIBITION))
def test_menu_equals_the_scalar_functions(spark, activation, inhibition):
    edges = [("A", "P", 1), ("B", "P", 1), ("C", "P", -1), ("D", "P", -1)]
    net = network(spark, edges)
    menu = spark.createDataFrame([("n", "P", activation, inhibition)], "network string, id string, activation string, inhibition string")
    values = {"A": 0.5, "B": 1.5, "C": 0.0, "D": 1.8}
    got = X.solve_arrow(scenarios(spark, [("k", values, {})]), X.with_menu(net, menu), "algebraic", {"damping": 0.0, "steps": 3}).first().value
    df = spark.createDataFrame([([0.5, 1.5], [0.0, 1.8])], "a array<double>, h array<double>")
    want = df.select(S.ACTIVATIONS[activation](F.col("a")).alias("a"), S.INHIBITIONS[inhibition](F.col("h")).alias("h")).first()
    assert got == pytest.approx(want.a * want.h, abs=1e-9)


def test_unknown_functions_are_refused():
    with pytest.raises(ValueError, match="no such function: nope"):
        X.Compiled(["A"], [{"a": [], "h": []}], [{"a": "nope", "h": None}])


def test_influences_add_and_take_away_supply(spark):
    acts = spark.createDataFrame([("n", "B", "X", 1), ("n", "B", "Y", -1), ("n", "C", "Z", 1), ("m", "B", "X", 1)], "network string, node string, source string, sign int")
    got = {r.key: r.supply for r in X.with_influences(scenarios(spark, [("a", {}, {"X": 2.0, "Y": 0.5, "B": 1.0}), ("b", {}, None), ("c", {}, {"Q": 1.0})]), acts).collect()}
    assert got == {"a": {"X": 2.0, "Y": 0.5, "B": 2.5}, "b": {}, "c": {"Q": 1.0}}


def test_trace_arrow_equals_the_other_engine(spark):
    net, scen = network(spark, LOOP), scenarios(spark, RUNS[:3])
    want = {(r.key, n, x): v for r in X.solve_expr(scen, net, "ode", trace=True).collect() for n, state in enumerate(r.trace) for x, v in zip(r.ids, state)}
    got = {(r.key, r.step, r.node): r.value for r in X.trace_arrow(scen, net, "ode").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_matrices_of_large_networks_hold_fewer_scenarios():
    small = X.Compiled(["A", "B"], [{"a": [], "h": []}, {"a": [0], "h": []}])
    n = 2000
    dense = X.Compiled([str(i) for i in range(n)], [{"a": list(range(20)), "h": list(range(20, 40))} for _ in range(n)])
    assert small.rows == X.MATRIX_ROWS and dense.rows * len(dense.a_src) <= X.MATRIX_CELLS and dense.rows > 1


def made(rng, n, least, most):
    """A network of n nodes with so many regulators each; a tenth has none."""
    kinds = [rng.permutation(n)[: rng.integers(least, most)] if rng.random() > 0.1 else [] for _ in range(n)]
    return X.Compiled([str(i) for i in range(n)], [{"a": sorted(map(int, k[: len(k) * 2 // 3])), "h": sorted(map(int, k[len(k) * 2 // 3 :]))} for k in kinds])


@pytest.mark.parametrize("params", [{}, {"k": 1.5, "n": 3.0}, {"steps": 1}, {"steps": 0}, {"dt": 1.5, "steps": 40}])
def test_networks_joined_in_one_matrix_are_solved_as_by_themselves(params, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 320)  # many blocks
    rng, p = np.random.default_rng(7), X.DEFAULTS["ode"] | params
    jobs = []
    for n, runs in ((1, 3), (5, 1), (40, 50), (90, 17), (30, 0), (300, 33)):
        gm, ex = np.ones((runs, n)), np.zeros((runs, n))
        gm[np.arange(runs), rng.integers(0, n, runs)] = rng.choice([0.0, 0.5, 2.0], runs)
        ex[rng.integers(0, max(runs, 1), runs // 4), rng.integers(0, n, runs // 4)] = rng.choice([-0.2, 0.7], runs // 4)
        jobs.append((made(rng, n, 0, min(n, 12)), gm, ex, rng.integers(-1, n, runs)))
    value, done, steps = X.solve_ode(jobs, p)
    want = [net.run("ode", gm, ex, p) for net, gm, ex, _ in jobs]
    at = [np.where(w < 0, 1.0, v[np.arange(len(w)), w]) for (_, _, _, w), (v, _, _) in zip(jobs, want)]
    assert np.array_equal(value, np.concatenate(at), equal_nan=True)
    assert np.array_equal(done, np.concatenate([x[1] for x in want])) and np.array_equal(steps, np.concatenate([x[2] for x in want]))


def test_what_is_not_a_number_does_not_stand_still(spark):
    """The factors of very many activators overflow, those of as many inhibitors vanish: their product is no number from then on."""
    rows = [("S", "Q", 1), *[x for i in range(2500) for x in (("S", f"A{i}", 1), (f"A{i}", "P", 1))], *[x for i in range(1600) for x in (("S", f"B{i}", 1), (f"B{i}", "P", -1))]]
    net, scen = network(spark, rows), scenarios(spark, [("oe", {"S": 2.0}, {}), ("wt", {}, {})])
    want = {r.key: (str(r.value), r.converged, r.iterations) for r in X.with_node(X.solve_expr(scen, net, "ode", {"steps": 60}), "P").collect()}
    assert want == {"oe": ("nan", False, 60), "wt": ("1.0", True, 1)}
    assert {r.key: (str(r.value), r.converged, r.iterations) for r in X.solve_arrow(scen, net, "ode", {"steps": 60}).collect()} == want
    # A node that has a number goes on, and so does its scenario.
    other = X.solve_arrow(scen.withColumn("phenotype_node", F.lit("Q")), net, "ode", {"steps": 60}).where("key = 'oe'").first()
    assert other.value > 1.5 and (other.converged, other.iterations) == (False, 60)


def test_a_step_of_the_ode_costs_by_nodes_and_little_by_regulators():
    rng = np.random.default_rng(3)
    net, p = made(rng, 1500, 10, 20), X.DEFAULTS["ode"] | {"steps": 20}
    gm, took = np.ones((48, 1500)), {}
    gm[np.arange(48), rng.permutation(1500)[:48]] = 0.0
    for name, f in (("joined", lambda: X.solve_ode([(net, gm, 0 * gm, np.zeros(48, int))], p)), ("alone", lambda: net.run("ode", gm, 0 * gm, p))):
        times = []
        for _ in range(3):
            began = time.process_time()
            f()
            times.append(time.process_time() - began)
        took[name] = min(times)
    assert took["joined"] < took["alone"] / 1.5
