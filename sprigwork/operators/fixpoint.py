"""Fixpoint simulators over signed networks: algebraic, Hill ODE and signed random walk with restart.

One row is one scenario. The state is an array over the network's nodes; all nodes read the state before the step. Two
engines give the same numbers: an expression engine (higher-order functions, JVM only, nothing is shuffled), and an Arrow
engine that advances many scenarios of a network as one matrix (for the ODE also of many small networks). The scenarios of a network are dealt to as many tasks as
their number asks for, and the network travels once with each such part, not with each scenario.

Semantics. Algebraic: start 1; sources (no regulators) hold max(modifier + supply, 0); others move to
(1 - damping) * f + damping * old with f = max(geomean(max(a, floor)) * min(1 / max(prod h, eps), K) * modifier + supply, 0).
ODE: x' = max(0, x + (prod - x) * dt) with Hill factors scaled to 1 at 1. Walk: s' = alpha * mean(sign * s) + (1 - alpha) * start,
without regulators s' = start. A scenario stops when no node moves by the tolerance or more, counted from step 1.

Network rows: network, ids ARRAY<STRING>, regs ARRAY<STRUCT<a ARRAY<INT>, h ARRAY<INT>>> (positions of activators and
inhibitors of each node). Scenario rows: key, network, modifiers MAP, supply MAP. Keys outside the network do nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sprigwork.functions import scalars as S
from sprigwork.session import partitions_of

METHODS = ("algebraic", "ode", "rwr")
#: Parameters of each method.
DEFAULTS = {
    "algebraic": {"damping": 0.7, "floor": 0.01, "eps": 0.1, "limit": 10.0, "tol": 1e-4, "steps": 100},
    "ode": {"k": 1.0, "n": 2.0, "dt": 0.1, "floor": 0.01, "tol": 1e-4, "steps": 500},
    "rwr": {"alpha": 0.85, "tol": 1e-4, "steps": 50},
}
ODE_SWEEP = [(k, n) for k in (0.5, 1.0, 1.5, 2.0, 3.0, 5.0) for n in (1.0, 2.0, 3.0, 4.0)]
RWR_SWEEP = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def network_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(network, ids, regs) of nodes(network, id) and edges(network, source, target, sign); end points are nodes too."""
    every = nodes.select("network", "id").union(edges.select("network", F.col("source"))).union(edges.select("network", F.col("target"))).distinct()
    ids = every.groupBy("network").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    # Positions are joined: to look names up in a network's array costs the square of its nodes.
    at = ids.select("network", F.posexplode("ids").alias("i", "id"))
    ends = edges.select("network", "source", F.col("target").alias("id"), "sign").join(at, ["network", "id"]).select("network", F.col("source").alias("id"), F.col("i").alias("t"), "sign").join(at, ["network", "id"])
    of = lambda sign: F.array_sort(F.collect_list(F.when(F.col("sign") == sign, F.col("i")))).alias("a" if sign > 0 else "h")
    regs = ends.groupBy("network", F.col("t").alias("i")).agg(of(1), of(-1))
    none = F.array().cast("array<int>")
    full = at.join(regs, ["network", "i"], "left").select("network", F.struct("i", F.struct(F.coalesce("a", none).alias("a"), F.coalesce("h", none).alias("h")).alias("r")).alias("x"))
    by_node = full.groupBy("network").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return ids.join(by_node, "network", "left").select("network", "ids", F.coalesce(F.transform("x", lambda x: x["r"]), F.array()).alias("regs"))


def _params(method: str, given: dict[str, float] | None) -> dict[str, float]:
    return DEFAULTS[method] | (given or {})


def _vectors(method: str) -> tuple[Column, Column]:
    """Per node: modifier (start signal for the walk) and supply."""
    get = lambda m, i: F.try_element_at(F.coalesce(F.col(m), F.create_map().cast("map<string,double>")), i)
    if method == "rwr":
        start = F.transform("ids", lambda i: F.coalesce(S.modifier_signal(get("modifiers", i)), F.lit(0.0)) + F.when(get("supply", i).isNull(), 0.0).otherwise(F.least(get("supply", i), F.lit(1.0))))
        return start, F.transform("ids", lambda i: F.lit(0.0))
    return F.transform("ids", lambda i: F.coalesce(get("modifiers", i), F.lit(1.0))), F.transform("ids", lambda i: F.coalesce(get("supply", i), F.lit(0.0)))


def _value(v: Column, k: Column) -> Column:
    return F.get(v, k)


def _step(method: str, v: Column, p: dict[str, Column]) -> Column:
    gm, ex = F.col("gm"), F.col("ex")

    def one(r: Column, i: Column) -> Column:
        a, h, old = F.transform(r["a"], lambda k: _value(v, k)), F.transform(r["h"], lambda k: _value(v, k)), _value(v, i)
        lone = (F.size(r["a"]) == 0) & (F.size(r["h"]) == 0)
        if method == "rwr":
            total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) - F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
            n = F.size(r["a"]) + F.size(r["h"])
            return F.when(lone, _value(gm, i)).otherwise(p["alpha"] * F.try_divide(total, n) + (1 - p["alpha"]) * _value(gm, i))
        if method == "algebraic":
            act = F.when(F.size(a) == 0, 1.0).otherwise(F.pow(F.aggregate(a, F.lit(1.0), lambda s, x: s * F.greatest(x, p["floor"])), F.try_divide(F.lit(1.0), F.size(a))))
            inh = F.when(F.size(h) == 0, 1.0).otherwise(F.least(F.try_divide(F.lit(1.0), F.greatest(F.aggregate(h, F.lit(1.0), lambda s, x: s * x), p["eps"])), p["limit"]))
            f = F.greatest(act * inh * _value(gm, i) + _value(ex, i), F.lit(0.0))
            return F.when(lone, f).otherwise((1 - p["damping"]) * f + p["damping"] * old)
        act = F.aggregate(a, F.lit(1.0), lambda s, x: s * S.hill_activation(F.greatest(x, p["floor"]), p["k"], p["n"]))
        inh = F.aggregate(h, F.lit(1.0), lambda s, x: s * S.hill_inhibition(x, p["k"], p["n"]))
        f = F.greatest(act * inh * _value(gm, i) + _value(ex, i), F.lit(0.0))
        return F.when(lone, f).otherwise(F.greatest(F.lit(0.0), old + (f - old) * p["dt"]))

    return F.transform("regs", one)


def solve_expr(scenarios: DataFrame, networks: DataFrame, method: str, params: dict[str, float] | None = None, trace: bool = False) -> DataFrame:
    """Expression engine: scenarios' columns, ids, state ARRAY<DOUBLE>, converged, iterations (and trace, one state a step).

    A parameter may also be a column of the scenarios, named like it.
    """
    given = _params(method, params)
    rows = scenarios.join(networks, "network")
    p = {k: (F.col(k) if k in scenarios.columns else F.lit(v)) for k, v in given.items()}
    gm, ex = _vectors(method)
    rows = rows.withColumn("gm", gm).withColumn("ex", ex)
    lone = lambda r: (F.size(r["a"]) == 0) & (F.size(r["h"]) == 0)
    start = F.col("gm") if method == "rwr" else F.transform("regs", lambda r, i: F.when(lone(r), F.greatest(_value(F.col("gm"), i) + _value(F.col("ex"), i), F.lit(0.0))).otherwise(1.0))
    first = F.struct(start.alias("v"), F.lit(0).alias("it"), F.lit(False).alias("done"), *([F.array(start).alias("trace")] if trace else []))

    def advance(acc: Column, _: Column) -> Column:
        def bind(nv: Column) -> Column:
            moved = F.aggregate(F.zip_with(nv, acc["v"], lambda x, y: F.abs(x - y)), F.lit(0.0), lambda m, x: F.greatest(m, x))
            return F.struct(nv.alias("v"), (acc["it"] + 1).alias("it"), (moved < p["tol"]).alias("done"), *([F.concat(acc["trace"], F.array(nv)).alias("trace")] if trace else []))

        return F.when(acc["done"], acc).otherwise(F.get(F.transform(F.array(_step(method, acc["v"], p)), bind), 0))

    end = F.aggregate(F.sequence(F.lit(1), p["steps"].cast("int")), first, advance)
    out = rows.withColumn("_end", end)
    keep = [c for c in scenarios.columns if c not in ("gm", "ex")]
    return out.select(*keep, "ids", F.col("_end.v").alias("state"), F.col("_end.done").alias("converged"), F.col("_end.it").alias("iterations"), *([F.col("_end.trace").alias("trace")] if trace else []))


#: The menu of functions of a node's activators and inhibitors (rows: scenarios), as the scalar functions of these names.
ACTIVATION = {
    "geomean": lambda x, p: np.maximum(x, p["floor"]).prod(axis=1) ** (1.0 / x.shape[1]),
    "arithmean": lambda x, p: np.maximum(x, p["floor"]).mean(axis=1),
    "max_pool": lambda x, p: np.maximum(x, p["floor"]).max(axis=1),
    "min_pool": lambda x, p: np.maximum(x, p["floor"]).min(axis=1),
}
INHIBITION = {
    "bounded_inverse": lambda x, p: np.minimum(1.0 / np.maximum(x.prod(axis=1), p["eps"]), p["limit"]),
    "independent_inverse": lambda x, p: np.minimum(1.0 / np.maximum(x, p["eps"]), p["limit"]).prod(axis=1),
    "linear_clamp": lambda x, p: np.clip(2.0 - x, 0.0, 1.0).prod(axis=1),
}
DEFAULT_MENU = ("geomean", "bounded_inverse")


class Compiled:
    """A network's regulators as flat arrays for whole-matrix steps."""

    def __init__(self, ids: list[str], regs: list[dict], menu: list[dict] | None = None) -> None:
        self.ids, n = ids, len(ids)
        self.special = {i: (m["a"] or DEFAULT_MENU[0], m["h"] or DEFAULT_MENU[1], regs[i]["a"], regs[i]["h"]) for i, m in enumerate(menu or ()) if m and (m["a"] or m["h"])}
        if unknown := sorted({x for m in self.special.values() for x in m[:2]} - {*ACTIVATION, *INHIBITION}):
            raise ValueError(f"no such function: {', '.join(unknown)}")
        self.at = {x: i for i, x in enumerate(ids)}
        self.lone = np.array([not r["a"] and not r["h"] for r in regs], bool)
        flat = lambda key: (np.array([k for r in regs for k in r[key]], int), np.array([i for i, r in enumerate(regs) for _ in r[key]], int))
        (self.a_src, self.a_dst), (self.h_src, self.h_dst) = flat("a"), flat("h")
        self.na, self.nh = np.bincount(self.a_dst, minlength=n), np.bincount(self.h_dst, minlength=n)
        self.rows = max(1, min(MATRIX_ROWS, MATRIX_CELLS // max(1, n, len(self.a_src), len(self.h_src))))

    @cached_property
    def plan(self) -> Plan:
        return Plan([self])

    @staticmethod
    def _fold(values: np.ndarray, dst: np.ndarray, n: int, times: bool) -> np.ndarray:
        """Product (or sum) of the columns of each target; targets in order, empty ones neutral."""
        out = np.ones((len(values), n)) if times else np.zeros((len(values), n))
        if len(dst):
            starts = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
            out[:, dst[starts]] = (np.multiply if times else np.add).reduceat(values, starts, axis=1)
        return out

    def run(self, method: str, gm: np.ndarray, ex: np.ndarray, p: dict[str, float], seen: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """End states, whether they stand still, and steps; seen: gets the states of all steps (for runs of one scenario)."""
        m, n = gm.shape
        v = gm.copy() if method == "rwr" else np.where(self.lone, np.maximum(gm + ex, 0.0), 1.0)
        steps, done, live = np.zeros(m, np.int32), np.zeros(m, bool), np.arange(m)
        if seen is not None:
            seen.append(v.copy())
        for it in range(1, int(p["steps"]) + 1):
            if not len(live):
                break
            x, g, e = v[live], gm[live], ex[live]
            if method == "rwr":
                total = self._fold(x[:, self.a_src], self.a_dst, n, False) - self._fold(x[:, self.h_src], self.h_dst, n, False)
                new = np.where(self.lone, g, p["alpha"] * total / np.maximum(self.na + self.nh, 1) + (1 - p["alpha"]) * g)
            elif method == "algebraic":
                act = self._fold(np.maximum(x[:, self.a_src], p["floor"]), self.a_dst, n, True) ** (1.0 / np.maximum(self.na, 1))
                inh = np.where(self.nh > 0, np.minimum(1.0 / np.maximum(self._fold(x[:, self.h_src], self.h_dst, n, True), p["eps"]), p["limit"]), 1.0)
                for i, (a_name, h_name, a, h) in self.special.items():
                    act[:, i] = ACTIVATION[a_name](x[:, a], p) if a else 1.0
                    inh[:, i] = INHIBITION[h_name](x[:, h], p) if h else 1.0
                f = np.maximum(act * inh * g + e, 0.0)
                new = np.where(self.lone, f, (1 - p["damping"]) * f + p["damping"] * x)
            else:
                kn = p["k"] ** p["n"]
                xa = np.maximum(x[:, self.a_src], p["floor"]) ** p["n"]
                xh = np.maximum(x[:, self.h_src], 0.0) ** p["n"]
                f = np.maximum(self._fold(xa * (kn + 1) / (kn + xa), self.a_dst, n, True) * self._fold((kn + 1) / (kn + xh), self.h_dst, n, True) * g + e, 0.0)
                new = np.where(self.lone, f, np.maximum(0.0, x + (f - x) * p["dt"]))
            still = ~(np.abs(new - x).max(axis=1, initial=0.0) < p["tol"])  # what is not a number does not stand still
            v[live], steps[live], done[live] = new, it, ~still
            if seen is not None:
                seen.append(v.copy())
            live = live[still]
        return v, done, steps


class Plan:
    """The rows of one or more networks' nodes in one matrix (columns: scenarios), in an order in which their regulators multiply fast.

    Nodes go by their number of activators, so that the k-th factors of a block's nodes are taken and multiplied at once; nodes
    with very many regulators go first and one by one, those without any last. Factors keep the order they have in the network.
    """

    def __init__(self, nets: list[Compiled]) -> None:
        starts = np.cumsum([0, *(len(t.ids) for t in nets)])
        joined = lambda name: np.concatenate([getattr(t, name) + s for t, s in zip(nets, starts)])
        self.n, lone = int(starts[-1]), np.concatenate([t.lone for t in nets])
        na, nh = np.concatenate([t.na for t in nets]), np.concatenate([t.nh for t in nets])
        many = lambda deg: deg > (np.partition(deg, -FEWEST)[-FEWEST] if self.n >= FEWEST else deg.max())
        kind = np.where(lone, 2, np.where(many(na) | many(nh), 0, 1))
        order, at = np.lexsort((-nh, -na, kind)), np.empty(self.n, int)
        at[order] = np.arange(self.n)
        self.rows, hubs, self.end = np.split(at, starts[1:-1]), int((kind == 0).sum()), int((kind < 2).sum())
        a_src, h_src, a_at, h_at = at[joined("a_src")], at[joined("h_src")], np.cumsum(na) - na, np.cumsum(nh) - nh
        self.hubs = [(a_src[a_at[i] : a_at[i] + na[i]], h_src[h_at[i] : h_at[i] + nh[i]]) for i in order[:hubs]]

        def factors(nodes: np.ndarray, src: np.ndarray, first: np.ndarray, deg: np.ndarray) -> list[np.ndarray]:
            return [src[first[nodes[:c]] + k] for k in range(deg[nodes[0]]) if (c := np.searchsorted(-deg[nodes], -k))]

        self.blocks, step = [], BLOCK // COLUMNS
        for lo in range(hubs, self.end, step):
            nodes = order[lo : min(lo + step, self.end)]
            by_h = np.argsort(-nh[nodes], kind="stable")
            self.blocks.append((lo, lo + len(nodes), factors(nodes, a_src, a_at, na), factors(nodes[by_h], h_src, h_at, nh), np.argsort(by_h)))


def _product(f: np.ndarray, factors: list[np.ndarray], out: np.ndarray, t: np.ndarray) -> None:
    if factors:
        f.take(factors[0], 0, out[: len(factors[0])], "clip")
    out[len(factors[0]) if factors else 0 :] = 1.0
    for k in factors[1:]:
        o = out[: len(k)]
        np.multiply(o, f.take(k, 0, t[: len(k)], "clip"), o)


class Joined:
    """The ODE states of a plan's nodes over some scenarios, and the steps of all of them at once; the same numbers as Compiled.run."""

    def __init__(self, plan: Plan, x: np.ndarray, gm: tuple[np.ndarray, ...], ex: tuple[np.ndarray, ...], p: dict[str, float]) -> None:
        """gm, ex: row, column and number of modifiers that are not 1 and of supplies that are not 0."""
        self.plan, self.p, self.kn, self.x, self.y = plan, p, p["k"] ** p["n"], x, x.copy()
        self.gm, self.ex = (tuple(c[np.argsort(z[0], kind="stable")] for c in z) for z in (gm, ex))
        self.below = not (0 <= p["dt"] <= 1 and all((z[2] >= 0).all() for z in (gm, ex)))  # else no number is below 0, and none is raised to it
        blocks = [*[(0, len(plan.hubs))] * bool(plan.hubs), *(b[:2] for b in plan.blocks)]
        self.cells = {lo: [tuple(c[slice(*np.searchsorted(z[0], (lo, hi)))] for c in z) for z in (self.gm, self.ex)] for lo, hi in blocks}
        self.f = [np.empty_like(x) for _ in range(4)]  # Hill factors as an activator and as an inhibitor, now and after the step
        size = max([plan.n - plan.end, *(hi - lo for lo, hi in blocks)])
        self.t = [np.empty((size, x.shape[1])) for _ in range(3)]
        for lo, hi in [*blocks, (plan.end, plan.n)]:
            self._hill(lo, hi, x, *self.f[:2])
        for now, after in zip(self.f[:2], self.f[2:]):
            after[plan.end :] = now[plan.end :]

    def _hill(self, lo: int, hi: int, x: np.ndarray, fa: np.ndarray, fh: np.ndarray) -> None:
        x, a, h, t, n, kn = x[lo:hi], fa[lo:hi], fh[lo:hi], self.t[1][: hi - lo], self.p["n"], self.kn
        np.maximum(x, self.p["floor"], out=a)
        for z, of in ((a, a), (h, x)):  # states are not negative
            np.multiply(of, of, out=z) if n == 2 else np.power(of, n, out=z)
        np.add(a, kn, out=t)
        a *= kn + 1
        a /= t
        h += kn
        np.divide(kn + 1, h, out=h)

    def _move(self, lo: int, hi: int) -> None:
        """The next state of rows of which the products of their factors are there."""
        f, x, y = self.t[0][: hi - lo], self.x[lo:hi], self.y[lo:hi]
        (r, c, g), (s, d, e) = self.cells[lo]
        if len(r):
            f[r - lo, c] *= g
        if len(s):
            f[s - lo, d] += e
        if self.below:
            np.maximum(f, 0.0, out=f)
        np.subtract(f, x, out=y)
        y *= self.p["dt"]
        y += x
        if self.below:
            np.maximum(y, 0.0, out=y)
        self._hill(lo, hi, self.y, *self.f[2:])

    def step(self) -> None:
        """Afterwards y has the new states and x those before."""
        self.x, self.y = self.y, self.x
        fa, fh, (f, t, u) = self.f[0], self.f[1], self.t
        for i, (a, h) in enumerate(self.plan.hubs):
            f[i] = np.multiply.reduce(fa.take(a, 0), axis=0) * np.multiply.reduce(fh.take(h, 0), axis=0)
        if self.plan.hubs:
            self._move(0, len(self.plan.hubs))
        for lo, hi, a, h, back in self.plan.blocks:
            _product(fa, a, f[: hi - lo], t)
            if h:
                _product(fh, h, u[: hi - lo], t)
                f[: hi - lo] *= u.take(back, 0, t[: hi - lo], "clip")
            self._move(lo, hi)
        self.f = [*self.f[2:], *self.f[:2]]


def columns_of(net: Compiled) -> int:
    """Scenarios of a network that go into one matrix of ODE runs: one stretch of a large one, as its plan is kept."""
    whole = JOINED // (COLUMNS * max(1, len(net.ids)))
    return COLUMNS * (whole if whole > 3 else 1)


def solve_ode(jobs: list[tuple[Compiled, np.ndarray, np.ndarray, np.ndarray]], p: dict[str, float], missing: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value of the watched node, whether it stands still, and steps of all scenarios of jobs (network, modifiers, supplies, position
    of the watched node or -1), which are run as one matrix. Scenarios that stand still leave it. One whose watched node is not a
    number leaves it too: that stays so, such a node moves in every step, and its steps are all there are."""
    first, limit, tol = np.cumsum([0, *(len(j[1]) for j in jobs)]), int(p["steps"]), p["tol"]
    value, done, steps = np.full(first[-1], missing), np.zeros(first[-1], bool), np.full(first[-1], limit, np.int32)
    live = [(j, np.arange(len(gm)), np.where(net.lone, np.maximum(gm + ex, 0.0), 1.0).T) for j, (net, gm, ex, _) in enumerate(jobs) if len(gm)]
    it = 0
    while live:
        width = min(COLUMNS, max(len(c) for _, c, _ in live))
        cut = [(j, c[i : i + width], x[:, i : i + width]) for j, c, x in live for i in range(0, len(c), width)]
        plan = jobs[cut[0][0]][0].plan if len(cut) == 1 else Plan([jobs[j][0] for j, _, _ in cut])
        x, at = np.ones((plan.n, width)), np.full((len(cut), width), -1)
        watched, cells, column = np.full((len(cut), width), -1), ([], []), np.arange(width)
        for s, ((j, c, x0), rows) in enumerate(zip(cut, plan.rows)):
            x[rows, : len(c)], at[s, : len(c)] = x0, first[j] + c
            w = jobs[j][3][c]
            watched[s, : len(c)] = np.where(w < 0, -1, rows[w])
            for z, of, rest in ((cells[0], jobs[j][1], 1.0), (cells[1], jobs[j][2], 0.0)):
                k, r = np.nonzero((g := of[c]) != rest)
                z.append((rows[r], k, g[k, r]))
        m = Joined(plan, x, *(tuple(map(np.concatenate, zip(*z))) for z in cells), p)
        begun, top = (at >= 0).sum(), np.stack([np.full(width, rows[0]) for rows in plan.rows])  # top: a node that moves, for each scenario

        def end(those: np.ndarray, state: np.ndarray, still: bool) -> None:
            k, seen = at[those], watched[those] >= 0
            value[k[seen]] = state[watched[those][seen], np.nonzero(those)[1][seen]]
            done[k], steps[k] = still, it if still else limit
            at[those] = -1

        while True:
            if it >= limit:
                end(at >= 0, m.y, False)
                return value, done, steps
            it += 1
            m.step()
            low = (at >= 0) & (np.abs(m.y[top, column] - m.x[top, column]) < tol)
            over = np.zeros_like(low)
            for s in np.flatnonzero(low.any(axis=1)):
                moved = np.abs(m.y.take(plan.rows[s], 0) - m.x.take(plan.rows[s], 0))
                most = moved.argmax(axis=0)  # of a number and none, none
                top[s], over[s] = plan.rows[s][most], low[s] & (moved[most, column] < tol)
            none = (at >= 0) & (watched >= 0) & np.isnan(m.y[watched, column])
            if over.any() or none.any():
                end(over, m.y, True)
                end(none & ~over, m.y, False)
                left = at >= 0
                if left.sum() <= REPACK * begun:
                    break
        kept: dict[int, list] = {}
        for s, (j, c, _) in enumerate(cut):
            if (ok := left[s, : len(c)]).any():
                kept.setdefault(j, []).append((c[ok], m.y[plan.rows[s]][:, : len(c)][:, ok]))
        live = [(j, np.concatenate([c for c, _ in z]), np.concatenate([y for _, y in z], axis=1)) for j, z in kept.items()]
    return value, done, steps


#: Scenarios that one matrix holds at most, and that one part of a network's scenarios holds about; numbers that one matrix holds
#: at most, so that scenarios of a network of many nodes and regulators go in shorter stretches (a step holds some ten matrices).
MATRIX_ROWS, PART, MATRIX_CELLS = 512, 2048, 1_000_000
#: Nodes above which a part has a quarter of the scenarios, as each of them costs by the nodes.
LARGE = 2_000
#: Of the ODE's matrix: columns, numbers it holds about, numbers of the block of rows that is worked on at once, the fewest nodes that
#: are multiplied together, and the share of scenarios left at which it is packed anew.
COLUMNS, JOINED, BLOCK, FEWEST, REPACK = 16, 262_144, 16_384, 16, 0.7
_SENT = "network string, part int, kind int, key string, modifiers map<string,double>, supply map<string,double>, watched string, params map<string,double>, ids array<string>, regs array<struct<a:array<int>,h:array<int>>>, menu array<struct<a:string,h:string>>"


def _parts(scenarios: DataFrame, networks: DataFrame) -> DataFrame:
    """Scenarios and networks as one stream: of each part of a network first the network, then its scenarios by parameters."""
    spark = scenarios.sparkSession
    nodes = networks.select("network", F.size("ids").alias("nodes"))
    share = F.when(F.col("nodes") > LARGE, PART / 4).otherwise(PART)
    sizes = scenarios.groupBy("network").agg(F.count("*").alias("n")).join(nodes, "network", "left").select("network", (F.floor(F.col("n") / share) + 1).cast("int").alias("parts"))
    has = lambda df, c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    number = "map<string,double>"
    ask = scenarios.join(sizes, "network").select(
        "network", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("key").cast("string").alias("key"), F.col("modifiers").cast(number).alias("modifiers"), F.col("supply").cast(number).alias("supply"),
        F.col("watched").cast("string").alias("watched"), has(scenarios, "params", number), none("ids", "array<string>"), none("regs", "array<struct<a:array<int>,h:array<int>>>"), none("menu", "array<struct<a:string,h:string>>"),
    )
    nets = networks.join(sizes, "network").select(
        "network", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), none("key", "string"), none("modifiers", number), none("supply", number), none("watched", "string"), none("params", number),
        "ids", "regs", has(networks, "menu", "array<struct<a:string,h:string>>"),
    )
    order = F.coalesce(F.to_json("params"), F.lit(""))
    return ask.unionByName(nets).withColumn("o", order).repartition(partitions_of(spark), "network", "part").sortWithinPartitions("network", "part", "kind", "o").drop("o")


def _vectors_of(net: Compiled, method: str, mods: list, sups: list) -> tuple[np.ndarray, np.ndarray]:
    """Modifier (start signal for the walk) and supply of each scenario and node."""
    shape = (len(mods), len(net.ids))
    gm, ex = np.full(shape, 0.0 if method == "rwr" else 1.0), np.zeros(shape)
    for r, (mod, sup) in enumerate(zip(mods, sups)):
        for node, x in mod or ():
            if node in net.at and x is not None:
                gm[r, net.at[node]] = (-1.0 if x == 0 else -0.5 if x == 0.5 else 1.0 if x >= 2 else x - 1.0) if method == "rwr" else x
        for node, x in sup or ():
            if node in net.at and x is not None:
                if method == "rwr":
                    gm[r, net.at[node]] += min(x, 1.0)
                else:
                    ex[r, net.at[node]] = x
    return gm, ex


def _solve(scenarios: DataFrame, networks: DataFrame, method: str, given: dict[str, float], trace: bool) -> DataFrame:
    def runs(batches: Iterator[pa.RecordBatch], most: Callable[[Compiled], int] = lambda net: net.rows) -> Iterator[tuple[Compiled, list[tuple], dict[str, float]]]:
        """Stretches of scenarios of one network and one set of parameters, at most as long as one matrix of it."""
        net, held, params, at = None, [], None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for i, (name, part, kind, key, mod, sup, watched, own) in enumerate(zip(*columns)):
                if kind == 0 or (name, part) != at or own != params or len(held) == (most(net) if net else MATRIX_ROWS):
                    if held and net:
                        yield net, held, given | dict(params or ())
                    held = []
                if kind == 0:
                    net, at = Compiled(batch.column(8)[i].as_py(), batch.column(9)[i].as_py(), batch.column(10)[i].as_py()), (name, part)
                else:
                    if (name, part) != at:  # no such network
                        net, at = None, (name, part)
                    params = own
                    held.append((key, mod, sup, watched))
        if held and net:
            yield net, held, given | dict(params or ())

    missing = 0.0 if method == "rwr" else 1.0
    found = lambda rows, value, done, steps: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array(value, pa.float64()), pa.array(done), pa.array(steps, pa.int32())], names=["key", "value", "converged", "iterations"])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for net, rows, p in runs(batches):
            v, done, steps = net.run(method, *_vectors_of(net, method, [r[1] for r in rows], [r[2] for r in rows]), p)
            yield found(rows, [float(v[i, net.at[r[3]]]) if r[3] in net.at else missing for i, r in enumerate(rows)], done, steps)

    def ode_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small networks are run together, as many as one matrix holds; a large one by itself."""
        jobs, at, held = [], None, 0

        def solved() -> pa.RecordBatch:
            vectors = ((net, *_vectors_of(net, method, [r[1] for r in rows], [r[2] for r in rows]), np.array([net.at.get(r[3], -1) for r in rows])) for net, rows in jobs)
            return found([r for _, rows in jobs for r in rows], *solve_ode(list(vectors), at, missing))

        for net, rows, p in runs(batches, columns_of):
            more = -(-len(rows) // COLUMNS) * COLUMNS * len(net.ids)
            if jobs and (p != at or held + more > JOINED or columns_of(net) == COLUMNS):
                yield solved()
                jobs, held = [], 0
            jobs.append((net, rows))
            at, held = p, held + more
        if jobs:
            yield solved()

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for net, rows, p in runs(batches):
            for i, r in enumerate(rows):
                seen: list[np.ndarray] = []
                net.run(method, *_vectors_of(net, method, [r[1]], [r[2]]), p, seen)
                yield pa.RecordBatch.from_arrays([pa.array([r[0]] * len(seen), pa.string()), pa.array(range(len(seen)), pa.int32()), pa.array([net.ids] * len(seen), pa.list_(pa.string())), pa.array([x[0].tolist() for x in seen], pa.list_(pa.float64()))], names=["key", "step", "ids", "v"])

    sent = _parts(scenarios, networks)
    return sent.mapInArrow(states, "key string, step int, ids array<string>, v array<double>") if trace else sent.mapInArrow(ode_values if method == "ode" else values, "key string, value double, converged boolean, iterations int")


def solve_arrow(scenarios: DataFrame, networks: DataFrame, method: str, params: dict[str, float] | None = None, watch: str = "phenotype_node") -> DataFrame:
    """Arrow engine for scenarios(key, network, modifiers, supply, <watch>[, params]): (key, value of the watched node, converged,
    iterations). A scenario of a network that is not there has no row.

    params of a scenario, MAP<name, number>, go before those of the call. networks may have a column menu, for each node the
    names of its activation and inhibition function (null: the default), which the algebraic method follows.
    """
    return _solve(scenarios.withColumn("watched", F.col(watch)), networks, method, _params(method, params), False)


def trace_arrow(scenarios: DataFrame, networks: DataFrame, method: str, params: dict[str, float] | None = None) -> DataFrame:
    """(key, step, node, value): all states of scenarios(key, network, modifiers, supply), a row a node and step."""
    steps = _solve(scenarios.withColumn("watched", F.lit("")), networks, method, _params(method, params), True)
    return steps.select("key", "step", F.explode(F.arrays_zip("ids", "v")).alias("z")).select("key", "step", F.col("z.ids").alias("node"), F.col("z.v").alias("value"))


def with_menu(networks: DataFrame, menu: DataFrame) -> DataFrame:
    """networks with a column menu from menu(network, id, activation, inhibition); unknown names are refused when it is used."""
    by_node = menu.groupBy("network").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct(F.col("activation").alias("a"), F.col("inhibition").alias("h"))))).alias("m"))
    none = F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("h"))
    return networks.join(by_node, "network", "left").withColumn("menu", F.transform("ids", lambda i: F.coalesce(F.try_element_at("m", i), none))).drop("m")


def with_influences(scenarios: DataFrame, influences: DataFrame) -> DataFrame:
    """scenarios whose supply also holds what influences(network, node, source, sign) add to a node: the supply of the source,
    or less it for a negative one. A node's own supply counts too; sources without supply bring nothing."""
    given = F.coalesce("supply", F.create_map().cast("map<string,double>"))
    of = influences.groupBy("network").agg(F.collect_list(F.struct("node", "source", "sign")).alias("inf"))
    j = scenarios.join(of, "network", "left").withColumn("_s", given)
    hits = F.filter(F.coalesce("inf", F.array().cast("array<struct<node:string,source:string,sign:int>>")), lambda x: F.map_contains_key(F.col("_s"), x["source"]))
    more = lambda node: F.aggregate(F.filter(hits, lambda x: x["node"] == node), F.lit(0.0), lambda acc, x: acc + x["sign"] * F.element_at(F.col("_s"), x["source"]))
    nodes = F.array_distinct(F.concat(F.map_keys("_s"), F.transform(hits, lambda x: x["node"])))
    return j.withColumn("supply", F.map_from_arrays(nodes, F.transform(nodes, lambda n: F.coalesce(F.try_element_at(F.col("_s"), n), F.lit(0.0)) + more(n)))).drop("_s", "inf")


def spec_issues(specs: DataFrame) -> DataFrame:
    """(node, issue) of specs(node, activation, inhibition, weights ARRAY<DOUBLE>): names that no function has, weights that do not
    sum to 1 within 0.001, functions that are not 1 where all their inputs are. A null name is the default; weights belong to
    weighted_geomean only, which needs them."""
    weighted = F.coalesce(F.col("activation") == "weighted_geomean", F.lit(False))
    weights = F.coalesce("weights", F.array().cast("array<double>"))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    ones = F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))
    at_ones = F.lit(True)
    for name, f in (*S.ACTIVATIONS.items(), *S.INHIBITIONS.items()):
        column = F.coalesce(F.col("activation" if name in S.ACTIVATIONS else "inhibition"), F.lit(""))
        at_ones = at_ones & ((column != name) | (F.abs(f(ones) - 1) < 1e-9))
    issues = F.array_compact(F.array(
        F.when(~F.col("activation").isin(*ACTIVATION, "weighted_geomean"), "unknown activation"), F.when(~F.col("inhibition").isin(*INHIBITION), "unknown inhibition"),
        F.when(weighted & (F.abs(total - 1) > 1e-3), "weights do not sum to 1"), F.when(~at_ones, "not 1 at ones"),
    ))
    return specs.select("node", F.explode(issues).alias("issue"))


def with_node(solved: DataFrame, node: str | Column, name: str = "value") -> DataFrame:
    """Adds the state of one node by name; null where the network lacks it."""
    node = F.lit(node) if isinstance(node, str) else node
    return solved.withColumn(name, F.get("state", (F.array_position("ids", node) - 1).cast("int")))
