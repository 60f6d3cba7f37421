import random
import math

import pytest
from pyspark.sql import functions as F

from sprigwork.functions import scalars as S
from sprigwork.operators import metrics as M

SCHEMA = "g string, expected string, predicted string, complexity int, path_length int, converged boolean"


def frame(spark, pairs):
    return spark.createDataFrame([("a", e, p, 1, 1, True) for e, p in pairs], SCHEMA)


def test_perfect_and_degenerate(spark):
    r = M.summary(frame(spark, [("increased", "increased"), ("decreased", "decreased"), ("unchanged", "unchanged")]), ["g"]).first()
    assert (r.accuracy, r.kappa, r.mcc) == (100.0, 1.0, 1.0)
    r = M.summary(frame(spark, [("increased", "increased")] * 4), ["g"]).first()
    assert (r.kappa, r.mcc, r.kappa_low, r.kappa_high) == (0.0, 0.0, 0.0, 0.0)


def test_unknown_labels_count_as_unchanged_but_are_compared_as_written(spark):
    r = M.confusion(frame(spark, [("up?", "unchanged"), (None, None)]), ["g"]).first()
    assert r.c22 == 2 and r.n_correct == 1


def test_kappa_by_hand(spark):
    pairs = [("increased", "increased")] * 20 + [("increased", "decreased")] * 5 + [("decreased", "increased")] * 10 + [("decreased", "decreased")] * 15
    r = M.summary(frame(spark, pairs), ["g"]).first()
    assert r.kappa == pytest.approx(0.4) and r.kappa_low < 0.4 < r.kappa_high


def test_mcnemar_branches(spark):
    rows = lambda b, c: [(True, False)] * b + [(False, True)] * c + [(True, True)]
    at = lambda b, c: M.mcnemar(spark.createDataFrame(rows(b, c), "right_a boolean, right_b boolean"), []).first()
    assert at(0, 0).p_value == 1.0
    r = at(1, 9)
    assert r.test_type == "exact" and r.p_value == pytest.approx(2 * (1 + 10) / 2**10, abs=1e-6)
    r = at(60, 20)
    assert r.test_type == "chi_square" and r.statistic == pytest.approx(39**2 / 80, abs=1e-4)
    assert r.p_value == pytest.approx(math.erfc(math.sqrt(39**2 / 80 / 2)), abs=1e-6)


@pytest.mark.parametrize("x", [0.0, 0.3, 1.0, 1.9, 2.0, 3.5, 6.0])
def test_erfc(spark, x):
    assert spark.range(1).select(M.erfc(F.lit(x))).first()[0] == pytest.approx(math.erfc(x), rel=1e-8, abs=1e-12)


def test_bootstrap_interval_covers(spark):
    rows = [(i, "a", "increased", "increased" if i % 4 else "decreased") for i in range(400)]
    r = M.bootstrap(spark.createDataFrame(rows, "id long, g string, expected string, predicted string"), ["g"], 200).first()
    assert r.accuracy_low < 75 < r.accuracy_high and 4 < r.accuracy_high - r.accuracy_low < 14


def test_bootstrap_draws_n_of_n(spark):
    rng = random.Random(4)
    labels = ("increased", "decreased", "unchanged")
    rows = [("g", *(lambda e: (e, e if rng.random() < 0.6 else rng.choice(labels)))(rng.choice(labels))) for _ in range(120)]
    got = M.bootstrap(spark.createDataFrame(rows, "g string, expected string, predicted string"), ["g"], 4000).first()
    drawn = sorted(100 * sum(e == p for _, e, p in rng.choices(rows, k=len(rows))) / len(rows) for _ in range(4000))
    assert abs(got.accuracy_low - drawn[100]) < 1.5 and abs(got.accuracy_high - drawn[3899]) < 1.5 and got.kappa_low < got.kappa_high
    again = M.bootstrap(spark.createDataFrame(rows, "g string, expected string, predicted string"), ["g"], 4000).first()
    assert got == again and M.bootstrap(spark.createDataFrame(rows[:0], "g string, expected string, predicted string"), ["g"]).count() == 0


def test_strata_empty_and_small(spark):
    rows = spark.createDataFrame([("a", "increased", "increased", 1, 1, True)] * 3, SCHEMA)
    got = {r.stratum: (r.n, r.accuracy, r.kappa) for r in M.stratified(rows, ["g"]).collect()}
    assert got == {"easy": (3, 100.0, None), "medium": (0, None, None), "hard": (0, None, None)}


def test_ratio_rules(spark):
    f = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.05, 1.0), (1.06, 1.0)], "p double, b double")
    got = [tuple(r) for r in f.select(S.safe_ratio(F.col("p"), F.col("b")), S.safe_log2(F.col("p")), S.classify_ratio(S.safe_ratio(F.col("p"), F.col("b")))).collect()]
    assert [g[0] for g in got] == [1.0, math.inf, 0.0, 1.05, 1.06] and got[0][1] == -math.inf and [g[2] for g in got] == ["unchanged", "increased", "decreased", "unchanged", "increased"]
