"""Evaluation of predicted against expected directions.

Every metric comes from one grouping: nine conditional counts per group, combined map-side, then expressions over one row
a group. Input rows: expected, predicted (long direction names), and where used correct, complexity, path_length,
converged, perturbation_type. Unknown labels count as unchanged in the matrix; null labels too.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sprigwork.functions import scalars as S

LABELS = ("increased", "decreased", "unchanged")
#: Two-sided standard normal quantiles (fixed values).
Z = {0.10: 1.6449, 0.05: 1.96, 0.01: 2.5758}


def _known(col: Column) -> Column:
    return F.when(col.isin(*LABELS), col).otherwise("unchanged")


def _cell(i: int, j: int) -> str:
    return f"c{i}{j}"


def confusion(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a group: c00..c22 (row expected, column predicted), total, n_correct."""
    e, p = _known(F.col("expected")), _known(F.col("predicted"))
    cells = [F.count_if((e == a) & (p == b)).alias(_cell(i, j)) for i, a in enumerate(LABELS) for j, b in enumerate(LABELS)]
    return results.groupBy(*keys).agg(*cells, F.count("*").alias("total"), F.count_if(F.col("expected").eqNullSafe(F.col("predicted"))).alias("n_correct"))


def confusion_long(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matrix in long form: keys, expected, predicted, n; empty cells as 0."""
    wide = confusion(results, keys)
    entries = F.explode(F.array(*[F.struct(F.lit(a).alias("expected"), F.lit(b).alias("predicted"), F.col(_cell(i, j)).alias("n")) for i, a in enumerate(LABELS) for j, b in enumerate(LABELS)]))
    return wide.select(*keys, entries.alias("m")).select(*keys, "m.expected", "m.predicted", "m.n")


def _row(i: int) -> Column:
    return sum((F.col(_cell(i, j)) for j in range(1, 3)), F.col(_cell(i, 0))).cast("double")


def _col(j: int) -> Column:
    return sum((F.col(_cell(i, j)) for i in range(1, 3)), F.col(_cell(0, j))).cast("double")


def _sum(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.try_divide(a, b)).otherwise(0.0)


def accuracy() -> Column:
    """Percent correct."""
    return _ratio(F.col("n_correct") * 100.0, F.col("total"))


def kappa() -> Column:
    n = F.col("total").cast("double")
    po = _ratio(F.col("n_correct").cast("double"), n)
    pe = _sum([_ratio(_row(i) * _col(i), n * n) for i in range(3)])
    return F.when(pe == 1, 0.0).otherwise(F.try_divide(po - pe, 1 - pe))


def mcc() -> Column:
    """Mean of the one-against-rest coefficients of the classes that have one."""
    n = F.col("total").cast("double")
    each, used = [], []
    for i in range(3):
        tp = F.col(_cell(i, i)).cast("double")
        fp, fn = _col(i) - tp, _row(i) - tp
        tn = n - tp - fp - fn
        d = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        each.append(F.when(d > 0, F.try_divide(tp * tn - fp * fn, d)).otherwise(0.0))
        used.append(F.when(d > 0, 1).otherwise(0))
    return _ratio(_sum(each), _sum(used))


def kappa_interval(alpha: float = 0.05) -> tuple[Column, Column]:
    """Asymptotic confidence limits of kappa; the upper one may pass 1."""
    n = F.col("total").cast("double")
    p = lambda i, j: F.col(_cell(i, j)) / n
    r, c = [_row(i) / n for i in range(3)], [_col(i) / n for i in range(3)]
    po, pe = _sum([p(i, i) for i in range(3)]), _sum([r[i] * c[i] for i in range(3)])
    k = F.try_divide(po - pe, 1 - pe)
    a = _sum([p(i, i) * F.pow(1 - (r[i] + c[i]) * (1 - k), F.lit(2)) for i in range(3)])
    b = F.pow(1 - k, F.lit(2)) * _sum([p(i, j) * F.pow(c[i] + r[j], F.lit(2)) for i in range(3) for j in range(3) if i != j])
    var = F.try_divide(a + b - F.pow(k - pe * (1 - k), F.lit(2)), n * F.pow(1 - pe, F.lit(2)))
    half = Z[alpha] * F.sqrt(F.greatest(var, F.lit(0.0)))
    bound = lambda x: F.when((n == 0) | (pe == 1), 0.0).when(var < 0, k).otherwise(F.round(x, 4))
    return bound(k - half), bound(k + half)


def summary(results: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Accuracy (percent), kappa with limits and band, MCC, total and correct of each group."""
    low, high = kappa_interval(alpha)
    return confusion(results, keys).select(
        *keys, "total", "n_correct", F.round(accuracy(), 1).alias("accuracy"), F.round(kappa(), 4).alias("kappa"), F.round(mcc(), 4).alias("mcc"),
        low.alias("kappa_low"), high.alias("kappa_high"), S.kappa_band(kappa()).alias("kappa_band"),
    )


def per_class(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support of each label."""
    structs = []
    for i, label in enumerate(LABELS):
        tp = F.col(_cell(i, i)).cast("double")
        pr, rc = _ratio(tp, _col(i)), _ratio(tp, _row(i))
        structs.append(F.struct(F.lit(label).alias("label"), F.round(pr, 4).alias("precision"), F.round(rc, 4).alias("recall"), F.round(_ratio(2 * pr * rc, pr + rc), 4).alias("f1"), _row(i).cast("bigint").alias("support")))
    return confusion(results, keys).select(*keys, F.explode(F.array(*structs)).alias("x")).select(*keys, "x.*")


def accuracy_by(results: DataFrame, keys: Sequence[str], digits: int = 1) -> DataFrame:
    right = F.count_if(F.col("expected").eqNullSafe(F.col("predicted")))
    return results.groupBy(*keys).agg(F.count("*").alias("n"), right.alias("n_correct"), F.round(right * 100.0 / F.count("*"), digits).alias("accuracy"))


def convergence(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    lost = F.count_if(~F.coalesce("converged", F.lit(False)))
    return results.groupBy(*keys).agg(F.count("*").alias("total"), lost.alias("non_converged"), F.round((F.count("*") - lost) * 100.0 / F.count("*"), 1).alias("convergence_rate"))


def rigor(results: DataFrame, sizes: DataFrame, keys: Sequence[str], size_keys: Sequence[str]) -> DataFrame:
    """FRS = kappa * log2(tests * (nodes + edges)) and DARS, the same over the summed complexity, with bands."""
    base = confusion(results, keys).join(results.groupBy(*keys).agg(F.sum("complexity").alias("t_effective"), F.round(F.avg(F.when(F.col("path_length") >= 0, F.col("path_length"))), 2).alias("mean_path_length")), list(keys))
    scope = lambda t: t * (F.col("n_nodes") + F.col("n_edges"))
    score = lambda t: F.when(scope(t) > 1, kappa() * F.log2(scope(t).cast("double"))).otherwise(0.0)
    frs, dars = score(F.col("total")), score(F.col("t_effective"))
    return base.join(sizes, list(size_keys)).select(*keys, "n_nodes", "n_edges", "total", "t_effective", "mean_path_length", F.round(kappa(), 4).alias("kappa"), F.round(frs, 4).alias("frs"), S.band(F.round(frs, 4)).alias("frs_band"), F.round(dars, 4).alias("dars"), S.band(F.round(dars, 4)).alias("dars_band"))


def stratified(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy and kappa of the easy, medium and hard tests of each group; kappa null under 5 tests, empty strata shown."""
    labelled = results.withColumn("stratum", S.complexity_label(F.col("complexity")))
    measured = confusion(labelled, [*keys, "stratum"]).select(*keys, "stratum", "total", "n_correct", F.round(accuracy(), 1).alias("accuracy"), F.when(F.col("total") >= 5, F.round(kappa(), 4)).alias("kappa"))
    every = results.select(*keys).distinct().withColumn("stratum", F.explode(F.array(*[F.lit(x) for x in ("easy", "medium", "hard")])))
    zero = F.lit(0).cast("bigint")
    return every.join(measured, [*keys, "stratum"], "left").select(*keys, "stratum", F.coalesce("total", zero).alias("n"), F.coalesce("n_correct", zero).alias("n_correct"), "accuracy", "kappa")


def _replicates(replicates: int, seed: int, confidence: float, n_keys: int):
    """Per group of nine cell counts: the percentile limits of accuracy, kappa and MCC over the replicates."""
    low, high = int((1 - confidence) / 2 * replicates), min(int((1 + confidence) / 2 * replicates), replicates - 1)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[float | None]] = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)))) or [()] * batch.num_rows
            for key, counts in zip(keys, zip(*(batch.column(n_keys + i).to_pylist() for i in range(9)))):
                n = sum(counts)
                rng = np.random.default_rng([seed, zlib.crc32(repr(key).encode())])
                c = rng.multinomial(n, np.array(counts) / n, size=replicates).reshape(replicates, 3, 3).astype(float)
                rows, cols, hit = c.sum(2), c.sum(1), c[:, range(3), range(3)]
                right = hit.sum(1) / n
                chance = (rows * cols).sum(1) / n**2
                with np.errstate(divide="ignore", invalid="ignore"):
                    kappa_ = np.where(chance == 1, 0.0, (right - chance) / (1 - chance))
                    fp, fn = cols - hit, rows - hit
                    tn = n - hit - fp - fn
                    d = np.sqrt((hit + fp) * (hit + fn) * (tn + fp) * (tn + fn))
                    each = np.where(d > 0, (hit * tn - fp * fn) / d, 0.0)
                used = (d > 0).sum(1)
                mcc_ = np.where(used > 0, each.sum(1) / np.maximum(used, 1), 0.0)
                out.append([round(float(np.sort(x)[i]), 4) for x in (right * 100, kappa_, mcc_) for i in (low, high)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *(pa.array([r[i] for r in out], pa.float64()) for i in range(6))], names=[*batch.schema.names[:n_keys], *_LIMITS])

    return apply


_LIMITS = [f"{name}_{end}" for name in ("accuracy", "kappa", "mcc") for end in ("low", "high")]


def bootstrap(results: DataFrame, keys: Sequence[str], replicates: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Percentile intervals of accuracy, kappa and MCC.

    Drawing n of n results with replacement changes only the nine cell counts, and these are then multinomial; so the results are
    counted once, and each group's replicates are drawn from its counts, however many results there are. The draws of a group
    depend on the seed and its key only.
    """
    cells = [_cell(i, j) for i in range(3) for j in range(3)]
    counted = confusion(results, keys).select(*keys, *cells)
    kinds = dict(counted.dtypes)
    return counted.mapInArrow(_replicates(replicates, seed, confidence, len(keys)), ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{x} double" for x in _LIMITS)]))


def observed_kappa(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kappa over the labels that occur, instead of the three fixed ones; 0 where chance agreement is complete."""
    pair = results.select(*keys, F.col("expected").alias("e"), F.col("predicted").alias("p"))
    n = pair.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("e") == F.col("p")).alias("same"))
    a = pair.groupBy(*keys, F.col("e").alias("label")).agg(F.count("*").alias("x"))
    b = pair.groupBy(*keys, F.col("p").alias("label")).agg(F.count("*").alias("y"))
    chance = a.join(b, [*keys, "label"]).groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    pe = F.coalesce("xy", F.lit(0)) / (F.col("n").cast("double") * F.col("n"))
    return n.join(chance, list(keys), "left").select(*keys, "n", F.round(F.when(pe >= 1, 0.0).otherwise(F.try_divide(F.col("same") / F.col("n") - pe, 1 - pe)), 4).alias("kappa"))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: the series below 2, the continued fraction above."""
    one = F.struct(x.alias("term"), x.alias("sum"))

    def term(s: Column, k: Column) -> Column:
        t = -s["term"] * x * x / k
        return F.struct(t.alias("term"), (s["sum"] + t / (2 * k + 1)).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(40)), one, term, lambda s: s["sum"])
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.greatest(x, F.lit(1.0)), lambda acc, k: F.greatest(x, F.lit(1.0)) + (k / 2.0) / acc)
    return F.when(x < 2, 1 - 2 / math.sqrt(math.pi) * series).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / fraction)


def binomial_tail(m: Column, low: Column) -> Column:
    """P(X <= low) for X ~ Binomial(m, 1/2), m up to a few dozens."""
    first = F.pow(F.lit(0.5), m)

    def step(s: Column, k: Column) -> Column:
        t = s["term"] * (m - k + 1) / k
        return F.struct(t.alias("term"), (s["sum"] + t).alias("sum"))

    steps = F.when(low >= 1, F.sequence(F.lit(1).cast("bigint"), low)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), step, lambda s: s["sum"])


def mcnemar(paired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Paired test of two predictors: rows with right_a, right_b. Under 25 discordant pairs the exact binomial, else chi-square."""
    cells = paired.groupBy(*keys).agg(
        F.count("*").alias("n_paired"), F.count_if(F.col("right_a") & F.col("right_b")).alias("a"), F.count_if(F.col("right_a") & ~F.col("right_b")).alias("b"),
        F.count_if(~F.col("right_a") & F.col("right_b")).alias("c"), F.count_if(~F.col("right_a") & ~F.col("right_b")).alias("d"),
    )
    m, low = F.col("b") + F.col("c"), F.least("b", "c")
    chi = F.try_divide(F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)).cast("double"), m.cast("double"))
    exact = F.least(F.lit(1.0), 2 * binomial_tail(F.least(m, F.lit(25).cast("bigint")), F.least(low, F.lit(12).cast("bigint"))))
    return cells.select(
        *keys, "n_paired", "a", "b", "c", "d",
        F.round(F.when(m == 0, 0.0).when(m >= 25, chi).otherwise(low.cast("double")), 4).alias("statistic"),
        F.round(F.when(m == 0, 1.0).when(m >= 25, erfc(F.sqrt(chi / 2))).otherwise(exact), 6).alias("p_value"),
        F.when(m == 0, "none").when(m >= 25, "chi_square").otherwise("exact").alias("test_type"),
    )


def best_by(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
