"""Mixing sources to target weights by soft membership and distributed projected-gradient least squares.

A labelled document belongs to its source; for an unlabelled one a naive Bayes classifier, counted over all labelled
documents, predicts a posterior over the sources that have documents. Nonnegative rates r (uses of each document, at most its source's
max_repeats) minimise sum_d (expected tokens of d - target tokens of d)^2 / tokens of d. Projected gradient steps in the
metric of the documents' lengths move all documents of equal posterior alike, so documents are first summed by (posterior,
limit), and each step is one small aggregate whose only state is the history of the sources' residuals, replayed per group.
Up to LOCAL_GROUPS groups are summed in the driver, more of them by the executors; the steps are the same. Rates become whole
repeats by a rounding that a hash of doc_id decides, and more steps correct what it moved.

The size of the mixture, where not given, is the largest at which every source that has documents can reach its share.

The report of the shares says how far the mixture is from its goal (residual, a share of the size, over the sources that have
documents) and whether that is at most CLOSE (converged).

Defined results: documents of sources without target get no use; a source without documents stays empty and is reported
with share 0; empty texts have no tokens and no use; max_repeats null or below 0 counts as 0; targets need not sum to 1.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sprigwork.llm.tokens import VOCABULARY, counter, shipped
from sprigwork.session import small, spread, staged
from sprigwork.tables import load

#: Hashed words of the classifier, most rounds of the gradient and on whole repeats, least residual (share of the size).
WIDTH, ROUNDS, POLISH, ENOUGH = 1 << 14, 2000, 12, 1e-4
#: Groups that the driver sums itself at most; residual at which a mixture counts as reached.
LOCAL_GROUPS, CLOSE = 50_000, 0.01
_WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """Words with their hash; words with digits count as one."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        own = self[word] = zlib.crc32(("#" if any(c.isdigit() for c in word) else word).encode()) % WIDTH
        return own


_HASHES = _Hashes()


def hashed_words(text: str | None) -> list[int]:
    """Hashed words of a text."""
    return list(map(_HASHES.__getitem__, _WORD.findall((text or "").casefold())))


def word_counts(documents: DataFrame, sources: list[str]) -> np.ndarray:
    """Word counts by source over all labelled documents: sources x WIDTH."""
    index = {s: i for i, s in enumerate(sources)}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((len(index), WIDTH))
        for batch in batches:
            words: dict[str, list[int]] = {}
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(source, []).extend(hashed_words(text))
            for source, at in words.items():
                own[index[source]] += np.bincount(np.array(at, np.int64), minlength=WIDTH)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own.ravel()[at])], names=["at", "n"])

    out = np.zeros(len(sources) * WIDTH)
    labelled = spread(documents.where(F.col("source").isin(sources)).select("source", F.col("text").cast("string")))
    for r in labelled.mapInArrow(apply, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(len(sources), WIDTH)


def posteriors(log_word: np.ndarray, log_prior: np.ndarray, words: list[int]) -> np.ndarray:
    """Posterior over the sources; evidence is tempered by the root of the text's length, as its words depend on each other.

    Untempered posteriors are nearly 0 or 1: on documents held out they put a source's tokens wrong by 42 percent, tempered
    ones by 14 (sf0.1). A source without documents has prior 0.
    """
    n = len(words)
    z = log_prior + (log_word[:, words].sum(1) / np.sqrt(n) if n else 0.0)
    if not np.isfinite(z).any():
        return np.zeros(len(z))
    e = np.exp(z - z.max())
    return np.round(e / e.sum(), 4)


def memberships(documents: DataFrame, targets: list[tuple[str, float, int]], vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, cap, member): tokens, most uses, and membership in each target source."""
    sources = [t[0] for t in targets]
    repeats = [t[2] for t in targets]
    counts = word_counts(documents, sources)
    words = counts.sum(1)
    with np.errstate(divide="ignore"):
        log_prior = np.log(words / max(words.sum(), 1.0))
    log_word = np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * WIDTH))
    model = documents.sparkSession.sparkContext.broadcast((log_word, log_prior))
    index = {s: i for i, s in enumerate(sources)}
    name = shipped(documents.sparkSession, vocabulary)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, (w, prior) = counter(name), model.value
        for batch in batches:
            n, cap, member = [], [], []
            for source, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n.append(count(text) if text else 0)
                if source is None:
                    p = posteriors(w, prior, hashed_words(text))
                    cap.append(repeats[int(p.argmax())] if p.any() else 0)
                    member.append(p.tolist())
                elif source in index:
                    cap.append(repeats[index[source]])
                    member.append([float(i == index[source]) for i in range(len(index))])
                else:
                    cap.append(0)
                    member.append([0.0] * len(index))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cap, pa.int32()), pa.array(member, pa.list_(pa.float64()))], names=["doc_id", "source", "n_tokens", "cap", "member"])

    return spread(documents.select(F.col("doc_id").cast("bigint"), "source", F.col("text").cast("string"))).mapInArrow(apply, "doc_id bigint, source string, n_tokens bigint, cap int, member array<double>")


def replay(member: np.ndarray, cap: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the projected steps, from rate 0; equal rows are replayed once."""
    rows, of = np.unique(np.column_stack([member, cap]), axis=0, return_inverse=True)
    rate = np.zeros(len(rows))
    for step in steps:
        rate = np.clip(rate - rows[:, :-1] @ step, 0.0, rows[:, -1])
    return rate[of.reshape(-1)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _summed(df: DataFrame, d: int, of_batch: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of what of_batch gives (k x d numbers): one row a task and source leaves the executors."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = sum((of_batch(b) for b in batches), np.zeros((1, d)))
        yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x in np.atleast_2d(out)], pa.list_(pa.float64()))], names=["y"])

    rows = df.mapInArrow(apply, "y array<double>").select(F.posexplode("y").alias("d", "x"))
    out = np.zeros(d)
    for r in rows.groupBy("d").agg(F.sum("x").alias("x")).collect():
        out[r["d"]] = r["x"]
    return out


def fit_rates(groups: DataFrame, share: np.ndarray, size: float | None, rounds: int = ROUNDS, local: int = LOCAL_GROUPS) -> tuple[list[np.ndarray], float]:
    """The steps whose replay gives the rates, and the size. groups(member, cap, tokens)."""
    d = len(share)
    rows = groups.select("member", "cap", "tokens")
    # The table is collected only if it was counted as small.
    here = None
    if rows.count() <= local:
        kept = rows.collect()
        here = np.array([r["member"] for r in kept]).reshape(len(kept), d), np.array([r["cap"] for r in kept], float), np.array([r["tokens"] for r in kept], float)

    def totals(rate_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        if here:
            return (here[2] * rate_of(here[0], here[1])) @ here[0]
        return _summed(rows, d, lambda b: ((b.column(2).to_numpy(zero_copy_only=False) * rate_of(_matrix(b.column(0), d), b.column(1).to_numpy(zero_copy_only=False).astype(float))) @ _matrix(b.column(0), d))[None])

    supply, once = totals(lambda m, cap: cap), totals(lambda m, cap: np.where(cap > 0, 1.0, 0.0))
    if size is None:
        reachable = [supply[i] / share[i] for i in range(d) if share[i] > 0 and supply[i] > 0]
        size = float(min(reachable)) if reachable else 0.0
    goal, scale = share * size, np.maximum(once, 1.0)
    steps: list[np.ndarray] = []
    now = np.zeros(len(here[1])) if here else None
    for _ in range(rounds):
        got = (here[2] * now) @ here[0] if here else totals(lambda m, cap, at=tuple(steps): replay(m, cap, list(at)))
        off = got - goal
        if np.abs(off[supply > 0]).sum() <= ENOUGH * max(size, 1.0) or (len(steps) > 3 and np.allclose(steps[-1], off / scale, atol=1e-9, rtol=1e-6)):
            break
        steps.append(off / scale)
        if here:
            now = np.clip(now - here[0] @ steps[-1], 0.0, here[1])
    return steps, size


def chances(doc_id: pa.Array) -> np.ndarray:
    """A number in [0, 1) for each document, from a mix of the bits of its key."""
    x = doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(float) / 2.0**64


def rounded(batch: pa.RecordBatch, d: int, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rates and whole repeats of a batch (doc_id, source, n_tokens, cap, member)."""
    cap = batch.column(3).to_numpy(zero_copy_only=False)
    rate = replay(_matrix(batch.column(4), d), cap, steps)
    whole = np.floor(rate)
    return rate, np.minimum(whole + (chances(batch.column(0)) < rate - whole), cap).astype(np.int32)


def polish(members: DataFrame, steps: list[np.ndarray], goal: np.ndarray, rounds: int = POLISH) -> list[np.ndarray]:
    """More steps, on what the whole repeats give instead of the rates; the best state seen is kept."""
    d = len(goal)

    def once(batch: pa.RecordBatch) -> np.ndarray:
        return (batch.column(2).to_numpy(zero_copy_only=False) @ _matrix(batch.column(4), d))[None]

    scale = np.maximum(_summed(members, d, once), 1.0)
    there = scale > 1.0
    best, least, now = steps, np.inf, list(steps)
    for _ in range(rounds):
        got = _summed(members, d, lambda b, at=tuple(now): ((b.column(2).to_numpy(zero_copy_only=False) * rounded(b, d, list(at))[1]) @ _matrix(b.column(4), d))[None])
        off = got - goal
        if (miss := float(np.abs(off[there]).sum())) < least:
            best, least = list(now), miss
        if miss <= ENOUGH * goal.sum():
            break
        now = [*now, off / scale]
    return best


def mix(documents: DataFrame, mix_targets: DataFrame, size: float | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (doc_id, source, n_tokens, repeats) and the shares by source."""
    spark = documents.sparkSession
    rows = mix_targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).orderBy("source").collect()
    targets = [(r["source"], float(r["share"] or 0.0), max(int(r["most"] or 0), 0)) for r in rows]
    share, d = np.array([t[1] for t in targets]), len(targets)
    members = staged(memberships(documents, targets, vocabulary), "members")
    groups = staged(members.groupBy("member", "cap").agg(F.sum("n_tokens").alias("tokens")), "groups")
    steps, size = fit_rates(groups, share, size)
    steps = polish(members, steps, share * size)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate, repeats = rounded(batch, d, steps)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.round(rate, 6)), pa.array(repeats), batch.column(4)], names=["doc_id", "source", "n_tokens", "rate", "repeats", "member"])

    rated = members.mapInArrow(apply, "doc_id bigint, source string, n_tokens bigint, rate double, repeats int, member array<double>").where("repeats > 0 and n_tokens > 0")
    chosen = rated.select("doc_id", "source", "n_tokens", "rate", "repeats")
    domain = spark.createDataFrame([(i, s, w, m) for i, (s, w, m) in enumerate(targets)], "pos int, source string, target_share double, max_repeats int")
    got = rated.select((F.col("n_tokens") * F.col("repeats")).alias("t"), F.posexplode("member").alias("pos", "p")).groupBy("pos").agg(F.sum(F.col("t") * F.col("p")).alias("tokens"))
    joined = domain.join(got, "pos", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0.0)).alias("tokens"))
    every = Window.partitionBy()  # a few rows: one for each target
    total = F.sum("tokens").over(every)
    goal = F.col("target_share") * F.lit(float(size))
    residual = F.sum(F.when(F.col("tokens") > 0, F.abs(F.col("tokens") - goal)).otherwise(0.0)).over(every) / F.lit(max(size, 1.0))
    shares = joined.select("source", "target_share", "max_repeats", F.round("tokens", 3).alias("tokens"), F.round(F.lit(float(size)), 3).alias("size"), F.round(F.when(F.lit(size) > 0, F.col("tokens") / F.lit(max(size, 1e-9))).otherwise(0.0), 6).alias("share_of_size"), F.round(F.when(total > 0, F.col("tokens") / total).otherwise(0.0), 6).alias("actual_share"), F.round(residual, 6).alias("residual"), (residual <= CLOSE).alias("converged"))
    return chosen, shares


def mixture(spark, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[0]


def shares(spark, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[1]


def limits(spark, sf_dir: str) -> DataFrame:
    """For each target: labelled documents that are used more often than it allows, and uses of documents that have no target."""
    documents, targets = load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets")
    chosen = mix(documents, targets)[0]
    caps = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    over = chosen.join(small(caps), "source", "left").where(F.col("source").isNotNull()).groupBy("source").agg(F.count_if(~F.coalesce(F.col("repeats") <= F.col("max_repeats"), F.lit(False))).alias("n"))
    return caps.join(over, "source", "full").select("source", "target_share", "max_repeats", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_over_limit"))
