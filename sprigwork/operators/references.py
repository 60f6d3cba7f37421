"""References to records that do not exist: range-partitioned keys, sorted parent arrays, vectorised binary search.

Parents (key, valid from, valid to) and references (key, time) are laid out together by range of (key, time), so one hot
key is spread over several ranges by its times. Each range keeps its parents as sorted arrays and probes its references
in batches by binary search: a reference is served if, among the parents of its key that began at or before its time, one
ends later (a running maximum of the ends makes that one look-up). Only the first key of a range may have begun in an
earlier range; each range therefore also hands over the latest end of its last key, one row per range, and the misses of
first keys are held against these.

Defined results: a blank reference is no reference; a reference without key parts (e.g. a null network) or without any
time has no record; validity is from <= time < to, a null `to` never ends, a parent without key or `from` serves nothing;
repeated parents and references are harmless, each reference row is judged by itself; with no parents all are misses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sprigwork.functions.doi import bare_doi, is_blank
from sprigwork.session import staged
from sprigwork.tables import load

FOREVER = 2**63 - 1
NEVER = -(2**63)
_OUT = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("key", pa.string()), ("at", pa.int64()), ("until", pa.int64()), ("tab", pa.string()), ("ref_field", pa.string()), ("row_key", pa.int64()), ("first", pa.bool_())])
_OUT_DDL = "part int, kind tinyint, key string, at bigint, until bigint, tab string, ref_field string, row_key bigint, first boolean"


class _Range:
    """The parents of one range as sorted arrays: distinct keys, and per key the begins and the running latest end."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.until: list[np.ndarray] = []
        self.ready = False

    def add(self, keys: np.ndarray, at: np.ndarray, until: np.ndarray) -> None:
        self.keys.append(keys)
        self.at.append(at)
        self.until.append(until)

    def close(self) -> None:
        keys = np.concatenate(self.keys) if self.keys else np.empty(0, object)
        at = np.concatenate(self.at) if self.at else np.empty(0, np.int64)
        until = np.concatenate(self.until) if self.until else np.empty(0, np.int64)
        self.names, code = np.unique(keys, return_inverse=True) if len(keys) else (np.empty(0, object), np.empty(0, np.int64))
        self.times = np.unique(at)
        order = np.lexsort((at, code))
        code, at, until = code[order], at[order], until[order]
        #: (key, begin) as one sortable integer: key code x number of times + rank of the begin.
        self.width = len(self.times) + 1
        self.slot = code * self.width + np.searchsorted(self.times, at)
        self.code = code
        start = np.r_[True, code[1:] != code[:-1]] if len(code) else np.empty(0, bool)
        self.latest = until.copy()
        for a, b in zip(np.flatnonzero(start), np.r_[np.flatnonzero(start)[1:], len(code)]):
            if b - a > 1:
                self.latest[a:b] = np.maximum.accumulate(until[a:b])
        self.ready = True

    def served(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(self.names) or not len(keys):
            return np.zeros(len(keys), bool)
        code = np.searchsorted(self.names, keys)
        code[code == len(self.names)] = 0
        known = self.names[code] == keys
        rank = np.searchsorted(self.times, at, side="right") - 1
        spot = np.searchsorted(self.slot, code * self.width + rank, side="right") - 1
        spot_ok = known & (rank >= 0) & (spot >= 0)
        spot[~spot_ok] = 0
        return spot_ok & (self.code[spot] == code) & (self.latest[spot] > at)

    def last(self) -> tuple[str, int] | None:
        return (str(self.names[-1]), int(self.latest[-1])) if len(self.names) else None


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: parents (kind 0) come first, then references (kind 1). Gives the misses, and the hand-over row (kind 0)."""
    part, rng, lowest = TaskContext.get().partitionId(), _Range(), None

    def misses(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.array(batch.column(1).to_pylist(), object)
        at = batch.column(2).to_numpy(zero_copy_only=False)
        lost = pa.array(~rng.served(keys, at))
        first = pa.array(keys == lowest)
        n = len(keys)
        table = pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), batch.column(0).cast(pa.int8()), batch.column(1), batch.column(2), pa.nulls(n, pa.int64()), batch.column(4), batch.column(5), batch.column(6), first], schema=_OUT)
        return table.filter(lost)

    for batch in batches:
        kinds = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(kinds):
            continue
        cut = int(np.searchsorted(kinds, 1))
        # Rows come by kind and key, so the lowest key of the range is known by its first reference.
        for low in (batch.column(1)[0].as_py(), batch.column(1)[cut].as_py() if cut < len(kinds) else None):
            if low is not None and (lowest is None or low < lowest):
                lowest = low
        if cut:
            parents = batch.slice(0, cut)
            rng.add(np.array(parents.column(1).to_pylist(), object), parents.column(2).to_numpy(zero_copy_only=False), parents.column(3).to_numpy(zero_copy_only=False))
        if cut < len(kinds):
            if not rng.ready:
                rng.close()
            yield misses(batch.slice(cut))
    if not rng.ready:
        rng.close()
    if (last := rng.last()) is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int8()), pa.array([last[0]]), pa.nulls(1, pa.int64()), pa.array([last[1]], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([False])], schema=_OUT)


def orphans(parents: DataFrame, references: DataFrame, partitions: int | None = None) -> DataFrame:
    """References without a record at their time.

    parents(key, since, until): timestamps as microseconds, until null = never ends.
    references(key, at, tab, ref_field, row_key): key null or at null = no record.
    Returns (tab, ref_field, row_key, at).
    """
    spark = parents.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = F.col("key").isNotNull() & F.col("at").isNotNull()
    both = (
        parents.where(F.col("key").isNotNull() & F.col("since").isNotNull())
        .groupBy("key", F.col("since").alias("at"))
        .agg(F.max(F.coalesce("until", F.lit(FOREVER))).alias("until"))
        .select(F.lit(0).alias("kind"), "key", "at", "until", F.lit(None).cast("string").alias("tab"), F.lit(None).cast("string").alias("ref_field"), F.lit(None).cast("bigint").alias("row_key"))
        .unionByName(references.where(usable).select(F.lit(1).alias("kind"), "key", "at", F.lit(None).cast("bigint").alias("until"), "tab", "ref_field", "row_key"))
    )
    ranged = both.repartitionByRange(n, "key", "at", "kind", "row_key").sortWithinPartitions("kind", "key")
    probed = staged(ranged.mapInArrow(_probe, _OUT_DDL), "orphans")
    lost = probed.where("kind = 1")
    carried = probed.where("kind = 0").select(F.col("part").alias("c_part"), F.col("key").alias("c_key"), F.col("until").alias("c_until"))
    # One row per range at most, and only the few references of a range's first key look at it.
    kept = lost.where("not first").unionByName(lost.where("first").join(carried, (F.col("key") == F.col("c_key")) & (F.col("c_part") < F.col("part")) & (F.col("c_until") > F.col("at")), "left_anti"))
    return kept.select("tab", "ref_field", "row_key", "at").unionByName(references.where(~usable).select("tab", "ref_field", "row_key", "at"))


def micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def node_references(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = load(spark, sf_dir, "network_nodes"), load(spark, sf_dir, "network_edges")
    key = lambda network, node: F.concat(F.lit("n"), network, F.lit("\x01"), node)
    parents = nodes.select(key(F.col("network"), F.col("node_id")).alias("key"), micros(F.col("created_at")).alias("since"), micros(F.col("deleted_at")).alias("until"))
    at = micros(F.coalesce("recorded_at", "loaded_at"))
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in ("source", "target")])).alias("r")
    refs = edges.select("network", "edge_key", at.alias("at"), ends).where(~is_blank(F.col("r.v"))).select(key(F.col("network"), F.col("r.v")).alias("key"), "at", F.lit("network_edges").alias("tab"), F.col("r.f").alias("ref_field"), F.col("edge_key").cast("bigint").alias("row_key"))
    return parents, refs


def doi_references(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = lambda col: F.when(bare_doi(col) != "", F.concat(F.lit("d"), bare_doi(col)))
    parents = load(spark, sf_dir, "papers").select(key(F.col("doi")).alias("key"), micros(F.col("fetched_at")).alias("since"), micros(F.col("withdrawn_at")).alias("until"))
    refs = None
    for tab, field, time, row in (("ode_validation_results", "evidence_doi", "validated_at", "result_key"), ("fulltext", "doi", "fetched_at", "fulltext_key")):
        one = load(spark, sf_dir, tab).where(~is_blank(F.col(field))).select(key(F.col(field)).alias("key"), micros(F.col(time)).alias("at"), F.lit(tab).alias("tab"), F.lit(field).alias("ref_field"), F.col(row).cast("bigint").alias("row_key"))
        refs = one if refs is None else refs.unionByName(one)
    return parents, refs


def all_references(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both kinds of reference as one key space (keys begin with n or d)."""
    (a, b), (c, d) = node_references(spark, sf_dir), doi_references(spark, sf_dir)
    return a.unionByName(c), b.unionByName(d)


def found(spark, sf_dir: str) -> DataFrame:
    return orphans(*all_references(spark, sf_dir)).select("tab", "ref_field", "row_key")


def report(spark, sf_dir: str) -> DataFrame:
    """References and orphans per table, field and month; a reference without time counts under a null month."""
    parents, refs = all_references(spark, sf_dir)
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("month")
    asked = refs.groupBy("tab", "ref_field", month).agg(F.count("*").alias("n_references"))
    lost = orphans(parents, refs).groupBy("tab", "ref_field", month).agg(F.count("*").alias("n_orphans"))
    same = [asked[c].eqNullSafe(lost[c]) for c in ("tab", "ref_field", "month")]
    return asked.join(lost, same[0] & same[1] & same[2], "left").select(asked.tab, asked.ref_field, asked.month, "n_references", F.coalesce("n_orphans", F.lit(0).cast("bigint")).alias("n_orphans"))
