"""Filling containers of fixed capacity: minimum bin slack over the lengths that are there.

Only lengths matter for packing, so the items are reduced to a table of lengths and their counts, at most one row for each
length up to the capacity, however many items there are. Bin by bin, the longest length left is placed and a bitset
subset-sum over the other lengths left finds the fullest combination; the combination is taken as often as the counts
allow. That gives slots (length, ranks -> containers), and each item finds its container by its rank among the items of
its length, numbered in parallel: every task numbers its own, and the tasks before it shift them.

Defined results: a document longer than the capacity is cut into pieces of the capacity and a rest; a document without
tokens takes no room and goes to container 0; null texts count as empty; repeated rows are items of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sprigwork.llm.tokens import VOCABULARY, count_tokens
from sprigwork.session import small, staged
from sprigwork.tables import load


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the lengths (descending) with their counts, the combination of the greatest sum within the room."""
    if room <= 0:
        return {}
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # (length, how many at once, reach before)
    goal = 1 << room
    for length in lengths:
        if length > room:
            continue
        left, chunk = min(counts[length], room // length), 1
        while left > 0:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            chunk *= 2
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack over a table of lengths: (length -> how many, how many containers are filled so)."""
    left = {length: n for length, n in counts.items() if n > 0 and 0 < length <= capacity}
    out = []
    lengths = sorted(left, reverse=True)
    while lengths:
        top = lengths[0]
        left[top] -= 1
        own = fullest([x for x in lengths if left[x] > 0], left, capacity - top)
        left[top] += 1
        own[top] = own.get(top, 0) + 1
        times = min(left[length] // n for length, n in own.items())
        for length, n in own.items():
            left[length] -= n * times
        lengths = [x for x in lengths if left[x] > 0]
        out.append((own, times))
    return out


def slots(counts: dict[int, int], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank of each slot, items a container, first container), sorted by rank."""
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    container = 0
    for own, times in patterns(counts, capacity):
        for length, n in own.items():
            rank = taken.get(length, 0)
            rows.setdefault(length, []).append((rank, n, container))
            taken[length] = rank + n * times
        container += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*r)) for length, r in rows.items()}


def pieces(tokens: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, doc_id, piece, token_start, n_tokens): documents, cut where they alone exceed the capacity."""
    caps = profiles.where("capacity_tokens > 0").groupBy("profile").agg(F.max("capacity_tokens").cast("bigint").alias("cap"))
    cut = tokens.join(small(caps)).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.expr("(n_tokens - 1) div cap")))))
    return cut.select("profile", "doc_id", F.col("piece").cast("int"), (F.col("piece") * F.col("cap")).alias("token_start"), F.least("cap", F.col("n_tokens") - F.col("piece") * F.col("cap")).alias("n_tokens"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number, and a running number among the task's items of one profile and length."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        local = []
        for key in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
            n = seen.get(key, 0)
            seen[key] = n + 1
            local.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(local), pa.int32()), pa.array(local, pa.int64())], names=["profile", "doc_id", "piece", "token_start", "n_tokens", "part", "local"])


_ITEM = "profile string, doc_id bigint, piece int, token_start bigint, n_tokens bigint"


def pack(tokens: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, doc_id, piece, token_start, n_tokens, container) for tokens(doc_id, n_tokens)."""
    spark = tokens.sparkSession
    items = staged(pieces(tokens, profiles).mapInArrow(_number, _ITEM + ", part int, local bigint"), "items")
    per_part = staged(items.groupBy("profile", "n_tokens", "part").agg(F.count("*").alias("n")), "lengths")
    capacity = {r["profile"]: int(r["c"]) for r in profiles.where("capacity_tokens > 0").groupBy("profile").agg(F.max("capacity_tokens").alias("c")).collect()}
    # At most one row for each profile and length within its capacity.
    table: dict[str, dict[int, int]] = {p: {} for p in capacity}
    for r in per_part.groupBy("profile", "n_tokens").agg(F.sum("n").alias("n")).collect():
        table[r["profile"]][r["n_tokens"]] = r["n"]
    plan = spark.sparkContext.broadcast({p: slots(counts, capacity[p]) for p, counts in table.items()})
    before = Window.partitionBy("profile", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_part.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint"))).drop("n")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = plan.value
        for batch in batches:
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            length = batch.column(4).to_numpy(zero_copy_only=False)
            profile = np.array(batch.column(0).to_pylist(), object)
            out = np.zeros(len(rank), np.int64)
            for p in set(profile.tolist()):
                mine = profile == p
                for x in np.unique(length[mine]):
                    if x > 0:
                        at = np.flatnonzero(mine & (length == x))
                        first, per, container = own[p][int(x)]
                        k = np.searchsorted(first, rank[at], side="right") - 1
                        out[at] = container[k] + (rank[at] - first[k]) // per[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out)], names=["profile", "doc_id", "piece", "token_start", "n_tokens", "container"])

    ranked = items.join(shift, ["profile", "n_tokens", "part"]).select("profile", "doc_id", "piece", "token_start", "n_tokens", (F.col("local") + F.col("shift")).alias("rank"))
    return ranked.mapInArrow(place, _ITEM + ", container bigint")


def packed(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return pack(count_tokens(load(spark, sf_dir, "documents"), vocabulary), load(spark, sf_dir, "pack_profiles"))


def fill(spark, sf_dir: str) -> DataFrame:
    """Containers, items, tokens and the used share of the room, for each profile."""
    profiles = load(spark, sf_dir, "pack_profiles")
    used = packed(spark, sf_dir).groupBy("profile").agg(F.count("*").alias("n_items"), (F.max("container") + 1).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return used.join(profiles.select("profile", "capacity_tokens"), "profile").select("profile", "capacity_tokens", "n_items", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("used_share"))


def audit(spark, sf_dir: str) -> DataFrame:
    """For each profile: documents, containers over the capacity, and documents whose pieces are not all of their tokens."""
    tokens = staged(count_tokens(load(spark, sf_dir, "documents")), "tokens")
    profiles = load(spark, sf_dir, "pack_profiles")
    items = staged(pack(tokens, profiles), "packed")
    caps = profiles.groupBy("profile").agg(F.max("capacity_tokens").alias("cap"))
    over = items.groupBy("profile", "container").agg(F.sum("n_tokens").alias("n")).join(small(caps), "profile").groupBy("profile").agg(F.count_if(F.col("n") > F.col("cap")).alias("n_overfull"))
    docs = items.groupBy("profile", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    whole = docs.join(tokens, "doc_id", "left").groupBy("profile").agg(F.count("*").alias("n_documents"), F.count_if(~F.coalesce((F.col("n") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens")), F.lit(False))).alias("n_incomplete"))
    return whole.join(over, "profile").select("profile", "n_documents", "n_overfull", "n_incomplete")
