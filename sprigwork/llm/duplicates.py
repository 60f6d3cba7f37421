"""Duplicates hidden by formatting: recursive radix partitioning on canonical bytes, counted in per-bucket burst tries.

Every record becomes canonical bytes: its compared fields folded (NFKC, letter case, white space, punctuation gone), DOIs
bare, numbers with their minus and decimal point, the parts of structured texts in sorted order. Copies within a map task are combined at once, so a text that a third
of all rows share leaves each task as one entry. Buckets are the leading bytes; a bucket over the limit is split by the
next bytes after the prefix all its entries share, again and again until each fits or holds one text only. A bucket's
entries then go through a burst trie whose terminal counters hold the number of copies and the smallest key. Records are
paired with the kept key over a 128-bit digest of the canonical bytes, so no list of a group's members is ever gathered.

Defined results: null and empty fields agree; a record whose required field is blank takes no part; a record without key
takes no part; columns beyond the compared ones are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprigwork.functions.doi import bare_doi_py, is_blank
from sprigwork.session import spread, staged
from sprigwork.tables import load

#: Table -> key, compared fields (the most selective first, for the radix), fields that are DOIs, the required field.
SPECS = {
    "papers": ("paper_key", ("title", "doi", "authors", "year", "journal"), ("doi",), "doi"),
    "fixes_applied": ("fix_key", ("source", "target", "network", "iteration", "action", "sign", "evidence_doi", "description"), ("evidence_doi",), "evidence_doi"),
    "network_edges": ("edge_key", ("source", "target", "network", "sign", "doi", "evidence"), ("doi",), "evidence"),
}
#: Compared fields that are numbers: a minus or a decimal point is no punctuation there.
NUMBERS = ("sign", "year", "iteration")
#: Bytes taken at each radix step, most entries of a bucket, most entries a task combines before it lets go of them.
RADIX, BUCKET, COMBINE = 3, 200_000, 100_000
#: Entries a trie's container holds before it bursts, bytes of a trie's branch.
BURST, BRANCH = 2048, 4

_DROP = re.compile(r"[\W_]+")
_NUMBER = re.compile(r"\s*([-−]?)\+?(\d*)(?:[.](\d+))?([eE][-+]?\d{1,3})?[.,;\s]*", re.A)
_LABEL = re.compile(r"^\s*([A-Za-z_]{2,20})\s*:(.*)$", re.S)


def fold(text: str | None) -> str:
    """Letters and digits only, case folded."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _DROP.sub("", text.casefold())


def leaf(text: str) -> str:
    """A value of its own: a number with its minus and decimal point (1.50 is 1.5), any other text folded."""
    m = _NUMBER.fullmatch(text)
    if not m or not (m[2] or m[3]):
        return fold(text)
    whole, part = m[2], m[3] or ""
    if m[4]:
        whole, _, part = format(Decimal(f"{whole or 0}.{part or 0}{m[4]}"), "f").partition(".")
    part = part.rstrip("0")
    minus = "-" if m[1] and (whole.strip("0") or part) else ""
    return f"{minus}{whole or 0}.{part}" if part else f"{minus}{whole or 0}"


def structured(text: str) -> str:
    """A text that may be JSON or 'label: text || label: text': its parts folded (numbers kept), in sorted order."""
    head = text.lstrip()[:1]
    if head in ("{", "["):
        try:
            value = json.loads(text, parse_int=str, parse_float=str)
        except (ValueError, RecursionError):
            return fold(text)
        return "\x1e".join(sorted(_flat(value, "")))
    if "||" in text:
        parts = [_LABEL.match(part) for part in text.split("||")]
        if all(parts):
            return "\x1e".join(sorted(f"{fold(m[1])}\x1d{leaf(m[2])}" for m in parts if m))
    return fold(text)


def _flat(value: object, at: str) -> Iterator[str]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _flat(v, f"{at}\x1c{fold(k)}" if at else fold(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _flat(v, f"{at}\x1c{i}")
    elif value is not None:
        yield f"{at}\x1d{leaf(value if isinstance(value, str) else json.dumps(value))}"


def canonical(fields: list[str | None], dois: frozenset[int], parts: frozenset[int], numbers: frozenset[int] = frozenset()) -> bytes:
    """Canonical bytes of a record's compared fields."""
    out = []
    for i, text in enumerate(fields):
        if text is None:
            out.append("")
        elif i in dois:
            out.append(bare_doi_py(text) or fold(text))
        elif i in numbers:
            out.append(leaf(text))
        else:
            out.append(structured(text) if i in parts else fold(text))
    return "\x1f".join(out).encode()


class BurstTrie:
    """Byte trie with terminal counters; a leaf holds the rest of its keys until it is too full, then it bursts."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list = [{}, False]  # [children or suffixes, burst?]

    def add(self, key: bytes, n: int, kept: int) -> None:
        node, at = self.root, 0
        while node[1]:
            chunk = key[at : at + BRANCH]
            at += BRANCH
            child = node[0].get(chunk)
            if child is None:
                child = node[0][chunk] = [{}, False]
            node = child
        rest = key[at:]
        end = node[0].get(rest)
        if end is None:
            node[0][rest] = [n, kept]
            if len(node[0]) > BURST:
                self._burst(node)
        else:
            end[0] += n
            if kept < end[1]:
                end[1] = kept

    @staticmethod
    def _burst(node: list) -> None:
        leaves: dict[bytes, list] = {}
        for rest, end in node[0].items():
            leaves.setdefault(rest[:BRANCH], [{}, False])[0][rest[BRANCH:]] = end
        node[0], node[1] = leaves, True
        for leaf in leaves.values():
            if len(leaf[0]) > BURST:
                BurstTrie._burst(leaf)

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            path, node = stack.pop()
            if node[1]:
                stack += [(path + chunk, child) for chunk, child in node[0].items()]
            else:
                for rest, (n, kept) in node[0].items():
                    yield path + rest, n, kept


_COMBINED_DDL = "tab string, canon binary, n bigint, kept bigint, ids array<bigint>"


def _combine(tab: str, dois: frozenset[int], parts: frozenset[int], numbers: frozenset[int]):
    schema = pa.schema([("tab", pa.string()), ("canon", pa.binary()), ("n", pa.int64()), ("kept", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def let_go(groups: dict[bytes, list[int]]) -> pa.RecordBatch:
        ids = list(groups.values())
        return pa.RecordBatch.from_arrays([pa.array([tab] * len(ids), pa.string()), pa.array(list(groups), pa.binary()), pa.array([len(x) for x in ids], pa.int64()), pa.array([min(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], schema=schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[bytes, list[int]] = {}
        held = 0
        for batch in batches:
            for key, *fields in zip(*(c.to_pylist() for c in batch.columns)):
                canon = canonical(fields, dois, parts, numbers)
                own = groups.get(canon)
                if own is None:
                    groups[canon] = [key]
                else:
                    own.append(key)
                held += 1
            if held >= COMBINE:
                yield let_go(groups)
                groups, held = {}, 0
        if groups:
            yield let_go(groups)

    return apply


def combined(rows: DataFrame, tab: str, key: str, fields: tuple[str, ...], dois: tuple[str, ...], required: str) -> DataFrame:
    """(tab, canon, n, kept, ids): canonical bytes with the keys of the copies that lay in one task."""
    at = frozenset(i for i, f in enumerate(fields) if f in dois)
    numbers = frozenset(i for i, f in enumerate(fields) if f in NUMBERS)
    parts = frozenset(i for i, f in enumerate(fields) if f not in dois and f not in NUMBERS)
    picked = rows.where(F.col(key).isNotNull() & ~is_blank(F.col(required).cast("string"))).select(F.col(key).cast("bigint"), *[F.col(f).cast("string") for f in fields])
    return spread(picked).mapInArrow(_combine(tab, at, parts, numbers), _COMBINED_DDL)


def _common_prefix(a: bytes, b: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def radix_buckets(entries: DataFrame, limit: int = BUCKET) -> DataFrame:
    """entries(tab, canon, ...) with a column `bucket`: leading bytes, as many as each bucket needs to fit the limit."""
    spark = entries.sparkSession
    out = entries.withColumn("bucket", F.concat(F.col("tab"), F.lit(":"), F.hex(F.substring("canon", 1, RADIX))))
    while True:
        # At most (entries / limit) rows: the full buckets only.
        counts = out.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("bucket")
        full = [r[0] for r in counts.collect() if not r[0].endswith("=")]
        if not full:
            return out.withColumn("bucket", F.rtrim("bucket", F.lit("=")))
        over = F.broadcast(spark.createDataFrame([(b,) for b in full], "bucket string"))
        ends = out.join(over, "bucket", "left_semi").groupBy("bucket").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).collect()
        # A bucket of one text only is marked as done; the others split after the prefix they share.
        cut = F.broadcast(spark.createDataFrame([(r["bucket"], -1 if r["a"] == r["b"] else _common_prefix(bytes(r["a"]), bytes(r["b"]))) for r in ends], "bucket string, skip int"))
        step = F.expr(f"hex(substring(canon, skip + 1, {RADIX}))")
        out = out.join(cut, "bucket", "left").withColumn("bucket", F.when(F.col("skip").isNull(), F.col("bucket")).when(F.col("skip") < 0, F.concat("bucket", F.lit("="))).otherwise(F.concat(F.col("bucket"), F.lit("."), F.col("skip").cast("string"), F.lit("/"), step))).drop("skip")


_COUNTED_DDL = "tab string, canon binary, n bigint, kept bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket after the other through a trie; the sets of more than one copy."""
    schema = pa.schema([("tab", pa.string()), ("canon", pa.binary()), ("n", pa.int64()), ("kept", pa.int64())])
    current, tab, trie = None, None, BurstTrie()

    def emit() -> Iterator[pa.RecordBatch]:
        rows = list(trie.terminals())
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([tab] * len(part), pa.string()), pa.array([r[0] for r in part], pa.binary()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64())], schema=schema)

    for batch in batches:
        for bucket, t, canon, n, kept in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != current:
                yield from emit()
                current, tab, trie = bucket, t, BurstTrie()
            trie.add(canon, n, kept)
    yield from emit()


def count_copies(entries: DataFrame, limit: int = BUCKET) -> DataFrame:
    """(tab, canon, n, kept): every distinct canonical text with its copies and the smallest key among them."""
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = radix_buckets(entries.select("tab", "canon", "n", "kept"), limit).select("bucket", "tab", "canon", "n", "kept")
    return bucketed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_count, _COUNTED_DDL)


def entries_of(spark, sf_dir: str) -> DataFrame:
    out = None
    for tab, (key, fields, dois, required) in SPECS.items():
        one = combined(load(spark, sf_dir, tab), tab, key, fields, dois, required)
        out = one if out is None else out.unionByName(one)
    return staged(out, "canonical")


def pairs(entries: DataFrame, limit: int = BUCKET) -> DataFrame:
    """(tab, kept_id, copy_id): every copy with the smallest key of its set."""
    digest = F.unhex(F.md5("canon"))
    sets = count_copies(entries, limit).where("n > 1").select("tab", digest.alias("d"), F.col("kept").alias("kept_id"))
    # Joined as the map tasks left them, a row for each task and text, so a frequent text is a few rows until it is exploded.
    met = entries.select("tab", digest.alias("d"), "ids").join(sets, ["tab", "d"])
    return met.select("tab", "kept_id", F.explode("ids").alias("copy_id")).where("copy_id > kept_id").select("tab", "kept_id", "copy_id")


def found(spark, sf_dir: str) -> DataFrame:
    return pairs(entries_of(spark, sf_dir))


def collapsed(spark, sf_dir: str) -> DataFrame:
    """One row for each set of copies: tab, kept_id, n_copies."""
    return count_copies(entries_of(spark, sf_dir)).select("tab", F.col("kept").alias("kept_id"), F.col("n").alias("n_copies"))
