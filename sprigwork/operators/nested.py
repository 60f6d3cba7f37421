"""Deeply nested records into related flat tables, by single-pass tagged emission.

One depth-first visit of each body emits rows (tag, pk, parent_pk, payload) for all tables at once; the rows are
written partitioned by tag, and each table is read back from its own partition with its own schema. A record costs one
parse however many tables it feeds, and reading one table touches only that table's files. Besides the tables of the
domain there are `records`, the root of all links, and `leaves`, every scalar of a body with its path and the path of
the object or list that holds it, so that nothing is lost whatever the shape.

Defined results: a null, empty or damaged body emits its record only; a body that is a JSON text inside a JSON text is
opened, however often; NaN and Infinity pass as numbers; a single object or value stands for a list of one; null elements
keep their position and emit nothing in the domain's tables, a leaf of type null in `leaves`; unknown keys are in `leaves`;
input columns other than record_id, body, network, kind and iteration are ignored, whatever their names; these three may be missing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprigwork.session import new_path, spread

#: The spellings of keys, long and short.
METHOD_MARKS = ("failures", "ci_95", "accuracy", "kappa", "mcc")
MODIFIER_KEYS = ("gene_modifiers", "m")
GENE_KEYS = ("node", "gene", "n", "g")
SOURCE_KEYS = ("source", "s")
TARGET_KEYS = ("target", "t")
SIGN_KEYS = ("sign", "x")
TEST_KEYS = ("test_id", "id")
#: Fixed value: an edge written as text, "A -> B (+1)", "A -| B (-1)".
EDGE_TEXT = re.compile(r"^\s*(?P<s>.+?)\s*(?P<arrow>-+>|-+\||→|⊣|⟶|=>)\s*(?P<t>.+?)\s*(?:\((?P<x>[+-]?\d+)\))?\s*$", re.S)

#: Table tag -> schema of its payload. Every table also has pk and parent_pk.
TABLES = {
    "records": "record_id bigint, item string, network string, iteration int, readable boolean",
    "leaves": "record_id bigint, path string, pos int, item string, kind string, value string",
    "methods": "record_id bigint, parent string, pos int, item string, accuracy double, kappa double, mcc double",
    "failures": "record_id bigint, parent string, pos int, item string, reason string",
    "ci_95": "record_id bigint, parent string, pos int, item string, value double",
    "fixes": "record_id bigint, parent string, pos int, item string, source string, target string, sign int",
    "gene_modifiers": "record_id bigint, parent string, pos int, item string, value double",
    "suggestions": "record_id bigint, parent string, pos int, item string, priority string, disposition string",
    "edges_added": "record_id bigint, parent string, pos int, item string, target string, sign int",
}
TAGGED = "tag string, pk string, parent_pk string, payload string"


def _as_list(value: object) -> list:
    if value is None:
        return []
    return value if isinstance(value, list) else [value]


def _first(obj: dict, keys: tuple[str, ...]) -> object:
    return next((obj[k] for k in keys if obj.get(k) is not None), None)


def _name(value: object) -> str | None:
    """A name as text; an object stands for its id; blank is none."""
    if isinstance(value, dict):
        value = _first(value, ("id", "name", *GENE_KEYS))
    if value is None or isinstance(value, (dict, list, bool)):
        return None
    text = str(value)
    return text if text.strip() else None


def _number(value: object) -> float | None:
    try:
        return None if value is None or isinstance(value, (bool, dict, list)) else float(value)
    except ValueError:
        return None


def _sign(value: object) -> int | None:
    number = _number(value)
    return None if number is None or number != number else (number > 0) - (number < 0)


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def open_body(body: str | None) -> dict | None:
    """The object in a body, or None where the text is not one complete JSON object."""
    value: object = body
    while isinstance(value, str):  # each opening leaves a shorter text
        try:
            value = json.loads(value.lstrip("\ufeff"))
        except (ValueError, RecursionError):
            return None
    return value if isinstance(value, dict) else None


_KINDS = {bool: "boolean", int: "number", float: "number", str: "string", type(None): "null"}


def leaves(record_id: int, root: dict) -> Iterator[tuple[str, str, str, str]]:
    """Every scalar of a body in the order of the text; an empty object or list is a leaf of its own."""
    stack: list[tuple[str, str, int, object]] = [("$", "$", 0, root)]
    while stack:
        at, parent, pos, value = stack.pop()
        if isinstance(value, dict) and value:
            stack += [(f"{at}.{k}", at, i, v) for i, (k, v) in reversed(list(enumerate(value.items())))]
        elif isinstance(value, list) and value:
            stack += [(f"{at}[{i}]", at, i, value[i]) for i in range(len(value) - 1, -1, -1)]
        else:
            kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else _KINDS[type(value)]
            text = value if isinstance(value, str) else None if value is None else json.dumps(value, allow_nan=True)
            payload = {"record_id": record_id, "path": at, "pos": pos, "item": at[len(parent) :].lstrip("."), "kind": kind, "value": text}
            yield "leaves", f"{record_id}/{at}", f"{record_id}/{parent}", json.dumps(payload)


def visit(record_id: int, body: str | None, every_leaf: bool = False) -> Iterator[tuple[str, str, str, str]]:
    """Depth-first visit of one body: (tag, pk, parent_pk, payload) for every row of every child table."""
    root = open_body(body)
    if root is None:
        return
    if every_leaf:
        yield from leaves(record_id, root)
    top = str(record_id)

    def row(tag: str, parent_pk: str, parent: str, pos: int, item: str | None, **more: object) -> tuple[str, str, str, str]:
        payload = {"record_id": record_id, "parent": parent, "pos": pos, "item": item} | {k: v for k, v in more.items() if v is not None}
        return tag, f"{parent_pk}/{tag}:{pos}", parent_pk, json.dumps(payload, allow_nan=True)

    methods = [(k, v) for k, v in root.items() if isinstance(v, dict) and k != "methods" and any(m in v for m in METHOD_MARKS)]
    listed = _as_list(root.get("methods"))
    methods += [(_name(v.get("name")), v) for v in listed if isinstance(v, dict)]
    for pos, (name, method) in enumerate(methods):
        name = str(pos) if name is None else name
        yield row("methods", top, "root", pos, name, **{k: _number(method.get(k)) for k in ("accuracy", "kappa", "mcc")})
        own = f"{top}/methods:{pos}"
        for at, failure in enumerate(_as_list(method.get("failures"))):
            inside = failure if isinstance(failure, dict) else {}
            if (item := _name(_first(inside, TEST_KEYS) if inside else failure)) is not None:
                yield row("failures", own, name, at, item, reason=_text(inside.get("reason")))
        bounds = method.get("ci_95")
        pair = [bounds.get("lower"), bounds.get("upper")] if isinstance(bounds, dict) else _as_list(bounds)[:2]
        for at, bound in enumerate(pair):
            if bound is not None and bound != "":
                yield row("ci_95", own, name, at, ("lower", "upper")[at], value=_number(bound))

    for pos, fix in enumerate(_as_list(root.get("fixes"))):
        if not isinstance(fix, dict):
            continue
        own = f"{top}/fixes:{pos}"
        yield row("fixes", top, "root", pos, _text(fix.get("action")), source=_name(_first(fix, SOURCE_KEYS)), target=_name(_first(fix, TARGET_KEYS)), sign=_sign(_first(fix, SIGN_KEYS)))
        updates = fix.get("updates")
        modifiers = _first(updates, MODIFIER_KEYS) if isinstance(updates, dict) else None
        if isinstance(modifiers, dict) and not ("value" in modifiers and isinstance(_first(modifiers, GENE_KEYS), str)):
            pairs = list(modifiers.items())
        else:
            pairs = []
            for one in _as_list(modifiers):
                if isinstance(one, dict):
                    named = _first(one, GENE_KEYS)
                    pairs += [(named, one.get("value"))] if named is not None or len(one) != 1 else list(one.items())
                else:
                    pairs.append((one if isinstance(one, str) else None, None))
        for at, (gene, value) in enumerate(pairs):
            if (item := _name(gene)) is not None:
                yield row("gene_modifiers", own, str(pos), at, item, value=_number(value))

    def edges(parent_pk: str, parent: str, value: object) -> Iterator[tuple[str, str, str, str]]:
        for at, edge in enumerate(_as_list(value)):
            source = target = sign = None
            if isinstance(edge, str) and (found := EDGE_TEXT.match(edge)):
                source, target = found["s"], found["t"]
                sign = int(found["x"]) if found["x"] else (-1 if found["arrow"] in ("⊣",) or found["arrow"].endswith("|") else 1)
            elif isinstance(edge, dict):
                inner = edge["edge"] if isinstance(edge.get("edge"), dict) else edge
                source, target = _name(_first(inner, SOURCE_KEYS)), _name(_first(inner, TARGET_KEYS))
                sign = _sign(_first(edge, SIGN_KEYS) if _first(edge, SIGN_KEYS) is not None else _first(inner, SIGN_KEYS))
            if source is not None:
                yield row("edges_added", parent_pk, parent, at, source, target=target, sign=sign)

    for pos, suggestion in enumerate(_as_list(root.get("applied_suggestions"))):
        if isinstance(suggestion, dict):
            own = f"{top}/suggestions:{pos}"
            yield row("suggestions", top, "root", pos, _name(suggestion.get("id")), priority=_text(suggestion.get("priority")), disposition=_text(suggestion.get("disposition")))
            yield from edges(own, str(pos), suggestion.get("edges_added"))
    yield from edges(top, "root", root.get("edges_added"))


def _emit(whole: bool):
    schema = pa.schema([("tag", pa.string()), ("pk", pa.string()), ("parent_pk", pa.string()), ("payload", pa.string())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for record_id, body, network, kind, iteration in zip(*(c.to_pylist() for c in batch.columns)):
                if record_id is not None:
                    if whole:
                        root = {"record_id": record_id, "item": kind, "network": network, "iteration": iteration, "readable": open_body(body) is not None}
                        rows.append(("records", str(record_id), None, json.dumps(root)))
                    rows.extend(visit(record_id, body, whole))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], schema=schema)

    return apply


def emit_tagged(records: DataFrame, whole: bool = True) -> DataFrame:
    """(tag, pk, parent_pk, payload) of all tables, from one pass over records(record_id, body[, network, kind, iteration]).

    whole: with `records` and `leaves`, else the domain's tables only.
    """
    or_null = lambda name, kind: (F.col(name) if name in records.columns else F.lit(None)).cast(kind).alias(name)
    picked = records.select(or_null("record_id", "bigint"), or_null("body", "string"), or_null("network", "string"), or_null("kind", "string"), or_null("iteration", "int"))
    return spread(picked).mapInArrow(_emit(whole), TAGGED)


def write_tables(records: DataFrame, path: str | None = None, whole: bool = True) -> str:
    """Write the tagged rows partitioned by tag; returns the path."""
    path = path or new_path(records.sparkSession, "nested")
    emit_tagged(records, whole).write.partitionBy("tag").option("compression", "zstd").parquet(path)
    return path


def read_table(spark, path: str, tag: str) -> DataFrame:
    """One flat table with its own schema, from its own partition of a written path."""
    raw = spark.read.schema("pk string, parent_pk string, payload string, tag string").parquet(path).where(F.col("tag") == tag)
    return raw.select("pk", "parent_pk", F.from_json("payload", TABLES[tag], {"allowNonNumericNumbers": "true"}).alias("r")).select("pk", "parent_pk", "r.*")


def found(records: DataFrame) -> DataFrame:
    """Elements of the four list-like tables: record_id, child, parent, pos, item."""
    spark, path = records.sparkSession, write_tables(records, whole=False)
    parts = [read_table(spark, path, tag).select("record_id", F.lit(tag).alias("child"), "parent", "pos", "item") for tag in ("failures", "ci_95", "gene_modifiers", "edges_added")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
