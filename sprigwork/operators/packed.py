"""Several values packed in one field: lattice segmentation with value frequencies learned by expectation-maximisation.

A cell is cut at its certain delimiters; quoted spans are atoms that nothing cuts. What is left between two certain cuts
is a run of atoms. A run of several atoms ("A B", "A and B") is ambiguous: connector words may be cuts or names, and a
stretch of neighbouring atoms may be one value, but only without a connector and only if that value occurs quoted
elsewhere, as a name with blanks is quoted. Its readings form a lattice. The frequencies of values are learned from the
whole column: certain values are counted, atoms in lattices by forward-backward expectation, and this is repeated.
Viterbi then takes the likeliest path of each lattice. Frequencies are those of the cell's own column, and the rounds end
when no count moves by more than TOLERANCE of itself. One pass parses all cells; only the distinct texts with ambiguous runs and the values on
their lattices take part in the rounds, so their cost follows the ambiguous part alone.

Defined results: null, blank and bracket-only cells give no value; empty values are skipped without a position; a quote
that is never closed is an ordinary character; repeated rows each give their values.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprigwork.session import small, spread, staged
from sprigwork.tables import load

#: Delimiters that always cut, quote pairs, bracket pairs, connector words.
CUTS = ";|,\t\n\r\x0b\x0c+&"
QUOTES = {'"': '"', "'": "'", "`": "`", "“": "”", "„": "“", "‘": "’", "«": "»"}
BRACKETS = {"[": "]", "(": ")", "{": "}", "<": ">"}
CONNECTORS = frozenset(("and", "und", "et", "plus"))

#: A number as it follows a name: decimal point or decimal comma.
_NUMBER = r"[-+]?(?:\d+(?:[.,]\d+)?|[.]\d+)(?:[eE][-+]?\d+)?|[-+]?inf(?:inity)?|nan|null|none|true|false"
_ASSIGN = re.compile(rf"\s*[=:]\s*(?:\"(?:{_NUMBER})\"|(?:{_NUMBER}))(?=[\s;|,+&\]\)\}}>]|$)", re.I)
_INSIDE = re.compile(rf"\s*[=:]\s*(?:{_NUMBER})\s*$", re.I)
#: Share of itself by which a count may still move when the rounds of expectation-maximisation end.
TOLERANCE = 0.01
#: Distinct texts whose parse a task remembers at once.
REMEMBERED = 100_000
#: Weight of an unseen value of one atom; an unseen value of several atoms is none.
UNSEEN = 0.5


def _quoted(text: str, i: int) -> tuple[str, int] | None:
    """The quoted span that begins at i, and the index behind it; None if it is never closed."""
    opening = text[i]
    closing, out, j = QUOTES[opening], [], i + 1
    while j < len(text):
        c = text[j]
        if c == "\\" and j + 1 < len(text) and text[j + 1] in ('"', "'", "\\", "/", "u"):
            if text[j + 1] == "u" and re.match(r"[0-9a-fA-F]{4}", text[j + 2 : j + 6]):
                out.append(json.loads(f'"{text[j : j + 6]}"'))
                j += 6
            else:
                out.append(text[j + 1])
                j += 2
        elif c == closing and text[j + 1 : j + 2] == closing and opening == closing:
            out.append(c)
            j += 2
        elif c == closing:
            rest = text[j + 1 : j + 2]
            if not rest or rest in CUTS or rest.isspace() or rest in "=:" or rest in BRACKETS.values():
                return "".join(out), j + 1
            out.append(c)
            j += 1
        else:
            out.append(c)
            j += 1
    return None


def _bare(text: str) -> str:
    """Text without surrounding blanks and enclosing brackets."""
    text = text.strip()
    while len(text) > 1 and text[0] in BRACKETS and text[-1] == BRACKETS[text[0]]:
        text = text[1:-1].strip()
    return text


_EASY = re.compile(r"[^\"'`“”„‘’«»\[\](){}<>\\]*")
_SPLIT = re.compile(f"[{re.escape(CUTS)}]")
_EASY_NUMBER = re.compile(rf"([^\s=:]+)\s*[=:]\s*(?:{_NUMBER})", re.I)


def easy(text: str, numbered: bool) -> list[str] | None:
    """The values of a cell without quotes, brackets and blanks inside its values; None if it is no such cell."""
    if not _EASY.fullmatch(text):
        return None
    out = []
    for part in _SPLIT.split(text):
        part = part.strip()
        if numbered and part:  # a part without a number may be the end of a decimal comma
            m = _EASY_NUMBER.fullmatch(part)
            if not m:
                return None
            part = m[1]
        if part:
            if len(part.split(None, 1)) > 1:
                return None
            if _has_letter(part):
                out.append(part)
    return out


def runs(text: str, numbered: bool) -> list[list[tuple[str, bool]]]:
    """The cell as runs between certain cuts; a run is a list of atoms (text, quoted).

    numbered: names carry a number ("A=0.5", '"A": 1'), which ends the run and is dropped.
    """
    text = _bare(text)
    out: list[list[tuple[str, bool]]] = []
    run: list[tuple[str, bool]] = []
    word: list[str] = []
    i = 0

    def end_word() -> None:
        if word:
            run.append(("".join(word), False))
            word.clear()

    def end_run() -> None:
        end_word()
        if run:
            out.append(run.copy())
            run.clear()

    while i < len(text):
        c = text[i]
        if not word and c in QUOTES and (span := _quoted(text, i)):
            value, i = span
            value = _INSIDE.sub("", value) if numbered else value
            if value.strip():
                run.append((value.strip(), True))
            if numbered and (number := _ASSIGN.match(text, i)):
                i = number.end()
                end_run()
        elif numbered and (c in "=:" or c.isspace()) and (number := _ASSIGN.match(text, i)):
            end_run()
            i = number.end()
        elif c in CUTS:
            end_run()
            i += 1
        elif c.isspace():
            end_word()
            i += 1
        elif not word and not run and c in BRACKETS or c in BRACKETS.values() and not _opened(word, c) and _closes(text, i):
            i += 1
        else:
            word.append(c)
            i += 1
    end_run()
    return out


def _opened(word: list[str], closing: str) -> bool:
    return any(BRACKETS.get(c) == closing for c in word)


def _closes(text: str, i: int) -> bool:
    rest = text[i + 1 : i + 2]
    return not rest or rest in CUTS or rest.isspace() or rest in BRACKETS.values()


def certain(run: list[tuple[str, bool]]) -> list[str] | None:
    """The values of a run with one reading only, else None."""
    if len(run) == 1:
        return [run[0][0]] if run[0][1] or _has_letter(run[0][0]) else []
    return [v for v, _ in run] if all(quoted for _, quoted in run) else None


def _has_letter(text: str) -> bool:
    return any(c.isalnum() for c in text)


def arcs(run: list[tuple[str, bool]], longest: int | None = None) -> list[tuple[int, int, str | None]]:
    """The lattice of a run: (from, to, value), value None where a connector or a lone mark is passed over.

    longest: words of the longest quoted value; a longer stretch of the run can be no value.
    """
    out: list[tuple[int, int, str | None]] = []
    for i, (atom, quoted) in enumerate(run):
        out.append((i, i + 1, atom))
        if not quoted and (atom.lower() in CONNECTORS or not _has_letter(atom)):
            out.append((i, i + 1, None))
        for j in range(i + 2, min(len(run), i + (longest or len(run))) + 1):
            if any(q or a.lower() in CONNECTORS for a, q in run[i:j]):
                break
            out.append((i, j, " ".join(a for a, _ in run[i:j])))
    return out


def weight(value: str | None, span: int, count: float, total: float) -> float:
    """Probability of an arc, from the learned count of its value; a passed-over connector costs a little."""
    if value is None:
        return 0.1
    if span > 1:
        return count / (total + 1.0)
    unseen = UNSEEN if value.lower() not in CONNECTORS and _has_letter(value) else 1e-9
    return (count + unseen) / (total + 1.0)


def expected(run: list[tuple[str, bool]], counts: dict[str, float], total: float, longest: int | None = None) -> dict[str, float]:
    """Expected number of each value in a run: forward-backward over its lattice."""
    n, lattice = len(run), arcs(run, longest)
    forward, backward = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    scored = [(i, j, v, weight(v, j - i, counts.get(v or "", 0.0), total)) for i, j, v in lattice]
    for i, j, _, w in sorted(scored, key=lambda a: a[0]):
        forward[j] += forward[i] * w
    for i, j, _, w in sorted(scored, key=lambda a: -a[0]):
        backward[i] += backward[j] * w
    out: dict[str, float] = {}
    for i, j, v, w in scored:
        if v is not None and forward[n] > 0:
            out[v] = out.get(v, 0.0) + forward[i] * w * backward[j] / forward[n]
    return out


def viterbi(run: list[tuple[str, bool]], counts: dict[str, float], total: float, longest: int | None = None) -> list[str]:
    """The values on the likeliest path of a run; of equal paths the one of more values."""
    n = len(run)
    scored = [(i, j, v, weight(v, j - i, counts.get(v or "", 0.0), total)) for i, j, v in arcs(run, longest)]
    best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * n
    back: list[tuple[int, str | None]] = [(0, None)] * (n + 1)
    for i, j, v, w in sorted((a for a in scored if a[3] > 0), key=lambda a: a[0]):
        score = (best[i][0] + math.log(w), best[i][1] + (v is not None))
        if score > best[j]:
            best[j], back[j] = score, (i, v)
    path, at = [], n
    while at:
        at, v = back[at]
        if v is not None:
            path.append(v)
    return path[::-1]


_PARSED_DDL = "tab string, field string, row_key bigint, numbered boolean, vals array<string>, txt string, words int"


def parse(txt: str, numbered: bool) -> tuple[list[str], bool, int]:
    """The certain values of a cell, whether some run of it is ambiguous, and the words of its longest quoted value."""
    quick = easy(txt, numbered)
    if quick is not None:
        return quick, False, 0
    own, ambiguous, words = [], False, 0
    for run in runs(txt, numbered):
        values = certain(run)
        if values is None:
            ambiguous = True
        else:
            own += values
        words = max([words, *(len(v.split()) for v, quoted in run if quoted)])
    return own, ambiguous, words


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells with their certain values; the text stays only where a run of it is ambiguous."""
    known: dict[tuple[str, bool], tuple[list[str], bool, int]] = {}
    for batch in batches:
        vals, texts, words = [], [], []
        for key in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            got = known.get(key)
            if got is None:
                if len(known) > REMEMBERED:
                    known.clear()
                got = known[key] = parse(*key)
            vals.append(got[0])
            texts.append(key[0] if got[1] else None)
            words.append(got[2])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(vals, pa.list_(pa.string())), pa.array(texts, pa.string()), pa.array(words, pa.int32())], names=["tab", "field", "row_key", "numbered", "vals", "txt", "words"])


def _candidates(longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every value on the lattices of each ambiguous text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for txt, numbered in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                out.append(sorted({v for run in runs(txt, numbered) if certain(run) is None for _, _, v in arcs(run, longest) if v is not None}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], names=["tab", "field", "txt", "numbered", "n", "open"])

    return apply


def _over_lattices(decode: bool, totals: dict[tuple[str, str], float], longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per text with its candidates' counts: expected counts (one row a value) or the decoded values."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for tab, field, txt, numbered, n, known in zip(*(batch.column(k).to_pylist() for k in range(6))):
                counts, total = {x["value"]: x["count"] for x in known or ()}, totals.get((tab, field), 0.0)
                parsed = runs(txt, numbered)
                if decode:
                    out.append((tab, field, txt, [v for run in parsed for v in (certain(run) if certain(run) is not None else viterbi(run, counts, total, longest))]))
                else:
                    for run in parsed:
                        if certain(run) is None:
                            # A value of several atoms is counted from its certain occurrences only.
                            atoms = {atom for atom, _ in run}
                            out += [(tab, field, v, e * n) for v, e in expected(run, counts, total, longest).items() if v in atoms]
            last = pa.list_(pa.string()) if decode else pa.float64()
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], pa.string()) for i in range(3)), pa.array([r[3] for r in out], last)], names=["tab", "field", "txt", "vals"] if decode else ["tab", "field", "value", "more"])

    return apply


def unpack(cells: DataFrame) -> DataFrame:
    """cells(tab, field, row_key, txt, numbered) -> (tab, field, row_key, pos, val), one row a value.

    numbered is the same for all cells of a field.
    """
    column, value = ["tab", "field"], ["tab", "field", "value"]
    full = cells.where(F.length(F.trim("txt")) > 0).select("tab", "field", F.col("row_key").cast("bigint"), "txt", "numbered")
    parsed = staged(spread(full).mapInArrow(_parse, _PARSED_DDL), "packed")
    # One row a column of the input.
    sizes = parsed.groupBy(*column).agg(F.sum(F.size("vals")).alias("n"), F.max("words").alias("words")).collect()
    totals, longest = {(r["tab"], r["field"]): float(r["n"]) for r in sizes}, max([1, *(r["words"] for r in sizes)])
    texts = parsed.where("txt is not null").groupBy("tab", "field", "txt", "numbered").agg(F.count("*").alias("n"))
    open_ = staged(texts.mapInArrow(_candidates(longest), "tab string, field string, txt string, numbered boolean, n bigint, open array<string>").select("tab", "field", "txt", "numbered", "n", F.explode("open").alias("value")), "lattice")
    wanted = open_.select(*value).distinct()
    sure = parsed.select("tab", "field", F.explode("vals").alias("value")).join(small(wanted), value, "left_semi").groupBy(*value).agg(F.count("*").alias("base"))
    counts = staged(wanted.join(sure, value, "left").select(*value, F.coalesce("base", F.lit(0)).cast("double").alias("base"), F.lit(0.0).alias("more"), F.lit(0.0).alias("before")), "counts")

    def with_counts() -> DataFrame:
        known = open_.join(counts.select(*value, F.struct("value", (F.col("base") + F.col("more")).alias("count")).alias("c")), value)
        return known.groupBy("tab", "field", "txt", "numbered", "n").agg(F.collect_list("c").alias("known")).select("tab", "field", "txt", "numbered", "n", "known")

    while True:
        more = with_counts().mapInArrow(_over_lattices(False, totals, longest), "tab string, field string, value string, more double").groupBy(*value).agg(F.sum("more").alias("now"))
        counts = staged(counts.join(more, value, "left").select(*value, "base", F.coalesce("now", F.lit(0.0)).alias("more"), F.col("more").alias("before")), "counts")
        moved = counts.agg(F.max(F.abs(F.col("more") - F.col("before")) / (F.col("base") + F.col("more") + 1.0))).first()[0]
        if (moved or 0.0) <= TOLERANCE:
            break
    decoded = with_counts().mapInArrow(_over_lattices(True, totals, longest), "tab string, field string, txt string, vals array<string>")
    read = parsed.where("txt is null").select("tab", "field", "row_key", "vals").unionByName(parsed.where("txt is not null").select("tab", "field", "row_key", "txt").join(decoded, ["tab", "field", "txt"]).select("tab", "field", "row_key", "vals"))
    return read.select("tab", "field", "row_key", F.posexplode("vals").alias("pos", "val"))


def packed_cells(spark, sf_dir: str) -> DataFrame:
    out = None
    for tab, key, fields in (("master_test_level", "master_key", ("gene_modifiers", "network_gene")), ("table_s5_ode_equations", "equation_key", ("activators", "inhibitors"))):
        rows = load(spark, sf_dir, tab)
        many = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in fields])).alias("c")
        one = rows.select(F.col(key).cast("bigint").alias("row_key"), many).select(F.lit(tab).alias("tab"), F.col("c.f").alias("field"), "row_key", F.col("c.v").alias("txt"), (F.col("c.f") == "gene_modifiers").alias("numbered"))
        out = one if out is None else out.unionByName(one)
    return out


def found(spark, sf_dir: str) -> DataFrame:
    return unpack(packed_cells(spark, sf_dir))
