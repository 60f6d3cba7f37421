"""Mapping of hand-typed names to a reference list: token-level repair, then soft TF-IDF over complete entries.

Every distinct value is read in several ways (as it stands, without notation around it, glued, split at blanks). Every
distinct token of these readings is joined to the vocabulary of the reference list: exactly, or, for words of nine or more
letters, by edit distance up to two over shared deletion variants of their first letters. A reading with its repaired tokens
then meets the entries over their rarest token. Soft TF-IDF ranks the complete entries: the similarity of each token pair falls with its
edits, that of a reading with the notation taken off it, and the entry of the highest similarity is taken. All steps are equi-joins over
distinct values, so a value that a third of all rows carry is handled once; the reference list is broadcast only after its
size has been counted.

Defined results: null and blank values give no row; a value that covers no entry completely is UNMATCHED; of equally similar
entries the one of the smallest kb_id is taken; an empty reference list leaves all values UNMATCHED.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprigwork.functions.doi import is_blank
from sprigwork.session import partitions_of, spread, staged
from sprigwork.tables import load

UNMATCHED = "UNMATCHED"
#: Letters a word needs to be open to repair, and the edits it may need.
REPAIR_FROM, EDITS = 9, 2
#: First letters of a word whose deletion variants are compared: words within EDITS share one, whatever follows.
PREFIX = 8
#: What one step of notation taken off costs of the similarity: less than any edit.
STEP = 0.998
#: Most deletion variants of the vocabulary that are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000

#: Greek letters, words of notation around a name, species prefixes.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "κ": "kappa", "λ": "lambda", "μ": "mu", "σ": "sigma", "τ": "tau", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega"}
BEFORE = ("gene", "the", "protein", "locus", "mutant", "wild-type", "wt", "loss of", "overexpressed", "over-expressed")
AFTER = ("protein", "gene", "locus", "mutants", "mutant", "null allele", "null mutant", "null", "alleles", "allele", "knock-down", "knockdown", "knock-out", "knockout", "knock down", "knock out", "ko", "kd", "oe", "ox", "rnai", "crispr", "amirna", "overexpressor", "over-expressor", "overexpression", "over-expression", "overexpressing", "line", "lines", "transgene", "plants")
SPECIES = ("at", "os", "zm", "ta", "hv", "sb", "sl", "gm", "mt", "nt", "bd", "pt")

_BEFORE = re.compile(rf"^(?:{'|'.join(BEFORE)})[\s:_-]+(?=\S)", re.I)
_AFTER = re.compile(rf"(?<=\S)[\s_-]+(?:{'|'.join(AFTER)})$", re.I)
_GLUED_OX = re.compile(r"(?<=\d)(?:ox|oe|ko|kd)$", re.I)
_PROMOTER = re.compile(r"^(?:p(?:ro)?)?[A-Za-z]*\d+[A-Za-z]*:{1,2}(?=\S)")
_TAG = re.compile(r"(?<=\S)(?:::|:|-)(?:GFP|YFP|CFP|RFP|GUS|LUC|FLAG|HA|MYC)$", re.I)
_DELTA = re.compile(r"^(?:[Δδ∆]|delta[\s_-])\s*(?=\S)", re.I)
_ALLELE = re.compile(r"(?<=\d)-\d{1,4}$")
_SPECIES = re.compile(rf"^(?:{'|'.join(SPECIES)})[\s._-]?(?=[A-Za-z]{{2,}}[\s._-]?\d)", re.I)
_PARENTHESIS = re.compile(r"^(.*?\S)\s*[(\[]([^()\[\]]+)[)\]]\s*$")
_EDGES = " \t\r\n\"'`“”„‘’«»[](){}<>.,;:!?*"


def fold(text: str) -> str:
    """NFKC, lower case, Greek letters by name, without accents."""
    text = unicodedata.normalize("NFKC", text).casefold().replace("ς", "σ")
    text = "".join(GREEK.get(c, c) for c in text)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", fold(text)) if t]


def strippings(raw: str) -> list[tuple[int, str]]:
    """The value as it stands and with notation taken off, with the number of steps that took."""
    seen: dict[str, int] = {}
    queue = deque([(raw.strip(), 0)])
    while queue:  # every rule shortens the text, so this ends
        text, level = queue.popleft()
        if not text or text in seen:
            continue
        seen[text] = level
        for rule in (_BEFORE, _AFTER, _GLUED_OX, _PROMOTER, _TAG, _DELTA, _ALLELE, _SPECIES):
            if (less := rule.sub("", text)) != text:
                queue.append((less, level + 1))
        if (trimmed := text.strip(_EDGES)) != text:
            queue.append((trimmed, level + 1))
        if m := _PARENTHESIS.match(text):
            queue += [(m[1], level + 1), (m[2], level + 1)]
    return [(level, text) for text, level in seen.items()]


def readings(raw: str) -> list[tuple[int, list[str], bool]]:
    """(level, tokens, as written) of every reading: split at blanks and marks, and glued into one token.

    Several words that were glued here may only be met without edits: their short words are not open to repair.
    """
    out: dict[tuple[str, ...], tuple[int, bool]] = {}
    for level, text in strippings(raw):
        split = tokens(text)
        if split:
            for form in (tuple(split), ("".join(split),)):
                out[form] = min((level, len(form) < len(split)), out.get(form, (level, True)))
    return [(level, list(form), exact) for form, (level, exact) in out.items()]


def variants(token: str) -> set[str]:
    """The token's first letters with up to two of them left out."""
    head = token[:PREFIX]
    out = {head}
    for i in range(len(head)):
        less = head[:i] + head[i + 1 :]
        out.add(less)
        out.update(less[:j] + less[j + 1 :] for j in range(i, len(less)))
    return out


def distance(a: str, b: str, most: int = EDITS) -> int:
    """Edits between two words, neighbours swapped counting as one; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    # What both begin and end with costs nothing.
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < end - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if not a or not b:
        return max(len(a), len(b))
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


# ---- the reference list ----


def reference_forms(kb: DataFrame) -> DataFrame:
    """(kb_id, kb_node, toks, open): every spelling of an entry, as split tokens and glued; open = has a word to repair."""
    named = kb.select(F.col("kb_id").cast("bigint").alias("kb_id"), "kb_node", F.array_compact(F.concat(F.array("kb_node", "full_name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("names"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kb_id, node, names in zip(*(c.to_pylist() for c in batch.columns)):
                for name in dict.fromkeys(names or ()):
                    split = tokens(name)
                    if split:
                        glued = "".join(split)
                        long = any(len(t) >= REPAIR_FROM and t.isalpha() for t in split)
                        out.append((kb_id, node, split, [glued] if long and glued.isalpha() else []))
                        if len(split) > 1:
                            out.append((kb_id, node, [glued], [glued] if long and glued.isalpha() else []))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.list_(pa.string())), pa.array([r[3] for r in out], pa.list_(pa.string()))], names=["kb_id", "kb_node", "toks", "open"])

    return named.mapInArrow(spell, "kb_id bigint, kb_node string, toks array<string>, open array<string>").distinct()


def weighted_forms(forms: DataFrame) -> DataFrame:
    """(form, kb_id, kb_node, toks, idf, rare): forms with the weights of their tokens and their rarest token."""
    total = forms.count()
    numbered = forms.select("kb_id", "kb_node", "toks", F.xxhash64("kb_id", "kb_node", "toks").alias("form"))
    exploded = numbered.select("form", "kb_id", "kb_node", F.posexplode("toks").alias("i", "tok"))
    df = exploded.groupBy("tok").agg(F.countDistinct("form").alias("df"))
    weighed = exploded.join(df, "tok").withColumn("idf", F.log(F.lit(1.0 + total) / F.col("df")))
    packed = weighed.groupBy("form", "kb_id", "kb_node").agg(F.sort_array(F.collect_list(F.struct("i", "tok", "idf"))).alias("t"), F.max(F.struct("idf", "tok")).alias("r"))
    return packed.select("form", "kb_id", "kb_node", F.col("t.tok").alias("toks"), F.col("t.idf").alias("idf"), F.col("r.tok").alias("rare"))


# ---- tokens to vocabulary ----


def _with_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tok, var = [], []
        for t in batch.column(0).to_pylist():
            own = variants(t)
            tok += [t] * len(own)
            var += own
            if len(tok) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(tok, pa.string()), pa.array(var, pa.string())], names=["token", "variant"])
                tok, var = [], []
        yield pa.RecordBatch.from_arrays([pa.array(tok, pa.string()), pa.array(var, pa.string())], names=["token", "variant"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(a, b, distance(a, b)) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        pairs = [p for p in pairs if p[2] <= EDITS]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array([p[2] for p in pairs], pa.int32())], names=["token", "vocab", "d"])


def salted(df: DataFrame, *keys: str) -> DataFrame:
    """df over all tasks by a hash of its keys, which no partitioning that is there already can stand for."""
    return df.withColumn("_salt", F.xxhash64(*keys)).repartition(partitions_of(df.sparkSession), "_salt").drop("_salt")


def repairs(distinct_tokens: DataFrame, forms: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(token, vocab, d): each distinct token with the vocabulary words it may stand for."""
    vocab = forms.select(F.explode("toks").alias("vocab")).distinct()
    exact = distinct_tokens.join(vocab, distinct_tokens.token == vocab.vocab).select("token", "vocab", F.lit(0).alias("d"))
    letters = F.col("vocab").rlike(rf"^\p{{L}}{{{REPAIR_FROM},}}$")
    glued = forms.select(F.explode("open").alias("vocab"))
    words = vocab.where(letters)
    single = forms.where(F.size("toks") > 1).select(F.explode("toks").alias("vocab")).where(letters)
    may = staged(words.join(glued.unionByName(single).distinct(), "vocab", "left_semi").distinct(), "vocabulary")
    bound = may.agg(F.max(F.length("vocab")), F.count("*")).first()
    longest, rows = int(bound[0] or 0), int(bound[1]) * (1 + PREFIX + PREFIX * (PREFIX - 1) // 2)
    variant = may.mapInArrow(_with_variants, "vocab string, variant string")
    variant = F.broadcast(variant) if rows <= broadcast_rows else variant
    near = distinct_tokens.join(exact.select("token"), "token", "left_anti").where((F.length("token") <= longest + EDITS) & F.col("token").rlike(rf"^\p{{L}}{{{REPAIR_FROM - EDITS},}}$"))
    met = salted(near, "token").mapInArrow(_with_variants, "token string, variant string").join(variant, "variant").where(F.abs(F.length("token") - F.length("vocab")) <= EDITS).select("token", "vocab")
    fuzzy = salted(met.distinct(), "token", "vocab").mapInArrow(_verify, "token string, vocab string, d int")
    return exact.unionByName(fuzzy)


# ---- readings to entries ----


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(raw, k, level, toks, exact) for raw in batch.column(0).to_pylist() for k, (level, toks, exact) in enumerate(readings(raw))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.list_(pa.string())), pa.array([r[4] for r in out], pa.bool_())], names=["raw", "reading", "level", "toks", "exact"])


def soft_tfidf(repaired: list[dict[str, int]], toks: list[str], idf: list[float]) -> tuple[float, int] | None:
    """Similarity of a reading (per token: vocabulary word -> edits) and an entry, and the edits; None if not complete.

    Complete: every token of the reading stands for a token of the entry and the other way round, each used once.
    """
    if len(repaired) != len(toks):
        return None
    left = dict(enumerate(repaired))
    dot, edits = 0.0, 0
    for tok, w in sorted(zip(toks, idf), key=lambda x: -x[1]):
        best = min(((r[tok], i) for i, r in left.items() if tok in r), default=None)
        if best is None:
            return None
        d, i = best
        del left[i]
        edits += d
        dot += w * w * (1.0 - d / (len(tok) + 1.0))
    norm = sum(w * w for w in idf)
    return (dot / norm if norm else 1.0), edits


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw, level, exact, n, at, vocab, edits, kb_id, node, toks, idf in zip(*(c.to_pylist() for c in batch.columns)):
            by_token: dict[int, dict[str, int]] = {}
            for i, word, d in zip(at, vocab, edits):
                by_token.setdefault(i, {})[word] = d
            if len(by_token) == n and (hit := soft_tfidf([by_token[i] for i in sorted(by_token)], toks, idf)) and not (exact and hit[1]):
                out.append((raw, -round(hit[0] * STEP**level, 12), kb_id, node))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.float64()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.string())], names=["raw", "below", "kb_id", "kb_node"])


def link(raws: DataFrame, kb: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """raws(raw: distinct) -> (raw, kb_node) for the values that mean an entry."""
    forms = staged(reference_forms(kb), "forms")
    entries = staged(weighted_forms(forms), "entries")
    read = staged(spread(raws, "raw").mapInArrow(_read, "raw string, reading int, level int, toks array<string>, exact boolean"), "readings")
    words = read.select(F.explode("toks").alias("token")).distinct()
    repaired = staged(repairs(words, forms, broadcast_rows), "repairs")
    each = read.select("raw", "reading", "level", "exact", F.size("toks").alias("n"), F.posexplode("toks").alias("i", "token")).join(repaired, "token")
    whole = each.groupBy("raw", "reading", "level", "exact", "n").agg(F.collect_list(F.struct("i", "vocab", "d")).alias("repaired"), F.countDistinct("i").alias("covered")).where("covered = n")
    # An entry is met over its rarest token only, which a complete reading must hold.
    met = whole.withColumn("rare", F.explode(F.array_distinct("repaired.vocab"))).join(entries, "rare").where(F.size(entries.toks) == F.col("n"))
    ranked = spread(met.select("raw", "level", "exact", "n", "repaired.i", "repaired.vocab", "repaired.d", "kb_id", "kb_node", entries.toks, "idf"), "raw").mapInArrow(_rank, "raw string, below double, kb_id bigint, kb_node string")
    return ranked.groupBy("raw").agg(F.min(F.struct("below", "kb_id", "kb_node")).alias("best")).select("raw", "best.kb_node")


def typed_values(spark, sf_dir: str) -> DataFrame:
    """(tab, field, row_key, pos, raw) of the four fields, blank values left out."""
    terms, perts = load(spark, sf_dir, "hypocotyl_length"), load(spark, sf_dir, "reconciled_perturbations")
    field = lambda tab, name: F.struct(F.lit(tab).alias("tab"), F.lit(name).alias("field"), F.col(name).cast("string").alias("raw"))
    a = terms.select(F.col("alias_key").cast("bigint").alias("row_key"), F.explode(F.array(field("hypocotyl_length", "term"), field("hypocotyl_length", "kb_node"))).alias("x")).select("x.tab", "x.field", "row_key", F.lit(0).alias("pos"), "x.raw")
    lit = [F.lit("reconciled_perturbations").alias("tab"), F.lit("gene").alias("field"), F.lit("network_gene").alias("field")]
    key = F.col("pert_key").cast("bigint").alias("row_key")
    b = perts.select(lit[0], lit[1], key, F.lit(0).alias("pos"), F.col("gene").alias("raw"))
    c = perts.select(lit[0], lit[2], key, F.posexplode("network_gene").alias("pos", "raw"))
    return a.unionByName(b).unionByName(c).where(~is_blank(F.col("raw")))


def found(spark, sf_dir: str) -> DataFrame:
    cells = typed_values(spark, sf_dir)
    matched = link(cells.select("raw").distinct(), load(spark, sf_dir, "kb_nodes"))
    return cells.join(matched, "raw", "left").select("tab", "field", "row_key", "pos", F.coalesce("kb_node", F.lit(UNMATCHED)).alias("kb_node"))


def unmatched(spark, sf_dir: str) -> DataFrame:
    """The values without an entry and how many cells hold each."""
    cells = typed_values(spark, sf_dir)
    matched = link(cells.select("raw").distinct(), load(spark, sf_dir, "kb_nodes"))
    return cells.groupBy("raw").agg(F.count("*").alias("n_cells")).join(matched, "raw", "left_anti").select("raw", "n_cells")
