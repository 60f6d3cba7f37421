"""Resolution of claims against paper texts: locate supporting sentences, score them, settle each claim.

Claims name two nodes and a sign; papers bring abstracts and full texts, a row a text. Every node has the spellings of its
alias index; which sentence names which node is found once, over an equi-join on the rarest word of each spelling, and all
steps read that table. A claim meets its own paper first, abstracts before full texts. What that leaves open is searched in
the abstracts of all papers, and what is still open then in all full texts. Pairs of nodes come from the sentences, a few
names each, so nothing is paired without a shared sentence. Names that the texts know by the same spellings are one, so the
pairs are bounded by the texts' vocabulary. What scores a sentence is worked out once a sentence and travels with its names as
numbers; a hit is shuffled once, by its pair, where its papers are ranked too. The sentences' words are joined last.

Defined results: a claim without or with an empty DOI has no paper on record; names without a letter, digit or mark are found
nowhere; a null sign counts as 0; a null species brings no points; repeated claims are claims of their own by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sprigwork.functions import text as T
from sprigwork.session import small, staged

#: What a sentence's score is made of, and the most it may be.
ABSTRACT, FULL_TEXT, AGREES, OPPOSES, SAME_SPECIES, WHOLE_PHRASE, TIGHT, SECOND_HAND, MOST = 0.60, 0.50, 0.20, 0.02, 0.08, 0.04, 0.05, -0.18, 0.95


#: Most rows of spellings that are broadcast to the sentences.
FEW = 100_000


def alias_index(names: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(name, alias, phrase): the normalised spellings of each distinct name, and whether one is of several words.

    nodes(id, full_name): known nodes; their spellings count for every name that equals the id in any letter case.
    """
    # Spellings are normalised inside the generator, an outer one: a filter pushed below would work them out again.
    spellings = lambda name, full: F.explode_outer(F.transform(T.aliases(name, full), T.norm)).alias("alias")
    own = names.select("name").distinct()
    every = own.select("name", spellings(F.col("name"), F.lit("")))
    if nodes is not None:
        named = nodes.where("id is not null").select("id", "full_name").distinct()
        known = named.select(F.upper("id").alias("k"), spellings(F.col("id"), F.col("full_name"))).distinct()
        every = every.unionByName(own.select("name", F.upper("name").alias("k")).join(known, "k").select("name", "alias"))
    plain = every.where(F.length("alias") >= 2).distinct()
    return plain.withColumn("phrase", F.contains("alias", F.lit(" ")))


def sentence_table(papers: DataFrame) -> DataFrame:
    """papers(doi, abstract, fulltext[, year]) -> (sid, doi, year, part, section, pos, sentence, plain, place); part is abstract or full_text.

    place: the sentence's number in its part of the DOI's texts, by pos, sentence and section.
    """
    year = F.col("year") if "year" in papers.columns else F.lit(None)
    parts = F.explode(F.array(F.struct(F.lit("abstract").alias("part"), F.col("abstract").alias("text")), F.struct(F.lit("full_text").alias("part"), F.col("fulltext").alias("text")))).alias("p")
    rows = papers.select("doi", year.cast("int").alias("year"), parts).where(F.length(F.coalesce("p.text", F.lit(""))) > 0).select("doi", "year", "p.part", "p.text")
    # Nothing moves if the papers are partitioned by DOI. Outer, as else a filter would cut the sentences again.
    each = rows.groupBy("doi", "part", "text").agg(F.min("year").alias("year")).select("doi", "year", "part", F.posexplode_outer(T.sectioned_sentences(F.col("text"))).alias("pos", "x")).where("pos is not null").select("doi", "year", "part", "x.section", "pos", "x.sentence")
    keyed = each.withColumn("sid", F.xxhash64("doi", "part", "section", "pos", "sentence"))
    once = keyed.groupBy("sid", "doi", "part", "section", "pos", "sentence").agg(F.min("year").alias("year")).withColumn("plain", T.norm(F.col("sentence")))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("doi", "part").orderBy("pos", "sentence", "section")))


def _words(col: Column) -> Column:
    """Distinct runs of letters and digits, and other marks but blanks."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(r"[a-z0-9]+|[^a-z0-9\s]"), 0))


def spelled(index: DataFrame, sentences: DataFrame) -> DataFrame:
    """(alias, sid) of every sentence that holds a spelling; twice, if it holds its rarest word in both forms.

    A sentence that holds a spelling holds all its words, the last perhaps with a plural s; a spelling meets the sentences of
    its rarest word only, and its pattern decides.
    """
    posts = sentences.select("sid", "plain", F.explode_outer(_words(F.col("plain"))).alias("said"))
    often = posts.groupBy("said").agg(F.count("*").alias("n"))
    # A word is met as it is or with an s. Where a spelling is one word of letters and digits, that is what its pattern accepts.
    forms = lambda c, plural: F.explode(F.filter(F.array(F.col(c), F.when(plural, F.concat(F.col(c), F.lit("s")))), lambda x: x.isNotNull())).alias("said")
    parts = index.select("alias").distinct().select("alias", F.explode_outer(_words(F.col("alias"))).alias("word"))
    counts = parts.select("alias", "word", forms("word", F.lit(True))).join(often, "said", "left").groupBy("alias", "word").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rarest = counts.groupBy("alias").agg(F.min(F.struct("n", "word")).alias("x"))
    one = F.rlike("alias", F.lit("^[a-z0-9]+$"))
    pattern = T.alias_pattern(F.col("alias"))
    # A spelling with a word that is nowhere is nowhere.
    asked = rarest.where("x.n > 0").select("alias", F.col("x.word").alias("word"), one.alias("one"), pattern.alias("pattern"))
    asked = staged(asked.select("alias", "one", "pattern", forms("word", ~F.col("one") | F.contains("pattern", F.lit("s?(?!")))), "words")
    if asked.count() <= FEW:  # as in small(): then the sentences need not move
        met = posts.join(F.broadcast(asked), "said")
    else:
        met = posts.select("sid", "said").join(asked, "said").join(sentences.select("sid", "plain"), "sid")
    return met.where(F.col("one") | F.contains("plain", F.col("alias")) & F.rlike("plain", F.col("pattern"))).select("alias", "sid")


def alike(index: DataFrame, said: DataFrame) -> DataFrame:
    """(name, id, as): of the names that are found at all a number each, and the smallest number of those that the texts know by
    the same spellings."""
    found = index.join(said.select("alias").distinct(), "alias").groupBy("name").agg(F.sort_array(F.collect_set("alias")).alias("all"))
    numbered = staged(found.withColumn("id", F.monotonically_increasing_id()), "found")
    return numbered.withColumn("as", F.min("id").over(Window.partitionBy("all"))).select("name", "id", "as")


#: A paper's own finding before a restatement of others': abstract, section of its own, second-hand section.
def tier(part: Column, section: Column) -> Column:
    return F.when(part == "abstract", 0).when(~section.rlike(T.SECOND_HAND), 1).otherwise(2)


def lines(index: DataFrame, said: DataFrame, sentences: DataFrame, species: DataFrame) -> DataFrame:
    """(sid, doi, part, codes, cue, tier, tight, near, year, place) of every sentence that names a node: the nodes as
    codes (the node times 2, and 1 if it is named by a whole phrase), and what else scores the sentence. near: of species(species) those that it speaks of."""
    codes = said.join(small(index), "alias").groupBy("sid").agg(F.collect_set(F.col("name") * 2 + F.col("phrase").cast("int")).alias("codes"))
    named = codes.select("sid", F.filter("codes", lambda c: (c % 2 == 1) | ~F.array_contains("codes", c + 1)).alias("codes"))
    words = F.filter(F.split(T.norm(F.col("species")), " "), lambda w: F.length(w) > 3)
    # One row, of as many species as organisms are studied.
    studied = species.select("species", words.alias("words")).agg(F.collect_list(F.struct("species", "words")).alias("studied"))
    near = F.transform(F.filter("studied", lambda x: F.exists(x["words"], lambda w: F.contains("plain", w))), lambda x: x["species"])
    tight = F.length("sentence") <= 300
    told = sentences.crossJoin(F.broadcast(studied)).select("sid", "doi", "part", T.cue_sign(F.col("plain")).alias("cue"), tier(F.col("part"), F.col("section")).alias("tier"), tight.alias("tight"), near.alias("near"), "year", "place")
    return told.join(named, "sid")


def support_score(sign: Column, species: Column, phrases: Column) -> Column:
    """Score of a line that names both nodes: place, direction words, species, whole phrases, length, whose finding it is."""
    cue = F.col("cue")
    score = F.when(F.col("part") == "abstract", ABSTRACT).otherwise(FULL_TEXT)
    score = score + F.when((sign != 0) & (cue == sign), AGREES).when((sign != 0) & (cue == -sign), OPPOSES).otherwise(0.0)
    score = score + F.when(F.array_contains("near", species), SAME_SPECIES).otherwise(0.0)
    score = score + phrases * WHOLE_PHRASE + F.when(F.col("tight"), TIGHT).otherwise(0.0)
    return score + F.when(F.col("tier") == 2, SECOND_HAND).otherwise(0.0)


#: What a pair of names is asked for by.
_ASKED = ("a", "b", "sign", "species")


def _scored(both: DataFrame) -> DataFrame:
    """Keys of the hits with what ranks them: part, raw score, place, and year and tier of the sentence; and its cue."""
    raw = support_score(F.col("sign"), F.col("species"), F.col("phrase_a") + F.col("phrase_b"))
    return both.select(*_ASKED, "sid", "doi", "part", raw.alias("raw"), "cue", "place", "year", "tier")


def _told(best: DataFrame, sentences: DataFrame) -> DataFrame:
    """best(claim, status, sign, doi, sid, part, raw, cue, n_supports, searched) as results: with the words of its sentence."""
    j = best.join(sentences.select("sid", "section", "sentence"), "sid")
    score = F.round(F.least(F.col("raw"), F.lit(MOST)), 2).alias("score")
    return j.select("claim", "status", "doi", "sentence", "part", "section", score, ((F.col("sign") == 0) | (F.col("cue") == 0) | (F.col("cue") == F.col("sign"))).alias("direction_ok"), "n_supports", "searched")


def _first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


_FOUND = ("doi", "sentence", "part", "section", "score", "direction_ok", "n_supports", "searched")


def verified(claims: DataFrame, named: DataFrame) -> DataFrame:
    """Claims that the paper on record supports: its abstracts are asked before its full texts, the best sentence counts."""
    asked = claims.where((F.length(F.coalesce("doi", F.lit(""))) > 0) & F.col("a").isNotNull() & F.col("b").isNotNull())
    # Few papers name both nodes at all: those are told first.
    node = lambda c: F.shiftright(c, 1)
    papers = named.where("doi is not null").groupBy("doi").agg(F.array_distinct(F.transform(F.flatten(F.collect_list("codes")), node)).alias("all"))
    maybe = staged(asked.join(papers, "doi").where("array_contains(all, a) and array_contains(all, b)").drop("all"), "candidates")
    phrase = lambda x: F.array_contains("codes", F.col(x) * 2 + 1).cast("int").alias(f"phrase_{x}")
    names = lambda x: F.array_contains("codes", F.col(x) * 2) | F.array_contains("codes", F.col(x) * 2 + 1)
    both = maybe.select(*_ASKED, "doi").distinct().join(named, "doi").where(names("a") & names("b")).select("*", phrase("a"), phrase("b"))
    best = _first(_scored(both), [*_ASKED, "doi"], F.col("part"), F.col("raw").desc(), F.col("place")).select(*_ASKED, "doi", "sid", "part", "raw", "cue")
    return maybe.join(best, [*_ASKED, "doi"]).select("claim", F.col("doi").alias("on_record"), "sign", "doi", "sid", "part", "raw", "cue", F.lit(1).cast("bigint").alias("n_supports"), F.lit(0).alias("searched"))


def searched(claims: DataFrame, named: DataFrame, part: str, round_: int, min_supports: int) -> DataFrame:
    """The claims with the sentence, of papers that support them in a part of their texts, of the most primary one; null if none.

    Of each paper the best sentence counts; a claim needs min_supports papers. The most primary paper reports a finding of its
    own before one of others, is the oldest, then the one of the highest score. Papers are counted and ranked once for all
    claims that ask the same. The paper on record is none of them: it names both nodes nowhere, as else the claim would be
    verified; but for claims without a DOI on record, these take no paper without one.
    """
    pairs = claims.select(*_ASKED).distinct()
    # Either code of a node that is asked for.
    asked = pairs.select("a", "b").distinct().select("a", F.explode(F.array(F.col("b") * 2, F.col("b") * 2 + 1)).alias("b")).groupBy("a").agg(F.collect_list("b").alias("with"))
    first = named.where((F.col("part") == part) & F.col("doi").isNotNull()).select("*", F.explode("codes").alias("code")).withColumn("a", F.shiftright("code", 1))
    # What is not asked for drops out before pairs are rows. From here on rows stay with their pair.
    met = first.join(asked, "a").select("*", F.explode(F.array_intersect("with", "codes")).alias("other"))
    phrase = lambda c, x: (F.col(c) % 2).cast("int").alias(f"phrase_{x}")
    both = met.select("a", F.shiftright("other", 1).alias("b"), "sid", "doi", "part", phrase("code", "a"), phrase("other", "b"), "cue", "tier", "near", "tight", "year", "place").join(pairs, ["a", "b"])
    by_paper = _first(_scored(both), [*_ASKED, "doi"], F.col("raw").desc(), F.col("place"))
    score = F.round(F.least(F.col("raw"), F.lit(MOST)), 2)
    same = Window.partitionBy(*_ASKED)
    rank = F.row_number().over(same.orderBy("tier", F.coalesce("year", F.lit(9999)), score.desc(), "doi"))
    ranked = by_paper.select(*_ASKED, "doi", "sid", "raw", "cue", rank.alias("_n"), F.count("*").over(same).alias("n"), F.count_if(F.col("doi") == "").over(same).alias("blank")).where("_n <= 2")
    top = ranked.groupBy(*_ASKED).agg(F.max("n").alias("n"), F.max("blank").alias("blank"), *[F.max(F.when(F.col("_n") == i, F.struct("doi", "sid", "raw", "cue"))).alias(f"paper_{i}") for i in (1, 2)])
    top = staged(top, "supports")
    no_doi = F.length(F.coalesce("doi", F.lit(""))) == 0
    n = F.when(no_doi, F.col("n") - F.col("blank")).otherwise(F.col("n"))
    pick = F.when(n >= max(min_supports, 1), F.when(no_doi & (F.col("paper_1.doi") == ""), F.col("paper_2")).otherwise(F.col("paper_1")))
    best = claims.join(top, [*_ASKED], "left").select("claim", *_ASKED, F.col("doi").alias("on_record"), pick.alias("_p"), n.alias("n_supports"))
    return best.select("claim", *_ASKED, "on_record", "_p.doi", "_p.sid", F.lit(part).alias("part"), "_p.raw", "_p.cue", "n_supports", F.lit(round_).alias("searched"))


def settled(claims: DataFrame, papers: DataFrame, nodes: DataFrame | None = None, min_supports: int = 1, second_pass: bool = True) -> tuple[DataFrame, DataFrame]:
    """(claim, on_record, sign, doi, sid, part, raw, cue, n_supports, searched, status) of what resolve() takes, and its sentences.

    on_record: the DOI that the claim came with; sid: the sentence, null in quarantine."""
    species = F.col("species") if "species" in claims.columns else F.lit(None).cast("string")
    # A null species and an empty one bring no points alike.
    asked = staged(claims.select("claim", "a", "b", F.coalesce("sign", F.lit(0)).alias("sign"), "doi", F.coalesce(species, F.lit("")).alias("species")), "claims")
    text = staged(sentence_table(papers), "sentences")
    names = asked.select(F.col("a").alias("name")).union(asked.select("b")).distinct()
    index = staged(alias_index(names, nodes), "aliases")
    said = staged(spelled(index, text), "spelled")
    one = staged(alike(index, said), "alike")
    stands = lambda x: small(one.select(F.col("name").alias(x), F.col("as").alias(f"_{x}")))
    asked = staged(asked.join(stands("a"), "a", "left").join(stands("b"), "b", "left").select("claim", F.col("_a").alias("a"), F.col("_b").alias("b"), "sign", "doi", "species"), "claims")
    index = index.join(one.where("id = as"), "name").select(F.col("as").alias("name"), "alias", "phrase")
    named = staged(lines(index, said, text, asked.select("species").distinct()), "lines")
    own = staged(verified(asked, named), "verified")
    found = own.withColumn("status", F.lit("verified"))
    # Claims with a name that is nowhere are not searched for.
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    left = asked.where(known).join(own.select("claim"), "claim", "left_anti")
    for round_, part in enumerate(("abstract", "full_text") if second_pass else ("abstract",), 1):
        tried = staged(searched(left, named, part, round_, min_supports), "repaired")
        found = found.unionByName(tried.where("sid is not null").select(*own.columns, F.lit("repaired").alias("status")))
        left = tried.where("sid is null").select(F.col("on_record").alias("doi"), *[c for c in asked.columns if c != "doi"])
    kinds = dict(found.dtypes)
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in ("sign", "doi", "sid", "part", "raw", "cue")]
    rest = left.select("claim", "doi").union(asked.where(~known).select("claim", "doi")).select("claim", F.col("doi").alias("on_record"), *none)
    return found.unionByName(rest.select("*", F.lit(0).cast("bigint").alias("n_supports"), F.lit(2 if second_pass else 1).alias("searched"), F.lit("quarantine").alias("status"))), text


def resolve(claims: DataFrame, papers: DataFrame, nodes: DataFrame | None = None, min_supports: int = 1, second_pass: bool = True) -> DataFrame:
    """(claim, status, doi, sentence, part, section, score, direction_ok, n_supports, searched): verified by the paper on record,
    repaired by another, or quarantined.

    claims(claim, a, b, sign, doi[, species]), papers(doi, abstract, fulltext[, year]), nodes(id, full_name). searched: 0 the
    paper on record, 1 the abstracts of all papers, 2 their full texts (the second pass, for what is still open).
    min_supports: papers that must support a repair.
    """
    every, text = settled(claims, papers, nodes, min_supports, second_pass)
    told = _told(every.where("sid is not null"), text).select("claim", "status", *_FOUND)
    kinds = dict(told.dtypes)
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in _FOUND[:-2]]
    return told.unionByName(every.where("sid is null").select("claim", "status", *none, "n_supports", "searched"))


def trail(resolved: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Attempts per claim as ARRAY<STRUCT<action, outcome>>: the paper on record, the search, and the retry of the second pass.

    claims: not needed where resolved has on_record, as settled() gives it."""
    j = resolved if claims is None else claims.select("claim", F.col("doi").alias("on_record")).join(resolved, "claim")
    blank = F.length(F.coalesce("on_record", F.lit(""))) == 0
    step = lambda action, outcome: F.struct(F.lit(action).alias("action"), outcome.alias("outcome"))
    hit = lambda round_: F.when((F.col("status") == "repaired") & (F.col("searched") == round_), "grounded").otherwise("miss")
    on_record = F.array(step("by_doi", F.when(F.col("status") == "verified", "grounded").when(blank, "miss").otherwise("ungrounded")))
    search = F.when(F.col("searched") >= 1, F.array(step("search", hit(1)))).otherwise(F.array().cast("array<struct<action:string,outcome:string>>"))
    again = F.when(F.col("searched") >= 2, F.array(step("retry", F.lit("full_text")), step("search", hit(2)))).otherwise(F.array().cast("array<struct<action:string,outcome:string>>"))
    return j.select("claim", "status", F.concat(on_record, search, again).alias("tried"))
