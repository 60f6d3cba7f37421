"""Queries of the text, evidence and codec operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sprigwork.functions import scalars as S
from sprigwork.functions import text as T
from sprigwork.functions.doi import bare_doi, doi_slug
from sprigwork.operators import evidence as E
from sprigwork.operators import fixpoint as X
from sprigwork.operators import graph as G
from sprigwork.operators import metrics as M
from sprigwork.operators import scenarios as R
from sprigwork.plans.frames import SQL_EDGES, SQL_NODES, live_nodes, net_edges, sql_expand
from sprigwork.plans.graph_queries import _ALIAS, _DOI, _EXPL, cascade
from sprigwork.session import small, spread, staged
from sprigwork.sources import codecs as C
from sprigwork.sources import exports as P
from sprigwork.tables import load

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


W = f"WITH {SQL_NODES}, {SQL_EDGES}"
_NORM = f"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(translate(translate(translate({{0}}, '{T.BLANKS}', '{' ' * len(T.BLANKS)}'), '{T.QUOTE_MARKS}', '{T.QUOTE_PLAIN.replace(chr(39), chr(39) * 2)}'), '{T.DASHES}', '{'-' * len(T.DASHES)}'))), '[^\\x00-\\x7F]+', '', 'g'), '\\s+', ' ', 'g'), '-{{{{2,}}}}', '-', 'g'))"


def _norm(col: str) -> str:
    return _NORM.replace("{{2,}}", "{2,}").replace("{0}", col)


@query(f"SELECT paper_key, {_DOI} AS bare, trim(regexp_replace(lower({_DOI}), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM papers WHERE doi IS NOT NULL")
def str1_bare_doi(spark, d: str) -> DataFrame:
    """DOI normal form and file-name form (STR1, STR2)."""
    b = bare_doi(F.col("doi"))
    return load(spark, d, "papers").where("doi is not null").select("paper_key", b.alias("bare"), doi_slug(b).alias("slug"))


@query("SELECT paper_key, trim(regexp_replace(replace(replace(replace(regexp_replace(title, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM papers")
def str3_clean_title(spark, d: str) -> DataFrame:
    return load(spark, d, "papers").select("paper_key", T.clean_title(F.col("title")).alias("title"))


@query(f"SELECT paper_key, {_norm('title')} AS plain FROM papers WHERE title IS NOT NULL")
def str4_norm(spark, d: str) -> DataFrame:
    return load(spark, d, "papers").where("title is not null").select("paper_key", T.norm(F.col("title")).alias("plain"))


def _paper_texts(spark, d: str) -> DataFrame:
    """(doi, abstract, fulltext): one row for each different text of a DOI, in one of the two columns; a DOI without any has one row."""
    none = F.lit(None).cast("string")
    p = load(spark, d, "papers").select(bare_doi(F.col("doi")).alias("doi"), F.col("abstract"), none.alias("fulltext"))
    f = load(spark, d, "fulltext").select(bare_doi(F.col("doi")).alias("doi"), none.alias("abstract"), F.col("text").alias("fulltext"))
    rows = p.unionByName(f).where("doi <> ''").select("doi", *[F.when(F.length(F.trim(c)) > 0, F.col(c)).alias(c) for c in ("abstract", "fulltext")]).distinct()
    texts = rows.where("abstract is not null or fulltext is not null")
    return texts.unionByName(rows.select("doi").distinct().join(texts, "doi", "left_anti").select("doi", none.alias("abstract"), none.alias("fulltext")))


def _dated(spark, d: str) -> DataFrame:
    """The texts, a row each and partitioned by DOI, with the earliest year of their DOI."""
    p, none = load(spark, d, "papers"), F.lit(None).cast("string")
    year = F.col("year") if "year" in p.columns else F.lit(None)
    a = p.select(bare_doi(F.col("doi")).alias("doi"), year.cast("int").alias("year"), "abstract", none.alias("fulltext"))
    f = load(spark, d, "fulltext").select(bare_doi(F.col("doi")).alias("doi"), F.lit(None).cast("int").alias("year"), none.alias("abstract"), F.col("text").alias("fulltext"))
    texts = spread(a.unionByName(f).where("doi <> ''"), "doi")
    return texts.withColumn("year", F.min("year").over(Window.partitionBy("doi")))


def _species(spark, d: str) -> DataFrame:
    """The species of each network, as its earliest result has it."""
    return load(spark, d, "master_test_level").where("network is not null").groupBy("network").agg(F.min_by("species", "master_key").alias("species"))


_GENE = f"trim(regexp_replace(gene, '{T.NOTATION}', '', 'g'))"
_CLAIMS = f"""claims AS (
  SELECT 'edge' AS kind, edge_key AS key, network, source AS a, target AS b, coalesce(sign, 0) AS sign, {_DOI.replace("doi", "coalesce(doi, '')", 1)} AS doi FROM network_edges WHERE length(trim(source)) > 0 AND length(trim(target)) > 0
  UNION ALL SELECT 'test', r.pert_key, r.network, {_GENE.replace("gene", "r.gene")}, p.id, CASE WHEN lower(trim(expected_direction)) IN ('up', 'increased') THEN 1 WHEN lower(trim(expected_direction)) IN ('dn', 'decreased') THEN -1 ELSE 0 END, {_DOI.replace("doi", "coalesce(r.doi, '')", 1)}
  FROM reconciled_perturbations r JOIN (SELECT network, min(id) AS id FROM nodes WHERE type = 'PHENOTYPE' GROUP BY 1) p ON p.network = r.network WHERE length({_GENE.replace("gene", "r.gene")}) > 0)"""


def _claims(spark, d: str) -> DataFrame:
    """Claims of edges (source, target, sign) and of tests (gene, phenotype, observed direction)."""
    e = load(spark, d, "network_edges").where("length(trim(source)) > 0 and length(trim(target)) > 0")
    edges = e.select(F.lit("edge").alias("kind"), F.col("edge_key").alias("key"), "network", F.col("source").alias("a"), F.col("target").alias("b"), F.coalesce("sign", F.lit(0)).alias("sign"), bare_doi(F.coalesce("doi", F.lit(""))).alias("doi"))
    ph = live_nodes(spark, d).where("type = 'PHENOTYPE'").groupBy("network").agg(F.min("id").alias("b"))
    seen = F.lower(F.trim("expected_direction"))
    # The gene as it is named, without the words for what was done to it.
    t = load(spark, d, "reconciled_perturbations").withColumn("a", T.parse_perturbation(F.col("gene"))["gene"]).where("length(a) > 0").join(ph, "network")
    tests = t.select(F.lit("test").alias("kind"), F.col("pert_key").alias("key"), "network", "a", "b", F.when(seen.isin("up", "increased"), 1).when(seen.isin("dn", "decreased"), -1).otherwise(0).alias("sign"), bare_doi(F.coalesce("doi", F.lit(""))).alias("doi"))
    return edges.unionByName(tests)


def _asked(spark, d: str) -> DataFrame:
    """The claims as resolve() takes them."""
    return _claims(spark, d).join(small(_species(spark, d)), "network", "left").select(F.concat_ws(":", "kind", "key").alias("claim"), "a", "b", "sign", "doi", "species")


def _resolved(spark, d: str) -> DataFrame:
    return E.resolve(_asked(spark, d), _dated(spark, d), live_nodes(spark, d).select("id", "full_name"))


@query()
def str5_located_quotes(spark, d: str) -> DataFrame:
    """Evidence sentences located in the paper they cite: exact text offsets and section (STR5, STR6)."""
    quote = F.coalesce(F.get_json_object("evidence", "$.sentence"), F.col("evidence"))
    e = load(spark, d, "network_edges").where("evidence is not null").select("edge_key", bare_doi(F.col("doi")).alias("doi"), quote.alias("quote"))
    j = e.join(_paper_texts(spark, d), "doi").select("edge_key", T.located(F.col("quote"), F.col("abstract"), F.col("fulltext")).alias("x"))
    # Of several texts the abstract counts first, then the earliest place.
    rank = F.struct(F.col("x.locator").isNull(), F.col("x.locator") != "abstract", "x.start", "x.end", "x.locator")
    best = j.groupBy("edge_key").agg(F.min_by("x", rank).alias("x"))
    return best.select("edge_key", "x.start", "x.end", "x.locator")


_SENT = "list_filter(flatten(list_transform(list_filter(list_transform(string_split(coalesce(abstract, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '## ')), lambda x: list_transform(string_split(regexp_replace(x, '([.!?])[\"'')\\]]?\\s+([A-Z0-9(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)))), lambda s: s <> '')"


@query(f"SELECT paper_key, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos, unnest(s) AS sentence FROM (SELECT paper_key, {_SENT} AS s FROM papers)")
def str7_sentences(spark, d: str) -> DataFrame:
    return load(spark, d, "papers").select("paper_key", F.posexplode(T.sentences(F.col("abstract"))).alias("pos", "sentence"))


@query()
def str8_aliases(spark, d: str) -> DataFrame:
    return load(spark, d, "kb_nodes").select("kb_id", F.explode(T.aliases(F.col("kb_node"), F.col("full_name"))).alias("alias"))


_POS, _NEG = "|".join(T.POSITIVE_CUES), "|".join(T.NEGATIVE_CUES)


@query(f"WITH t AS (SELECT paper_key, regexp_matches({_norm('abstract')}, '{_POS}') AS p, regexp_matches({_norm('abstract')}, '{_NEG}') AS n FROM papers WHERE abstract IS NOT NULL) SELECT paper_key, CASE WHEN p AND NOT n THEN 1 WHEN n AND NOT p THEN -1 ELSE 0 END AS cue FROM t")
def str10_cue_sign(spark, d: str) -> DataFrame:
    return load(spark, d, "papers").where("abstract is not null").select("paper_key", T.cue_sign(T.norm(F.col("abstract"))).alias("cue"))


_TOK = f"list_distinct(list_filter(regexp_split_to_array({_norm('coalesce(title, {q}{q})').replace('{q}', chr(39))}, '[^a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({', '.join(repr(x) for x in T.STOP_WORDS)})))"


@query(f"SELECT paper_key, CAST(len({_TOK}) AS INTEGER) AS n_tokens, array_to_string(list_sort({_TOK}), ' ') AS tokens FROM papers")
def str12_title_tokens(spark, d: str) -> DataFrame:
    t = T.title_tokens(F.col("title"))
    return load(spark, d, "papers").select("paper_key", F.size(t).alias("n_tokens"), F.array_join(F.array_sort(t), " ").alias("tokens"))


_FIRST = "CASE WHEN len(w) = 1 THEN f WHEN regexp_matches(w[-1], '^[A-Z]{1,3}$') THEN w[1] ELSE w[-1] END"


@query(f"WITH p AS (SELECT paper_key, title, year, authors, {_DOI} AS k, trim(split_part(coalesce(authors, ''), ',', 1)) AS f, regexp_split_to_array(trim(split_part(coalesce(authors, ''), ',', 1)), '\\s+') AS w FROM papers WHERE doi IS NOT NULL AND {_DOI} <> ''), "
       f"o AS (SELECT k, title AS t0, year AS y0, {_FIRST} AS a0 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY paper_key) AS rn FROM p) WHERE rn = 1), "
       f"j AS (SELECT paper_key, {_TOK.replace('title', 't0')} AS want, {_TOK} AS got, y0, year AS y, length(coalesce(a0, '')) > 0 AND length(coalesce(authors, '')) > 0 AS known, contains({_norm('authors')}, {_norm('a0')}) AS has FROM p JOIN o USING (k)), "
       "r AS (SELECT *, len(list_intersect(want, got)) / nullif(len(want), 0) AS recall, abs(y0 - y) > 1 AS far FROM j), "
       "c AS (SELECT *, least(1.0, 0.5 * recall + CASE WHEN y0 = y THEN 0.25 ELSE 0.15 END + CASE WHEN known THEN 0.15 ELSE 0.0 END) AS conf FROM r) "
       "SELECT paper_key, len(want) > 0 AND coalesce(recall >= 0.7, false) AND NOT coalesce(far, false) AND NOT (known AND NOT coalesce(has, false)) AND conf >= 0.55 AS accept, round(CASE WHEN len(want) = 0 THEN 0.0 WHEN recall < 0.7 THEN recall WHEN coalesce(far, false) THEN 0.0 WHEN known AND NOT coalesce(has, false) THEN 0.0 ELSE conf END, 4) AS confidence FROM c")
def str13_title_match(spark, d: str) -> DataFrame:
    """Every paper against the first paper of its DOI: same work or not (one comparison a paper)."""
    p = load(spark, d, "papers").withColumn("k", bare_doi(F.col("doi"))).where("k <> ''")
    first = M.best_by(p, ["k"], F.col("paper_key")).select("k", F.col("title").alias("t0"), F.col("year").alias("y0"), T.first_author(F.col("authors")).alias("a0"))
    j = p.join(first, "k").select("paper_key", T.title_match(F.col("t0"), F.col("title"), F.col("y0"), F.col("year"), F.col("a0"), F.col("authors")).alias("m"))
    return j.select("paper_key", "m.accept", "m.confidence")


@query("WITH a AS (SELECT paper_key, trim(split_part(coalesce(authors, ''), ',', 1)) AS f FROM papers), b AS (SELECT paper_key, f, regexp_split_to_array(f, '\\s+') AS p FROM a) SELECT paper_key, CASE WHEN len(p) = 1 THEN f WHEN regexp_matches(p[-1], '^[A-Z]{1,3}$') THEN p[1] ELSE p[-1] END AS surname FROM b")
def str14_first_author(spark, d: str) -> DataFrame:
    return load(spark, d, "papers").select("paper_key", T.first_author(F.col("authors")).alias("surname"))


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NAMED = "CASE " + " ".join(f"WHEN regexp_matches(lower({{0}}), {_lit(chr(92) + 'b' + k + chr(92) + 'b')}) THEN {_lit(v)}" for k, v in (*T.GENERA.items(), *sorted(T.COMMON.items(), key=lambda x: -len(x[0])))) + " END"
_PAIR = f"list_filter(list_transform(regexp_extract_all({{0}}, '{T.BINOMIAL}'), lambda x: regexp_replace(x, '\\.?\\s+', ' ')), lambda x: list_contains(k, x))[1]"
_IN = lambda c: f"coalesce({_PAIR.replace('{0}', c)}, {_NAMED.replace('{0}', c)})"
_PLANT = ", ".join(_lit(x) for x in T.ANIMAL_GENERA)


@query(f"WITH known AS (SELECT species AS s FROM master_test_level WHERE species IS NOT NULL UNION SELECT unnest([{', '.join(_lit(x) for x in sorted({*T.GENERA.values(), *(v for v in T.COMMON.values() if ' ' in v)}))}])), "
       f"f AS (SELECT paper_key, {_IN(chr(39) * 2 + ' || coalesce(title, ' + chr(39) * 2 + ')')} AS x, {_IN('coalesce(abstract, ' + chr(39) * 2 + ')')} AS y FROM papers, (SELECT list(s) AS k FROM known)) "
       f"SELECT paper_key, coalesce(x, CASE WHEN lower(split_part(y, ' ', 1)) NOT IN ({_PLANT}) THEN y END, '') AS species FROM f")
def str15_species(spark, d: str) -> DataFrame:
    """Species of each paper from its title, then its abstract; known binomials are those of the results and of the tables."""
    # One row a species: as many as organisms are studied.
    known = [r[0] for r in load(spark, d, "master_test_level").select("species").distinct().where("species is not null").collect()]
    return load(spark, d, "papers").select("paper_key", T.species_of(F.col("title"), F.col("abstract"), binomials=known).alias("species"))


@query("WITH s AS (SELECT master_key, trim(regexp_replace(coalesce(species, ''), '\\s*\\([^)]*\\)', '', 'g')) AS s FROM master_test_level), p AS (SELECT master_key, s, regexp_split_to_array(s, '\\s+') AS w FROM s) SELECT master_key, CASE WHEN len(w) >= 2 AND regexp_matches(s, '^[A-Z]') THEN substr(s, 1, 1) || '. ' || w[2] ELSE s END AS short FROM p")
def str16_short_species(spark, d: str) -> DataFrame:
    return load(spark, d, "master_test_level").select("master_key", T.short_species(F.col("species")).alias("short"))


_QUOTE = "coalesce(CASE WHEN json_valid(evidence) AND json_type(evidence) = 'OBJECT' THEN json_extract_string(evidence, '$.sentence') END, evidence)"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: length(w) > 2))"


@query(f"WITH e AS (SELECT edge_key, {_DOI} AS k, {_WORDS.format(_QUOTE)} AS want FROM network_edges WHERE evidence IS NOT NULL), p AS (SELECT DISTINCT {_DOI} AS k, abstract FROM papers WHERE length(trim(abstract)) > 0 AND {_DOI} <> ''), "
       f"s AS (SELECT k, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT k, {_SENT} AS s FROM p)), j AS (SELECT edge_key, pos, len(list_intersect(want, {_WORDS.format('sentence')})) / greatest(len(want), 1) AS score FROM e JOIN s ON s.k = e.k), b AS (SELECT edge_key, score, pos, row_number() OVER (PARTITION BY edge_key ORDER BY score DESC, pos) AS rn FROM j) "
       "SELECT edge_key, round(score, 6) AS score, pos FROM b WHERE rn = 1 AND score >= 0.2")
def str17_best_sentence(spark, d: str) -> DataFrame:
    """Of a cited abstract the sentence that shares most words with the evidence, if at least a fifth."""
    quote = F.coalesce(F.get_json_object("evidence", "$.sentence"), F.col("evidence"))
    e = load(spark, d, "network_edges").where("evidence is not null").select("edge_key", bare_doi(F.col("doi")).alias("doi"), T.claim_words(quote).alias("want"))
    p = _paper_texts(spark, d).where("abstract is not null").select("doi", F.posexplode(T.sentences(F.col("abstract"))).alias("pos", "sentence")).withColumn("got", T.claim_words(F.col("sentence")))
    s = e.join(p, "doi").withColumn("score", F.try_divide(F.size(F.array_intersect("want", "got")).cast("double"), F.greatest(F.size("want"), F.lit(1))))
    return s.groupBy("edge_key").agg(F.max(F.struct("score", (-F.col("pos")).alias("p"))).alias("b")).where("b.score >= 0.2").select("edge_key", F.round("b.score", 6).alias("score"), (-F.col("b.p")).alias("pos"))


@query(f"SELECT edge_key, coalesce(nullif({_DOI}, ''), regexp_extract(lower(coalesce(evidence, '')), '10\\.\\d{{4,9}}/[^\\s\"<>]+', 0)) AS doi FROM network_edges")
def str18_first_doi(spark, d: str) -> DataFrame:
    own = F.when(bare_doi(F.col("doi")) != "", bare_doi(F.col("doi")))
    return load(spark, d, "network_edges").select("edge_key", F.coalesce(own, F.regexp_extract(F.lower(F.coalesce("evidence", F.lit(""))), r'10\.\d{4,9}/[^\s"<>]+', 0)).alias("doi"))


@query("WITH e AS (SELECT equation_key, regexp_extract(formula, '([A-Za-z][\\w.\\-/]*)\\s*=\\s*([A-Za-z][\\w.\\-/]*)', 1) AS l, regexp_extract(formula, '([A-Za-z][\\w.\\-/]*)\\s*=\\s*([A-Za-z][\\w.\\-/]*)', 2) AS r FROM table_s5_ode_equations WHERE formula IS NOT NULL) SELECT equation_key, l AS \"left\", r AS \"right\" FROM e WHERE l <> ''")
def str19_alias_harvest(spark, d: str) -> DataFrame:
    x = load(spark, d, "table_s5_ode_equations").where("formula is not null").select("equation_key", T.harvest_alias(F.col("formula")).alias("x"))
    return x.select("equation_key", "x.left", "x.right").where("left <> ''")


@query(f"SELECT paper_key, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, unnest(a) AS author FROM (SELECT paper_key, list_filter(list_transform(string_split(coalesce(authors, ''), ';'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13) || '{T.BLANKS}')), lambda x: x <> '') AS a FROM papers)")
def str20_authors(spark, d: str) -> DataFrame:
    names = F.filter(F.transform(F.split(F.coalesce("authors", F.lit("")), ";"), lambda a: F.btrim(a, F.lit(" \t\r\n" + T.BLANKS))), lambda a: a != "")
    return load(spark, d, "papers").select("paper_key", F.posexplode(names).alias("pos", "author"))


@query(f"SELECT pert_key, trim(regexp_replace(coalesce(gene, ''), '{T.NOTATION}', '', 'g')) AS gene, CASE WHEN regexp_matches(lower(coalesce(gene, '')), '35s|overexpress|over-express|\\boe\\b|gain.of.function') THEN 'oe' WHEN regexp_matches(lower(coalesce(gene, '')), 'rnai|knock.?down|\\bkd\\b|amirna') THEN 'kd' WHEN regexp_matches(lower(coalesce(gene, '')), 'knock.?out|\\bko\\b|null|mutant|loss.of.function|crispr') THEN 'ko' WHEN regexp_matches(lower(coalesce(gene, '')), 'treat|applied|supply|feeding') THEN 'trt' ELSE 'other' END AS kind FROM reconciled_perturbations")
def str21_parsed_perturbations(spark, d: str) -> DataFrame:
    x = load(spark, d, "reconciled_perturbations").select("pert_key", T.parse_perturbation(F.col("gene")).alias("x"))
    return x.select("pert_key", "x.gene", "x.kind")


@query(f"{W}, {_CLAIMS} SELECT kind, key, network, a, b, sign, doi FROM claims")
def evd1_claims(spark, d: str) -> DataFrame:
    return _claims(spark, d)


@query()
def evd2_alias_index(spark, d: str) -> DataFrame:
    """Spellings of every name in the claims, with those of the nodes of that name in any letter case."""
    c = _claims(spark, d)
    names = c.select(F.col("a").alias("name")).union(c.select("b"))
    return E.alias_index(names, live_nodes(spark, d).select("id", "full_name"))


@query()
def evd3_resolved_claims(spark, d: str) -> DataFrame:
    """Every claim settled against the papers: verified, repaired or quarantined (EVD3, STR9, STR11)."""
    return _resolved(spark, d).select("claim", "status", "doi", "part", "section", "score", "direction_ok", "n_supports", "searched")


@query()
def evd4_second_pass(spark, d: str) -> DataFrame:
    """The claims that the first pass left open, and what the second, over the full texts, made of them."""
    return _resolved(spark, d).where("searched = 2").select("claim", "status", "doi", "section", "score", "n_supports")


@query()
def evd6_attempt_trail(spark, d: str) -> DataFrame:
    every, _ = E.settled(_asked(spark, d), _dated(spark, d), live_nodes(spark, d).select("id", "full_name"))
    return E.trail(every).select("claim", "status", F.to_json("tried").alias("tried"))


@query(f"WITH w AS (SELECT {_DOI} AS k, count(*) AS n FROM network_edges GROUP BY 1), h AS (SELECT DISTINCT {_DOI} AS k FROM papers) SELECT w.k AS doi, w.n AS n_claims, h.k IS NOT NULL AS known FROM w LEFT JOIN h ON h.k = w.k WHERE w.k <> ''")
def evd5_prefetch(spark, d: str) -> DataFrame:
    """The papers that the edges cite, one row each: how many edges wait for it, and whether it is there already."""
    w = load(spark, d, "network_edges").select(bare_doi(F.col("doi")).alias("doi")).where("doi <> ''").groupBy("doi").agg(F.count("*").alias("n_claims"))
    h = load(spark, d, "papers").select(bare_doi(F.col("doi")).alias("doi")).distinct().withColumn("h", F.lit(True))
    return w.join(h, "doi", "left").select("doi", "n_claims", F.coalesce("h", F.lit(False)).alias("known"))


# ---- codecs


@query(f"{W} SELECT network, source, target, sign FROM edges")
def snk2_table_round_trip(spark, d: str) -> DataFrame:
    """Edges as counted tab tables (one a network) and back (SNK2, SRC2)."""
    lines = C.table_lines(net_edges(spark, d), "edges", ["source", "target", "sign"], "network", ["source", "target"])
    dec = C.decode_lines(lines.select(F.col("network").alias("path"), "part", "line"))
    at = lambda c: F.try_element_at("cells", F.lit(c))
    return dec.where("error is null").select(F.col("path").alias("network"), at("source").alias("source"), at("target").alias("target"), at("sign").cast("int").alias("sign"))


_SHORT_EDGES = {k: v for k, v in C.EDGE_KEYS.items() if k != "v"}


@query("SELECT edge_key, CASE WHEN trim(edge_id) <> '' THEN edge_id END AS edge_id, CASE WHEN trim(source) <> '' THEN source END AS source, CASE WHEN trim(target) <> '' THEN target END AS target, sign, CASE WHEN trim(doi) <> '' THEN doi END AS doi FROM network_edges")
def snk1_short_edges(spark, d: str) -> DataFrame:
    """Edges as short-key JSON without blanks, and back to long names (SNK1, SRC1)."""
    e = load(spark, d, "network_edges")
    text = e.select("edge_key", C.short_json(e, _SHORT_EDGES).alias("t"))
    return text.select("edge_key", *C.long_record(F.col("t"), _SHORT_EDGES, dict(e.dtypes)))


@query(f"SELECT node_key, CASE WHEN trim(node_id) <> '' THEN node_id END AS id, CASE WHEN trim(node_type) <> '' THEN {sql_expand('node_type', S.NODE_TYPES)} END AS type, CASE WHEN trim(full_name) <> '' THEN full_name END AS full_name, CASE WHEN is_source THEN true END AS is_source FROM network_nodes")
def snk1_short_nodes(spark, d: str) -> DataFrame:
    """Nodes as short-key JSON with short type codes, and back."""
    n = load(spark, d, "network_nodes").select("node_key", F.col("node_id").alias("id"), S.expand(F.col("node_type"), S.NODE_TYPES).alias("type"), "full_name", "is_source")
    codes = {"type": S.NODE_TYPES}
    text = n.select("node_key", C.short_json(n, C.NODE_KEYS, codes).alias("t"))
    return text.select("node_key", *C.long_record(F.col("t"), C.NODE_KEYS, dict(n.dtypes), codes))


@query(f"{W} SELECT network, source, target, sign FROM edges")
def snk7_graphml_round_trip(spark, d: str) -> DataFrame:
    lines = C.graphml_lines(live_nodes(spark, d), net_edges(spark, d))
    return C.read_graphml(lines.select("network", F.col("line").alias("value")))[1]


@query(f"{W} SELECT network, id, type FROM nodes")
def snk7_graphml_nodes(spark, d: str) -> DataFrame:
    lines = C.graphml_lines(live_nodes(spark, d), net_edges(spark, d))
    return C.read_graphml(lines.select("network", F.col("line").alias("value")))[0]


@query(f"{W} SELECT network, source, target, CASE WHEN sign > 0 THEN 'activation' ELSE 'inhibition' END AS interaction, CASE WHEN sign > 0 THEN '#2E7D32' ELSE '#C62828' END AS colour FROM edges")
def snk9_edge_attributes(spark, d: str) -> DataFrame:
    return C.edge_attributes(net_edges(spark, d))


@query(f"{W} SELECT network, source || chr(9) || CASE WHEN sign > 0 THEN 'activates' WHEN sign < 0 THEN 'inhibits' ELSE 'regulates' END || chr(9) || target AS line FROM edges")
def snk8_sif(spark, d: str) -> DataFrame:
    return C.sif_lines(net_edges(spark, d))


@query(f"{W} SELECT network, id, type, CASE type WHEN 'GENE' THEN '#4C78A8' WHEN 'HORMONE' THEN '#F58518' WHEN 'METABOLITE' THEN '#54A24B' WHEN 'ENVIRONMENT' THEN '#EECA3B' WHEN 'PROTEIN_COMPLEX' THEN '#B279A2' WHEN 'REGULATORY_RNA' THEN '#9D755D' WHEN 'PHENOTYPE' THEN '#E45756' WHEN 'PROCESS' THEN '#72B7B2' ELSE '#BAB0AC' END AS colour FROM nodes")
def snk9_node_attributes(spark, d: str) -> DataFrame:
    return live_nodes(spark, d).select("network", "id", "type", S.type_colour(F.col("type")).alias("colour"))


@query("SELECT result_key, CASE WHEN ratio IS NULL OR isnan(ratio) THEN 'NA' WHEN ratio = 'Infinity'::DOUBLE THEN 'Inf' WHEN ratio = '-Infinity'::DOUBLE THEN '-Inf' ELSE printf('%.6f', ratio) END AS ratio_text FROM ode_validation_results")
def snk6_sentinels(spark, d: str) -> DataFrame:
    """Numbers as text with NA, Inf and -Inf (SNK4, SNK6)."""
    return load(spark, d, "ode_validation_results").select("result_key", C.sentinel_text(F.col("ratio")).alias("ratio_text"))


@query(f"{W} SELECT 'nodes' AS \"table\", network, id AS name, type AS what FROM nodes UNION ALL SELECT 'edges', network, source || ' > ' || target, CAST(sign AS VARCHAR) FROM edges UNION ALL SELECT 'papers', NULL, CAST(paper_key AS VARCHAR), title FROM papers")
def snk10_tagged_rows(spark, d: str) -> DataFrame:
    """Three tables in one tagged stream of JSON lines, and read back from it."""
    tag = lambda df, name: df.select(F.lit(name).alias("table"), C.slim_json(F.struct("*")).alias("row"))
    rows = tag(live_nodes(spark, d), "nodes").unionByName(tag(net_edges(spark, d), "edges")).unionByName(tag(load(spark, d, "papers"), "papers"))
    r = F.from_json("row", "network string, id string, type string, source string, target string, sign int, paper_key bigint, title string")
    x = rows.select("table", r.alias("r"))
    name = F.when(F.col("table") == "nodes", F.col("r.id")).when(F.col("table") == "edges", F.concat_ws(" > ", "r.source", "r.target")).otherwise(F.col("r.paper_key").cast("string"))
    what = F.when(F.col("table") == "nodes", F.col("r.type")).when(F.col("table") == "edges", F.col("r.sign").cast("string")).otherwise(F.col("r.title"))
    return x.select("table", "r.network", name.alias("name"), what.alias("what"))


@query(f"{W}, j AS (SELECT e.network, (a.id IS NOT NULL AND b.id IS NOT NULL) AS whole FROM edges e LEFT JOIN nodes a ON a.network = e.network AND a.id = e.source LEFT JOIN nodes b ON b.network = e.network AND b.id = e.target) SELECT network, count(*) FILTER (WHERE whole) AS n_edges, count(*) FILTER (WHERE NOT whole) AS n_dangling FROM j GROUP BY 1")
def snk11_viewer_edges(spark, d: str) -> DataFrame:
    n = live_nodes(spark, d)
    end = lambda name: n.select("network", F.col("id").alias(name), F.lit(True).alias(f"has_{name}"))
    j = net_edges(spark, d).join(end("source"), ["network", "source"], "left").join(end("target"), ["network", "target"], "left")
    whole = F.coalesce("has_source", F.lit(False)) & F.coalesce("has_target", F.lit(False))
    return j.groupBy("network").agg(F.count_if(whole).alias("n_edges"), F.count_if(~whole).alias("n_dangling"))


@query("WITH t AS (SELECT paper_key, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM papers WHERE length(trim(title)) > 0) SELECT paper_key, t AS text FROM t")
def src12_inverted_index(spark, d: str) -> DataFrame:
    """Titles as inverted indexes and back to text."""
    w = load(spark, d, "papers").where("length(trim(title)) > 0").select("paper_key", F.posexplode(F.split(F.btrim(F.regexp_replace("title", r"\s+", " ")), " ")).alias("pos", "word"))
    index = w.groupBy("paper_key", "word").agg(F.collect_list("pos").alias("p")).groupBy("paper_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "p"))).alias("index"))
    return index.select("paper_key", T.inverted_to_text(F.col("index")).alias("text"))


@query("SELECT doi, paper_key FROM (SELECT doi, paper_key, row_number() OVER (PARTITION BY doi ORDER BY fetched_at DESC NULLS LAST, paper_key DESC) AS rn FROM papers WHERE doi IS NOT NULL) WHERE rn = 1")
def src9_paper_cache(spark, d: str) -> DataFrame:
    """Latest fetch of each DOI text, as the cache keeps it."""
    p = load(spark, d, "papers").where("doi is not null")
    return M.best_by(p, ["doi"], F.col("fetched_at").desc_nulls_last(), F.col("paper_key").desc()).select("doi", "paper_key")


@query("WITH a AS (SELECT doi, min(journal) AS j FROM papers WHERE source = 'openindex' AND doi <> '' GROUP BY 1), b AS (SELECT doi, min(journal) AS j, min(licence) AS l FROM papers WHERE source <> 'openindex' AND doi <> '' GROUP BY 1), a2 AS (SELECT a.doi, j, (SELECT min(licence) FROM papers p WHERE p.doi = a.doi AND source = 'openindex') AS l FROM a) "
       "SELECT coalesce(a2.doi, b.doi) AS doi, coalesce(CASE WHEN length(trim(a2.j)) > 0 THEN a2.j END, CASE WHEN length(trim(b.j)) > 0 THEN b.j END) AS journal, coalesce(CASE WHEN length(trim(a2.l)) > 0 THEN a2.l END, CASE WHEN length(trim(b.l)) > 0 THEN b.l END) AS licence FROM a2 FULL JOIN b ON a2.doi = b.doi")
def src13_fill_blanks(spark, d: str) -> DataFrame:
    p = load(spark, d, "papers").where("doi <> ''")
    side = lambda cond: p.where(cond).groupBy("doi").agg(F.min("journal").alias("journal"), F.min("licence").alias("licence"))
    return C.fill_blanks(side("source = 'openindex'"), side("source <> 'openindex'"), "doi", ["journal", "licence"])


@query("SELECT edge_key, CASE WHEN lower(trim(coalesce(effect, ''))) IN ('+', 'activation', 'activates', 'positive', '1', '1.0') THEN 1 ELSE -1 END AS sign FROM network_edges")
def src5_strict_signs(spark, d: str) -> DataFrame:
    return load(spark, d, "network_edges").select("edge_key", S.sign_strict(F.coalesce("effect", F.lit(""))).alias("sign"))


# ---- remaining joins and checks


@query("WITH b AS (SELECT network || '__' || test_id AS pooled, pert_key FROM reconciled_perturbations WHERE network IS NOT NULL AND test_id IS NOT NULL), o AS (SELECT network || '__' || test_id AS pooled, result_key FROM ode_validation_results WHERE network IS NOT NULL AND test_id IS NOT NULL), f AS (SELECT split_part(pooled, '__', 1) AS network, pooled, min(pert_key) AS p FROM b GROUP BY ALL) "
       "SELECT f.network, count(*) AS n_pooled, count(r.pooled) AS n_paired, round(count(r.pooled) * 1.0 / count(*), 6) AS coverage, count(r.pooled) * 1.0 / count(*) >= 0.95 AS covered FROM f LEFT JOIN (SELECT DISTINCT pooled FROM o) r ON r.pooled = f.pooled GROUP BY 1")
def jn8_pooled_coverage(spark, d: str) -> DataFrame:
    """Pooled test ids against the single networks' results by their split prefix, with the share that pairs (JN8, JN16)."""
    pooled = lambda t: load(spark, d, t).where("network is not null and test_id is not null").select(F.concat_ws("__", "network", "test_id").alias("pooled")).distinct()
    j = pooled("reconciled_perturbations").join(pooled("ode_validation_results").withColumn("hit", F.lit(1)), "pooled", "left")
    share = F.count("hit") / F.count("*")
    return j.groupBy(F.split_part("pooled", F.lit("__"), F.lit(1)).alias("network")).agg(F.count("*").alias("n_pooled"), F.count("hit").alias("n_paired"), F.round(share, 6).alias("coverage"), (share >= 0.95).alias("covered"))


@query("WITH f AS (SELECT DISTINCT network, source, target FROM fixes_applied WHERE evidence_doi IS NULL AND network IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL) SELECT e.edge_key, CASE WHEN f.network IS NOT NULL THEN 'q' END AS verification FROM network_edges e LEFT JOIN f ON f.network = e.network AND f.source = e.source AND f.target = e.target")
def jn13_flag_write_back(spark, d: str) -> DataFrame:
    """Quarantine flags of fixes without evidence, joined back onto the edges."""
    key = ["network", "source", "target"]
    f = load(spark, d, "fixes_applied").where("evidence_doi is null").select(*key).dropna().distinct().withColumn("hit", F.lit(1))
    return load(spark, d, "network_edges").join(f, key, "left").select("edge_key", F.when(F.col("hit") == 1, "q").alias("verification"))


@query(f"{W}, g AS (SELECT network, id FROM nodes WHERE type NOT IN ('ENVIRONMENT', 'PHENOTYPE', 'PROCESS')), l AS (SELECT network, id FROM nodes WHERE type = 'ENVIRONMENT') SELECT g.network, g.id AS gene, mode, l.id AS env, dose FROM g JOIN l ON l.network = g.network, (VALUES ('KO'), ('KD'), ('OE')) m(mode), (VALUES (0.25::DOUBLE), (0.5), (1.0), (2.0)) v(dose)")
def jn12_grid(spark, d: str) -> DataFrame:
    """The gene x mode x lever x dose grid of each network."""
    n = live_nodes(spark, d)
    genes = n.where(~F.col("type").isin("ENVIRONMENT", "PHENOTYPE", "PROCESS")).select("network", "id")
    grid = R.gxe_grid(genes, n.where("type = 'ENVIRONMENT'").select("network", "id"), [0.25, 0.5, 1.0, 2.0])
    return grid.where("gene is not null and env is not null").select("network", "gene", "mode", "env", "dose")


@query(f"{W} SELECT network || '' AS network, r.test_id || '__' || n.id AS outcome_id, {sql_expand('r.expected_direction', S.DIRECTIONS)} AS expected FROM reconciled_perturbations r JOIN nodes n USING (network) WHERE n.type = 'PHENOTYPE' AND r.test_id IS NOT NULL")
def arr2_outcomes(spark, d: str) -> DataFrame:
    """Tests with one outcome for each phenotype of their network, an outcome a row (ARR2)."""
    ph = live_nodes(spark, d).where("type = 'PHENOTYPE'").select("network", F.col("id").alias("phenotype_node"))
    t = load(spark, d, "reconciled_perturbations").where("test_id is not null").select("pert_key", "network", "test_id", "expected_direction")
    nested = t.join(ph.groupBy("network").agg(F.collect_list("phenotype_node").alias("ph")), "network").select("network", "test_id", F.transform("ph", lambda p: F.struct(p.alias("phenotype_node"), F.col("expected_direction").alias("expected_direction"))).alias("expected_outcomes"))
    return P.explode_outcomes(nested).select("network", "outcome_id", "expected")


_IMPLIED = "CASE WHEN lower(trim(perturbation_type)) IN ('ko', 'knockout', 'loss_of_function', 'lof', 'null') THEN 0.0::DOUBLE WHEN lower(trim(perturbation_type)) IN ('kd', 'knockdown', 'rnai', 'heterozygous', 'hypomorph') THEN 0.5 WHEN lower(trim(perturbation_type)) IN ('oe', 'overexpression', 'gain_of_function', 'gof') THEN 2.0 WHEN perturbation_type LIKE '%double%' AND perturbation_type LIKE '%ko%' THEN 0.0 ELSE 1.0 END"


@query(f"WITH g AS (SELECT DISTINCT pert_key, unnest(network_gene) AS gene, {_IMPLIED} AS m FROM reconciled_perturbations), e AS (SELECT pert_key, e.key AS gene, e.value AS m FROM (SELECT pert_key, unnest(map_entries(gene_modifiers)) AS e FROM reconciled_perturbations)) "
       "SELECT pert_key, gene, m AS modifier FROM e UNION ALL SELECT pert_key, gene, m FROM g WHERE gene IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.pert_key = g.pert_key AND e.gene = g.gene)")
def src4_modifiers(spark, d: str) -> DataFrame:
    """Tests written as JSON texts of the old shape and read back: named genes get the implied modifier, given ones win (SRC4, ARR4)."""
    body = F.to_json(F.struct("test_id", "gene", "perturbation_type", "expected_direction", "network_gene", "gene_modifiers", "exogenous_supply", "comparison_baseline"))
    t = P.canonical_tests(load(spark, d, "reconciled_perturbations").select("pert_key", body.alias("body")))
    return t.select("pert_key", F.explode("modifiers").alias("gene", "modifier"))


@query(f"{W} SELECT n.network, n.id AS node, 'd/dt ' || n.id || ' = ' || coalesce((SELECT string_agg('hillA(' || e.source || ')', ' * ' ORDER BY e.source) FROM edges e WHERE e.network = n.network AND e.target = n.id AND e.sign = 1) || ' * ', '') || coalesce((SELECT string_agg('hillI(' || e.source || ')', ' * ' ORDER BY e.source) FROM edges e WHERE e.network = n.network AND e.target = n.id AND e.sign = -1) || ' * ', '') || 'modifier + supply - ' || n.id AS formula FROM nodes n")
def snk5_ode_formulas(spark, d: str) -> DataFrame:
    """Documented rate equation of every node (SNK5)."""
    return P.ode_formulas(G.equations(live_nodes(spark, d), net_edges(spark, d)))


@query(f"{W} SELECT n.network, n.id AS node, coalesce((SELECT string_agg(e.source, '; ' ORDER BY e.edge_key, e.source) FROM edges e WHERE e.network = n.network AND e.target = n.id AND e.sign = 1), '') AS activators, coalesce((SELECT string_agg(e.source, '; ' ORDER BY e.edge_key, e.source) FROM edges e WHERE e.network = n.network AND e.target = n.id AND e.sign = -1), '') AS inhibitors FROM nodes n")
def set3_ordered_equations(spark, d: str) -> DataFrame:
    """Equations whose regulators stand in the order of their first appearance, then by name (SET3)."""
    q = G.equations(live_nodes(spark, d), net_edges(spark, d), "edge_key")
    return q.select("network", "node", F.array_join("activators", "; ").alias("activators"), F.array_join("inhibitors", "; ").alias("inhibitors"))


@query("WITH b AS (SELECT record_id, regexp_replace(body, '([\\[:,]\\s*)(NaN|-?Infinity)\\b', '\\1\"\\2\"', 'g') AS b FROM raw_records) SELECT record_id, coalesce(CASE WHEN json_valid(b) THEN json_extract_string(b, '$.metadata.phenotype') END, 'NA') AS phenotype, coalesce(CASE WHEN json_valid(b) THEN json_extract_string(b, '$.ode.best.n') END, 'NA') AS best_n FROM b")
def arr3_safe_get(spark, d: str) -> DataFrame:
    """A value deep inside a record, or a default where any step is missing or the record cannot be read (ARR3)."""
    return load(spark, d, "raw_records").select("record_id", C.safe_get(F.col("body"), "$.metadata.phenotype", "NA").alias("phenotype"), C.safe_get(F.col("body"), "$.ode.best.n", "NA").alias("best_n"))


@query("SELECT doi, paper_key FROM (SELECT doi, paper_key, row_number() OVER (PARTITION BY doi ORDER BY fetched_at DESC NULLS LAST, withdrawn_at IS NULL, paper_key DESC) AS rn FROM papers WHERE doi IS NOT NULL) WHERE rn = 1")
def src9_upsert(spark, d: str) -> DataFrame:
    """Papers that were withdrawn put over those that were not: one row a DOI text, the latest fetch, of equal ones the withdrawn (SRC9)."""
    p = load(spark, d, "papers").where("doi is not null").select("doi", "paper_key", "fetched_at", "withdrawn_at")
    one = lambda x: M.best_by(x, ["doi"], F.col("fetched_at").desc_nulls_last(), F.col("paper_key").desc()).select("doi", "paper_key", "fetched_at")
    return C.upsert(one(p.where("withdrawn_at is null")), one(p.where("withdrawn_at is not null")), "doi", "fetched_at").select("doi", "paper_key")


@query("SELECT record_id, CASE WHEN body IS NULL OR trim(body) = '' THEN 'empty' WHEN kind NOT IN ('accuracy_metrics', 'fix_package', 'build_log_iteration_3') THEN 'unknown kind' ELSE 'present' END AS gate FROM raw_records")
def flt12_input_gate(spark, d: str) -> DataFrame:
    gate = F.when(F.col("body").isNull() | (F.trim("body") == ""), "empty").when(~F.col("kind").isin("accuracy_metrics", "fix_package", "build_log_iteration_3"), "unknown kind").otherwise("present")
    return load(spark, d, "raw_records").select("record_id", gate.alias("gate"))


@query("WITH c AS (SELECT pert_key, unnest([CASE WHEN test_id IS NULL THEN 'test_id missing' END, CASE WHEN gene IS NULL OR trim(gene) = '' THEN 'gene missing' END, CASE WHEN lower(expected_direction) NOT IN ('up', 'dn', 'nc', 'increased', 'decreased', 'unchanged') THEN 'bad direction' END, CASE WHEN list_contains(coalesce(network_gene, ['x']), NULL) OR len(list_filter(network_gene, lambda g: g IS NULL)) > 0 THEN 'null in network_gene' END]) AS issue FROM reconciled_perturbations) SELECT pert_key, issue FROM c WHERE issue IS NOT NULL")
def flt11_schema_issues(spark, d: str) -> DataFrame:
    """Violations of the test schema as rows."""
    s = load(spark, d, "reconciled_perturbations")
    issues = F.array_compact(F.array(
        F.when(F.col("test_id").isNull(), "test_id missing"), F.when(F.col("gene").isNull() | (F.trim("gene") == ""), "gene missing"),
        F.when(~F.lower("expected_direction").isin("up", "dn", "nc", "increased", "decreased", "unchanged"), "bad direction"), F.when(F.exists("network_gene", lambda g: g.isNull()), "null in network_gene"),
    ))
    return s.select("pert_key", F.explode(issues).alias("issue"))


_SPEC = [("a", "geomean", "bounded_inverse", None), ("b", "arithmean", "linear_clamp", None), ("c", "no_such", "bounded_inverse", None), ("d", "geomean", "nothing", None), ("e", "weighted_geomean", "bounded_inverse", [0.5, 0.3, 0.2]), ("f", "weighted_geomean", "independent_inverse", [0.5, 0.6]), ("g", "weighted_geomean", "bounded_inverse", None), ("h", None, None, None)]


@query("SELECT * FROM (VALUES ('c', 'unknown activation'), ('d', 'unknown inhibition'), ('f', 'weights do not sum to 1'), ('g', 'weights do not sum to 1')) v(node, issue)")
def flt10_equation_spec(spark, d: str) -> DataFrame:
    """Issues of a specification of node functions with one fault of each kind: unknown names, weight sums, values at ones."""
    return X.spec_issues(spark.createDataFrame(_SPEC, "node string, activation string, inhibition string, weights array<double>"))


@query("WITH al AS (SELECT term, min(kb_node) AS kb_node FROM hypocotyl_length WHERE length(trim(term)) > 0 AND length(trim(kb_node)) > 0 GROUP BY term), g AS (SELECT pert_key, generate_subscripts(network_gene, 1) AS i, unnest(network_gene) AS g FROM reconciled_perturbations) SELECT pert_key, array_to_string(list(coalesce(al.kb_node, g.g) ORDER BY i) FILTER (WHERE g.g IS NOT NULL), '; ') AS genes FROM g LEFT JOIN al ON al.term = g.g GROUP BY pert_key HAVING count(g.g) > 0")
def set11_renamed_genes(spark, d: str) -> DataFrame:
    """Names of an array through the alias table, order kept."""
    al = load(spark, d, "hypocotyl_length").where((F.length(F.trim("term")) > 0) & (F.length(F.trim("kb_node")) > 0)).groupBy(F.col("term").alias("g")).agg(F.min("kb_node").alias("k"))
    g = load(spark, d, "reconciled_perturbations").select("pert_key", F.posexplode("network_gene").alias("i", "g")).where("g is not null").join(al, "g", "left")
    return g.groupBy("pert_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("k", "g").alias("n")))), lambda x: x["n"]), "; ").alias("genes"))


@query("WITH q AS (SELECT network, node, equation_key, trim(coalesce(activators, '')) = '' AND trim(coalesce(inhibitors, '')) = '' AS src, length(coalesce(activators, '')) + length(coalesce(inhibitors, '')) AS score FROM table_s5_ode_equations WHERE node IS NOT NULL), v AS (SELECT *, count(*) FILTER (WHERE src) OVER (PARTITION BY node) * 2 > count(*) OVER (PARTITION BY node) AS most FROM q) "
       "SELECT node, equation_key FROM (SELECT node, equation_key, row_number() OVER (PARTITION BY node ORDER BY CASE WHEN src = most THEN 0 ELSE 1 END, score DESC, equation_key) AS rn FROM v) WHERE rn = 1")
def set4_equation_donor(spark, d: str) -> DataFrame:
    """Of all networks' equations of a node the donor: the majority says whether it is a source, then the longest wins (SET4, WIN3)."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    q = load(spark, d, "table_s5_ode_equations").where("node is not null").withColumn("src", blank("activators") & blank("inhibitors")).withColumn("score", size("activators") + size("inhibitors"))
    w = Window.partitionBy("node")
    v = q.withColumn("most", F.count_if("src").over(w) * 2 > F.count("*").over(w))
    return M.best_by(v, ["node"], F.when(F.col("src") == F.col("most"), 0).otherwise(1), F.col("score").desc(), F.col("equation_key")).select("node", "equation_key")


@query(f"WITH {_ALIAS}, {_EXPL}, j AS (SELECT p.pert_key, p.gene, p.v, coalesce(k.kb_node, l.kb_node, a.kb_node, b.kb_node, p.gene) AS node FROM ex p LEFT JOIN kb_nodes k ON k.kb_node = p.gene LEFT JOIN low l ON l.k = lower(p.gene) LEFT JOIN al a ON a.term = p.gene LEFT JOIN al2 b ON b.term = lower(p.gene)) "
       "SELECT pert_key, node, min(v) AS modifier, count(*) FILTER (WHERE node <> gene) AS n_renamed FROM j GROUP BY ALL")
def set12_component_remap(spark, d: str) -> DataFrame:
    """The modifier maps rewritten: a key that resolves to a reference entry under another name takes its name, others stay; of keys
    that become one the smallest value counts (SET12). One row an entry of the new maps."""
    ex = load(spark, d, "reconciled_perturbations").select("pert_key", F.explode("gene_modifiers").alias("gene", "v"))
    named = cascade(spark, d, ex).withColumn("node", F.coalesce("node", "gene"))
    return named.groupBy("pert_key", "node").agg(F.min("v").alias("modifier"), F.count_if(F.col("node") != F.col("gene")).alias("n_renamed"))
