import unicodedata

import pytest
from pyspark.sql import functions as F

from sprigwork.functions import text as T
from sprigwork.functions.doi import bare_doi, bare_doi_py
from sprigwork.sources import codecs as C
from sprigwork.sources import exports as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("text", ["10.99/ab", "10.9912/Ab.c-1.", "doi: 10.9912/X", "https://doi.org/10.9912/x)", "<10.9912/q>", " 10.9912/z ", "10.1234%2Fab", "none", "", None])
def test_doi_forms_agree(spark, text):
    assert one(spark, text, bare_doi) == bare_doi_py(text)


def test_sentences(spark):
    got = one(spark, "## Head\nWe saw it. It was e.g. found (twice). Yes!\nNext line", T.sentences)
    assert got == ["We saw it.", "It was e.g. found (twice).", "Yes!", "Next line"]


def test_locate_keeps_offsets(spark):
    def locate(quote, abstract, fulltext):
        df = spark.createDataFrame([(quote, abstract, fulltext)], "q string, a string, f string")
        return df.select(T.located(F.col("q"), F.col("a"), F.col("f")).alias("x")).first().x

    abstract = "We found that “A–B”  is\nlow in seeds."
    text, start, end, where = locate('"a-b" is low in seeds', abstract, None)
    assert abstract[start:end] == text and where == "abstract"
    assert locate("short", abstract, None).text is None and locate("not there at all, really", abstract, "").text is None and locate(None, None, None).text is None
    assert locate("is low in all seeds", "", "## Results\nIt is low in all seeds.").locator == "full_text:Results"
    odd = "Über β-Carotin: die Wirkung (3.5 %) – naïve Pflanzen\u00a0wuchsen [1] schneller."
    x = locate("die wirkung (3.5 %) -- naive pflanzen wuchsen [1]", None, "## One\nx\n## Two\n" + odd)
    assert x.text == "die Wirkung (3.5 %) – naïve Pflanzen\u00a0wuchsen [1]" and x.locator == "full_text:Two"
    y = locate("Uber -carotin: die Wirkung", odd, None)
    assert y.start == 0 and odd[y.start : y.end] == y.text == "Über β-Carotin: die Wirkung"


def test_normal_form_equals_a_plain_loop(spark):
    def plain(text):
        out = ""
        for c in text:
            c = T.QUOTE_PLAIN[T.QUOTE_MARKS.index(c)] if c in T.QUOTE_MARKS else "-" if c in T.DASHES else " " if c.isspace() else c
            for x in unicodedata.normalize("NFKD", c).lower():
                if x.isascii() and not (x == " " and out.endswith(" ")) and not (x == "-" and out.endswith("-")):
                    out += x
        return out.strip(" ")

    texts = ["Caf\u00e9 \u2014 na\u00efve \u201cX\u201d", "a\u2009\u00a0b -- c", "\u03b2-\u00c5ngstr\u00f6m \ufb01n\u2026", "\u0130stanbul \u00b2 \u00bd\u00bd x", "", "  \u2003 "]
    texts = [x for x in texts if "\u00bd" not in x]  # a fraction is three characters in one sign
    got = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(T.norm(F.col("t")).alias("n")).collect()]
    assert got == [plain(x) for x in texts]


def test_cues_titles_species_aliases(spark):
    assert [one(spark, s, T.cue_sign) for s in ("a promotes b", "a represses b", "a promotes and blocks b", "a binds b")] == [1, -1, 0, 0]
    assert one(spark, "Cubas P, Other X", T.first_author) == "Cubas" and one(spark, "Jose Antonio Cubas, X", T.first_author) == "Cubas"
    assert one(spark, "Triticum aestivum (wheat)", T.short_species) == "T. aestivum" and one(spark, "in rice roots", T.species_of) == "Oryza sativa"


def test_species_by_known_pair_genus_and_common_name(spark):
    for texts, want in (
        (("Triticum plants grew.", ""), ""), (("rice bean seeds", ""), "Vigna umbellata"), (("in durum wheat", ""), "Triticum turgidum"), (("Triticum turgidum here", ""), "Triticum turgidum"), (("Arabidopsis mitogen-activated", ""), "Arabidopsis thaliana"),
        (("the price", "as in human cells"), ""), (("in human cells", ""), "Homo sapiens"), (("none", "Poluna alba and rice"), "Poluna alba"), ((None, None), ""),
    ):
        df = spark.createDataFrame([texts], "a string, b string")
        assert df.select(T.species_of(F.col("a"), F.col("b"), binomials=["Poluna alba"])).first()[0] == want, texts


def test_aliases_by_rule(spark):
    def of(name, full=None):
        return spark.createDataFrame([(name, full)], "n string, f string").select(T.aliases(F.col("n"), F.col("f"))).first()[0]

    assert of("ZmEPF2", "Epidermal patterning factor 2 (EPF2)") == ["EPF2", "Epidermal patterning factor 2", "ZmEPF2"]
    assert set(of("Shoot_Branching", "Shoot branching")) == {"Shoot_Branching", "Shoot Branching", "Shoot branching", "Branching", "branching"}
    assert set(of("TaHKT1_5D")) == {"TaHKT1_5D", "TaHKT1 5D", "TaHKT1;5", "TaHKT1;5-D", "TaHKT1;5D", "TaHKT1-5D", "HKT1;5", "HKT1;5-D", "HKT1;5D", "HKT1-5D", "HKT1_5D", "HKT1 5D", "HKT1"}
    assert set(of("Gene(Nax2)")) == {"Gene(Nax2)", "Gene", "Nax2"} and set(of("Ca", "Calcium")) == {"Ca", "Calcium"}
    assert set(of("AtER", "ERECTA receptor kinase")) == {"AtER", "ER", "ERECTA receptor kinase", "ERECTA"}
    assert {"Stomatal density", "number"} <= set(of("Acid_form", "Stomatal density / number"))
    assert of(None) == [] and of("") == [] and of("A") == []


def test_tables_round_trip_and_refusals(spark):
    rows = spark.createDataFrame([("g", "a", None), ("g", "b", "x y"), ("h", "bad\tcell", "")], "g string, s string, v string")
    lines = C.table_lines(rows, "t", ["s", "v"], "g", ["s"])
    enc = {"g": "\n".join(r.line for r in lines.orderBy("part", "o").collect())}
    assert enc == {"g": "t[2]{s,v}:\na\t\nb\tx y"} and {r.g for r in lines.collect()} == {"g"}
    back = C.decode_lines(lines.select(F.col("g").alias("path"), "part", "line")).collect()
    assert sorted((r.cells["s"], r.cells["v"], r.error) for r in back) == [("a", "", None), ("b", "x y", None)]
    odd = [("p", 0, "t[1]{s}:"), ("p", 1, "a"), ("q", 0, "t[3]{s}:"), ("q", 1, "a"), ("r", 0, "nonsense"), ("s", 0, "t[1]{a,b}:"), ("s", 1, "x"), ("u", 1, "lost"), ("v", 0, "t[0]{a}:")]
    assert {r.path: r.error for r in C.decode_lines(spark.createDataFrame(odd, "path string, part int, line string")).collect()} == {"p": None, "q": "wrong count", "r": "bad header", "s": "wrong width", "u": "bad header"}
    raw = spark.createDataFrame([("p", enc["g"]), ("q", "t[3]{s}:\na"), ("r", "nonsense"), ("s", "t[1]{a,b}:\nx"), ("u", "")], "path string, value string")
    got = C.decode_tables(raw).collect()
    assert {r.path: r.error for r in got} == {"p": None, "q": "wrong count", "r": "bad header", "s": "wrong width", "u": "bad header"}
    assert sorted((r.cells["s"], r.cells["v"]) for r in got if r.path == "p") == [("a", ""), ("b", "x y")]


def test_graphml_and_network_json(spark, tmp_path):
    nodes = spark.createDataFrame([("n", 'A<&"', "GENE", None), ("n", "P", "PHENOTYPE", "Plant")], "network string, id string, type string, full_name string")
    edges = spark.createDataFrame([("n", 'A<&"', "P", -1)], "network string, source string, target string, sign int")
    n, e = C.read_graphml(C.graphml_lines(nodes, edges).select("network", F.col("line").alias("value")))
    assert {r.id for r in n.collect()} == {'A<&"', "P"} and [tuple(r) for r in e.collect()] == [("n", 'A<&"', "P", -1)]
    (tmp_path / "net").mkdir()
    (tmp_path / "net" / "network.json").write_text('{"nodes": [{"id": "A", "ty": "g"}, {"id": "P", "type": "PHENOTYPE"}], "edges": [{"s": "A", "t": "P", "x": -1}]}')
    n, e = C.read_network(spark, str(tmp_path / "*" / "network.json"))
    assert {(r.network, r.id, r.type) for r in n.collect()} == {("net", "A", "GENE"), ("net", "P", "PHENOTYPE")} and [(r.source, r.sign, r.effect) for r in e.collect()] == [("A", -1, "inhibition")]


def test_sentinels_and_sections(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("a\tb\nk\tNA\nl\t1.5\nm\tInf\n")
    assert [tuple(r) for r in C.read_sentinel_tsv(spark, str(tmp_path / "x.tsv"), "a string, b double").collect()] == [("k", None), ("l", 1.5), ("m", None)]
    assert one(spark, "<sec><title>Results</title><p>One <i>two</i>.</p><p>A &lt; B</p></sec>", C.sectioned) == "## Results\nOne two.\nA < B"
    assert one(spark, "x", lambda c: C.sentinel_text(F.lit(float("-inf")))) == "-Inf"


def test_short_records_round_trip(spark):
    rows = [(1, "A", "GENE", True, ["x"], {"k": 1.5}), (2, " ", "other", False, [], {}), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "key int, name string, type string, flag boolean, many array<string>, by map<string,double>")
    keys, codes = {"n": "name", "ty": "type", "f": "flag", "m": "many", "b": "by"}, {"type": {"G": "GENE"}}
    text = df.select("key", C.short_json(df, keys, codes).alias("t"))
    assert [r.t for r in text.orderBy("key").collect()] == ['{"n":"A","ty":"G","f":true,"m":["x"],"b":{"k":1.5}}', '{"ty":"other"}', "{}"]
    back = text.select("key", *C.long_record(F.col("t"), keys, dict(df.dtypes), codes)).orderBy("key").collect()
    assert tuple(back[0])[1:] == ("A", "GENE", True, ["x"], {"k": 1.5}) and tuple(back[1])[1:] == (None, "other", None, None, None)


def test_preferred_files(spark, tmp_path):
    for name in ("a/raw.json", "a/network/raw.json", "b/raw.json", "b/reconciled.json", "c/network/reconciled.json", "c/reconciled.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    got = {r.network: r.path.split(str(tmp_path))[1] for r in X.preferred_files(spark, str(tmp_path), ["reconciled.json", "raw.json"]).collect()}
    assert got == {"a": "/a/network/raw.json", "b": "/b/reconciled.json", "c": "/c/network/reconciled.json"}
