import json

import pytest
from pyspark.sql import functions as F

from sprigwork import api, session
from sprigwork.operators import fixpoint as X
from sprigwork.sources import codecs as C
from sprigwork.sources import exports as E


def network(spark):
    nodes = spark.createDataFrame([("n", x, t, None, s) for x, t, s in (("L", "ENVIRONMENT", True), ("A", "GENE", True), ("B", "GENE", False), ("P", "PHENOTYPE", False), ("Z", "GENE", True))], "network string, id string, type string, full_name string, is_source boolean")
    edges = spark.createDataFrame([("n", "L", "B", 1), ("n", "A", "B", 1), ("n", "B", "P", -1)], "network string, source string, target string, sign int")
    return nodes, edges


def test_old_and_new_test_shapes(spark):
    bodies = [
        {"test_id": "1", "gene": "A", "network_gene": "A", "perturbation_type": "ko", "expected_direction": "up"},
        {"test_id": "2", "network_gene": ["A", "B"], "gene_modifiers": {"A": 0.5}, "exogenous_supply": {"node": "H", "value": 2}, "expected_direction": "decreased"},
        {"test_id": "3", "network_gene": None, "exogenous_supply": {"H": 1.0}, "comparison_baseline": "epistasis"},
        {"test_id": "4", "network_gene": ["A"], "gene_modifier": 0.1, "additional_genes_modifiers": {"A": 2.0, "C": 0.0}},
    ]
    raw = spark.createDataFrame([("n", json.dumps(b)) for b in bodies], "network string, body string")
    got = {r.test_id: r for r in E.canonical_tests(raw).collect()}
    assert got["1"].modifiers == {"A": 0.0} and got["1"].comparison_baseline == "WT" and got["1"].expected == "increased"
    assert got["2"].modifiers == {"A": 0.5, "B": 1.0} and got["2"].supply == {"H": 2.0} and got["2"].comparison_baseline == "mutant"
    assert got["3"].modifiers == {} and got["3"].supply == {"H": 1.0} and got["3"].comparison_baseline == "epistasis"
    assert got["4"].modifiers == {"A": 2.0, "C": 0.0}


def test_outcomes_and_discovery(spark, tmp_path):
    t = spark.createDataFrame([("T1", [("P", "up"), ("Q", "nc")])], "test_id string, expected_outcomes array<struct<phenotype_node:string,expected_direction:string>>")
    assert [(r.outcome_id, r.expected) for r in E.explode_outcomes(t).collect()] == [("T1__P", "increased"), ("T1__Q", "unchanged")]
    for p in ("a/network.json", "a/iteration_1/network.json", "b/iteration_1/network.json", "b/iteration_3/network.json"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("{}")
    got = {r.network: r.path.split(str(tmp_path))[1] for r in E.discover_networks(spark, str(tmp_path)).collect()}
    assert got == {"a": "/a/network.json", "b": "/b/iteration_3/network.json"}
    files = C.manifest(spark, str(tmp_path)).collect()
    assert len(files) == 4 and all(len(f.checksum_sha256) == 64 and f.size_bytes == 2 for f in files)


def test_equation_files(spark, tmp_path):
    for name, body in (("a", {"equations": [{"n": "B", "a": ["A"], "inh": []}]}), ("b", {"equations": {"C": {"activators": [], "inhibitors": ["A"]}}}), ("c", "broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "eq.json").write_text(json.dumps(body) if body != "broken" else "{")
    got = {(r.network, r.node): (r.activators, r.inhibitors) for r in C.read_equations(spark, str(tmp_path / "*" / "eq.json")).collect()}
    assert got == {("a", "B"): (["A"], []), ("b", "C"): ([], ["A"])}


def test_upsert_and_ttl(spark):
    old = spark.createDataFrame([("a", "2024-01-01", 1), ("b", "2024-01-05", 1)], "k string, at string, v int")
    new = spark.createDataFrame([("a", "2024-01-01", 2), ("b", "2024-01-01", 2), ("c", None, 2)], "k string, at string, v int")
    assert {r.k: r.v for r in C.upsert(old, new, "k", "at").collect()} == {"a": 2, "b": 1, "c": 2}
    assert {r.k for r in C.fresh(old.withColumn("at", F.col("at").cast("date")), "at", F.lit("2024-02-02").cast("date"), 30).collect()} == {"b"}


def test_reports(spark):
    nodes, edges = network(spark)
    text = E.results_table(spark.createDataFrame([("t", 0.12345678, None, True)], "test string, ratio double, log double, ok boolean")).first()
    assert tuple(text) == ("t", "0.123457", "NA", "true")
    solved = X.solve_expr(spark.createDataFrame([("s", "n", {"A": 0.0}, {})], "key string, network string, modifiers map<string,double>, supply map<string,double>"), X.network_rows(nodes.select("network", "id"), edges), "algebraic")
    assert json.loads(E.steady_states(solved).first().states)["A"] == 0.0
    sizes = E.compact_sizes(nodes, {"id": "id", "ty": "type", "fn": "full_name"}, "network").first()
    assert sizes.bytes_after < sizes.bytes_before


def test_api(spark, tmp_path):
    nodes, edges = network(spark)
    m = "map<string,double>"
    tests = spark.createDataFrame([(1, "n", "P", {"B": 0.0}, {}, "WT", {}, {}, "increased"), (2, "n", "P", {"Z": 0.0}, {}, "WT", {}, {}, "unchanged"), (3, "n", "P", {"B": 0.0}, {"P": 1.0}, "mutant", {}, {}, "increased")], f"test int, network string, phenotype_node string, modifiers {m}, supply {m}, comparison_baseline string, baseline_modifiers {m}, baseline_exogenous {m}, expected string")
    for method in X.METHODS:
        results, metrics = api.validate(nodes, edges, tests, method)
        assert results.count() == 3
    results, metrics = api.validate(nodes, edges, tests)
    assert metrics.first().accuracy == 100.0
    assert {(r.check, r.item) for r in api.audit(nodes, edges).collect()} == {("floating node", "Z")}
    assert {r.id for r in api.fix(nodes, edges)[0].collect()} == {"A", "B", "L", "P"}
    assert api.scan(nodes, edges, "P").count() == 12 and api.epistasis(nodes, edges, "P").count() == 6 * 9
    with pytest.raises(ValueError, match="nowhere"):
        api.gxe(nodes, edges, "P", env=["nowhere"])
    table = api.gxe(nodes, edges, "P", doses=[0.5, 1.0])
    assert table.count() == 3 * 2 * 2 and "## Top contrasts" in api.gxe_report(table) and api.gxe(nodes, edges, "P", cross=True).count() == 0
    api.export_cytoscape(nodes, edges, str(tmp_path / "cyto"))
    api.export_atlas(nodes, edges, nodes.limit(0), str(tmp_path / "atlas"))
    assert C.read_sif(spark, str(tmp_path / "cyto" / "sif" / "network=n")).count() == 3
    assert spark.read.text(str(tmp_path / "atlas" / "_table=edges")).count() == 3
    assert api.merge(edges.withColumn("k", F.lit(1)), "k").count() == 3


def test_registered_queries_have_names_and_twins():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert len(queries) > 120 and set(sql) <= set(queries) and all(callable(f) for f in queries.values())


def test_simulate_against_a_baseline_of_its_own(spark):
    nodes = spark.createDataFrame([("n", x, "PHENOTYPE" if x == "P" else "GENE") for x in "ABP"], "network string, id string, type string")
    edges = spark.createDataFrame([("n", "A", "B", 1), ("n", "B", "P", -1)], "network string, source string, target string, sign int")
    runs = spark.createDataFrame(
        [("own", "n", {"A": 0.0, "B": 2.0}, {}, {"A": 0.0}, None), ("wt", "n", {"A": 0.0}, None, None, None)],
        "key string, network string, modifiers map<string,double>, supply map<string,double>, baseline_modifiers map<string,double>, baseline_supply map<string,double>",
    )
    rows = api.simulate(nodes, edges, runs).collect()
    last = {k: max(r.step for r in rows if r.key == k) for k in ("own", "wt")}
    end = {(r.key, r.node): (r.value, r.baseline) for r in rows if r.step == last[r.key]}
    assert all(r.value is not None and r.baseline is not None for r in rows) and len(rows) == 3 * (last["own"] + last["wt"] + 2)
    assert end["own", "A"] == (0.0, 0.0) and end["own", "B"][0] > end["own", "B"][1] and end["wt", "P"][1] == 1.0 < end["wt", "P"][0]


def test_verdicts_go_back_onto_the_edges(spark):
    papers = spark.createDataFrame([("new", "AB1 promotes CD2.", None)], "doi string, abstract string, fulltext string")
    edges = spark.createDataFrame([(1, "AB1", "CD2", 1, "old"), (2, "XX1", "CD2", 1, "old")], "edge_key long, source string, target string, sign int, doi string")
    claims = edges.select(F.col("edge_key").alias("claim"), F.col("source").alias("a"), F.col("target").alias("b"), "sign", "doi")
    got = {r.edge_key: (r.doi, r.previous_doi, r.verification) for r in api.apply_verdicts(edges, api.verify(claims, papers, offline=True), "edge_key").collect()}
    assert got == {1: ("new", "old", "repaired"), 2: ("old", None, "quarantine")}


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Spark:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Spark())
