import json

from sprigwork.operators import nested


def rows(body, tags=("failures", "ci_95", "gene_modifiers", "edges_added")):
    out = []
    for tag, pk, parent_pk, payload in nested.visit(7, body):
        p = json.loads(payload)
        if tag in tags:
            out.append((tag, p["parent"], p["pos"], p["item"]))
    return out


def test_method_lists_and_bounds():
    body = json.dumps({"tests": {"total": 3}, "ode": {"accuracy": 0.5, "failures": ["T1", None, {"test_id": "T2"}], "ci_95": [None, 0.5]}, "rwr": {"failures": "T9", "ci_95": {"upper": "0.7"}}})
    assert rows(body) == [("failures", "ode", 0, "T1"), ("failures", "ode", 2, "T2"), ("ci_95", "ode", 1, "upper"), ("failures", "rwr", 0, "T9"), ("ci_95", "rwr", 1, "upper")]


def test_listed_methods_strata_are_no_failures():
    body = json.dumps({"methods": [{"name": "alg", "failures": [], "strata": [{"detail": {"failures": ["X"]}}]}]})
    assert rows(body) == []


def test_fix_modifiers_in_all_shapes():
    fixes = [{"updates": {"gene_modifiers": {"A": 0, "B": None}}}, {"updates": {"m": [{"node": "C", "value": 1}, None, {"node": "D"}]}}, {"updates": None}, {"updates": {"gene_modifiers": {"node": "E", "value": 2}}}]
    assert rows(json.dumps({"fixes": fixes})) == [("gene_modifiers", "0", 0, "A"), ("gene_modifiers", "0", 1, "B"), ("gene_modifiers", "1", 0, "C"), ("gene_modifiers", "1", 2, "D"), ("gene_modifiers", "3", 0, "E")]
    assert rows(json.dumps({"fixes": {"updates": {"m": {"A": 1}}}})) == [("gene_modifiers", "0", 0, "A")]


def test_edges_in_all_shapes():
    body = {"applied_suggestions": [{"edges_added": ["A -> B (+1)", "C ⊣ D", None, {"s": "E"}, {"edge": {"source": {"id": "F"}}}], "note": "edges_added X -> Y"}, {"edges_added": 3}], "edges_added": {"source": "G"}, "summary": {"edges_added": 4}}
    assert rows(json.dumps(body)) == [("edges_added", "0", 0, "A"), ("edges_added", "0", 1, "C"), ("edges_added", "0", 3, "E"), ("edges_added", "0", 4, "F"), ("edges_added", "root", 0, "G")]


def test_damaged_empty_double_encoded_and_nan():
    assert rows('{"ode": {"failures": ["T1"') == [] and rows("") == [] and rows(None) == [] and rows("[1]") == []
    inner = '{"ode": {"kappa": NaN, "failures": ["T1"]}}'
    assert rows(inner) == rows(json.dumps(inner)) == [("failures", "ode", 0, "T1")]
    assert rows("[" * 100_000) == []


def test_written_tables_keep_links_and_extra_columns(spark, tmp_path):
    body = json.dumps({"ode": {"accuracy": 0.5, "failures": ["T1", "T2"]}})
    df = spark.createDataFrame([(1, body, "x"), (2, None, "y"), (3, body, "z"), (3, body, "z")], "record_id long, body string, tag string")
    path = nested.write_tables(df, str(tmp_path / "t"))
    methods, failures = nested.read_table(spark, path, "methods"), nested.read_table(spark, path, "failures")
    assert methods.count() == 3 and failures.count() == 6
    parents = {r.pk for r in methods.collect()}
    assert {r.parent_pk for r in failures.collect()} <= parents
    assert nested.found(df.limit(0)).count() == 0


def test_no_leaf_is_lost_and_records_are_the_root(spark, tmp_path):
    body = json.dumps({"metadata": {"created": "d", "more": {"deep": [1, [2, None], {}]}}, "tests": {"total": 3}, "flag": True, "ode": {"failures": ["T1"]}})
    twice = body
    for _ in range(8):
        twice = json.dumps(twice)
    df = spark.createDataFrame([(1, body, "net", "accuracy_metrics", 2), (2, "{broken", "net", "x", None), (3, twice, None, None, None)], "record_id long, body string, network string, kind string, iteration int")
    path = nested.write_tables(df, str(tmp_path / "t"))
    records = {r.pk: r for r in nested.read_table(spark, path, "records").collect()}
    assert len(records) == 3 and records["1"].network == "net" and records["1"].item == "accuracy_metrics" and records["1"].readable and not records["2"].readable
    leaves = nested.read_table(spark, path, "leaves").where("record_id = 1").collect()
    assert {(r.path, r.kind, r.value) for r in leaves} == {
        ("$.metadata.created", "string", "d"), ("$.metadata.more.deep[0]", "number", "1"), ("$.metadata.more.deep[1][0]", "number", "2"), ("$.metadata.more.deep[1][1]", "null", None),
        ("$.metadata.more.deep[2]", "object", "{}"), ("$.tests.total", "number", "3"), ("$.flag", "boolean", "true"), ("$.ode.failures[0]", "string", "T1"),
    }
    assert {r.parent_pk for r in leaves if r.path.startswith("$.metadata.more.deep[1]")} == {"1/$.metadata.more.deep[1]"}
    assert nested.read_table(spark, path, "failures").where("record_id = 3").count() == 1 and nested.read_table(spark, path, "leaves").where("record_id = 3").count() == 8
