import re

import pytest

from sprigwork.operators import evidence as E
from sprigwork.plans import text_queries as Q

CLAIM, PAPER = "claim long, a string, b string, sign int, doi string", "doi string, abstract string, fulltext string"


def test_search_meets_every_spelling_that_the_pattern_accepts(spark):
    papers = spark.createDataFrame([("p1", "The LLH4 line for seed mass rose.", None), ("p2", "Two abscisins induce X/Y.", None), ("p3", "AB promotes \u03b2.", None)], PAPER)
    claims = spark.createDataFrame([(1, "seed_mass", "LLH4", 0, ""), (2, "Abscisin", "X/Y", 1, "p9"), (3, "seed__mass", "llh4", 0, None), (4, "\u03b2", "AB", 1, None), (5, "seed", "AB", 1, None)], CLAIM)
    got = {r.claim: (r.status, r.doi) for r in E.resolve(claims, papers).collect()}
    assert got == {1: ("repaired", "p1"), 2: ("repaired", "p2"), 3: ("repaired", "p1"), 4: ("quarantine", None), 5: ("quarantine", None)}


def test_every_text_of_a_doi_is_read(spark, tmp_path):
    seen = "AB1 promotes CD2 in all the leaves."
    edges = [("n", 1, "AB1", "CD2", 1, "10.9912/a", seen), ("n", 2, "EF3", "GH4", -1, "10.9912/a", "EF3 represses GH4 in the roots."), ("n", 3, "X", "Y", 1, "10.9912/b", "A sentence that is nowhere.")]
    spark.createDataFrame(edges, "network string, edge_key long, source string, target string, sign int, doi string, evidence string").write.parquet(f"{tmp_path}/network_edges.parquet")
    spark.createDataFrame([(1, "10.9912/a", None), (2, "doi:10.9912/A", "Other words. " + seen), (3, "10.9912/b", "")], "paper_key long, doi string, abstract string").write.parquet(f"{tmp_path}/papers.parquet")
    spark.createDataFrame([(1, "10.9912/a", "Nothing of it."), (2, "10.9912/a", "EF3 represses GH4 in the roots.")], "fulltext_key long, doi string, text string").write.parquet(f"{tmp_path}/fulltext.parquet")
    spark.createDataFrame([("n", 1, "Genus one")], "network string, master_key long, species string").write.parquet(f"{tmp_path}/master_test_level.parquet")
    spark.createDataFrame([(1, "n", "PH1", "P", None, False, None)], "node_key long, network string, node_id string, node_type string, full_name string, is_source boolean, deleted_at timestamp").write.parquet(f"{tmp_path}/network_nodes.parquet")
    spark.createDataFrame([(7, "n", "AB1", "up", None)], "pert_key long, network string, gene string, expected_direction string, doi string").write.parquet(f"{tmp_path}/reconciled_perturbations.parquet")
    d = str(tmp_path)
    assert {r.edge_key: (r.start, r.locator) for r in Q.str5_located_quotes(spark, d).collect()} == {1: (13, "abstract"), 2: (0, "full_text"), 3: (None, None)}
    assert {r.edge_key: (r.score, r.pos) for r in Q.str17_best_sentence(spark, d).collect()}[1] == (1.0, 1)
    assert {r.claim: (r.status, r.part) for r in Q.evd3_resolved_claims(spark, d).collect()} == {"edge:1": ("verified", "abstract"), "edge:2": ("verified", "full_text"), "edge:3": ("quarantine", None), "test:7": ("quarantine", None)}


def test_ladder_primary_paper_and_second_pass(spark):
    s = "GA3 promotes Stem_Girth in the shoot of Poluna alba."
    papers = spark.createDataFrame(
        [
            ("own", 2020, "GA3 binds stem girth loosely.", "## Results\nGA3 promotes stem girth in Poluna.\n"), ("new", 2019, s, None), ("old", 2001, s.replace("_", " "), None), ("intro", 1990, None, "## Introduction\nGA3 promotes stem girth.\n"),
            ("deep", 2005, "Nothing here.", "## Background\nQR7 represses OLO6.\n\n## Results\nWe saw that QR7 represses OLO6."),
        ], "doi string, year int, abstract string, fulltext string",
    )
    claims = spark.createDataFrame([(1, "GA3", "Stem_Girth", 1, "own", "Poluna alba"), (2, "GA3", "Stem_Girth", 1, "gone", "Poluna alba"), (3, "QR7", "OLO6", -1, None, None), (4, "QR7", "OLO6", None, "", None), (5, "ZZ9", "OLO6", 1, "old", "x")], CLAIM + ", species string")
    got = {r.claim: r for r in E.resolve(claims, papers).collect()}
    assert (got[1].status, got[1].doi, got[1].part, got[1].score) == ("verified", "own", "abstract", round(0.60 + 0.04 + 0.05, 2))  # the abstract is asked first
    assert (got[2].status, got[2].doi, got[2].n_supports, got[2].searched) == ("repaired", "old", 3, 1)  # of three abstracts the oldest
    assert (got[3].status, got[3].doi, got[3].section, got[3].searched) == ("repaired", "deep", "Results", 2) and got[3].score == round(0.50 + 0.20 + 0.05, 2)
    assert got[4].status == "repaired" and got[5].status == "quarantine"
    strict = {r.claim: r.status for r in E.resolve(claims, papers, min_supports=2).collect()}
    assert strict == {1: "verified", 2: "repaired", 3: "quarantine", 4: "quarantine", 5: "quarantine"}
    assert {r.claim for r in E.resolve(claims, papers, second_pass=False).where("status = 'quarantine'").collect()} == {3, 4, 5}
    tried = {r.claim: [tuple(x) for x in r.tried] for r in E.trail(E.resolve(claims, papers), claims).collect()}
    assert tried[1] == [("by_doi", "grounded")] and tried[3] == [("by_doi", "miss"), ("search", "miss"), ("retry", "full_text"), ("search", "grounded")] and tried[5][0] == ("by_doi", "ungrounded")
    assert E.resolve(claims.limit(0), papers).count() == 0 and E.resolve(claims, papers.limit(0)).where("status = 'quarantine'").count() == 5


def test_full_names_of_nodes_are_spellings_in_any_letter_case(spark):
    papers = spark.createDataFrame([("p", "Epidermal patterning factor two lowers conductance (gs) in leaves.", None)], PAPER)
    nodes = spark.createDataFrame([("ZmEPF2", "Epidermal patterning factor two"), ("Stomatal_Conductance", "Stomatal conductance (gs)"), (None, "x")], "id string, full_name string")
    claims = spark.createDataFrame([(1, "ZMEPF2", "stomatal_conductance", -1, "p")], CLAIM)
    assert E.resolve(claims, papers).first().status == "quarantine" and E.resolve(claims, papers, nodes).first().status == "verified"


def test_second_hand_sections_cost_points(spark):
    papers = spark.createDataFrame([("p", None, "## Introduction\nAB1 promotes CD2 fast.\n\n## Results\nAB1 and CD2 were seen.")], PAPER)
    claims = spark.createDataFrame([(1, "AB1", "CD2", 1, "p")], CLAIM)
    best = E.resolve(claims, papers).first()
    assert (best.sentence, best.section, best.score) == ("AB1 promotes CD2 fast.", "Introduction", 0.57)


def test_pairs_that_the_texts_do_not_tell_apart_are_searched_once(spark, monkeypatch):
    rows, staged = {}, E.staged

    def counted(df, name, *more):
        out = staged(df, name, *more)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(E, "staged", counted)
    papers = spark.createDataFrame([("p1", 2001, "Petiole length and hypocotyl width rose.", None), ("p2", 1999, "The width follows the length.", None), ("", 1990, "Length and width.", None)], "doi string, year int, abstract string, fulltext string")
    claims = spark.createDataFrame([(i, f"Xq{i}zz_Length", f"Yq{i}zz_hypocotyl", 0, None if i else "p9") for i in range(20)] + [(90, "Xq1zz_Length", "Wq_petiole", 0, "p2"), (91, "nowhere9", "Xq1zz_Length", 0, "p1")], CLAIM)
    got = {r.claim: (r.status, r.doi, r.n_supports) for r in E.resolve(claims, papers).collect()}
    assert got == {i: ("repaired", "p1", 1) for i in range(20)} | {90: ("repaired", "p1", 1), 91: ("quarantine", None, 0)}
    assert rows["supports"][0] == 2  # of 21 pairs of names


def test_a_paper_without_doi_is_no_repair_of_a_claim_without_one(spark):
    papers = spark.createDataFrame([("p1", 2001, "AB1 binds CD2.", None), ("p2", 1999, "AB1 meets CD2.", None), ("", 1990, "AB1 and CD2.", None)], "doi string, year int, abstract string, fulltext string")
    claims = spark.createDataFrame([(1, "AB1", "CD2", 0, None), (2, "AB1", "CD2", 0, "p9"), (3, "AB1", "CD2", 0, "")], CLAIM)
    assert {r.claim: (r.doi, r.n_supports) for r in E.resolve(claims, papers).collect()} == {1: ("p2", 2), 2: ("", 3), 3: ("p2", 2)}


def test_hits_are_shuffled_by_their_pair_only_and_without_words(spark, monkeypatch):
    plans, staged = {}, E.staged

    def seen(df, name, *more):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, name, *more)

    monkeypatch.setattr(E, "staged", seen)
    papers = spark.createDataFrame([("p1", "AB1 binds CD2.", None), ("p2", "AB1 meets CD2. EF3 is met.", "AB1 and EF3.")], PAPER)
    claims = spark.createDataFrame([(1, "AB1", "CD2", 0, "p9"), (2, "AB1", "CD2", 0, "p1"), (3, "AB1", "EF3", 0, None)], CLAIM)
    got = {r.claim: (r.status, r.doi, r.searched) for r in E.resolve(claims, papers).collect()}
    assert got == {1: ("repaired", "p1", 1), 2: ("verified", "p1", 0), 3: ("repaired", "p2", 2)}
    late = [p for name in ("verified", "supports", "repaired") for p in plans[name]]
    assert len(late) == 5 and not [p for p in late if re.search(r"\b(sentence|plain)#|hashpartitioning\(sid#", p)]


@pytest.mark.parametrize("few", [0, 100])
def test_one_word_spellings_meet_their_plural_and_no_longer_word(spark, monkeypatch, few):
    monkeypatch.setattr(E, "FEW", few, raising=False)
    papers = spark.createDataFrame([("p1", "Kinins and kinin lower ABCs.", None), ("p2", "Kininss lower ABC.", None), ("p3", "KRPs lower kinin-ABC.", None), ("p4", "The KRPS1 line (kinin).", None)], PAPER)
    claims = spark.createDataFrame([(1, "Kinin", "ABC", 0, "p1"), (2, "Kinin", "ABC", 0, "p2"), (3, "Kinin", "ABC", 0, "p3"), (4, "KRPS", "Kinin", 0, "p3"), (5, "KRPS1", "Kinin", 0, "p4"), (6, "KRPS", "Kinin", 0, "p4")], CLAIM)
    got = {r.claim: (r.status, r.doi, r.n_supports) for r in E.resolve(claims, papers).collect()}
    assert got == {1: ("repaired", "p3", 1), 2: ("repaired", "p3", 1), 3: ("verified", "p3", 1), 4: ("verified", "p3", 1), 5: ("verified", "p4", 1), 6: ("repaired", "p3", 1)}


def test_settled_claims_hold_their_paper_on_record_and_keys_only(spark):
    papers = spark.createDataFrame([("p1", "AB1 binds CD2.", None), ("p2", "EF3 is met.", "AB1 and EF3.")], PAPER)
    claims = spark.createDataFrame([(1, "AB1", "CD2", 0, "p1"), (2, "AB1", "EF3", 0, None), (3, "AB1", "GH4", 0, "p2")], CLAIM)
    every, _ = E.settled(claims, papers)
    assert "sentence" not in every.columns and {r.claim: (r.on_record, r.doi) for r in every.collect()} == {1: ("p1", "p1"), 2: (None, "p2"), 3: ("p2", None)}
    assert {tuple(r.claim for r in E.trail(every).where("size(tried) = %d" % n).collect()) for n in (1, 4)} >= {(1,)}
