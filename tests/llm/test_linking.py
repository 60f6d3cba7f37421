import random

import pytest

from sprigwork.llm import linking as L

KB = [(1, "RNT3", "gene", "Zefubozar binding kinase", ["EUFG2"]), (2, "RNT4", "gene", None, []), (3, "Pagelstimlu_beta", "metabolite", None, None), (4, "Stonglosmu_Complex", "complex", None, []), (5, "Kurz", "process", None, [])]
CASES = {
    "RNT3": "RNT3", "rnt-3": "RNT3", "Rnt 3.": "RNT3", "AtRNT3": "RNT3", "35S::RNT3": "RNT3", "pro35S:RNT3": "RNT3", "RNT3-OE": "RNT3", "RNT3ox": "RNT3", "Δrnt3": "RNT3", "rnt3-102": "RNT3", "rnt3 null allele": "RNT3",
    "gene RNT3": "RNT3", "'RNT3'": "RNT3", "[RNT4]": "RNT4", "eufg2": "RNT3", "RNT3 (Zefubozar binding kinase)": "RNT3", "ZEFUBOZAR-BINDING-KINASE": "RNT3", "Zefubosar bindng kinase": None, "Zefbozzar binding kinase": "RNT3",
    "pagelstimluβ": "Pagelstimlu_beta", "pgelstmlu beta": "Pagelstimlu_beta", "STONGLOSMUCOMPLEX": "Stonglosmu_Complex", "Stonlgosmu Complex": "Stonglosmu_Complex", "RNT5": None, "RNZ3": None, "Kurx": None, "?": None, "see note": None, "x" * 5000: None,
}


def test_readings_match_or_not(spark):
    kb = spark.createDataFrame(KB, "kb_id long, kb_node string, kind string, full_name string, synonyms array<string>")
    raws = spark.createDataFrame([(x,) for x in CASES], "raw string")
    for rows in (2_000_000, 0):  # vocabulary broadcast, and shuffled
        got = {r.raw: r.kb_node for r in L.link(raws, kb, rows).collect()}
        assert {x: got.get(x) for x in CASES} == CASES
    assert L.link(raws, kb.limit(0)).count() == 0 and L.link(raws.limit(0), kb).count() == 0


@pytest.mark.parametrize(("a", "b", "d"), [("abcdef", "abcdef", 0), ("abcdef", "abdcef", 1), ("abcdef", "bcdef", 1), ("abcdef", "abcxyf", 2), ("abcdef", "uvwxyz", 3), ("", "ab", 2), ("a", "abcd", 3)])
def test_distance(a, b, d):
    assert L.distance(a, b) == d


def test_distance_equals_the_full_table():
    def full(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(9)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 8)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 8)))
        assert L.distance(a, b) == min(full(a, b), 3)


def test_soft_tfidf_needs_complete_cover():
    assert L.soft_tfidf([{"a": 0}], ["a", "b"], [1.0, 1.0]) is None and L.soft_tfidf([{"a": 0}, {"a": 0}], ["a", "b"], [1.0, 1.0]) is None
    exact, near = L.soft_tfidf([{"a": 0}, {"b": 0}], ["b", "a"], [1.0, 2.0]), L.soft_tfidf([{"a": 1}, {"b": 0}], ["b", "a"], [1.0, 2.0])
    assert exact == (1.0, 0) and near[0] < 1 and near[1] == 1


def test_score_ranks_complete_entries(spark):
    kb = spark.createDataFrame([(1, "Stonglosmat", "process", None, None), (2, "Stonglosmut", "process", None, None)], "kb_id long, kb_node string, kind string, full_name string, synonyms array<string>")
    raws = spark.createDataFrame([("stonglosmut",), ("mutant stonglosmut",), ("Stonglosmot",)], "raw string")
    got = {r.raw: r.kb_node for r in L.link(raws, kb).collect()}
    # Notation costs less than an edit; of two entries equally far the smaller kb_id is taken.
    assert got == {"stonglosmut": "Stonglosmut", "mutant stonglosmut": "Stonglosmut", "Stonglosmot": "Stonglosmat"}


def test_notation_of_any_depth_is_taken_off():
    assert "RNT3" in [text for _, text in L.strippings("gene gene gene gene gene gene gene mutant 35S::RNT3 null lines lines lines lines")]


def _misspelt(word: str, edits: int, seed: int) -> str:
    rng = random.Random(seed)
    out = list(word)
    for _ in range(edits):
        i, kind = rng.randrange(1, len(out) - 1), rng.randrange(4)
        if kind == 0:
            del out[i]
        elif kind == 1:
            out.insert(i, rng.choice("bdfgk"))
        elif kind == 2:
            out[i] = rng.choice("bdfgk")
        else:
            out[i], out[i - 1] = out[i - 1], out[i]
    made = "".join(out)
    return made if L.distance(made, word) == edits else _misspelt(word, edits, seed + 1000)


def test_words_within_two_edits_share_a_variant():
    rng = random.Random(3)
    for seed in range(3000):
        word = "".join(rng.choice("abdeiklmnorst") for _ in range(rng.randrange(9, 20)))
        assert L.variants(word) & L.variants(_misspelt(word, 1 + seed % 2, seed))


def test_recall_by_kind_of_error(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n))
    symbols = [f"{''.join(rng.choice('BCDFGKLMNPRTVZ') for _ in range(3))}{k % 9 + 1}" for k in range(40)]
    kb = [(k, s, "gene", f"{word(6)} {word(5)} kinase", [word(7)]) for k, s in enumerate(dict.fromkeys(symbols))]
    kinds = {
        "canonical": lambda e, k: e[1], "case": lambda e, k: e[1].lower(), "separator": lambda e, k: f"{e[1][:3]}-{e[1][3:]}", "full name": lambda e, k: e[3].upper(), "glued": lambda e, k: e[3].replace(" ", "_"),
        "synonym": lambda e, k: e[4][0], "species": lambda e, k: f"At{e[1]}", "mutant": lambda e, k: f"{e[1].lower()}-{k + 1} mutant", "construct": lambda e, k: f"35S::{e[1]}", "both names": lambda e, k: f"{e[1]} ({e[3]})",
        "one edit": lambda e, k: _misspelt(e[4][0], 1, k), "two edits": lambda e, k: _misspelt(e[4][0], 2, k), "edit in a phrase": lambda e, k: f"{_misspelt(e[3].split()[0], 1, k)} {e[3].split()[1]} kinase",
        "other symbol": lambda e, k: f"{e[1][:3]}{int(e[1][3:]) + 10}", "placeholder": lambda e, k: ("unknown", "n/a", "-", "?")[k % 4],
    }
    want = {}
    for kind, make in kinds.items():
        for k, e in enumerate(kb):
            want.setdefault(make(e, k), (kind, None if kind in ("other symbol", "placeholder") else e[1]))
    got = {r.raw: r.kb_node for r in L.link(spark.createDataFrame([(x,) for x in want], "raw string"), spark.createDataFrame(kb, "kb_id long, kb_node string, kind string, full_name string, synonyms array<string>")).collect()}
    right = {kind: [got.get(x) == node for x, (k, node) in want.items() if k == kind] for kind in kinds}
    assert {kind: sum(x) / len(x) for kind, x in right.items()} == {kind: 1.0 for kind in kinds}
