import random

from hypothesis import given
from hypothesis import strategies as st

from sprigwork.llm import duplicates as D


def canon(*fields, dois=(), parts=(0,)):
    return D.canonical(list(fields), frozenset(dois), frozenset(parts))


def test_fields_agree_whatever_their_form():
    a = '{"sentence": "Loss of AB1 (n = 3)", "locator": "Fig. 1"}'
    b = '{\n "Locator": "fig 1", "Sentence": "LOSS OF AB1 (n=3)."}'
    c = "locator: Fig. 1 || sentence:  Loss of AB1, n = 3"
    assert canon(a) == canon(b) == canon(c) != canon('{"sentence": "Loss of AB1 (n = 4)", "locator": "Fig. 1"}')
    assert canon(None) == canon("") == canon(" ") and canon("{broken") == canon("broken")
    assert canon("DOI: 10.99012/X.1", dois=(0,)) == canon("https://doi.org/10.99012/x.1.", dois=(0,)) != canon("10.99012/x1", dois=(0,))


@given(st.lists(st.binary(max_size=12), max_size=300))
def test_trie_counts_like_a_dictionary(keys):
    trie, burst = D.BurstTrie(), D.BURST
    D.BURST = 4
    try:
        want = {}
        for i, k in enumerate(keys):
            trie.add(k, 1, 100 - i)
            n, kept = want.get(k, (0, 10**9))
            want[k] = (n + 1, min(kept, 100 - i))
        assert {k: (n, kept) for k, n, kept in trie.terminals()} == want
    finally:
        D.BURST = burst


def test_pairs_equal_brute_force_with_hot_text_and_deep_splits(spark):
    rng = random.Random(1)
    rows = [(i, "same prefix " * 5 + rng.choice(["hot", "hot", f"t{rng.randrange(60)}"]) + rng.choice(["", ".", " "]), rng.choice(["10.9912/a", "doi:10.9912/A", None]), "x") for i in range(1, 600)]
    rows += [(None, "no key", "10.9912/a", "x"), (900, "blank", "  ", "x")]
    df = spark.createDataFrame(rows, "k long, title string, doi string, canon string")
    entries = D.combined(df, "t", "k", ("title", "doi"), ("doi",), "doi")
    groups = {}
    for k, t, d, _ in rows:
        if k is not None and d and d.strip():
            groups.setdefault(canon(t, d, dois=(1,), parts=(0,)), []).append(k)
    want = {("t", min(g), k) for g in groups.values() for k in g if k != min(g)}
    for limit in (1_000_000, 7):
        assert {tuple(r) for r in D.pairs(entries, limit).collect()} == want
    counted = {bytes(r.canon): r.n for r in D.count_copies(entries, 7).collect()}
    assert counted == {k: len(v) for k, v in groups.items()}
    assert D.pairs(entries.limit(0)).count() == 0


def test_edges_and_parts_that_differ_in_a_minus_or_a_point_are_no_copies(spark):
    rows = [(1, "A", "B", 1, "seen"), (2, "a", "b", -1, "Seen."), (3, "A", "B", -1, "seen"), (4, "A", "B", None, "seen")]
    df = spark.createDataFrame(rows, "k long, source string, target string, sign int, evidence string")
    entries = D.combined(df, "t", "k", ("source", "target", "sign", "evidence"), (), "evidence")
    assert {tuple(r) for r in D.pairs(entries).collect()} == {("t", 2, 3)}
    assert canon('{"effect": -1}') == canon('{"Effect" : "-1"}') == canon('{"effect": -1.0}') != canon('{"effect": 1}')
    assert canon('{"pv": 0.5, "nn": 12}') == canon("pv: 0.50 || nn: 12.") != canon('{"pv": 5, "nn": 12}') and canon('{"p": 1e-3}') == canon('{"p": 0.001}') != canon('{"p": 1.5}') != canon('{"p": 15}')
