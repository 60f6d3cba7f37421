from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sprigwork.llm import mixing, packing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 30))
def test_fullest_equals_brute_force(counts, room):
    best = max((s for n in product(*[range(c + 1) for c in counts.values()]) if (s := sum(a * b for a, b in zip(counts, n))) <= room), default=0)
    got = packing.fullest(sorted(counts, reverse=True), counts, room)
    assert sum(k * n for k, n in got.items()) == best and all(n <= counts[k] for k, n in got.items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=8), st.integers(20, 40))
def test_patterns_use_every_item_once(counts, capacity):
    used = {}
    for own, times in packing.patterns(counts, capacity):
        assert times > 0 and sum(k * n for k, n in own.items()) <= capacity
        for k, n in own.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts


def test_packed_frame(spark):
    tokens = spark.createDataFrame([(i, n) for i, n in enumerate([7, 3, 5, 5, 10, 25, 0, 1] * 9)], "doc_id long, n_tokens long")
    profiles = spark.createDataFrame([("s", 10), ("l", 100), (None, None)], "profile string, capacity_tokens int")
    rows = packing.pack(tokens, profiles).collect()
    for name, cap in (("s", 10), ("l", 100)):
        mine = [r for r in rows if r.profile == name]
        fill, docs = {}, {}
        for r in mine:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
            docs[r.doc_id] = docs.get(r.doc_id, 0) + r.n_tokens
        assert max(fill.values()) <= cap and docs == {r.doc_id: r.n_tokens for r in tokens.collect()}
        total = sum(docs.values())
        assert len(fill) <= -(-total // cap) + 1
    assert packing.pack(tokens.limit(0), profiles).count() == 0


def corpus(spark):
    rows = [(i, f"alpha beta gamma word{i % 7} " * (1 + i % 5), "a") for i in range(300)] + [(1000 + i, "delta epsilon zeta " * 3, "b") for i in range(40)]
    rows += [(2000 + i, "delta epsilon zeta", None) for i in range(10)] + [(3000, None, "a"), (3001, "", None), (3002, "other words", "unlisted")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixture_reaches_shares_and_limits(spark):
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 4), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(corpus(spark), targets)
    rows = chosen.collect()
    assert all(0 < r.repeats <= {"a": 1, "b": 4, None: 4}[r.source] for r in rows) and not {3000, 3001, 3002} & {r.doc_id for r in rows}
    got = {r.source: r for r in shares.collect()}
    assert got["none"].tokens == 0 and abs(got["a"].share_of_size - 0.6) < 0.03 and abs(got["b"].share_of_size - 0.3) < 0.03
    assert mixing.mix(corpus(spark).limit(0), targets)[0].count() == 0


def test_rates_are_least_squares_with_limits():
    member, cap = np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]]), np.array([1, 2, 1])
    steps = [np.array([-0.5, -3.0]), np.array([0.1, 0.0])]
    assert np.allclose(mixing.replay(member, cap, steps), [0.4, 2.0, 0.95])


def test_posteriors_follow_the_words(spark):
    docs, sources = corpus(spark), ["a", "b"]
    members = {r.doc_id: r.member for r in mixing.memberships(docs, [("a", 0.5, 1), ("b", 0.5, 2)]).collect()}
    assert members[0] == [1.0, 0.0] and members[2000][1] > 0.8 and members[3002] == [0.0, 0.0] and len(sources) == 2


def test_a_source_without_documents_takes_no_unlabelled_text(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma", "a") for i in range(50)] + [(100, " ".join(f"unseen{chr(97 + i)}" for i in range(20)), None)], "doc_id long, text string, source string")
    members = {r.doc_id: r.member for r in mixing.memberships(docs, [("a", 0.5, 1), ("empty", 0.5, 2)]).collect()}
    assert members[100] == [1.0, 0.0]
    only_empty = mixing.memberships(docs, [("empty", 1.0, 2)]).where("doc_id = 100").first()
    assert only_empty.member == [0.0] and only_empty.cap == 0


def test_rates_are_the_same_summed_here_or_by_the_executors(spark):
    rows = [([1.0, 0.0, 0.0], 1, 500), ([0.0, 1.0, 0.0], 3, 80), ([0.2, 0.5, 0.3], 2, 60), ([0.0, 0.0, 1.0], 4, 30)]
    groups = spark.createDataFrame(rows, "member array<double>, cap int, tokens bigint")
    share = np.array([0.5, 0.3, 0.2])
    here, there = mixing.fit_rates(groups, share, None, rounds=30), mixing.fit_rates(groups, share, None, rounds=30, local=0)
    assert here[1] == there[1] and len(here[0]) == len(there[0]) and all(np.allclose(a, b) for a, b in zip(here[0], there[0]))


def test_report_says_whether_the_shares_are_reached(spark):
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 4)], "source string, target_share double, max_repeats int")
    reached = mixing.mix(corpus(spark), targets)[1].collect()
    missed = mixing.mix(corpus(spark), targets, size=1e6)[1].collect()
    assert all(r.converged and r.residual <= mixing.CLOSE for r in reached) and not any(r.converged for r in missed)
