import random

from sprigwork.operators import references as R

PARENT, REF = "key string, since long, until long", "key string, at long, tab string, ref_field string, row_key long"


def brute(parents, refs):
    out = set()
    for key, at, tab, field, row in refs:
        if not any(k is not None and key == k and s is not None and at is not None and s <= at and (u is None or at < u) for k, s, u in parents):
            out.add((tab, field, row))
    return out


def check(spark, parents, refs, partitions=5):
    got = R.orphans(spark.createDataFrame(parents, PARENT), spark.createDataFrame(refs, REF), partitions)
    rows = [(r.tab, r.ref_field, r.row_key) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(parents, refs)


def test_random_with_a_hot_key_in_several_ranges(spark):
    rng = random.Random(3)
    key = lambda: "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}"
    parents = [(key(), s := rng.randrange(1000), rng.choice([None, s + rng.randrange(1, 200)])) for _ in range(300)]
    parents = [p for p in parents if p[0] != "k3"] + [("hot2", 5, 6)] * 50
    refs = [(key(), rng.randrange(1000), "t", "f", i) for i in range(900)]
    check(spark, parents, refs, 7)


def test_long_life_from_an_earlier_range(spark):
    parents = [("h", 1, 10_000)] + [("h", t, t + 1) for t in range(2, 400)]
    check(spark, parents, [("h", t, "t", "f", t) for t in range(0, 1000)] + [("h", 20_000, "t", "f", 5000)], 8)


def test_nulls_empty_and_repeats(spark):
    parents = [(None, 1, None), ("a", None, None), ("a", 5, None), ("a", 5, None), ("é ", 1, 3)]
    refs = [(None, 9, "t", "f", 1), ("a", None, "t", "f", 2), ("a", 4, "t", "f", 3), ("a", 5, "t", "f", 4), ("é ", 2, "t", "f", 5), ("é ", 3, "t", "f", 6)]
    check(spark, parents, refs)
    check(spark, [], refs)
    assert R.orphans(spark.createDataFrame(parents, PARENT), spark.createDataFrame([], REF)).count() == 0
