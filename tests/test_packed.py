from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sprigwork.operators import packed as P


def names(text, numbered=False):
    return [v for run in P.runs(text, numbered) for v in (P.certain(run) if P.certain(run) is not None else P.viterbi(run, {}, 1.0))]


@pytest.mark.parametrize(
    ("text", "numbered", "want"),
    [
        ("A1; B2|C3,D4", False, ["A1", "B2", "C3", "D4"]), ("A1 and B2", False, ["A1", "B2"]), ("A1, and  B2 ", False, ["A1", "B2"]),
        ('"N, P and K status"; X_y', False, ["N, P and K status", "X_y"]), ("Dorinase-P5'x & 'GA-20 pool'", False, ["Dorinase-P5'x", "GA-20 pool"]),
        ('"so-called ""Factor Z"""', False, ['so-called "Factor Z"']), ('["A", "B \\"q\\""]', False, ["A", 'B "q"']), ("['A']", False, ["A"]), ("[]", False, []), (" ; ,", False, []),
        ("Velotin/Marosin|KRT1.2", False, ["Velotin/Marosin", "KRT1.2"]), ("A=1,0; 'B c' = 0,5", True, ["A", "B c"]), ('"A=0.5"', True, ["A"]), ('{"A": 0.0, "B c": 2}', True, ["A", "B c"]),
        ("A=1,B=2", True, ["A", "B"]), ("A:0.1 and B:2", True, ["A", "B"]), ('"1,3-norvalactone": 0.997, B: 1', True, ["1,3-norvalactone", "B"]), ('"open', False, ['"open']),
    ],
)
def test_shapes(text, numbered, want):
    assert names(text, numbered) == want
    quick = P.easy(text, numbered)
    assert quick is None or quick == want


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("AB10 ;,|&=:.'\"[]-+_")), max_size=30), st.booleans())
def test_quick_reading_equals_the_parser(text, numbered):
    quick = P.easy(text, numbered)
    if quick is not None:
        parsed = P.runs(text, numbered)
        assert all(P.certain(run) is not None for run in parsed) and quick == [v for run in parsed for v in P.certain(run)]


def test_learned_value_keeps_its_blank_and_others_split():
    run = [("GA-20", False), ("pool", False)]
    assert P.viterbi(run, {"GA-20 pool": 50.0}, 100.0) == ["GA-20 pool"]
    assert P.viterbi(run, {"GA-20": 9.0, "pool": 9.0}, 100.0) == ["GA-20", "pool"]


def test_expectation_equals_brute_force():
    run, counts, total = [("A", False), ("and", False), ("B", False), ("C", False)], {"A": 3.0, "B C": 2.0, "B": 1.0}, 10.0
    lattice, n = P.arcs(run), len(run)

    def paths(i):
        if i == n:
            yield [], 1.0
        for a, b, v in lattice:
            if a == i:
                for rest, w in paths(b):
                    yield [v, *rest], w * P.weight(v, b - a, counts.get(v or "", 0.0), total)

    every = list(paths(0))
    mass, want = sum(w for _, w in every), Counter()
    for vs, w in every:
        for v in vs:
            if v is not None:
                want[v] += w / mass
    got = P.expected(run, counts, total)
    assert all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_frame(spark):
    cells = spark.createDataFrame([("t", "f", 1, "A; B", False), ("t", "f", 2, "A; B", False), ("t", "f", 3, None, False), ("t", "f", 4, "", False), ("t", "g", 5, "A and B; 'x y'", False)], "tab string, field string, row_key long, txt string, numbered boolean")
    got = sorted(tuple(r) for r in P.unpack(cells).collect())
    assert got == [("t", "f", 1, 0, "A"), ("t", "f", 1, 1, "B"), ("t", "f", 2, 0, "A"), ("t", "f", 2, 1, "B"), ("t", "g", 5, 0, "A"), ("t", "g", 5, 1, "B"), ("t", "g", 5, 2, "x y")]
    assert P.unpack(cells.limit(0)).count() == 0


def test_names_of_middling_frequency_split_at_connectors_in_a_large_column(spark):
    rows = [(f"N{i % 500};M{i % 499}",) for i in range(25_000)] + [(f"N{i} and M{i} and N{i + 1}",) for i in range(300)] + [("'N1 and M1'",)] * 40 + [("'N2 x'; N2",)] * 40 + [("N2 x",)]
    cells = spark.createDataFrame([("t", "f", i, x, False) for i, (x,) in enumerate(rows)], "tab string, field string, row_key long, txt string, numbered boolean")
    got = P.unpack(cells).where("row_key >= 25000").orderBy("row_key", "pos").collect()
    want = [v for i in range(300) for v in (f"N{i}", f"M{i}", f"N{i + 1}")] + ["N1 and M1"] * 40 + ["N2 x", "N2"] * 40 + ["N2 x"]
    assert [r.val for r in got] == want


def test_long_values_are_kept_whole_and_each_column_has_its_own_counts(spark):
    long = "one two three four five six"
    rows = [("t", "f", i, f'"{long}"') for i in range(30)] + [("t", "f", 100, f"X; {long}"), ("t", "g", 200, f"X; {long}")]
    cells = spark.createDataFrame([(*r, False) for r in rows], "tab string, field string, row_key long, txt string, numbered boolean")
    got = {}
    for r in P.unpack(cells).where("row_key >= 100").orderBy("row_key", "pos").collect():
        got.setdefault(r.row_key, []).append(r.val)
    assert got == {100: ["X", long], 200: ["X", *long.split()]}
