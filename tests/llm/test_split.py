from hypothesis import given, settings
from hypothesis import strategies as st

from sprigwork.llm import split as S

TEXT = st.text(alphabet=st.sampled_from(list("ab .!?\n\t#é A")), max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 60), st.integers(0, 40))
def test_nothing_lost_and_never_too_long(text, limit, overlap):
    pieces = S.split(text, limit, overlap)
    if not text:
        assert pieces == []
        return
    assert pieces[0][1] == 0 and pieces[-1][2] == len(text) and all(a[2] == b[1] for a, b in zip(pieces, pieces[1:]))
    assert all(0 < end - start <= limit and start <= core for start, core, end, _ in pieces)
    assert (len(pieces) > 1) == (len(text) > limit)
    if len(text) > limit:
        assert any(hard for *_, hard in pieces) == (S.longest_run(text) > limit)


def test_highest_boundary_is_taken():
    text = "# One\n\nFirst part. Still first.\n\n# Two\n\nSecond part. Still second.\n"
    cores = [text[c:e] for _, c, e, _ in S.split(text, 40)]
    assert cores[0].startswith("# One") and cores[1].startswith("# Two")


def test_lists_markup_and_fences():
    items = "Intro text.\n" + "".join(f"- item {i} has some words.\n  and a second line.\n" for i in range(8))
    assert all(items[c:].startswith("- item") for _, c, _, _ in S.split(items, 80)[1:])
    html = "".join(f"<p>Paragraph{i}.</p>" for i in range(10))
    pieces = S.split(html, 40)
    assert all(html[c:].startswith("<p>") for _, c, _, _ in pieces) and not any(hard for *_, hard in pieces)
    fenced = "# A\n\n```\n# no heading\n```\n\nText one here.\n\n# B\n\nText two here."
    assert [fenced[c:e][:3] for _, c, e, _ in S.split(fenced, 48)] == ["# A", "# B"]


def test_overlap_is_shared():
    text = " ".join(f"word{i}." for i in range(200))
    pieces = S.split(text, 120, 30)
    assert all(15 <= core - start <= 30 for start, core, _, _ in pieces[1:])


def test_frame(spark):
    texts = spark.createDataFrame([(1, "a", "x" * 25), (2, "a", None), (3, "a", ""), (4, "zz", "y" * 99), (5, None, "q"), (6, "a", "ab " * 9)], "fulltext_key long, source string, text string")
    limits = spark.createDataFrame([("a", 10, 2)], "source string, max_chars int, overlap_chars int")
    got = {(r.fulltext_key, r.piece): r.piece_text for r in S.pieces(texts, limits).collect()}
    assert got[4, 0] == "y" * 99 and got[5, 0] == "q" and not {2, 3} & {k for k, _ in got}
    assert S.pieces(texts.limit(0), limits).count() == 0
    wide = spark.createDataFrame([("a", 10, 8)], "source string, max_chars int, overlap_chars int")
    assert {r.overlap_held for r in S.pieces(texts, wide).where("fulltext_key in (1, 6)").collect()} == {True} and not any(r.overlap_held for r in S.pieces(texts, limits).collect())
