import numpy as np
import pytest

from sprigwork.llm import abuse as A


@pytest.mark.parametrize(
    ("raw", "want"),
    [("You 1d10t, get l0$t", "idiot"), ("a d i m w i t wrote it", "dimwit"), ("this m.o.r.o.n again", "moron"), ("so sttttupid", "stupid"), ("their na\u200bked bodies", "naked"), ("stuр\u0456d", "stupid"), ("d****t", "dimwit"), ("7h13v3$", "thieves"), ("blöd", "blod"), ("you b!tch", "bitch"), ("IDIOT5 all", "idiots")],
)
def test_disguises_are_undone(raw, want):
    assert want in A.plain(A.masked(raw)).split()


def test_names_and_numbers_become_one_sign():
    assert A.plain(A.masked("TFD3 binds Stem_Girth at 28 degrees (n = 4.5)")) == "0 binds 0 at 0 degrees n 0"


def test_long_passages_are_cut_into_overlapping_windows():
    words = [f"w{i}" for i in range(100)]
    got = A.passages(" ".join(words))
    assert all(len(p.split()) <= A.WINDOW for p in got) and set(" ".join(got).split()) == set(words)
    assert A.passages(None) == A.passages("  ") == []


ABUSE = ["You are a moron and everyone in this lab knows it.", "Foreigners belong in a cage and not in a lab.", "I will break your fingers, idiot.", "Send me nudes tonight, I want to see you naked.", "Du bist ein dummer Idiot.", "Qué gilipollas, vete a la mierda."]
HARMLESS = ["The naked barley rows were harvested by hand.", "That script is awful to use, yet the numbers hold.", "Please keep to the code of conduct: abusive or hateful language is removed by moderators.", "I hate to ask again, but could someone check the sign?", "A suicide gene was used to kill escaped cells.", "Die Kante hat ein positives Vorzeichen."]


def test_voters_take_sides():
    for text in ABUSE:
        assert any(v > 0 for v in A.votes(A.plain(text))), text
    for text in HARMLESS:  # a harsh word in a harmless use has a voter on the other side too
        votes = A.votes(A.plain(text))
        assert not any(v > 0 for v in votes) or any(v < 0 for v in votes), text


def test_label_model_settles_contradictions_and_sees_a_copied_voter():
    rng = np.random.default_rng(0)
    y = rng.random(40_000) < 0.05

    def voter(hit, false):
        return np.where(y, rng.random(len(y)) < hit, rng.random(len(y)) < false).astype(int)

    a, b, c, harmless = voter(0.8, 0.004), voter(0.7, 0.003), voter(0.6, 0.001), -voter(0.01, 0.9)
    votes = np.stack([a, a, b, c, harmless], 1)  # the first voter stands twice
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = A.LabelModel(5).fit(patterns, counts.astype(float))
    assert model.parent[1] == 0 or model.parent[0] == 1
    post = model.posterior(votes)
    plain_rule = (votes > 0).any(1)
    assert np.mean((post > 0.5) == y) > max(0.985, np.mean(plain_rule == y))


def _corpus(spark):
    rows = [(i, f"Plants were sampled at dawn in week {i}. {HARMLESS[i % 6]}", "forum") for i in range(60)]
    rows += [(100 + i, f"Plants were sampled in week {i}.\n{ABUSE[i % 6]} Thanks.", None) for i in range(12)] + [(500, None, "x"), (501, "", "x"), (502, "ok", "x"), (502, "ok", "x")]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, votes string")


def test_found_documents(spark):
    rows, docs = _corpus(spark)
    got = A.scored(docs).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and {k for k, s in score.items() if s >= A.THRESHOLD} == {100 + i for i in range(12)} and score[500] == score[501] == 0.0
    assert A.scored(docs.limit(0)).count() == 0


#: Abuse in other words than the patterns of one family know, next to words that other families teach.
TAUGHT = ["You are a {w}, get lost.", "I will break your fingers, {w}.", "Shut up, {w}, you are a waste of air.", "Screw you, you {w}.", "Get out of our lab, {w}, or you will regret it."]


def test_a_family_left_out_is_learned_from_the_others(spark):
    insults = ["moron", "dimwit", "scumbag", "imbecile", "idiot", "halfwit"]
    what, done, when = ["Seeds", "The labels", "Both tables", "Leaves", "These counts", "The samples"], ["were sown", "came back", "look right", "were dried", "need a check", "were sent out"], ["at dawn", "after the meeting", "in the new greenhouse", "by our group", "for the second batch", "last week"]
    rows = [(i, f"{what[i % 6]} {done[i // 6 % 6]} {when[i // 36 % 6]}. {HARMLESS[i % 6]}", "forum") for i in range(216)]
    rows += [(1000 + i, f"Fixed in build {i}. " + TAUGHT[i % 5].format(w=insults[i // 5 % 6]), "forum") for i in range(60)]
    held = [(2000 + i, f"Fixed in build {i}. What a {w}.", "forum") for i, w in enumerate(insults)]
    docs = spark.createDataFrame(rows + held, "doc_id long, text string, source string")
    got = {r.doc_id: r.score for r in A.scored(docs, without=("words",)).collect()}
    voted = [A.votes(A.plain(t)) for _, t, _ in held]
    gone = {A.VOTERS.index(v) for v in A.FAMILIES["words"]}
    assert not any(v > 0 for votes in voted for j, v in enumerate(votes) if j not in gone)
    assert sum(got[k] >= A.THRESHOLD for k, _, _ in rows if k >= 1000) == 60
    harmless = [got[k] for k, _, _ in rows if k < 1000]
    assert max(harmless) < A.THRESHOLD, (max(harmless), [got[k] for k, _, _ in held])
    assert sum(got[k] > np.mean(harmless) for k, _, _ in held) >= 5
