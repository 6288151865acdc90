from __future__ import annotations

import random

import numpy as np

from loomspeak.llm import text_quality as Q
from loomspeak.llm.text_stats import NAMES, statistics
from loomspeak.runtime import stage


def stat(text, name):
    return statistics([text])[0, NAMES.index(name)]


def test_statistics_by_hand():
    text = "The cat sat on the mat.\nred, blue"
    assert stat(text, "n_words") == 8 and stat(text, "mean_word_length") == (3 + 3 + 3 + 2 + 3 + 3 + 3 + 4) / 8
    assert stat(text, "share_lines_punctuated") == 18 / 26 and stat(text, "share_short_lines") == 8 / 26
    assert stat(text, "share_common_words") == 3 / 8 and stat(text, "words_per_segment") == 8 / 4 and stat(text, "share_stops") == 1 / 4
    assert stat("a b c", "share_single_letters") == 1.0
    assert stat("x. x. x. x. x. x. x. x.", "share_repeated_segments") == 1.0 and stat("a. b. c. d. e. f.", "share_repeated_segments") == 0.0
    for odd in ("!", "१२", "木", " 1 ", "a" * 60_000, "😀", "\u2028x\u2028", "'"):
        assert statistics([odd]).shape == (1, len(NAMES)) and np.isfinite(statistics([odd])).all()


def test_statistics_of_lines():
    assert stat("- a b\n- c\n2) d e\nand f", "share_marked_lines") == 9 / 13
    assert stat("1.1 red\n1.2 blue", "share_marked_lines") == 1.0 and stat("[x] red\n[ ] blue", "share_marked_lines") == 1.0
    for rows in ("a;b;c\nd;e;f", "| a | b |\n| c | d |", "a\tb\tc\nd\te\tf", '"a","b","c"\n"d","e","f"', "<td>a</td>\n<td>b</td>", "name   age   town\nlea   3   york"):
        assert stat(rows, "share_aligned_lines") == 1.0
    assert stat("He came, saw, and left again.\nShe went, slowly, to the door.", "share_aligned_lines") == 0.0
    assert stat(".thgin ta esuoh ehT", "share_leading_marks") == 1 / 4 and stat("T#e r@in fell", "share_damaged_words") == 2 / 3
    assert stat("[inaudible] (pause) well", "share_bracketed") == 2 / 3 and stat("aaaaa bb", "share_drawn_out") == 3 / 7


def test_a_text_has_the_same_statistics_in_any_company():
    texts = [t for _, _, t in Q.EXAMPLES]
    together = statistics(texts)
    for i in range(0, len(texts), 7):
        assert np.allclose(statistics([texts[i]])[0], together[i])


def test_distinct_words_of_the_whole_text():
    letters = "abcdefghijklmnopqrstuvwxyz"
    varied = [a + b + c for a in letters for b in letters for c in "xyz"][:2000]
    assert stat(" ".join(varied), "share_distinct_words") == 1.0
    assert stat(" ".join(varied + ["again"] * 6000), "share_distinct_words") == 2001 / 8000


def corpus():
    rng = random.Random(6)
    w = ["stone", "river", "lamp", "window", "garden", "coat", "bell", "mirror"]
    prose = lambda: " ".join(f"The {rng.choice(w)} was near the {rng.choice(w)}, and I did not know why it had {rng.choice(['gone', 'come', 'stayed'])}." for _ in range(rng.randrange(1, 6)))
    listed = lambda: "\n".join(f"{rng.choice('-*')} {rng.choice(w)} {rng.choice(w)}" for _ in range(rng.randrange(4, 20)))
    table = lambda: "\n".join(f"{rng.choice(w)};{rng.randrange(99)};{rng.randrange(99)}" for _ in range(rng.randrange(4, 20)))
    junk = lambda: " ".join("".join(rng.choice("qwertzsdfghjkl;") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(8, 60)))
    rows = [(i, kind(), k) for i, (k, kind) in enumerate([("prose", prose)] * 200 + [("list", listed)] * 60 + [("table", table)] * 60 + [("junk", junk)] * 40)]
    return rows


def test_kinds_of_unseen_documents(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(900, None, ""), (901, " \n", "")], "doc_id long, text string, kind string")
    got = {r.id: r.kind for r in Q.document_kinds(df, "doc_id", "text").collect()}
    assert got.keys() == {i for i, _, _ in rows}
    assert sum(got[i] == k for i, _, k in rows) >= 0.98 * len(rows)


def test_the_mixture_decides(spark, monkeypatch):
    monkeypatch.setattr(Q, "component_kinds", lambda examples, mixture: ["junk"] * len(mixture[0]))
    df = spark.createDataFrame([(i, t) for i, t, _ in corpus()], "doc_id long, text string")
    assert {r.kind for r in Q.document_kinds(df, "doc_id", "text").collect()} == {"junk"}


def test_examples_get_their_own_kind(spark):
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(Q.EXAMPLES)], "doc_id long, text string")
    got = {r.id: r.kind for r in Q.document_kinds(df, "doc_id", "text").collect()}
    assert sum(got[i] == k for i, (k, _, _) in enumerate(Q.EXAMPLES)) >= 0.97 * len(Q.EXAMPLES)


def test_rounds_raise_the_likelihood(spark):
    stats = stage(Q.document_statistics(spark.createDataFrame([(i, t) for i, t, _ in corpus()], "doc_id long, text string"), "doc_id", "text"), "statistics")
    x = Q.features(np.array([[r[f] for f in Q.FEATURES] for r in stats.collect()], float))

    def score(rounds):
        scale, mixture = Q.fit(stats, rounds=rounds)
        return float(np.logaddexp.reduce(Q.log_density(Q.standard(x, scale), mixture), axis=1).sum())

    assert score(6) > score(0)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert Q.document_kinds(df, "doc_id", "text").collect() == []
    one = spark.createDataFrame([(1, "We were there and it was good.")], "doc_id long, text string")
    assert [r.kind for r in Q.document_kinds(one, "doc_id", "text").collect()] == ["prose"]
