"""Answer building: transcripts worked out by hand, and what holds of every transcript."""

from __future__ import annotations

import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loomspeak.config import DEFAULT
from loomspeak.operators import answers as A
from loomspeak.operators import quality, scenes, segments
from loomspeak.plans import catalogue
from tests import fixtures

SCHEMA = "file string, turn_idx int, start string, end string, speaker string, text string"
OPENING = ("Anna", "The most intense moment.")


def worked(spark, turns):
    rows = [("f", i, "00:00:00", "00:00:01", who, text) for i, (who, text) in enumerate([OPENING, *turns])]
    labelled = segments.segment(segments.with_text_flags(segments.with_roles(spark.createDataFrame(rows, SCHEMA))))
    return [(r.raw, r.n_turns_merged, r.n_interviewer_turns_bridged, r.drop_reason) for r in A.build_answers(labelled).orderBy("answer_no").collect()]


def test_worked_transcripts(spark):
    p, i = "sub-p0001", "Anna"
    # A short interruption between marks of continuation is bridged, one without the marks isn't.
    assert worked(spark, [(p, "It was like a long way..."), (i, "A long way"), (p, "... down to the river")]) == [("It was like a long way down to the river", 2, 1, "")]
    assert worked(spark, [(p, "It was like a long way"), (i, "A long way"), (p, "down to the river")]) == [("It was like a long way", 1, 0, ""), ("down to the river", 1, 0, "")]
    # Backchannels are bridged, however many; consecutive turns are one answer; a question ends it.
    assert worked(spark, [(p, "I saw the gate open"), (i, "Mhm"), (i, "Okay"), (p, "and I went in"), (p, "very slowly"), (i, "What did you notice there?"), (p, "Only the cold floor")]) == [
        ("I saw the gate open and I went in very slowly", 3, 2, ""), ("Only the cold floor", 1, 0, ""),
    ]
    # An interruption, then a backchannel: merged, as the participant follows; the other way round: split.
    assert [n for _, n, _, _ in worked(spark, [(p, "It was dark..."), (i, "Very dark"), (i, "Mhm"), (p, "... and I was alone there")])] == [2]
    assert worked(spark, [(p, "I am ready."), (i, "What did you notice?"), (p, "Can you repeat?"), (i, "What did you see?"), (p, "Nothing"), (i, "And then?"), (p, "Mhm")]) == [
        ("I am ready.", 1, 0, "evocation"), ("Can you repeat?", 1, 0, "participant question"), ("Nothing", 1, 0, "too short"), ("Mhm", 1, 0, "backchannel"),
    ]


def test_every_turn_in_one_answer_and_no_answer_across_moments(spark):
    rng = random.Random(8)
    says = ["I felt it...", "... and more", "Mhm", "yes", "It was like a long walk home", "Can you repeat?", "I am ready", "okay", "– no, not that", "Then it ended -"]
    asks = ["Mhm", "Okay", "And then?", "What did you notice there?", "Right", "Now another scene, the celebration.", "And the last scene, with the woman.", "Go on", OPENING[1]]
    rows = []
    for f in range(120):
        for i in range(rng.randrange(2, 16)):
            who = "Anna" if i == 0 else rng.choice(["Anna", "sub-p0001"])
            rows.append((f"f{f:03d}", i, "00:00:00", "00:00:01", who, OPENING[1] if i == 0 else rng.choice(says if who != "Anna" else asks)))
    labelled = segments.segment(segments.with_text_flags(segments.with_roles(spark.createDataFrame(rows, SCHEMA))))
    turns = labelled.where("is_participant AND moment > 0").groupBy("file", "moment", "evocation").agg(F.count("*").alias("n"))
    answers = A.build_answers(labelled)
    merged = answers.groupBy("file", "moment", "evocation").agg(F.sum("n_turns_merged").alias("n"))
    assert turns.exceptAll(merged).count() == 0 and merged.exceptAll(turns).count() == 0
    numbers = answers.groupBy("file").agg(F.sort_array(F.collect_list("answer_no")).alias("n")).collect()
    assert numbers and all(r.n == list(range(1, len(r.n) + 1)) for r in numbers)
    reasons = {r.drop_reason for r in answers.select("drop_reason").distinct().collect()}
    assert reasons <= {"", "evocation", "backchannel", "participant question", "too short"} and answers.where("kept <> (drop_reason = '')").count() == 0


def test_three_moments(spark):
    turns = segments.with_text_flags(segments.with_roles(fixtures.three_moments(spark)))
    labelled = segments.segment(turns)
    rows = {r.turn_idx: r for r in labelled.collect()}
    assert [rows[i].moment for i in range(12)] == [0, 0, 1, 1, 1, 1, 1, 1, 2, 2, 3, 3]
    assert [i for i in rows if rows[i].evocation] == [3]
    answers = A.with_ids(A.build_answers(labelled), segments.file_people(turns))
    second = answers.where("answer_no = 2").first()
    assert second.question == "Please go back to the most intense moment. What did you notice?"
    assert (second.n_annotations, second.n_hesitations, second.n_stray_brackets) == (1, 1, 0)
    scene = scenes.moment1_scenes(labelled).first()
    assert (scene.scene, scene.confidence, scene.evidence) == ("boy", "ambiguous", "boy=2 (boy, cried)")
    sources = A.moment_sources(answers, scenes.moment1_scenes(labelled), labelled.where("unrecognised"))
    s = sources.first()
    assert (s.source1, s.source2, s.source3, s.status, s.outcome, s.present, s.notes) == ("own", "own", "own", "ok", None, [], [])
    times = quality.moment_report(labelled, answers).first()
    assert (times.m1_duration_s, times.m2_duration_s, times.m3_duration_s, times.m1_words, times.m2_words, times.m3_words, times.n_moments) == (23, 10, 10, 13, 7, 3, 3)
    assert {r.moment: (r.median_s, r.median_words, r.participants) for r in quality.moment_summary(quality.moment_report(labelled, answers), answers).collect()} == {1: (23, 13, 1), 2: (10, 7, 1), 3: (10, 3, 1)}
    assert {r.role: round(float(r.word_share), 3) for r in quality.speaker_shares(turns).collect()}["participant"] == 0.508
    assert [round(float(r.retention), 3) for r in quality.totals(answers).where("moment = 'all'").collect()] == [0.885]
    report = quality.file_report(turns, segments.file_people(turns), labelled, answers, sources).first()
    assert (report.status, report.m2_start, report.evocations, report.answers, report.words) == ("ok", 8, 1, 3, 23)
    assert {(r.segment, r.answer_id) for r in A.materialise(answers, sources).collect()} == {
        (g, a) for g, n in (("full", (2, 3, 4)), ("moment1", (2,)), ("moment2", (3,)), ("moment3", (4,))) for a in (f"sub-p0001_m{n_ - 1}_a{n_:03d}" for n_ in n)
    }
    flags = quality.flags(turns, answers, segments.file_people(turns), turns.select("file").distinct(), sources)
    assert sorted(r.detail for r in flags.where("check = 'moments'").collect()) == ["moment 1 has 13 words", "moment 2 has 7 words", "moment 3 has 3 words"]


def test_copied_moment(spark):
    rows = [t for t in fixtures.THREE if t[0] not in (8, 9)]
    rows[5 - 0] = (5, "00:00:18", "00:00:25", "sub-p0001", "I hugged my opponent because he won.")
    turns = segments.with_text_flags(segments.with_roles(spark.createDataFrame([("f", *t) for t in rows], SCHEMA)))
    labelled = segments.segment(turns)
    answers = A.with_ids(A.build_answers(labelled), segments.file_people(turns))
    found = scenes.moment1_scenes(labelled)
    assert (found.first().scene, found.first().confidence, found.first().evidence) == ("celebration", "clear", "celebration=4 (hugged my opponent, won)")
    sources = A.moment_sources(answers, found, labelled.where("unrecognised"))
    first = sources.first()
    assert (first.source2, first.outcome, [n.severity for n in first.notes]) == ("copied_from_moment1", "confirmed", ["INFO"])
    copied = A.materialise(answers, sources).where("segment = 'moment2'").collect()
    assert copied and all(r.moment == 1 and "_m1_" in r.answer_id for r in copied)


def test_longest_keyword_wins(spark):
    lexicon = scenes.lexicon_of(DEFAULT)
    assert scenes.stretches("I hugged my opponent", lexicon) == [("celebration", True, "hugged my opponent", 0)]
    assert scenes.stretches("", lexicon) == []
    texts = spark.createDataFrame([(1, "The boy was at the beach, in the sand and the sea."), (2, "nothing"), (3, None), (4, "a doctor and a crowd"), (5, "waves, then death")], "k int, t string")
    got = {r.k: (r.scene, r.confidence, r.evidence, r.present) for r in scenes.scenes_of(texts, "k", "t").collect()}
    assert got == {
        1: ("beach", "clear", "beach=6 (beach, sand, sea); boy=1 (boy)", ["beach"]), 4: ("doctor", "clear", "doctor=2 (doctor); celebration=1 (crowd)", ["doctor"]),
        5: ("beach", "ambiguous", "beach=2 (waves); death=2 (death)", ["beach", "death"]),
    }


def sources_of(spark, has, scene=("unknown", "none", "", []), odd=None, **changes):
    answers = spark.createDataFrame([("f", m, bool(h)) for m, h in enumerate(has, 1)], "file string, moment int, kept boolean")
    found = spark.createDataFrame([("f", *scene)], "file string, scene string, confidence string, evidence string, present array<string>")
    r = A.moment_sources(answers, found, spark.createDataFrame([("f", odd)] if odd is not None else [], "file string, turn_idx int"), replace(DEFAULT, **changes)).first()
    return (r.source1, r.source2, r.source3), r.outcome, [n.severity for n in r.notes], r.status


def test_decisions_and_their_notes(spark):
    cel = ("celebration", "clear", "e", ["celebration"])
    copied = ("own", "copied_from_moment1", "own")
    assert sources_of(spark, (1, 0, 1), cel) == (copied, "confirmed", ["INFO"], "ok")
    assert sources_of(spark, (1, 0, 1), ("beach", "ambiguous", "e", ["beach", "celebration"])) == (copied, "among several", ["INFO"], "ok")
    assert sources_of(spark, (1, 0, 1), ("celebration", "ambiguous", "e", ["celebration"])) == (copied, "unconfirmed", ["WARN"], "ok")
    assert sources_of(spark, (1, 0, 1)) == (copied, "unknown", ["WARN"], "ok")
    assert sources_of(spark, (1, 0, 1), ("beach", "clear", "e", ["beach"])) == (("own", "missing", "own"), "elsewhere", ["WARN"], "review")
    assert sources_of(spark, (1, 0, 1), cel, odd=4) == (("own", "ambiguous", "own"), "ambiguous", ["ERROR"], "review")
    assert sources_of(spark, (1, 0, 1), cel, no_fill=True) == (("own", "missing", "own"), "off", [], "review")
    assert sources_of(spark, (1, 0, 0), cel) == (("own", "missing", "missing"), None, ["ERROR"], "review")
    assert sources_of(spark, (0, 1, 1), odd=2) == (("missing", "own", "own"), None, ["ERROR", "WARN"], "review")
    assert sources_of(spark, (1, 1, 1), ("mother", "clear", "e", ["mother", "beach"])) == (("own", "own", "own"), None, ["INFO", "INFO"], "ok")


def test_no_opening_and_empty(spark):
    none = spark.createDataFrame([("f", 0, None, None, None, None)], SCHEMA)
    turns = segments.with_text_flags(segments.with_roles(none))
    assert segments.segment(turns).collect() == []
    empty = segments.segment(segments.with_text_flags(segments.with_roles(spark.createDataFrame([], SCHEMA))))
    assert A.build_answers(empty).collect() == []
    assert quality.moment_report(empty, A.build_answers(empty)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_every_unrecognised_announcement_is_flagged(spark):
    turns = catalogue.moment_labels(spark, "/root/testdata/sf0.001").where("unrecognised").collect()
    flags = catalogue.qc_flags(spark, "/root/testdata/sf0.001").where("check = 'moments' AND severity = 'WARN'").collect()
    got = sorted((r.file, r.detail) for r in flags if r.detail.startswith("unrecognised"))
    assert turns and got == sorted((r.file, f"unrecognised announcement at turn {r.turn_idx}") for r in turns)
