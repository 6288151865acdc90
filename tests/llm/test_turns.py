from __future__ import annotations

import datetime as dt

from loomspeak.llm import turns as T

TURNS = "file string, turn_idx int, start string, end string, speaker string, text string, loaded_at timestamp, who string"
SESSIONS = "file string, participant_id string, interviewer string, observer string, sec int"
AT = dt.datetime(2032, 1, 1)


def found(spark, rows, sessions=(("f", "sub-p0100", "Dorvik", "Quillan", 1),)):
    turns = spark.createDataFrame([("f", i, s, e, sp, t, AT, "clash") for i, s, e, sp, t in rows], TURNS)
    out = T.clean_turns(turns, spark.createDataFrame(list(sessions), SESSIONS))
    return sorted((r.first_turn_idx, r.last_turn_idx, r.speaker) for r in out.collect())


def test_labels_in_any_spelling():
    people = T.People("sub-p0100", "Dorvik", "Quillan")
    for label in ("sub-p0100", " SUB-P0100", "sub–p0100", "subp0100", "P0100", "sub-pO1OO", "Participant (sub-p0100)", "P", "Interviewee", "sub_p0100:"):
        assert people.of(label) == "participant", label
    for label in ("Dorvik", "dorvik ", "DORVIK:", "D.", "Drovik", "Dorvikk", "Int.", "I", "Interviewer", "Dorvik (interviewer)"):
        assert people.of(label) == "interviewer", label
    for label in ("Quillan", "Q.", "Observer 1", "OBS:", "Quillan (observer)"):
        assert people.of(label) == "observer", label
    for label in (None, "", "???", "UNKNOWN", "sub-p0200", "Somebody"):
        assert people.of(label) is None, label


def test_pieces_and_what_is_said():
    people = T.People("sub-p0100", "Dorvik", None)
    assert T.pieces("sub-p0100", "It was cold. // Dorvik: And then?", people)[0] == [("participant", True), ("interviewer", True)]
    assert T.pieces("Dorvik", "Go on. [SUB-P0100] Yes.\nDORVIK: Good.", people)[0] == [("interviewer", True), ("participant", True), ("interviewer", True)]
    assert T.pieces(None, "<sub-p0100> Hello", people)[0] == [("participant", True)]
    assert T.pieces("", "Dorvik - Hello", people)[0] == [("interviewer", True)]
    assert T.pieces("sub-p0100", "Thank you, Dorvik told me: go on, please: now", people)[0] == [("participant", True)]
    assert T.pieces("???", None, people)[0] == [("unknown", False)]
    for text in ("Mhm...", "[laughs] (long pause)", "uh, Er ...", "♪ sighs ♪ *coughs*", "(laughs]", "– –", "", "  "):
        assert not T.said(text), text
    for text in ("okay", "(how do I say this?)", "um, yes", "好的。", "12"):
        assert T.said(text), text


def test_order_repetitions_and_runs(spark):
    rows = [
        (0, "00:00:01", "00:00:02", "Dorvik", "Welcome."),
        (1, "00:00:05", None, "sub-p0100", "Hello there"),
        (2, None, None, "P", "and more"),
        (3, "00:00:07.5", "", "I", "Mhm"),
        (4, "9 s", "", "sub-p0100", "Last words"),
        (5, "[00:00:03]", None, "Quillan", "I only listen"),
        (6, "00.00.05", None, "P0100", "HELLO  there "),
        (7, "00:00:09,120", "00:00:10", "", "who?"),
    ]
    assert found(spark, rows) == [(0, 0, "interviewer"), (1, 4, "participant"), (5, 5, "observer"), (7, 7, "unknown")]


def test_rows_delivered_twice_and_bad_rows(spark):
    later = AT + dt.timedelta(days=1)
    rows = [("f", 0, "00:00:01", None, "Dorvik", "one", AT, "c"), ("f", 0, "00:00:01", None, "Dorvik", "one", later, "c"), (None, 1, None, None, None, None, AT, "c"), ("g", None, "x", "y", "P", "text", None, "c")]
    out = T.clean_turns(spark.createDataFrame(rows, TURNS), spark.createDataFrame([], SESSIONS))
    assert {(r.file, r.first_turn_idx, r.speaker) for r in out.collect()} == {("f", 0, "unknown"), ("g", None, "participant")}
    assert T.clean_turns(spark.createDataFrame([], TURNS), spark.createDataFrame([], SESSIONS)).collect() == []


def test_times_are_read_by_their_template(spark):
    std = [(f"00:{m:02d}:{s:02d}", m * 60 + s) for m in range(3) for s in range(0, 60, 7)]
    rows = [("f", i, f"{n // 60:02d}:{n % 60:02d}", t, "P", "x", AT, "c") for i, (t, n) in enumerate(std)]
    rows += [("f", 100 + i, f"{n // 3600:02d}h{n % 3600 // 60:02d}m{n % 60:02d}s", t, "P", "x", AT, "c") for i, (t, n) in enumerate(std)]
    rows += [("f", 200 + i, f"{n}.0s", t, "P", "x", AT, "c") for i, (t, n) in enumerate(std)]
    templates = slots(spark, rows)
    assert templates["D : D"] == (60, 1) and templates["D . D s"] == (1, 0) and templates["D : D : D"] == (3600, 60, 1)
    assert templates["D h D m D s"] == (3600, 60, 1)


def slots(spark, rows, sessions=()):
    people = T.people_of(spark.createDataFrame(list(sessions), SESSIONS))
    return {shape: t["slot"] for t in T.mined(spark.createDataFrame(rows, TURNS), people) for shape in t["shapes"] or ["<*> of %d" % len(t["slot"])]}


def test_a_rare_layout_takes_the_reading_of_its_template(spark):
    rows = [("f", i, f"{i} m {i} s", f"00:{i:02d}:{i:02d}", "P", "x", AT, "c") for i in range(9)] + [("f", 50, "7 m 8 z", None, "P", "x", AT, "c")]
    assert slots(spark, rows)["D m D z"] == (60, 1)


def test_layouts_beyond_the_most_frequent_are_read_too(spark, monkeypatch):
    monkeypatch.setattr(T, "MAX_SHAPES", 1)
    rows = [(0, "00:00:01", "00:00:02", "Dorvik", "one"), (1, "(00/00/09)", None, "sub-p0100", "two"), (2, "00:00:05", None, "Dorvik", "three"), (3, "00~30", "00:30:00", "P", "four")]
    rows += [(4 + i, "00:02:00", "00:02:01", "Dorvik", f"w{i}") for i in range(5)]
    assert found(spark, rows) == [(0, 2, "interviewer"), (1, 1, "participant"), (3, 3, "participant"), (4, 8, "interviewer")]


def test_the_slot_of_a_label_is_inferred(spark):
    sessions = [(f"f{i}", f"sub-p{i:04d}", "Dorvik", None, 1) for i in range(20)]
    rows = [(f"f{i}", 0, None, None, f"mic / sub-p{i:04d}", "x", AT, "c") for i in range(20)] + [("f1", 1, None, None, "Dorvik", "x", AT, "c")]
    found_slots = slots(spark, rows, sessions)
    assert found_slots[T.label_shape("mic / sub-p0001")] == 2 and found_slots["W"] == 0


def test_tree_joins_alike_and_keeps_slots_apart():
    tree = T.TokenTree()
    a = tree.add("speaker", "W - W a b c d".split(), 2)
    assert tree.add("speaker", "W - W a b c e".split(), 3) == a
    assert tree.templates[a]["tokens"] == ["W", "-", "W", "a", "b", "c", "<*>"] and tree.templates[a]["count"] == 5
    b = tree.add("time", "D : D s".split(), 4, (60, 1))
    assert tree.add("time", "D . D s".split(), 1, (1, 0)) != b and tree.add("time", "D ; D s".split(), 1) == b
    assert tree.templates[b]["tokens"] == ["D", "<*>", "D", "s"]
