"""Small inline transcripts with results worked out by hand, which serve as the SQL side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CONTENT = (
    "﻿Some heading\n\n00:00:00 - 00:00:05\nAnna: Welcome to this.\n\nIt will be short.\n0:00:05 - 00:00:07\nOkay then\n00:00:08 - 00:00:09\n"
    "00:00:10 - 00:00:12\r\nsub-p0001: I see:\nall of it\nanna: and you\n"
)
PARSED_SQL = (
    "SELECT * FROM (VALUES ('a.txt', 0, '00:00:00', '00:00:05', 'Anna', 'Welcome to this. It will be short.'), ('a.txt', 1, '0:00:05', '00:00:07', 'UNKNOWN', 'Okay then'), "
    "('a.txt', 2, '00:00:10', '00:00:12', 'sub-p0001', 'I see: all of it anna: and you')) AS t(file, turn_idx, \"start\", \"end\", speaker, text)"
)
ISSUES_SQL = "SELECT * FROM (VALUES ('a.txt', 1, 'Some heading', 'before_first_timestamp'), ('a.txt', 13, 'anna: and you', 'label_inside_turn')) AS t(file, line_no, line, issue)"

THREE = (
    (0, "00:00:00", "00:00:05", "Anna", "Welcome, this is the introduction."),
    (1, "00:00:05", "00:00:07", "sub-p0001", "Okay, thank you."),
    (2, "00:00:07", "00:00:12", "Anna", "Please go back to the most intense moment."),
    (3, "00:00:12", "00:00:14", "sub-p0001", "I am ready."),
    (4, "00:00:14", "00:00:18", "Anna", "What did you notice?"),
    (5, "00:00:18", "00:00:25", "sub-p0001", "My chest was tight when the boy cried..."),
    (6, "00:00:25", "00:00:26", "Anna", "Mhm"),
    (7, "00:00:26", "00:00:30", "sub-p0001", "...and I felt, um, a lump (pause)."),
    (8, "00:00:30", "00:00:36", "Anna", "Now another scene, the celebration."),
    (9, "00:00:36", "00:00:40", "sub-p0001", "He won and the crowd was cheering."),
    (10, "00:00:40", "00:00:45", "Anna", "And the last scene, with the woman."),
    (11, "00:00:45", "00:00:50", "sub-p0001", "It was beautiful."),
)
ANSWERS_SQL = (
    "SELECT * FROM (VALUES ('sub-p0001_m1_a001', '00:00:12', '00:00:14', 1, 0, 3, 'evocation', 'I am ready.'), "
    "('sub-p0001_m1_a002', '00:00:18', '00:00:30', 2, 1, 13, '', 'My chest was tight when the boy cried and I felt a lump.'), "
    "('sub-p0001_m2_a003', '00:00:36', '00:00:40', 1, 0, 7, '', 'He won and the crowd was cheering.'), ('sub-p0001_m3_a004', '00:00:45', '00:00:50', 1, 0, 3, '', 'It was beautiful.')) "
    "AS t(answer_id, \"start\", \"end\", n_turns_merged, n_interviewer_turns_bridged, n_words, drop_reason, clean)"
)

RAW = ("Um, I felt, uh, sad (laughs).", "tense) and then (relieved", "pause) I felt it", "It was good . . And then", "Mhm", "I felt, um, a lump (pause).")
CLEANED_SQL = (
    "SELECT * FROM (VALUES (0, 'I felt sad.'), (1, 'tense and then relieved'), (2, 'I felt it'), (3, 'It was good. And then'), (4, ''), (5, 'I felt a lump.')) AS t(id, clean)"
)

TAGGED = (
    ("The woman comes in and hugs him.", "narrative"), ("When the boy cried I felt a lump.", "mixed"), ("I felt sad for the boy.", "mixed"), ("The father was cruel to the boy.", "mixed"),
    ("there was this heaviness", "experiential"), ("it was a very sad scene", "experiential"), ("that was not good", "experiential"), ("Yes, exactly.", "other"), ("It was the end.", "other"),
)
TAGS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{t}')" for s, t in TAGGED) + ") AS t(sentence, tag)"


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a.txt", CONTENT.lstrip("﻿"))], "file string, content string")


def three_moments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("sub-p0001_x.txt", *t) for t in THREE], "file string, turn_idx int, start string, end string, speaker string, text string")
