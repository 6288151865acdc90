from __future__ import annotations

from tests import fixtures
from loomspeak.sources import sinks, transcripts
from loomspeak.streaming.words import speaker_words


def test_read_parse_and_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes(fixtures.CONTENT.encode() + b"\xff\n")
    (tmp_path / "B_TASK-x.TXT").write_text("00:00:00 - 00:00:01\nAnna: hi\n")
    (tmp_path / "c.csv").write_text("no")
    files = transcripts.read_files(spark, str(tmp_path))
    assert {r.file for r in files.collect()} == {"a.txt", "B_TASK-x.TXT"}
    assert {r.file for r in transcripts.read_files(spark, str(tmp_path), "*_task-x.txt").collect()} == {"B_TASK-x.TXT"}
    turns = transcripts.parse_transcripts(transcripts.lines(files)).where("file = 'a.txt'").orderBy("turn_idx").collect()
    assert [(t.speaker, t.start) for t in turns] == [("Anna", "00:00:00"), ("UNKNOWN", "0:00:05"), ("sub-p0001", "00:00:10")]
    assert turns[2].text == "I see: all of it anna: and you �"
    assert {r.issue for r in transcripts.structure_issues(transcripts.lines(files)).collect()} == {"before_first_timestamp", "label_inside_turn"}


def test_participant_list(spark):
    rows = ["participant_id", "# comment", "", None, '"sub-p0001",x', "sub-p0002 # late", "sub-p0001", "SUB-P0003"]
    df = spark.createDataFrame(list(enumerate(rows)), "line_no int, participant_id string")
    got = {r.participant_id: (r.line_no, r.accepted) for r in transcripts.participant_list(df).collect()}
    assert got == {"participant_id": (0, False), "sub-p0001": (4, True), "sub-p0002": (5, True), "SUB-P0003": (7, True)}


def test_text_table_takes_the_first_known_column(spark):
    df = spark.createDataFrame([("x", None), ("y", "z")], "text string, reflection_answer string")
    assert [r.text for r in transcripts.text_table(df.drop("text")).collect()] == ["z"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", 2, "b.", "q?", True), ("p", 1, "a.", "", True), ("p", 3, "c", "", False)], "participant_id string, answer_no int, clean string, question string, kept boolean")
    assert sinks.documents(df, ["participant_id"]).first().document == "a. b."
    assert sinks.documents(df, ["participant_id"], "qa").first().document == "A: a.\n\nQ: q?\nA: b."
    for value in ("one", "two"):
        sinks.write_participants(spark.createDataFrame([(value, "p1" if value == "two" else "p0")], "v string, participant_id string"), str(tmp_path / "out"))
    assert {(r.v, r.participant_id) for r in spark.read.option("header", "true").csv(str(tmp_path / "out")).collect()} == {("one", "p0"), ("two", "p1")}
    vectors = spark.createDataFrame([(1, [1.0])], "row int, embedding array<float>")
    sinks.save_vectors(vectors, str(tmp_path / "v"), "f", "m")
    assert sinks.load_vectors(spark, str(tmp_path / "v"), "f", "m").count() == 1
    assert sinks.load_vectors(spark, str(tmp_path / "v"), "other", "m") is None and sinks.load_vectors(spark, str(tmp_path / "none"), "f", "m") is None


def test_find_results_and_baseline(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError):
        transcripts.find_results(spark, str(tmp_path))
    (tmp_path / "x_results.csv").write_text("trial_number\n1\n")
    assert transcripts.find_results(spark, str(tmp_path)).endswith("x_results.csv")
    assert transcripts.baseline_table(spark, str(tmp_path / "no.csv")).count() == 0
    (tmp_path / "b.csv").write_text("baseline,mean_similarity\nany two,0.5\n")
    assert transcripts.baseline_table(spark, str(tmp_path / "b.csv")).first().mean_similarity == 0.5


def test_stream_counts_a_row_once(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2032, 1, 1)
    rows = [("f", 0, "A", "one two", at), ("f", 0, "A", "one two", at), ("f", 1, "B", None, at)]
    schema = "file string, turn_idx int, speaker string, text string, loaded_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = speaker_words(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("speaker_words").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.speaker, r.turns, r.words) for r in spark.sql("SELECT * FROM speaker_words").collect()} == {("A", 1, 2), ("B", 1, 0)}
