"""Reading transcripts, participant lists, tables of texts, baselines and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspeak.config import DEFAULT, Study, TopicModel
from loomspeak.functions.regex import java
from loomspeak.functions.text import strip

#: Where a line ends: the boundaries of str.splitlines.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def read_files(spark: SparkSession, folder: str, glob: str = "*.txt", exclude: str | None = None) -> DataFrame:
    """(file, path, content) of the files below folder: undecodable bytes replaced, byte-order mark dropped.

    glob is compared without case; paths that match the pattern exclude are left out.
    """
    pattern = "(?i)^" + "".join({"*": ".*", "?": "."}.get(ch, "\\" + ch if not ch.isalnum() else ch) for ch in glob) + "$"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "").alias("content"))
    named = named.where(F.col("file").rlike(pattern))
    return named.where(~F.col("path").rlike(exclude)) if exclude else named


def unreadable(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(file) of the files below folder that aren't among those read: with spark.sql.files.ignoreCorruptFiles one bad file doesn't end the run."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return listed.join(files.select("file").distinct(), "file", "left_anti")


def lines(files: DataFrame) -> DataFrame:
    """(file, line_no, line): the lines of every file from 1."""
    return files.select("file", F.posexplode(F.split("content", LINE_END)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def numbered_lines(all_lines: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """Lines that aren't blank with turn_no (timestamps so far) and rank (place behind its timestamp, from 0)."""
    by = Window.partitionBy("file").orderBy("line_no")
    is_time = F.col("line").rlike(java(study.timestamp)).cast("int")
    counted = all_lines.where(strip(F.col("line")) != "").withColumn("turn_no", F.sum(is_time).over(by))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("file", "turn_no").orderBy("line_no")) - F.when(F.col("turn_no") > 0, 1).otherwise(0))


def parse_transcripts(all_lines: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """(file, turn_idx, start, end, speaker, text) of lines (file, line_no, line).

    A timestamp line opens a turn, the next line that isn't blank holds label and text (without label the speaker is
    no_label), further lines go on. What stands before the first timestamp is left out, as is a timestamp
    followed by nothing. Turns are numbered from 0 in their order.
    """
    label, time = java(study.label), java(study.timestamp)
    of_turn = numbered_lines(all_lines, study).where("turn_no > 0")
    first = F.col("rank") == 1
    labelled = F.col("line").rlike(label)
    text = F.when(first & labelled, strip(F.regexp_extract("line", label, 2))).otherwise(strip(F.col("line")))
    turns = of_turn.groupBy("file", "turn_no").agg(
        F.max(F.when(F.col("rank") == 0, F.regexp_extract("line", time, 1))).alias("start"),
        F.max(F.when(F.col("rank") == 0, F.regexp_extract("line", time, 2))).alias("end"),
        F.max(F.when(first, F.when(labelled, strip(F.regexp_extract("line", label, 1))).otherwise(F.lit(study.no_label)))).alias("speaker"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 0, F.struct("rank", text.alias("text"))))), lambda x: x["text"]), " ").alias("text"),
    ).where("speaker IS NOT NULL")
    by = Window.partitionBy("file").orderBy("turn_no")
    return turns.select("file", (F.row_number().over(by) - 1).alias("turn_idx"), "start", "end", "speaker", "text")


def structure_issues(all_lines: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """(file, line_no, line, issue): lines before the first timestamp, and known labels at the start of continuation lines."""
    numbered = numbered_lines(all_lines, study)
    label = java(study.label)
    speakers = numbered.where("rank = 1 AND turn_no > 0").where(F.col("line").rlike(label)).select("file", F.lower(strip(F.regexp_extract("line", label, 1))).alias("speaker")).distinct()
    before = numbered.where("turn_no = 0").select("file", "line_no", "line", F.lit("before_first_timestamp").alias("issue"))
    inside = numbered.where("turn_no > 0 AND rank > 1").where(F.col("line").rlike(label)).withColumn("speaker", F.lower(strip(F.regexp_extract("line", label, 1))))
    hidden = inside.join(speakers, ["file", "speaker"], "left_semi").select("file", "line_no", "line", F.lit("label_inside_turn").alias("issue"))
    return before.union(hidden)


def participant_list(raw: DataFrame, study: Study = DEFAULT, inline_comments: bool = False) -> DataFrame:
    """(participant_id, line_no, accepted) of lines (line_no, participant_id): the first column, without quotes.

    Blank lines and comments are skipped, of repeated ids the first line counts, others than ids are listed as not accepted.
    inline_comments: what follows # in a line is no part of it either.
    """
    line = F.regexp_replace("participant_id", r"#.*$", "") if inline_comments else F.col("participant_id")
    value = strip(F.regexp_replace(F.get(F.split(strip(line), r"[,;\t ]"), F.lit(0)), "[\"']", ""))
    kept = raw.where("participant_id IS NOT NULL").select("line_no", value.alias("participant_id"), strip(F.col("participant_id")).alias("raw")).where("participant_id <> '' AND raw NOT LIKE '#%'")
    first = kept.groupBy("participant_id").agg(F.min("line_no").alias("line_no"))
    return first.withColumn("accepted", F.col("participant_id").rlike(java(study.participant, True)))


def text_table(df: DataFrame, model: TopicModel = TopicModel(), text_col: str | None = None) -> DataFrame:
    """df with its text, the first of the known columns that exists, as `text`; null texts are left out."""
    names = [text_col] if text_col else [c for c in model.text_columns if c in df.columns]
    if not names or names[0] not in df.columns:
        raise ValueError(f"no text column among {df.columns}")
    out = df.where(F.col(names[0]).isNotNull())
    return out if names[0] == "text" else out.withColumn("text", F.col(names[0]))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of one pattern, stacked by column name; quoted fields may hold line breaks."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def baseline_table(spark: SparkSession, path: str) -> DataFrame:
    """(baseline, mean_similarity); no rows if the file isn't there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], "baseline string, mean_similarity double")
    return read_csv(spark, path).select("baseline", F.col("mean_similarity").cast("double"))


def find_results(spark: SparkSession, folder: str, pattern: str = "*_results.csv") -> str:
    """The one file of a pattern; none or several is an error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder, pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) or []
    if len(found) != 1:
        raise ValueError(f"{len(found)} files match {pattern} in {folder}")
    return found[0].getPath().toString()
