"""Writing data sets, reports and flags."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_segments(units: DataFrame, folder: str) -> None:
    """Rows by segment, sorted by participant and answer: one folder a segment, without the column segment inside."""
    units.sortWithinPartitions("participant_id", *[c for c in ("answer_id",) if c in units.columns]).write.mode("overwrite").partitionBy("segment").option("header", "true").csv(folder)


def write_participants(df: DataFrame, folder: str) -> None:
    """Rows by participant; only folders of participants in df are replaced."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("participant_id").option("header", "true").csv(folder)
    )


def write_table(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One table as CSV with a header."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", "true").csv(path)


def save_vectors(vectors: DataFrame, path: str, fingerprint: str, model: str) -> None:
    """Vectors as parquet with a sidecar of what they were made from."""
    vectors.write.mode("overwrite").parquet(path)
    spark = vectors.sparkSession
    spark.createDataFrame([(json.dumps({"fingerprint": fingerprint, "model": model}),)], "value string").coalesce(1).write.mode("overwrite").text(path + "_meta")


def load_vectors(spark: SparkSession, path: str, fingerprint: str, model: str) -> DataFrame | None:
    """Saved vectors if they were made from the same texts by the same model, else None."""
    meta = spark._jvm.org.apache.hadoop.fs.Path(path + "_meta")
    if not meta.getFileSystem(spark._jsc.hadoopConfiguration()).exists(meta):
        return None
    found = json.loads(spark.read.text(path + "_meta").first()[0])
    return spark.read.parquet(path) if found == {"fingerprint": fingerprint, "model": model} else None


def documents(answers: DataFrame, by: list[str], mode: str = "answers") -> DataFrame:
    """(by, document): the kept answers of a group in order of answer_no, joined by a blank or, mode 'qa', as questions and answers."""
    block = F.when(F.coalesce("question", F.lit("")) != "", F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.col("clean"))).otherwise(F.concat(F.lit("A: "), F.col("clean")))
    part = block if mode == "qa" else F.col("clean")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("answer_no", part.alias("part")))), lambda x: x["part"])
    return answers.where("kept").groupBy(*by).agg(F.array_join(ordered, "\n\n" if mode == "qa" else " ").alias("document"))


def summary(df: DataFrame, title: str, most: int = 60) -> str:
    """A small report as text: at most `most` rows of an aggregated table."""
    rows = df.limit(most).collect()
    return "\n".join([title, *("  " + ", ".join(f"{k}: {v}" for k, v in r.asDict().items()) for r in rows)])


def file_of_participant(files: DataFrame, participants: DataFrame) -> DataFrame:
    """(participant_id, files, n): the files whose name holds a participant's id, not followed by a digit.

    The id in a name is taken out by pattern and joined, so that no pair of file and participant is compared.
    """
    ids = files.select("file", F.explode(F.regexp_extract_all("file", F.lit(r"(?i)(sub-[a-z]*\d+)"), 1)).alias("id")).select("file", F.lower("id").alias("id")).distinct()
    listed = participants.select("participant_id", F.lower("participant_id").alias("id"))
    return listed.join(ids, "id", "left").groupBy("participant_id").agg(F.sort_array(F.collect_set("file")).alias("files"), F.count("file").alias("n"))
