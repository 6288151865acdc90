"""Scene of a text by keywords.

The places of matches have no built-in, so an Arrow function over whole texts gives the stretches that keywords cover. Which
scene they speak for is an aggregate over those rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspeak.config import DEFAULT, Study

STRETCH = "scene string, strong boolean, word string, place int"


def stretches(text: str, lexicon: list[tuple[str, bool, re.Pattern]]) -> list[tuple[str, bool, str, int]]:
    """(scene, strong, word, place) of the keywords that hold a stretch of text.

    Every character belongs to the longest keyword over it: keywords claim their characters in turn, long before short, strong
    before weak, early before late, and one that meets a claimed character is left out.
    """
    claimed = bytearray(len(text))
    claims = ((m.end() - m.start(), strong, -m.start(), -n, m) for n, (_, strong, keywords) in enumerate(lexicon) for m in keywords.finditer(text))
    held = []
    for length, strong, start, n, m in sorted(claims, key=lambda c: c[:4], reverse=True):
        if not any(claimed[m.start() : m.end()]):
            claimed[m.start() : m.end()] = b"\1" * length
            held.append((lexicon[-n][0], strong, m.group().lower(), len(held)))
    return held


def lexicon_of(study: Study) -> list[tuple[str, bool, re.Pattern]]:
    return [(scene, strong, re.compile(rf"\b(?:{'|'.join(words)})\b", re.I)) for scene, (sure, unsure) in study.scenes.items() for strong, words in ((True, sure), (False, unsure)) if words]


def scenes_of(texts: DataFrame, key: str, text_col: str, study: Study = DEFAULT) -> DataFrame:
    """(key, scene, confidence, evidence, present) of every text with a keyword.

    Strong keywords give 2 points, weak ones 1; of equal points the scene whose keyword was held first leads. clear: the leading
    scene has a strong keyword and twice the next one's points, else ambiguous. present: scenes with a strong keyword and at least
    scene_share of the leading points, the best first.
    """
    lexicon = lexicon_of(study)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("scene", pa.string()), ("strong", pa.bool_()), ("word", pa.string()), ("place", pa.int32())]))
        for batch in batches:
            found = [[dict(zip(("scene", "strong", "word", "place"), s)) for s in stretches(t or "", lexicon)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[key, "found"])

    part = texts.select(key, F.col(text_col).alias("t"))
    found = part.mapInArrow(run, f"{key} {dict(part.dtypes)[key]}, found array<struct<scene: string, strong: boolean, word: string, place: int>>")
    points = found.select(key, F.inline("found")).groupBy(key, "scene").agg(
        F.sum(F.when(F.col("strong"), 2).otherwise(1)).alias("points"), F.min("place").alias("first"), F.bool_or("strong").alias("sure"),
        F.array_join(F.array_sort(F.collect_set("word")), ", ").alias("words"),
    )
    ranked = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("rank"), "first", "scene", "sure", "words"))).alias("r"))
    lead, runner_up = F.element_at("r", 1), F.get("r", F.lit(1))
    shown = F.transform(F.slice("r", 1, 3), lambda x: F.format_string("%s=%d (%s)", x["scene"], -x["rank"], x["words"]))
    return ranked.select(
        key, lead["scene"].alias("scene"), F.when(lead["sure"] & (lead["rank"] <= 2 * F.coalesce(runner_up["rank"], F.lit(0))), "clear").otherwise("ambiguous").alias("confidence"),
        F.array_join(shown, "; ").alias("evidence"), F.transform(F.filter("r", lambda x: x["sure"] & (x["rank"] <= study.scene_share * lead["rank"])), lambda x: x["scene"]).alias("present"),
    )


def moment1_scenes(turns: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """(file, scene, confidence, evidence, present) of moment 1: its first scene_turns turns with content, else all of it, as 'weak'."""
    content = turns.where("moment = 1 AND NOT evocation AND NOT backchannel AND NOT (is_participant AND asks)")
    numbered = content.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("turn_idx")))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"]), " ")
    both = numbered.groupBy("file").agg(
        joined(F.when(F.col("nth") <= study.scene_turns, F.struct("turn_idx", "text"))).alias("head"), joined(F.struct("turn_idx", "text")).alias("whole")
    ).select(F.explode(F.array(F.struct("file", F.lit(True).alias("early"), F.col("head").alias("t")), F.struct("file", F.lit(False).alias("early"), F.col("whole").alias("t")))).alias("x")).select(F.struct("x.file", "x.early").alias("part"), "x.t")
    found = scenes_of(both, "part", "t", study).select("part.file", "part.early", "scene", "confidence", "evidence", "present")
    of = found.groupBy("file").agg(F.max_by(F.struct("early", "scene", "confidence", "evidence", "present"), "early").alias("s"))  # the first turns before the whole
    return content.select("file").distinct().join(of, "file", "left").select(
        "file", F.coalesce("s.scene", F.lit("unknown")).alias("scene"),
        F.when(F.col("s.scene").isNull(), "none").when(F.col("s.early"), F.col("s.confidence")).otherwise("weak").alias("confidence"),
        F.coalesce("s.evidence", F.lit("")).alias("evidence"), F.coalesce("s.present", F.array().cast("array<string>")).alias("present"),
    )
