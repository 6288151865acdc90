"""The same functions on a stream of turns: words by speaker in windows of arrival, repetitions dropped within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspeak.functions import text as T


def speaker_words(turns: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window, speaker, turns, words) of a stream of turns (file, turn_idx, speaker, text, loaded_at).

    A row delivered again within the watermark counts once; later ones are late data and don't count.
    """
    once = turns.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["file", "turn_idx"])
    return once.groupBy(F.window("loaded_at", every), "speaker").agg(F.count("*").alias("turns"), F.sum(F.coalesce(T.n_words(F.col("text")), F.lit(0))).alias("words"))
