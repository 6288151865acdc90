"""Filling fixed-capacity containers with texts: sum-of-squares online packing.

A text larger than the capacity is cut: its full pieces fill containers of their own and the rest is an item like any other.
Items are dealt by hash into shards of about SHARD_ITEMS, so that a task holds a bounded number of them. Within a shard
items come one after another and each goes to the fill level that leaves the sum of squared numbers of windows at a level
smallest, kept in an array by level: this keeps no level crowded, so later items find a level that they complete. What the
shards leave in windows filled below CLOSED is taken out again, dealt into as few shards of SHARD_ITEMS as hold it, and packed
largest first, and so on until one shard is left. Where a round leaves so much that the number of shards doesn't shrink, as with
items that no others complete, its windows stay: another round would change nothing and no task may hold them all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspeak.llm.tokens import VOCABULARY, token_sizes
from loomspeak.runtime import stage

SHARD_ITEMS = 20_000
CLOSED = 0.97


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, in the order given; sizes are from 1 to capacity."""
    counts = np.zeros(capacity + 1, np.int64)  # windows at a level; level 0 and a full window count for nothing
    twice = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    windows = 0
    far = np.iinfo(np.int64).max // 4
    for i, s in enumerate(sizes.tolist()):
        # Placing at level h changes the sum of squares by -(2 N[h] - 1) + (2 N[h + s] + 1); a new window by 2 N[s] + 1.
        change = np.where(counts[: capacity - s + 1] > 0, twice[s:] - twice[: capacity - s + 1] + 2, far)
        change[0] = twice[s] + 1
        if s <= capacity and counts[capacity - s]:
            change[capacity - s] = -twice[capacity - s] + 1  # completes a window
        if s == capacity:
            change[0] = 0
        h = len(change) - 1 - int(change[::-1].argmin())  # of equal changes the fullest level
        if h == 0:
            window, windows = windows, windows + 1
        else:
            window = open_at[h].pop()
            counts[h] -= 1
            twice[h] -= 2
        out[i] = window
        level = h + s
        if level < capacity:
            counts[level] += 1
            twice[level] += 2
            open_at[level].append(window)
    return out


def _best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Largest first, each into the fullest window that takes it."""
    out = np.empty(len(sizes), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, bool)
    windows = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        levels = np.flatnonzero(filled[1 : capacity - s + 1])
        if len(levels):
            h = int(levels[-1]) + 1
            window = open_at[h].pop()
            filled[h] = bool(open_at[h])
        else:
            h, window, windows = 0, windows, windows + 1
        out[i] = window
        if h + s < capacity:
            open_at[h + s].append(window)
            filled[h + s] = True
    return out


def _round(level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one shard of one container: online in the first round, largest first in the later ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["salt", "id", "piece"], ignore_index=True)
        sizes = pdf.n_tokens.to_numpy()
        window = (pack if level == 0 else _best_fit)(sizes, int(pdf.capacity.iloc[0]))
        pdf["window"] = [f"{level}-{pdf['shard'].iloc[0]}-{w}" for w in window]
        pdf["fill"] = np.bincount(window, weights=sizes).astype(np.int64)[window]
        return pdf

    return run


ITEM = "container string, capacity long, shard long, id {id}, salt long, piece long, first_token long, n_tokens long"


def packed(df: DataFrame, containers: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container, window, id, piece, first_token, n_tokens, fill): every token of every text in one window of each container.

    piece counts a text's pieces from 0 and first_token is where it begins; an uncut text is piece 0 from 0. fill is the
    tokens of the whole window. Null and empty texts have no tokens and no row, blank texts have; repeated texts and
    repeated ids are items of their own; containers of a capacity below 1 or null are left out; an empty table gives no
    rows. Other columns aren't read. Tokens and windows are the same in every run.
    """
    spark = df.sparkSession
    sizes = stage(token_sizes(df, id_col, text_col, path=vocabulary), "token-sizes")
    # The containers are settings, a few rows that make the plan.
    kinds = [(r.container, int(r.capacity_tokens)) for r in containers.select("container", "capacity_tokens").distinct().collect() if r.capacity_tokens and r.capacity_tokens > 0]
    item = ITEM.format(id=dict(sizes.dtypes)["id"])
    columns = [x.split()[0] for x in item.split(", ")]
    if not kinds:
        return spark.createDataFrame([], f"container string, window string, id {dict(sizes.dtypes)['id']}, piece long, first_token long, n_tokens long, fill long")
    shards = {c: max(1, -(-sizes.count() // SHARD_ITEMS)) for c, _ in kinds}
    each = F.explode(F.array(*[F.struct(F.lit(c).cast("string").alias("container"), F.lit(k).cast("long").alias("capacity"), F.lit(shards[c]).alias("shards")) for c, k in kinds])).alias("c")
    pieces = sizes.select("id", "salt", F.col("n_tokens").alias("all"), each).select("c.*", "id", "salt", "all")
    cut = pieces.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("all") - 1) / F.col("capacity")).cast("long"))).alias("piece")
    ).select(
        "container", "capacity", F.pmod("salt", F.col("shards").cast("long")).alias("shard"), "id", "salt", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"),
        F.least("capacity", F.col("all") - F.col("piece") * F.col("capacity")).alias("n_tokens"),
    )
    alike = Window.partitionBy("container", "salt", "id", "piece").orderBy("first_token")  # rows equal in id and text
    whole = cut.where("n_tokens = capacity").select(
        "container", F.concat_ws("-", F.lit("full"), F.hex("salt"), F.coalesce(F.col("id").cast("string"), F.lit("")), "piece", F.row_number().over(alike)).alias("window"),
        "id", "piece", "first_token", "n_tokens", F.col("capacity").alias("fill"),
    )
    items = cut.where("n_tokens < capacity")
    kept, level = [whole], 0
    while True:
        done = stage(items.groupBy("container", "shard").applyInPandas(_round(level), item + ", window string, fill long"), "windows")
        open_ = F.col("fill") < F.col("capacity") * F.lit(CLOSED)
        left = {r.container: r.n for r in done.where(open_).groupBy("container").agg(F.count("*").alias("n")).collect()}
        following = {c: -(-left.get(c, 0) // SHARD_ITEMS) for c in shards}
        again = {c: n for c, n in following.items() if n and (n < shards[c] or level == 0 and shards[c] == 1)}
        onward = F.coalesce(*[F.when(F.col("container").eqNullSafe(c), n) for c, n in again.items()], F.lit(0))
        moves = open_ & (onward > 0)
        kept.append(done.where(~moves).select("container", "window", "id", "piece", "first_token", "n_tokens", "fill"))
        if not again:
            break
        items = done.where(moves).withColumn("shard", F.pmod("salt", onward).cast("long")).select(*columns)
        shards, level = again, level + 1
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def report(windows: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, capacity_tokens, windows, least_windows, tokens, fill_share, texts, cut_texts) of packed()."""
    per_window = windows.groupBy("container", "window").agg(F.sum("n_tokens").alias("tokens"))
    used = per_window.groupBy("container").agg(F.count("*").alias("windows"), F.sum("tokens").alias("tokens"))
    cut = windows.groupBy("container").agg(F.count_if(F.col("piece") == 0).alias("texts"), F.count_if(F.col("piece") == 1).alias("cut_texts"))
    return (
        containers.select("container", "capacity_tokens").distinct().join(used, "container").join(cut, "container")
        .select(
            "container", "capacity_tokens", "windows", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_windows"), "tokens",
            F.round(F.col("tokens") / (F.col("windows") * F.col("capacity_tokens")), 5).alias("fill_share"), "texts", "cut_texts",
        )
    )
