"""Mixing sources to target weights: cube-method balanced sampling of the documents of every source.

A source's tokens times its number of repeats is what it can give at most. From the target shares follows how often each
source is to be used on average: the whole part of it every document is used, for the fraction documents are drawn with equal
probability. The cube method draws them balanced: probabilities move along directions that change neither the
number of documents nor the number of tokens until each is 0 or 1. A task moves the documents of one shard of one source, three
at a time; the two or three that remain undecided in every shard go on, with those of the source's other shards, until
a last few are decided by the outcome nearest to the wanted tokens (the landing).
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspeak.llm.tokens import VOCABULARY, token_sizes
from loomspeak.runtime import stage

SHARD_DOCUMENTS = 50_000
#: Sources with a target: a fixed table of few rows; more is refused.
MAX_SOURCES = 10_000
RESERVE = 400
EXCHANGES = 6


def normal_source(c):
    """A source's name however written: lower case, without outer blanks, one underscore for blanks and hyphens."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " "))), r"[\s\-‐-―]+", "_")


def flight(probabilities: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved through the null space of (count, tokens) until at most three lie strictly between 0 and 1."""
    p = probabilities.astype(float).tolist()
    t = tokens.astype(float).tolist()
    eps = 1e-9
    held: list[int] = []
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    for i in range(len(p)):
        if eps < p[i] < 1 - eps:
            held.append(i)
        while len(held) == 3:
            a, b, c = held
            # The direction orthogonal to (1, 1, 1) and to the three sizes.
            u = (t[c] - t[b], t[a] - t[c], t[b] - t[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min(((1 - p[k]) / d if d > 0 else p[k] / -d) for k, d in zip(held, u) if d)
            down = min((p[k] / d if d > 0 else (1 - p[k]) / -d) for k, d in zip(held, u) if d)
            step = up if next(draws) * (up + down) < down else -down
            for k, d in zip(held, u):
                p[k] += step * d
                if p[k] < eps:
                    p[k] = 0.0
                elif p[k] > 1 - eps:
                    p[k] = 1.0
            held = [k for k in held if 0 < p[k] < 1]
    return np.array(p)


def landing(probabilities: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The last few decided: the outcome nearest to the expected tokens, then documents."""
    free = np.flatnonzero((probabilities > 0) & (probabilities < 1))
    want, count = float((probabilities[free] * tokens[free]).sum()), float(probabilities[free].sum())
    best = min(itertools.product((0.0, 1.0), repeat=len(free)), key=lambda x: (abs(float((np.array(x) * tokens[free]).sum()) - want), abs(sum(x) - count), x))
    out = probabilities.copy()
    out[free] = best
    return out


def exchange(drawn: np.ndarray, free: np.ndarray, tokens: np.ndarray, missing: float) -> np.ndarray:
    """Exchanges pairs of a drawn and an undrawn unit, of those that are free, while that brings the tokens nearer."""
    out = drawn.copy()
    for _ in range(EXCHANGES):
        on, off = np.flatnonzero(free & (out == 1)), np.flatnonzero(free & (out == 0))
        if not len(on) or not len(off):
            break
        left = np.abs(missing - (tokens[off][None] - tokens[on][:, None]))
        i, j = np.unravel_index(left.argmin(), left.shape)
        if left[i, j] >= abs(missing):
            break
        missing -= float(tokens[off[j]] - tokens[on[i]])
        out[on[i]], out[off[j]] = 0, 1
    return out


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: int | None) -> dict[str, float]:
    """Tokens wanted of every source.

    Without total_tokens the largest total for which every source that has tokens reaches its share: targets of sources
    without any are spread over the others in proportion. With it, sources give at most their tokens times
    max_repeats and the others share what is missing in proportion to their targets, as far as they can.
    """
    usable = {s: (w, available.get(s, 0) * m) for s, (w, m) in targets.items() if w > 0 and available.get(s, 0) * m > 0}
    if not usable:
        return {}
    weight = sum(w for w, _ in usable.values())
    if total_tokens is None:
        total = min(most * weight / w for w, most in usable.values())
        return {s: total * w / weight for s, (w, _) in usable.items()}
    left, out, open_ = float(total_tokens), {}, dict(usable)
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = {s: most for s, (w, most) in open_.items() if left * w / weight >= most}
        if not full:
            return out | {s: left * w / weight for s, (w, _) in open_.items()}
        out |= {s: float(most) for s, most in full.items()}
        left -= sum(full.values())
        open_ = {s: v for s, v in open_.items() if s not in full}
    return out


def mixture(
    df: DataFrame, targets: DataFrame, id_col: str, source_col: str, text_col: str, total_tokens: int | None = None, seed: int = 17, vocabulary: str = VOCABULARY
) -> DataFrame:
    """(id, source, n_tokens, copies): the documents drawn, and how often each is used, at most max_repeats times.

    Source names are compared in normal form. Documents of a null source or one without target, and null or empty texts,
    aren't drawn. Repeated ids and texts are documents of their own. A source whose documents can't give its share gives what
    it can. Rows of one source in targets: the first by share and repeats counts, null shares and repeats are 0. Empty
    tables give no rows. Other columns aren't read. The same input gives the same draw.
    """
    spark = df.sparkSession
    named = df.select(F.col(id_col).alias("id"), normal_source(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    sizes = stage(token_sizes(named.where("source IS NOT NULL"), "id", "text", ("source",), vocabulary).where("n_tokens > 0"), "mixing-sizes")
    rows = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    goal: dict[str, tuple[float, int]] = {}
    for r in sorted(rows, key=lambda r: (r.source, r.target_share or 0, r.max_repeats or 0)):
        goal.setdefault(r.source, (float(r.target_share or 0), int(r.max_repeats or 0)))
    of_target = sizes.where(F.col("source").isin(list(goal)))
    sums = {r.source: (r.tokens, r.n) for r in of_target.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    wanted = plan({s: t for s, (t, _) in sums.items()}, goal, total_tokens)
    schema = f"id {dict(sizes.dtypes)['id']}, source string, n_tokens long, copies long"
    if not wanted:
        return spark.createDataFrame([], schema)
    rate = {s: min(float(goal[s][1]), w / sums[s][0]) for s, w in wanted.items()}
    rows = [
        (s, int(r + 1e-9), r - int(r + 1e-9) if r - int(r + 1e-9) > 1e-9 else 0.0, max(1, -(-sums[s][1] // SHARD_DOCUMENTS)), max(1, sums[s][1] // RESERVE))
        for s, r in rate.items()
    ]
    rates = F.broadcast(spark.createDataFrame(rows, "source string, base long, chance double, shards long, one_in long"))  # at most MAX_SOURCES rows
    units = of_target.join(rates, "source").withColumn(
        "shard", F.when(F.pmod(F.xxhash64("salt"), F.col("one_in")) == 0, F.lit(-1)).otherwise(F.pmod("salt", F.col("shards")))
    )
    unit = f"source string, shard long, id {dict(sizes.dtypes)['id']}, salt long, n_tokens long, base long, chance double"

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["shard", "salt", "id"], ignore_index=True)
        rng = np.random.default_rng([seed, int(pdf["shard"].iloc[0]) + 1, int(pdf["salt"].iloc[0]) & 0xFFFFFFFF])
        pdf["chance"] = flight(pdf.chance.to_numpy(), pdf.n_tokens.to_numpy(), rng)
        return pdf

    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        want = float((pdf.chance * pdf.n_tokens).sum())
        pdf = fly(pdf)
        drawn, tokens = landing(pdf.chance.to_numpy(), pdf.n_tokens.to_numpy()), pdf.n_tokens.to_numpy()
        pdf["chance"] = exchange(drawn, (pdf["shard"] == -1).to_numpy(), tokens, want - float((drawn * tokens).sum()))
        return pdf

    names = [x.split()[0] for x in unit.split(", ")]
    reserve = units.where("shard = -1").select(names)
    flown = stage(units.where("shard >= 0").select(names).groupBy("source", "shard").applyInPandas(fly, unit), "flown")
    open_ = flown.where("chance > 0 AND chance < 1")
    shards = max(r[3] for r in rows)
    decided = [flown.where("chance <= 0 OR chance >= 1")]
    while shards > 20_000:  # two or three undecided a shard: again in shards while they are too many for one task
        shards = -(-shards // 10_000)
        again = stage(open_.withColumn("shard", F.pmod("salt", F.lit(shards))).groupBy("source", "shard").applyInPandas(fly, unit), "flown")
        decided.append(again.where("chance <= 0 OR chance >= 1"))
        open_ = again.where("chance > 0 AND chance < 1")
    decided.append(open_.union(reserve).groupBy("source").applyInPandas(end, unit))
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out.select("id", "source", "n_tokens", (F.col("base") + F.col("chance").cast("long")).alias("copies")).where("copies > 0")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, copies, tokens, share, most_repeats): what every target really got."""
    got = drawn.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_repeats")
    )
    total = got.agg(F.sum("tokens").alias("total"))
    goal = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        goal.join(got, "source", "left").crossJoin(F.broadcast(total))  # one row
        .select("source", "target_share", "max_repeats", zero("documents"), zero("copies"), zero("tokens"), F.round(F.coalesce("tokens", F.lit(0)) / F.col("total"), 6).alias("share"), zero("most_repeats"))
    )
