"""Similarity baselines of vectors: closed forms over sums, one pass; quantiles by blocks of pairs where asked for."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspeak.runtime import shared_path


def unit(v: Column) -> Column:
    """The vector in doubles by its length; a zero vector stays zero."""
    d = F.transform(v, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is zero."""
    return F.aggregate(F.zip_with(unit(a), unit(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _sums(df: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """By keys: number, and the sums of unit vectors and of their squared lengths."""
    u = df.select(*keys, unit(F.col("v")).alias("u"))
    self_product = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    return u.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("u", F.lit(i))) for i in range(dim)]).alias("s"), F.sum(self_product).alias("own"))


def _mean(n: Column, s: Column, own: Column) -> Column:
    square = F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x)
    return (square - own) / (n * (n - 1))


def _usable(vectors: DataFrame, vector_col: str, dim: int, keys: list[str]) -> DataFrame:
    v = F.col(vector_col)
    return vectors.where((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))).select(*keys, v.alias("v"))


def _square_moment(df: DataFrame, dim: int) -> float:
    """Sum of squared cosines over ordered pairs, itself included: the squared norm of the sum of outer products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((dim, dim))
        for b in batches:
            u = b.column(0).flatten().to_numpy().reshape(-1, dim)
            m += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([m.ravel()], pa.list_(pa.float64()))], names=["m"])

    parts = df.select(unit(F.col("v")).alias("u")).mapInArrow(run, "m array<double>").collect()  # dim squared numbers a partition
    total = np.sum([p.m for p in parts], axis=0)
    return float((total**2).sum())


def overall(vectors: DataFrame, vector_col: str = "embedding", dim: int = 64, quantiles: bool = False) -> DataFrame:
    """(baseline, pairs, mean_similarity, sd[, p05, median, p95]) over all pairs of usable vectors, zero vectors included.

    Mean and deviation come from sums of one pass. quantiles compares all pairs, in blocks against blocks kept in the
    shared folder: quadratic in the number of vectors, so for tables of bounded size.
    """
    spark = vectors.sparkSession
    good = _usable(vectors, vector_col, dim, [])
    one = _sums(good, [], dim).select("n", "own", _mean(F.col("n"), F.col("s"), F.col("own")).alias("mean")).first()
    schema = "baseline string, pairs long, mean_similarity double, sd double" + ", p05 double, median double, p95 double" * quantiles
    if not one or one.n < 2:
        return spark.createDataFrame([], schema)
    pairs = one.n * (one.n - 1) // 2
    fourth = good.select(F.sum(F.pow(F.aggregate(unit(F.col("v")), F.lit(0.0), lambda s, x: s + x * x), 2)).alias("q")).first().q
    squares = (_square_moment(good, dim) - fourth) / 2
    sd = (max(0.0, squares - pairs * one.mean**2) / (pairs - 1)) ** 0.5 if pairs > 1 else None
    row = ["any two", pairs, one.mean, sd]
    if quantiles:
        q = pair_cosines(good, dim).agg(F.percentile("cosine", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q")).first().q
        row += list(q)
    return spark.createDataFrame([tuple(row)], schema)


def pair_cosines(good: DataFrame, dim: int, block: int = 1024) -> DataFrame:
    """(cosine) of all pairs of vectors v, each block of one side read from the shared folder in turn."""
    spark = good.sparkSession
    path = shared_path(spark, "pair-vectors")
    good.select(F.monotonically_increasing_id().alias("i"), unit(F.col("v")).alias("u")).write.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path)
        for b in batches:
            i, u = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, dim)
            for other in ds.dataset(root, filesystem=where, format="parquet").to_batches(batch_size=block):
                j, w = other.column(0).to_numpy(), other.column(1).flatten().to_numpy().reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([pa.array((u @ w.T)[i[:, None] < j[None]])], names=["cosine"])

    return spark.read.parquet(path).mapInArrow(run, "cosine double")


def hashed_words(texts: list[str], dim: int) -> np.ndarray:
    """A plain model: signed counts of lower-case words at hashed places; unlike texts are nearly orthogonal."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            out[i, h % dim] += 1.0 if h & 0x80000000 else -1.0
    return out


def embedded(df: DataFrame, id_col: str, text_col: str, model: Callable[[list[str], int], np.ndarray] = hashed_words, dim: int = 64, batch: int = 512) -> DataFrame:
    """(id, embedding) of every text that isn't null, by a model (texts, dim) -> matrix that workers call on batches of texts."""
    part = df.select(id_col, F.col(text_col).alias("t")).where("t IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), batch):
                some = np.asarray(model(texts[at : at + batch], dim), np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), pa.array(list(some), pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return part.mapInArrow(run, f"{id_col} {dict(part.dtypes)[id_col]}, embedding array<float>")


def by_group(vectors: DataFrame, label: str, vector_col: str = "embedding", dim: int = 64) -> DataFrame:
    """(baseline, groups, pairs, mean_similarity, sd, median, between_groups_mean): pairs within groups of one label.

    mean, sd and median are of the groups' means; null labels take no part, groups of one have no pairs. Between
    groups: all pairs less those within, from sums alone.
    """
    good = _usable(vectors, vector_col, dim, [F.col(label).alias("label")]).where("label IS NOT NULL")
    sums = _sums(good, ["label"], dim)
    square = F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)
    per = sums.select("n", "s", "own", ((square - F.col("own")) / 2).alias("within"), (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    mean = F.when(F.col("n") > 1, F.col("within") / F.col("pairs"))
    out = per.agg(
        F.count(mean).alias("groups"), F.sum(F.when(F.col("n") > 1, F.col("pairs"))).cast("long").alias("pairs"), F.avg(mean).alias("mean_similarity"), F.stddev_samp(mean).alias("sd"),
        F.percentile(mean, F.lit(0.5)).alias("median"), F.sum("within").alias("within"), F.sum("pairs").alias("inside"), F.sum("n").alias("n"), F.sum("own").alias("own"),
        F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(dim)]).alias("s"),
    )
    total, all_pairs = (F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x) - F.col("own")) / 2, F.col("n") * (F.col("n") - 1) / 2
    return out.select(
        F.lit(label).alias("baseline"), "groups", "pairs", "mean_similarity", "sd", "median",
        ((total - F.col("within")) / F.nullif(all_pairs - F.col("inside"), F.lit(0))).alias("between_groups_mean"),
    )
