"""Frequency of every distinct term: global integer dictionary, encoded terms, blockwise count arrays.

1. Each block of records is read once and reduced to its own terms with two counts: occurrences, and records
   holding the term (map-side combine; nothing else of the text is shuffled).
2. The global dictionary numbers the distinct terms: they are sorted by range, each range knows how many terms the
   ranges before it hold, so a term's id is its range's offset plus its place. Only one number a range reaches the driver.
3. Blocks are encoded by the dictionary and their counts are added into arrays over ranges of identifiers.
   A range has RANGE ids, so an array is of a fixed size however frequent its terms are. A hot term is at
   most one row a block, so a term that every record holds is no hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspeak.functions.unicode_words import latin_terms
from loomspeak.runtime import stage

#: Identifiers in one count array.
RANGE = 1 << 14
#: A block's own terms are given out once there are so many, so that a block's memory is bounded.
BLOCK_TERMS = 200_000


def block_counts(texts: DataFrame, text_col: str, tokenize: Callable[[str], list[str]]) -> DataFrame:
    """(term, occurrences, records, n_records) by block; a row with a null term carries the block's number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: Counter = Counter()
        records: Counter = Counter()
        n = 0

        def out() -> pa.RecordBatch:
            terms = list(occurrences)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(terms, pa.string()),
                    pa.array([occurrences[t] for t in terms], pa.int64()),
                    pa.array([records[t] for t in terms], pa.int64()),
                    pa.array([0] * len(terms), pa.int64()),
                ],
                names=["term", "occurrences", "records", "n_records"],
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text is None or not text.strip():
                    continue
                n += 1
                found = tokenize(text)
                occurrences.update(found)
                records.update(set(found))
            if len(occurrences) > BLOCK_TERMS:
                yield out()
                occurrences.clear()
                records.clear()
        yield out()
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([n], pa.int64())],
            names=["term", "occurrences", "records", "n_records"],
        )

    return texts.select(F.col(text_col)).mapInArrow(run, "term string, occurrences long, records long, n_records long")


def dictionary(terms: DataFrame) -> DataFrame:
    """(term, term_id): ids 0, 1, … in byte order of the distinct non-null terms."""
    ranged = stage(
        terms.where("term IS NOT NULL").select("term").distinct().repartitionByRange("term").sortWithinPartitions("term")
        .select("term", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")),
        "dictionary",
    )
    sizes = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, offsets = 0, {}
    for part, n in sizes:
        offsets[part] = before
        before += n
    if not offsets:
        return ranged.select("term", F.lit(0).cast("long").alias("term_id"))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("part"))
    return ranged.select("term", (offset + F.col("place")).cast("long").alias("term_id"))


def _sum_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds (range, slots, occurrences, records) into one pair of arrays a range; a task holds the arrays of its ranges."""
    arrays: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, occ, rec = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for r in np.unique(ids // RANGE):
            mine = ids // RANGE == r
            into = arrays.setdefault(int(r), np.zeros((2, RANGE), np.int64))
            np.add.at(into[0], ids[mine] % RANGE, occ[mine])
            np.add.at(into[1], ids[mine] % RANGE, rec[mine])
    for r, both in arrays.items():
        slots = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots + r * RANGE), pa.array(both[0][slots]), pa.array(both[1][slots])],
            names=["term_id", "occurrences", "records"],
        )


def term_frequency(
    texts: DataFrame,
    text_col: str,
    rare_below: int = 3,
    common_above: float = 0.2,
    tokenize: Callable[[str], list[str]] = latin_terms,
) -> DataFrame:
    """(term_id, term, occurrences, records, n_records, mark) of every distinct term.

    records is the number of records holding the term, n_records that of all records with a text that isn't null or
    blank. mark is 'rare' below rare_below records, else 'common' above the share common_above, else null.
    Null and blank texts are no records; an empty table gives no rows; other columns, whatever their names, aren't read.
    """
    blocks = stage(block_counts(texts, text_col, tokenize), "term-blocks")
    terms = stage(dictionary(blocks), "term-ids")
    encoded = (
        blocks.where("term IS NOT NULL").join(terms, "term").select("term_id", "occurrences", "records")
        .repartition((F.col("term_id") / RANGE).cast("long"))
    )
    sums = encoded.mapInArrow(_sum_arrays, "term_id long, occurrences long, records long")
    n_records = blocks.where("term IS NULL").agg(F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_records"))
    return (
        sums.join(terms, "term_id").crossJoin(F.broadcast(n_records))  # one row
        .select(
            "term_id", "term", "occurrences", "records", "n_records",
            F.when(F.col("records") < rare_below, "rare")
            .when(F.col("records") > F.col("n_records") * F.lit(common_above), "common").alias("mark"),
        )
    )


SCHEMA = T.StructType([T.StructField("term", T.StringType()), T.StructField("mark", T.StringType())])


def found(answers: DataFrame) -> DataFrame:
    """p5_found: (term, mark) of the marked terms of the answers, each answer_id counted once by its first delivery."""
    from loomspeak.runtime import first_delivery

    once = first_delivery(answers.select("answer_id", "loaded_at", "cleaned_reflection"), ["answer_id"], ["loaded_at"])
    return term_frequency(once, "cleaned_reflection").where("mark IS NOT NULL").select("term", "mark")
