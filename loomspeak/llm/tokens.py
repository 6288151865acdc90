"""Sizes of texts in tokens of a public tokenizer, read from a vocabulary file whose path is a parameter."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where executors find the vocabulary: lines of a token in base64 and its rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before this vocabulary's merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer runs without a blank are encoded in pieces of so many characters, so that no text takes quadratic time.
RUN = 20_000
_LONG = re.compile(rf"\S{{{RUN + 1},}}")


@functools.cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def size(text: str, path: str = VOCABULARY) -> int:
    """Tokens of the whole text; a run of more than RUN characters without a blank counts in pieces, the text around it as it is."""
    enc = encoding(path)
    if len(text) <= RUN:
        return len(enc.encode_ordinary(text))
    n, at = 0, 0
    for m in _LONG.finditer(text):
        begin = m.start() - (m.start() > at and text[m.start() - 1] == " ")  # a single blank belongs to the word after it
        n += len(enc.encode_ordinary(text[at:begin])) + sum(len(enc.encode_ordinary(text[i : min(i + RUN, m.end())])) for i in range(begin, m.end(), RUN))
        at = m.end()
    return n + len(enc.encode_ordinary(text[at:]))


def token_sizes(df: DataFrame, id_col: str, text_col: str, more: tuple[str, ...] = (), path: str = VOCABULARY) -> DataFrame:
    """(id, salt, n_tokens, *more) of every text with a token; salt is a hash of id and text that tells rows apart evenly."""
    part = df.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("salt"), F.col(text_col).alias("t"), *more).where("t IS NOT NULL AND t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([size(t, path) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, *batch.columns[3:]], names=["id", "salt", "n_tokens", *more])

    types = dict(part.dtypes)
    return part.mapInArrow(run, ", ".join([f"id {types['id']}", "salt long", "n_tokens long", *(f"{m} {types[m]}" for m in more)]))
