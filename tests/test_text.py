"""Text functions against plain Python statements of the same rules."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from loomspeak.functions import text as T
from tests import fixtures

ALPHABET = list("abcAB é ü ß – — - ' ’ . , ! ? … ( ) [ ] : ; 1 _  ") + ["um", "uh", " hmm ", "laughs", "pause", " the the ", "...", "नि", "\n", "\t", " you know ", " kind of "]


def strings(n=400, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(25))) for _ in range(n)] + [""]


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_clean_text(spark):
    pairs = {
        "Well [laughs) it (a long note) was": "Well it was", "It was . . so , cold , , there": "It was. so, cold, there", "...and then—": "and then", "( ( pause": "", "One. , Two": "One. Two",
        "sighs) no (sighs": "no", "a   b\t\nc": "a b c", "I - you": "I - you", "so -": "so",
    }
    assert dict(zip(pairs, column(spark, list(pairs), T.clean_text))) == pairs
    assert column(spark, ["Um, I, uh, went", "hmm", "Umbrella, uhm"], lambda c: T.clean_text(c, True)) == ["I went", "", "Umbrella"]
    for h in (False, True):
        assert not any(set("()[]") & set(x) for x in column(spark, strings(), lambda c: T.clean_text(c, h)))


def test_counts_match_python(spark):
    s = strings(seed=6)
    assert column(spark, s, T.n_words) == [len(re.findall(r"\w+", x)) for x in s]
    assert column(spark, s, T.n_tokens) == [len(x.split()) for x in s]
    assert column(spark, s, T.split_sentences) == [[p for p in re.split(r"(?<=[.!?…])\s+", x) if p.strip()] for x in s]
    assert column(spark, s, T.n_repetitions) == [len(re.findall(r"\b(\w+)(?:[\s,.-]+\1\b)+", x, re.I)) for x in s]
    assert column(spark, s, T.words) == [re.findall(r"[^\W\d_]+(?:['-][^\W\d_]+)*", x.lower().replace("’", "'")) for x in s]


def test_predicates(spark):
    s = ["I am ready.", "Mhm", "", "Yes, right, okay", "Can you repeat it?", "no", "Let's start now and go ahead please", None]
    assert column(spark, s, T.is_ready) == [True, False, False, True, False, True, False, False]
    assert column(spark, s, T.is_backchannel) == [False, True, True, True, False, False, False, False]
    assert column(spark, s, T.is_question) == [False, False, False, False, True, False, False, False]
    moves = ["Now another scene, please.", "That is another scene.", "The final moment.", "We will get there later, another scene", "scene"]
    assert column(spark, moves, T.is_transition) == [True, False, True, False, False]


def test_join_continuation(spark):
    df = spark.createDataFrame([(["It was...", "… and then -", "– it went."],), (["one"],), ([],)], "t array<string>")
    assert [r.x for r in df.select(T.join_continuation(F.col("t")).alias("x")).collect()] == ["It was and then it went.", "one", None]


def test_small_functions(spark):
    assert column(spark, ["01:02:03", "1:00:00", "x", None], T.to_seconds) == [3723, 3600, None, None]
    assert column(spark, ["Here is a warm word in the middle"], lambda c: T.context(c, F.lit("WARM"), 5)) == ["is a warm word"]
    assert column(spark, ["nothing"], lambda c: T.context(c, F.lit("warm"), 5)) == [None]
    assert column(spark, ["a"], lambda c: T.fingerprint(F.array(c, F.lit("b")))) == [__import__("hashlib").sha256(b"a\0b\0").hexdigest()[:16]]
    got = column(spark, ["You know, kind of well, a kind of joy, as well"], lambda c: F.struct(*[v.alias(k) for k, v in T.filler_counts(c).items()]))[0]
    assert (got.discourse, got.hesitation, got.like) == (3, 0, 0)


def test_golden_cleaning(spark):
    assert column(spark, list(fixtures.RAW), lambda c: T.clean_text(c, True)) == ["I felt sad.", "tense and then relieved", "I felt it", "It was good. And then", "", "I felt a lump."]
