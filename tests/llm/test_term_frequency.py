from __future__ import annotations

import unicodedata
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from loomspeak.functions.unicode_words import latin_terms, words
from loomspeak.llm import term_frequency
from loomspeak.llm.term_frequency import found, term_frequency as frequency


def test_terms_of_spellings():
    assert latin_terms("Don’t re‐enter the CAFÉ so­far 木rock'n'roll x--y 'quoted'") == ["don't", "re-enter", "the", "café", "sofar", "rock'n'roll", "x", "y", "quoted"]
    assert words("Zwei 2nd don’t किताब") == ["zwei", "2nd", "don't", "किताब"]
    assert latin_terms("") == [] and latin_terms("12 …") == []


@given(st.text(alphabet="aB'-’ é́​1.", max_size=40))
def test_terms_do_not_depend_on_composition(text):
    assert latin_terms(unicodedata.normalize("NFD", text)) == latin_terms(unicodedata.normalize("NFC", text))


def test_counts_against_brute_force(spark):
    texts = ["a b a", "b c", None, "  ", "", "a-b it’s it's", "a", "x" * 50_000 + " a"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, t string, term string").repartition(3)
    got = {r.term: (r.occurrences, r.records, r.n_records, r.mark) for r in frequency(df, "t").collect()}
    real = [t for t in texts if t and t.strip()]
    occurrences, records = Counter(), Counter()
    for t in real:
        occurrences.update(latin_terms(t))
        records.update(set(latin_terms(t)))
    assert got == {
        w: (n, records[w], len(real), "rare" if records[w] < 3 else "common" if records[w] > 0.2 * len(real) else None) for w, n in occurrences.items()
    }


def test_ids_are_dense_and_in_order(spark):
    df = spark.createDataFrame([(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}",) for i in range(300)], "t string")
    rows = sorted((r.term, r.term_id) for r in frequency(df, "t").collect())
    assert [i for _, i in rows] == list(range(300))


def test_blocks_that_overflow_are_added_up(spark, monkeypatch):
    monkeypatch.setattr(term_frequency, "BLOCK_TERMS", 1)
    df = spark.createDataFrame([("a b",)] * 10, "t string").coalesce(1)
    assert {(r.term, r.occurrences) for r in frequency(df, "t").collect()} == {("a", 10), ("b", 10)}


def test_empty_and_repeated_deliveries(spark):
    empty = spark.createDataFrame([], "answer_id string, loaded_at int, cleaned_reflection string")
    assert found(empty).collect() == []
    twice = spark.createDataFrame([("x", 2, "late words"), ("x", 1, "first"), ("y", 1, None), (None, 1, "first"), (None, 1, "first")], empty.schema)
    assert {(r.term, r.mark) for r in found(twice).collect()} == {("first", "rare")}
