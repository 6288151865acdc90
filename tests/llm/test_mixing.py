from __future__ import annotations

import random

import numpy as np
import pytest

from loomspeak.llm import mixing as M


def test_flight_keeps_number_and_tokens():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 500, 2000)
    out = M.flight(np.full(2000, 0.37), tokens, rng)
    assert ((out > 0) & (out < 1)).sum() <= 3
    assert out.sum() == pytest.approx(740, abs=1e-6) and (out * tokens).sum() == pytest.approx(0.37 * tokens.sum(), rel=1e-9)
    assert M.flight(np.zeros(0), np.zeros(0), rng).tolist() == []
    same = M.flight(np.full(10, 0.5), np.full(10, 4), rng)
    assert same.sum() == pytest.approx(5)


def test_every_unit_is_drawn_with_its_probability():
    tokens = np.array([5, 9, 14, 3, 8, 40, 2, 6, 7, 30])
    total = np.zeros(10)
    for i in range(3000):
        rng = np.random.default_rng(i)
        out = M.flight(np.full(10, 0.3), tokens, rng)
        total += out
    assert np.abs(total / 3000 - 0.3).max() < 0.04


def test_landing_and_exchange():
    assert M.landing(np.array([1.0, 0.5, 0.5]), np.array([9, 10, 30])).tolist() in ([1, 0, 1], [1, 1, 0])
    drawn = M.exchange(np.array([1.0, 0.0, 0.0]), np.array([True, True, True]), np.array([5, 7, 20]), 2.0)
    assert drawn.tolist() == [0, 1, 0]


def test_plan():
    targets = {"a": (0.5, 1), "b": (0.25, 2), "c": (0.25, 4), "none": (0.1, 1)}
    got = M.plan({"a": 1000, "b": 1000, "c": 20}, targets, None)
    assert got["c"] == pytest.approx(80) and got["a"] == pytest.approx(160) and "none" not in got
    full = M.plan({"a": 1000, "b": 1000, "c": 20}, targets, 1200)
    assert full["c"] == 80 and sum(full.values()) == pytest.approx(1200) and full["a"] == pytest.approx(2 * full["b"])
    assert M.plan({}, targets, None) == {}


def frames(spark, n):
    rng = random.Random(5)
    rows = [(i, rng.choice(["Big-Source", " big_source", "small source", "MIDDLE"]) if i % 50 else "small source", " ".join(["word"] * rng.randrange(1, 60))) for i in range(n)]
    rows += [(n, None, "no source"), (n + 1, "other", "no target"), (n + 2, "middle", None), (n + 3, "middle", "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, copies int")
    targets = spark.createDataFrame([("big_source", 0.6, 1), ("middle", 0.3, 1), ("small_source", 0.1, 3), ("empty", 0.2, 2)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_shares_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_DOCUMENTS", 300)
    docs, targets = frames(spark, 4000)
    drawn = M.mixture(docs, targets, "doc_id", "source", "text")
    rows = drawn.collect()
    assert len({r.id for r in rows}) == len(rows)
    got = {r.source: r for r in M.shares(drawn, targets).collect()}
    for s, share in (("big_source", 0.6), ("middle", 0.3), ("small_source", 0.1)):
        assert got[s].share == pytest.approx(share, rel=0.005)
        assert got[s].most_repeats <= got[s].max_repeats
    assert (got["empty"].tokens, got["empty"].share) == (0, 0.0)
    assert sorted((r.id, r.copies) for r in M.mixture(docs, targets, "doc_id", "source", "text").collect()) == sorted((r.id, r.copies) for r in rows)


def test_small_source_at_its_cap(spark):
    docs, targets = frames(spark, 600)
    drawn = M.mixture(docs, targets, "doc_id", "source", "text", total_tokens=10**7).collect()
    assert {(r.source, r.copies) for r in drawn} == {("big_source", 1), ("middle", 1), ("small_source", 3)}


def test_empty(spark):
    docs, targets = frames(spark, 0)
    assert M.mixture(docs.limit(0), targets, "doc_id", "source", "text").collect() == []
    assert M.mixture(docs, targets.limit(0), "doc_id", "source", "text").collect() == []
