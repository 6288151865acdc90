from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from loomspeak.llm import packing as P
from loomspeak.llm.tokens import size


def test_windows_hold_what_fits():
    rng = np.random.default_rng(1)
    for capacity in (1, 7, 100, 512):
        sizes = rng.integers(1, capacity + 1, 3000)
        for how in (P.pack, P._best_fit):
            window = how(sizes, capacity)
            fill = np.bincount(window, weights=sizes)
            assert fill.max() <= capacity and fill.min() > 0 and len(window) == 3000
    assert P.pack(np.zeros(0, np.int64), 10).tolist() == []


def test_sum_of_squares_wastes_little():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 60, 20_000)
    windows = P.pack(sizes, 100).max() + 1
    assert windows <= 1.02 * sizes.sum() / 100


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, window string"), spark.createDataFrame([("s", 16), ("m", 64), ("bad", 0), (None, 5)], "container string, capacity_tokens int")


def test_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ITEMS", 40)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["red", "lamp", "harbour", "木", "é"]) for _ in range(rng.choice([1, 3, 9, 80])))) for i in range(300)] + [(300, None), (301, ""), (302, "   "), (5, "again"), (None, "no id")]
    df, containers = table(spark, rows)
    out = P.packed(df, containers, "doc_id", "text").collect()
    expected = defaultdict(list)
    for i, t in rows:
        if t:
            expected[i].append(size(t))
    fills = defaultdict(int)
    pieces = defaultdict(list)
    for r in out:
        fills[(r.container, r.window)] += r.n_tokens
        pieces[(r.container, r.id)].append((r.piece, r.first_token, r.n_tokens))
    capacity = {"s": 16, "m": 64, None: 5}
    assert all(f <= capacity[c] for (c, _), f in fills.items())
    assert all(fills[(r.container, r.window)] == r.fill for r in out)
    for c, k in capacity.items():
        for i, sizes in expected.items():
            got = pieces[(c, i)]
            assert sum(n for _, _, n in got) == sum(sizes)
            assert len(got) == sum(-(-s // k) for s in sizes)
            assert all(f == p * k for p, f, _ in got)
    report = {r.container: r for r in P.report(P.packed(df, containers, "doc_id", "text"), containers).collect()}
    assert report["s"].tokens == sum(map(sum, expected.values())) and report["s"].windows <= 1.1 * report["s"].least_windows + 1


def test_equal_rows_above_the_capacity_have_windows_of_their_own(spark):
    text = " ".join(["lamp"] * 40)
    df, containers = table(spark, [(1, text), (1, text), (None, text)])
    fills = defaultdict(int)
    for r in P.packed(df, containers.where("container = 's'"), "doc_id", "text").collect():
        fills[r.window] += r.n_tokens
    assert max(fills.values()) <= 16 and sum(fills.values()) == 3 * size(text)


def test_items_that_nothing_completes_stay_in_their_shards(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ITEMS", 20)
    seen = []
    monkeypatch.setattr(P, "stage", lambda df, name, kept=P.stage: (seen.append(name), kept(df, name))[1])
    df = spark.createDataFrame([(i, "a" + " a" * 9) for i in range(400)], "doc_id long, text string")
    out = P.packed(df, spark.createDataFrame([("c", 16)], "container string, capacity_tokens int"), "doc_id", "text").collect()
    assert len({r.window for r in out}) == 400 and seen.count("windows") == 1


def test_more_than_a_thousand_containers(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    containers = spark.createDataFrame([(f"c{i}", 10 + i) for i in range(1001)], "container string, capacity_tokens int")
    assert len({r.container for r in P.packed(df, containers, "doc_id", "text").collect()}) == 1001


def test_empty(spark):
    df, containers = table(spark, [])
    assert P.packed(df, containers, "doc_id", "text").collect() == []
    df, _ = table(spark, [(1, "a")])
    assert P.packed(df, containers.limit(0), "doc_id", "text").collect() == []


def test_size_of_a_very_long_word():
    assert size("a" * 100_000) > 1000
    around = "the lamp  was   out. " * 1500
    run = "ab" * 10_001
    assert len(run) == 20_002 and abs(size(around + run + " " + around) - 2 * size(around) - size(run[:20_000]) - size(run[20_000:])) <= 2
