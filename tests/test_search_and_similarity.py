from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from loomspeak.config import TopicModel
from loomspeak.operators import quality, search, similarity

TRIAL = "trial_number int, n_topics int, n_components int, n_neighbors int, min_dist double, min_cluster_size int, min_samples int, embedding_coherence double, objective_cv double"


def test_front_against_brute_force(spark):
    rng = random.Random(2)
    for size in (1, 3, 40):
        rows = [(i, 5, 5, 5, 0.1, 5, 1, rng.randrange(6) / 10, rng.randrange(6) / 10) for i in range(size)] + [(900, 5, 5, 5, 0.1, 5, 1, None, 0.9), (0, 9, 9, 5, 0.1, 5, 1, 0.0, 0.0)]
        got = {r.trial_number: r.on_front for r in search.on_front(search.scored(spark.createDataFrame(rows, TRIAL))).collect()}
        best = {}
        for r in rows:
            if r[7] is not None and (r[0] not in best or (r[8], r[7]) > best[r[0]]):
                best[r[0]] = (r[8], r[7])
        want = {i: not any(o != s and o[0] >= s[0] and o[1] >= s[1] for o in best.values()) for i, s in best.items()}
        assert got == want


def test_front_lists_equal_settings_once_and_marks_the_balanced(spark):
    rows = [(0, 5, 5, 5, 0.1, 5, 1, 0.1, 0.9), (1, 5, 5, 5, 0.1, 5, 1, 0.1, 0.9), (2, 5, 5, 5, 0.1, 5, 1, 0.6, 0.6), (3, 5, 5, 5, 0.1, 5, 1, 0.9, 0.1)]
    front = search.pareto_front(spark.createDataFrame(rows, TRIAL), baseline=0.5).orderBy("solution").collect()
    assert [(r.trial_number, r.balanced, r.above_baseline) for r in front] == [(0, False, False), (2, True, True), (3, False, True)]


def test_similarity_closed_forms(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 8))
    x[3] = 0
    labels = [None if i == 0 else "once" if i == 1 else f"g{i % 3}" for i in range(30)]
    df = spark.createDataFrame([(i, [float(v) for v in row], labels[i]) for i, row in enumerate(x)] + [(99, None, "g1"), (98, [1.0], "g1")], "i int, embedding array<float>, label string")
    u = x.astype(np.float32).astype(float)
    n = np.linalg.norm(u, axis=1, keepdims=True)
    u = u / np.where(n == 0, 1, n)
    s = u @ u.T
    pairs = [s[i, j] for i, j in itertools.combinations(range(30), 2)]
    got = similarity.overall(df, dim=8, quantiles=True).first()
    assert got.pairs == len(pairs)
    assert [got.mean_similarity, got.sd, got.p05, got.median, got.p95] == pytest.approx([np.mean(pairs), np.std(pairs, ddof=1), *np.percentile(pairs, [5, 50, 95])], abs=1e-9)
    means, within, across = [], 0, []
    for g in ("g0", "g1", "g2"):
        own = [i for i in range(30) if labels[i] == g]
        p = [s[i, j] for i, j in itertools.combinations(own, 2)]
        means.append(np.mean(p))
        within += len(p)
    for i, j in itertools.combinations(range(1, 30), 2):
        if labels[i] != labels[j]:
            across.append(s[i, j])
    group = similarity.by_group(df, "label", dim=8).first()
    assert (group.groups, group.pairs) == (3, within)
    assert [group.mean_similarity, group.sd, group.median, group.between_groups_mean] == pytest.approx([np.mean(means), np.std(means, ddof=1), np.median(means), np.mean(across)], abs=1e-9)
    assert similarity.overall(df.limit(0), dim=8).collect() == []


def test_topic_terms(spark):
    df = spark.createDataFrame([("a", "red car"), ("a", "red"), ("b", "blue car"), ("b", None), (None, "red")], "topic string, t string")
    rows = {(r.topic, r.term): r for r in search.topic_terms(df, "topic", "t", TopicModel()).collect()}
    assert rows[("a", "red")]["count"] == 2 and rows[("a", "red")].place == 1 and ("b", "blue car") in rows


def test_totals_and_describe(spark):
    df = spark.createDataFrame([("p", 1, True, 10), ("p", 2, False, 10), ("q", 1, False, 0)], "participant_id string, moment int, kept boolean, n_words int")
    got = {(r.participant_id, r.moment): (r.words_all, r.words_kept, r.retention) for r in quality.totals(df).collect()}
    assert got == {("p", "1"): (10, 10, 1.0), ("p", "2"): (10, 0, 0.0), ("p", "3"): (0, 0, None), ("p", "all"): (20, 10, 0.5)} | {("q", m): (0, 0, None) for m in ("1", "2", "3", "all")}
    d = quality.describe(df, "n_words").first()
    assert (d.n, d.median, d.min, d.max) == (3, 10.0, 0, 10)
