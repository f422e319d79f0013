"""A large group of near copies is one component before shingles are joined, and rounds end when they no longer help."""

from __future__ import annotations

import random

import corpus_pipeline
from hourmark.llm import nearcopies
from test_pipeline_wholeness import _changed, _kept


def _texts():
    """Near copies of which half the pairs are 0.8 alike, and texts that share halves with many others but are no copies."""
    rng = random.Random(3)
    noise = lambda n: " ".join(f"w{rng.randint(0, 30000)}" for _ in range(n))
    hub = noise(300)
    group = [_changed(rng, hub, rng.randint(1, 5)) for _ in range(80)]
    left, right = [noise(40) for _ in range(6)], [noise(40) for _ in range(6)]
    return group, [f"{a} {b}" for a in left for b in right]


def test_large_group_needs_few_rounds_and_few_listed_pairs(spark, make_docs, monkeypatch):
    calls, alike = [], nearcopies._alike
    monkeypatch.setattr(nearcopies, "_alike", lambda pairs, sets: calls.append(pairs.count()) or alike(pairs, sets))
    group, halves = _texts()
    common = " ".join(f"c{k}" for k in range(88))
    late = [f"{common} " + " ".join(f"own{k}x{i}" for i in range(16)) for k in range(40)]  # 84 of 100 shingles shared, too late in the order to link
    rows = list(enumerate(group + halves + late))
    kept = corpus_pipeline.without_near_copies(spark, make_docs(rows), "")
    want = _kept(rows)
    assert len(halves + late) < len(want) < len(halves + late) + 10 and sorted(r["doc_id"] for r in kept.collect()) == want
    # SimHash, two rounds of neighbours, one listing: of 36 texts, 180 pairs share a half
    assert len(calls) <= 4 and calls[-1] <= 180 + 10 * len(group)


def test_neighbours_join_a_group_of_near_copies(spark):
    """Each text meets a few others, however large the group is; verified, they join what all pairs join."""
    group, halves = _texts()
    sets = nearcopies._sets(spark.createDataFrame(list(enumerate(group + halves)), "node bigint, text string"), nearcopies.SHINGLE).cache()
    alone = spark.createDataFrame([], "node bigint, root bigint")
    pairs = nearcopies._neighbours(sets, alone, 0).cache()
    n = len(group) + len(halves)
    assert pairs.count() <= n * nearcopies.BANDS * nearcopies.NEIGHBOURS
    label = list(range(n))
    for a, b in nearcopies._alike(pairs, sets).collect():
        x, y = sorted((label[a], label[b]))
        label = [x if v == y else v for v in label]
    want = _kept(list(enumerate(group + halves)))
    assert len(want) <= len(set(label)) <= len(want) + 2
    # texts of one root are not met again
    one = spark.createDataFrame([(k, 0) for k in range(1, n)], "node bigint, root bigint").unionByName(spark.createDataFrame([(0, 0)], "node bigint, root bigint"))
    assert nearcopies._neighbours(sets, one, 1).count() == 0
