"""The SimHash step of the pipeline's near-dedup stage."""

from __future__ import annotations

import random

import corpus_pipeline
from hourmark.llm import nearcopies, simhash


def _component(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = sorted((label[a], label[b]))
        label = [x if v == y else v for v in label]
    return label


def test_near_stage_links_by_simhash_first(spark, make_docs, monkeypatch):
    """Fingerprints of all texts that may have copies go through the BK-trees; pairs join what brute force over the bits joins."""
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
        texts.append(" ".join(words))
        for _ in range(4):
            words = [*words]
            words[rng.randrange(400)] = "other"
            texts.append(" ".join(words))
    prints = [simhash.simhash(t, nearcopies.SHINGLE) for t in texts]
    close = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= nearcopies.RADIUS]
    want = _component(len(texts), close)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = nearcopies.simhash_pairs(spark.createDataFrame(list(enumerate(signed)), "node bigint, fp bigint")).collect()
    assert len(close) > 20 and _component(len(texts), [(r["a"], r["b"]) for r in pairs]) == want

    seen = []
    within = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda values, radius: seen.extend(r["fp"] for r in values.collect()) or within(values, radius))
    kept = corpus_pipeline.without_near_copies(spark, make_docs(list(enumerate(texts))), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 30, 5))
    assert sorted(seen) == sorted(set(signed))
