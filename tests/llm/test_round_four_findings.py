"""Findings of round 3: what travels and what is done once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from hourmark.llm import common, passages, quality


def test_quality_moves_only_texts_that_may_be_fitted(spark, make_docs):
    """Every row is marked once; the plan is the same however few the labels are, and half of the texts stay in place."""
    rows = [*((k, f"text {k}") for k in range(400)), (None, "no id"), (7, "again"), (8, None)]
    docs = make_docs(rows)
    labels = spark.createDataFrame([*((k, int(k < 300)) for k in range(0, 400, 2)), (2, 0), (None, 1)], "doc_id bigint, quality int")
    marked = quality._marked(docs, labels)
    half = {r[0]: r[1] for r in docs.select("doc_id", quality._half(docs["doc_id"])).distinct().collect()}
    want = sorted((t or "", i is not None and i % 2 == 0 and i < 300 and half[i] == 0) for i, t in rows)
    assert sorted((r["text"] or "", r["__role"] == quality.FITTED) for r in marked.collect()) == want
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "ShuffledHashJoin" in plan
    assert 100 < sum(h == 0 for i, h in half.items() if i is not None) < 300


def test_passage_blocks_take_a_text_apart_once(monkeypatch):
    seen = []
    bounds = passages.word_bounds
    monkeypatch.setattr(passages, "word_bounds", lambda data: seen.append(data) or bounds(data))
    texts = ["short one", "  ".join(f"w{k % 70}" for k in range(300)), "\u00e9t\u00e9 \n" * 60, ""]
    part = pa.RecordBatch.from_arrays([pa.array([1, None, 3, 4], pa.int64()), pa.array([5, 6, 7, 8], pa.int64()), pa.array(texts)], names=["doc_id", "th", "text"])
    got = passages._blocks_of(part, 51).to_pylist()
    assert len(seen) == len(texts)
    want = []
    for doc_id, th, text in zip([1, None, 3, 4], [5, 6, 7, 8], texts):
        data = text.encode()
        begins, ends = bounds(data)
        for h, a, b in zip(*(v.tolist() for v in passages.anchors_of(data))):
            x, y = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(data.split()[a : b + 51])), ">i8").tolist()
            want.append({"doc_id": doc_id, "th": th, "h": h - (1 << 64) if h >> 63 else h, "x": x, "y": y, "a": a, "b": b, "begin": begins[a], "end": ends[b + 50]})
    assert len(want) > 5 and got == want


def test_components_bring_no_table_to_the_driver(spark, monkeypatch):
    plans, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    chain, hub = [(k, k + 1) for k in range(1, 12)], [(100, k) for k in range(101, 120)]
    edges = spark.createDataFrame([*chain, *hub, (119, 118), (50, 50)], "a bigint, b bigint")
    root = {r["node"]: r["root"] for r in common.components(edges, "test").collect()}
    assert root == {k: 1 for k in range(1, 13)} | {k: 100 for k in range(100, 120)}
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)


def test_component_rounds_take_three_exchanges_and_their_end_none(spark, monkeypatch):
    """The driver's memory grows with queries and exchanges; results stay those of brute force, repeated and looped edges included."""
    plans, scans, stored = [], [], common.stored

    def keeping(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        kept = stored(df, name)
        where = kept.where
        monkeypatch.setattr(kept, "where", lambda c: scans.append(where(c)._jdf.queryExecution().executedPlan().toString()) or where(c))
        return kept

    monkeypatch.setattr(common, "stored", keeping)
    rng = np.random.default_rng(4)
    edges = [*((int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))), *((k, 1000 - k) for k in range(300, 330)), *[(299, k) for k in range(300, 330)] * 2]
    label = {k: k for e in edges for k in e if e[0] != e[1]}
    for a, b in edges * len(label):
        if a != b and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    rows = common.components(spark.createDataFrame(edges, "a bigint, b bigint"), "test").collect()
    assert sorted(tuple(r) for r in rows) == sorted(label.items())
    assert len(plans) > 2 and max(p.count("Exchange hashpartitioning") for p in plans) == 3
    assert len(scans) == len(plans) - 1 and not any("Exchange" in p for p in scans)
