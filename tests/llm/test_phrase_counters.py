"""Counters of op12 keep rare phrases back, however much text there is."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hourmark.llm import phrases


def _counted(docs, least):
    grams = Counter()
    for lang, text in docs:
        ws = text.split()
        grams.update((lang, " ".join(ws[i : i + n])) for n in range(1, 5) for i in range(len(ws) - n + 1))
        grams[lang, ""] += len(ws)
    return {k: f for k, f in grams.items() if f >= least or not k[1]}


def test_few_counters_keep_long_rare_phrases_back(spark, monkeypatch):
    # 7 positions for each of the 4096 counters: too many only if every length is counted in them at once
    rng = random.Random(5)
    docs = [("en", " ".join(f"w{rng.randrange(200)}" for _ in range(300))) for _ in range(100)] + [("en", "new york city hall")] * 40
    seen, chains = [], phrases._chains
    monkeypatch.setattr(phrases, "_chains", lambda *a: seen.append(chains(*a)) or seen[-1])
    counts = phrases.phrase_counts(spark.createDataFrame(docs, "lang string, text string"), bits=12)
    assert {(r["lang"], r["gram"]): r["f"] for r in counts.collect()} == _counted(docs, phrases.LEAST)
    assert seen[0].where(F.size(F.split("words", " ")) > 1).agg(F.sum("weight")).first()[0] < 3_000


def test_counters_follow_the_size_of_the_texts(spark, monkeypatch):
    assert 2 ** phrases.sketch_bits(10 * 10**9) >= 10**9 and phrases.sketch_bits(0) >= 3
    used, often = [], phrases._often
    monkeypatch.setattr(phrases, "_often", lambda texts, short, bits, *more: used.append(bits) or often(texts, short, bits, *more))
    for n in (1, 16):
        df = spark.createDataFrame([("en", "a b c d e " * 4_000)] * 10 * n, "lang string, text string")
        assert {r["gram"]: r["f"] for r in phrases.phrase_counts(df).collect()}["b c d"] == 40_000 * n
    assert used[0] == used[1] and used[2] == used[3] == used[0] + 4


@pytest.mark.parametrize("bits", [3, 8, 20, 30, 34, 40])
def test_sent_counters_come_back(bits):
    cells = np.random.default_rng(bits).integers(0, 1 << bits, 5_000).astype(np.uint64)
    cells = np.concatenate([cells, cells[:100], np.array([0, (1 << bits) - 1], np.uint64)])
    batch, (spread, marks) = phrases._sent(cells, bits), phrases._parts(bits)
    got = [(block << (bits - spread)) + phrases._received(x.as_py()) for block, x in zip(batch.column(0).to_pylist(), batch.column(1))]
    assert np.concatenate(got).tolist() == sorted(cells.tolist()) and spread + 3 <= marks <= bits


def test_blanks_cuts_and_unseen_marks_in_stretches():
    texts = ["  Two  words. x", None, "", "one\ttwo;three", " . ", "a b c d e f g h i j k l m"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    for size in (2, 5, 1000):
        words = []
        for _, ids, own, stop, starts in phrases._stretches(iter([batch]), size):
            left = phrases.room(ids, stop, len(ids))
            assert starts <= 2 * size and len(ids) <= 2 * size + phrases.LONGEST and min(left[:starts], default=0) >= 0
            words += [own[i].as_py() for i in ids[:starts].tolist() if i != stop]
        assert words == ["two", "words", "x", "one", "two", "three", *"abcdefghijklm"]
