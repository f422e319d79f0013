"""The quality model uses every label."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from hourmark.llm import quality


def test_quality_model_counts_all_labelled_rows(spark, make_docs):
    """60,000 labels, of which few meet a document: counts and threshold equal those over all of them."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["stone", "river", f"w{k % 40}", "early"] if k < 200 else ["buy", "win", "stone", f"w{k % 40}"], k=40)) for k in range(300)]
    docs = make_docs([(200 * k, t) for k, t in enumerate(texts)])
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") < 40_000).cast("int").alias("quality"))
    ids = spark.createDataFrame([(200 * k,) for k in range(300)], "i bigint")
    half = {r["i"] // 200: r["h"] for r in ids.select("i", F.pmod(F.xxhash64("i", F.lit(1)), F.lit(2)).alias("h")).collect()}
    size = 1 << quality.BUCKET_BITS
    count = lambda own: sum((np.bincount(quality.buckets(texts[k].encode().split()), minlength=size) for k in own), np.zeros(size))
    every, trusted = count(range(300)), count(k for k in range(200) if half[k] == 0)
    raw = (every + 0.5) / (every.sum() + 0.5 * size)
    model = quality.fit(docs, labels)
    np.testing.assert_allclose(model.ratio, np.log((trusted + size * raw) / (trusted.sum() + size) / raw))
    score = [model.score(t.encode().split()) for t in texts]
    good, bad = [score[k] for k in range(200) if half[k] == 1], score[200:]
    least = max((np.mean(good) + np.mean(bad)) / 2, np.mean(good) - 6 * np.std(good))
    report = quality.judge_quality(docs, labels)
    assert abs(quality.threshold(report, labels) - least) < 2e-6
    assert {r["doc_id"] for r in report.where("kept").collect()} == {200 * k for k in range(300) if score[k] >= round(least, 6) and not report_failed(texts[k])}


def report_failed(text):
    words = text.encode().split()
    return quality._fails(len(words), quality.base_counts(text, words)[-1])
