"""The pipeline's stages against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from hourmark.llm import nearcopies


def _sets(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def _kept(rows):
    label = list(range(len(rows)))
    sets = [_sets(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for x, (i, _) in zip(label, rows):
        least[x] = min(i, least.get(x, i))
    return sorted(least.values())


def _changed(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("rounds", [0, 4])
def test_near_stage_equals_brute_force(spark, make_docs, monkeypatch, rounds):
    """Pairs on either side of 0.8, a large group, chains, a shared half, short and empty texts."""
    monkeypatch.setattr(nearcopies, "ROUNDS", rounds)
    monkeypatch.setattr(nearcopies, "OPEN", 0)
    rng = random.Random(9)
    noise = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    texts = []
    for k in range(12):
        base = noise(rng.randint(90, 200))
        texts += [base, *(_changed(rng, base, rng.randint(1, 6)) for _ in range(3))]
    hub = noise(120)
    texts += [_changed(rng, hub, rng.randint(1, 3)) for _ in range(40)]
    now = noise(150)
    for _ in range(5):
        texts.append(now := _changed(rng, now, 2))
    half = noise(60)
    texts += [half + " " + noise(60) for _ in range(6)] + ["one two", "ONE  two", "one three", "", "a b c d e f", "a b c d e g"]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts))
    docs = make_docs(rows, "node,n,root,__lost")
    kept = corpus_pipeline.without_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    want = _kept(rows)
    assert 0 < len(want) < len(rows) - 40 and sorted(r["doc_id"] for r in kept.collect()) == want


def test_near_stage_keeps_one_row_without_an_id(spark, make_docs):
    text = " ".join(f"w{k}" for k in range(80))
    kept = lambda rows: sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.without_near_copies(spark, make_docs(rows), "").collect())
    assert kept([(None, text), (4, text + " more")]) == [("4", text + " more")]
    assert len(kept([(None, text), (None, text + " more"), (1, "other")])) == 2
    assert kept([]) == []


def _cut(texts, n):
    """Texts without the 51-word windows that occur more than once; bytes are ASCII."""
    spans = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    windows = [[tuple((t or "")[x:y] for x, y in s[k : k + n]) for k in range(len(s) - n + 1)] for t, s in zip(texts, spans)]
    seen = Counter(w for own in windows for w in own)
    out = []
    for t, s, own in zip(texts, spans, windows):
        gone = {i for k, w in enumerate(own) if seen[w] > 1 for i in range(s[k][0], s[k + n - 1][1])}
        out.append("".join(c for i, c in enumerate(t or "") if i not in gone))
    return out


def test_passages_of_51_short_words_are_cut(spark, make_docs):
    """All passages are shorter than 400 bytes; those of 50 words stay, so do two runs that only touch."""
    rng = random.Random(12)
    noise = lambda n: [f"{rng.choice('abcdefg')}{rng.randint(0, 999)}" for _ in range(n)]
    passage, short, long = noise(51), noise(50), noise(70)
    texts = [" ".join(noise(rng.randint(0, 90)) + p + noise(rng.randint(0, 90))) for p in (passage, passage, short, short, long, long, long[:55], long[10:], long[:30] + short[:30])]
    texts += ["\n ".join(["x1"] + passage), "a b " * 60, " ".join(noise(300)), "", " ".join(short)]
    rows = [*enumerate(texts), (None, " ".join(passage + noise(5)))]
    docs = make_docs(rows, "th,spans,kept")
    got = corpus_pipeline.without_passages(spark, docs, "")
    want = _cut([t for _, t in rows], 51)
    assert sum(len(t) != len(w) for (_, t), w in zip(rows, want)) == 9
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in got.collect()) == sorted((str(i), w, len(w)) for (i, _), w in zip(rows, want))
