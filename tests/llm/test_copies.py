"""Near and exact copies, repeated strings."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from hourmark.llm import exactdedup, simhash, suffixes
from hourmark.llm.common import components


def _simhash(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _labels(values, radius, ids):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for x, i in zip(label, ids):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [least.get(x) for x in label]


def test_near_components_equal_brute_force(make_docs):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "Ünit", "delta", "eps", "ZETA"]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(25)]
    texts = base + [t.replace("alpha", "omega", 1) for t in base] + base[:5] + [None, "", " \n", "one", "ONE", "two words\x0bhere", "a\u00a0b", "word " * 20_000]
    rows = [(100 - k, t) for k, t in enumerate(texts)] + [(None, base[0]), (77, base[1])]
    got = simhash.near_components(make_docs(rows, "fp,root,fingerprint")).collect()
    values = [_simhash(t) for _, t in rows]
    want = sorted((str(i), f"{v:016x}", str(c)) for (i, _), v, c in zip(rows, values, _labels(values, 4, [i for i, _ in rows])))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want
    assert simhash.near_components(make_docs([])).count() == 0
    docs = make_docs(rows, "fp,least")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {int(c) for _, _, c in want if c != "None"} & {i for i, _ in rows}


@pytest.mark.parametrize("limit", [5, 20_000])
def test_links_span_all_pairs(spark, limit):
    """Random, clustered and chained values; small shards force the dealt way."""
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(4):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(40)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), 4, shard_limit=limit)
    assert all(((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 4 for r in links.collect())
    root = {r["node"]: r["root"] for r in components(links, "test").collect()}
    assert [root.get(v, v) for v in signed] == [signed_min for signed_min in _labels(values, 4, signed)]


def test_forest_follows_edges_within_radius():
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64) & np.uint64(0xFFFF))
    groups = (values % np.uint64(3)).astype(np.int64)
    found = {(int(a), int(b)) for i, j in simhash.Forest(groups, values).within(4, step=50) for a, b in zip(i, j)}
    want = {(i, j) for i in range(len(values)) for j in range(i) if groups[i] == groups[j] and int(values[i] ^ values[j]).bit_count() <= 4}
    assert found == want


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(159, 200), (7, 7)]
    root = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "test").collect()}
    assert root == {k: 0 for k in range(41)} | {k: 100 for k in [*range(100, 160), 200]}


@pytest.mark.parametrize("capacity", [3, 4096])
def test_exact_groups(make_docs, capacity):
    rows = [(k, f"text {k % 30} here") for k in range(90)] + [(200, " text\t1 here "), (201, None), (202, ""), (203, " \x0b\n"), (204, "a\u00a0b"), (205, "ab"), (None, "text 2 here"), (206, "z" * 100_000), (5, "text 5 here")]
    docs = make_docs(rows, "h,sha,bucket,points,__lost,__sha")
    got = exactdedup.exact_groups(docs, capacity).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    want = []
    for i, t in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        longest = min(g[0] for g in groups[body])
        keep = min(g[1:] for g in groups[body] if g[0] == longest)[1]
        want.append((str(i), str(keep), len(groups[body]), i == keep and -len(t or "") == longest, hashlib.sha256(body.encode()).hexdigest()))
    assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in got) == sorted(want)
    kept = exactdedup.keep_first(docs, capacity)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(w[0] for w in want if w[3])
    assert exactdedup.exact_groups(docs.limit(0)).count() == 0


def test_directory_doubles_only_full_buckets(spark):
    keys = spark.range(3000).selectExpr("xxhash64(id) AS h").union(spark.range(500).selectExpr("shiftright(id, 60) + 5 AS h"))
    found = exactdedup.directory(keys, 100).collect()
    hashes = {r["h"] & ((1 << 64) - 1) for r in keys.collect()}
    homes = {h: [b for b in found if (h >> (64 - b["depth"]) if b["depth"] else 0) == b["prefix"]] for h in hashes}
    assert all(len(b) == 1 for b in homes.values())
    sizes = {}
    for b in homes.values():
        sizes[(b[0]["depth"], b[0]["prefix"])] = sizes.get((b[0]["depth"], b[0]["prefix"]), 0) + 1
    assert max(sizes.values()) <= 100 and len({b["depth"] for b in found}) >= 1


def _cut(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for k in range(len(d) - n + 1):
            seen[d[k : k + n]] = seen.get(d[k : k + n], 0) + 1
    out = []
    for d in data:
        cover = bytearray(len(d))
        for k in range(len(d) - n + 1):
            if seen[d[k : k + n]] > 1:
                cover[k : k + n] = b"\1" * n
        kept = bytes(x for x, c in zip(d, cover) if not c)
        spans = sum(1 for k in range(len(d)) if cover[k] and not (k and cover[k - 1]))
        out.append((len(d), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2, 50_000])
def test_repeats_equal_brute_force(make_docs, hot):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choices("abcdefgh é\n", k=n))
    passage = [noise(120) for _ in range(4)]
    texts = []
    for k in range(60):
        parts = [noise(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage)
            a, b = sorted(rng.sample(range(len(p) + 1), 2))
            parts += [p[a:b], noise(rng.randint(0, 60))]
        texts.append("".join(parts))
    texts += ["a" * 500, "ab" * 300, noise(50) * 4, texts[0], texts[0], None, "", "short", noise(3000) + passage[0]]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, passage[1])]
    docs = make_docs(rows, "th,spans,kept,__id,__th")
    got = suffixes.repeat_report(docs, length=40, seed=12, hot_seed=hot).collect()
    want = _cut([t for _, t in rows], 40)
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want))
    shown = suffixes.without_repeats(docs, length=40, seed=12)
    assert shown.columns == docs.columns and shown.count() == len(rows)
    assert all(r["n_chars"] == len(r["text"] or "") for r in shown.collect())
    assert suffixes.repeat_report(docs.limit(0)).count() == 0


def test_parts_of_a_long_text_meet(monkeypatch):
    monkeypatch.setattr(suffixes, "PART_BYTES", 64)
    data = random.Random(7).randbytes(1000)
    found = [x for rows in suffixes.blocks_of([data, b"", data[:50]], 40, 12) for x in zip(*[c.tolist() for c in rows])]
    windows = sorted((n, i) for n, _, a, b, _ in found for i in range(a, b + 1))
    assert windows == [(0, i) for i in range(961)] + [(2, i) for i in range(11)]
    assert all(a <= b <= p <= a + 28 for _, _, a, b, p in found)


def test_loser_tree_merges_with_prefixes():
    rng = random.Random(8)
    for n in (0, 1, 2, 3, 7, 8):
        runs = [sorted("".join(rng.choices("ab", k=rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 30))) for _ in range(n)]
        tree = suffixes.LoserTree([iter(list(zip(*suffixes.front_code(r)))) for r in runs])
        got = list(tree)
        assert [g[1] for g in got] == sorted(x for r in runs for x in r)
        assert [g[2] for g in got[1:]] == [suffixes.common_prefix(a[1], b[1]) for a, b in zip(got, got[1:])]


def test_passage_words_equal_brute_force(make_docs):
    """Windows of 12 equal words, in copies, near copies, repeats within a text, and periodic texts."""
    rng = random.Random(9)
    words = lambda n: rng.choices(["a", "b", "cc", "Ä", "."], k=n)
    passages = [words(30) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = words(rng.randint(0, 20))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p) + 1), 2))
            parts += p[a:b] + words(rng.randint(0, 15))
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    texts += [texts[0], texts[1], texts[1] + " tail", "x " * 60, "x y " * 30, " ".join(passages[0] * 3), None, "", "short one"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[2])]
    seen = Counter(tuple(w[i : i + 12]) for _, t in rows if (w := (t or "").split()) for i in range(len(w) - 11))
    want = []
    for doc_id, t in rows:
        w = (t or "").split()
        covered = {i + k for i in range(len(w) - 11) if seen[tuple(w[i : i + 12])] > 1 for k in range(12)}
        want.append((str(doc_id), len(covered)))
    got = suffixes.repeat_report(make_docs(rows, "th,spans,h,x,y,n"), length=40, seed=12, words=12).collect()
    assert sorted((str(r["doc_id"]), r["passage_words"]) for r in got) == sorted(want) and any(n for _, n in want)


def test_the_directory_decides_what_is_found(make_docs, monkeypatch):
    """Rows are looked up through the directory: without one of its buckets their groups are gone."""
    docs = make_docs([(k, f"text {k % 150}") for k in range(300)])
    whole = exactdedup.exact_groups(docs, 20).collect()
    assert len(whole) == 300 and {r["group_size"] for r in whole} == {2} and sum(r["kept"] for r in whole) == 150
    index, buckets = exactdedup.hash_index(docs, 20)
    assert index.count() == 150 and buckets.count() > 4 and index.groupBy("bucket").count().agg({"count": "max"}).first()[0] <= 20
    plain = exactdedup.directory

    def broken(keys, capacity):
        found = plain(keys, capacity)
        first = found.orderBy("depth", "prefix").first()
        return found.where(f"NOT (depth = {first['depth']} AND prefix = {first['prefix']})")

    monkeypatch.setattr(exactdedup, "directory", broken)
    assert exactdedup.exact_groups(docs, 20).count() < 300
