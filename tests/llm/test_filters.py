"""URL filter, quality rules, sharding, chat formatting."""

from __future__ import annotations

import fnmatch
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hourmark.llm import chat, quality, sharding, urlfilter


def test_automaton_equals_globs():
    rng = random.Random(1)
    hosts = ["*", "*a*", "a?c", "*.net", "ab*ba", "x" * 70 + "*", "**b", "?"]
    paths = ["*", "/a*", "", "*/b/*", "/?", "*.exe"]
    patterns = [(h, p) for h in hosts for p in paths]
    automaton = urlfilter.Automaton(patterns)
    cases = [("".join(rng.choices("abc.net", k=rng.randint(0, 6))), "".join(rng.choices("/ab.exe", k=rng.randint(0, 6)))) for _ in range(400)]
    cases += [("x" * 70 + "yz", "/a"), ("abba", "/b/b/"), ("", "")]
    hits = automaton.matches([h.encode() + bytes([urlfilter.BOUNDARY]) + p.encode() for h, p in cases])
    for (h, p), row in zip(cases, hits):
        want = [fnmatch.fnmatchcase(h, hp) and fnmatch.fnmatchcase(p, pp) for hp, pp in patterns]
        assert row.tolist() == want


def test_url_rules(spark):
    rows = [
        (1, "https://www.Example.NET/en/1?x"), (2, "http://example.net/de/"), (3, "https://a.example.com/de/x#y"), (4, "http://x.org/fr/"), (5, "http://x.org/FR/"),
        (6, None), (7, "no scheme"), (8, "http://evil.io/x.example.net/en/"), (9, "http://notexample.com/de/"), (10, "http://net"), (11, "http://net/"),
        (12, "http://big-casino.io/"), (13, ""), (14, "x://h?q://z/"), (14, "x://h?q://z/"), (15, "http://h.io/" + "a" * 100_000 + "/tracks/1"),
    ]
    df = spark.createDataFrame([(i, u, "old") for i, u in rows], "page_id bigint, url string, verdict string")
    got = [tuple(r) for r in urlfilter.judge_urls(df).select("page_id", "host", "rule", "verdict").collect()]
    want = {
        1: ("www.example.net", "example.net/en/", "allow"), 2: ("example.net", "net/", "block"), 3: ("a.example.com", "example.com/de/", "block"),
        4: ("x.org", "org/fr/", "allow"), 5: ("x.org", None, "allow"), 6: ("", None, "allow"), 7: ("", None, "allow"), 8: ("evil.io", None, "allow"),
        9: ("notexample.com", None, "allow"), 10: ("net", None, "allow"), 11: ("net", "net/", "block"), 12: ("big-casino.io", None, "block"),
        13: ("", None, "allow"), 14: ("h", None, "allow"), 15: ("h.io", None, "block"),
    }
    assert len(got) == len(rows) and all(want[g[0]] == g[1:] for g in got)
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (3, 1)])
def test_hilbert_curve_is_a_walk(spark, n, bits):
    cells = spark.range(1 << (n * bits)).select(*[F.floor(F.col("id") / (1 << (bits * i))).bitwiseAND((1 << bits) - 1).alias(f"x{i}") for i in range(n)])
    rows = cells.select("*", sharding.hilbert_index([F.col(f"x{i}") for i in range(n)], bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(len(rows)))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_law_and_slots(make_docs):
    texts = [(k, f"word {k} " * (k % 40)) for k in range(205)] + [(None, None), (3, "é"), (3, "é"), (999, ""), (1000, "same"), (1001, "same")]
    got = sharding.hilbert_shards(make_docs(texts, "shard,size,__rank,curve"), shards=40).collect()
    assert len(got) == len(texts)
    counts, slots = {}, {}
    for r in got:
        counts[r["shard"]] = counts.get(r["shard"], 0) + 1
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == by
    assert sharding.hilbert_shards(make_docs([])).count() == 0
    assert {r["shard"] for r in sharding.hilbert_shards(make_docs(texts[:3])).collect()} <= set(range(40))


def _base(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    spans = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, s in enumerate(spans) if spans.count(s) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark, make_docs):
    rng = random.Random(2)
    good = [" ".join(rng.choices(["stone", "river", "walks", "under", "early", "light", "ünder"], k=60)) for _ in range(120)]
    bad = [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in rng.choices(["buy", "win", "now", "click"], k=60)) for _ in range(60)]
    odd = [None, "", "one\n\none\none two", "a b c d e f g h " * 4, "x\u00a0y\u2003z \x1c q", "word " * 30_000]
    texts = list(enumerate(good + bad + odd)) + [(0, good[0]), (None, good[1])]
    docs = make_docs(texts, "score,kept,__id,quality")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(80)] + [(k, 0, 0) for k in range(120, 160)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.judge_quality(docs, labels).collect()
    assert len(got) == len(texts)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, t in texts:
        if i is not None:
            r = by_id[i]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == _base(t)[:4]
            if len(t or "") < 10_000:
                assert r["n_repeat_words"] == _base(t)[4]
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    assert all(by_id[k]["kept"] for k in range(120) if not by_id[k]["base_failed"])
    assert not any(by_id[k]["kept"] for k in range(120, 180))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert quality.judge_quality(docs, labels.limit(0)).where("NOT base_failed AND NOT kept").count() == 0
    assert quality.judge_quality(docs.limit(0), labels).count() == 0


def test_chat_round_trip(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x|>", "plain", "", None, "<|im_end|>\n<|im_start|>user\nhi", "<|im_end|", "tail <|", "é" * 20_000]
    rows = [(k, t, role, text) for k, text in enumerate(hard) for t, role in ((0, "user"), (1, "assistant"), (2, "assistant"))]
    rows += [(50, 1, "as\nsistant", "x"), (50, None, None, "first"), (50, 1, "as\nsistant", "x"), (None, 0, "user", "null"), (51, 0, "<|line|>", "y")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, nth int")
    formatted = chat.format_chats(df)
    whole = {}
    for r in formatted.orderBy("conv_id", "nth").collect():
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["formatted"]
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert set(got) == {r[0] for r in rows}
    order = lambda r: tuple((v is not None, v) for v in r[1:])
    for conv, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == conv), key=order)]
        assert chat.parse(whole[conv]) == turns
        said = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["formatted_chars"] == len(whole[conv])
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0
