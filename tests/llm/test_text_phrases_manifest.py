"""HTML text, phrase collocations and the Merkle manifest against plain versions."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hourmark.llm import htmltext, merkle, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- HTML text ---


def _page(rng, blocks):
    """A page around the given article blocks, with every kind of thing that is not the article."""
    noise = lambda n: " ".join(rng.choices(["buy", "now", "home", "about", "terms", "cookies"], k=n))
    body = []
    for k, b in enumerate(blocks):
        body.append(rng.choice(["<p>{}</p>", "<p><b>{}</b></p>\n", "<div><p>{}</p></div>", "<blockquote>{}</blockquote>"]).format(html.escape(b)))
        if rng.random() < 0.4:
            body.append(rng.choice(['<div class="ad">{}</div>', '<aside><p>{}</p></aside>', "<script>var x='<p>{}</p>';</script>", "<form><label>{}</label><input name=q></form>"]).format(noise(6)))
    return (
        f"<!DOCTYPE html><html><head><title>{noise(3)}</title><style>p{{}}</style></head><body class='page sidebar-left'><header><h1>{noise(2)}</h1></header>"
        f"<nav><ul>{''.join(f'<li><a href=x>{noise(1)}</a>' for _ in range(6))}</ul></nav><div id='cookie-notice'>{noise(30)}</div>"
        f"<article>{''.join(body)}</article><section class='comments'><p>{noise(60)}</p></section><footer>&copy; {noise(4)}</footer>"
    )


def test_article_is_found_whatever_stands_around_it():
    rng = random.Random(4)
    for _ in range(60):
        blocks = [" ".join(rng.choices(["Ärzte", "a<b", "x&y", "lorem", "\"q\"", "."], k=rng.choice([1, 2, 40, 200]))) for _ in range(rng.randint(1, 8))]
        assert htmltext.main_text(_page(rng, blocks)) == "\n".join(blocks)


def test_region_without_an_article_element_is_chosen_by_ratio():
    links = "".join(f"<li><a href='{k}'>more {k}</a></li>" for k in range(40))
    page = f"<body><div><ul>{links}</ul></div><div><h2>Head</h2><p>{'word ' * 60}</p><p>Short.</p><p>{'text ' * 80}</p></div><div>{'<a>x</a> ' * 30}</div></body>"
    assert htmltext.main_text(page) == "\n".join(["Head", ("word " * 60).strip(), "Short.", ("text " * 80).strip()])
    flat = np.zeros(9)
    flat[4] = 1
    smooth = htmltext.smoothed(flat)
    assert smooth.argmax() == 4 and np.allclose(smooth, smooth[::-1]) and np.allclose(htmltext.smoothed(np.ones(5)), 1)


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("  \n ", ""), ("plain &amp; text", "plain & text"), ("<p>a<br>b<p>c", "a b\nc"), ("<p>a &eacute;\n\t b</p>", "a é b"), ("<article></article>", ""),
    ("<script>if (a<b) {}</script>", ""), ("<article><p>One.</p><article class='comment'><p>Nice!</p></article></article>", "One."), ("<p hidden>x</p><p>y</p>", "y"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"), ("<article><p>a</p>tail</article>", "a\ntail"),
])
def test_small_pages(page, want):
    assert htmltext.main_text(page) == want


def test_extraction_rows(spark):
    long = "<article>" + "<p>long text</p>" * 30_000 + "</article>"
    rows = [(1, "u", "<p>é</p>", "x"), (1, "u", "<p>é</p>", "x"), (None, None, None, "x"), (2, "v", "", None), (3, "w", long, None), (4, "d", "<div>" * 3000 + "deep", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").withColumnRenamed("text", "n_chars")
    got = sorted(map(tuple, htmltext.extract_text(df).collect()), key=str)
    whole = "\n".join(["long text"] * 30_000)
    assert got == sorted([(1, "u", "é", 1), (1, "u", "é", 1), (None, None, "", 0), (2, "v", "", 0), (3, "w", whole, len(whole)), (4, "d", "deep", 4)], key=str)
    assert htmltext.extract_text(df.limit(0)).count() == 0


# --- phrases ---


def _pieces(docs):
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            yield lang or "und", [w for w in re.split(r"[\x20\t]+", piece) if w]


def _plain_phrases(docs, least, top):
    counts, total = {}, Counter()
    for lang, ws in _pieces(docs):
        total[lang] += len(ws)
        for n in range(1, 5):
            counts.setdefault(lang, Counter()).update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, f in counts.items():
        cands = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        around = Counter()
        for g, a in cands.items():
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    around[g[i : i + n]] = max(around[g[i : i + n]], a)
        rows = []
        for g, a in cands.items():
            if 100 * around[g] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def _corpus(rng, n):
    words = ["the", "of", "New", "york", "ZZ", "é", "a-b", "x", " ", "日本"]
    text = lambda: "".join(rng.choices(words, [8, 6, 3, 3, 1, 2, 1, 1, 1, 1])[0] + rng.choice([" ", " ", " ", "\t", ". ", "\n", " new york city hall "]) for _ in range(rng.randint(0, 40)))
    return [(rng.choice(["en", "en", "de", None, "und"]), rng.choice([None, "", text(), text(), text()])) for _ in range(n)]


@pytest.mark.parametrize("bits,stretch,top", [(24, 1 << 19, 2000), (6, 37, 2000), (12, 5, 3)])
def test_phrases_equal_plain_counting(spark, bits, stretch, top):
    docs = _corpus(random.Random(bits), 400)
    docs += docs[:30] + [("en", "Same words again here, " * 3000)]
    df = spark.createDataFrame([(l, t, "x", 1) for l, t in docs], "lang string, text string, gram string, n bigint")
    got = sorted(map(tuple, phrases.phrases(df, least=7, top=top, bits=bits, stretch=stretch).collect()))
    assert got == _plain_phrases(docs, 7, top) and got


def test_phrases_of_empty_tables_and_tied_scores(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.phrases(empty).count() == 0
    assert phrases.phrases(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0
    tied = spark.createDataFrame([("en", "b c. a d")] * 40, "lang string, text string")
    assert [(r["rank"], r["phrase"]) for r in phrases.phrases(tied).orderBy("rank").collect()] == [(1, "a d"), (2, "b c")]
    with pytest.raises(ValueError):
        phrases.phrase_counts(tied, least=300)


def test_chains_hold_every_edge_once():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 6, 3000)
    ids = np.concatenate([ids, [0], np.arange(10, 60), [0], np.arange(10, 60), [0]])
    want = Counter(tuple(ids[i : i + 4].tolist()) for i in range(len(ids) - 3) if 0 not in ids[i : i + 4])
    at = np.flatnonzero(phrases.room(ids, 0, len(ids)) == 4)
    got, rows = Counter(), 0
    for a, b, w in zip(*(x.tolist() for x in phrases.compact_graph(ids, at))):
        rows += 1
        for i in range(a, b - 2):
            assert tuple(ids[i : i + 4].tolist()) not in got
            got[tuple(ids[i : i + 4].tolist())] = w
    assert got == want and rows < len(want)  # the passage of 50 words is one row of weight 2
    assert max(b - a + 1 for a, b, _ in zip(*(x.tolist() for x in phrases.compact_graph(ids, at)))) >= 50


# --- Merkle manifest ---


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def _steps(levels, i):
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        yield "".join(run[: i % 16]), "".join(run[i % 16 + 1 :])
        i //= 16


def _plain_manifest(rows):
    mark = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for doc_id, text, lang, source, n in rows:
        own = _sha("".join(map(mark, (doc_id, source, lang, n, text))))
        low = text.translate(LOWER) if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else text
        by.setdefault(source, []).append(((doc_id is not None, doc_id or 0), own, _sha("".join(map(mark, (doc_id, source, lang, n, low)))), doc_id))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [_levels([x[1] for x in sorted(by[s])]) for s in sources]
    top = _levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, (_, own, shown, doc_id) in enumerate(sorted(by[s])):
            steps = [*_steps(trees[k], i), *_steps(top, k)]
            h = shown
            for a, b in steps:
                h = _sha(a + h + b)
            out.append((doc_id, own, trees[k][-1][0], top[-1][0], _sha("".join(a + b for a, b in steps)), h, h == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [300, 1, 5], [256, 257], [4200], [1] * 40 + [70]])
def test_manifest_equals_plain_trees(spark, sizes):
    rows, k = [], 0
    for s, size in enumerate(sizes):
        for _ in range(size):
            rows.append((k, None if k % 11 == 0 else f"Text É {k}", ["de", None][k % 2], None if s == 1 else f"s{s}é", None if k % 7 == 0 else k))
            k += 1
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, pos string, root int")
    got = sorted(map(tuple, merkle.tree_manifest(df).collect()), key=str)
    assert got == _plain_manifest(rows)
    assert {r[-1] for r in got} <= {True, False} and (len(rows) < 20 or len({r[-1] for r in got}) == 2)


def test_manifest_of_odd_rows(spark, make_docs):
    assert merkle.tree_manifest(make_docs([])).count() == 0
    rows = [(7, "Same", "en", "s", 4), (7, "Same", "en", "s", 4), (7, "Other", "en", "s", 4), (None, "A", "en", "s", 4), (None, None, None, None, None), (5, "", "en", "", 0), (6, "B" * 400_000, "en", "s", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(map(tuple, merkle.tree_manifest(df).collect()), key=str) == _plain_manifest(rows)
