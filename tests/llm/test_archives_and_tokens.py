"""WARC archives, packing, unigram encoding, and the pipeline."""

from __future__ import annotations

import base64
import glob
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
import zstandard

from hourmark.llm import packing, unigram, warc
from hourmark.llm.common import shared_path


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(1)
    pages = [(k, f"http://h/{k} ü\r\nx", "<p>" + " ".join(rng.choices(["aa", "bb", "é"], k=50 + k)) + "</p>") for k in range(80)]
    pages += [(100 + k, None, "same" if k % 2 else pages[3][2]) for k in range(9)] + [(200, "u", None), (201, "u", ""), (None, "u", "same"), (202, "u", "y" * 3_000_000), (7, *pages[7][1:])]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, frame int")
    got = warc.archive_and_read(df).collect()
    latest = {}
    for i, _, h in pages:
        if i is not None:
            latest[h or ""] = max(i, latest.get(h or "", i))
    count = {}
    for _, _, h in pages:
        count[h or ""] = count.get(h or "", 0) + 1
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        last = latest.get(h or "")
        again = count[h or ""] > 1 and last is not None and i != last
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", str(last) if again else "None"))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    assert {r["record_type"] for r in warc.archive_and_read(df, least_bytes=1 << 30).collect()} == {"response"}
    assert warc.archive_and_read(df.where("page_id < 0")).count() == 0


def test_archives_roll_by_bytes(spark, monkeypatch):
    rng = random.Random(5)
    records = ["".join(rng.choices("abcdefghij <>", k=4000)).encode() for _ in range(120)]
    monkeypatch.setattr(warc, "SAMPLE_RECORDS", 10)
    found = {}
    for archive, place, row in warc.rolled_rows(iter(records), 50_000):
        assert place == len(found.setdefault(archive, []))
        found[archive].append(row)
    assert list(found) == list(range(len(found))) and len(found) > 3
    whole = [b"".join(r + b"\n" for r in found[k]) for k in found]  # the text writer ends rows so
    assert [r for data in whole for r in warc.unpack(data)] == records and max(map(len, whole)) < 50_000 + 40_000 + warc.DICTIONARY_BYTES
    assert list(warc.rolled_rows(iter([]), 10)) == [] and [r[0] for r in warc.rolled_rows(iter(records[:1]), 1)] == [0, 0]
    # many archives of a task are read as one
    path = shared_path(spark, "rolled")
    df = spark.createDataFrame([(k, f"http://h/{k}", records[k % 120].decode() + str(k)) for k in range(2500)], "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(df, path, archive_bytes=50_000)
    assert len(glob.glob(path.removeprefix("file://") + "/archive=*/part-*")) >= 3
    assert sorted(r["page_id"] for r in warc.read_archives(spark, path).select("page_id").collect()) == list(range(2500))


def test_archive_is_a_zstd_stream(spark):
    path = shared_path(spark, "stream")
    df = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k} some words of a page</p>" * 20) for k in range(60)], "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(df, path)
    data = [open(f, "rb").read() for f in glob.glob(path.removeprefix("file://") + "/archive=*/part-*")]
    data = next(d for d in data if d)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    words = data[8 : 8 + int.from_bytes(data[4:8], "little")]
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    whole = opener.stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == len(list(warc.unpack(data))) and whole == b"".join(warc.unpack(data))


HARD = [
    "", None, " ", "  a", "a  b   c ", "a\n\tb\x0bc\x0cd\re", "▁x", "😀 ñ\u0000z", "日本語テキスト 中文", "x" * 3000, "trail  ", "don't <|x|> 12345", "e\u0301 combining",
    "İstanbul ſ ǅ µm ª", "It's they'll 'tis", "x<|endoftext|>y <|startoftext|>", "\u00a0nb\u2003sp\x1cq\x85z", "ΣΑΣ ς", "Ünïcödé!!! (foo) [bar] foo-bar 3.14 ...", "½ ② ＦＵＬＬ",
]


def test_packing_covers_every_id_once(make_docs):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = HARD + [" ".join(rng.choices(["river", "Stone,", "walks", "éclair"], k=rng.randint(1, 900))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(0, "twice"), (None, "no id"), (500, "long " * 9000)]
    got = packing.pack_documents(make_docs(rows, "ids,n,curve,tie")).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    pieces = sorted((str(r["doc_id"]), r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    want = {i: sorted(map(len, v)) for i, v in ids.items()}
    for i, lists in ids.items():
        for own in lists:
            covered = 0
            for p in [p for p in pieces if p[0] == str(i) and p[1] == len(own)]:
                assert p[4] == zlib.crc32(np.array(own[p[2] : p[2] + p[3]], "<u4").tobytes())
                covered += p[3]
            assert covered == len(own) * want[i].count(len(own))
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == packing.SEQUENCE or end & (end - 1) == 0
    assert packing.pack_documents(make_docs([])).count() == 0


def _best(word, pieces, unknown):
    """Plain Viterbi: best score of a word."""
    best = {0: 0.0}
    for end in range(1, len(word) + 1):
        options = [best[s] + pieces[word[s:end]] for s in range(max(0, end - 16), end) if word[s:end] in pieces]
        if word[end - 1] not in pieces:
            options.append(best[end - 1] + unknown)
        best[end] = max(options)
    return best[len(word)]


def test_unigram_is_optimal_and_decodes(make_docs):
    import sentencepiece

    model = unigram.Unigram(unigram.default_model())
    reader = sentencepiece.SentencePieceProcessor(model_file=unigram.default_model())
    pieces = {reader.id_to_piece(i): float(np.float32(reader.get_score(i))) for i in range(reader.vocab_size()) if not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i))}
    texts = [t for t in HARD if t] + ["the river that ended", "heend andand theretion"]
    for text, ids in zip(texts, model.encode(texts)):
        assert model.decode(ids.tolist()) == text.replace("▁", " ")
        if all(c == " " or c in pieces for c in text):
            shown = "▁" + text.replace(" ", "▁")
            assert abs(sum(pieces[reader.id_to_piece(int(i))] for i in ids) - _best(shown, pieces, float(model.unknown_score))) <= 1e-6 * abs(_best(shown, pieces, 0)) + 64
            assert reader.decode(ids.tolist()) == text.replace("▁", " ")
    assert [reader.id_to_piece(int(i)) for i in model.encode(["\n"])[0]] == ["▁", "<0x0A>"]
    got = unigram.encode_documents(make_docs([(k, t) for k, t in enumerate(HARD)] + [(None, "x")], "ids,n_pieces")).collect()
    assert len(got) == len(HARD) + 1
    assert {r["doc_id"] for r in got if not r["round_trip"]} == {HARD.index("▁x")}
    assert unigram.encode_documents(make_docs([])).count() == 0


def test_double_array_finds_its_keys_only():
    rng = random.Random(3)
    keys = {bytes(rng.choices(range(256), k=rng.randint(1, 5))): i for i in range(800)}
    trie = unigram.DoubleArray(keys)

    def find(key):
        node = 0
        for c in key:
            if trie.check[trie.base[node] + c] != node:
                return -1
            node = trie.base[node] + c
        return trie.value[node]

    assert all(find(k) == v for k, v in keys.items())
    assert all(find(k[:-1] + bytes([k[-1] ^ 1])) == keys.get(k[:-1] + bytes([k[-1] ^ 1]), -1) for k in keys)


def test_pipeline_stages(spark):
    import corpus_pipeline
    from hourmark.llm import exactdedup, simhash
    from hourmark.llm.common import table

    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = shared_path(spark, "test-stage")
        stage(spark, before, folder).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == columns and 0 < after.count() <= before.count()
        if name == "exact dedup":
            assert exactdedup.exact_groups(after).where("group_size > 1").count() == 0
        if name == "SimHash near-dedup":
            assert simhash.near_components(after).where("doc_id <> component_id").count() == 0
        before = after
    packed = corpus_pipeline.run(spark, folder)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in before.select("doc_id").collect()}


@pytest.mark.parametrize("name", ["op1_url_filter", "op7_exact_dedup", "op9_chat"])
def test_queries_equal_sql(spark, name):
    from check_queries import compare, connect
    from hourmark.llm.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    assert compare(QUERIES[name](spark, folder).toPandas(), connect(folder).execute(ORACLE_SQL[name]).df()) is None
