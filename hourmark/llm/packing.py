"""Packing of token sequences in the order of a space-filling curve.

A document's token counts form a hashed vector that is projected to three
dimensions. Rows are range-sorted by the Hilbert index of the cell, so
neighbours on the curve are alike, and cut into sequences one after the other.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmark.llm.common import arrow_rows, in_arrow, stored
from hourmark.llm.sharding import hilbert_index

SEQUENCE, END_ID, DIMS, CURVE_BITS = 2048, 1, 3, 10
#: Words kept with their ids per Python worker; beyond it the cache starts anew.
CACHE_WORDS = 400_000
#: Letters whose normal form, lower case and class need no table, and marks that form a unit of their own after them.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#%*$&)\"-]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of blank-separated words, kept as bytes of unsigned 16 or 32-bit integers.

    The tokenizer drops white space and never joins across it, so a text's ids
    are its words' ids one after the other. New words of plain letters go
    straight to the tokenizer's BPE model, all others through its whole chain.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0x61, 0x100) if _PLAIN.fullmatch(chr(c))]
        self.shown = {ord(c): to_bytes.pre_tokenize_str(c)[0][0] for c in letters}
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _ids(self, ids: Iterable[int]) -> bytes:
        return np.fromiter(ids, self.kind).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        plain = _PLAIN.fullmatch(text)
        if not plain:
            return self._whole(text)
        stem, marks = plain[1].lower(), plain[2]
        if (ids := self.stems.get(stem)) is None:
            ids = self.stems[stem] = self._ids([t.id for t in self.model.tokenize(stem.translate(self.shown))])
        if marks:
            if (more := self.stems.get(marks)) is None:
                more = self.stems[marks] = self._whole(marks)
            ids += more
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, as bytes."""
        split = [t.encode("utf-8", "replace").split() for t in texts]
        if len(self.known) > CACHE_WORDS or len(self.stems) > CACHE_WORDS:
            self.known, self.stems = {}, {}
        known = self.known
        for word in set().union(*split).difference(known):
            known[word] = self._learn(word)
        return [b"".join(map(known.__getitem__, words)) for words in split]


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer and cache per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def forget_words() -> None:
    """Drop the caches of this worker, as it may go on to other work."""
    for words in _LOADED.values():
        words.known, words.stems = {}, {}


def _cells(ids: np.ndarray, axes: np.ndarray) -> list[int]:
    """Cell of a document: its mean token direction per dimension, squashed to ``CURVE_BITS`` bits."""
    mean = axes[ids].mean(axis=0, dtype=np.float64)
    share = 0.5 + np.arctan(8 * mean) / np.pi
    return np.minimum((share * (1 << CURVE_BITS)).astype(np.int64), (1 << CURVE_BITS) - 1).tolist()


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, ids, n, curve)``: compressed ids with the end id, their number, the Hilbert index."""

    def make():
        words = word_ids(tokenizer)
        axes = np.random.default_rng(8).choice(np.array([-1, 1], np.float32), (max(words.tokenizer.get_vocab_size(), END_ID + 1), DIMS))
        end, pack = np.array([END_ID], words.kind).tobytes(), zstandard.ZstdCompressor(level=1).compress

        def step(batch: pa.RecordBatch) -> Iterable[dict]:
            found = words.encode([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, data in zip(batch.column(0).to_pylist(), found):
                ids = np.frombuffer(data + end, words.kind)
                x, y, z = _cells(ids, axes)
                yield {"doc_id": doc_id, "ids": pack(ids.tobytes()), "n": len(ids), "x": x, "y": y, "z": z}

        return step

    cells = arrow_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), make, "doc_id bigint, ids binary, n bigint, x int, y int, z int", rows=256)
    return cells.select("doc_id", "ids", "n", hilbert_index([F.col("x"), F.col("y"), F.col("z")], CURVE_BITS).alias("curve"))


def split_rest(pieces: list[tuple], first: int) -> list[tuple]:
    """Deal the pieces of an unfilled last sequence to sequences whose lengths are powers of two, largest first.

    ``pieces`` are (document, start, length); returns them cut, with sequence and offset.
    """
    left = sum(p[2] for p in pieces)
    out, sequence, room, size = [], first - 1, 0, 0
    for document, start, length in pieces:
        while length:
            if not room:
                size = room = 1 << (left.bit_length() - 1)
                left -= size
                sequence += 1
            take = min(room, length)
            out.append((document, start, take, sequence, size - room))
            start, length, room = start + take, length - take, room - take
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Pieces of all rows of ``docs`` in sequences of at most ``size`` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A
    partition of the sorted rows fills its sequences without gaps; what its last
    one lacks is made up by cutting it at powers of two, so nothing is padded.
    ``sequence_id`` is unique, its high bits number the partition.

    A null or empty text is the end id alone. Equal texts lie side by side; ties
    are ordered by doc_id, and repeated rows are packed once each. A null doc_id
    is kept. Very long texts take as many sequences as they need. An empty table
    gives no rows; other columns are not read. ``size`` is a power of two.

    Texts are tokenised once; their ids are written to the shared folder, and
    only they are sorted. The sort key ends in the document, so no cell is hot.
    """
    path = tokenizer or default_tokenizer()
    kept = stored(tokenised(docs, path), "tokens")
    kind = word_ids(path).kind
    tie = F.xxhash64("ids")
    dealt = kept.withColumn("tie", tie).repartitionByRange("curve", "tie", "doc_id").sortWithinPartitions("curve", "tie", "doc_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        base = TaskContext.get().partitionId() << 32
        opener = zstandard.ZstdDecompressor()
        sequence = used = 0
        open_: list[tuple] = []  # pieces of the sequence that is being filled: ((doc_id, n, ids), start, length)
        rows: list[tuple] = []

        def put(document: tuple, start: int, length: int, number: int, offset: int) -> None:
            doc_id, n, ids = document
            crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
            rows.append((doc_id, start, length, crc, n, base + number, offset))

        def out() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
            rows.clear()
            return made

        for batch in batches:
            for doc_id, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                document = (doc_id, n, np.frombuffer(opener.decompress(data), kind))
                start = 0
                while start < n:
                    take = min(size - used, n - start)
                    open_.append((document, start, take))
                    start, used = start + take, used + take
                    if used == size:
                        offset = 0
                        for d, s, length in open_:
                            put(d, s, length, sequence, offset)
                            offset += length
                        open_, used, sequence = [], 0, sequence + 1
            if rows:
                yield out()
        for piece in split_rest(open_, sequence):
            put(*piece)
        if rows:
            yield out()

    return dealt.select("doc_id", "n", "ids").transform(in_arrow, pack, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
