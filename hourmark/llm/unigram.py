"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and log scores come from a public model file. The trie is built once on
the driver and sent to the tasks (a few MB, bounded by the vocabulary). Within a
task, the distinct words of a batch are segmented together: NumPy walks the trie
from all their positions at once and relaxes the best scores position by
position. Words are kept with their ids, as texts repeat them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmark.llm.common import arrow_rows

MARKER = "▁"
#: What an unknown character costs beside the worst piece.
UNKNOWN_COST = 10.0
CACHE_WORDS = 400_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class DoubleArray:
    """Trie of byte strings: the child of ``s`` by byte ``c`` is ``base[s] + c`` where ``check`` of it is ``s``."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][c]
            values[node] = value
        size = 2 * len(children) + 1024
        taken = bytearray(size)
        taken[0] = 1
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        slot = [0] * len(children)
        free = 1  # no free slot lies below
        for node in range(len(children)):  # parents come before their children
            value[slot[node]] = values[node]
            codes = sorted(children[node])
            if not codes:
                continue
            while taken[free]:
                free += 1
            at = max(free - codes[0], 1)
            while any(taken[at + c] for c in codes):
                at = taken.index(0, at + codes[0] + 1) - codes[0]
            base[slot[node]] = at
            for c in codes:
                taken[at + c] = 1
                check[at + c] = slot[node]
                slot[children[node][c]] = at + c
        end = max(slot) + 257
        self.base, self.check, self.value = base[:end], check[:end], value[:end]


class Unigram:
    """Encoder and decoder of one model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.unknown = model.unk_id()
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.shown: list[bytes] = [b""] * size
        keys = {}
        scores = np.zeros(size, np.float64)  # of singles; sums of many are exact only in doubles
        for i in range(size):
            scores[i] = model.get_score(i)
            if model.is_byte(i):
                self.shown[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                keys[piece.encode()] = i
                self.shown[i] = piece.replace(MARKER, " ").encode()
        if any(MARKER in k.decode().lstrip(MARKER) for k in keys):
            raise ValueError("a piece holds the marker after another character")
        self.scores, self.trie = scores, DoubleArray(keys)
        self.unknown_score = min(scores[list(keys.values())]) - UNKNOWN_COST
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.known: dict[bytes, bytes] = {}

    def segment(self, words: list[bytes]) -> list[list[int]]:
        """Best ids of each word: the highest sum of scores; of equal ones that whose last piece is longer."""
        flat = np.frombuffer(b"".join(words) + bytes(1), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(lengths) - lengths
        n = len(flat) - 1
        owner = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(n) - begins[owner]
        ends = (begins + lengths)[owner]
        starts = np.flatnonzero(flat[:n] & 0xC0 != 0x80)
        width = np.where(flat[starts] < 0x80, 1, np.where(flat[starts] < 0xE0, 2, np.where(flat[starts] < 0xF0, 3, 4)))
        trie = self.trie
        at, node, depth = starts, np.zeros(len(starts), np.int64), 0
        alone = np.zeros(n + 1, bool)
        wide = np.zeros(n + 1, np.int64)
        wide[starts] = width
        found_start, found_end, found_id = [], [], []
        while len(at):
            inside = at + depth < ends[at]
            at, node = at[inside], node[inside]
            step = trie.base[node] + flat[at + depth]
            fits = trie.check[step] == node
            at, node = at[fits], step[fits].astype(np.int64)
            depth += 1
            ids = trie.value[node]
            hit = ids >= 0
            found_start.append(at[hit])
            found_end.append(at[hit] + depth)
            found_id.append(ids[hit])
            alone[at[hit & (wide[at] == depth)]] = True
        lost = starts[~alone[starts]]
        start = np.concatenate([*found_start, lost])
        end = np.concatenate([*found_end, lost + wide[lost]])
        ids = np.concatenate([*found_id, np.full(len(lost), self.unknown, np.int32)])
        score = np.where(ids == self.unknown, self.unknown_score, self.scores[ids])
        order = np.argsort(place[start], kind="stable")
        start, end, ids, score = start[order], end[order], ids[order], score[order]
        # scores, back pointers and pieces by (word, end); a word's ends are shifted by its number, as it has one more than bytes
        best = np.full(n + len(words), -np.inf)
        back, piece = np.zeros(len(best), np.int64), np.zeros(len(best), np.int32)
        best[begins + np.arange(len(words))] = 0
        shift = owner[start]
        cuts = np.flatnonzero(np.diff(place[start])) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(start)]):
            s, e = start[low:high] + shift[low:high], end[low:high] + shift[low:high]
            total = best[s] + score[low:high]
            better = total > best[e]
            e = e[better]
            best[e], back[e], piece[e] = total[better], s[better], ids[low:high][better]
        back_list, piece_list = back.tolist(), piece.tolist()
        out = []
        for k, word in enumerate(words):
            first = int(begins[k]) + k
            now, path = first + len(word), []
            while now > first:
                before = back_list[now]
                if piece_list[now] == self.unknown:
                    path += [self.bytes[b] for b in reversed(word[before - first : now - first])]
                else:
                    path.append(piece_list[now])
                now = before
            out.append(path[::-1])
        return out

    def _words(self, text: str) -> list[bytes]:
        """Cut before every run of spaces that follows another character; one leading space is implied."""
        words = text.encode("utf-8", "replace").split(b" ")
        if b"" not in words:
            return words
        joined, held = [], 0
        for k, word in enumerate(words):
            if word or k == len(words) - 1:
                joined.append(b" " * held + word)
                held = 0
            else:
                held += 1
        return joined

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, by the convention of a leading marker and escaped spaces."""
        split = [self._words(t) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        new = sorted(set().union(*split).difference(known), key=len)  # alike lengths together
        marker = MARKER.encode()
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            for word, ids in zip(part, self.segment([marker + w.replace(b" ", marker) for w in part])):
                known[word] = np.array(ids, self.kind).tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), self.kind) for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids: bytes joined, markers turned to spaces, the leading one dropped."""
        joined = b"".join(map(self.shown.__getitem__, ids))
        return joined.removeprefix(b" ").decode("utf-8", "replace")

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Every row's ids under the model, and what decoding them gives.

    Returns doc_id, ids (array), n_pieces, n_byte_pieces, ids_crc32 (little-endian
    unsigned 32-bit ids), decoded_sha256 and round_trip (whether decoding restores
    the text). A null text counts as empty: no ids, round trip true. A text that
    holds the marker character itself decodes with a space there, so its round
    trip is false. Repeated rows and null doc_ids are kept. An empty table gives
    no rows. Other columns are not read. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(Unigram(model or default_model()))  # bounded by the vocabulary

    def make():
        unigram = held.value
        is_byte = np.zeros(len(unigram.shown), bool)
        is_byte[[b for b in unigram.bytes if b != unigram.unknown]] = True

        def step(batch: pa.RecordBatch) -> Iterable[dict]:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, text, ids in zip(batch.column(0).to_pylist(), texts, unigram.encode(texts)):
                decoded = unigram.decode(ids.tolist())
                yield {
                    "doc_id": doc_id, "ids": ids, "n_pieces": len(ids), "n_byte_pieces": int(is_byte[ids].sum()), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()),
                    "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest(), "round_trip": decoded == text,
                }

        return step

    return arrow_rows(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), make,
        "doc_id bigint, ids array<int>, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean", rows=256,
    )
