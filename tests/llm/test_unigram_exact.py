"""Ids of the unigram operator against a plain Viterbi in exact numbers."""

from __future__ import annotations

import random
from fractions import Fraction

from hourmark.llm import unigram


def _ids(model, pieces, word):
    """Highest exact sum of scores; of equal ones that whose last piece is longer. Unknown characters become bytes."""
    unknown = Fraction(min(s for _, s in pieces.values())) - 10
    longest = max(map(len, pieces))
    best = [(Fraction(0), None, None)]
    for end in range(1, len(word) + 1):
        top = None
        for start in range(max(0, end - longest), end):  # the longest last piece first
            part = word[start:end]
            if part in pieces:
                i, score = pieces[part]
            elif end - start == 1:
                i, score = None, unknown
            else:
                continue
            total = best[start][0] + Fraction(score)
            if top is None or total > top[0]:
                top = (total, start, [i] if i is not None else [model.bytes[b] for b in part.encode()])
        best.append(top)
    out, now = [], len(word)
    while now:
        _, before, ids = best[now]
        out, now = ids + out, before
    return out


def test_ids_equal_an_exact_viterbi():
    import sentencepiece

    model = unigram.Unigram(unigram.default_model())
    reader = sentencepiece.SentencePieceProcessor(model_file=unigram.default_model())
    pieces = {reader.id_to_piece(i): (i, reader.get_score(i)) for i in range(reader.vocab_size()) if not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i))}
    rng = random.Random(5)
    shown = [p for p in pieces if not p.startswith("▁") and len(p) > 1]
    words = ["".join(rng.choices(shown, k=rng.randint(2, 12))) for _ in range(200)]
    words += [w[:3] + "\U0001f9ff" * rng.randint(1, 60) + w[3:] for w in words[:100]]
    words += ["\n" + w for w in words[:100]] + ["".join(rng.choices(shown, k=900)), "人と" * 40 + "theretion", "  " + words[0]]
    for word in words:
        text = word.replace("▁", "")
        want = [i for w in model._words(text) for i in _ids(model, pieces, "▁" + w.decode().replace(" ", "▁"))]
        assert model.encode([text])[0].tolist() == want, text
