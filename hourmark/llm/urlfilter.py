"""URL filter: all wildcard rules in one bit-parallel automaton.

Every rule is a glob over the canonical URL and becomes a run of bits in a
multiword Shift-And mask. One pass over the bytes of a URL moves all rules at
once: ``D = ((D << 1) & B[c]) | (D & L[c])``, where ``B`` holds the byte each
state waits for and ``L`` the states in which a ``*`` may stay. NumPy applies
the step to all URLs of an Arrow batch together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmark.session import ship_package

#: Separates host and path in the canonical form; no UTF-8 text holds it.
BOUNDARY = 0xFF

#: Host and path rules with their verdicts.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: (host glob, path glob) pairs that block a URL no host rule decides.
BLOCK_GLOBS = (("*casino*", "*"), ("*.free-bets.*", "*"), ("*.ads-track.*", "*"), ("*", "*/track?/*"), ("*", "*.exe"))


@dataclass
class Automaton:
    """Shift-And masks of (host glob, path glob) patterns; ``*`` and ``?`` stay within their part.

    ``?`` stands for one byte of UTF-8. Patterns may be longer than a word.
    """

    patterns: list[tuple[str, str]]
    words: int = field(init=False)

    def __post_init__(self) -> None:
        starts, accepts, bits = [], [], 0
        waits: list[tuple[int, int]] = []  # (bit, byte or -1 for any byte of the part)
        stays: list[int] = []
        for host, path in self.patterns:
            starts.append(bits)
            for unit in [*host.encode(), -BOUNDARY, *path.encode()]:
                if unit == ord("*"):
                    stays.append(bits)
                else:
                    bits += 1
                    waits.append((bits, BOUNDARY if unit == -BOUNDARY else -1 if unit == ord("?") else unit))
            accepts.append(bits)
            bits += 1
        self.words = max(1, -(-bits // 64))
        self.waits = np.zeros((256, self.words), np.uint64)
        self.stays = np.zeros((256, self.words), np.uint64)
        inside = np.arange(256) != BOUNDARY
        for bit, byte in waits:
            self.waits[inside if byte < 0 else byte, bit >> 6] |= np.uint64(1 << (bit & 63))
        for bit in stays:
            self.stays[inside, bit >> 6] |= np.uint64(1 << (bit & 63))
        self.start = np.zeros(self.words, np.uint64)
        for bit in starts:
            self.start[bit >> 6] |= np.uint64(1 << (bit & 63))
        self.accepts = accepts

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """One row per text, one column per pattern: whether the pattern fits the whole text."""
        out = np.zeros((len(texts), len(self.patterns)), bool)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begins = (np.cumsum(lengths) - lengths)[order]
        left = lengths[order]
        state = np.tile(self.start, (len(texts), 1))
        active = len(texts)
        for t in range(int(left[0]) if len(texts) else 0):
            active = int(np.searchsorted(-left, -t, side="left"))  # the texts longer than t
            byte = flat[begins[:active] + t]
            now = state[:active]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.waits[byte]) | (now & self.stays[byte])
        for k, bit in enumerate(self.accepts):
            out[order, k] = (state[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1) == 1
        return out


_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def url_parts(url: str | None) -> tuple[str, str]:
    """Host (ASCII lower case) and path; both empty for null or a text without ``://``."""
    found = _PARTS.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def canonical(host: str, path: str) -> bytes:
    """``.host``, the boundary, ``path``: a rule for a domain starts with ``*.``."""
    return b"." + host.encode("utf-8", "replace") + bytes([BOUNDARY]) + path.encode("utf-8", "replace")


def judge_urls(
    df: DataFrame, url: str = "url", rules: tuple = HOST_RULES, block_globs: tuple = BLOCK_GLOBS
) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block) of every row.

    A rule ``host/path`` fits the host and its subdomains where the URL's path
    starts with the rule's; the longest wins, of equally long ones the one listed
    first. URLs without a fitting rule are blocked by any of ``block_globs`` and
    allowed otherwise. A null URL, an empty one or one without ``://`` has an
    empty host and path, no rule, and is judged by the globs on the empty form
    (allow by default). Repeated rows are judged alike. Columns of these four
    names in ``df`` are replaced; others stay. No shuffle.
    """
    ordered = sorted(enumerate(rules), key=lambda x: (-len(x[1][0]), x[0]))
    listed = [(text, verdict) for _, (text, verdict) in ordered]
    globs = [("*." + text.partition("/")[0].lower(), "/" + text.partition("/")[2] + "*") for text, _ in listed] + list(block_globs)
    n_rules = len(listed)
    ship_package(df.sparkSession)

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        automaton = Automaton(globs)
        parts = [url_parts(u) for u in urls]
        hits = automaton.matches([canonical(h, p) for h, p in parts])
        rule: list = [None] * len(parts)
        verdict = np.where(hits[:, n_rules:].any(axis=1), "block", "allow").astype(object)
        if n_rules:
            fits = hits[:, :n_rules]
            for i in np.flatnonzero(fits.any(axis=1)):
                rule[i], verdict[i] = listed[int(fits[i].argmax())]
        return pd.DataFrame({"host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": rule, "verdict": verdict})

    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return df.select(*rest, judge(F.col(f"`{url}`")).alias("__judged")).select(*rest, "__judged.*")
