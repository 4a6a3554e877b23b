"""Byte-level pre-tokens of whole batches of texts, by array operations instead of a regular expression.

The split is that of the pattern of public byte-level vocabularies:
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Characters of a text that are split at once; a longer one is cut where a run of white space begins.
CHUNK_CHARS = 1_000_000
_GAP = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")
#: Odd, so that its powers have inverses modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def char_classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        chars = "".join(map(chr, range(low, high)))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
            for m in regex.finditer(pattern, chars):
                table[low + m.start() : low + m.end()] = kind
    return table


def segments(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Pieces of text of about ``size`` characters whose words are together the text's.

    No word goes on from another character into white space, so a cut before white space divides none. Only a run of ``size``
    characters without any makes a longer piece.
    """
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


class Words(NamedTuple):
    """Pre-tokens: bytes buf[starts[i]:ends[i]], in order; text t has the words from first[t] up to first[t + 1]."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def split_words(texts: list[str]) -> Words:
    joined = "".join(texts)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    buf = np.frombuffer(joined.encode(), np.uint8)
    n = len(chars)
    text_at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=text_at[1:])
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(buf, empty, empty, np.zeros(len(texts) + 1, np.int64))
    kind = char_classes()[chars]
    new_text = np.zeros(n + 1, bool)
    new_text[text_at] = True
    run = new_text[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = np.append(run, True)
    # Where a run of other characters follows white space, the last white character stands apart, or joins it if it is U+0020.
    at = np.flatnonzero(run[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~new_text[1:n]) + 1
    start[at - 1] = True
    start[at[chars[at - 1] == 0x20]] = False
    # 's and its like stand apart where a single apostrophe begins a word.
    q = np.flatnonzero((chars[:-1] == 0x27) & start[:n][:-1])
    q = q[(kind[q + 1] == LETTER) & ~new_text[q + 1]]
    c1 = chars[q + 1]
    c2 = np.where((q + 2 < n) & ~new_text[np.minimum(q + 2, n)], chars[np.minimum(q + 2, n - 1)], 0)
    short = np.isin(c1, [ord(c) for c in "stmd"])
    long = ~short & (((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l"))))
    start[q[short | long] + 1] = False
    start[q[short] + 2] = True
    start[q[long] + 3] = True
    where = np.flatnonzero(start)
    byte_at = np.zeros(n + 1, np.int64)
    np.cumsum(1 + (chars >= 0x80).view(np.int8) + (chars >= 0x800) + (chars >= 0x10000), out=byte_at[1:])
    edges = byte_at[where]
    return Words(buf, edges[:-1], edges[1:], np.searchsorted(where, text_at))


#: Powers are kept for texts of so many bytes; for longer ones they are computed each time.
KEPT_POWERS = 1 << 21


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for base in (BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return tuple(out)


@cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _power_tables(KEPT_POWERS)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial by prefix sums, then mixed with the length.

    Different spans can share it, structured ones of some hundred bytes on purpose: it sorts, and tells nothing apart.
    """
    n = len(buf)
    up, down = _kept_powers() if n < KEPT_POWERS else _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h ^ (ends - starts).astype(np.uint64))


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one span of each kind, the kind of every span); spans are of one kind when their bytes are equal.

    Spans of one hash are compared with their first byte by byte; where that fails, all are told apart by a table of their bytes.
    """
    _, first, inverse = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    lengths = ends - starts
    like = first[inverse]
    if (lengths == lengths[like]).all() and (gather_spans(buf, starts, lengths) == gather_spans(buf, starts[like], lengths)).all():
        return first, inverse
    kinds: dict[bytes, int] = {}
    firsts: list[int] = []
    inverse = np.empty(len(starts), np.int64)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        kind = inverse[i] = kinds.setdefault(buf[a:b].tobytes(), len(kinds))
        if kind == len(firsts):
            firsts.append(i)
    return np.array(firsts, np.int64), inverse


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gather_spans(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[0]:starts[0]+lengths[0]], values[starts[1]:...], ... in one array."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return values[:0]
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]
