"""Matching-blocks ratios (difflib's) of many pairs of texts at once: numpy bounds them, Python works out what the bounds let through."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd

#: Words of 64 bits that are worked on together, steps between two looks at what is still open, characters that a match grows by at once,
#: and the length from which difflib leaves out popular characters.
WORDS, STRIDE, SLICE, POPULAR = 8_192, 64, 32, 200


def matched(a: str, b: str, needed: float = 0, of_a: list[int] | None = None, of_b: list[int] | None = None) -> int:
    """Characters in difflib's matching blocks of a and b; -1 once ``needed`` is out of reach.

    In a long b, popular characters only lengthen a match; so all but the others is passed over where difflib looks at every character of a
    for each block. ``of_a`` and ``of_b`` are the places in a and b of the characters that aren't popular in b.
    """
    if len(b) < POPULAR:
        return sum(block.size for block in SequenceMatcher(None, a, b).get_matching_blocks())
    if of_a is None or of_b is None:
        most = len(b) // 100 + 1
        few = {c for c, n in Counter(b).items() if n <= most}
        of_a, of_b = ([i for i, c in enumerate(t) if c in few] for t in (a, b))
    places: dict[str, list[int]] = {}
    for j in of_b:
        places.setdefault(b[j], []).append(j)
    spots = [i for i in of_a if a[i] in places]
    total, open_, reach = 0, [(0, len(a), 0, len(b))], min(len(a), len(b))
    while open_:
        a_low, a_high, b_low, b_high = open_.pop()
        i, j, k, last, run = a_low, b_low, 0, -2, {}
        for s in spots[bisect_left(spots, a_low) : bisect_left(spots, a_high)]:
            longer: dict[int, int] = {}
            if s != last + 1:
                run = {}
            for t in places[a[s]]:
                if t >= b_high:
                    break
                if t >= b_low:
                    n = longer[t] = run.get(t - 1, 0) + 1
                    if n > k:
                        i, j, k = s - n + 1, t - n + 1, n
            run, last = longer, s
        while i - SLICE >= a_low and j - SLICE >= b_low and a[i - SLICE : i] == b[j - SLICE : j]:
            i, j, k = i - SLICE, j - SLICE, k + SLICE
        while i > a_low and j > b_low and a[i - 1] == b[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k + SLICE <= a_high and j + k + SLICE <= b_high and a[i + k : i + k + SLICE] == b[j + k : j + k + SLICE]:
            k += SLICE
        while i + k < a_high and j + k < b_high and a[i + k] == b[j + k]:
            k += 1
        reach -= min(a_high - a_low, b_high - b_low)
        if k:
            total += k
            before, after = min(i - a_low, j - b_low), min(a_high - i, b_high - j) - k
            reach += before + k + after
            if before:
                open_.append((a_low, i, b_low, j))
            if after:
                open_.append((i + k, a_high, j + k, b_high))
        if reach < needed:
            return -1
    return total


def _subsequences(text: Callable[[int], np.ndarray], symbols: int, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of texts a[i] and b[i], or -1 once ``least[i]`` is out of reach.

    A bit for each character of a, one step for each of b, for all pairs at once.
    """
    words = -(-int(sizes[a].max()) // 64)
    mine, own = np.unique(a, return_inverse=True)
    masks = np.zeros((len(mine), symbols + 1, words * 64), dtype=np.uint8)
    for row, x in zip(masks, mine, strict=True):
        row[text(x), np.arange(sizes[x])] = 1
    masks = np.packbits(masks, axis=2, bitorder="little").view(np.uint64).reshape(len(mine) * (symbols + 1), words)
    steps = int(sizes[b].max())
    theirs, other = np.unique(b, return_inverse=True)
    read = np.full((steps, len(theirs)), symbols, dtype=np.int64)  # the last symbol is in no text
    for i, x in enumerate(theirs):
        read[: sizes[x], i] = text(x)
    whole = np.zeros((len(a), words * 64), dtype=np.uint8)
    whole[np.arange(words * 64) < sizes[a][:, None]] = 1
    free = whole = np.packbits(whole, axis=1, bitorder="little").view(np.uint64)
    found, at = np.full(len(a), -1, dtype=np.int64), np.arange(len(a))
    own = own * (symbols + 1)
    for step in range(steps):
        met = free & masks.take(own + read[step].take(other), axis=0)
        added = free + met
        over = added < free
        while words > 1 and over[:, :-1].any():
            carry = over[:, :-1]
            added[:, 1:] += carry
            over = np.zeros_like(over)
            over[:, 1:] = carry & (added[:, 1:] == 0)
        free = added | (free ^ met)
        if (step + 1) % STRIDE == 0 or step + 1 == steps:
            got = sizes[a[at]] - np.bitwise_count(free & whole).sum(axis=1, dtype=np.int64)
            left = np.maximum(sizes[b[at]] - step - 1, 0)
            reach = got + left >= least[at]
            done = reach & (left == 0)
            found[at[done]] = got[done]
            stay = reach & ~done
            if not stay.any():
                break
            if not stay.all():
                at, own, other, free, whole = at[stay], own[stay], other[stay], free[stay], whole[stay]
    return found


def ratios(left: pd.Series, right: pd.Series, least: pd.Series) -> np.ndarray:
    """The ratio of (left, right), which isn't symmetric, where it is ``least`` at least; else 0. ``least`` from 1 on asks for equal texts only.

    Matching blocks are a common subsequence, so the ratio is worked out only where characters in common, and then the longest common
    subsequence, may reach ``least``; both are found for all pairs together, and once for pairs that come again.
    """
    if not len(left):
        return np.zeros(0)
    least = least.to_numpy(dtype=np.float64)
    codes, texts = pd.factorize(pd.concat([left, right], ignore_index=True))
    a, b = codes[: len(left)], codes[len(left) :]
    _, first, back = np.unique(a * len(texts) + b, return_index=True, return_inverse=True)
    lowest = np.full(len(first), np.inf)
    np.minimum.at(lowest, back, least)
    out = _ratios(texts, a[first], b[first], lowest)[back]
    return np.where((a == b) | ((least < 1) & (out >= least)), out, 0.0)


def _ratios(texts: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The ratios of the texts a[i] and b[i], where they are ``least[i]`` at least; else 0."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.where((a == b) & (sizes[a] > 0), 1.0, 0.0)
    keep = np.flatnonzero((a != b) & (sizes[a] > 0) & (sizes[b] > 0) & (least < 1))
    if not len(keep):
        return out
    used = np.unique(np.concatenate([a[keep], b[keep]]))
    ends = np.cumsum(sizes[used])
    points = np.frombuffer("".join(texts[used]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    known = np.flatnonzero(np.bincount(points))
    rank = np.zeros(known[-1] + 1, dtype=np.int64)
    rank[known] = np.arange(len(known))
    coded, place = rank[points], np.zeros(len(texts), dtype=np.int64)
    place[used] = np.arange(len(used))
    counts = np.bincount(np.repeat(np.arange(len(used)), sizes[used]) * len(known) + coded, minlength=len(used) * len(known)).reshape(len(used), len(known)).astype(np.int32)
    both = np.minimum(counts[place[a[keep]]], counts[place[b[keep]]]).sum(axis=1)
    total = sizes[a] + sizes[b]
    keep = keep[2.0 * both / total[keep] >= least[keep]]
    text = lambda x: coded[ends[place[x]] - sizes[x] : ends[place[x]]]
    # Fewer by one than the bound asks for, as it is made of doubles; the ratio itself is compared in the end.
    needed = np.ceil(least * total / 2.0) - 1
    # A long right text has few characters that start a match, so its ratio costs less than the bound.
    far = sizes[b[keep]] >= POPULAR
    telling: dict[int, tuple[np.ndarray, list[int]]] = {}
    for i in keep[far]:
        x, y = a[i], b[i]
        if y not in telling:
            few = counts[place[y]] <= sizes[y] // 100 + 1
            telling[y] = few, np.flatnonzero(few[text(y)]).tolist()
        few, of_b = telling[y]
        found = 2.0 * matched(texts[x], texts[y], needed[i], np.flatnonzero(few[text(x)]).tolist(), of_b) / total[i]
        out[i] = found if found >= least[i] else 0.0
    # The shorter text has the bits; pairs of like sizes go together.
    keep = keep[~far]
    short, long = np.where(sizes[a] <= sizes[b], a, b), np.where(sizes[a] <= sizes[b], b, a)
    keep = keep[np.lexsort((sizes[long[keep]], -(-sizes[short[keep]] // 64)))]
    start = 0
    while start < len(keep):
        words = -(-sizes[short[keep[start:]]] // 64)
        some = keep[start : start + max(1, int(np.searchsorted(np.arange(1, len(words) + 1) * words, WORDS, "right")))]
        start += len(some)
        longest = _subsequences(text, len(known), sizes, short[some], long[some], needed[some])
        for i in some[longest >= 0]:
            found = 2.0 * matched(texts[a[i]], texts[b[i]]) / total[i]
            out[i] = found if found >= least[i] else 0.0
    return out
