"""Fuzzy string scores, several at once for a batch of pairs in one Arrow round trip, in numpy over all pairs of a batch.

ratio: 200 * LCS / (sum of lengths), partial: the best window, token_set and token_sort: of words, and Jaro-Winkler (0 to 1).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; the rows of the table are the bits of one integer."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        match = row & where.get(ch, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length in the longer one, cut at the ends."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    best = 0.0
    for short, long in {(a, b), (b, a)} if len(a) == len(b) else {(a, b) if len(a) < len(b) else (b, a)}:
        if short in long:
            return 100.0
        n = len(short)
        best = max([best, *(ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))])
    return best


def _apart(distance: int, total: int) -> float:
    return 100.0 - 100.0 * distance / total if total else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """The best of: the words that only one side has against each other, the shared words against each side."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = x & y
    if shared and (x <= y or y <= x):
        return 100.0
    only_x, only_y, both = (" ".join(sorted(s)) for s in (x - y, y - x, shared))
    gap = 1 if both else 0
    whole_x, whole_y = len(both) + gap + len(only_x), len(both) + gap + len(only_y)
    best = _apart(len(only_x) + len(only_y) - 2 * lcs_length(only_x, only_y), whole_x + whole_y)
    if both:
        best = max(best, _apart(gap + len(only_x), len(both) + whole_x), _apart(gap + len(only_y), len(both) + whole_y))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by up to four equal first characters where it is over 0.7."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, first = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                first.append(ch)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [b[j] for j in range(len(b)) if taken[j]]
    swaps = sum(p != q for p, q in zip(first, second, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


#: Longest strings that a batch's matrices hold; pairs with a longer one are scored one by one. Cells of a matrix at once.
MATRIX_CHARS, CELLS = 64, 1 << 18


def _matrix(texts: list[str], width: int) -> np.ndarray:
    """Code points of each text in a row, -1 after its end."""
    out = np.full((len(texts), width), -1, np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _in_batches(a: list[str], b: list[str], one: Callable[[str, str], float], many: Callable[[list[str], list[str]], np.ndarray]) -> np.ndarray:
    """Scores of distinct pairs: long ones by `one`, the others by `many`, those of like length together so that matrices are full."""
    out = np.empty(len(a))
    size = np.fromiter((max(len(x), len(y)) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    order = np.argsort(size, kind="stable")
    short = order[size[order] <= MATRIX_CHARS]
    step = max(1, CELLS // MATRIX_CHARS)
    for at in range(0, len(short), step):
        some = short[at : at + step]
        out[some] = many([a[i] for i in some], [b[i] for i in some])
    for i in order[len(short) :].tolist():
        out[i] = one(a[i], b[i])
    return out


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """lcs_length of each pair; the rows of all pairs' tables are bits of one 64-bit integer each, and step together."""

    def many(a: list[str], b: list[str]) -> np.ndarray:
        wide = [max(1, max(map(len, x), default=0)) for x in (a, b)]
        x, y = _matrix(a, wide[0]), _matrix(b, wide[1])
        bits = np.uint64(1) << np.arange(wide[0], dtype=np.uint64)
        sizes = np.fromiter(map(len, a), np.int64, len(a))
        full = np.array([(1 << n) - 1 for n in range(MATRIX_CHARS + 1)], np.uint64)[sizes]
        row = full.copy()
        for j in range(wide[1]):
            ch = y[:, j : j + 1]
            match = row & np.where((x == ch) & (ch >= 0), bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
            row = ((row + match) | (row - match)) & full
        return sizes - np.bitwise_count(row)

    return _in_batches(a, b, lcs_length, many).astype(np.int64)


def _ratios(a: list[str], b: list[str]) -> np.ndarray:
    total = np.fromiter((len(x) + len(y) for x, y in zip(a, b, strict=True)), float, len(a))
    return np.where(total > 0, 200.0 * lcs_lengths(a, b) / np.maximum(total, 1), 100.0)


def _partials(a: list[str], b: list[str]) -> np.ndarray:
    """Windows of all pairs are pairs themselves, scored together; equal ones once."""
    out, of, shorts, windows = np.zeros(len(a)), [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if not x or not y:
            out[i] = 100.0 if x == y else 0.0
            continue
        for short, long in {(x, y), (y, x)} if len(x) == len(y) else {(x, y) if len(x) < len(y) else (y, x)}:
            if short in long:
                out[i] = 100.0
                break
            cut = {long[max(0, k) : k + len(short)] for k in range(1 - len(short), len(long))}
            of += [i] * len(cut)
            shorts += [short] * len(cut)
            windows += cut
    if of:
        np.maximum.at(out, of, _ratios(shorts, windows))
    return out


def _token_sets(a: list[str], b: list[str]) -> np.ndarray:
    out, at, left, right, rest = np.zeros(len(a)), [], [], [], []
    for i, (s, t) in enumerate(zip(a, b, strict=True)):
        x, y = set(s.split()), set(t.split())
        if not x or not y:
            continue
        shared = x & y
        if shared and (x <= y or y <= x):
            out[i] = 100.0
            continue
        only_x, only_y, both = (" ".join(sorted(w)) for w in (x - y, y - x, shared))
        at.append(i)
        left.append(only_x)
        right.append(only_y)
        rest.append((len(both), 1 if both else 0))
    if at:
        m, n = (np.fromiter(map(len, w), float, len(w)) for w in (left, right))
        both, gap = np.array(rest, float).T
        whole_m, whole_n = both + gap + m, both + gap + n
        best = 100.0 - 100.0 * (m + n - 2 * lcs_lengths(left, right)) / (whole_m + whole_n)
        sides = np.maximum(100.0 - 100.0 * (gap + m) / (both + whole_m), 100.0 - 100.0 * (gap + n) / (both + whole_n))
        out[at] = np.where(both > 0, np.maximum(best, sides), best)
    return out


def _token_sorts(a: list[str], b: list[str]) -> np.ndarray:
    return _ratios(*[[" ".join(sorted(t.split())) for t in side] for side in (a, b)])


def _jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    """Characters of all pairs' left sides look for their partners together, one place after the other."""

    def many(a: list[str], b: list[str]) -> np.ndarray:
        wide = [max(1, max(map(len, x), default=0)) for x in (a, b)]
        x, y = _matrix(a, wide[0]), _matrix(b, wide[1])
        m, n = (np.fromiter(map(len, s), np.int64, len(s)) for s in (a, b))
        reach = np.maximum(np.maximum(m, n) // 2 - 1, 0)
        taken, first = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
        rows, places = np.arange(len(a)), np.arange(wide[1])
        for i in range(wide[0]):
            free = (y == x[:, i : i + 1]) & (x[:, i : i + 1] >= 0) & ~taken & (np.abs(places - i) <= reach[:, None])
            at = free.argmax(axis=1)
            hit = free[rows, at]
            taken[rows[hit], at[hit]] = True
            first[:, i] = hit
        k = first.sum(axis=1)
        # matched characters in order, side by side
        sides = []
        for chars, mask in ((x, first), (y, taken)):
            packed = np.full((len(a), max(1, int(k.max(initial=0)))), -1, np.int32)
            r, c = np.nonzero(mask)
            packed[r, np.arange(len(r)) - np.repeat(np.cumsum(k) - k, k)] = chars[r, c]
            sides.append(packed)
        swaps = (sides[0] != sides[1]).sum(axis=1) // 2
        kk = np.maximum(k, 1)
        jaro = np.where(k > 0, (kk / np.maximum(m, 1) + kk / np.maximum(n, 1) + (kk - swaps) / kk) / 3, 0.0)
        four = min(4, wide[0], wide[1])
        same = np.cumprod((x[:, :four] == y[:, :four]) & (x[:, :four] >= 0), axis=1).sum(axis=1)
        out = np.where(jaro > 0.7, jaro + same * 0.1 * (1 - jaro), jaro)
        return np.where((m == 0) | (n == 0), (m == n).astype(float), out)

    return _in_batches(a, b, jaro_winkler, many)


SCORERS: dict[str, Callable[[list[str], list[str]], np.ndarray]] = {"ratio": _ratios, "partial": _partials, "token_set": _token_sets, "token_sort": _token_sorts, "jaro_winkler": _jaro_winklers}


def scored(wanted: Sequence[tuple[str, str, Column, Column]]) -> Column:
    """A struct with a field for each (name, scorer, left, right); nulls count as empty. Equal pairs of a batch are scored once, all pairs of a batch together."""
    names = [w[0] for w in wanted]
    kinds = [w[1] for w in wanted]

    @F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for k, kind in enumerate(kinds):
            number: dict[tuple[str, str], int] = {}
            at = [number.setdefault((a or "", b or ""), len(number)) for a, b in zip(columns[2 * k].to_pylist(), columns[2 * k + 1].to_pylist(), strict=True)]
            values = SCORERS[kind]([a for a, _ in number], [b for _, b in number])
            out.append(pa.array(np.asarray(values, float)[at] if at else [], pa.float64()))
        return pa.StructArray.from_arrays(out, names=names)

    return run(*[c for w in wanted for c in w[2:]])
