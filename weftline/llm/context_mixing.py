"""Online logistic context mixing over running text, in blocks of numpy arrays.

A byte is spelled by the binary decisions of a Huffman tree over all training bytes, so that a common byte takes few of them. Each of three contexts
(the last two, four and six bytes, which cross the borders of words) predicts each decision from how often the corpus went either
way there. The predictions are stretched and added with weights that are gated by which contexts are known, and how well; a map
from the sum, by decision, refines the probability. Weights and map learn online, from training bytes only: a batch is
predicted, then learned from.

Places of a block that have the same contexts and byte get the same prediction, so they are computed once. A training byte
is predicted from all other training bytes: its own occurrence is left out of its counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

#: Contexts, by their bytes; the longest comes last and holds the others.
ORDERS = (2, 4, 6)
CONTEXTS = len(ORDERS)
#: Bytes before the first of a text, as all contexts see them.
BEFORE = b"\n" * 8
#: What a byte's text is to the model: counted, learned from by weights and map, or held out.
COUNTED, TAUGHT, HELD = 0, 1, 2
#: Places that are looked at together, bytes between two steps of learning, bytes whose decisions are laid out at once.
BLOCK, BATCH, LAID_OUT = 1 << 20, 512, 1 << 14
#: What is added to counts; first weight; rates of the weights and of the map; what a cell of the map counts for at first.
ADDED, FIRST, RATE, PRIOR = 0.02, 0.35, 0.03, 20.0
#: Cells of the map on each side of zero, and cells for one unit of the stretched probability.
REACH, CELLS = 16, 2
#: Counts are told apart up to this one, then by so many steps for a factor of two.
EXACT, STEPS = 64, 6

_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_MIX), -1, 1 << 64))
_EIGHT = np.uint64(8)


def level(n: np.ndarray) -> np.ndarray:
    """A count in one byte."""
    n = np.asarray(n, np.int64)
    high = EXACT + np.floor(STEPS * np.log2(np.maximum(n, EXACT) / EXACT) + 1e-9)
    return np.where(n < EXACT, n, np.minimum(high, 255)).astype(np.uint8)


_VALUE = np.where(np.arange(256) < EXACT, np.arange(256.0), EXACT * 2 ** ((np.arange(256.0) - EXACT + 0.5) / STEPS))
_SAME, _OTHER = np.divmod(np.arange(1 << 16), 256)
#: Of a code (level of the count of what came, level of the count of the other way): the stretched probability, and how well the context is known.
STRETCH = np.log((_VALUE[_SAME] + ADDED) / (_VALUE[_OTHER] + ADDED)).astype(np.float32)
_TOTAL = _VALUE[_SAME] + _VALUE[_OTHER]
_GRADE = np.where(_TOTAL > 0, np.minimum(12, np.floor(np.log2(np.maximum(_TOTAL, 1)) + 1e-9) + 1), 0)
KNOWN = np.where((_SAME == 0) | (_OTHER == 0), _GRADE, _GRADE + 12).astype(np.uint8)
GRADES = 25
#: The code without the occurrence itself.
LEFT_OUT = (np.where((_SAME > 0) & (_SAME <= EXACT), _SAME - 1, _SAME) * 256 + _OTHER).astype(np.uint16)
GATES = 1 << CONTEXTS


class Code:
    """A Huffman tree of bytes. Bytes are ranked from left to right, so that a node holds a range of ranks."""

    def __init__(self, counts: np.ndarray):
        """counts: of each of 256 bytes; bytes that don't occur have a place in the tree, too."""
        heap = [(int(n) + 1, b, (b,)) for b, n in enumerate(counts)]
        heapq.heapify(heap)
        name, children = 256, {}
        while len(heap) > 1:
            (m, _, a), (n, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            children[name] = (a, b)
            heapq.heappush(heap, (m + n, name, (name,)))
            name += 1
        paths, todo, order = {}, [(heap[0][2][0], ())], []
        while todo:
            at, path = todo.pop()
            if at < 256:
                paths[at] = path
                order.append(at)
                continue
            (left,), (right,) = children[at]
            todo += [(right, (*path, (at, 1))), (left, (*path, (at, 0)))]
        self.rank = np.zeros(256, np.uint8)
        self.rank[order] = np.arange(256)
        self.length = np.array([len(paths[b]) for b in order], np.int64)
        deep = int(self.length.max())
        self.node, self.bit = np.zeros((256, deep), np.int64), np.zeros((256, deep), bool)
        self.low, self.high = np.zeros((256, deep + 1), np.uint64), np.zeros((256, deep + 1), np.uint64)
        spans: dict[int, tuple[int, int]] = {}
        for r, b in enumerate(order):
            for at, _ in paths[b]:
                a, z = spans.get(at, (r, r))
                spans[at] = (min(a, r), max(z, r))
        for r, b in enumerate(order):
            for d, (at, bit) in enumerate(paths[b]):
                self.node[r, d], self.bit[r, d] = at - 256, bit
                self.low[r, d], self.high[r, d] = spans[at][0], spans[at][1] + 1
            self.low[r, len(paths[b])], self.high[r, len(paths[b])] = r, r + 1


def lowered(raw: bytes) -> bytes:
    """A text as it is scored: A-Z lower-cased, its words with a blank between, and its end."""
    return b" ".join(raw.lower().split()) + b"\n"


def contexts(raw: np.ndarray, code: Code) -> list[np.ndarray]:
    """For each place from len(BEFORE) on and each context: context and rank of the byte there, in 64 bits."""
    first, n = len(BEFORE), len(raw)
    byte, rank = raw.astype(np.uint64), code.rank[raw].astype(np.uint64)
    keys = []
    for order in ORDERS:
        k = byte[first - order : n - order].copy()
        for j in range(order - 1, 0, -1):
            k <<= _EIGHT
            k |= byte[first - j : n - j]
        k <<= _EIGHT
        k |= rank[first:]
        keys.append(k)
    return keys


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words that end before the places `ends`; raw begins with a word or a word's end."""
    byte, n = raw.astype(np.uint64), len(raw)
    power, back = np.full(n, _MIX), np.full(n, _INVERSE)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    # a polynomial of a word's bytes, from sums up to each place
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((byte + np.uint64(1)) * (byte + np.uint64(257)) * power, out=sums[1:])
    gap = (raw == 32) | (raw == 10)
    starts = np.maximum.accumulate(np.where(np.concatenate(([True], gap[:-1])), np.arange(n), 0))[ends - 1]
    word = (sums[ends] - sums[starts]) * back[starts]  # as if each word began at place 0
    word ^= word >> np.uint64(31)
    word *= _MIX2
    word ^= word >> np.uint64(29)
    return word + (ends - starts).astype(np.uint64) * _MIX


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts[order], starts)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each occurs."""
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def counted(keys: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with how often learned is true there."""
    merged = _Sums()
    merged.add(*_runs(np.sort(keys[learned])))
    rest, _ = _runs(np.sort(keys[~learned]))
    merged.add(rest, np.zeros(len(rest), np.int64))
    return merged.keys, merged.counts


class _Sums:
    """Distinct keys, in order, with the sums of their counts."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds distinct keys in order."""
        if not len(self.keys):
            self.keys, self.counts = keys, counts
            return
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        self.counts[at[known]] += counts[known]
        new = ~known
        self.keys, self.counts = np.insert(self.keys, at[new], keys[new]), np.insert(self.counts, at[new], counts[new])


def paths(keys: np.ndarray, counts: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: how often its context occurs, and for each of its byte's decisions (one key's after another's) how often it goes the other way there.

    keys: distinct, in order, with all keys of each context; counts: how often each occurs in COUNTED texts.
    """
    before = np.append(0, np.cumsum(counts))
    rank = (keys & np.uint64(255)).astype(np.int64)
    context = keys - rank.astype(np.uint64)
    lengths = code.length[rank]
    ends = np.cumsum(lengths)
    others = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)

    def total(at: np.ndarray, d: int) -> np.ndarray:
        # the last context's end may lie beyond 64 bits, so ranges are closed
        low, high = context[at] | code.low[rank[at], d], context[at] | (code.high[rank[at], d] - np.uint64(1))
        return before[np.searchsorted(keys, high, "right")] - before[np.searchsorted(keys, low)]

    at = np.arange(len(keys))
    whole = every = total(at, 0)
    for d in range(int(lengths.max()) if len(lengths) else 0):
        deep = lengths[at] > d
        at, whole = at[deep], whole[deep]
        same = total(at, d + 1)
        others[ends[at] - lengths[at] + d] = whole - same
        whole = same
    return every, others


_LEVELS = level(np.arange(1 << 16))


def codes(keys: np.ndarray, totals: np.ndarray, others: np.ndarray, code: Code) -> np.ndarray:
    """The codes of the decisions, from what paths() gives of the keys."""
    lengths = code.length[(keys & np.uint64(255)).astype(np.int64)]
    ends, out = np.cumsum(lengths), np.empty(len(others), np.uint16)
    for first in range(0, len(keys), 1 << 17):  # some keys at a time
        some = slice(first, first + (1 << 17))
        size, stop = lengths[some], ends[some]
        start = int(stop[0] - size[0])
        other = others[start : int(stop[-1])]
        gone = np.cumsum(other)
        gone -= np.repeat(gone[stop - size - start] - other[stop - size - start], size)
        for values, shift in ((np.repeat(totals[some], size) - gone, 256), (other, 1)):
            small = _LEVELS[np.minimum(values, (1 << 16) - 1)].astype(np.uint16)
            large = values >= 1 << 16
            if large.any():
                small[large] = level(values[large])
            if shift == 256:
                out[start : int(stop[-1])] = small << 8
            else:
                out[start : int(stop[-1])] |= small
    return out


class Slots:
    """Places of distinct 64-bit keys, by open addressing, for many keys at a time."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(32))) * _MIX
        return (mixed >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Their places, -1 where there is none."""
        out, slot = np.full(len(keys), -1, np.int64), self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            at = self.table[slot]
            good = at >= 0
            if not good.all():
                left, slot, at = left[good], slot[good], at[good]
            same = self.keys[at] == keys[left]
            out[left[same]] = at[same]
            left, slot = left[~same], (slot[~same] + 1) & self.mask
        return out


class Known:
    """What the corpus says about the keys of one context: where the codes of a key's decisions start, the last for keys that are not there."""

    def __init__(self, keys: np.ndarray, decisions: np.ndarray, code: Code):
        length = code.length[(keys & np.uint64(255)).astype(np.int64)]
        self.slots, self.start = Slots(keys), np.append(np.cumsum(length) - length, len(decisions)).astype(np.int32)
        self.codes = np.append(decisions, np.zeros(code.node.shape[1], np.uint16))


class Mixer:
    """Gated weights and the refining map, as far as they have learned."""

    def __init__(self, code: Code):
        self.code = code
        self.weights = np.full(GATES * CONTEXTS * GRADES, FIRST, np.float32)
        self.taught = np.zeros(len(self.weights))
        self.cells = 2 * REACH * CELLS + 1
        start = 1 / (1 + np.exp(-(np.arange(self.cells) - REACH * CELLS) / CELLS))
        self.seen = np.full(255 * self.cells, PRIOR)
        self.ones = np.tile(start * PRIOR, 255)

    def _laid_out(self, starts: list[np.ndarray], known: list[Known], rank: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the decisions of some bytes: places of weights and stretched probabilities (CONTEXTS, decisions), the middle of the map's row, the bit; where each byte's decisions begin."""
        code = self.code
        lengths = code.length[rank]
        ends = np.cumsum(lengths)
        first = ends - lengths
        deep = np.arange(ends[-1]) - np.repeat(first, lengths)
        found = np.empty((CONTEXTS, len(deep)), np.uint16)
        for k, row in enumerate(found):
            np.take(known[k].codes, np.repeat(starts[k], lengths) + deep, out=row, mode="clip")
        if own.any():
            np.copyto(found, np.take(LEFT_OUT, found), where=np.repeat(own, lengths))
        index = np.take(KNOWN, found).astype(np.int32)
        gate = np.zeros(len(deep), np.int32)
        for k in range(CONTEXTS):
            gate |= (index[k] > 0).astype(np.int32) << k
        gate *= CONTEXTS * GRADES
        for k in range(CONTEXTS):
            index[k] += gate + k * GRADES
        flat = np.repeat(rank * code.node.shape[1], lengths) + deep
        return index, np.take(STRETCH, found), np.take(code.node, flat) * self.cells + REACH * CELLS, np.take(code.bit, flat), first

    def _mixed(self, index: np.ndarray, x: np.ndarray, cell: np.ndarray, bit: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, ...]:
        """The probability of what came as mixed and as refined, and for each decision the map's cell below and how far it is from there."""
        total = np.einsum("kn,kn->n", np.take(self.weights, index, mode="clip"), x)
        np.clip(total, -REACH + 0.01, REACH - 0.01, out=total)
        p = 1 / (1 + np.exp(-total))
        place = np.where(bit, total, -total) * np.float32(CELLS)
        low = np.floor(place)
        share = place - low
        cell = cell + low.astype(np.int64)
        one = np.take(one, cell) * (1 - share) + np.take(one, cell + 1) * share
        return p, (p + np.where(bit, one, 1 - one)) * np.float32(0.5), cell, share

    def _map(self) -> np.ndarray:
        return (self.ones / self.seen).astype(np.float32)

    def learn(self, starts: list[np.ndarray], known: list[Known], rank: np.ndarray, times: np.ndarray) -> None:
        """Learns from bytes that no count holds, each as often as `times` says: a batch is predicted first, then learned from."""
        for at in range(0, len(rank), BATCH):
            some = slice(at, at + BATCH)
            r = rank[some]
            index, x, cell, bit, _ = self._laid_out([s[some] for s in starts], known, r, np.zeros(len(r), bool))
            p, _, cell, share = self._mixed(index, x, cell, bit, self._map())
            use = np.repeat(times[some].astype(float), self.code.length[r])
            flat = index.ravel()
            steps = np.bincount(flat, ((1 - p) * use * x).ravel(), len(self.weights))
            self.taught += np.bincount(flat, np.tile(use, CONTEXTS), len(self.weights))
            self.weights += (RATE * steps / np.sqrt(self.taught + 1)).astype(np.float32)
            near = cell + (share > 0.5)
            self.ones += np.bincount(near, use * bit, len(self.ones))
            self.seen += np.bincount(near, use, len(self.seen))

    def scores(self, starts: list[np.ndarray], known: list[Known], rank: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The natural logarithm of each byte's probability; own: whether the counts hold the byte itself. starts: of each context's codes."""
        out, one = np.empty(len(rank)), self._map()
        for at in range(0, len(rank), LAID_OUT):
            some = slice(at, at + LAID_OUT)
            index, x, cell, bit, first = self._laid_out([s[some] for s in starts], known, rank[some], own[some])
            _, refined, _, _ = self._mixed(index, x, cell, bit, one)
            out[some] = np.add.reduceat(np.log(refined), first, dtype=float)
        return out


class Stream:
    """Texts one after another, each with the bytes before it. Places are those of bytes after the first len(BEFORE)."""

    def __init__(self, data: bytes, lengths: np.ndarray, kinds: np.ndarray):
        """lengths: of the texts with the bytes before them; kinds: COUNTED, TAUGHT or HELD."""
        self.raw, self.kinds = np.frombuffer(data, np.uint8), kinds
        self.starts = np.cumsum(lengths) - lengths - len(BEFORE)
        self.data = data

    def keys(self, code: Code) -> Iterator[tuple[int, list[np.ndarray]]]:
        """The keys of all contexts, for BLOCK places at a time, with the first place."""
        for at in range(0, len(self.raw) - len(BEFORE), BLOCK):
            yield at, contexts(self.raw[at : at + len(BEFORE) + BLOCK], code)

    def of(self, at: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of n places from `at` on: the kind (bytes before a text are HELD), whether the byte belongs to a text, and which text."""
        a, z = np.searchsorted(self.starts, [at, at + n - 1], "right")
        some = slice(a - 1, z)
        sizes = np.diff(np.clip(np.append(self.starts[some], at + n), at, at + n))
        inside = np.ones(n, bool)
        before = (self.starts[some][:, None] + np.arange(len(BEFORE))).ravel() - at
        inside[before[(before >= 0) & (before < n)]] = False
        return np.where(inside, np.repeat(self.kinds[some], sizes), HELD).astype(np.uint8), inside, np.repeat(np.arange(a - 1, z), sizes)

    def words(self, at: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the places from `at` on that are inside texts end a word, and the words' hashes."""
        first = len(BEFORE)
        begin = max(self.data.rfind(b" ", 0, at + first), self.data.rfind(b"\n", 0, at + first)) + 1  # words are whole
        gap = np.isin(self.raw[at + first - 1 : at + first + len(inside)], (32, 10))
        ended = np.flatnonzero(gap[1:] & ~gap[:-1] & inside)
        return ended, word_hashes(self.raw[begin : at + first + len(inside)], ended + at + first - begin) if len(ended) else np.zeros(0, np.uint64)


def census(stream: Stream, code: Code) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context its distinct keys, in order, and how often each occurs in COUNTED texts; then the same of words, in texts that aren't HELD."""
    parts = [_Sums() for _ in range(CONTEXTS + 1)]
    for at, keys in stream.keys(code):
        kind, inside, _ = stream.of(at, len(keys[0]))
        for of, k in zip(parts, keys, strict=False):
            of.add(*counted(k[inside], kind[inside] == COUNTED))
        ended, words = stream.words(at, inside)
        parts[-1].add(*counted(words, kind[ended] != HELD))
    return [(of.keys, of.counts) for of in parts]


def distinct(keys: list[np.ndarray], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): order sorts a block's places by what is predicted there, and for what kind of text; starts says where something new begins."""
    bits = np.uint64(BLOCK.bit_length() - 1)
    mixed, salt = keys[-1] * np.uint64(3) + kind, _MIX
    while True:
        ordered = (mixed ^ (mixed >> np.uint64(30))) * salt
        ordered = np.sort((ordered >> bits) << bits | np.arange(len(mixed), dtype=np.uint64))
        order = (ordered & np.uint64(BLOCK - 1)).astype(np.int64)
        ordered >>= bits
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        same = ~new[1:]
        if not any((k[order][1:] != k[order][:-1])[same].any() for k in (keys[-1], kind)):
            return order, np.flatnonzero(new)
        salt = salt * _MIX2 + np.uint64(2)  # two of them met in one hash


def score(stream: Stream, code: Code, known: list[Known], words: Slots, tokens: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of each text: score (natural logarithms of its bytes' probabilities), words, known (words that are no HELD text's alone) and logs (of their counts and one, to base 10).

    tokens: how often each of `words` occurs. A block's TAUGHT bytes are learned from, then the block is scored.
    """
    mixer, n = Mixer(code), len(stream.kinds)
    out = {k: np.zeros(n) for k in ("score", "words", "known", "logs")}
    tokens = np.append(tokens, 0)
    for at, keys in stream.keys(code):
        kind, inside, text = stream.of(at, len(keys[0]))
        order, starts = distinct(keys, kind)
        heads = order[starts]
        times, kinds, keys = np.diff(np.append(starts, len(order))), kind[heads], [k[heads] for k in keys]
        begin = [k.start[k.slots.find(x)] for k, x in zip(known, keys, strict=True)]
        rank = (keys[0] & np.uint64(255)).astype(np.int64)
        some = kinds == TAUGHT
        if some.any():
            mixer.learn([b[some] for b in begin], known, rank[some], times[some])
        logs = np.empty(len(order))
        logs[order] = np.repeat(mixer.scores(begin, known, rank, kinds == COUNTED), times)
        first, last = int(text[0]), int(text[-1]) + 1
        out["score"][first:last] += np.bincount(text[inside] - first, logs[inside], last - first)
        ended, hashes = stream.words(at, inside)
        c, of = tokens[words.find(hashes)], text[ended] - first
        out["words"][first:last] += np.bincount(of, minlength=last - first)
        out["known"][first:last] += np.bincount(of, c > 0, last - first)
        out["logs"][first:last] += np.bincount(of, np.log10(c + 1), last - first)
    return out
