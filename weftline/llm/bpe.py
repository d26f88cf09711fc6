"""Byte-level BPE encoding and decoding in length-bucketed, padded numpy matrices.

The distinct pieces of a batch that are not yet known are laid out as rows of token ids, all rows of a bucket of one length.
In each round every row merges its leftmost pair of minimum rank: pair ranks come from a hash table of (left, right), the
merged pair's right column is squeezed out of every row, and rows without a pair left leave the matrix. Known pieces stay in a
dictionary of bounded size, so frequent words cost one lookup. Pieces of over MATRIX_BYTES bytes, for which rounds would cost
the square of their length, are merged one by one from a heap, to the same ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftline.llm._common import map_texts

MATRIX_BYTES, CACHE_PIECES, CHUNK_CHARS, CHUNK_PIECES = 128, 150_000, 1 << 20, 1 << 18
NONE = np.int32(2**31 - 1)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from the text of a rank file: base64 of a token's bytes, white space, rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class PairTable:
    """(left id, right id) to merged id by open addressing: keys and values in arrays, linear probing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        size = 1 << max(4, (4 * len(pairs)).bit_length())
        self.mask, self.keys, self.values = size - 1, np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys = np.fromiter(((a << 32) | b for a, b in pairs), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slots, left, self.probes = self._slots(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = left[self.keys[slots[left]] == -1]
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[slots[placed]], self.values[slots[placed]] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slots[left] = np.where(self.keys[slots[left]] == keys[left], slots[left], (slots[left] + 1) & self.mask)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            at = self.keys[slots[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
        return out


class Codec:
    """Encodes and decodes with one rank file; pieces are the matches of a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes = np.fromiter((ranks[bytes([b])] for b in range(256)), np.int32, 256)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs, self.table = pairs, PairTable(pairs)
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.known: dict[str, bytes] = {}

    def _one(self, raw: bytes) -> list[int]:
        """A long piece: linked list of tokens, pairs from a heap by (rank, position)."""
        ids: list[int] = self.bytes[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def _matrix(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, token ids) of the rows that end with the same number of tokens, for rows of one length in bytes."""
        at, ids = np.arange(len(rows)), self.bytes[rows]
        n, length = ids.shape
        ranks = self.table.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, length - 1)
        while ids.shape[1] > 1:
            p = ranks.argmin(axis=1)  # the leftmost of the smallest
            low = ranks[np.arange(len(p)), p]
            ended = low == NONE
            if ended.any():
                yield at[ended], ids[ended]
                go = ~ended
                at, ids, ranks, p, low = at[go], ids[go], ranks[go], p[go], low[go]
                if not len(at):
                    return
            each, columns = np.arange(len(p)), np.arange(ids.shape[1])
            ids[each, p] = low
            ids = ids[columns != (p + 1)[:, None]].reshape(len(p), -1)
            ranks = ranks[columns[:-1] != p[:, None]].reshape(len(p), -1)
            left = np.flatnonzero(p > 0)
            ranks[left, p[left] - 1] = self.table.ranks(ids[left, p[left] - 1], ids[left, p[left]])
            right = np.flatnonzero(p < ids.shape[1] - 1)
            ranks[right, p[right]] = self.table.ranks(ids[right, p[right]], ids[right, p[right] + 1])
        yield at, ids

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes pieces that are not known."""
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known = self.known
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                known[piece] = whole.to_bytes(4, "little")
            elif len(raw) > MATRIX_BYTES:
                known[piece] = np.array(self._one(raw), "<u4").tobytes()
            else:
                by_length.setdefault(len(raw), []).append((piece, raw))
        for length, some in by_length.items():
            rows = np.frombuffer(b"".join(raw for _, raw in some), np.uint8).reshape(-1, length)
            for at, ids in self._matrix(rows):
                flat, step = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, j in enumerate(at.tolist()):
                    known[some[j][0]] = flat[k * step : (k + 1) * step]

    def encoded(self, texts: list[str]) -> Iterator[list[bytes]]:
        """For each text the ids as parts of little-endian unsigned 32-bit integers; texts are taken in chunks of bounded size."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK_CHARS):
                size += len(texts[end])
                end += 1
            if size > CHUNK_CHARS:
                yield list(self._long(texts[at]))
            else:
                pieces = [self.pattern.findall(t) for t in texts[at:end]]
                new = set().union(*pieces)
                if len(self.known) > CACHE_PIECES:
                    self.known.clear()
                new.difference_update(self.known)
                self.learn(new)
                for some in pieces:
                    yield [b"".join(map(self.known.__getitem__, some))]
            at = end

    def _long(self, text: str) -> Iterator[bytes]:
        matches = self.pattern.finditer(text)
        while some := [m[0] for m in islice(matches, CHUNK_PIECES)]:
            if len(self.known) > CACHE_PIECES:
                self.known.clear()
            self.learn(set(some).difference(self.known))
            yield b"".join(map(self.known.__getitem__, some))

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """The codec of a rank file's bytes, built once in each process."""
    key = (hashlib.sha256(raw).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(read_ranks(raw), pattern)
    return _CODECS[key]


def _vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The rank file (a fixed file of about a megabyte), read on the driver: executors need no copy of it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids: bool = False) -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256, decoded_sha256 and, on request, token_ids (array of int).

    Each match of the pattern is encoded separately, without special tokens; the ids are then decoded again and the bytes they
    give are digested. Null texts count as empty: no tokens, digests of nothing. An empty table gives no rows. Other columns pass
    through unless one is named like a column of the result, which then replaces it. Texts of any length are taken in
    chunks.
    """
    vocabulary = _vocabulary(docs.sparkSession, path)

    def work(texts: list[str | None]) -> list[pa.Array]:
        c = codec(vocabulary.value, pattern)
        count, digest, back, tokens = [], [], [], []
        for parts in c.encoded([t or "" for t in texts]):
            a, b = hashlib.sha256(), hashlib.sha256()
            for part in parts:
                a.update(part)
                b.update(c.decoded(part))
            count.append(sum(map(len, parts)) // 4)
            digest.append(a.hexdigest())
            back.append(b.hexdigest())
            if ids:
                tokens.append(np.frombuffer(b"".join(parts), "<i4"))
        return [pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())] + [pa.array(tokens, pa.list_(pa.int32()))] * ids

    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_texts(docs, text_col, work, made + [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * ids)


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """tokens with text in place of the ids (null for null); bytes that are no UTF-8 become U+FFFD, as cut sequences of ids can give."""
    vocabulary = _vocabulary(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary.value, pattern)
        for batch in batches:
            rest = [n for n in batch.schema.names if n != ids_col]
            texts = [None if x is None else c.decoded(np.array(x, "<u4").tobytes()).decode(errors="replace") for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(texts, pa.string())], names=[*rest, text_col])

    schema = T.StructType([f for f in tokens.schema if f.name != ids_col] + [T.StructField(text_col, T.StringType())])
    return tokens.mapInArrow(run, schema)


__all__ = ["Codec", "codec", "decode", "encode", "read_ranks"]
