"""Language-model scores of texts by online logistic context mixing over their bytes, against an add-one base of words.

Counts of contexts come from all training texts and are exact: each task reads a bounded chunk of texts and lists its distinct (context, byte)
keys with their counts, packed by parts of the key space; a part sums what all chunks list and answers each chunk with what the
corpus says about the chunk's own keys. A chunk then meets its answers and is scored by weftline.llm.context_mixing. So
the statistics grow with the corpus, nothing of them is broadcast or collected (the Huffman tree of 256 byte counts is), and what is
shuffled is each chunk's distinct keys, not its bytes.

Weights and map learn from TAUGHT_OF training texts in so many, whose bytes the contexts' counts leave out, so that they see such texts as held-out ones are
seen. Each chunk starts from the same weights and learns as it reads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import ROW_KEY, crc_of, delete, materialise, with_row_key
from weftline.llm.context_mixing import BEFORE, CONTEXTS, COUNTED, HELD, TAUGHT, Code, Known, Slots, Stream, census, codes, lowered, paths, score, summed

#: Rows with crc32(id) mod FOLDS == HELD_OUT are not learned from; of the others, those with crc32(id) mod TAUGHT_OF == 1 teach the weights.
FOLDS, HELD_OUT, TAUGHT_OF = 7, 2, 13
#: A chunk has about so many bytes of text, at most and at least, between them what makes about CHUNKS of them; parts of the key space for each chunk.
CHUNK_BYTES, LEAST_BYTES, CHUNKS, PARTS = 28 << 20, 4 << 20, 6, 4

_CHUNKS = "chunk long, docs binary, lengths binary, kinds binary, bytes long, text binary, histogram array<long>"
_LISTED = "part int, chunk long, context int, size int, keys binary, counts binary"
_ANSWERS = "chunk long, context int, size int, keys binary, totals binary, decisions int, others binary, words long, total long"
_SCORED = "f long, i long, words long, known long, logs double, score double, bytes long, ends int, vocabulary long, total long"


def _packed(values: np.ndarray, kind: str) -> bytes:
    """An array, its bytes sorted by significance and compressed."""
    planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, size: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, width * size, "zstd"), np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)), "<u8")


def _unpack_keys(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(_unpacked(data, size, "<u8"), dtype=np.uint64)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of a schema as Spark writes it."""
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], types[t]) for j, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


class _Chunk:
    """Texts, or segments of long ones."""

    def __init__(self) -> None:
        self.docs: list[tuple[int, int]] = []
        self.pieces: list[bytes] = []
        self.kinds: list[int] = []
        self.bytes, self.histogram = 0, np.zeros(256, np.int64)

    def add(self, key: tuple[int, int], kind: int, before: bytes, body: bytes) -> None:
        self.docs.append(key)
        self.pieces += [before, body]
        self.kinds.append(kind)
        self.bytes += len(body)
        if kind == COUNTED:
            self.histogram += np.bincount(np.frombuffer(body, np.uint8), minlength=256)

    def row(self, name: int) -> pa.RecordBatch:
        text = b"".join(self.pieces)
        lengths = np.array([len(b) + len(BEFORE) for b in self.pieces[1::2]], np.int64)
        return _batch(_CHUNKS, [(name, np.array(self.docs, np.int64).tobytes(), lengths.tobytes(), bytes(self.kinds), len(text), pa.compress(text, "zstd", asbytes=True), self.histogram.tolist())])


def _segments(body: bytes, most: int) -> Iterator[tuple[bytes, bytes]]:
    """A text with the bytes before it; one of over `most` bytes in segments that begin after a blank and go on in the contexts of the one before."""
    at, before = 0, BEFORE
    while at < len(body):
        cut = body.find(b" ", at + most) + 1 if len(body) - at > most else 0
        stop = cut or len(body)
        yield before, body[at:stop]
        before, at = (before + body[max(0, stop - len(BEFORE)) : stop])[-len(BEFORE) :], stop


def _chunked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    task, n, chunk = TaskContext.get().partitionId(), 0, _Chunk()
    for batch in batches:
        f, i, kind = (batch.column(c).to_pylist() for c in (*ROW_KEY, "kind"))
        for j in range(batch.num_rows):
            for before, body in _segments(lowered((batch.column("text")[j].as_py() or "").encode()), most):
                chunk.add((f[j], i[j]), kind[j], before, body)
                if chunk.bytes >= most:
                    yield chunk.row(task << 32 | n)
                    n, chunk = n + 1, _Chunk()
    if chunk.docs:
        yield chunk.row(task << 32 | n)


def _stream(text: bytes, size: int, lengths: bytes, kinds: bytes) -> Stream:
    return Stream(pa.decompress(text, size, "zstd", asbytes=True), np.frombuffer(lengths, np.int64), np.frombuffer(kinds, np.uint8))


def _parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key: all keys of a context are in one."""
    mixed = (keys >> np.uint64(8)) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)


def _listed(batches: Iterator[pa.RecordBatch], code: Code, parts: int) -> Iterator[pa.RecordBatch]:
    """What each chunk holds: its distinct keys by part and context, with their counts. Words come after the contexts."""
    for batch in batches:
        for r in batch.to_pylist():
            for context, (keys, counts) in enumerate(census(_stream(r["text"], r["bytes"], r["lengths"], r["kinds"]), code)):
                part = _parts_of(keys, parts)
                order = np.argsort(part, kind="stable")
                ends = np.append(0, np.cumsum(np.bincount(part, minlength=parts)))
                for p in np.flatnonzero(np.diff(ends)):
                    at = order[ends[p] : ends[p + 1]]
                    yield _batch(_LISTED, [(int(p), r["chunk"], context, len(at), _pack_keys(keys[at]), _packed(counts[at], "<i4"))])


def _answered(group: pa.Table, code: Code) -> pa.Table:
    """Sums a part's keys over all chunks and answers each chunk. One row more says how many distinct words the part holds, and how often they occur."""
    out, vocabulary, total = [], 0, 0
    rows = group.to_pylist()
    for context in range(CONTEXTS + 1):
        listed = [(r["chunk"], _unpack_keys(r["keys"], r["size"]), _unpacked(r["counts"], r["size"], "<i4")) for r in rows if r["context"] == context]
        if not listed:
            continue
        keys, totals = summed(np.concatenate([k for _, k, _ in listed]), np.concatenate([n for _, _, n in listed]).astype(np.int64))
        others = lengths = ends = np.zeros(0, np.int64)
        if context == CONTEXTS:
            vocabulary, total = int((totals > 0).sum()), int(totals.sum())
        else:
            totals, others = paths(keys, totals, code)
            lengths = code.length[(keys & np.uint64(255)).astype(np.int64)]
            ends = np.cumsum(lengths)
        for chunk, wanted, _ in listed:
            at = np.searchsorted(keys, wanted)
            flat = at[:0]
            if context < CONTEXTS:
                size = lengths[at]
                flat = np.repeat(ends[at] - size - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            out.append((chunk, context, len(wanted), _pack_keys(wanted), _packed(totals[at], "<i8"), len(flat), _packed(others[flat], "<i8"), None, None))
    out.append((-1, *[None] * 6, vocabulary, total))
    return pa.Table.from_batches([_batch(_ANSWERS, out)])


def _decisions(answer: dict, code: Code) -> np.ndarray:
    keys = _unpack_keys(answer["keys"], answer["size"])
    return codes(keys, _unpacked(answer["totals"], answer["size"], "<i8"), _unpacked(answer["others"], answer["decisions"], "<i8"), code)


def _scored(answers: pa.Table, chunk: pa.Table, code: Code) -> pa.Table:
    """The sums of each text, or segment, of a chunk; the answers' words and totals go through."""
    rows, out = answers.to_pylist(), []
    if not chunk.num_rows:
        return pa.Table.from_batches([_batch(_SCORED, [(*[None] * 8, sum(r["words"] for r in rows), sum(r["total"] for r in rows))])])
    of = [[r for r in rows if r["context"] == context] for context in range(CONTEXTS + 1)]
    keys = [np.concatenate([np.zeros(0, np.uint64), *[_unpack_keys(r["keys"], r["size"]) for r in some]]) for some in of]
    known = [Known(k, np.concatenate([np.zeros(0, np.uint16), *[_decisions(r, code) for r in some]]), code) for k, some in zip(keys[:-1], of[:-1], strict=True)]
    words, tokens = Slots(keys[-1]), np.concatenate([np.zeros(0, np.int64), *[_unpacked(r["totals"], r["size"], "<i8") for r in of[-1]]])
    del rows, of, keys, answers
    c = {k: chunk.column(k)[0].as_py() for k in ("text", "bytes", "lengths", "kinds", "docs")}
    stream = _stream(c["text"], c["bytes"], c["lengths"], c["kinds"])
    sums = score(stream, code, known, words, tokens)
    docs, lengths = np.frombuffer(c["docs"], np.int64).reshape(-1, 2), np.frombuffer(c["lengths"], np.int64)
    ends = (stream.raw[np.cumsum(lengths) - 1] == 10).astype(np.int32)
    out = [docs[:, 0], docs[:, 1], sums["words"].astype(np.int64), sums["known"].astype(np.int64), sums["logs"], sums["score"], lengths - len(BEFORE), ends]
    names = [x.split()[0] for x in _SCORED.split(", ")]
    return pa.table([*map(pa.array, out), *[pa.nulls(len(docs), pa.int64())] * 2], names=names)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ROW_KEY, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Scores are log10 probabilities: base_score of the lower-cased (A-Z) words and the end, score of the bytes of the lower-cased words with a blank between, and
    the end. A training text's byte is scored by all other training bytes, a held-out one's by all. Null texts count as empty: the end
    alone. Null ids are learned from. If nothing is learned from, no token is known and every decision has an even chance. An empty
    table gives no rows; other columns are not read. Words are told apart by 64 bits of a hash.
    """
    held, taught = crc_of(F.col("doc_id")) % FOLDS == HELD_OUT, crc_of(F.col("doc_id")) % TAUGHT_OF == 1
    keyed = with_row_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    facts = keyed.select(*ROW_KEY, "doc_id", held.alias("held_out"))
    read = keyed.select(*ROW_KEY, F.when(held, HELD).when(taught, TAUGHT).otherwise(COUNTED).alias("kind"), "text")
    files = keyed._jdf.queryExecution().optimizedPlan().collectLeaves().apply(0).stats().sizeInBytes()
    size = 2 * int(str(files))  # texts take twice the files' bytes or less
    about = min(CHUNK_BYTES, max(LEAST_BYTES, size // CHUNKS))
    # a task reads about a chunk, which closes before the task ends only if the files' splits are much larger
    chunked = materialise(read.coalesce(max(1, size // about)).mapInArrow(lambda b: _chunked(b, about * 3 // 2), _CHUNKS), "chunks")
    counts = {r["at"]: r["n"] for r in chunked.select(F.posexplode("histogram").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()}
    code = Code(np.array([counts.get(b, 0) for b in range(256)]))
    chunks = max(1, chunked.count())
    parts = PARTS * chunks
    listed = chunked.select("chunk", "text", "bytes", "lengths", "kinds").mapInArrow(lambda b: _listed(b, code, parts), _LISTED)
    answers = listed.repartition(parts, "part").groupBy("part").applyInArrow(lambda t: _answered(t, code), _ANSWERS)
    of_chunk = chunked.drop("histogram").withColumnRenamed("chunk", "of").repartition(parts, "of")
    met = answers.repartition(parts, "chunk").groupBy("chunk").cogroup(of_chunk.groupBy("of")).applyInArrow(lambda a, c: _scored(a, c, code), _SCORED)
    scored = materialise(met, "scored_texts")
    delete(chunked)
    ended = F.col("ends") > 0
    trained = facts.agg(F.count(F.when(~F.col("held_out"), 1))).first()[0]
    words, total = scored.agg(F.coalesce(F.sum("vocabulary"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    n, v = total + trained, words + (trained > 0)
    # a text that was read in segments has a row for each
    sums = scored.where(F.col("f").isNotNull()).groupBy(F.col("f").alias(ROW_KEY[0]), F.col("i").alias(ROW_KEY[1]))
    sums = sums.agg(*[F.sum(c).alias(c) for c in ("words", "known", "logs", "score", "bytes")], F.count(F.when(ended, 1)).alias("ends"))
    tokens = F.col("words") + F.col("ends")
    base = F.col("logs") + F.col("ends") * math.log10(trained + 1) - tokens * math.log10(n + v + 1)
    known = F.col("known") + F.col("ends") * int(trained > 0)
    columns = [tokens.alias("n_tokens"), known.alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score")]
    log10 = F.col("score") / math.log(10)
    return facts.join(sums, ROW_KEY).select(*ROW_KEY, "doc_id", "held_out", *columns, log10.alias("score"), (-F.col("score") / math.log(2) / F.col("bytes")).alias("bits_per_byte"))
