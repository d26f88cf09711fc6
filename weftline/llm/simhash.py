"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into pieces. Two fingerprints that differ in at most d bits agree on all but d of the
pieces, so they share a key made of (pieces - d) pieces. Distinct fingerprints are joined on those keys and verified inside the
join, where each linked pair is let through by the first of its shared keys only. The number of pieces follows
the number of fingerprints, so that a key keeps more bits than are needed to tell them apart and buckets stay small.

A bucket that still holds many fingerprints is not paired. Its members are linked through midpoints: two fingerprints
differ in at most 2r bits exactly when a third value lies within r bits of both, so each member lists the values within
r bits of it (only in bits outside the shared pieces) and all members that list a value link to the smallest of them.
That costs a fixed number of rows for each member and loses no link between components.

Near copies of a stated similarity need more bits than 64: a similarity of 0.8 leaves some 15 % of the bits different. near_copies() makes
wide fingerprints, whose many blocks let such pairs share one, and verifies the distance of all their bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._common import ROW_KEY, materialise, with_row_key
from weftline.llm.components import components

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: From this many members on, a bucket is linked through midpoints.
DENSE = 2000
#: Of near copies: words of a shingle, least similarity, the chance that a pair of just that similarity shares a block.
STAGE_WORDS, SIMILARITY, RECALL = 5, 0.8, 0.97
#: From this many members on, a bucket of near copies is compared in tiles; members of a tile.
CROWD, TILE = 24, 4096
#: Hashes unpacked at once, a multiple of 255 so that byte counters can't overflow.
CHUNK = 255 * 256


def _shingles(raw: bytes, words: int) -> list[bytes]:
    tokens = raw.lower().split()  # of bytes: A-Z and ASCII white space only
    if len(tokens) <= words:
        return [b" ".join(tokens)] if tokens else []
    text = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) + np.arange(len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [text[a:b] for a, b in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The SimHash of a text as an unsigned integer; 0 for a text without words or null."""
    parts = _shingles((text or "").encode(), words)
    if not parts:
        return 0
    digest, n = xxhash.xxh64_intdigest, len(parts)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        some = parts[at : at + CHUNK]
        hashes = np.fromiter((digest(x, seed) for x in some), np.uint64, len(some))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        if full:
            ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        if full < len(bits):
            ones += bits[full:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index("text")
        prints = np.fromiter((fingerprint(x.as_py(), words, seed) for x in batch.column(at)), np.uint64, batch.num_rows)
        rest = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(prints.view(np.int64))], names=[*(batch.schema.names[i] for i in rest), "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """ROW_KEY, doc_id and fp (the fingerprint's 64 bits as a long) of every row."""
    keyed = with_row_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema if f.name != "text") + ", fp long"
    return keyed.mapInArrow(lambda batches: _fingerprints(batches, words, seed), schema)


def _pieces(count: int) -> list[int]:
    """Masks of the pieces, as signed 64-bit integers."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [int(np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)).view(np.int64)) for a, b in zip(cuts, cuts[1:], strict=False)]


def pieces_for(prints: int, max_bits: int) -> int:
    """The fewest pieces whose keys have more bits than it takes to number the fingerprints (or 4 pieces beyond max_bits)."""
    for extra in range(2, 5):
        if extra * 64 // (max_bits + extra) > max(1, prints).bit_length():
            break
    return max_bits + extra


def _keys(prints: DataFrame, pieces: int, max_bits: int) -> DataFrame:
    """fp, combo (bit mask of the pieces that the key is made of) and key (the fingerprint's bits in them)."""
    masks = _pieces(pieces)
    each = []
    for chosen in combinations(range(pieces), pieces - max_bits):
        mask = int(np.bitwise_or.reduce(np.array([masks[k] for k in chosen], np.int64)))
        each.append(F.struct(F.lit(sum(1 << k for k in chosen)).alias("combo"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    return prints.select("fp", F.explode(F.array(*each)).alias("k")).select("fp", "k.combo", "k.key")


def _first_combo(differ: Column, pieces: int, max_bits: int) -> Column:
    """Of the pieces in which two fingerprints agree, the first (pieces - max_bits), as a bit mask."""
    same = F.lit(0)
    for k, mask in enumerate(_pieces(pieces)):
        same = same + F.when(differ.bitwiseAND(F.lit(mask)) == 0, F.lit(1 << k)).otherwise(F.lit(0))
    first = F.lit(0)
    for _ in range(pieces - max_bits):
        less = same.bitwiseAND(same - 1)
        first, same = first + (same - less), less
    return first


def _paired(keys: DataFrame, pieces: int, max_bits: int) -> DataFrame:
    other = keys.select(F.col("fp").alias("other"), F.col("combo").alias("combo2"), F.col("key").alias("key2"))
    differ = F.col("fp").bitwiseXOR(F.col("other"))
    match = (F.col("combo") == F.col("combo2")) & (F.col("key") == F.col("key2")) & (F.col("fp") > F.col("other"))
    match = match & (F.bit_count(differ) <= max_bits) & (_first_combo(differ, pieces, max_bits) == F.col("combo"))
    return keys.join(other, match).select(F.col("fp").alias("a"), F.col("other").alias("b"))


def _even(max_bits: int) -> None:
    """Midpoints are half of max_bits from either side."""
    if max_bits < 0 or max_bits % 2:
        raise ValueError("max_bits must be even")


def _through_midpoints(keys: DataFrame, pieces: int, max_bits: int) -> DataFrame:
    """Edges to the smallest member for each value that lies within half of max_bits of members of a dense bucket."""
    masks, near = _pieces(pieces), max_bits // 2
    flips = []
    for chosen in combinations(range(pieces), pieces - max_bits):
        shared = int(np.bitwise_or.reduce(np.array([masks[k] for k in chosen], np.int64)))
        free = [int(np.uint64(1 << i).view(np.int64)) for i in range(64) if not (shared >> i) & 1]
        some = [0]
        for n in range(1, near + 1):
            some += [int(np.bitwise_xor.reduce(np.array(c, np.int64))) for c in combinations(free, n)]
        flips.append((sum(1 << k for k in chosen), some))
    table = keys.sparkSession.createDataFrame(flips, "combo int, flips array<bigint>")  # a row for each choice of pieces
    listed = keys.join(F.broadcast(table), "combo").select("fp", "key", "combo", F.explode("flips").alias("flip"))
    listed = listed.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")).distinct()
    listed = materialise(listed, "midpoints")
    least = materialise(listed.groupBy("mid").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mid", "least"), "midpoint_least")
    return listed.join(least, "mid").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def links(prints: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) at most max_bits apart: all of them, or within dense buckets as many as connect the same."""
    _even(max_bits)
    count = prints.count()
    pieces = pieces_for(count, max_bits)
    keys = _keys(prints, pieces, max_bits)
    crowded = keys.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense).select("combo", "key")
    crowded = materialise(crowded, "dense")
    if crowded.isEmpty():
        return _paired(keys, pieces, max_bits)
    sparse = keys.join(crowded, ["combo", "key"], "left_anti")
    # a pair that a dense bucket links must not depend on the sparse buckets' first combo, so those emit any shared one
    return _paired_any(sparse, max_bits).unionByName(_through_midpoints(keys.join(crowded, ["combo", "key"], "left_semi"), pieces, max_bits))


def _paired_any(keys: DataFrame, max_bits: int) -> DataFrame:
    other = keys.withColumnRenamed("fp", "other")
    joined = keys.join(other, ["combo", "key"]).where(F.col("fp") > F.col("other")).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits)
    return joined.select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, seed: int = SEED, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: ROW_KEY, doc_id, fp (long), component_id: the smallest doc_id that can be reached over links.

    Null texts and texts without words have fingerprint 0 and are linked like any other. Null ids never are the smallest (a
    component of null ids only has a null component_id). Rows with equal texts meet in one fingerprint, so copies are never
    paired. Other columns of docs are not read; an empty table gives no rows. max_bits must be even.
    """
    _even(max_bits)
    rows = materialise(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct_fingerprints")
    labels = materialise(components(links(prints.select("fp"), max_bits)), "labels")
    labelled = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("label", "fp").alias("label"))
    labelled = materialise(labelled, "labelled")
    smallest = materialise(labelled.groupBy("label").agg(F.min("least_id").alias("component_id")), "smallest")
    by_print = materialise(labelled.join(smallest, "label").select("fp", "component_id"), "by_fingerprint")
    return rows.join(by_print, "fp").select(*ROW_KEY, "doc_id", "fp", "component_id")


def differing(similarity: float) -> float:
    """The share of bits in which SimHashes of two sets of this Jaccard similarity differ, as expected of sets of like size: their angle over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_plan(prints: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a block, 64-bit words of a wide fingerprint) for so many fingerprints.

    A block has as many bits as keep unlike fingerprints apart; there are as many blocks as it takes for a pair of just this similarity to share one with
    probability `recall`. Pairs that differ in fewer bits than there are blocks always do.
    """
    bits = next((b for b in (16, 21, 32) if prints.bit_length() <= b + 3), 32)
    blocks = math.log(1 - recall) / math.log(1 - (1 - differing(similarity)) ** bits)
    return bits, math.ceil(blocks / (64 // bits))


def wide_fingerprint(text: str | None, lanes: int, words: int = STAGE_WORDS, seed: int = SEED) -> np.ndarray:
    """A SimHash of lanes * 64 bits over a text's distinct shingles; all zero for a text without words or null."""
    parts = _shingles((text or "").encode(), words)
    if not parts:
        return np.zeros(lanes, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.unique(np.fromiter((digest(x, seed) for x in parts), np.uint64, len(parts)))
    steps = np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte can count
        x = hashes[at : at + 255, None] + steps
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(by)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def _wide(docs: DataFrame, id_col: str, text_col: str, lanes: int, words: int) -> DataFrame:
    """ROW_KEY, doc_id and wide (array of `lanes` longs) of every row."""
    keyed = with_row_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    schema = T.StructType([*[f for f in keyed.schema if f.name != "text"], T.StructField("wide", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            wide = [wide_fingerprint(x.as_py(), lanes, words).view(np.int64) for x in batch.column(at)]
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(wide, pa.list_(pa.int64()))], names=[*(batch.schema.names[i] for i in rest), "wide"])

    return keyed.mapInArrow(run, schema)


def _spanning(group: pa.Table, most: int) -> pa.Table:
    """Links that connect the members of a bucket which are at most `most` bits apart as all such links do; a member is compared with those not yet reached."""
    nodes = group.column("node").to_numpy()
    wide = np.array(group.column("wide").to_pylist(), np.int64).view(np.uint64).reshape(len(nodes), -1)
    left, a, b = np.arange(len(nodes)), [], []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        for at in todo:
            near = np.bitwise_count(wide[left] ^ wide[at]).sum(axis=1) <= most
            found = left[near].tolist()
            left = left[~near]
            todo += found
            a += [at] * len(found)
            b += found
    return pa.table({"a": pa.array(nodes[a], pa.int64()), "b": pa.array(nodes[b], pa.int64())})


def _forest(roots: dict[int, int], a: list[int], b: list[int]) -> list[int]:
    """Positions of the pairs that connect what those before them don't; roots: what is connected, kept from call to call."""

    def root(x: int) -> int:
        while (up := roots.get(x, x)) != x:
            roots[x] = x = roots.get(up, up)
        return x

    new = []
    for at, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = root(x), root(y)
        if x != y:
            roots[x] = y
            new.append(at)
    return new


def _bucket_links(batches: Iterator[pa.RecordBatch], most: int, lanes: int) -> Iterator[pa.RecordBatch]:
    """Links within small buckets, whose rows (block, key, node, wide) follow each other: all members of a bucket are compared, and as many links are let through as connect a task's nodes the same."""
    roots: dict[int, int] = {}
    held = [np.empty(0, np.int64)] * 3 + [np.empty((0, lanes), np.uint64)]

    def links(block: np.ndarray, key: np.ndarray, node: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
        a, b, step = [], [], 1
        while step < len(node) and len(at := np.flatnonzero((block[step:] == block[:-step]) & (key[step:] == key[:-step]))):
            at = at[np.bitwise_count(wide[at] ^ wide[at + step]).sum(axis=1) <= most]
            a += node[at].tolist()
            b += node[at + step].tolist()
            step += 1
        some = _forest(roots, a, b)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for i in some], pa.int64()) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        came = [batch.column(batch.schema.names.index(c)) for c in ("block", "key", "node", "wide")]
        came = [np.concatenate(x) for x in zip(held, [*(c.to_numpy() for c in came[:3]), came[3].flatten().to_numpy().view(np.uint64).reshape(-1, lanes)], strict=True)]
        last = int(np.argmax((came[0] == came[0][-1]) & (came[1] == came[1][-1])))  # where the last bucket begins, which may go on in the next batch
        held = [x[last:] for x in came]
        yield links(*[x[:last] for x in came])
    yield links(*held)


def wide_links(prints: DataFrame, lanes: int, bits: int, similarity: float = SIMILARITY, dense: int = CROWD, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between nodes whose wide fingerprints share a block and differ in no more bits than `similarity` allows, or as many as connect the same. prints: node (long), wide, distinct.

    Buckets of over `dense` members come first: they are compared in tiles that a task holds, where a member is compared until it is linked. Of small buckets those members
    stay that are near another, which the large buckets' links don't connect with them, on a 64-bit word outside the block; their whole fingerprints are compared bucket by bucket.
    No bucket is left out, and none emits pairs: members are rows once for each block, links connect a task's nodes once, so that large groups of like texts cost rows in proportion
    to their members, near copies or not.
    """
    most, per = int(64 * lanes * differing(similarity)), 64 // bits
    mask = (1 << bits) - 1
    each = [
        F.struct(F.lit(k * per + j).cast("long").alias("block"), F.shiftrightunsigned(F.get("wide", F.lit(k)), bits * j).bitwiseAND(F.lit(mask)).cast("long").alias("key"), F.get("wide", F.lit((k + 1) % lanes)).alias("word"))
        for k in range(lanes) for j in range(per)
    ]
    keys = prints.select("node", F.explode(F.array(*each)).alias("k")).select("node", "k.*")
    crowded = materialise(keys.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense), "crowded")
    full = crowded.isEmpty()
    if full:
        tight, sparse = None, keys.withColumn("label", F.col("node"))
    else:
        tiles = F.ceil(F.col("n") / tile).cast("int")
        dealt = keys.join(crowded, ["block", "key"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.greatest(tiles, F.lit(1))).cast("int"))
        pairs = dealt.select("block", "key", "node", "tile", F.explode(F.sequence(F.lit(0), F.greatest(tiles, F.lit(1)) - 1)).alias("with"))
        pairs = pairs.select("block", "key", "node", F.least("tile", "with").alias("t"), F.greatest("tile", "with").alias("u")).join(prints, "node")
        tight = materialise(pairs.groupBy("block", "key", "t", "u").applyInArrow(lambda g: _spanning(g, most), "a long, b long").distinct(), "crowd_links")
        labels = materialise(components(tight), "crowd_labels")
        sparse = keys.join(crowded.select("block", "key"), ["block", "key"], "left_anti").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    spread = differing(similarity)
    loose = int(64 * spread + 4 * math.sqrt(64 * spread * (1 - spread)))
    other = sparse.select(*[F.col(c).alias(f"{c}2") for c in ("block", "key", "word", "label")])
    like = (F.col("block") == F.col("block2")) & (F.col("key") == F.col("key2")) & (F.col("label") != F.col("label2")) & (F.bit_count(F.col("word").bitwiseXOR(F.col("word2"))) <= loose)
    members = materialise(sparse.join(other, like, "left_semi").select("block", "key", "node"), "near_members")
    buckets = members.join(prints, "node").select("block", "key", "node", "wide").repartition("block", "key").sortWithinPartitions("block", "key", "node")
    near = materialise(buckets.mapInArrow(lambda batches: _bucket_links(batches, most, lanes), "a long, b long"), "near_candidates")
    return near if tight is None else near.unionByName(tight)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = STAGE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: ROW_KEY, doc_id, label (one for each group of near copies) and stays, true for one row of a group.

    Texts are near copies if wide SimHashes over their distinct shingles of `words` words (lower-cased A-Z; shorter texts: the whole sequence) say a similarity of
    `similarity` or more; groups are connected over such links. The row with the smallest id stays, the first stored of several, null ids last. Null texts and texts without
    words are copies of each other. An empty table gives no rows; other columns are not read.
    """
    # twice the rows, so that few more rows don't change the plan's numbers
    bits, lanes = wide_plan(2 * docs.count(), similarity)
    rows = materialise(_wide(docs, id_col, text_col, lanes, words), "wide_rows")
    prints = materialise(rows.select("wide").distinct().withColumn("node", F.monotonically_increasing_id()), "wide_prints")
    labels = materialise(components(wide_links(prints, lanes, bits, similarity)), "wide_labels")
    named = prints.join(labels, "node", "left").select("wide", F.coalesce("label", "node").alias("label"))
    labelled = materialise(rows.join(named, "wide").select(*ROW_KEY, "doc_id", "label"), "wide_labelled")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *ROW_KEY)
    first = labelled.groupBy("label").agg(F.min(order).alias("first")).select("label", *[F.col(f"first.{k}").alias(f"{k}_") for k in ROW_KEY])
    stays = (F.col(ROW_KEY[0]) == F.col(f"{ROW_KEY[0]}_")) & (F.col(ROW_KEY[1]) == F.col(f"{ROW_KEY[1]}_"))
    return labelled.join(materialise(first, "wide_first"), "label").select(*ROW_KEY, "doc_id", "label", stays.alias("stays"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = STAGE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with the row of each group of near_copies() that stays; same columns."""
    keyed = with_row_key(docs)
    # those that go are few where those that stay are most: only their keys are matched with the texts
    lost = materialise(near_copies(keyed.drop(*ROW_KEY), id_col, text_col, words, similarity).where("not stays").select(*ROW_KEY), "lost")
    return keyed.join(lost, ROW_KEY, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
