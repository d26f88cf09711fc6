"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks of bounded size and every block of queries meets every block of candidates. In each round all
scores are computed and counted in one histogram for each query, summed over the cluster; the bin that holds a query's
k-th score becomes its next, finer interval. When few enough candidates stand at or above the interval, one more pass
returns them and ties are broken by id. Only counts, thresholds and the final candidates are ever shuffled beside
the blocks: a block sends no more than k bins or k candidates for each query, since its k best hold all it can add.

No side of a join is broadcast: blocks are small as files and large as rows, and the queries' are repeated for each group, so the
driver would hold what grows with the square of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm._common import ROW_KEY, materialise, with_row_key

SCALE, K = 256, 5
#: Rows of a packed block; vectors of a block also stay below BLOCK_BYTES.
QUERY_ROWS, CANDIDATE_ROWS, BLOCK_BYTES = 512, 2048, 4 << 20
BINS = 4096
#: A query is located once this many candidates, beside the k, stand at or above its interval.
SPARE = 27
#: Candidate blocks are dealt out over this many groups at most; the query blocks are sent to each group. Unless the cluster has more cores, there
#: are about as many groups as candidates for a query, so that both sides send alike.
MAX_GROUPS = 1024
SHORT, FLOAT32_EXACT, FLOAT64_EXACT, INT64_MAX = 1 << 15, 1 << 24, 1 << 53, (1 << 63) - 1

_PACKED = "block long, n int, dim int, ids binary, keys binary, vectors binary, short boolean, longest double"
_COUNTS = "f long, i long, bin int, n long"
_FOUND = "f long, i long, query_id long, vec_id long, cf long, ci long, score long"


def _pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of floored vectors as float64 (short: as 16-bit integers, where all fit), shorter ones padded with zeros; longest: the largest Euclidean norm."""
    for batch in batches:
        vectors = batch.column("vector")
        at = 0
        while at < batch.num_rows:
            some = vectors.slice(at, rows)
            lengths = some.value_lengths().to_numpy(zero_copy_only=False)
            fit = np.cumsum(np.maximum.accumulate(lengths) * 8)
            take = max(1, min(len(some), int(np.searchsorted(fit, BLOCK_BYTES, "right"))))
            some, lengths = some.slice(0, take), lengths[:take]
            dim = int(lengths.max())
            full = np.zeros((take, dim))
            full[np.arange(dim) < lengths[:, None]] = some.flatten().to_numpy(zero_copy_only=False)
            full = np.floor(full * SCALE)
            keys = np.stack([batch.column(c).slice(at, take).to_numpy() for c in ROW_KEY])
            longest = float(np.sqrt((full**2).sum(axis=1)).max()) if dim else 0.0
            short = longest < SHORT
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in (
                    (int(keys[1, 0]) ^ int(keys[0, 0]), pa.int64()), (take, pa.int32()), (dim, pa.int32()), (batch.column("vec_id").slice(at, take).to_numpy().tobytes(), pa.binary()),
                    (keys.tobytes(), pa.binary()), ((full.astype(np.int16) if short else full).tobytes(), pa.binary()), (short, pa.bool_()), (longest, pa.float64()),
                )], names=[x.split()[0] for x in _PACKED.split(", ")],
            )
            at += take


def _matrix(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, dim = row[f"{side}_n"], row[f"{side}_dim"]
    vectors = np.frombuffer(row[f"{side}_vectors"], np.int16 if row[f"{side}_short"] else np.float64).reshape(n, dim)
    return np.frombuffer(row[f"{side}_ids"], np.int64), np.frombuffer(row[f"{side}_keys"], np.int64).reshape(2, n), vectors.astype(np.float64, copy=False)


def _scores(queries: np.ndarray, candidates: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer inner products; sums beyond 64 bits are held at the ends of their range."""
    dim = min(queries.shape[1], candidates.shape[1])
    q, c = queries[:, :dim], candidates[:, :dim]
    if bound < FLOAT64_EXACT:
        kind = np.float32 if bound < FLOAT32_EXACT else np.float64
        return (q.astype(kind) @ c.T.astype(kind)).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    if not dim:
        return np.zeros((len(q), len(c)), np.int64)
    return np.clip(whole(q).dot(whole(c).T), -INT64_MAX - 1, INT64_MAX).astype(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(query ids, query keys, state, candidate ids, candidate keys, scores with a mask of the query's own row) of each pair of blocks."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = {n: batch.column(j)[at].as_py() for j, n in enumerate(batch.schema.names)}
            q_ids, q_keys, q = _matrix(row, "q")
            c_ids, c_keys, c = _matrix(row, "c")
            own = np.zeros((len(q_ids), len(c_ids)), bool)
            at_key = {k: j for j, k in enumerate(zip(*c_keys.tolist(), strict=True))}
            for j, k in enumerate(zip(*q_keys.tolist(), strict=True)):
                if k in at_key:
                    own[j, at_key[k]] = True
            yield q_ids, q_keys, row, c_ids, c_keys, _scores(q, c, row["q_longest"] * row["c_longest"] + 1), own


def _state(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """low and width of each query's interval, in the order of the block's rows."""
    return np.frombuffer(row["q_low"], np.int64), np.frombuffer(row["q_width"], np.int64)


def _histograms(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each query of a pair of blocks its highest bins, until they hold k; bin BINS stands for everything above the interval."""
    for _, q_keys, row, _, _, scores, own in _pairs(batches):
        low, width = _state(row)
        bins = np.clip((scores - low[:, None]) // width[:, None], -1, BINS)
        bins[own] = -1
        kept = min(k, bins.shape[1])
        top = -np.sort(-np.partition(bins, bins.shape[1] - kept, axis=1)[:, -kept:], axis=1)
        at = np.repeat(np.arange(len(low)), kept)
        flat = top.ravel()
        ok = flat >= 0
        pair, n = np.unique(at[ok] * (BINS + 1) + flat[ok], return_counts=True)
        j = pair // (BINS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(q_keys[0][j]), pa.array(q_keys[1][j]), pa.array((pair % (BINS + 1)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["f", "i", "bin", "n"])


def _above(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Candidates with scores at or above each query's low; of a block its k best by (score, smaller id) at most."""
    for q_ids, q_keys, row, c_ids, c_keys, scores, own in _pairs(batches):
        low, _ = _state(row)
        j, c = np.nonzero((scores >= low[:, None]) & ~own)
        score = scores[j, c]
        order = np.lexsort((c_keys[1][c], c_keys[0][c], c_ids[c], -score, j))
        j, c, score = j[order], c[order], score[order]
        rank = np.arange(len(j)) - np.searchsorted(j, j)
        j, c, score = j[rank < k], c[rank < k], score[rank < k]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_keys[0][j], q_keys[1][j], q_ids[j], c_ids[c], c_keys[0][c], c_keys[1][c], score)], names=[x.split()[0] for x in _FOUND.split(", ")])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query blocks with their intervals, from the keys of the block and the lists of (f, i, low, width)."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = {n: batch.column(j)[at].as_py() for j, n in enumerate(batch.schema.names)}
            keys = np.frombuffer(row["q_keys"], np.int64).reshape(2, row["q_n"])
            place = {k: j for j, k in enumerate(zip(*keys.tolist(), strict=True))}
            low, width = np.full(row["q_n"], INT64_MAX, np.int64), np.ones(row["q_n"], np.int64)
            for s in row["states"]:
                j = place[s["f"], s["i"]]
                low[j], width[j] = s["low"], s["width"]
            names = [n for n in batch.schema.names if n != "states"]
            arrays = [batch.column(batch.schema.names.index(n)).slice(at, 1) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([low.tobytes()], pa.binary()), pa.array([width.tobytes()], pa.binary())], names=[*names, "q_low", "q_width"])


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def top_k(vectors: DataFrame, k: int = K, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by `every` its k best other rows.

    Components count as floor(256 * x). Vectors that are null or hold null or non-finite components, and rows without an id,
    take no part; an empty vector scores 0; vectors of different lengths are compared over the shorter one. Ties go to the
    smaller id, then to the row stored first. Rows that repeat an id are queries and candidates of their own. Scores beyond
    64 bits are held at the ends of their range. Fewer candidates than k give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    keyed = with_row_key(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")))
    keyed = keyed.where(F.col("vec_id").isNotNull() & _valid(F.col("vector")))
    candidates = materialise(keyed.mapInArrow(lambda b: _pack(b, CANDIDATE_ROWS), _PACKED), "candidates")
    queries = materialise(keyed.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(lambda b: _pack(b, QUERY_ROWS), _PACKED), "queries")
    blocks, longest = candidates.agg(F.count(F.lit(1)), F.max("longest")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not blocks:
        return empty
    groups = max(1, min(int(blocks), MAX_GROUPS, max(every, 2 * spark.sparkContext.defaultParallelism)))
    c_side = candidates.select(F.pmod(F.xxhash64("keys"), F.lit(groups)).alias("g"), *[F.col(c).alias(f"c_{c}") for c in candidates.columns])
    q_side = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])

    def paired(state: DataFrame) -> DataFrame:
        """Each block of candidates with each block of queries that has an open query; equal parts of the grid meet in a group."""
        listed = state.groupBy("q_keys").agg(F.collect_list(F.struct("f", "i", "low", "width")).alias("states"))  # as many as a block has rows
        ready = q_side.join(listed.hint("merge"), "q_keys").select(*q_side.columns, "states")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in q_side.schema) + ", q_low binary, q_width binary"
        ready = materialise(ready.mapInArrow(_assemble, schema), "query_blocks")
        return ready.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(c_side.hint("merge"), "g").drop("g", "q_block", "c_block")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(j)[at].as_py() for j, n in enumerate(batch.schema.names)}
                _, keys, q = _matrix(row, "q")
                reach = np.sqrt((q**2).sum(axis=1)) * longest * (1 + 1e-9) + 1
                # where scores may near the ends of 64 bits there is no interval (width 0): each block sends its k best
                far = ~(reach < float(1 << 61))
                reach = np.where(far, 0, reach).astype(np.int64)
                low, width = np.where(far, -INT64_MAX - 1, -reach), np.where(far, 0, 2 * (reach // BINS) + 2)
                yield pa.RecordBatch.from_arrays([pa.array([row["q_keys"]] * row["q_n"], pa.binary()), pa.array(keys[0]), pa.array(keys[1]), pa.array(low), pa.array(width)], names=["q_keys", "f", "i", "low", "width"])

    first = materialise(q_side.mapInArrow(rows_of, "q_keys binary, f long, i long, low long, width long"), "state")
    state, located = first.where("width > 0"), [first.where("width = 0")]
    while not state.isEmpty():
        counts = paired(state).mapInArrow(lambda b: _histograms(b, k), _COUNTS).groupBy("f", "i", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("f", "i").orderBy(F.desc("bin"))
        ranked = counts.withColumn("reached", F.sum("n").over(down)).withColumn("total", F.sum("n").over(W.partitionBy("f", "i")))
        # the bin of the k-th score; with fewer than k candidates the lowest bin that holds any
        place = ranked.where((F.col("reached") >= k) & (F.col("reached") - F.col("n") < k) | (F.col("total") < k) & (F.col("reached") == F.col("total")))
        place = materialise(place.join(state.hint("merge"), ["f", "i"]).select("q_keys", "f", "i", "bin", "reached", "low", "width"), "place")
        low = F.col("low") + F.col("bin") * F.col("width")
        ends = (F.col("reached") <= k + SPARE) | (F.col("width") == 1) | (F.col("bin") == BINS)
        narrowed = place.select("q_keys", "f", "i", low.alias("low"), F.greatest(F.lit(1).cast("long"), (F.col("width") / BINS).cast("long") + 1).alias("width"), ends.alias("ends"))
        narrowed = materialise(narrowed, "narrowed")
        located.append(narrowed.where("ends").drop("ends"))
        state = narrowed.where("not ends").drop("ends")
    thresholds = located[0]
    for more in located[1:]:
        thresholds = thresholds.unionByName(more)
    found = paired(materialise(thresholds, "thresholds")).mapInArrow(lambda b: _above(b, k), _FOUND)
    rank = F.row_number().over(W.partitionBy("f", "i").orderBy(F.desc("score"), "vec_id", "cf", "ci"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
