"""Mixing sources to target weights.

Every row gets a hash-random key. Rows are sorted by key within their source: the leading digits of the key deal a source's
rows over KEY_BUCKETS ranges of equal expectation, however large the source, and a prefix sum of words runs over the ranges'
totals and then inside each range. A source's budget is cut exactly there: whole passes over the source (epochs) first, then
the rows whose prefix sums fit the rest, the row at the cut for as many words as are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm._common import ROW_KEY, WORD, materialise, with_row_key

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5.0, 2.0, 1.0), 1.0, 3.0, "mix"
#: Hexadecimal digits of the key that make a range: 256 ranges in each source.
RANGE_DIGITS = 2


def _weighted(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Adds weight: weights repeat over the sources in order of code points, null last.

    Ranks come from a range sort of the distinct sources and the row counts of its partitions, so that no task sees them all.
    """
    order = [F.col("source").asc_nulls_last()]
    placed = materialise(sources.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "start")
    rank = F.col("start") + F.col("at") - F.shiftleft("part", 33)
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int") + 1)
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select("source", "source_size", choice.alias("weight"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sizes(source, source_size) with target: the sources' shares by weight of share times all sizes.

    A target stops at max_epochs times its source's size; the excess is dealt again by weight to the sources below their caps, until none
    is above. Each round is one aggregate over the sources; a capped source stays capped, so rounds end.
    """
    weighted = materialise(_weighted(sizes, weights), "weighted")
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= cap if capped >= 0 else F.lit(False)
        held, free, count = weighted.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if count == capped or not free:
            break
        level, capped = (total * share - (held or 0.0)) / free, count
    return weighted.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap).alias("target"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per row of docs: ROW_KEY, doc_id, size (words), source_size, target, taken (words the mix takes, repeats counted).

    Null texts have size 0; the null source is a source of its own. Keys digest seed, id and text, so reruns agree and rows that share an id are
    still dealt apart; rows equal in both are told apart by where they are stored. Sources of size 0 take nothing. An empty table
    gives no rows. Other columns of docs are not read.
    """
    keyed = with_row_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    rows = keyed.select(*ROW_KEY, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    rows = materialise(rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS)), "sizes")
    ranges = materialise(rows.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
    wanted = materialise(targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs), "targets")
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.withColumn("before", before).withColumnRenamed("source", "of")
    # 256 rows for each source: what a row needs to know of its source travels with its range
    starts = materialise(starts.join(wanted, F.col("of").eqNullSafe(F.col("source"))).select("of", F.col("range").alias("in"), "before", "source_size", "target"), "starts")
    inside = F.sum("size").over(W.partitionBy("source", "range").orderBy("key", *ROW_KEY).rowsBetween(W.unboundedPreceding, W.currentRow))
    summed = rows.withColumn("upto", inside).join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
    upto, budget = F.col("before") + F.col("upto"), F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.least("size", F.greatest(F.lit(0).cast("long"), rest - (upto - F.col("size"))))
    return summed.select(*ROW_KEY, "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed documents: each row of docs as often as the mix takes it, with the same columns.

    Rows stay whole: the row at a source's cut is taken once more if at least half of its words fit. Rows without words are never taken.
    """
    keyed = with_row_key(docs)
    chosen = mixture(keyed.drop(*ROW_KEY), id_col, text_col, source_col, **how).where("taken > 0")
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    chosen = materialise(chosen.select(*ROW_KEY, copies.alias("__wl_copies")).where("__wl_copies > 0"), "chosen")
    repeated = keyed.join(chosen, ROW_KEY).withColumn("__wl_copy", F.explode(F.sequence(F.lit(1), F.col("__wl_copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
