"""Profiles of sources and of the truth, key quality, leak checks, script shares and token lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCRIPTS = ("Latin", "Devanagari", "Tamil", "Telugu", "Kannada", "Malayalam", "Bengali", "Gujarati", "Gurmukhi", "Oriya", "Arabic", "Cyrillic", "Han")


def nearest_quantile(column: Column, q: float) -> Column:
    """The value at place round(q * (n - 1)) of the sorted values, as an aggregate of counts by value would need; for groups that fit a task."""
    values = F.array_sort(F.collect_list(column))
    return F.element_at(values, (F.round(F.lit(q) * (F.size(values) - 1)) + 1).cast("int"))


def quantiles_by(df: DataFrame, column: str, by: Sequence[str], qs: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles of each group, from counts of distinct values and their running sums: no group is collected."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(*by).orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = counts.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(W.partitionBy(*by))})
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("upto") > F.round(F.lit(q) * (F.col("all") - 1)), F.col("v"))).alias(name) for name, q in qs.items()])


def profile_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each text column: rows, nulls, distinct values, rows whose value repeats, and length statistics."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.column", "x.v")
    by_value = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    size, held = F.length("v"), F.col("v").isNotNull()
    return by_value.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(~held, F.col("n")).otherwise(0)).alias("nulls"), F.count(F.when(held, 1)).alias("distinct_values"),
        F.sum(F.when(held & (F.col("n") > 1), F.col("n")).otherwise(0)).alias("repeated_rows"), F.max(size).alias("max_len"),
        (F.sum(size * F.col("n")) / F.sum(F.when(held, F.col("n")))).alias("mean_len"),
    )


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values (smaller values first among ties)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def truth_profile(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: S1s, singletons, pairs, mean matches of the others, records claimed by several S1s."""
    sizes = base.select("s1").join(pairs.groupBy("s1").agg(F.count(F.lit(1)).alias("n")), "s1", "left").fillna(0, ["n"])
    one = sizes.agg(F.count(F.lit(1)).alias("s1s"), F.count(F.when(F.col("n") == 0, 1)).alias("singletons"), F.sum("n").alias("pairs"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("mean_matches"))
    claimed = pairs.groupBy("c").agg(F.countDistinct("s1").alias("k")).agg(F.count(F.when(F.col("k") > 1, 1)).alias("multi_claimed"))
    return one.join(claimed)


def size_histogram(base: DataFrame, pairs: DataFrame, most: int = 10) -> DataFrame:
    """How many S1s have so many matches; `most` stands for that and more."""
    sizes = base.select("s1").join(pairs.groupBy("s1").agg(F.count(F.lit(1)).alias("n")), "s1", "left").fillna(0, ["n"])
    return sizes.groupBy(F.least("n", F.lit(most)).cast("long").alias("matches")).agg(F.count(F.lit(1)).alias("s1s"))


def key_quality(records: DataFrame, key: str, true: DataFrame) -> DataFrame:
    """By country, for one key column: pairs that share it, true ones, precision, recall, and the largest block."""
    left = records.where(f"src = 1 and {key} <> ''").select("country", key, F.col("id").alias("s1"))
    right = records.where(f"src <> 1 and {key} <> ''").select("country", key, F.col("id").alias("c"))
    blocks = right.groupBy("country", key).agg(F.count(F.lit(1)).alias("size"))
    asked = left.groupBy("country", key).agg(F.count(F.lit(1)).alias("asked"))
    # pairs are counted from block sizes; only the true pairs are looked up
    volume = asked.join(blocks, ["country", key]).groupBy("country").agg(F.sum(F.col("asked") * F.col("size")).alias("pairs"), F.max("size").alias("largest_block"))
    keyed = true.join(records.select(F.col("id").alias("s1"), "country", F.col(key).alias("ka")), "s1").join(records.select(F.col("id").alias("c"), F.col("country").alias("cb"), F.col(key).alias("kb")), "c")
    hits = keyed.groupBy("country").agg(F.count(F.lit(1)).alias("true_pairs"), F.count(F.when((F.col("ka") == F.col("kb")) & (F.col("ka") != "") & (F.col("country") == F.col("cb")), 1)).alias("hits"))
    joined = volume.join(hits, "country", "left").fillna(0, ["true_pairs", "hits"])
    return joined.select("country", "pairs", "largest_block", "true_pairs", "hits", (F.col("hits") / F.col("pairs")).alias("precision"), F.when(F.col("true_pairs") > 0, F.col("hits") / F.col("true_pairs")).alias("recall"))


def script_shares(df: DataFrame, text: str, by: Sequence[str], scripts: Sequence[str] = SCRIPTS) -> DataFrame:
    """Shares of rows with a letter of each script, with an accented Latin letter, and null."""
    seen = [F.avg(F.coalesce(F.col(text).rlike(rf"\p{{Is{s}}}"), F.lit(False)).cast("double")).alias(s.lower()) for s in scripts]
    accented = F.avg(F.coalesce(F.col(text).rlike(r"[À-ÖØ-öø-ɏ]"), F.lit(False)).cast("double")).alias("accented")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *seen, accented, F.avg(F.col(text).isNull().cast("double")).alias("null_share"))


def top_tokens(df: DataFrame, words: str, by: Sequence[str], n: int = 10) -> DataFrame:
    """The n most frequent tokens of each group, counted once for each row, with their rank."""
    counts = df.select(*by, F.explode(F.array_distinct(words)).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("rows"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("rows"), "token"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def average_rank(df: DataFrame, column: str, by: Sequence[str], name: str) -> DataFrame:
    """Adds the average rank of a column within each group, from counts of distinct values."""
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    below = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy(column).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn(name, below + (F.col("_n") + 1) / 2).drop("_n")
    return df.join(ranks, [*by, column])


def spearman_by(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Spearman's correlation of two columns in each group."""
    ranked = average_rank(average_rank(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, by, "_ra"), b, by, "_rb")
    return ranked.groupBy(*by).agg(F.corr("_ra", "_rb").alias("rho"))


def sibling_gaps(df: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """Adds gap: the difference to the row before in the group's order."""
    return df.withColumn("gap", F.col(order) - F.lag(order).over(W.partitionBy(*group).orderBy(order)))


def decile(position: Column) -> Column:
    return F.floor(position * 10).cast("int")


def random_pairs(pairs: DataFrame, seed: int = 5) -> DataFrame:
    """Each s1 with the c of another row: both sides are placed by digests within buckets and paired by place, so nothing is sorted as a whole."""
    bucket = F.pmod(F.xxhash64("s1", "c"), F.lit(1024))
    a = pairs.select("s1", bucket.alias("b"), F.row_number().over(W.partitionBy(bucket).orderBy(F.xxhash64("s1", F.lit(seed)), "s1", "c")).alias("n"))
    b = pairs.select("c", bucket.alias("b"), F.row_number().over(W.partitionBy(bucket).orderBy(F.xxhash64("c", F.lit(seed + 1)), "c", "s1")).alias("n"))
    return a.join(b, ["b", "n"]).select("s1", "c")


def summary_table(df: DataFrame, key: str) -> DataFrame:
    """A small summary turned on its side: a row for each column."""
    return df.transpose(F.col(key))
