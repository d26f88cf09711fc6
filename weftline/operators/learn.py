"""Dictionaries learned from true pairs: native tokens to Latin ones, native tokens to states, sides of name markers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrays import jaccard
from weftline.functions.text import LEFT, NON_LATIN, RIGHT, folded, tokens


def most_frequent(counts: DataFrame, key: str, value: str, least: int, share: float) -> DataFrame:
    """counts(key, value, n): for each key its most frequent value (the smaller of ties), its count and share; rare and unclear keys are dropped."""
    best = F.min(F.struct(-F.col("n"), F.col(value).alias("value")))  # the largest count, then the smallest value
    top = counts.groupBy(key).agg(F.max("n").alias("support"), F.sum("n").alias("total"), best.alias("best"))
    rated = top.select(key, F.col("best.value").alias(value), "support", (F.col("support") / F.col("total")).alias("share"))
    return rated.where((F.col("support") >= least) & (F.col("share") >= share)).select(key, value, "support", "share")


def learn_native_tokens(records: DataFrame, pairs: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """native, latin, support, share from true pairs (s1, c) whose names have as many tokens."""
    a = records.select(F.col("id").alias("s1"), F.col("name_toks").alias("a"))
    b = records.where("nonlatin").select(F.col("id").alias("c"), F.col("name_toks").alias("b"))
    even = pairs.join(b, "c").join(a, "s1").where((F.size("a") == F.size("b")) & (F.size("a") > 0))
    aligned = even.select(F.inline(F.arrays_zip(F.col("b").alias("native"), F.col("a").alias("latin")))).where(F.col("native").rlike(NON_LATIN))
    return most_frequent(aligned.groupBy("native", "latin").agg(F.count(F.lit(1)).alias("n")), "native", "latin", least, share)


def apply_native_tokens(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """records with native tokens replaced where the dictionary knows them, in their order; name_toks replaced."""
    words = records.where("nonlatin").select("id", F.posexplode("name_toks").alias("pos", "native"))
    mapped = words.join(dictionary.select("native", "latin"), "native", "left").select("id", F.struct("pos", F.coalesce("latin", "native").alias("t")).alias("p"))
    back = mapped.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.t).alias("_toks"))
    return records.join(back, "id", "left").withColumn("name_toks", F.coalesce("_toks", "name_toks")).drop("_toks")


def native_coverage(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row: native tokens, the share that the dictionary maps, and native names."""
    words = records.where("nonlatin").select("id", F.explode("name_toks").alias("native")).where(F.col("native").rlike(NON_LATIN))
    found = words.join(dictionary.select("native", "latin"), "native", "left")
    return found.agg(F.count(F.lit(1)).alias("native_tokens"), F.avg(F.col("latin").isNotNull().cast("double")).alias("mapped_share"), F.countDistinct("id").alias("native_names"))


def learn_native_states(records: DataFrame, pairs: DataFrame, least: int = 20, share: float = 0.9) -> DataFrame:
    """token, state, support, share: native address tokens of records without a state, by the state of their true partner."""
    a = records.where("src = 1 and state is not null").select(F.col("id").alias("s1"), "state")
    b = records.where("state is null and size(addr_native) > 0").select(F.col("id").alias("c"), F.explode("addr_native").alias("token"))
    counts = pairs.join(b, "c").join(a, "s1").groupBy("token", "state").agg(F.count(F.lit(1)).alias("n"))
    return most_frequent(counts, "token", "state", least, share)


def apply_native_states(records: DataFrame, states: DataFrame) -> DataFrame:
    """records with missing states filled by the most frequent state of their native tokens (the smallest of ties)."""
    words = records.where("state is null and size(addr_native) > 0").select("id", F.explode("addr_native").alias("token"))
    found = words.join(states.select("token", F.col("state").alias("_st")), "token").groupBy("id", "_st").agg(F.count(F.lit(1)).alias("n"))
    first = found.groupBy("id").agg(F.min(F.struct(-F.col("n"), F.col("_st").alias("st"))).alias("_best"))
    filled = records.join(first.select("id", F.col("_best.st").alias("_found")), "id", "left")
    return filled.withColumn("state", F.coalesce("state", "_found")).drop("_found")


def marker_sides(pairs: DataFrame, markers: Sequence[str]) -> DataFrame:
    """For each marker: rows, mean similarity of the text before and after it to the true partner's name, and the better side.

    pairs: s1_name, name. One pass over the pairs for all markers.
    """
    own = tokens(F.col("s1_name"))
    found = pairs.select("s1_name", folded(F.col("name")).alias("name"), F.explode(F.array(*[F.lit(m) for m in markers])).alias("marker"))
    cut = F.concat(F.lit(LEFT), F.col("marker"), F.lit(RIGHT))
    parts = F.split(F.col("name"), cut, 2)
    sides = found.where(F.size(parts) == 2).select("marker", jaccard(own, tokens(F.trim(parts[0]))).alias("before"), jaccard(own, tokens(F.trim(parts[1]))).alias("after"))
    means = sides.groupBy("marker").agg(F.count(F.lit(1)).alias("n"), F.avg("before").alias("before"), F.avg("after").alias("after"))
    return means.withColumn("side", F.when(F.col("after") >= F.col("before"), "after").otherwise("before"))


def split_markers(sides: DataFrame) -> tuple[list[str], list[str]]:
    """(after, before) markers, the longest first; as many rows as markers."""
    rows = sides.select("marker", "side").collect()
    by = {s: sorted((r["marker"] for r in rows if r["side"] == s), key=lambda m: (-len(m), m)) for s in ("after", "before")}
    return by["after"], by["before"]
