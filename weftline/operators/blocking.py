"""Candidate pairs by blocking: keys of five passes, block joins under a cap, and the union of passes with their bits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.config import DEFAULT, Linkage, Pass
from weftline.sources.io import looked_up

KEY = ["country", "key"]


def counted(records: DataFrame) -> Column:
    """How many records the rows of a group are: rows with n_copies stand for as many."""
    return F.sum("n_copies") if "n_copies" in records.columns else F.count(F.lit(1))


def rarest_tokens(records: DataFrame, words: str, n: int, cfg: Linkage = DEFAULT) -> DataFrame:
    """country, id, tok, f: each record's n rarest tokens, of cfg.rare_letters letters and in cfg.rare_records records of the country."""
    weight = [c for c in ("n_copies",) if c in records.columns]
    each = records.select("country", "id", *weight, F.explode(F.array_distinct(words)).alias("tok")).where(F.length("tok") >= cfg.rare_letters)
    known = looked_up(each.groupBy("country", "tok").agg(counted(records).alias("f")).where(F.col("f") >= cfg.rare_records))
    place = F.row_number().over(W.partitionBy("country", "id").orderBy("f", "tok"))
    return each.join(known, ["country", "tok"]).withColumn("_place", place).where(F.col("_place") <= n).select("country", "id", "tok", "f")


def block_keys(records: DataFrame, kind: str, cfg: Linkage = DEFAULT) -> DataFrame:
    """country, id, key of a pass; records are prepared. Records move once, by country and id; their keys do not."""
    records = records.repartition("country", "id")
    if kind == "name_exact":
        keys = records.select("country", "id", F.explode(F.array_distinct(F.array("k1", "k2", "k1f", "k2f"))).alias("key")).where("key <> ''")
    elif kind in ("num_name", "num_addr"):
        words, n = ("core_f", cfg.rare_name) if kind == "num_name" else ("addr_toks", cfg.rare_addr)
        rare = rarest_tokens(records, words, n, cfg).groupBy("country", "id").agg(F.collect_list("tok").alias("toks"))  # n tokens
        both = rare.join(records.select("country", "id", "numx"), ["country", "id"])
        keys = both.select("country", "id", "toks", F.explode("numx").alias("num")).select("country", "id", "num", F.explode("toks").alias("tok"))
        keys = keys.select("country", "id", F.concat_ws("|", F.col("num").cast("string"), "tok").alias("key"))
    elif kind == "name_pair":
        rare = rarest_tokens(records, "core_f", cfg.rare_pair, cfg).groupBy("country", "id").agg(F.array_sort(F.collect_list("tok")).alias("t"))
        pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.filter("t", lambda _, j: j > i), lambda b: F.concat_ws("|", a, b))))
        keys = rare.select("country", "id", F.explode(F.when(F.size("t") == 1, F.col("t")).otherwise(pairs)).alias("key"))
    elif kind == "name_prefix":
        start = [F.substring(F.get("core_f", F.lit(i)), 1, 3) for i in (0, 1)]
        some = records.where(F.length(start[0]) >= 2)
        keys = some.select("country", "id", F.concat_ws("|", F.coalesce("state", F.lit("")), start[0], F.coalesce(start[1], F.lit(""))).alias("key"))
    else:
        raise ValueError(f"no such pass: {kind}")
    return keys.distinct()


def with_source(keys: DataFrame, records: DataFrame) -> DataFrame:
    """Adds the source, and n_copies if records have it."""
    out = keys.withColumn("src", F.floor(F.col("id") / 10_000_000_000).cast("int"))
    return out.join(records.select("country", "id", "n_copies"), ["country", "id"]) if "n_copies" in records.columns else out


def oversized(keys: DataFrame, cap: int) -> DataFrame:
    """country, key, n of keys with more than cap candidate records."""
    return keys.where("src <> 1").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)


def block_pairs(keys: DataFrame, cap: int) -> DataFrame:
    """country, s1, c: distinct pairs that share a key with at most cap candidate records.

    Keys are counted before the join, so no block gives more than cap pairs for a record; keys over the cap are left out on both sides.
    """
    small = looked_up(keys.where("src <> 1").groupBy(*KEY).agg(counted(keys).alias("n")).where(F.col("n") <= cap).select(*KEY))
    candidates = keys.where("src <> 1").join(small, KEY, "left_semi").select(*KEY, F.col("id").alias("c"))
    return keys.where("src = 1").join(small, KEY, "left_semi").select(*KEY, F.col("id").alias("s1")).join(candidates, KEY).select("country", "s1", "c").distinct()


def candidates(records: DataFrame, passes: Sequence[Pass] | None = None, cfg: Linkage = DEFAULT) -> DataFrame:
    """country, s1, c, mask: the pairs of all passes, each with the bits of the passes that found it. Records with n_copies stand for as many in counts and caps; pairs are theirs."""
    found = []
    for p in passes or cfg.passes:
        keys = with_source(block_keys(records, p.name, cfg), records)
        found.append(block_pairs(keys, p.cap).withColumn("bit", F.lit(p.bit)))
    return reduce(DataFrame.unionByName, found).groupBy("country", "s1", "c").agg(F.bit_or("bit").alias("mask"))


def merged(keyed: DataFrame, nearest: DataFrame, bit: int = DEFAULT.tfidf_bit) -> DataFrame:
    """Pairs of key passes and of the nearest-neighbour pass (tf_cos, tf_rank) in one table; the latter set their bit."""
    both = keyed.join(nearest, ["country", "s1", "c"], "full")
    mask = F.coalesce("mask", F.lit(0)).bitwiseOR(F.when(F.col("tf_rank").isNotNull(), F.lit(bit)).otherwise(F.lit(0)))
    return both.select("country", "s1", "c", mask.alias("mask"), "tf_cos", "tf_rank")


def siblings(confident: DataFrame, keys: DataFrame, known: DataFrame, cap: int = 50) -> DataFrame:
    """s1, c: records that share a key with a confident match of s1 and are no candidates yet (two hops)."""
    small = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= cap).select(*KEY)
    near = keys.join(small, KEY, "left_semi")
    hop = confident.join(near.select(*KEY, F.col("id").alias("m")), confident["c"] == F.col("m")).select("s1", *KEY, "m")
    far = near.where("src <> 1").select(*KEY, F.col("id").alias("c"))
    return hop.join(far, KEY).where("m <> c").select("s1", "c").distinct().join(known.select("s1", "c"), ["s1", "c"], "left_anti")
