"""The best partners of records by the Jaccard similarity of their numbers, without a pair for any two records that share a key.

Records of few numbers meet by what they share: each offers itself under every subset of its numbers, and of those that a subset and a count of numbers (so a similarity) have in
common only the first k can be among the k best. A record asks with its own subsets; one smaller than what is shared gives too low a score, and the right one is asked for as well. Records
of many numbers, whose subsets would be too many, are compared one by one with all that share their keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.arrays import jaccard

#: Records of more numbers are compared one by one.
FEW = 5


def _subsets(df: DataFrame, *columns: str) -> DataFrame:
    """columns, n: how many numbers a record has, and shared: each subset of them, in order."""
    each = F.expr("transform(sequence(0, cast(power(2, size(num)) as int) - 1), m -> filter(num, (x, i) -> getbit(m, i) = 1))")
    return df.select(*columns, F.size("num").alias("n"), F.explode(each).alias("shared"))


def best(wanted: DataFrame, offered: DataFrame, keys: Sequence[str], score: Callable[[Column], Column], k: int = 1) -> DataFrame:
    """w, o, p: for each wanted record (w, keys, num) the k offered ones (o, keys, num) of equal keys with the best score p, the smaller o of ties.

    num: distinct sorted numbers, never null. score: of the similarity, never falling as that rises. offered may have `least`: a lower p is none for this record.
    """
    few, many, more = F.size("num") <= FEW, F.size("num") > FEW, [c for c in offered.columns if c == "least"]
    first = F.row_number().over(W.partitionBy(*keys, "shared", "n", *more).orderBy("o"))
    index = _subsets(offered.where(few), *keys, "o", *more).withColumn("_r", first).where(F.col("_r") <= k).drop("_r").withColumnRenamed("n", "_n")
    union = F.col("n") + F.col("_n") - F.size("shared")
    similar = F.when(union > 0, F.size("shared") / union).otherwise(F.lit(0.0))
    found = _subsets(wanted.where(few), *keys, "w").join(index, [*keys, "shared"]).select("w", "o", *more, score(similar).alias("p"))
    for a, b in ((wanted.where(many), offered), (wanted.where(few), offered.where(many))):
        pairs = a.join(b.withColumnRenamed("num", "_num"), [*keys])
        found = found.unionByName(pairs.select("w", "o", *more, score(jaccard(F.col("num"), F.col("_num"))).alias("p")))
    if more:
        found = found.where("p >= least")
    if k > 1:
        found = found.groupBy("w", "o").agg(F.max("p").alias("p"))
    place = F.row_number().over(W.partitionBy("w").orderBy(F.desc("p"), "o"))
    return found.select("w", "o", "p").withColumn("_r", place).where(F.col("_r") <= k).drop("_r")


def tally(wanted: DataFrame, offered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """similarity, pairs: how many pairs of a wanted (keys, num) and an offered record of equal keys have numbers of that similarity. No pair of records of few numbers is made.

    Records that have a subset in common are counted by it, so a pair of i shared numbers counts C(i, j) times under subsets of j; how many pairs share i is solved from these counts.
    """
    few, many = F.size("num") <= FEW, F.size("num") > FEW
    a, b = (_subsets(x.where(few), *keys).groupBy(*keys, "shared", "n").agg(F.count(F.lit(1)).alias(c)) for x, c in ((wanted, "x"), (offered, "y")))
    met = a.join(b.withColumnRenamed("n", "_n"), [*keys, "shared"]).groupBy(F.size("shared").alias("j"), "n", "_n").agg(F.sum(F.col("x") * F.col("y")).alias("m"))
    ways = F.expr("cast(round(factorial(j) / (factorial(i) * factorial(j - i))) as bigint) * if((j - i) % 2 = 0, 1, -1)")
    exact = met.select("*", F.explode(F.sequence(F.lit(0), "j")).alias("i")).groupBy("n", "_n", "i").agg(F.sum(ways * F.col("m")).alias("pairs")).where("pairs > 0")
    union = F.col("n") + F.col("_n") - F.col("i")
    found = exact.select(F.when(union > 0, F.col("i") / union).otherwise(F.lit(0.0)).alias("similarity"), "pairs")
    for x, y in ((wanted.where(many), offered), (wanted.where(few), offered.where(many))):
        pairs = x.select(*keys, "num").join(y.select(*keys, F.col("num").alias("_num")), [*keys])
        found = found.unionByName(pairs.groupBy(jaccard(F.col("num"), F.col("_num")).alias("similarity")).agg(F.count(F.lit(1)).alias("pairs")))
    return found.groupBy("similarity").agg(F.sum("pairs").alias("pairs"))
