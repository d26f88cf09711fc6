"""From pair probabilities to matches: threshold with one owner, expected-F sets, rule baselines, and grids as tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.config import DEFAULT
from weftline.operators.copies import of_copies, sizes
from weftline.operators.metrics import f_beta, per_entity, summary_columns, true_counts
from weftline.operators.nearest import best


def _owned(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each candidate record goes to its likeliest S1 (the smaller of ties)."""
    first = F.row_number().over(W.partitionBy(*keys, "c").orderBy(F.desc("p"), "s1"))
    return pred.withColumn("_o", first).where("_o = 1").drop("_o")


def decide(pred: DataFrame, threshold: float, relative: float = 0.0, copies: DataFrame | None = None) -> DataFrame:
    """s1, c with p of at least threshold and of relative times the S1's best, one owner for each record.

    copies: pred holds pairs of representatives. A record's owner is a representative itself, the smallest id of its copies, and owns the record's copies as well.
    """
    over = pred.where(F.col("p") >= threshold)
    if relative > 0:
        over = over.withColumn("_m", F.max("p").over(W.partitionBy("s1"))).where(F.col("p") >= relative * F.col("_m")).drop("_m")
    owned = _owned(over).select("s1", "c")
    return owned if copies is None else of_copies(owned, copies, ["c"])


def owners(s1s: DataFrame, cs: DataFrame, keys: Sequence[str], score: Callable[[Column], Column], threshold: float, relative: float = 0.0) -> DataFrame:
    """decide() of all pairs with equal keys, whose p is a score of the Jaccard similarity of their numbers, but without these pairs: s1s and cs are the records (id, keys, num)."""
    wanted, offered = cs.select(F.col("id").alias("w"), *keys, "num"), s1s.select(F.col("id").alias("o"), *keys, "num")
    if relative > 0:
        top = best(offered.withColumnRenamed("o", "w"), wanted.withColumnRenamed("w", "o"), keys, score)
        offered = offered.join(top.select(F.col("w").alias("o"), (relative * F.col("p")).alias("least")), "o")
    return best(wanted, offered, keys, score).where(F.col("p") >= threshold).select(F.col("o").alias("s1"), F.col("w").alias("c"))


def _expected_sets(owned: DataFrame, alpha, keys: Sequence[str] = ()) -> DataFrame:
    """Of each S1 the likeliest candidates, as many as maximise the expected F0.5, where that beats predicting nothing (which is right if no candidate is)."""
    group = W.partitionBy(*keys, "s1")
    ranked = group.orderBy(F.desc("p"), "c")
    sure_hits = F.sum("p").over(ranked.rowsBetween(W.unboundedPreceding, W.currentRow))
    wanted = F.sum("p").over(group) * (1 + alpha)
    nothing = F.exp(F.sum(F.log(F.greatest(F.least(1 - F.col("p"), F.lit(1.0)), F.lit(1e-12)))).over(group))
    value = (1.25 * F.col("_hits") / (F.col("_place") + 0.25 * F.col("_wanted"))).alias("value")
    x = owned.withColumns({"_place": F.row_number().over(ranked), "_hits": sure_hits, "_wanted": wanted, "_nothing": nothing})
    x = x.withColumn("_best", F.max(F.struct(value, (-F.col("_place")).alias("place"))).over(group))
    return x.where((F.col("_best.value") > F.col("_nothing")) & (F.col("_place") <= -F.col("_best.place"))).select(*keys, "s1", "c")


def decide_expected(pred: DataFrame, alpha: float = 0.0, floor: float = 0.05, copies: DataFrame | None = None) -> DataFrame:
    """s1, c: p of at least floor, one owner for each record, then the set of each S1 with the best expected F0.5; alpha adds mass for matches that blocking missed.

    copies: pred holds pairs of representatives; records are owned as in decide(), all copies count in the sets.
    """
    owned = _owned(pred.where(F.col("p") >= floor)).select("s1", "c", "p")
    return _expected_sets(owned if copies is None else of_copies(owned, copies, ["c"]), F.lit(alpha))


def exclusive(pairs: DataFrame) -> DataFrame:
    """Pairs whose candidate is claimed by one S1 only."""
    return pairs.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("c"))).where("_n = 1").drop("_n")


def baselines(pairs: DataFrame) -> dict[str, DataFrame]:
    """Rule baselines over name-key pairs with num_ok and b_addr_null: nothing, all, exclusive ones, exclusive ones with a shared number or no address."""
    alone = exclusive(pairs)
    return {"B0": pairs.where("false"), "B1": pairs, "B2": alone, "B3": alone.where("num_ok or b_addr_null")}


def tune(pred: DataFrame, true: DataFrame, base: DataFrame, thresholds: Sequence[float] = DEFAULT.thresholds, relatives: Sequence[float] = DEFAULT.relatives, copies: DataFrame | None = None) -> DataFrame:
    """The summary of decide() for each (thr, rel), all settings in one plan.

    The relative cut and the owner of a record don't depend on the threshold, so pairs are ranked once for each relative; the thresholds only count
    an S1's decided pairs and hits, which is done in one aggregation. Entities, not pairs, are multiplied by the settings. copies: pred and true hold
    pairs of representatives, base all S1s.
    """
    each = lambda values, name: F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name)
    best = F.max("p").over(W.partitionBy("s1"))
    cut = pred.select("s1", "c", "p").distinct().withColumn("_m", best).select("s1", "c", "p", "_m", each(relatives, "rel")).where("p >= rel * _m")
    hits = _owned(cut.drop("_m"), ["rel"]).join(true.select("s1", "c", F.lit(1).alias("hit")).distinct(), ["s1", "c"], "left")
    hits = hits.withColumn("n_c", F.lit(1).cast("long")) if copies is None else hits.join(sizes(copies, "c"), "c")
    some = lambda over: F.coalesce(F.sum(F.when(over, F.col("n_c"))), F.lit(0).cast("long"))
    counts = [F.struct(F.lit(float(t)).alias("thr"), some(F.col("p") >= t).alias("n_pred"), some((F.col("p") >= t) & F.col("hit").isNotNull()).alias("tp")) for t in thresholds]
    nothing = [F.struct(F.lit(float(t)).alias("thr"), F.lit(0).cast("long").alias("n_pred"), F.lit(0).cast("long").alias("tp")) for t in thresholds]
    got = hits.groupBy("rel", "s1").agg(F.array(*counts).alias("by"))
    want = true_counts(true, copies)
    entities = base.select("s1", each(relatives, "rel")).join(got, ["rel", "s1"], "left").join(want, "s1", "left").fillna(0, ["n_true"])
    every = entities.select("s1", "rel", "n_true", F.inline(F.coalesce("by", F.array(*nothing))))
    return every.withColumn("f", f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true"))).groupBy("thr", "rel").agg(*summary_columns())


def tune_expected(pred: DataFrame, true: DataFrame, base: DataFrame, alphas: Sequence[float] = DEFAULT.alphas, floors: Sequence[float] = DEFAULT.floors, copies: DataFrame | None = None) -> DataFrame:
    """The summary of decide_expected() for each (alpha, floor), all settings in one plan. A record's owner doesn't depend on them; only owned pairs, one for each record, are multiplied.

    copies: pred and true hold pairs of representatives, base all S1s.
    """
    grid = pred.sparkSession.createDataFrame([(float(a), float(f)) for a in alphas for f in floors], "alpha double, floor double")
    keys = ["alpha", "floor"]
    owned = _owned(pred).select("s1", "c", "p")
    owned = owned if copies is None else of_copies(owned, copies, ["c"])
    decided = _expected_sets(owned.crossJoin(F.broadcast(grid)).where("p >= floor"), F.col("alpha"), keys)
    every = base.select("s1").crossJoin(F.broadcast(grid))  # a row of the grid for each setting
    return per_entity(decided, true, every, keys=keys, copies=copies).groupBy(*keys).agg(*summary_columns())


def best_rule(pred: DataFrame, true: DataFrame, base: DataFrame) -> tuple[str, float, float]:
    """("threshold", thr, rel) or ("expected", alpha, floor), whichever grid holds the best macro F (the first of ties)."""
    a = tune(pred, true, base).orderBy(F.desc("f_macro"), "rel", "thr").first()
    b = tune_expected(pred, true, base).orderBy(F.desc("f_macro"), "alpha", "floor").first()
    if b is not None and (a is None or b["f_macro"] > a["f_macro"]):
        return "expected", b["alpha"], b["floor"]
    return "threshold", a["thr"], a["rel"]


def apply_rule(pred: DataFrame, rule: tuple[str, float, float]) -> DataFrame:
    return decide(pred, rule[1], rule[2]) if rule[0] == "threshold" else decide_expected(pred, rule[1], rule[2])


def match_lists(base: DataFrame, pairs: DataFrame, s1: str = "s1_entity", c: str = "c_entity") -> DataFrame:
    """source1_entity_id, matched_entity_ids: one row for each S1 of base, ids distinct, sorted and joined by commas; empty if none."""
    lists = pairs.groupBy(s1).agg(F.array_join(F.array_sort(F.collect_set(c)), ",").alias("ids"))
    return base.select(s1).distinct().join(lists, s1, "left").select(F.col(s1).alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))
