"""Learned scoring with MLlib: boosted trees over pair features, logistic blends, a stacker over several models' scores, and scoring of pairs by any callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.config import DEFAULT
from weftline.operators.features import FEATURES, blend_features, stack_features


class PairScorer(Protocol):
    """Adds a score column to pairs (s1, c, ...)."""

    def __call__(self, pairs: DataFrame) -> DataFrame: ...


def hash_sample(df: DataFrame, key: str, share: float, seed: int = 11) -> DataFrame:
    """Rows whose key's digest falls into a share: the same sample in every stage and on every cluster."""
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def labelled(pairs: DataFrame, true: DataFrame) -> DataFrame:
    """pairs with y, 1 for true ones."""
    return pairs.join(true.select("s1", "c", F.lit(1.0).alias("y")).distinct(), ["s1", "c"], "left").fillna(0.0, ["y"])


def fit_matcher(features: DataFrame, columns: Sequence[str] = tuple(FEATURES), rounds: int = 60, depth: int = 5, seed: int = 7, weight: str | None = None) -> PipelineModel:
    """Boosted trees over features with y; rows with `held` true stop the rounds early, if there is such a column. weight: a column that says how many equal rows each stands for."""
    trees = GBTClassifier(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=20, seed=seed, cacheNodeIds=True, checkpointInterval=-1)
    if "held" in features.columns:
        trees = trees.setValidationIndicatorCol("held")
    if weight is not None:
        trees = trees.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="x"), trees]).fit(features)


def spread(kinds: DataFrame, rows: str, weight: str, most: int = 1024) -> DataFrame:
    """Each of some kinds of equal rows as many rows as it has, `most` at most, that share its weight: a fit that draws rows and counts them in its leaves does so as with all."""
    m = F.least(F.col(rows), F.lit(most)).cast("int")
    each = kinds.where((F.col(rows) > 0) & (F.col(weight) > 0)).coalesce(1).sortWithinPartitions(*kinds.columns)  # in a fixed order, as rows are drawn by it
    return each.withColumn(weight, F.col(weight) / m).select("*", F.explode(F.sequence(F.lit(1), m)).alias("_i")).drop("_i", rows)


def predict(model: PipelineModel, features: DataFrame, least: float = 0.01, keep: Sequence[str] = ("s1", "c")) -> DataFrame:
    """s1, c (or what else to keep), p of at least `least`."""
    return model.transform(features).select(*keep, vector_to_array("probability")[1].alias("p")).where(F.col("p") >= least)


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """Features by their share of the gain."""
    shares = model.stages[-1].featureImportances.toArray()
    return sorted(zip(model.stages[0].getInputCols(), shares.tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def fit_blend(scores: DataFrame, models: Sequence[str], c: float = 1.0, band: tuple[float, float] = DEFAULT.uncertain, weight: str | None = None) -> PipelineModel:
    """Logistic regression over logit(p), model scores and their products, on the pairs whose p lies in the uncertain band. weight: a column that says how many equal rows each stands for."""
    x = blend_features(scores.where(F.col("p").between(*band)), models)
    n = max(1, x.count() if weight is None else x.agg(F.sum(weight)).first()[0] or 0)
    columns = ["logit_p", *models, *[f"logit_p_x_{m}" for m in models]]
    blend = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / (c * n), standardization=False)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x"), blend if weight is None else blend.setWeightCol(weight)]).fit(x)


def blended(model: PipelineModel, scores: DataFrame, models: Sequence[str], band: tuple[float, float] = DEFAULT.uncertain, keep: Sequence[str] = ("s1", "c")) -> DataFrame:
    """s1, c (or what else to keep), p with the blend's probability inside the band."""
    x = model.transform(blend_features(scores, models)).withColumn("_b", vector_to_array("probability")[1])
    return x.select(*keep, F.when(F.col("p").between(*band), F.col("_b")).otherwise(F.col("p")).alias("p"))


def pseudo_labels(scores: DataFrame, sure: float = 0.98, never: float = 0.02, most: int = 300_000, negatives: int = 2, seed: int = 13) -> DataFrame:
    """y 1 for scores from `sure`, 0 below `never` or null, the rest dropped; at most `most` ones and `negatives` zeros for each, by digest."""
    y = F.when(F.col("p") >= sure, 1.0).when(F.coalesce("p", F.lit(0.0)) < never, 0.0)
    some = scores.withColumn("y", y).where("y is not null").withColumn("_h", F.xxhash64("s1", "c", F.lit(seed)))
    ones = some.where("y = 1").orderBy("_h").limit(most)
    zeros = some.where("y = 0").orderBy("_h").limit(negatives * max(1, ones.count()))
    return ones.unionByName(zeros).drop("_h")


def hard_pairs(rated: DataFrame, true: DataFrame, top: int = 10) -> DataFrame:
    """Training pairs: each S1's best by q, and all true pairs that were blocked, with y."""
    from weftline.operators.features import best_candidates

    best = best_candidates(rated, top, 0).select("s1", "c")
    blocked = rated.select("s1", "c").join(true.select("s1", "c"), ["s1", "c"], "left_semi")
    return labelled(best.unionByName(blocked).distinct(), true)


def save_model(model: PipelineModel, path: str) -> None:
    """Writes a fitted model, in place of what is there."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def best_predictions(model: PipelineModel, features: DataFrame, least: float = 0.01, top: int = 10) -> DataFrame:
    """predict(), and of each S1 the `top` likeliest candidates only (smaller ids first among equals)."""
    rank = F.row_number().over(W.partitionBy("s1").orderBy(F.desc("p"), "c"))
    return predict(model, features, least).withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")


def stack_columns(models: Sequence[str]) -> list[str]:
    """The columns of stack_features() that the stacker reads."""
    return ["lp", "n_top", "lp_rank", "lp_gap", *[f"{m}{x}" for m in models for x in ("", "_rank", "_gap", "_vs2nd")]]


def fit_stacker(scores: DataFrame, models: Sequence[str], rounds: int = 60, depth: int = 4, seed: int = 7) -> PipelineModel:
    """Boosted trees over p and several models' scores in the context of an S1's other candidates. scores: s1, c, p, the models' columns and y."""
    return fit_matcher(stack_features(scores, models).fillna(0.0), stack_columns(models), rounds, depth, seed)


def stacked(model: PipelineModel, scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """s1, c, p by the stacker."""
    return predict(model, stack_features(scores, models).fillna(0.0), 0.0)


def scored_by(pairs: DataFrame, score: Callable[[list[str], list[str]], Sequence[float]], name: str, batch: int = 256) -> DataFrame:
    """pairs (s1, c, a_text, b_text) to s1, c and a column of scores from any callable over batches of texts, such as a cross-encoder that each Python worker loads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                some = rows.slice(at, batch)
                values = score(*[[t or "" for t in some.column(i).to_pylist()] for i in (2, 3)])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([float(v) for v in values], pa.float64())], names=["s1", "c", name])

    schema = f"s1 {pairs.schema['s1'].dataType.simpleString()}, c {pairs.schema['c'].dataType.simpleString()}, {name} double"
    return pairs.select("s1", "c", "a_text", "b_text").mapInArrow(run, schema)
