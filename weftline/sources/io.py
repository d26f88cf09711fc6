"""Readers and writers: quoteless TSV, Parquet with pushdown, row numbers, line counts, stage registry, id lists."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RAW = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def read_tsv(spark: SparkSession, path: str | Sequence[str], schema: str = RAW) -> DataFrame:
    """Tab-separated text with a header and no quoting: a quotation mark is data; empty fields are null; every column as the schema says."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", escape="", encoding="UTF-8", mode="PERMISSIVE")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header, never quoted; empty strings stay empty."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="")


def settled(df: DataFrame) -> DataFrame:
    """df computed once, so that what depends on the order or cut of its partitions is the same wherever it is used: in the checkpoint folder if there is one, else kept."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def with_row_index(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Adds the row's position in reading order: the partitions' row counts are summed, no row moves to one task."""
    placed = settled(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))  # a row for each partition
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + F.col("_at") - F.shiftleft("_part", 33)).alias(name))


def cut(df: DataFrame) -> DataFrame:
    """df computed once: written to the checkpoint folder, or kept by the executors where the session has none. Its plan and what optimisers push into it end here."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


#: A table of more rows is not broadcast by looked_up().
SMALL = 50_000


def looked_up(df: DataFrame) -> DataFrame:
    """A table to look things up in, computed once: broadcast if it turns out to have few rows, so that what meets it need not move."""
    known = cut(df)
    return F.broadcast(known) if known.count() <= SMALL else known


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A stage's Parquet table (zstd), by partition columns."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def read_stage(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
    """One or several Parquet tables; columns and predicates reach the scan."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def find_stage(spark: SparkSession, name: str, roots: Sequence[str]) -> str | None:
    """The first of roots under which a stage of this name is stored, on any file system Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        if path.getFileSystem(conf).exists(path):
            return path.toString()
    return None


def first_of_each(paths: Sequence[str]) -> list[str]:
    """Shards by their last path element; of several the first one counts."""
    first: dict[str, str] = {}
    for p in paths:
        first.setdefault(p.rstrip("/").rpartition("/")[2], p)
    return list(first.values())


def line_check(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """One row: raw_rows (lines without the header), parsed_rows, mismatch."""
    lines = spark.read.text(path).agg((F.count(F.lit(1)) - 1).alias("raw_rows"))
    parsed = read_tsv(spark, path, schema).agg(F.count(F.lit(1)).alias("parsed_rows"))
    return lines.join(parsed).withColumn("mismatch", F.col("raw_rows") != F.col("parsed_rows"))


def report_json(df: DataFrame) -> str:
    """A small report frame as JSON; other scripts are kept as they are. For summaries of a few rows."""
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], indent=1, ensure_ascii=False, default=str)


def shards(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a glob, in order, on any file system Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(f.getPath().toString() for f in found)


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """Copies a file or folder, also between file systems; what is at the target is replaced."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of several frames by column names; columns that one lacks are null."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def load_split(spark: SparkSession, root: str, split: str, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The records of a split's three sources (tables <split>_source1 to 3 under root), with the source's number, and its truth (<split>_ground_truth; empty if there is none).

    Ids must be unique over all sources; if some are not, it is an error that names one.
    """
    tables = [find_stage(spark, f"{split}_source{n}", [root]) for n in (1, 2, 3)]
    if None in tables:
        raise FileNotFoundError(f"{split}_source{tables.index(None) + 1} below {root}")
    rows = union_all([read_stage(spark, path, columns).withColumn("src", F.lit(n)) for n, path in enumerate(tables, 1)])
    twice = rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['entity_id']} stands for {twice['n']} records")
    truth = find_stage(spark, f"{split}_ground_truth", [root])
    return rows, read_stage(spark, truth) if truth else spark.createDataFrame([], TRUTH)
