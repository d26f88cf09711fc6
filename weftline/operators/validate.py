"""Checks of result files: every rule as a query, findings as (rule, severity, n, example)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.io import with_row_index

HEADERS = {"matches": ("source1_entity_id", "matched_entity_ids"), "candidates": ("source1_entity_id", "candidate_entity_ids")}
FINDINGS = "rule string, severity string, n long, example string"


def _finding(bad: DataFrame, rule: str, severity: str, example: Column) -> DataFrame:
    return bad.agg(F.count(F.lit(1)).alias("n"), F.min(example.cast("string")).alias("example")).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "example")


def check_header(line: str, kind: str) -> list[tuple[str, str]]:
    """(rule, severity) findings of a file's first line."""
    if "\t" not in line:
        return [("header_not_tab_separated", "fatal")]
    return [] if tuple(line.rstrip("\r\n").split("\t")) == HEADERS[kind] else [("wrong_header", "fatal")]


def check_lists(lists: DataFrame, required: DataFrame, known: DataFrame | None = None, ids: str = "matched_entity_ids") -> DataFrame:
    """Findings of (source1_entity_id, ids): repeated rows, repeated ids in a list, ids of S1 or without a source, unknown ids, missing and surplus rows.

    required: source1_entity_id that must have a row; known: entity_id that may be named, if that is to be checked.
    """
    s1 = "source1_entity_id"
    rows = lists.groupBy(s1).agg(F.count(F.lit(1)).alias("k"))
    items = lists.select(s1, F.explode(F.split(ids, ",")).alias("id")).select(s1, F.trim("id").alias("id")).where("id <> ''")
    twice = items.groupBy(s1, "id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    out = [
        _finding(rows.where("k > 1"), "duplicate_rows", "error", F.col(s1)), _finding(twice, "repeated_ids", "error", F.col("id")),
        _finding(items.where("id like 'S1-%'"), "self_match", "error", F.col("id")), _finding(items.where("not (id like 'S1-%' or id like 'S2-%' or id like 'S3-%')"), "bad_prefix", "error", F.col("id")),
        _finding(required.select(s1).distinct().join(rows, s1, "left_anti"), "missing_rows", "error", F.col(s1)), _finding(rows.join(required.select(s1).distinct(), s1, "left_anti"), "surplus_rows", "error", F.col(s1)),
    ]
    if known is not None:
        out.append(_finding(items.join(known.select(F.col("entity_id").alias("id")).distinct(), "id", "left_anti"), "unknown_ids", "error", F.col("id")))
    return reduce(DataFrame.unionByName, out)


def check_file(spark: SparkSession, path: str, kind: str = "matches") -> DataFrame:
    """Findings of a result file before its rows are read: missing_file, empty_file, those of the header, and lines without a tab with the number of the first."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([("missing_file", "fatal", 1, path)], FINDINGS)
    lines = with_row_index(spark.read.text(path), "line")
    first = lines.where("line = 0").first()
    if first is None:
        return spark.createDataFrame([("empty_file", "fatal", 1, path)], FINDINGS)
    header = spark.createDataFrame([(rule, severity, 1, first["value"]) for rule, severity in check_header(first["value"], kind)], FINDINGS)
    untabbed = lines.where((F.col("line") > 0) & ~F.contains("value", F.lit("\t")))
    return header.unionByName(_finding(untabbed, "line_without_tab", "error", F.lpad((F.col("line") + 1).cast("string"), 12, " ")).withColumn("example", F.trim("example")))


def quick_checks(lists: DataFrame, ids: str = "matched_entity_ids") -> DataFrame:
    """One row of plain counts for a look at a result: rows, distinct S1s, rows without ids, ids, distinct ids, ids in several rows, most and mean ids in a row."""
    sized = lists.withColumn("_ids", F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), ","), F.trim), lambda x: x != ""))
    rows = sized.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("source1_entity_id").alias("entities"), F.count(F.when(F.size("_ids") == 0, 1)).alias("empty"), F.sum(F.size("_ids")).alias("ids"),
        F.max(F.size("_ids")).alias("most"), F.avg(F.size("_ids").cast("double")).alias("mean"),
    )
    uses = sized.select(F.explode("_ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("distinct_ids"), F.count(F.when(F.col("n") > 1, 1)).alias("shared_ids"))
    return rows.crossJoin(uses)  # a row each


def check_subset(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """A warning with the matches that are no candidates."""
    def pairs(df: DataFrame, ids: str) -> DataFrame:
        return df.select("source1_entity_id", F.explode(F.split(ids, ",")).alias("id")).select("source1_entity_id", F.trim("id").alias("id")).where("id <> ''")

    outside = pairs(matches, "matched_entity_ids").join(pairs(candidates, "candidate_entity_ids"), ["source1_entity_id", "id"], "left_anti")
    return _finding(outside, "match_not_candidate", "warning", F.col("id"))


def passes(findings: DataFrame) -> bool:
    """Whether no error or fatal finding has rows."""
    return findings.where("severity <> 'warning' and n > 0").isEmpty()
