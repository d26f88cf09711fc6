"""Helpers shared by the training-data operators: stable row keys, tables in the shared folder, ASCII lower-casing."""

from __future__ import annotations

import contextlib
import contextvars
import logging
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of the two columns that tell one stored row from every other.
ROW_KEY = ["__wl_f", "__wl_i"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts of a batch that are in Python at the same time.
TEXTS_AT_ONCE = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets one of its own; a cluster's executors could not reach it, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Paths that the enclosing scratch() deletes.
_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside are deleted at the end, but for those that are kept: what a result is computed from must be written by then."""
    paths: list[str] = []
    token = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            _remove(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, gives sizes to the planner. keep: a surrounding scratch() leaves it."""
    path = new_path(df.sparkSession, name)
    paths = _SCRATCH.get()
    if paths is not None and not keep:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(df: DataFrame) -> None:
    """Deletes what materialise() wrote and nothing reads any more."""
    for file in df.inputFiles()[:1]:
        _remove(df.sparkSession, file.rpartition("/")[0])


def with_row_key(df: DataFrame) -> DataFrame:
    """Adds ROW_KEY, (hash of the file's path, row number in the file): the same in every job, however files are split.

    A frame that isn't a plain scan of Parquet files is written to the shared folder first. Columns may have any names, that of the hidden metadata included.
    """
    try:
        return _keyed(df)
    except AnalysisException:
        return _keyed(materialise(df, "rows", keep=True))


def _keyed(df: DataFrame) -> DataFrame:
    log = logging.getLogger("DataFrameQueryContextLogger")
    level, _ = log.level, log.setLevel(logging.CRITICAL)
    try:
        hidden = df.metadataColumn("_metadata")
        out = df.select("*", F.xxhash64(hidden["file_path"]).alias(ROW_KEY[0]), hidden["row_index"].alias(ROW_KEY[1]))
        out.schema  # noqa: B018 - analysed here, where a frame without files is told
        return out
    finally:
        log.setLevel(level)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; lower() does it where every character is ASCII, translate() elsewhere."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_of(key: Column) -> Column:
    """crc32 of the key as text (null: of the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")))


def map_texts(df: DataFrame, text_col: str, work: Callable[[list[str | None]], list[pa.Array]], made: list[T.StructField], keep_text: bool = False) -> DataFrame:
    """df with columns made from its texts in Python, a few rows at a time; the text itself goes unless keep_text.

    Columns may have any names (with dots, or like those that are made, which replace them).
    """
    new = [f.name for f in made]
    text_at = df.columns.index(text_col)
    rest = [i for i, c in enumerate(df.columns) if (i != text_at or keep_text) and c not in new]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                columns = work(some.column(text_at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in rest), *columns], names=[*(f"c{i}" for i in rest), *(f"m{i}" for i in range(len(made)))])

    schema = T.StructType([T.StructField(f"c{i}", df.schema[i].dataType) for i in rest] + [T.StructField(f"m{i}", f.dataType) for i, f in enumerate(made)])
    return plain.mapInArrow(run, schema).toDF(*[df.columns[i] for i in rest], *new)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elect(rows: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Adds to rows (with ROW_KEY) leader, the largest order_col among rows of equal keys, group_size, and elected: true for one row of a group.

    Elected is the row with the leader's value, of several the first stored; nulls lose to any value. Groups are summed before the
    shuffle and written before the join back, so that a hot group's rows can be split.
    """
    groups = rows.groupBy(*keys).agg(F.max(order_col).alias("leader"), F.count(F.lit(1)).alias("group_size"))
    sized = rows.join(materialise(groups, "groups"), keys)
    leads = F.col(order_col).eqNullSafe(F.col("leader"))
    # values are unique as a rule; only where they are not, the first of the leading rows is looked for
    tied = materialise(sized.where(leads).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys), "tied")
    if tied.isEmpty():
        return sized.withColumn("elected", leads)
    ordinal = F.struct(*ROW_KEY)
    firsts = sized.where(leads).join(tied, keys, "left_semi").groupBy(*keys).agg(F.min(ordinal).alias("first"))
    marked = sized.join(materialise(firsts, "firsts"), keys, "left")
    return marked.withColumn("elected", leads & (F.col("first").isNull() | (F.col("first") == ordinal))).drop("first")
