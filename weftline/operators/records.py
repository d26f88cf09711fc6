"""Records: raw rows of the sources with normalised names and addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions.address import with_address
from weftline.functions.arrays import digits_to_letters, with_short_numbers
from weftline.sources.tables import id_code, source_of


def build_base(raw: DataFrame, after: Sequence[str] | None = None, before: Sequence[str] | None = None) -> DataFrame:
    """Raw rows (entity_id, business_name, business_address, country) with ids, numbers, parsed addresses and name tokens."""
    name, address = F.col("business_name"), F.col("business_address")
    rows = raw.select("*", id_code(F.col("entity_id")).alias("id"))
    rows = rows.withColumns({"src": source_of(F.col("id")), "nonlatin": X.is_non_latin(name), "num": X.numbers_int(address), "addr_null": address.isNull(), "name_toks": X.name_tokens_v1(name, after, before)})
    return with_address(rows).drop("business_address")


def finalize(base: DataFrame) -> DataFrame:
    """Adds core, joined and sorted name keys and the name string."""
    core = base.withColumn("name_core", X.core_from_tokens(F.col("name_toks")))
    return core.withColumns({"k1": F.array_join("name_core", ""), "k2": F.array_join(F.array_sort("name_core"), " "), "name_str": F.array_join("name_toks", " ")})


def prepare(records: DataFrame) -> DataFrame:
    """Adds names with repaired digits, their keys, and the numbers with short variants."""
    fixed = records.withColumn("core_f", digits_to_letters(F.col("name_core")))
    return fixed.withColumns({"k1f": F.array_join("core_f", ""), "k2f": F.array_join(F.array_sort("core_f"), " "), "numx": with_short_numbers(F.col("num"))})


def duplicate_ids(records: DataFrame) -> DataFrame:
    """Ids that stand for several records; none in sound data."""
    return records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
