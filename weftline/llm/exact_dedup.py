"""Exact deduplication by deterministic block naming.

Normalised texts are cut into fixed-size blocks of bytes. Equal blocks get one integer name, distinct blocks distinct
names; then adjacent pairs of names are named in the same way, again and again, until each document has one name left.
Two documents share (block count, name) exactly when their texts are equal: no digest decides.

Bytes of blocks are shuffled once, to count the distinct blocks behind each 64-bit digest. A digest that stands for one
block is sorted into an integer name in its place; blocks of a digest that stands for several are sorted and named by their
bytes. A name is bucket * 2**40 + rank in the sorted bucket, so there is no global sort and no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm._common import ROW_KEY, ascii_lower, elect, materialise, scratch, with_row_key

BLOCK_BYTES = 4096
#: Buckets in which distinct items are sorted for their names; a bucket holds items, never copies of one.
BUCKETS = 1 << 16


def _named(items: DataFrame, order: list[str]) -> DataFrame:
    """Adds name to distinct items by sorting each bucket of them."""
    bucket = F.pmod(F.xxhash64(*order), F.lit(BUCKETS))
    ranked = items.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(W.partitionBy("bucket").orderBy(*order)))
    return ranked.select(*items.columns, (F.col("bucket") * F.lit(1 << 40) + F.col("rank")).alias("name"))


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """Rows of blocks with name in place of block and digest."""
    spark = blocks.sparkSession
    distinct = blocks.groupBy("digest", "block").agg(F.count(F.lit(1)).alias("copies"))
    digests = materialise(distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")), "digests")
    keep = [c for c in blocks.columns if c not in ("digest", "block")]
    shared = digests.where("texts > 1").select("digest")
    names = materialise(_named(digests.where("texts = 1").select("digest"), ["digest"]), "names")
    by_digest = blocks.drop("block").join(names, "digest").select(*keep, "name")
    if shared.isEmpty():
        return by_digest
    clashing = blocks.join(shared, "digest", "left_semi")
    texts = _named(materialise(clashing.select("block").distinct(), "clashes"), ["block"]).withColumn("name", -F.col("name"))
    return by_digest.unionByName(clashing.join(texts, "block").select(*keep, "name"))


def _name_pairs(rows: DataFrame) -> DataFrame:
    """One level up: names of adjacent pairs; the last of an odd number pairs with nothing (-0x1)."""
    at = F.col("pos") % 2 == 0
    pairs = materialise(
        rows.groupBy(*ROW_KEY, "blocks", (F.col("pos") / 2).cast("long").alias("at"))
        .agg(F.max(F.when(at, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~at, F.col("name"))), F.lit(0)).alias("b")),
        "pairs",
    )
    names = materialise(_named(pairs.select("a", "b").distinct(), ["a", "b"]), "pair_names")
    return pairs.join(names, ["a", "b"]).select(*ROW_KEY, F.col("at").alias("pos"), "blocks", "name")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: ROW_KEY, doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the row with the largest id stays; ids that are null lose to any other, and
    among rows with the same id the one stored first stays (exactly one row of a group is kept, also if all its ids are null;
    keep_id is null then). Empty tables give no rows; other columns of docs are not read.
    """
    keyed = with_row_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    with scratch(docs.sparkSession):
        identity = _identities(keyed, block_bytes)
    chosen = elect(identity, ["blocks", "name"], "doc_id")
    return chosen.select(*ROW_KEY, "doc_id", F.col("leader").alias("keep_id"), "group_size", F.col("elected").alias("kept"), "text_sha256")


def _identities(keyed: DataFrame, block_bytes: int) -> DataFrame:
    """ROW_KEY, blocks, name, doc_id and text_sha256 of each document: equal texts, and they alone, have the same (blocks, name)."""
    raw = keyed.select(*ROW_KEY, "doc_id", ascii_lower(F.coalesce("text", F.lit(""))).cast("binary").alias("raw"))
    # lower-cased and digested once for each document, below the generator: an expression in a lambda runs for each element
    raw = raw.withColumns({"text_sha256": F.sha2("raw", 256), "blocks": F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / F.lit(block_bytes)).cast("long"))})
    cut = raw.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("pos"))
    first, block = F.col("pos") == 0, F.substring("raw", (F.col("pos") * block_bytes + 1).cast("int"), F.lit(block_bytes))
    cut = cut.select(*ROW_KEY, "blocks", "pos", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("text_sha256")).alias("text_sha256"), block.alias("block"))
    cut = cut.withColumn("digest", F.xxhash64("block"))
    level = materialise(_name_blocks(cut), "named_blocks")
    facts = level.where("pos = 0").select(*ROW_KEY, "doc_id", "text_sha256")
    most = level.agg(F.max("blocks")).first()[0] or 1
    rows, left, done = level.select(*ROW_KEY, "pos", "blocks", "name"), 1, []
    while True:
        # a document of b blocks has ceil(b / left) names at this level, and is done with one
        done.append(rows.where(F.col("blocks") <= left) if left == 1 else rows.where((F.col("blocks") <= left) & (F.col("blocks") > left // 2)))
        if left >= most:
            break
        rows = materialise(_name_pairs(rows.where(F.col("blocks") > left)), "level")
        left *= 2
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    return materialise(identity.select(*ROW_KEY, "blocks", "name").join(facts, ROW_KEY), "identities", keep=True)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates() does not keep; same columns, whatever their names. Nulls, ties and empty tables are as there."""
    keyed = with_row_key(docs)
    # keyed scans what docs scans, or its copy in the shared folder: the keys agree
    lost = exact_duplicates(keyed.drop(*ROW_KEY), id_col, text_col).where(~F.col("kept")).select(*ROW_KEY)
    return keyed.join(lost, ROW_KEY, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
