"""Nearest neighbours by TF-IDF cosine over letter trigrams of words: a join of the rare grams' postings and exact cosines, or products of matrices where most texts share such grams."""

from __future__ import annotations

from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.config import DEFAULT
from weftline.operators.blocking import counted
from weftline.sources.io import cut, looked_up

#: What a group of texts that can meet has in common.
GROUP = ["country", "under"]
#: Meetings of prefixes a pair of texts from which a group is multiplied; texts of a tile that are asked for and that are held (a text goes to each tile of the other side); grams that are multiplied at once.
CROWD, TILE, WIDE, COLUMNS = 0.25, 4096, 65536, 2048
#: Texts of both sides that are multiplied at once within a tile.
BLOCK = (1024, 4096)


def grams(records: DataFrame, text: str, n: int = 3) -> DataFrame:
    """country, id, gram, tf: letter n-grams of words padded with a space on each side; n_copies stays, if records have it. Records move, their grams do not."""
    of = ["country", "id", *[c for c in ("n_copies",) if c in records.columns]]
    padded = F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    cut = F.flatten(F.transform(padded, lambda w: F.when(F.length(w) <= n, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n))))))
    return records.repartition("country", "id").select(*of, F.explode(cut).alias("gram")).groupBy(*of, "gram").agg(F.count(F.lit(1)).alias("tf"))


def dictionary(records: DataFrame, text: str, n: int = 3) -> DataFrame:
    """country, gram, df, size: of a country's records, how many have a gram, and how many there are. A record with n_copies counts as so many."""
    df = grams(records, text, n).groupBy("country", "gram").agg(counted(records).alias("df"))
    return df.join(records.groupBy("country").agg(counted(records).alias("size")), "country")


def weighted(records: DataFrame, text: str, n: int = 3, known: DataFrame | None = None) -> DataFrame:
    """country, id, gram, df, w: (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), each record of length 1; N and df by country. known: the dictionary(), if it is not that of these records."""
    known = looked_up(dictionary(records, text, n)) if known is None else known
    idf = F.log((1 + F.col("size")) / (1 + F.col("df"))) + 1
    raw = grams(records, text, n).join(known, ["country", "gram"]).select("country", "id", "gram", "df", ((1 + F.log("tf")) * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("country", "id")))
    return raw.select("country", "id", "gram", "df", (F.col("w") / norm).alias("w"))


def rare_prefix(vectors: DataFrame, least: float) -> DataFrame:
    """The rarest grams of each vector, without the most frequent ones that together can't give a cosine of `least` with any vector of the country.

    What they can give is bounded by their length, and by their weights times the largest weight that any vector has there; the smaller bound counts. Two vectors that
    reach `least` share a gram of both prefixes: the rarest that they share. Frequent grams, whose postings are long, drop out.
    """
    largest = looked_up(vectors.groupBy("country", "gram").agg(F.max("w").alias("_most")))
    upto = W.partitionBy("country", "id").orderBy(F.desc("df"), "gram").rowsBetween(W.unboundedPreceding, W.currentRow)
    bounded = vectors.join(largest, ["country", "gram"]).withColumn("_upto", F.least(F.sqrt(F.sum(F.col("w") * F.col("w")).over(upto)), F.sum(F.col("w") * F.col("_most")).over(upto)))
    return bounded.where(F.col("_upto") >= least - 1e-6).drop("_upto", "_most")


def _dot(a: str, b: str) -> Column:
    """The inner product of two vectors given as maps from gram to weight: only what they share is looked up."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(shared, F.lit(0.0), lambda total, g: total + F.element_at(F.col(a), g) * F.element_at(F.col(b), g))


def _matched(left: DataFrame, right: DataFrame, whole: DataFrame, least: float, digits: int) -> DataFrame:
    """GROUP, a, b, tf_cos of pairs that share a gram of both prefixes (left: GROUP, gram, a; right: GROUP, gram, b)."""
    met = left.join(right, [*GROUP, "gram"]).select(*GROUP, "a", "b").distinct()
    both = met.join(whole.select("country", F.col("id").alias("a"), F.col("v").alias("va")), ["country", "a"]).join(whole.select("country", F.col("id").alias("b"), F.col("v").alias("vb")), ["country", "b"])
    return both.select(*GROUP, "a", "b", F.round(_dot("va", "vb"), digits).alias("tf_cos")).where(F.col("tf_cos") >= least)


def _vectors(side: pa.Table, known: dict[str, float] | None, n: int) -> tuple[np.ndarray, list[str] | pa.Array, np.ndarray]:
    """Rows, grams and weights of a side's vectors: v holds them, or texts of which they are made by the idf of the known grams, as grams() and weighted() do."""
    v = side.column("v").combine_chunks()
    if known is None:
        return np.repeat(np.arange(len(v)), pc.list_value_length(pc.fill_null(v, [])).to_numpy(zero_copy_only=False)), v.flatten().field("gram"), v.flatten().field("w").to_numpy(zero_copy_only=False)
    words: dict[str, list[str]] = {}
    sizes, found, weights = np.zeros(len(v), np.int64), [], []
    for i, text in enumerate(v.to_pylist()):
        tf: Counter[str] = Counter()
        for word in filter(None, text.split(" ")):
            if (of := words.get(word)) is None:
                of = words[word] = [f" {word} "[j : j + n] for j in range(max(len(word) + 3 - n, 1))]
            tf.update(of)
        w = [(1 + log(k)) * known[g] for g, k in tf.items()]
        norm = sum(x * x for x in w) ** 0.5
        sizes[i] = len(w)
        found.extend(tf)
        weights.extend(x / norm for x in w)
    return np.repeat(np.arange(len(v)), sizes), pa.array(found, pa.string()), np.array(weights, np.float64)


def _nearest_rows(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]], n_a: int, n_b: int, columns: int, top: int, least: float, digits: int) -> tuple[np.ndarray, ...]:
    """Row, column and rounded cosine of each row's `top` columns, the smaller column of ties. a, b: rows, grams' numbers and weights in order of rows."""
    starts = [np.searchsorted(x[0], np.arange(n + 1)) for x, n in ((a, n_a), (b, n_b))]

    def dense(side: int, at: int, to: int, start: int, stop: int) -> np.ndarray:
        row, gram, w = (x[starts[side][at] : starts[side][to]] for x in (a, b)[side])
        some = (gram >= start) & (gram < stop)
        out = np.zeros((to - at, stop - start))
        out[row[some] - at, gram[some] - start] = w[some]
        return out

    spans, slack = [(s, min(s + COLUMNS, columns)) for s in range(0, columns, COLUMNS)], 10.0**-digits
    blocks = [(at, min(at + BLOCK[0], n_a)) for at in range(0, n_a, BLOCK[0])]
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(blocks)
    bars = [np.full(to - at, -np.inf) for at, to in blocks]  # the score of the last of `top`, where there are so many
    for b_at in range(0, n_b, BLOCK[1]):
        b_to = min(b_at + BLOCK[1], n_b)
        held = [dense(1, b_at, b_to, *s) for s in spans] if len(spans) == 1 else None
        for k, (at, to) in enumerate(blocks):
            cosines = np.zeros((to - at, b_to - b_at))
            for i, s in enumerate(spans):
                cosines += dense(0, at, to, *s) @ (held[i] if held else dense(1, b_at, b_to, *s)).T
            bar = np.maximum(bars[k], least)
            some = np.flatnonzero(np.isinf(bars[k]))
            if len(some) and b_to - b_at > top:
                bar[some] = np.maximum(bar[some], np.partition(cosines[some], b_to - b_at - top, axis=1)[:, b_to - b_at - top])
            row, column = np.nonzero(cosines >= (bar - slack)[:, None])
            score = np.round(cosines[row, column], digits)
            keep = (score >= least) & (score > bars[k][row])  # later columns lose ties
            row, column, score = (np.concatenate([x, y[keep]]) for x, y in zip(best[k], (row, column + b_at, score), strict=True))
            order = np.lexsort((column, -score, row))
            row, column, score = row[order], column[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            last = place == top - 1
            bars[k][row[last]] = score[last]
            best[k] = row[place < top], column[place < top], score[place < top]
    return tuple(np.concatenate(x) for x in zip(*[(row + at, column, score) for (at, _), (row, column, score) in zip(blocks, best, strict=True)], strict=True))


def _tile(a: pa.Table, b: pa.Table, schema: pa.Schema, top: int, least: float, digits: int, n: int) -> pa.Table:
    """Of each text of a the `top` texts of b by cosine, ties to the smaller `first`: products of the tile's matrices, over the grams that both sides have. Rows of b without an id are the dictionary."""
    known = None
    if "idf" in b.column_names:
        words = b.filter(pc.is_null(b.column("id")))
        known, b = dict(zip(words.column("v").to_pylist(), words.column("idf").to_pylist(), strict=True)), b.filter(pc.is_valid(b.column("id")))
    if not a.num_rows or not b.num_rows:
        return schema.empty_table()
    b = b.sort_by([("first", "ascending")])
    sides = [_vectors(side, known, n) for side in (a, b)]
    shared = pc.unique(sides[0][1])
    shared = shared.filter(pc.is_in(shared, pc.unique(sides[1][1])))
    coded = []
    for row, gram, w in sides:
        number = pc.fill_null(pc.index_in(gram, shared), -1).to_numpy(zero_copy_only=False)
        coded.append((row[number >= 0], number[number >= 0], w[number >= 0]))
    row, column, score = _nearest_rows(*coded, a.num_rows, b.num_rows, len(shared), top, least, digits)
    values = {"a": a.column("id").take(row), "b": b.column("id").take(column), "tf_cos": pa.array(score, pa.float64())}
    return pa.table([values[c] if c in values else a.column(c).take(row) if c in a.column_names else b.column(c).take(column) for c in schema.names], schema=schema)


def _multiplied(asked: DataFrame, held: DataFrame, whole: DataFrame | None, top: int, least: float, digits: int, tile: int = TILE, wide: int = WIDE, known: DataFrame | None = None, n: int = 3) -> DataFrame:
    """For each a of a group its `top` best b at least, from products of tiles of both sides: all columns of asked (GROUP, a) and held (GROUP, b, first), and tf_cos. Each pair of a group meets in one tile.

    Vectors v are looked up in whole. With known, the dictionary() of the texts' countries, both sides have texts as v: tiles make the vectors of these, which are many times as long.
    """
    dealt = []
    sizes = asked.groupBy(*GROUP).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("n_t")).join(held.groupBy(*GROUP).agg(F.ceil(F.count(F.lit(1)) / wide).cast("int").alias("n_u")), GROUP)
    for side, own, other, n_own, n_other in ((asked, "t", "u", "n_t", "n_u"), (held, "u", "t", "n_u", "n_t")):
        more = [c for c in side.columns if c not in (*GROUP, "a", "b", "v")]
        x = side.withColumnRenamed("a" if side is asked else "b", "id").join(sizes, GROUP).withColumn(own, F.pmod(F.xxhash64("id"), F.col(n_own)).cast("int"))
        if known is None:
            x = x.join(whole.select("country", "id", F.transform(F.map_entries("v"), lambda e: F.struct(e["key"].alias("gram"), e["value"].alias("w"))).alias("v")), ["country", "id"])
        x = x.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
        x = x.select(*[F.col(c).alias(c) for c in (*GROUP, "t", "u", "id", "v", *more)])  # aliases: both sides come from the same frames
        if known is not None and side is held:
            idf = F.log((1 + F.col("size")) / (1 + F.col("df"))) + 1
            words = sizes.join(known.select("country", F.col("gram").alias("v"), idf.alias("idf")), "country")
            words = words.select("*", F.explode(F.sequence(F.lit(0), F.col("n_t") - 1)).alias("t")).select("*", F.explode(F.sequence(F.lit(0), F.col("n_u") - 1)).alias("u"))
            x = x.unionByName(words.drop("n_t", "n_u"), allowMissingColumns=True)
        dealt.append(x.groupBy(*GROUP, "t", "u"))
    kinds = {c: kind for side in (held, asked) for c, kind in side.dtypes if c not in (*GROUP, "a", "b", "v")}
    fields = {"country": "string", "under": "string", "a": "long", "b": "long", "tf_cos": "double"} | kinds
    arrow = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c, arrow[kind]) for c, kind in fields.items()])
    return dealt[0].cogroup(dealt[1]).applyInArrow(lambda a, b: _tile(a, b, schema, top, least, digits, n), ", ".join(f"{c} {kind}" for c, kind in fields.items()))


def nearest(records: DataFrame, text: str = "doc", top: int = DEFAULT.tfidf_top, least: float = DEFAULT.tfidf_cosine, n: int = 3, digits: int = 9, copies: DataFrame | None = None, crowd: float = CROWD) -> DataFrame:
    """country, s1, c, tf_cos, tf_rank: for each S1 record its top candidates of the same country and state with a cosine of at least `least`.

    Candidates without a state stand in every state; S1 records without a state meet those only. Equal texts share one vector: the join runs over distinct
    (country, state, text) and its results go to the records afterwards, so repeated texts never multiply. Cosines are rounded before ranking; ties go to the smaller id.
    Groups (country, state) in which prefixes meet more than `crowd` times a pair of texts are multiplied as matrices, tile by tile, others joined by gram: both are whole and give the same.
    Texts are moved, not their postings, which are made where they are read; a text goes by the smallest id of its records.
    copies: records stand for n_copies records each; copies (id, rep) has all of them, rep the smallest of its copies.
    """
    named = records.where(F.col("country").isNotNull() & F.col(text).isNotNull()).select("country", "id", (F.col("src") == 1).alias("asks"), F.coalesce("state", F.lit("")).alias("state"), F.col(text).alias("text"), *[c for c in ("n_copies",) if c in records.columns])
    units = cut(named.withColumn("of", F.min("id").over(W.partitionBy("country", "text"))))
    each = units.groupBy("of", "country", "text", "state", "asks").agg(F.min("id").alias("first"), counted(units).alias("k"))
    states = F.array_sort(F.collect_set(F.when(F.col("asks"), F.col("state"))))
    held_ = F.collect_list(F.when(~F.col("asks"), F.struct(F.col("state").alias("under"), "first", F.least("k", F.lit(top)).cast("long").alias("n"))))
    texts = cut(each.groupBy("of", "country", "text").agg(F.sum("k").alias("n_copies"), states.alias("states"), held_.alias("held")))
    as_records = lambda t: t.select("country", F.col("of").alias("id"), "text", "n_copies")
    known = looked_up(dictionary(as_records(texts), "text", n))
    # the state is part of the key: candidates stand under their own or under none, and are asked for under the S1's own and under none; wants: the states of S1s that ask
    asked = texts.where(F.size("states") > 0).select("country", F.col("of").alias("a"), F.col("text").alias("v"), "states", F.explode(F.array_distinct(F.concat("states", F.array(F.lit(""))))).alias("under"))
    asked = asked.select(*GROUP, "a", "v", F.when(F.col("under") == "", F.col("states")).otherwise(F.array("under")).alias("wants"))
    held = texts.select("country", F.col("of").alias("b"), F.col("text").alias("v"), F.explode("held").alias("h")).select("country", "h.under", "b", "v", "h.first", "h.n")
    # how often prefixes meet, by group
    sides = asked.select("country", "under", F.col("a").alias("id"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(held.select("country", "under", F.col("b").alias("id"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    sides = sides.groupBy("country", "id").agg(F.collect_list(F.struct("under", "x", "y")).alias("sides"))
    prefix = rare_prefix(weighted(as_records(texts), "text", n, known), least).select("country", "id", "gram").join(sides, ["country", "id"]).select("country", "gram", F.inline("sides"))
    total = lambda c: F.sum(F.col(c).cast("double")).alias(c)
    meets = prefix.groupBy(*GROUP, "gram").agg(total("x"), total("y")).groupBy(*GROUP).agg(F.sum(F.col("x") * F.col("y")).alias("meets")).where("meets > 0")
    pairs = asked.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("x")).join(held.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("y")), GROUP)
    groups = cut(meets.join(pairs, GROUP).select(*GROUP, (F.col("meets") > crowd * F.col("x").cast("double") * F.col("y")).alias("crowded")))
    crowded, thin = groups.where("crowded").drop("crowded"), groups.where("not crowded").drop("crowded")
    found = []
    if not thin.isEmpty():
        left, right = (side.join(thin, GROUP, "left_semi") for side in (asked, held))
        some = texts.join(left.select(F.col("a").alias("of")).union(right.select("b")).distinct(), "of", "left_semi")
        postings = cut(weighted(as_records(some), "text", n, known))
        whole = postings.groupBy("country", "id").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("v"))  # as long as the text
        rare = cut(rare_prefix(postings, least).select("country", "gram", "id"))
        close = _matched(left.select(*GROUP, "a").join(rare.withColumnRenamed("id", "a"), ["country", "a"]), right.select(*GROUP, "b").join(rare.withColumnRenamed("id", "b"), ["country", "b"]), whole, least, digits)
        found.append(close.join(left.drop("v"), [*GROUP, "a"]).join(right.drop("v"), [*GROUP, "b"]).select("under", "a", "b", "tf_cos", "first", "n", "wants"))
    if not crowded.isEmpty() or not found:
        near = _multiplied(asked.join(crowded, GROUP, "left_semi"), held.join(crowded, GROUP, "left_semi"), None, top, least, digits, known=known, n=n)
        found.append(near.select("under", "a", "b", "tf_cos", "first", "n", "wants"))
    # S1s of one text and state have one list: it is made once, from texts' candidates in the order of their smallest ids
    best = (found[0] if len(found) == 1 else found[0].unionByName(found[1])).select("a", F.explode("wants").alias("s1_state"), "under", "b", "tf_cos", "first", "n")
    # of each text and state no more than `top` records can be wanted, those with the smallest ids, and none once `top` are closer
    ids = lambda of: of if copies is None else of.join(copies.select(F.col("rep").alias("id"), F.col("id").alias("_id")), "id").withColumn("id", F.col("_id")).drop("_id")
    c = ids(units.where("not asks").select("of", "state", "id")).withColumn("_n", F.row_number().over(W.partitionBy("of", "state").orderBy("id"))).where(F.col("_n") <= top)
    c = c.groupBy(F.col("of").alias("b"), F.col("state").alias("under")).agg(F.collect_list("id").alias("ids"))
    group = W.partitionBy("a", "s1_state")
    closer = F.sum("n").over(group.orderBy(F.desc("tf_cos")).rangeBetween(W.unboundedPreceding, W.currentRow)) - F.sum("n").over(W.partitionBy("a", "s1_state", "tf_cos"))
    best = best.withColumns({"_place": F.row_number().over(group.orderBy(F.desc("tf_cos"), "first")), "_closer": closer}).where((F.col("_place") <= top) & (F.col("_closer") < top))
    # lists of ids move; they become rows where an S1 text's candidates are together
    near = best.select("a", "s1_state", "under", "b", "tf_cos").join(c, ["b", "under"]).select("a", "s1_state", "tf_cos", "ids").repartition("a", "s1_state").select("a", "s1_state", "tf_cos", F.explode("ids").alias("c"))
    listed = near.withColumn("tf_rank", F.row_number().over(group.orderBy(F.desc("tf_cos"), "c"))).where(F.col("tf_rank") <= top)
    s1 = ids(units.where("asks").select("country", F.col("of").alias("a"), F.col("state").alias("s1_state"), "id")).withColumnRenamed("id", "s1")
    return s1.join(listed, ["a", "s1_state"]).select("country", "s1", "c", "tf_cos", "tf_rank")
