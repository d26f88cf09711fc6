"""Column functions against worked rows and plain definitions."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import arrays, fuzzy
from weftline.functions import text as X
from weftline.functions.address import with_address
from weftline.plans.fixtures import ADDRESSES, NAMES


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_names_by_every_rule(spark):
    df = spark.createDataFrame([(n,) for n, _ in NAMES], "x string").withColumn("t", X.name_tokens_v1(F.col("x")))
    got = {r.x: (" ".join(r.t), " ".join(r.c)) for r in df.select("x", "t", X.core_from_tokens(F.col("t")).alias("c")).collect()}
    assert got == {n: tuple(e.split("|")) for n, e in NAMES}
    after = one(spark, "Nexbelo DBA Psv Education Ltd", "string", lambda c: X.name_tokens_v1(c, ["dba"], []))
    assert after == ["psv", "education", "ltd"]
    assert one(spark, None, "string", X.name_tokens_v1) is None and one(spark, None, "string", X.is_non_latin) is False
    assert one(spark, "எக்ஸ் ltd", "string", X.is_non_latin) is True


def test_addresses_by_every_rule(spark):
    df = with_address(spark.createDataFrame([r[:2] for r in ADDRESSES], "country string, business_address string"))
    got = {(r.country, r.business_address): (r.state, None if r.addr_toks is None else " ".join(r.addr_toks), r.addr_str) for r in df.collect()}
    assert got == {r[:2]: r[2:] for r in ADDRESSES}
    row = with_address(spark.createDataFrame([("India", "Balaji Towers 11/239 Salem, தமிழ்நாடு"), (None, "x road")], "country string, business_address string")).orderBy("country").collect()
    assert row[0].addr_toks == ["road"] and row[1].addr_native == ["தமிழ்நாடு"]


def test_numbers(spark):
    assert one(spark, "Door No. 2/351, 0045 Main", "string", X.numbers_int) == [2, 45, 351]
    assert one(spark, "id 1234567890123", "string", X.numbers_int) == [567890123]
    assert one(spark, [257, 208, 5, 200], "array<long>", arrays.with_short_numbers) == [5, 8, 57, 200, 208, 257]
    assert one(spark, None, "string", X.numbers_int) is None
    assert one(spark, ["g1obal", "12", "c0de"], "array<string>", arrays.digits_to_letters) == ["global", "12", "code"]


def test_set_similarities(spark):
    rows = [(["a", "b"], ["b", "c"]), ([], []), (["a", "a", "b"], ["a", "b"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select(arrays.jaccard(F.col("a"), F.col("b")).alias("j"), arrays.containment(F.col("a"), F.col("b")).alias("c"))
    assert [(round(r.j, 4), r.c) for r in df.collect()] == [(0.3333, 0.5), (0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abcd ", max_size=20), st.text("abcd ", max_size=20))
def test_ratios_by_definition(a, b):
    assert fuzzy.lcs_length(a, b) == plain_lcs(a, b)
    assert fuzzy.ratio(a, b) == pytest.approx(200 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 100)
    for score in fuzzy.SCORERS.values():
        assert 0 <= score([a], [b])[0] <= 100
    for score in (fuzzy.ratio, fuzzy.token_set_ratio, fuzzy.token_sort_ratio, fuzzy.partial_ratio):
        assert score(a, b) == pytest.approx(score(b, a))
    assert fuzzy.partial_ratio(a, b) >= fuzzy.ratio(a, b) - 1e-9 or len(a) != len(b)


@given(st.lists(st.tuples(st.text("abcé ", max_size=90), st.text("abcé ", max_size=90)), max_size=8))
def test_batches_are_scored_like_single_pairs(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    single = {"ratio": fuzzy.ratio, "partial": fuzzy.partial_ratio, "token_set": fuzzy.token_set_ratio, "token_sort": fuzzy.token_sort_ratio, "jaro_winkler": fuzzy.jaro_winkler}
    for kind, score in fuzzy.SCORERS.items():
        assert list(score(a, b)) == pytest.approx([single[kind](x, y) for x, y in pairs])


def test_ratios_by_example(spark):
    assert fuzzy.ratio("abcd", "abxd") == 75 and fuzzy.ratio("", "") == 100 and fuzzy.ratio("a", "") == 0
    assert fuzzy.jaro_winkler("abc", "abd") == pytest.approx(0.822222, abs=1e-6) and fuzzy.jaro_winkler("", "") == 1
    assert fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100 and fuzzy.token_set_ratio("a", "") == 0
    assert fuzzy.token_sort_ratio("b a", "a b") == 100 and fuzzy.partial_ratio("test", "this is a test!") == 100
    random.seed(1)
    pairs = [(" ".join(random.choices(["red", "blue", "bolt", ""], k=3)), None if i % 7 == 0 else "red bolt") for i in range(40)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.scored([("r", "ratio", F.col("a"), F.col("b")), ("s", "token_set", F.col("a"), F.col("b"))]).alias("s"))
    assert all(r.s.r == fuzzy.ratio(r.a, r.b or "") and r.s.s == fuzzy.token_set_ratio(r.a, r.b or "") for r in df.collect())
