"""Blocking, features, decisions, evaluation, files and streams on worked examples, and laws that must hold on tables."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.config import DEFAULT, Pass
from weftline.operators import blocking, decide, features, learn, metrics, ml, nearest, profile, records, tfidf, validate
from weftline.sources import io, tables


@pytest.fixture(scope="module")
def recs(spark, sf):
    return records.prepare(records.finalize(records.build_base(tables.part_records(spark, sf)))).cache()


@pytest.fixture(scope="module")
def truth(spark, sf):
    return tables.part_truth(spark, sf).cache()


def pairs(df):
    return sorted((r.s1, r.c) for r in df.collect())


def test_ids_and_folds(spark):
    df = spark.createDataFrame([("S2-403571744",), ("S1-906445972",), ("S1-840286800",), ("junk",)], "e string")
    got = df.select(tables.id_code(F.col("e")).alias("i"), tables.fold_of(F.col("e")).alias("f")).withColumn("s", tables.source_of(F.col("i"))).withColumn("h", tables.half_of(F.col("i"))).collect()
    assert [(r.i, r.f, r.s) for r in got[:3]] == [(20403571744, 4, 2), (10906445972, 2, 1), (10840286800, 0, 1)] and got[3].i is None and got[2].h == 0


def test_caps_count_candidates_only(spark):
    keys = spark.createDataFrame([("x", 1, "K1", 1), ("x", 2, "K2", 1), ("x", 10, "K1", 2), ("x", 11, "K1", 3), ("x", 12, "K2", 2)], "country string, id long, key string, src int")
    assert pairs(blocking.block_pairs(keys, 1)) == [(2, 12)] and blocking.oversized(keys, 1).count() == 1
    assert pairs(blocking.block_pairs(keys, 2)) == [(1, 10), (1, 11), (2, 12)] and blocking.oversized(keys, 2).count() == 0


def test_token_pairs(spark):
    words = [["aaa", "bbb", "ccc"]] * 2 + [["zzz"]] * 2 + [["aaa"]]
    df = spark.createDataFrame([("x", i, w) for i, w in enumerate(words)], "country string, id long, core_f array<string>")
    got = {}
    for r in blocking.block_keys(df, "name_pair").collect():
        got.setdefault(r.id, set()).add(r.key)
    assert got[0] == {"aaa|bbb", "aaa|ccc", "bbb|ccc"} and got[2] == {"zzz"} and got[4] == {"aaa"}


def test_masks_and_merge(spark, recs):
    found = blocking.candidates(recs).cache()
    assert found.where("mask < 1 or mask > 31").count() == 0 and found.count() == found.select("s1", "c").distinct().count()
    only = blocking.candidates(recs, [Pass("name_exact", 1, 300)])
    assert only.join(found, ["s1", "c"], "left_anti").count() == 0
    near = spark.createDataFrame([("X", 1, 2, 0.5, 1)], "country string, s1 long, c long, tf_cos double, tf_rank int")
    both = blocking.merged(found, near)
    assert both.count() == found.count() + 1 and both.where("mask = 32").count() == 1


def test_nearest_by_state(spark):
    rows = [("x", 1, 1, "a", "red ring"), ("x", 2, 1, None, "red ring"), ("x", 10, 2, "a", "red ring"), ("x", 11, 3, None, "red rings"), ("x", 12, 2, "b", "red ring"), ("x", 13, 2, "a", "green cog")]
    df = spark.createDataFrame(rows, "country string, id long, src int, state string, doc string")
    got = {(r.s1, r.c): r.tf_cos for r in tfidf.nearest(df).collect()}
    assert set(got) == {(1, 10), (1, 11), (2, 11)} and got[1, 10] == pytest.approx(1.0)
    assert {(r.s1, r.c) for r in tfidf.nearest(df, top=1).collect()} == {(1, 10), (2, 11)}


def test_decisions(spark):
    pred = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.6), (1, 12, 0.2), (2, 10, 0.8), (2, 13, 0.75)], "s1 long, c long, p double")
    assert pairs(decide.decide(pred, 0.5)) == [(1, 10), (1, 11), (2, 13)] and pairs(decide.decide(pred, 0.5, 0.8)) == [(1, 10), (2, 13)]
    assert pairs(decide.decide_expected(pred)) == [(1, 10), (2, 13)]
    assert pairs(decide.exclusive(pred)) == [(1, 11), (1, 12), (2, 13)]
    base, true = spark.createDataFrame([(1, "x"), (2, "x")], "s1 long, country string"), spark.createDataFrame([(1, 10), (1, 11), (2, 13)], "s1 long, c long")
    grid = {(r.thr, r.rel): r.f_macro for r in decide.tune(pred, true, base).collect()}
    for (t, rel), f in grid.items():
        assert f == pytest.approx(metrics.summarize(metrics.per_entity(decide.decide(pred, t, rel), true, base)).first().f_macro)
    rule = decide.best_rule(pred, true, base)
    assert rule[0] == "threshold" and pairs(decide.apply_rule(pred, rule)) == pairs(true)
    assert len(decide.tune_expected(pred, true, base).collect()) == len(DEFAULT.alphas) * len(DEFAULT.floors)


@pytest.mark.parametrize("k", [1, 3])
def test_best_by_numbers(spark, k):
    """As of all pairs: of records of no, few and many numbers, with ties, and with scores that a record doesn't take."""
    draw = random.Random(k)
    rows = [(draw.choice("ab"), i, sorted(draw.sample(range(9), draw.choice([0, 1, 1, 2, 2, 3, 5, 6, 8]))), draw.choice([0.0, 0.25, 0.5])) for i in range(160)]
    df = spark.createDataFrame(rows, "g string, o long, num array<long>, least double")
    want = set()
    for g, w, num, _ in rows[:60]:
        score = lambda other: len(set(num) & set(other)) * 4 // max(1, len(set(num) | set(other))) / 4  # noqa: B023, E731
        found = sorted((-score(other), o) for h, o, other, least in rows[60:] if h == g and score(other) >= least)
        want |= {(w, o, -p) for p, o in found[:k]}
    wanted = df.where("o < 60").select("g", F.col("o").alias("w"), "num")
    got = nearest.best(wanted, df.where("o >= 60"), ["g"], lambda j: F.floor(j * 4) / 4, k)
    assert {(r.w, r.o, r.p) for r in got.collect()} == want


def test_scorer(spark):
    base = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y")], "s1 long, country string")
    true = spark.createDataFrame([(1, 47), (1, 812), (2, 4)], "s1 long, c long")
    pred = spark.createDataFrame([(1, 47), (1, 193), (1, 812), (4, 9), (99, 1)], "s1 long, c long")
    got = {r.s1: r.f for r in metrics.per_entity(pred, true, base).collect()}
    assert got == pytest.approx({1: 0.7142857, 2: 0, 3: 1, 4: 0}, abs=1e-6)
    rows = {r.country: r for r in metrics.summarize(metrics.per_entity(pred, true, base), "country").collect()}
    assert set(rows) == {"ALL", "x", "y"} and rows["ALL"].f_macro == pytest.approx(0.4285714, abs=1e-6)
    assert metrics.summarize(metrics.per_entity(true, true, base)).first().f_macro == 1


def test_validator_rules(spark):
    rows = [("S1-1", "S2-5,S2-5"), ("S1-1", "S3-1"), ("S1-2", "S1-9, X-1"), ("S1-7", "S2-99")]
    lists = spark.createDataFrame(rows, "source1_entity_id string, matched_entity_ids string")
    need = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "source1_entity_id string")
    known = spark.createDataFrame([("S2-5",), ("S3-1",)], "entity_id string")
    got = {r.rule: r.n for r in validate.check_lists(lists, need, known).collect()}
    assert got == {"duplicate_rows": 1, "repeated_ids": 1, "self_match": 1, "bad_prefix": 1, "missing_rows": 1, "surplus_rows": 1, "unknown_ids": 3}
    assert not validate.passes(validate.check_lists(lists, need, known))
    assert validate.check_header("a,b", "matches")[0][1] == "fatal" and validate.check_header("source1_entity_id\tmatched_entity_ids\n", "matches") == []
    some = lists.withColumnRenamed("matched_entity_ids", "candidate_entity_ids").limit(0)
    assert validate.check_subset(lists.limit(1), some).first().severity == "warning"


def test_features(spark, recs, truth):
    found = blocking.candidates(recs).select("s1", "c", "mask")
    rated = features.cheap(features.sides(found, recs, ["k1", "name_str", "addr_str"]))
    best = features.best_candidates(rated, 2)
    assert best.groupBy("s1").count().where("count > 2").count() == 0 and rated.where("q < 0 or q > 2").count() == 0
    x = features.full_features(features.competition(best), recs).cache()
    assert x.columns == ["s1", "c", *features.FEATURES] and len(features.FEATURES) == 45 and x.where(" or ".join(f"{c} is null" for c in features.FEATURES)).count() == 0
    flagged = rated.withColumn("mask", F.when(F.col("q") < 1, 32).otherwise(1))
    kept = features.best_candidates(flagged, 1)
    assert kept.where("mask = 32").count() == flagged.where("mask = 32").count() and kept.count() == kept.select("s1", "c").distinct().count()


def test_models(spark, recs, truth):
    p = blocking.candidates(recs).select("s1", "c", "mask")
    x = ml.labelled(features.set_features(features.sides(p, recs)), truth).select("s1", "c", "y", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("core_j", "num_inter", "num_conflict")])
    model = ml.fit_matcher(x, ["core_j", "num_inter", "num_conflict"], rounds=5, depth=3)
    scored = ml.predict(model, x, 0.0)
    auc = metrics.auc_by(scored.join(x.select("s1", "c", "y"), ["s1", "c"]), "p", "y").first().auc
    assert auc > 0.9 and abs(sum(v for _, v in ml.importances(model)) - 1) < 1e-6
    assert ml.hash_sample(x, "s1", 0.5).count() == ml.hash_sample(x, "s1", 0.5).count() < x.count()
    labels = ml.pseudo_labels(spark.createDataFrame([(1, 1, 0.99), (1, 2, 0.5), (1, 3, 0.01), (1, 4, None)], "s1 long, c long, p double"))
    assert sorted((r.c, r.y) for r in labels.collect()) == [(1, 1.0), (3, 0.0), (4, 0.0)]


def test_auc_and_errors(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.9, 1), ("a", 0.9, 0), ("b", 0.5, 1), ("c", None, 1), ("c", 0.1, 0)], "g string, s double, y int")
    assert {r.g: r.auc for r in metrics.auc_by(df, "s", "y", ["g"]).collect()} == {"a": 0.75, "b": None, "c": 0.0}


def test_learning(spark):
    t = spark.createDataFrame([(1, "X", "wi", [], 1), (2, "X", "wi", [], 1), (10, "X", None, ["न"], 2), (11, "X", None, ["न", "क"], 2), (12, "X", None, ["न"], 2)], "id long, country string, state string, addr_native array<string>, src int")
    states = learn.learn_native_states(t, spark.createDataFrame([(1, 10), (2, 11)], "s1 long, c long"), least=2)
    assert [(r.token, r.state, r.support) for r in states.collect()] == [("न", "wi", 2)]
    assert {r.id: r.state for r in learn.apply_native_states(t, states).collect()}[12] == "wi"
    sides = learn.marker_sides(spark.createDataFrame([("b", "a dba b"), ("b", "a dba b"), ("x", "x aka y")], "s1_name string, name string"), ["dba", "aka"])
    assert learn.split_markers(sides) == (["dba"], ["aka"])


def test_files(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tJoe "s\t\tUS\nS2-2\té\t1 "x" st\tUS\n')
    df = io.read_tsv(spark, str(path))
    assert [tuple(r) for r in df.orderBy("entity_id").collect()] == [("S1-1", 'Joe "s', None, "US"), ("S2-2", "é", '1 "x" st', "US")]
    assert not io.line_check(spark, str(path)).first().mismatch
    io.write_tsv(spark.createDataFrame([("S1-1", ""), ("S1-2", 'a"b')], io.TRUTH), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "S1-1\t\n" in text and 'S1-2\ta"b\n' in text
    io.write_stage(df, str(tmp_path / "w" / "stage"), ["country"])
    assert io.find_stage(spark, "stage", [str(tmp_path / "no"), str(tmp_path / "w")]).endswith("stage") and io.find_stage(spark, "none", [str(tmp_path)]) is None
    assert io.read_stage(spark, str(tmp_path / "w" / "stage"), ["entity_id"], "country = 'US'").count() == 2
    assert io.first_of_each(["/a/x", "/b/y", "/c/x"]) == ["/a/x", "/b/y"] and '"é"' in io.report_json(df.where("entity_id = 'S2-2'").select("business_name"))


def test_plans_push_down_and_limit_ranks(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/part.parquet").write.parquet(str(tmp_path / "p"))
    plan = io.read_stage(spark, str(tmp_path / "p"), ["p_name"], "p_type = 'SMALL'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_type), EqualTo(p_type,SMALL)]" in plan and "ReadSchema: struct<p_name:string,p_type:string>" in plan
    q = spark.createDataFrame([(1, 2, 1, 0.5)], "s1 long, c long, mask int, q double")
    assert "WindowGroupLimit" in features.best_candidates(q, 3)._jdf.queryExecution().toString()


def test_profiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(11)] + [("b", 5.0), ("b", None)], "g string, v double")
    assert {r.g: r.q for r in profile.quantiles_by(df, "v", ["g"], {"q": 0.9}).collect()} == {"a": 9.0, "b": 5.0}
    assert df.where("v is not null").groupBy("g").agg(profile.nearest_quantile(F.col("v"), 0.9).alias("q")).where("g = 'a'").first().q == 9.0
    rho = profile.spearman_by(spark.createDataFrame([("x", i, i * i) for i in range(5)], "g string, a long, b long"), "a", "b", ["g"]).first().rho
    assert rho == pytest.approx(1.0)
    shuffled = profile.random_pairs(spark.createDataFrame([(i, 100 + i) for i in range(50)], "s1 long, c long"))
    assert shuffled.count() == 50 and shuffled.select("c").distinct().count() == 50
    assert profile.top_values(df, "g", 1).first().n == 11
    assert profile.summary_table(spark.createDataFrame([("x", 1, 2)], "k string, a long, b long"), "k").count() == 2


def test_link_stream(spark, recs, tmp_path):
    from weftline.streaming.incremental import link_stream

    first = recs.where("src = 1")
    raw = spark.createDataFrame([("S2-900000", "small ring", "11 Brand#2", "ECONOMY"), ("S3-900001", "nothing like it", None, "ECONOMY")], io.RAW)
    raw.write.parquet(str(tmp_path / "in"))
    out = []
    stream = spark.readStream.schema(io.RAW).parquet(str(tmp_path / "in"))
    link_stream(stream, first, lambda df, n: out.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert out and {r.c for r in out} == {20000900000}


def test_set_features_of_missing_addresses(spark):
    from weftline.operators.features import FEATURES, set_features

    side = "k1 string, name_str string, name_core array<string>, addr_toks array<string>, addr_str string, addr_null boolean, num array<bigint>, state string, nonlatin boolean, src int"
    schema = "s1 long, c long, mask int, " + ", ".join(f"{t}_{c}" for t in "ab" for c in side.split(", "))
    none, some = ("acme", "acme", ["acme"], None, None, True, None, None, False, 1), ("acme", "acme", ["acme"], ["1", "road"], "1 road", False, [1], "ca", False, 2)
    rows = spark.createDataFrame([(1, 2, 3, *none, *some), (1, 3, 0, *none, *none), (1, 4, 32, *some, *some)], schema)
    made = {r.c: r for r in set_features(rows).collect()}
    for c, overlap in ((2, 0.0), (3, 0.0), (4, 1.0)):
        r = made[c]
        assert (r.addr_j, r.addr_cont, r.num_inter, r.num_trunc, r.num_conflict) == (overlap, overlap, int(overlap), bool(overlap), False)
        assert r.core_j == 1 and all(r[f] is not None for f in FEATURES if f in r.asDict())
    assert (made[2].a_addr_n, made[2].b_addr_n, made[2].a_num_n, made[2].state_rel, made[4].state_rel, made[4].m5) == (0, 2, 0, -1, 1, True)


def test_splits_shards_copies_and_unions(spark, tmp_path):
    from weftline.sources import io

    row = "entity_id string, business_name string, business_address string, country string"
    for n in (1, 2, 3):
        io.write_stage(spark.createDataFrame([(f"S{n}-1", "a", None, "x"), (f"S{n}-2", "b", "1 road", "x")], row), f"file://{tmp_path}/train_source{n}")
    records, truth = io.load_split(spark, f"file://{tmp_path}", "train", ["entity_id", "country"])
    assert sorted((r.entity_id, r.src) for r in records.collect()) == [(f"S{n}-{k}", n) for n in (1, 2, 3) for k in (1, 2)] and truth.isEmpty()
    assert [p.rpartition("/")[2] for p in io.shards(spark, f"file://{tmp_path}/train_source*")] == ["train_source1", "train_source2", "train_source3"] and io.shards(spark, f"file://{tmp_path}/none*") == []
    io.copy_file(spark, f"file://{tmp_path}/train_source1", f"file://{tmp_path}/copy")
    assert spark.read.parquet(f"file://{tmp_path}/copy").count() == 2
    io.write_stage(spark.createDataFrame([("S1-1", "a", None, "x")], row), f"file://{tmp_path}/train_source3")
    with pytest.raises(ValueError, match="S1-1"):
        io.load_split(spark, f"file://{tmp_path}", "train")
    with pytest.raises(FileNotFoundError):
        io.load_split(spark, f"file://{tmp_path}", "test")
    both = io.union_all([spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2.5, 3)], "c double, a int")])
    assert sorted(map(tuple, both.collect()), key=str) == [(1, "x", None), (3, None, 2.5)]


def test_row_index_of_sorted_rows_with_ties(spark):
    from weftline.sources.io import with_row_index

    rows = with_row_index(spark.range(1000).selectExpr("id % 7 as k", "id").repartition(6).orderBy("k")).collect()
    assert sorted(r.row_idx for r in rows) == list(range(1000)) and [r.k for r in sorted(rows, key=lambda r: r.row_idx)] == sorted(i % 7 for i in range(1000))


def test_samples_with_replacement(spark):
    from weftline.operators.eda import with_replacement

    df = spark.range(4000)
    a, b = ([r.id for r in with_replacement(df.repartition(n), ["id"], 2.0).collect()] for n in (2, 5))
    assert sorted(a) == sorted(b) and 7500 < len(a) < 8500 and len(set(a)) < 4000 * 0.9
    assert with_replacement(df.limit(0), ["id"], 2.0).count() == 0


def test_matchers_are_saved_stacked_and_cut(spark, tmp_path):
    from weftline.operators import ml

    rows = [(s, 100 + c, float((s * 7 + c * 3) % 10) / 10, float((s + c) % 5) / 5, float((s * 7 + c * 3) % 10 >= 6)) for s in range(60) for c in range(12)]
    scores = spark.createDataFrame(rows, "s1 long, c long, p double, ce double, y double")
    model = ml.fit_matcher(scores, ["p", "ce"], rounds=5, depth=2)
    ml.save_model(model, f"file://{tmp_path}/model")
    best = ml.best_predictions(ml.load_model(f"file://{tmp_path}/model"), scores, top=3).collect()
    assert sorted(map(tuple, best)) == sorted(map(tuple, ml.best_predictions(model, scores, top=3).collect()))
    assert all(len([r for r in best if r.s1 == s]) == 3 for s in range(60))
    y = {(s, c): t for s, c, _, _, t in rows}
    by_stack = ml.stacked(ml.fit_stacker(scores, ["ce"], rounds=5, depth=2), scores, ["ce"]).collect()
    assert len(by_stack) == len(rows) and min(r.p for r in by_stack if y[r.s1, r.c]) > max(r.p for r in by_stack if not y[r.s1, r.c])
    texts = spark.createDataFrame([(1, 2, "ab", "abc"), (1, 3, None, "x")], "s1 long, c long, a_text string, b_text string")
    assert sorted(map(tuple, ml.scored_by(texts, lambda a, b: [len(x) - len(z) for x, z in zip(a, b)], "ce", batch=1).collect())) == [(1, 2, -1.0), (1, 3, -1.0)]


def test_result_files_and_quick_checks(spark, tmp_path):
    from weftline.operators.validate import check_file, quick_checks

    good = "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S2-2\nS1-2\t\nS1-3\tS2-1\n"
    cases = {"good": (good, []), "empty": ("", ["empty_file"]), "header": (good.replace("matched", "m"), ["wrong_header"]), "comma": ("a,b\n", ["header_not_tab_separated"]), "lines": (good + "S1-4\nS1-5\n", ["line_without_tab"])}
    for name, (text, rules) in cases.items():
        (tmp_path / name).write_text(text)
        found = check_file(spark, f"file://{tmp_path}/{name}").where("n > 0").collect()
        assert [r.rule for r in found] == rules
        assert name != "lines" or (found[0].n, found[0].example) == (2, "5")
    assert check_file(spark, f"file://{tmp_path}/none").first().rule == "missing_file"
    lists = spark.createDataFrame([("S1-1", "S2-1, S2-2"), ("S1-2", None), ("S1-3", "S2-1")], "source1_entity_id string, matched_entity_ids string")
    r = quick_checks(lists).first()
    assert (r.rows, r.entities, r.empty, r.ids, r.most, r.distinct_ids, r.shared_ids) == (3, 3, 1, 3, 2, 2, 1) and r["mean"] == 1.0


def test_tfidf_meets_in_states_only(spark):
    """States are part of the key: candidates of the same state, and those without one."""
    from weftline.operators.tfidf import nearest

    names = ["alpha bakery", "alpha bakers", "beta motors", "alpha bakery shop", "beta motor"]
    rows = [(country, 10 * k + s, 1 + (k > 1), state, names[(k + s) % 5]) for country in ("x", "y") for k in range(5) for s, state in enumerate((None, "ca", "ny", "tx"))]
    got = nearest(spark.createDataFrame([(c, i + 1000 * (c == "y"), src, st, t) for c, i, src, st, t in rows], "country string, id long, src int, state string, doc string"), least=0.3).collect()
    by = {(c, i + 1000 * (c == "y")): (src, st, t) for c, i, src, st, t in rows}
    grams = lambda t: {g for w in t.split() for p in [f" {w} "] for g in (p[j : j + 3] for j in range(len(p) - 2))}
    assert got and all(by[r.country, r.c][1] in (None, by[r.country, r.s1][1]) for r in got)
    found = {(r.s1, r.c) for r in got}
    for (ca, a), (sa, ta, xa) in by.items():
        for (cb, b), (sb, tb, xb) in by.items():
            if ca == cb and sa == 1 and sb != 1 and tb in (None, ta) and xa == xb:
                assert (a, b) in found
            if not grams(xa) & grams(xb):
                assert (a, b) not in found


def test_tfidf_of_copies_and_of_crowded_groups(spark):
    """Records that stand for copies give what all copies give; groups that are multiplied in tiles what those joined by gram give."""
    from random import Random

    from weftline.operators.tfidf import _multiplied, nearest, weighted

    rng, words = Random(5), ["red", "blue", "ring", "bolt", "brand", "small", "plate"]
    rows = [(rng.choice("xy"), i, 1 + i % 3, rng.choice(["a", "b", None]), " ".join(rng.choices(words, k=3))) for i in range(90)]
    schema = "country string, id long, src int, state string, doc string"
    every = spark.createDataFrame([(c, i + 1000 * k, src, st, d) for c, i, src, st, d in rows for k in range(4)], schema)
    plain = lambda df: sorted(map(tuple, df.collect()))
    want = plain(nearest(every, top=5, crowd=float("inf")))
    assert want and plain(nearest(every, top=5, crowd=0.0)) == want
    some = spark.createDataFrame([(*r, 4) for r in rows], schema + ", n_copies long")
    copies = spark.createDataFrame([(r[1] + 1000 * k, r[1]) for r in rows for k in range(4)], "id long, rep long")
    assert plain(nearest(some, top=5, copies=copies)) == want
    # tiles of three texts
    v = weighted(every, "doc")
    whole = v.groupBy("country", "id").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("v"))
    asked = every.where("src = 1 and id < 1000").select("country", F.lit("").alias("under"), F.col("id").alias("a"))
    held = every.where("src <> 1 and id < 1000").select("country", F.lit("").alias("under"), F.col("id").alias("b"), F.col("id").alias("first"))
    one, tiled = (_multiplied(asked, held, whole, 100, 0.3, 9, t) for t in (1000, 3))
    assert plain(one) == plain(tiled) and one.count() > 100


def test_best_columns_by_blocks(monkeypatch):
    """blocks of a tile give what all of it gives at once, ties included."""
    import numpy as np

    rng = np.random.default_rng(3)
    sides = [np.round(rng.random((n, 7)), 1) * (rng.random((n, 7)) < 0.6) for n in (23, 57)]
    coded = [(*np.nonzero(x), x[np.nonzero(x)]) for x in sides]
    cosines = np.round(sides[0] @ sides[1].T, 9)
    want = [(i, j, cosines[i, j]) for i in range(23) for j in sorted(range(57), key=lambda j: (-cosines[i, j], j))[:5] if cosines[i, j] >= 0.9]
    for block, columns in (((1024, 4096), 2048), ((4, 9), 3), ((5, 2), 7)):
        monkeypatch.setattr(tfidf, "BLOCK", block)
        monkeypatch.setattr(tfidf, "COLUMNS", columns)
        assert list(zip(*[x.tolist() for x in tfidf._nearest_rows(*coded, 23, 57, 7, 5, 0.9, 9)], strict=True)) == want


def test_tally_of_similarities(spark):
    """pairs by the similarity of their numbers are counted without being made, whatever the number of numbers."""
    rng = random.Random(4)
    rows = [(k, rng.choice("xy"), sorted(rng.sample(range(1, 9), rng.choice([0, 1, 2, 3, 5, 6])))) for k in range(120)]
    a, b = rows[:50], rows[50:]
    want = {}
    for _, key, num in a:
        for _, other, more in b:
            if key == other:
                union = len({*num, *more})
                p = round(len({*num} & {*more}) / union, 9) if union else 0.0
                want[p] = want.get(p, 0) + 1
    made = [spark.createDataFrame(x, "id long, key string, num array<bigint>") for x in (a, b)]
    assert {round(r.similarity, 9): r.pairs for r in nearest.tally(*made, ["key"]).collect()} == want
