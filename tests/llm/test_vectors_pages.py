"""Top-k search and WARC archives against brute force."""

import base64
import hashlib
import random

import numpy as np
import pytest


def held(score):
    return max(-(2**63), min(2**63 - 1, int(score)))


def plain_top(rows, k=5):
    ok = [(i, n, np.floor(256 * np.array(v, float))) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, n, q in ok:
        if i % 50 == 0:
            m = sorted((-held(sum(int(a) * int(b) for a, b in zip(q, c))), j, o) for j, o, c in ok if o != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(m)]
    return sorted(out)


def got_top(df):
    from weftline.llm.topk import top_k

    return sorted(map(tuple, top_k(df).collect()))


def test_top_k(spark, sf):
    nan, inf = float("nan"), float("inf")
    odd = [(0, [1.0, 2.0]), (50, [0.5]), (50, [0.5]), (None, [1.0]), (7, None), (8, [1.0, None]), (9, [nan, 1.0]), (10, [inf]), (11, []), (12, [1.0, 2.0]), (13, [1.0, 2.0]), (14, [-3.0, 1e6]), (-100, [0.25, 0.25]), (15, [0.001, -0.001])]
    schema = "vec_id long, embedding array<double>, score string"
    assert got_top(spark.createDataFrame([(i, v, "x") for i, v in odd], schema)) == plain_top(odd)
    assert got_top(spark.createDataFrame([(0, [1.0], "x")], schema)) == [] and got_top(spark.createDataFrame([], schema)) == []
    assert got_top(spark.createDataFrame([(0, [1.0], "x"), (3, [1.0], "x")], schema)) == [(0, 1, 3, 65536)]
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert got_top(df) == plain_top([(r.vec_id, r.embedding) for r in df.collect()])


def test_top_k_refines_and_breaks_ties(spark, monkeypatch):
    from weftline.llm import topk

    monkeypatch.setattr(topk, "BINS", 4)
    monkeypatch.setattr(topk, "SPARE", 0)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, 4) / 256]) for i in range(120)] + [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(40)]
    assert got_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)) == plain_top(rows)


def test_top_k_large_numbers(spark):
    rows = [(0, [1e9, 3.0]), (1, [2e9, -1.0]), (2, [1e9 + 1, 0.0]), (3, [1e15, 0.0]), (4, [-1e15, 1.0])]
    assert got_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == plain_top(rows)


def test_top_k_broadcasts_nothing(spark):
    """The query blocks are repeated for each group; as a broadcast they would have to pass through the driver."""
    from weftline.llm.topk import top_k

    rows = [(i, [float(i % 7), 1.0]) for i in range(200)]
    plan = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


PAGES = "page_id long, url string, html string, payload string"


@pytest.mark.parametrize("least", [0, 4])
def test_warc_round_trip(spark, sf, least):
    from weftline.llm.warc import round_trip

    odd = [(1, "http://a/", "x é"), (5, "http://b/\r\nEvil: 1", "x é"), (3, None, None), (4, "u", ""), (None, "n", "q" * 10), (None, "n", "q" * 10), (7, "p", "same"), (7, "p", "same"), (8, "l", "long " * 100_000)]
    frames = [spark.createDataFrame([(*r, "clash") for r in odd], PAGES), spark.read.parquet(f"{sf}/pages.parquet")]
    for df in frames:
        got = round_trip(df, least=least).collect()
        given = [(r.page_id, (r.html or "").encode()) for r in df.collect()]
        assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest) for r in got) == sorted((i or -1, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode()) for i, p in given)
        groups = {}
        for r in got:
            groups.setdefault(r.payload_digest, []).append(r)
        for rows in groups.values():
            if rows[0].payload_bytes < least:
                assert all(r.record_type == "response" and r.refers_to is None for r in rows)
                continue
            top = max((r.page_id for r in rows if r.page_id is not None), default=None)
            one = [r for r in rows if r.record_type == "response"]
            assert len(one) == 1 and one[0].page_id == top and one[0].refers_to is None
            assert all(r.refers_to == top for r in rows if r.record_type == "revisit")
    assert round_trip(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_pushdown_and_skipping(spark, tmp_path, compression):
    from weftline.llm.warc import archive_pages, read_archive

    pages = spark.createDataFrame([(i, f"http://h{i % 3}/{i}", f"body {i % 5}") for i in range(40)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    archive_pages(pages, path, compression)
    assert read_archive(spark, path).count() == 40
    hits = read_archive(spark, path).where("record_type = 'response' and target_uri like 'http://h1/%'")
    assert all(r.payload is not None and r.payload.decode().startswith("body") for r in hits.collect())
    revisits = read_archive(spark, path).where("record_type = 'revisit'").collect()
    assert len(revisits) == 35 and all(r.payload is None and r.payload_bytes == 6 for r in revisits)
    assert read_archive(spark, path, payload=False).where("payload is not null").count() == 0
    assert read_archive(spark, path, verify=True).count() == 40


def test_warc_reader_reports_damage():
    import io

    from weftline.llm.warc import _Seeking, record, records

    good = record("response", "<urn:page:1>", "u", None, b"abc")
    take = lambda raw, **how: list(records(_Seeking(io.BytesIO(raw)), lambda h: True, **how))
    assert take(good + good)[1][1] == b"abc"
    with pytest.raises(ValueError):
        take(good[:-8])
    with pytest.raises(ValueError):
        take(good.replace(b"abc", b"abd"), verify=True)
    with pytest.raises(ValueError):
        take(b"nonsense\r\n")


def test_archives_that_are_written_to_again(spark, tmp_path):
    from weftline.llm.warc import archive_pages, page_records, read_archive

    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>" + "x" * i * 1000) for i in range(6)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/again"
    archive_pages(pages.where("page_id < 3"), path)
    archive_pages(pages.where("page_id >= 3"), path)
    assert read_archive(spark, path).count() == 6
    page_records(pages.where("page_id = 1")).write.format("warc").option("path", path).mode("overwrite").save()
    assert read_archive(spark, path).count() == 1 and len(list((tmp_path / "again").iterdir())) == 2


def test_gzip_members_that_end_early_are_told(spark, tmp_path):
    import gzip

    from weftline.llm.warc import _Inflated

    whole = gzip.compress(random.Random(1).randbytes(200_000))
    for cut, skipped in ((len(whole) - 500, False), (len(whole) // 2, True)):
        path = tmp_path / "cut.gz"
        path.write_bytes(whole[:cut])
        with open(path, "rb") as f, pytest.raises(EOFError):
            stream = _Inflated(f)
            stream.skip(200_000) if skipped else stream.read(200_000)
