"""The pipeline's stages against plain Python, and its queries' names."""

import math
import re
from collections import Counter

import pytest


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def check_toxicity(spark, before, after, sf):
    """A row goes exactly if the grammar, with what it learned from these rows, says so."""
    from weftline.llm import toxicity as X

    chosen = X._sampled(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "toxic", X.SAMPLE)
    lexicon = X.Lexicon(X.learn_stems(before, chosen))
    bias, *weights = X.fit(X.features(before, lexicon), chosen)

    def plain(text):
        found = X.matched(text, lexicon)
        x = [found["weight"], X.PER * found["weight"] / (X.PER + found["words"]), *[math.log1p(found[s]) for s in X.SORTS]]
        return 1 / (1 + math.exp(-bias - sum(a * b for a, b in zip(x, weights)))) < X.THRESHOLD

    assert sorted(map(str, after.collect())) == sorted(str(r) for r in before.collect() if plain(r.text))


def check_exact(spark, before, after, sf):
    best = {}
    for r in before.collect():
        text = lowered(r.text)
        if text not in best or (r.doc_id is not None and (best[text] is None or r.doc_id > best[text])):
            best[text] = r.doc_id
    assert Counter((lowered(r.text), r.doc_id) for r in after.collect()) == Counter(best.items())


def check_near(spark, before, after, sf):
    """All that goes has a near copy, clearly near copies don't both stay, and of a group the smallest id stays."""
    rows = [(r.doc_id, shingles(r.text)) for r in before.collect()]
    kept, near = {r.doc_id for r in after.collect()}, {}
    for n, (a, x) in enumerate(rows):
        for b, y in rows[:n]:
            likeness = len(x & y) / len(x | y) if x | y else 1.0
            if likeness >= 0.7:
                near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = likeness
    assert all(i in kept or i in near for i, _ in rows if i is not None)
    assert not any(a in kept and b in kept for a, of in near.items() for b, x in of.items() if x >= 0.9 and None not in (a, b))


def check_mixing(spark, before, after, sf):
    """Rows come as often as the words that the exact mix takes of them say, to the nearest whole row."""
    from weftline.llm.mixing import mixture

    want = Counter()
    for r in mixture(before).collect():
        if r.taken:
            want[r.doc_id] += (2 * r.taken + r.size) // (2 * r.size)
    assert Counter(r.doc_id for r in after.collect()) == +want


CHECKS = {"toxicity": check_toxicity, "exact_dedup": check_exact, "simhash_near_dedup": check_near, "mixing": check_mixing}


def run_stages(spark, docs, sf, folder):
    """Each stage on what the one before left, written and read again as in a run; checks all but the last."""
    import corpus_pipeline as C

    for name, stage in C.STAGES[:-1]:
        after = stage(spark, docs, sf)
        after.write.parquet(f"{folder}/{name}")
        after = spark.read.schema(docs.schema).parquet(f"{folder}/{name}")
        assert after.columns == docs.columns
        CHECKS[name](spark, docs, after, sf)
        docs = after
    return docs, C.STAGES[-1][1](spark, docs, sf)


def test_pipeline_stages(spark, sf, tmp_path):
    import public_tokenizers as P
    import tiktoken
    from weftline.llm.bpe import read_ranks

    import corpus_pipeline as C

    df, last = run_stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf, tmp_path)
    last = last.collect()
    with open(P.path(C.VOCABULARY), "rb") as f:
        plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    assert last and sorted((r.doc_id, tuple(r.token_ids)) for r in last) == sorted((r.doc_id, tuple(plain.encode_ordinary(r.text or ""))) for r in df.collect())
    ran = C.run(spark, sf)
    assert sorted((r.doc_id, r.ids_sha256) for r in ran.collect()) == sorted((r.doc_id, r.ids_sha256) for r in last)


def test_pipeline_stages_on_awkward_rows(spark, sf, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, label double, spans string, _metadata string, `row.x` int"
    long = " ".join(f"w{i % 97}x{i}" for i in range(20_000))
    texts = ["A b c d e f", "a B c d e f", None, "", "a b c d e f", "", "a b c d e f", long, long.upper(), long + " end", " \t\n", "É é 😀 x", "you are an idiot", "z" * 5000, "q", "q"]
    ids = [1, 2, 3, None, None, 4, 4, 5, 6, 7, 8, 9, 10, 11, 3, 3]
    rows = [(i, t, None, None if n % 3 == 0 else "s", None, None, "x", "y", n) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/docs")
    df, last = run_stages(spark, spark.read.parquet(f"{tmp_path}/docs"), sf, tmp_path)
    assert last.count() == df.count() > 0
    _, last = run_stages(spark, spark.createDataFrame([], schema), sf, f"{tmp_path}/empty")
    assert last.count() == 0


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {n for n in names if n == "pipeline"} and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(e.oracle_sql()) <= names


@pytest.mark.parametrize("name", ["op1_mixing", "op5_warc", "op6_exact_dedup", "op7_secrets", "op9_pii", "op10_topk"])
def test_oracles(spark, sf, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(e.oracle_sql()[name])
    df = e.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(want.columns)
    fix = lambda rows: sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)
    assert fix(map(tuple, df.select(*want.columns).collect())) == fix(want.fetchall())
