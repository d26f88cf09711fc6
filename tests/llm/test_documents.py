"""Operators over documents: awkward rows against plain computations, and whole tables against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size int, `row.x` string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"


def ascii_lower(t):
    return (t or "").translate(str.maketrans(UPPER, LOWER))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and names that operators use themselves."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    rows = [(1, "A b c d e"), (2, "a B c d e"), (3, None), (None, None), (None, "a b c d e"), (4, ""), (4, ""), (5, long), (6, long.upper()), (7, long + "!"), (8, " \t\n"), (9, "É é 😀 x"), (10, "é é 😀 x"), (11, "z" * 5000), (3, "q")]
    return spark.createDataFrame([(i, t, None, None if n % 3 == 0 else "s", None, None, n, "x") for n, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_exact_duplicates(awkward, empty, docs):
    from weftline.llm.exact_dedup import drop_duplicates, exact_duplicates

    for df in (awkward, docs):
        got = exact_duplicates(df, block_bytes=64 if df is docs else 4096).collect()
        given = Counter((r.doc_id, hashlib.sha256(ascii_lower(r.text).encode()).hexdigest()) for r in df.collect())
        assert Counter((r.doc_id, r.text_sha256) for r in got) == given
        groups = {}
        for r in got:
            groups.setdefault(r.text_sha256, []).append(r)
        for rows in groups.values():
            ids = [r.doc_id for r in rows if r.doc_id is not None]
            assert sum(r.kept for r in rows) == 1
            assert all(r.group_size == len(rows) and r.keep_id == max(ids, default=None) for r in rows)
            assert next(r for r in rows if r.kept).doc_id == max(ids, default=None)
        left = drop_duplicates(df)
        assert left.columns == df.columns and left.count() == len(groups)
    assert exact_duplicates(empty).count() == 0 and drop_duplicates(empty).count() == 0


def test_block_names_settle_digest_clashes(spark, monkeypatch):
    from weftline.llm import exact_dedup

    blocks = spark.createDataFrame([(0, i, 2, p, b, d) for i, (p, b, d) in enumerate([(0, "aa", 1), (0, "bb", 1), (0, "aa", 1), (1, "cc", 2)])], "__wl_f long, __wl_i long, blocks long, pos long, block string, digest long")
    names = {r["__wl_i"]: r["name"] for r in exact_dedup._name_blocks(blocks.withColumn("block", F.col("block").cast("binary"))).collect()}
    assert names[0] == names[2] != names[1] and names[3] not in (names[0], names[1])


def near_groups(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i] = parent[parent[i]]
        return i

    for i in range(len(prints)):
        for j in np.nonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= 4)[0]:
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def plain_fingerprint(text):
    import xxhash

    words = [w for w in re.split(SPACE, ascii_lower(text)) if w]
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    value = 0
    for bit in range(64):
        ones = sum((xxhash.xxh64_intdigest(p.encode(), seed=42) >> bit) & 1 for p in parts)
        value |= (2 * ones > len(parts)) << bit
    return value


def test_simhash(awkward, empty, docs):
    from weftline.llm.simhash import fingerprint, near_duplicates

    for t in (None, "", "a", "a b c", "a b c d", "A b c d e f g a b c d", "x " * 700):
        assert fingerprint(t) == plain_fingerprint(t)
    for df in (awkward, docs):
        rows = near_duplicates(df).collect()
        assert len(rows) == df.count()
        prints = np.array([r.fp for r in rows], np.int64).view(np.uint64)
        groups = near_groups(prints)
        least = {}
        for g, r in zip(groups, rows, strict=True):
            if r.doc_id is not None:
                least[g] = min(r.doc_id, least.get(g, r.doc_id))
        assert [r.component_id for r in rows] == [least.get(g) for g in groups]
    assert near_duplicates(empty).count() == 0
    for odd in (awkward, empty):
        with pytest.raises(ValueError):
            near_duplicates(odd, max_bits=3)


def shingle_set(t):
    words = [w for w in re.split(SPACE, ascii_lower(t)) if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_of_planted_edits(spark):
    """Copies with a few edits are found, texts of the same words in another order are not."""
    from weftline.llm.simhash import near_copies

    random.seed(11)
    vocabulary = ["".join(random.choice("abcdeginorst") for _ in range(random.randint(2, 8))) for _ in range(800)]
    rows, sets = [], []
    for k in range(60):
        words = [random.choice(vocabulary) for _ in range(random.choice((40, 150, 400)))]
        rows.append((k, " ".join(words)))
        for j in range(random.choice((0, 1, 4))):
            edited = list(words)
            for _ in range(random.choice((1, len(words) // 60, len(words) // 8))):
                edited[random.randrange(len(edited))] = random.choice(vocabulary)
            rows.append((1000 * (j + 1) + k, " ".join(edited).upper()))
        random.shuffle(words)
        rows.append((10_000 + k, " ".join(words)))
    got = {r.doc_id: r for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    pairs = [(a, b, jaccard(sets[a], sets[b])) for n, (a, _) in enumerate(rows) for b, _ in rows[:n]]
    near = [got[a].label == got[b].label for a, b, x in pairs if x >= 0.85]
    assert len(near) > 40 and sum(near) >= 0.97 * len(near)
    assert not any(got[a].label == got[b].label for a, b, x in pairs if x < 0.4)
    for label in {r.label for r in got.values()}:
        group = [r for r in got.values() if r.label == label]
        assert [r.doc_id for r in group if r.stays] == [min(r.doc_id for r in group)]


def test_near_copies_in_crowded_buckets(spark, docs):
    """Tiles connect what the join of small buckets connects; a group of a third of all rows among them."""
    from weftline.llm.components import components
    from weftline.llm.simhash import differing, wide_fingerprint, wide_links

    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(100)] + [r.text for r in docs.limit(200).collect()]
    wide = sorted({tuple(wide_fingerprint(t, 4).view(np.int64).tolist()) for t in texts})
    prints = spark.createDataFrame([(n, list(w)) for n, w in enumerate(wide)], "node long, wide array<bigint>")
    found = [{(r.node, r.label) for r in components(wide_links(prints, 4, 16, dense=dense, tile=7)).collect()} for dense in (10**6, 8)]
    assert found[0] == found[1] and max(Counter(x for _, x in found[0]).values()) >= 100
    assert 0.14 < differing(0.8) < 0.16 and differing(1.0) == 0


def test_a_large_group_of_near_copies_meets_few_pairs(spark, monkeypatch):
    """Pairs of small buckets whose ends the large buckets connect are not met again; lone pairs are."""
    from weftline.llm import simhash
    from weftline.llm.components import components

    random.seed(5)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(150)]
    for k in range(5):
        words = [f"{random.random()}" for _ in range(200)]
        texts += [" ".join(words), " ".join([*words[:-1], "x"])]
    wide = [simhash.wide_fingerprint(t, 4).view(np.int64).tolist() for t in texts]
    prints = spark.createDataFrame([(n, w) for n, w in enumerate(wide)], "node long, wide array<bigint>")
    met, write = [], simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, name, *a: (met.append((name, out := write(df, name, *a))), out)[1])
    groups = {}
    for r in components(simhash.wide_links(prints, 4, 16)).collect():
        groups.setdefault(r.label, []).append(r.node)
    assert sorted(map(len, groups.values())) == [2] * 5 + [150]
    assert sum(df.count() for name, df in met if name == "near_candidates") < 150


def test_a_large_group_of_like_texts_costs_rows_for_its_members(spark, monkeypatch):
    """Some 20 % of the bits differ: pairs share small buckets but few are near copies. Members are rows, pairs are not, and the links are those of brute force."""
    from weftline.llm import simhash
    from weftline.llm.components import components

    rng, lanes = np.random.default_rng(3), 12
    base = rng.integers(0, 2, 64 * lanes, dtype=np.uint8)
    bits = base ^ (rng.random((500, 64 * lanes)) < 0.11).astype(np.uint8)
    bits = np.concatenate([bits, bits[:40] ^ (rng.random((40, 64 * lanes)) < 0.03).astype(np.uint8)])  # near copies of some
    wide = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    prints = spark.createDataFrame([(n, w) for n, w in enumerate(wide.view(np.int64).tolist())], "node long, wide array<bigint>")
    met, write = [], simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, name, *a: (met.append((name, out := write(df, name, *a))), out)[1])
    found = {r.node: r.label for r in components(simhash.wide_links(prints, lanes, 16)).collect()}
    most = int(64 * lanes * simhash.differing(simhash.SIMILARITY))
    blocks, label = wide.view(np.uint16), list(range(len(wide)))
    for a in range(len(wide)):
        for b in np.flatnonzero((np.bitwise_count(wide ^ wide[a]).sum(axis=1) <= most) & (blocks == blocks[a]).any(axis=1)).tolist():
            if label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert found == {n: x for n, x in enumerate(label) if label.count(x) > 1} and len(found) >= 80
    rows = {name: df.count() for name, df in met}
    assert rows["near_candidates"] < len(wide) and rows["near_members"] <= 48 * len(wide)


def test_links_of_small_buckets_wherever_batches_end():
    import pyarrow as pa

    from weftline.llm.simhash import _bucket_links

    rows = [(0, 1, 10, [0, 0]), (0, 1, 11, [1, 0]), (0, 2, 12, [0, 0]), (1, 2, 10, [0, 0]), (1, 2, 11, [1, 0]), (1, 2, 13, [7, 7]), (1, 2, 14, [3, 0]), (1, 3, 15, [0, -1])]
    batch = pa.table(dict(zip(("block", "key", "node", "wide"), map(list, zip(*rows, strict=True)), strict=True)), pa.schema([("block", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("wide", pa.list_(pa.int64()))]))
    for size in (1, 2, 3, 8):
        made = [tuple(r.values()) for out in _bucket_links(iter(batch.to_batches(size)), 1, 2) for r in out.to_pylist()]
        assert sorted(made) == [(10, 11), (11, 14)], size  # each once, though 10 and 11 share two buckets
    assert sum(out.num_rows for out in _bucket_links(iter([]), 1, 2)) == 0


def test_near_copies_of_awkward_rows(awkward, empty):
    from weftline.llm.simhash import drop_near_duplicates, near_copies

    got = near_copies(awkward).collect()
    labels = {}
    for r, given in zip(sorted(got, key=lambda r: r["__wl_i"]), awkward.collect(), strict=False):
        labels.setdefault(r.label, []).append(r.stays)
    assert len(got) == awkward.count() and all(sum(x) == 1 for x in labels.values())
    left = drop_near_duplicates(awkward)
    kept = left.collect()
    assert left.columns == awkward.columns and len(kept) == len(labels)
    # without words: null, empty and blank texts are one group; equal texts and the long text with its variants are others
    assert sum(not (r.text or "").strip() for r in kept) == 1 and sum(len(r.text or "") > 10_000 for r in kept) == 1
    assert near_copies(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


def test_columns_that_clash_with_the_hidden_metadata(spark, tmp_path):
    from weftline.llm.exact_dedup import drop_duplicates
    from weftline.llm.mixing import mix, mixture
    from weftline.llm.simhash import drop_near_duplicates

    for n, column in enumerate(("'x'", "named_struct('file_path', 'f', 'row_index', 7L)")):
        df = spark.sql(f"select id as doc_id, concat('some words of text ', id % 2) as text, 's' as source, {column} as _metadata from range(4)")
        df.coalesce(1).write.parquet(f"{tmp_path}/{n}")
        stored = spark.read.parquet(f"{tmp_path}/{n}")
        for odd in (df, stored):
            assert sum(r.taken for r in mixture(odd).collect()) == 20
            for made, rows in ((mix(odd), 4), (drop_duplicates(odd), 2), (drop_near_duplicates(odd), 2)):
                assert made.columns == odd.columns and made.count() == rows


@pytest.mark.parametrize("dense", [2, 1000])
def test_simhash_links_connect_the_same_in_dense_buckets(spark, dense):
    from weftline.llm.components import components
    from weftline.llm.simhash import links

    random.seed(4)
    values = set()
    for _ in range(6):
        centre = random.getrandbits(64)
        values |= {centre ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(12)} | {random.getrandbits(64) for _ in range(20)}
    values = np.array(sorted(values), np.uint64)
    signed = values.view(np.int64)
    got = {r["node"]: r["label"] for r in components(links(spark.createDataFrame([(int(v),) for v in signed], "fp long"), dense=dense)).collect()}
    groups = near_groups(values)
    label = {}
    for g, v in zip(groups, signed.tolist(), strict=True):
        label.setdefault(g, set()).add(got.get(v, v))
    assert all(len(x) == 1 for x in label.values()) and len({next(iter(x)) for x in label.values()}) == len(label)


def test_components_of_a_path_and_a_star(spark):
    from weftline.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (100, 101)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))


def test_mixing(awkward, empty, docs):
    from weftline.llm.mixing import mix, mixture

    for df in (awkward, docs):
        got = mixture(df).collect()
        source = {(r.doc_id, r.text): r.source for r in df.collect()}
        assert Counter(r.size for r in got) == Counter(len([w for w in re.split(SPACE, t or "") if w]) for _, t in [(r.doc_id, r.text) for r in df.collect()])
        assert all(0 <= r.taken <= 3 * r.size for r in got)
        by = {}
        for r in got:
            by.setdefault((r.source_size, r.target), []).append(r)
        for (size, target), rows in by.items():  # sources that are alike in both are summed together
            alike = sum(r.size for r in rows) // size if size else 0
            assert sum(r.taken for r in rows) == alike * math.floor(target)
        assert sorted((r.doc_id or -1, r.size, r.taken) for r in got) == sorted((r.doc_id or -1, r.size, r.taken) for r in mixture(df).collect())
        mixed = mix(df)
        assert mixed.columns == df.columns
        assert {(r.doc_id, r.text) for r in mixed.collect()} <= set(source)
    assert mixture(empty).count() == 0 and mix(empty).count() == 0


def test_mixing_targets(spark):
    from weftline.llm.mixing import targets

    sizes = spark.createDataFrame([("b", 1000), ("a", 10), ("c", 500), (None, 0), ("d", 90)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in targets(sizes).collect()}
    # weights: a 5, b 2, c 1, d 5, null 2; a, d and the null source reach three times their sizes
    assert got["a"] == 30 and got["d"] == 270 and got[None] == 0
    assert got["b"] == pytest.approx(1300 * 2 / 3) and got["c"] == pytest.approx(1300 / 3)


def test_bpe_is_tiktoken_and_decodes(spark, awkward, empty, docs):
    import public_tokenizers as P
    import tiktoken
    from weftline.llm.bpe import decode, encode, read_ranks

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = read_ranks(f.read())
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (awkward, docs):
        got = encode(df.withColumn("copy", F.col("text")).withColumn("n_tokens", F.lit("clash")), path, P.PATTERN, ids=True)
        for r in got.collect():
            assert r.token_ids == plain.encode_ordinary(r.copy or "") and r.n_tokens == len(r.token_ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(r.token_ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((r.copy or "").encode()).hexdigest()
        assert all(r.text == (r.copy or "") for r in decode(got.select("copy", "token_ids"), path, P.PATTERN).collect())
    assert encode(empty, path, P.PATTERN).count() == 0


def test_bpe_codec_on_odd_pieces():
    import public_tokenizers as P
    import tiktoken
    from weftline.llm.bpe import CHUNK_CHARS, codec, read_ranks

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        raw = f.read()
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(raw), special_tokens={})
    c = codec(raw, P.PATTERN)
    texts = ["a" * 5000, "ab" * 3000, "é" * 700, " " * 3000, "x" * 129, "日本語" * 500, "", "1" * 200 + "!" * 300, "\x1c\x85᠎ x", "word " * (CHUNK_CHARS // 4)]
    for t, parts in zip(texts, c.encoded(texts), strict=True):
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == plain.encode_ordinary(t)


def lm_base(rows):
    tokens = {i: [w for w in re.split(SPACE, ascii_lower(t)) if w] + ["\n"] for i, (_, t) in enumerate(rows)}
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    return sorted((-1 if d is None else d, held[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[i]), 4)) for i, (d, _) in enumerate(rows))


def test_lm_base_is_exact_and_scores_are_probabilities(awkward, empty, docs):
    from weftline.llm.lm import scores

    for df in (awkward, docs):
        got = scores(df).collect()
        rows = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)
        for a, b in zip(rows, lm_base([(r.doc_id, r.text) for r in df.collect()]), strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-6)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert scores(empty).count() == 0


class PlainMixer:
    """The model in plain Python: dictionaries of counts, one decision at a time."""

    def __init__(self, texts, kinds):
        from weftline.llm import context_mixing as cm

        self.cm, self.texts, self.kinds = cm, texts, kinds
        histogram = Counter(b for t, k in zip(texts, kinds) if k == cm.COUNTED for b in t)
        self.code = cm.Code(np.array([histogram[b] for b in range(256)]))
        self.counts = Counter()
        for t, k in zip(texts, kinds, strict=True):
            for at in range(len(t)) if k == cm.COUNTED else ():
                for context in self.contexts(t, at):
                    self.counts.update((context, node, bit) for node, bit in self.decisions(t[at]))

    def contexts(self, t, at):
        seen = self.cm.BEFORE + t[:at]
        return [(n, seen[-n:]) for n in self.cm.ORDERS]

    def decisions(self, byte):
        r = int(self.code.rank[byte])
        return [(int(self.code.node[r, d]), bool(self.code.bit[r, d])) for d in range(int(self.code.length[r]))]

    def inputs(self, t, at, own):
        for node, bit in self.decisions(t[at]):
            codes = []
            for c in self.contexts(t, at):
                code = int(self.cm.level(np.array([self.counts[c, node, bit]]))[0]) * 256 + int(self.cm.level(np.array([self.counts[c, node, not bit]]))[0])
                codes.append(int(self.cm.LEFT_OUT[code]) if own else code)
            grades = [int(self.cm.KNOWN[c]) for c in codes]
            gate = sum((g > 0) << k for k, g in enumerate(grades))
            yield node, bit, [(gate, k, g) for k, g in enumerate(grades)], [float(self.cm.STRETCH[c]) for c in codes]

    def probability(self, node, bit, index, x):
        cm = self.cm
        total = min(max(sum(self.weights[i] * v for i, v in zip(index, x)), 0.01 - cm.REACH), cm.REACH - 0.01)
        p, place = 1 / (1 + math.exp(-total)), (total if bit else -total) * cm.CELLS
        low = math.floor(place)
        share, cell = place - low, [self.map[node, low + j] for j in (0, 1)]
        one = cell[0][0] / cell[0][1] * (1 - share) + cell[1][0] / cell[1][1] * share
        return p, (p + (one if bit else 1 - one)) / 2, low + (share > 0.5)

    def scores(self, order):
        """order: (text, place) of the bytes that are learned from, in turn, as batches."""
        from collections import defaultdict

        cm = self.cm
        self.weights, taught = defaultdict(lambda: cm.FIRST), Counter()
        self.map = {(n, j): [cm.PRIOR / (1 + math.exp(-j / cm.CELLS)), cm.PRIOR] for n in range(255) for j in range(-cm.REACH * cm.CELLS, cm.REACH * cm.CELLS + 1)}
        for batch in order:
            steps, cells = Counter(), []
            for t, at, times in batch:
                for node, bit, index, x in self.inputs(self.texts[t], at, False):
                    p, _, near = self.probability(node, bit, index, x)
                    for i, v in zip(index, x):
                        steps[i] += (1 - p) * times * v
                        taught[i] += times
                    cells.append((node, near, bit, times))
            for i, s in steps.items():
                self.weights[i] += cm.RATE * s / math.sqrt(taught[i] + 1)
            for node, near, bit, times in cells:
                self.map[node, near][0] += times * bit
                self.map[node, near][1] += times
        return [sum(math.log(self.probability(*d)[1]) for at in range(len(t)) for d in self.inputs(t, at, k == cm.COUNTED)) for t, k in zip(self.texts, self.kinds)]


def chunk_of(cm, texts, kinds):
    data = b"".join(cm.BEFORE + t for t in texts)
    return cm.Stream(data, np.array([len(t) + len(cm.BEFORE) for t in texts]), np.array(kinds, np.uint8))


def chunk_scores(cm, stream, code):
    *found, (words, tokens) = cm.census(stream, code)
    return cm.score(stream, code, [cm.Known(k, cm.codes(k, *cm.paths(k, n, code), code), code) for k, n in found], cm.Slots(words), tokens), found, tokens


def test_lm_mixes_like_plain_python(docs):
    from weftline.llm import context_mixing as cm

    texts = [cm.lowered((r.text or "")[:150].encode()) for r in docs.orderBy("doc_id").limit(24).collect()] + [b"\n", cm.lowered("É é 日本 x x x".encode())]
    kinds = [cm.HELD if i % 7 == 2 else cm.TAUGHT if i % 3 == 1 else cm.COUNTED for i in range(len(texts))]
    plain, stream = PlainMixer(texts, kinds), chunk_of(cm, texts, kinds)
    sums, _, tokens = chunk_scores(cm, stream, plain.code)
    places = [(t, at) for t, x in enumerate(texts) for at in range(-len(cm.BEFORE), len(x))][len(cm.BEFORE) :]
    ((at, keys),) = stream.keys(plain.code)
    order, starts = cm.distinct(keys, stream.of(0, len(keys[0]))[0])
    taught = [(*places[order[a]], z - a) for a, z in zip(starts, [*starts[1:], len(order)]) if kinds[places[order[a]][0]] == cm.TAUGHT and places[order[a]][1] >= 0]
    want = plain.scores([taught[i : i + cm.BATCH] for i in range(0, len(taught), cm.BATCH)])
    assert len(taught) > cm.BATCH
    assert sums["score"] == pytest.approx(want, rel=1e-6)
    counted = Counter(w for t, k in zip(texts, kinds) if k != cm.HELD for w in t.split())
    assert sums["words"].tolist() == [len(t.split()) for t in texts] and tokens.sum() == sum(counted.values())


def test_lm_decisions_are_a_distribution():
    from weftline.llm import context_mixing as cm

    texts, kinds = [b"the cat sat\n", b"the dog sat\n", b"a cat\n", b"the cow\n"], [cm.COUNTED, cm.COUNTED, cm.TAUGHT, cm.HELD]
    plain = PlainMixer(texts, kinds)
    ends = [b"the c" + bytes([b]) for b in range(256)]
    plain.texts, plain.kinds = ends, [cm.HELD] * 256
    total = plain.scores([])
    plain.texts, plain.kinds = [b"the c"], [cm.HELD]
    (before,) = plain.scores([])
    assert sum(math.exp(x - before) for x in total) == pytest.approx(1)


def test_lm_blocks_and_segments_change_no_context(monkeypatch):
    from weftline.llm import context_mixing as cm
    from weftline.llm.lm import _segments

    random.seed(3)
    body = cm.lowered(" ".join("".join(random.choice("abc") for _ in range(random.choice((1, 3, 400)))) for _ in range(200)).encode())
    code = cm.Code(np.bincount(np.frombuffer(body, np.uint8), minlength=256))
    whole, inside = next(chunk_of(cm, [body], [0]).keys(code))[1], np.ones(len(body), bool)
    words = chunk_of(cm, [body], [0]).words(0, inside)[1]
    assert len(words) == len(body.split()) and len(set(words.tolist())) == len(set(body.split()))
    monkeypatch.setattr(cm, "BLOCK", 512)
    blocks = [k for _, k in chunk_of(cm, [body], [0]).keys(code)]
    for i, k in enumerate(whole):
        assert (np.concatenate([b[i] for b in blocks]) == k).all()
    stream = chunk_of(cm, [body], [0])
    assert (np.concatenate([stream.words(at, inside[at : at + 512])[1] for at, _ in stream.keys(code)]) == words).all()
    parts = list(_segments(body, 1000))
    assert len(parts) > 5 and b"".join(b for _, b in parts) == body
    cut = [next(cm.Stream(a + b, np.array([len(a + b)]), np.zeros(1, np.uint8)).keys(code))[1] for a, b in parts if len(b) <= 512]
    assert all((c[0] == whole[0][len(body) - len(c[0]) :]).all() and (c[2] == whole[2][len(body) - len(c[2]) :]).all() for c in cut[-1:])


def test_lm_chunks_share_counts(spark, docs, monkeypatch):
    from weftline.llm import lm

    one = {r.doc_id: r for r in lm.scores(docs).collect()}
    monkeypatch.setattr(lm, "CHUNK_BYTES", 1 << 18)
    monkeypatch.setattr(lm, "LEAST_BYTES", 1 << 18)
    for r in lm.scores(docs).collect():
        a = one[r.doc_id]
        assert a[:7] == r[:7] and a.base_score == pytest.approx(r.base_score) and math.isfinite(r.score) and r.score < 0  # small chunks may teach no weights, so scores differ


def test_toxic_grammar():
    from weftline.llm.toxicity import Lexicon, matched, trigger

    plain = Lexicon()
    found = lambda t: {k for k, v in matched(t, plain).items() if v and k not in ("weight", "words")}
    weight = lambda t, x=plain: matched(t, x)["weight"]
    assert found("You are an idiot.") == {"aimed_insult"} and found("He is not an idiot.") == {"denied_insult"} and found("he isn't an idiot") == {"denied_insult"}
    assert found("She said that he is a moron.") == {"reported_insult"} and found("trash") == {"insult"} and found("nothing here") == set()
    assert found("I will kill you") == found("I'll kill you") == found("I’ll kill you") == {"aimed_threat"} and found("we will kill the process") == {"threat"} and found(None) == set()
    assert found("you're an idiot") == {"aimed_insult"} and found("l'idiot") == {"insult"} and found("_idiot_") == {"insult"} and found("idiotx") == set()
    # weights add along a path: the word's and the transitions'
    assert weight("You are an idiot") == 3.0 and weight("an idiot") == 2.0 and weight("not an idiot") == -0.5 and weight("said an idiot") == pytest.approx(0.3)
    assert weight("I will kill you") == pytest.approx(2.5) and weight("idiot. " * 50) == 100.0
    learned = Lexicon({"zwyr": 1.5, "zwyrlo": 3.0})
    assert weight("zwyrk zwyrlox", learned) == 4.5 and weight("you zwyrk", learned) == 2.5 and trigger(["ab"]).search("x_abc") and not trigger(["ab"]).search("xabc")


def test_toxicity(spark, sf, awkward, empty, docs):
    from weftline.llm.toxicity import drop_toxic, toxicity

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    for df, known in ((awkward, odd), (docs, labels), (awkward, odd.where("false"))):
        got = toxicity(df, known).collect()
        assert len(got) == df.count()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)
        kept = drop_toxic(df, known)
        assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)
    assert toxicity(empty, labels).count() == 0 and drop_toxic(empty, labels).count() == 0


def test_toxicity_by_language_on_held_out_rows(spark):
    """On a real table: most toxic rows of each language with rows enough to learn from, and hardly a clean one."""
    from weftline.llm.toxicity import toxicity

    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = toxicity(docs, labels).where("held_out").join(labels.where("toxic is not null"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    clean = [r.predicted for r in rows if not r.toxic]
    assert sum(clean) <= 0.01 * len(clean)
    for lang in ("en", "fr", "de", "es"):
        toxic = [r.predicted for r in rows if r.toxic and r.lang == lang]
        assert len(toxic) >= 10 and sum(toxic) >= 0.8 * len(toxic), (lang, sum(toxic), len(toxic))


def test_toxicity_learns_stems_and_is_right_on_held_out_rows(spark):
    from weftline.llm.toxicity import _sampled, learn_stems, toxicity

    random.seed(2)
    ends = ["a", "en", "ung", "lich", "or", "ist", "um"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = ["".join(random.choice("abdegklmnrstu") for _ in range(6)) for _ in range(30)]
        if toxic:
            words[random.randrange(30)] = "zwyrl" + random.choice(ends)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    stems = learn_stems(d, _sampled(known, "doc_id", "toxic", 1000))
    assert any(s.startswith("zwyr") for s in stems) and all(w > 0 for w in stems.values())
    got = toxicity(d, known).where("held_out").join(known, "doc_id").collect()
    assert len(got) > 50 and all(r.predicted == r.toxic for r in got)


def test_transducers_compose():
    from weftline.llm.transducers import Transducer, window

    a, b = window("N", {"X": "Y"}, 2, 0.5), Transducer(0, lambda s, x: (s + (x == "Y"), x, 1.0 if x == "Y" else 0.0))
    machine = a >> b
    state, out, total = machine.start, [], 0.0
    for x in "NOXX":
        state, y, w = machine.step(state, x)
        out.append(y)
        total += w
    assert out == ["N", "O", "Y", "X"] and total == 1.5
    table, _ = a.compiled(["N", "X", "O", "END"])
    assert table[0]["X"][1] == "X" and table[table[0]["N"][0]]["X"][1] == "Y"
