"""The queries of the training-data operators and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._common import ROW_KEY, table

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over all documents."""
    from weftline.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents")).drop(*ROW_KEY)


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source, {WORDS} AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source
), c AS (  -- sources by the level at which they reach their cap
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM s
), l AS (SELECT max((total - held) / free) FILTER (WHERE (total - held) / free <= 3.0 * source_size / weight) AS level, max(total) AS total FROM c),
t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, least(weight * coalesce(level, 'inf'::DOUBLE), 3.0::DOUBLE * source_size) AS target FROM s, l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + least(size, greatest(0, budget % source_size - before)) END AS BIGINT) AS taken
FROM p
"""


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over all documents."""
    from weftline.llm.lm import scores

    return scores(table(spark, sf_dir, "documents")).drop(*ROW_KEY)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over all documents."""
    from weftline.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop(*ROW_KEY)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over all documents."""
    import public_tokenizers

    from weftline.llm.bpe import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over all pages."""
    from weftline.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex, coalesce(html, '') AS payload FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS leader FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       -- the i-th of 32 characters stands for the bits 5i to 5i + 4, which lie in two neighbouring hexadecimal digits
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         ((((strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 1 AS INTEGER), 1)) - 1) * 16
         + (strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 2 AS INTEGER), 1)) - 1)) >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> leader THEN leader END AS refers_to
FROM r
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over all documents."""
    from weftline.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents")).drop(*ROW_KEY)


OP6_SQL = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {LOWERED} AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""

def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over all documents."""
    from weftline.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over all documents."""
    from weftline.llm.secrets import secret_digests

    return secret_digests(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over all documents."""
    from weftline.llm.pii import personal_data_digests

    return personal_data_digests(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over all embeddings."""
    from weftline.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM s
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""


def _spans_sql(kinds: list[tuple[str, str, int, str, bool]]) -> str:
    """SQL of a span query from (kind, pattern, group, condition on the value v, base) in order.

    Positions are sums of the lengths of the gaps between matches and of the matches, as code points.
    """
    each = " UNION ALL ".join(
        f"SELECT rid, {n} AS ord, '{kind}' AS kind, {base} AS base, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS whole, regexp_extract_all(text, '{pattern}', {group}) AS vals FROM t WHERE regexp_matches(text, '{pattern}')"
        for n, (kind, pattern, group, _, base) in enumerate(kinds)
    )
    keep = " OR ".join(f"(ord = {n} AND ({condition}))" for n, (_, _, _, condition, _) in enumerate(kinds))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind, *_, base in kinds if base)
    outer = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_, base in kinds if base)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), m AS ({each}),
u AS (SELECT rid, ord, kind, base, unnest(range(1, len(whole) + 1)) AS i, unnest(list_slice(list_transform(gaps, lambda x: length(x)), 1, len(whole))) AS gap, unnest(list_transform(whole, lambda x: length(x))) AS size, unnest(vals) AS v FROM m),
p AS (SELECT rid, ord, kind, base, v, size, sum(gap + size) OVER (PARTITION BY rid, ord ORDER BY i) AS stop FROM u),
s AS (SELECT rid, ord, kind, base, CAST(stop - size AS BIGINT) AS start, kind || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT) AS w FROM p WHERE {keep}),
g AS (SELECT rid, {counts}, string_agg(w, ',' ORDER BY start, ord) FILTER (WHERE base) AS b, string_agg(w, ',' ORDER BY start, ord) AS spans FROM s GROUP BY rid)
SELECT doc_id, {outer}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (rid)
"""


def _secrets_sql() -> str:
    from weftline.llm.secrets import RULES

    return _spans_sql([(r.kind, r.pattern.replace("'", "''"), r.group, f"length(v) >= {r.least}", r.base) for r in RULES])


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INTEGER) WHEN CAST(d AS INTEGER) < 5 THEN 2 * CAST(d AS INTEGER) ELSE 2 * CAST(d AS INTEGER) - 9 END)) % 10 = 0"


def _personal_sql() -> str:
    """SQL of the personal-data query. RE2 knows no look-arounds, so account and security numbers are looked for at each place of the few texts that may hold one."""
    from weftline.llm.pii import AROUND, CONTEXT_GAIN, KINDS, LEAST, iban_pattern

    octet = "ltrim(x, '0')"
    luhn = f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END"
    plain = "replace(v, ' ', '')"
    code = "CASE WHEN ch <= '9' THEN ascii(ch) - 48 ELSE ascii(ch) - 55 END"
    number = f"list_transform(string_split(substr({plain}, 5) || substr({plain}, 1, 4), ''), lambda ch: {code})"
    mod97 = f"list_reduce(list_prepend(0, {number}), lambda a, n: (CASE WHEN n < 10 THEN a * 10 + n ELSE a * 100 + n END) % 97) = 1"
    # of a kind: the expression whose matches split the text, or (what stands before, what begins there, the whole)
    split = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    placed = {"iban": ("[A-Za-z0-9]", "[A-Z]{2}[0-9]{2}", f"({iban_pattern()})([^A-Za-z0-9]|$)"), "ssn": ("[0-9-]", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "([0-9]{3}-[0-9]{2}-[0-9]{4})([^0-9-]|$)")}
    confirm = {
        "email": "true", "ip": f"len(list_filter(string_split(v, '.'), lambda x: length({octet}) > 3 OR (length({octet}) = 3 AND {octet} > '255'))) = 0", "card": luhn, "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
        "iban": mod97, "ssn": "NOT regexp_matches(v, '^(000|666|9)') AND NOT contains(v, '-00-') AND NOT regexp_matches(v, '0000$')",
    }
    first = {"iban": "4", "ssn": "11"}  # characters that a match takes
    by_split = " UNION ALL ".join(
        f"SELECT rid, {n} AS ord, string_split_regex(text, '{split[k.kind]}') AS gaps, regexp_extract_all(text, '{split[k.kind]}', 0) AS whole FROM t WHERE regexp_matches(text, '{split[k.kind]}')"
        for n, k in enumerate(KINDS) if k.kind in split
    )
    by_place = " UNION ALL ".join(
        f"SELECT rid, {n} AS ord, i - 1 AS start, i - 1 + {first[k.kind]} AS stop, regexp_extract(substr(text, i, 80), '^{placed[k.kind][2]}', 1) AS v FROM (SELECT rid, text, unnest(range(1, length(text) + 1)) AS i FROM t WHERE regexp_matches(text, '{placed[k.kind][1]}')) "
        f"WHERE regexp_matches(substr(text, i, 80), '^{placed[k.kind][2]}') AND NOT regexp_matches(substr(text, CAST(greatest(i - 1, 1) AS BIGINT), CASE WHEN i > 1 THEN 1 ELSE 0 END), '{placed[k.kind][0]}')"
        for n, k in enumerate(KINDS) if k.kind in placed
    )
    kept = " OR ".join(f"(ord = {n} AND ({confirm[k.kind]}))" for n, k in enumerate(KINDS))
    names, sure = "[" + ", ".join(f"'{k.kind}'" for k in KINDS) + "]", "[" + ", ".join(str(k.sure) for k in KINDS) + "]"
    base = [k.kind for k in KINDS if k.base]
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in base)
    near = " OR ".join(f"(ord = {n} AND regexp_matches(near, '(?i)(^|[^a-z0-9_])({k.context})([^a-z0-9_]|$)'))" for n, k in enumerate(KINDS))
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), m AS ({by_split}),
u AS (SELECT rid, ord, unnest(range(1, len(whole) + 1)) AS i, unnest(list_slice(list_transform(gaps, lambda x: length(x)), 1, len(whole))) AS gap, unnest(list_transform(whole, lambda x: length(x))) AS size, unnest(whole) AS v FROM m),
p AS (SELECT rid, ord, CAST(sum(gap + size) OVER (PARTITION BY rid, ord ORDER BY i) - size AS BIGINT) AS start, CAST(sum(gap + size) OVER (PARTITION BY rid, ord ORDER BY i) AS BIGINT) AS stop, v FROM u UNION ALL {by_place}),
c AS (SELECT *, start + length(v) AS finish, coalesce(lag(stop, 2) OVER w, 0) AS low, coalesce(lead(start, 2) OVER w, 9223372036854775807) AS high FROM p WINDOW w AS (PARTITION BY rid, ord ORDER BY start)),
s AS (SELECT rid, ord, start, finish, text[greatest(start - {AROUND}, low) + 1:start] || ' ' || text[finish + 1:least(finish + {AROUND}, high)] AS near, v FROM c JOIN t USING (rid) WHERE {kept}),
a AS (SELECT *, lag(finish) OVER (PARTITION BY rid, ord ORDER BY start) AS before FROM s),
k AS (SELECT rid, ord, {names}[ord + 1] AS kind, start, {names}[ord + 1] || ':' || start || ':' || finish AS w, round({sure}[ord + 1] + CASE WHEN {near} THEN {CONTEXT_GAIN} ELSE 0 END, 1) AS score FROM a WHERE coalesce(before <= start, true)),
g AS (SELECT rid, {counts}, string_agg(w, ',' ORDER BY start, ord) FILTER (WHERE ord < {len(base)}) AS b, string_agg(w, ',' ORDER BY start, ord) AS spans, string_agg(CAST(CAST(score AS DECIMAL(3,1)) AS VARCHAR), ',' ORDER BY start, ord) AS scores FROM k WHERE ord < {len(base)} OR score >= {LEAST} GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM t LEFT JOIN g USING (rid)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_lm": op2_lm,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secrets": op7_secrets,
    "op8_simhash": op8_simhash,
    "op9_pii": op9_pii,
    "op10_topk": op10_topk,
}
ORACLES: dict[str, str] = {"op1_mixing": OP1_SQL, "op5_warc": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op7_secrets": _secrets_sql(), "op9_pii": _personal_sql(), "op10_topk": OP10_SQL}
