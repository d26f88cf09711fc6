"""DuckDB SQL of the parts that oracles share: part records, keys, pairs, truth, predictions."""

from __future__ import annotations

LEGAL_SQL = "['private','pvt','limited','ltd','llp','opc','public','llc','inc','incorporated','corp','corporation','co','company','pc','pllc','lp','plc','lc','sarl','sas','sasu','sa','eurl','snc','sci','ei','selarl','scp','scop','ms','dr','mr','mrs','messrs','the','and','et','und']"
DROP_SQL = "['private','pvt','limited','ltd','llp','public','opc','llc','inc','incorporated','corp','corporation','co','company','pc','pllc','lp','plc','sarl','sas','sasu','sa','eurl','snc','sci','ms','dr','the','and','et','com','www']"


def cleaned(c: str) -> str:
    """The first name cleaner."""
    steps = f"lower(strip_accents({c}))"
    for pattern, by in ((r"\bm/s\b", " "), (r"\.com\b|\bwww\.", " "), ("&", " and "), (r"\.", ""), (r"[^\p{L}\p{M}\p{N}]+", " ")):
        steps = f"regexp_replace({steps}, '{pattern}', '{by}', 'g')"
    return f"trim({steps})"


def ints(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({c}, '[0-9]+'), lambda d: CAST(right(d, 9) AS BIGINT)), lambda d: d > 0)))"


def short(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_concat({c}, list_transform({c}, lambda x: x % CAST(pow(10, floor(log10(x) + 1e-9)) AS BIGINT))), lambda x: x > 0)))"


REC = f"""
raw AS (
  SELECT (p_partkey % 3 + 1) * 10000000000 + p_partkey AS id, CAST(p_partkey % 3 + 1 AS INTEGER) AS src, p_type AS country, p_brand, p_name,
         'S' || (p_partkey % 3 + 1) || '-' || p_partkey AS entity_id, CASE WHEN p_size <> 33 THEN p_size || ' ' || p_brand END AS address
  FROM part
), rec AS (
  SELECT *, list_filter(string_split({cleaned('p_name')}, ' '), lambda t: t <> '' AND NOT list_contains({LEGAL_SQL}, t)) AS core, {ints('address')} AS num,
         {cleaned('address')} AS addr_str, CASE WHEN address IS NOT NULL THEN ['brand'] END AS addr_toks
  FROM raw
), keyed AS (
  SELECT *, array_to_string(core, '') AS k1, array_to_string(list_sort(core), ' ') AS k2, {short('num')} AS numx FROM rec
)"""
TRUTH = "truth AS (SELECT a.id AS s1, b.id AS c FROM raw a JOIN raw b ON a.src = 1 AND b.src <> 1 AND a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.country = b.country)"
#: Name-key pairs with the score that the decision queries use.
PRED = """
pred AS (
  SELECT a.id AS s1, b.id AS c, a.country, list_has_any(a.num, b.num) AS num_ok, b.address IS NULL AS b_addr_null,
         round((2 + 2 * coalesce(len(list_intersect(a.num, b.num)) / nullif(len(list_distinct(list_concat(a.num, b.num))), 0), 0)) / 4.5, 6) AS p
  FROM keyed a JOIN keyed b ON a.src = 1 AND b.src <> 1 AND a.country = b.country AND a.k1 = b.k1
), base AS (SELECT id AS s1, country FROM raw WHERE src = 1)"""


def rare(words: str, n: int) -> str:
    """CTEs: the n rarest tokens of each record."""
    return f"""
tok AS (SELECT DISTINCT country, id, unnest({words}) AS t FROM keyed),
frq AS (SELECT country, t, count(*) AS f FROM tok WHERE length(t) >= 3 GROUP BY ALL HAVING count(*) >= 2),
rare AS (SELECT country, id, t, f FROM tok JOIN frq USING (country, t) QUALIFY row_number() OVER (PARTITION BY country, id ORDER BY f, t) <= {n})"""


def key_ctes(kind: str) -> str:
    """CTEs that end with keys(country, id, key)."""
    if kind == "name_exact":
        return "keys AS (SELECT DISTINCT country, id, unnest([k1, k2]) AS key FROM keyed)"
    if kind == "num_name":
        return rare("core", 2) + ", nums AS (SELECT id, unnest(numx) AS n FROM keyed), keys AS (SELECT DISTINCT country, id, n || '|' || t AS key FROM rare JOIN nums USING (id))"
    if kind == "num_addr":
        return rare("addr_toks", 2) + ", nums AS (SELECT id, unnest(numx) AS n FROM keyed), keys AS (SELECT DISTINCT country, id, n || '|' || t AS key FROM rare JOIN nums USING (id))"
    if kind == "name_pair":
        return rare("core", 3) + """, ones AS (SELECT country, id, min(t) AS t FROM rare GROUP BY ALL HAVING count(*) = 1),
keys AS (SELECT country, id, t AS key FROM ones UNION SELECT a.country, a.id, a.t || '|' || b.t FROM rare a JOIN rare b ON a.id = b.id AND a.country = b.country AND a.t < b.t)"""
    return "keys AS (SELECT DISTINCT country, id, '|' || left(core[1], 3) || '|' || coalesce(left(core[2], 3), '') AS key FROM keyed WHERE length(left(core[1], 3)) >= 2)"


def pass_pairs(kind: str, cap: int) -> str:
    """The pairs of a pass as a SELECT of its own."""
    return f"""WITH {REC}, {key_ctes(kind)}, ks AS (SELECT *, id // 10000000000 AS src FROM keys),
small AS (SELECT country, key FROM ks WHERE src <> 1 GROUP BY ALL HAVING count(*) <= {cap})
SELECT DISTINCT a.country, a.id AS s1, b.id AS c FROM ks a JOIN small USING (country, key) JOIN ks b USING (country, key) WHERE a.src = 1 AND b.src <> 1"""


def entities(pairs: str) -> str:
    """CTE ent(s1, country, tp, n_pred, n_true, f) from a CTE of pairs; needs base and truth."""
    return f"""
got AS (SELECT p.s1, count(t.c) AS tp, count(*) AS n_pred FROM (SELECT DISTINCT s1, c FROM {pairs}) p LEFT JOIN truth t ON p.s1 = t.s1 AND p.c = t.c GROUP BY 1),
want AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY 1),
ent AS (
  SELECT s1, country, tp, n_pred, n_true, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END AS f
  FROM (SELECT base.s1, country, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true FROM base LEFT JOIN got USING (s1) LEFT JOIN want USING (s1))
)"""


SUMMARY = """count(*) AS n, avg(f) AS f_macro, avg(tp / n_pred) FILTER (WHERE n_pred > 0) AS p_avg, avg(tp / n_true) FILTER (WHERE n_true > 0) AS r_avg,
avg(CAST(n_pred > 0 AS INTEGER)) AS pred_nonempty, avg(CAST(n_true = 0 AS INTEGER)) AS singleton_frac, avg(f) FILTER (WHERE n_true = 0) AS f_singletons, avg(f) FILTER (WHERE n_true > 0) AS f_nonsingle"""
SUMMARY_DOUBLES = ("f_macro", "p_avg", "r_avg", "pred_nonempty", "singleton_frac", "f_singletons", "f_nonsingle")
OWNED = "owned AS (SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY c ORDER BY p DESC, s1) = 1)"


def expected(alpha: str, keys: str = "") -> str:
    """The expected-F decision over a CTE owned."""
    by = f"{keys}s1"
    return f"""
x AS (
  SELECT *, row_number() OVER w AS k, sum(p) OVER (PARTITION BY {by} ORDER BY p DESC, c ROWS UNBOUNDED PRECEDING) AS cum, sum(p) OVER (PARTITION BY {by}) * (1 + {alpha}) AS et,
         exp(sum(ln(greatest(least(1 - p, 1.0), 1e-12))) OVER (PARTITION BY {by})) AS p0
  FROM owned WINDOW w AS (PARTITION BY {by} ORDER BY p DESC, c)
), y AS (SELECT *, 1.25 * cum / (k + 0.25 * et) AS ef FROM x),
z AS (SELECT *, max(ef) OVER (PARTITION BY {by}) AS efmax, first_value(k) OVER (PARTITION BY {by} ORDER BY ef DESC, k) AS kbest FROM y),
decided AS (SELECT {by}, c FROM z WHERE efmax > p0 AND k <= kbest)"""
