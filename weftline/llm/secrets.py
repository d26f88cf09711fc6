"""Secret scans over a trigram inverted index.

A Boolean trigram query is derived from each rule's expression. The postings (trigram, row) of the trigrams that any rule needs
are written to an index; a rule's candidates are the rows whose postings satisfy one conjunction of its query, and only they are
verified with the expression. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import ROW_KEY, materialise, with_row_key
from weftline.llm._spans import located, marked, spans_where, written
from weftline.llm.trigrams import ALWAYS, trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, the group whose length counts and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The expressions of the base kinds.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
)
#: Published formats of further credentials.
MORE_RULES = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


def _scan_pattern(rule: Rule) -> tuple[str, int]:
    """For a rule that scans fully: an expression that skips what fails anyhow, and the least length left to check.

    A maximal run of one class fails as a whole when it is short, so only long runs need positions.
    """
    if rule.pattern == r"[0-9a-f]+":
        return rf"(?<![0-9a-f])[0-9a-f]{{{rule.least},}}+", rule.least
    return rule.pattern, rule.least


def _long_enough(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda s: F.length(s["value"]) >= least)


def build_index(keyed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The postings (trigram, ROW_KEY) of all trigrams that the rules' queries name; keyed: ROW_KEY and text (null: empty)."""
    needed = sorted({t for r in rules for conjunction in trigram_query(r.pattern) for t in conjunction})
    lowered = keyed.select(*ROW_KEY, F.lower("text").alias("lowered"))
    has = F.filter(F.array(*[F.lit(t) for t in needed]).cast("array<string>"), lambda t: F.contains(F.col("lowered"), t))
    return materialise(lowered.select(F.explode(has).alias("trigram"), *ROW_KEY), "postings")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """ROW_KEY and rules (kinds, at most one of each rule) of the rows that satisfy the rules' queries."""
    parts = [(r.kind, f"{r.kind}{j}", len(c), t) for r in rules for j, c in enumerate(sorted(trigram_query(r.pattern), key=sorted)) for t in sorted(c)]
    query = F.broadcast(index.sparkSession.createDataFrame(parts, "kind string, conjunction string, need int, trigram string"))  # as long as the rules
    met = index.join(query, "trigram").groupBy(*ROW_KEY, "kind", "conjunction").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n = need")
    return met.groupBy(*ROW_KEY).agg(F.collect_set("kind").alias("rules"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: ROW_KEY, doc_id, spans: array of (start, ord, end, kind, score) in order.

    Matches are leftmost and non-overlapping for each rule; those whose group is too short are dropped, without another try.
    Null texts count as empty; rows without secrets have an empty array. Ids may be null or repeat. An empty table gives no rows; other columns are
    not read.
    """
    keyed = with_row_key(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    indexed = tuple(r for r in rules if trigram_query(r.pattern) != ALWAYS)
    met = candidates(build_index(keyed, indexed), indexed)
    joined = keyed.join(met, ROW_KEY, "left")
    found = []
    for order, rule in enumerate(rules):
        if rule in indexed:
            spans = spans_where(F.coalesce(F.array_contains("rules", rule.kind), F.lit(False)), located(F.col("text"), rule.pattern, rule.group))
            least = rule.least
        else:
            pattern, least = _scan_pattern(rule)
            spans = spans_where(F.col("text").rlike(pattern), located(F.col("text"), pattern, rule.group))
        found.append(marked(_long_enough(spans, least), order, rule.kind))
    return joined.select(*ROW_KEY, "doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the number of spans of each base kind, the digest of the base spans, and all spans as a string."""
    return digests(find_secrets(docs, id_col, text_col, rules), [r.kind for r in rules if r.base])


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s.kind == kind)


def digests(found: DataFrame, base: list[str], *more: Column) -> DataFrame:
    of_base = F.filter("spans", lambda s: s.kind.isin(base))
    count = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *count, F.sha2(written(of_base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), *more)
