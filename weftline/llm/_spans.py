"""Spans of regular expressions as Column expressions: positions in code points, leftmost and non-overlapping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
#: Matches whose positions are summed in one go. Lists grow by copies, so a text's matches are cut into lists of this length, and the work stays in proportion.
AT_ONCE = 256


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once for a row, however often `use` names it, in lambdas or not."""
    return F.transform(F.array(value), use)[0]


def _blocks(items: Column) -> Column:
    count = F.floor((F.size(items) - 1) / AT_ONCE).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda k: F.slice(items, k * AT_ONCE + 1, AT_ONCE)))


def located(text: Column, pattern: str, group: int = 0, around: int = 0) -> Column:
    """Matches of a (Java) pattern with start, end (exclusive), value (the text of a group), and up to `around` characters before and after it.

    Positions are sums of the lengths of the gaps that split() leaves and of the matches between them: both walk the same
    matches, once. What stands before and after reaches over one neighbouring match; a group that is longer than the match ends where the group does.
    The time grows in proportion to the text and its matches.
    """
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def measured(facts: Column) -> Column:
        def item(w: Column, i: Column) -> Column:
            v = F.get(facts.value, i)
            before, after = F.lit(""), F.lit("")
            if around:
                last, first = (lambda x: F.right(x, F.lit(around))), (lambda x: F.left(x, F.lit(around)))
                before = last(F.concat_ws("", last(F.get(facts.gaps, i - 1)), last(F.get(facts.whole, i - 1)), last(F.get(facts.gaps, i))))
                # a group may reach beyond its match, into the gap after
                rest = F.substring(F.get(facts.gaps, i + 1), F.greatest(F.length(v) - F.length(w), F.lit(0)) + 1, F.lit(around))
                after = first(F.concat_ws("", rest, first(F.get(facts.whole, i + 1)), first(F.get(facts.gaps, i + 2))))
            return F.struct(F.length(F.get(facts.gaps, i)).alias("gap"), F.length(w).alias("size"), v.alias("value"), before.alias("before"), after.alias("after"))

        return F.transform(facts.whole, item)

    def step(acc: Column, s: Column) -> Column:
        at = acc.pos + s.gap
        span = F.struct(at.alias("start"), (at + s["size"]).alias("end"), s["value"].alias("value"), s.before.alias("before"), s.after.alias("after"))
        return F.struct((at + s["size"]).alias("pos"), F.concat(acc.out, F.array(span)).alias("out"))

    def placed(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("pos"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc.out)

    def joined(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, s: a + s.gap + s["size"]))
        starts = F.aggregate(sizes, F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")), lambda acc, n: F.struct((acc.pos + n).alias("pos"), F.concat(acc.out, F.array(acc.pos)).alias("out")), lambda acc: acc.out)
        return F.flatten(F.zip_with(blocks, starts, placed))

    facts = F.struct(gaps.alias("gaps"), whole.alias("whole"), value.alias("value"))
    found = once(once(facts, measured), lambda items: once(_blocks(items), joined))
    return F.coalesce(found, F.array().cast(SPAN))


def spans_where(condition: Column, spans: Column) -> Column:
    """The spans where a cheap condition holds, else none."""
    return F.when(condition, spans).otherwise(F.array().cast(SPAN))


def apart(spans: Column) -> Column:
    """Spans, in order, without those that begin inside the one before."""
    return once(spans, lambda all_: F.filter(all_, lambda s, i: (i == 0) | (F.get(all_, i - 1).end <= s.start)))


def marked(spans: Column, order: int, kind: str, score: Callable[[Column], Column] | None = None) -> Column:
    """Spans that sort by (start, order), with their kind and a score."""
    scored = score or (lambda s: F.lit(1.0))
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(order).alias("ord"), s.end.alias("end"), F.lit(kind).alias("kind"), scored(s).cast("double").alias("score")))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
