"""Personal data: expressions propose spans, checksums and ranges confirm them, nearby words adjust their scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import ROW_KEY, with_row_key
from weftline.llm._spans import apart, located, marked, spans_where
from weftline.llm.secrets import digests


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a string pass Luhn's checksum."""
    numbers = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d: d.cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes the mod-97 check: first four characters moved to the end, letters as 10 to 35."""
    plain = F.regexp_replace(value, "\x20", "")
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    number = F.transform(turned, lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(number, F.lit(0), lambda a, n: F.when(n < 10, a * 10 + n).otherwise(a * 100 + n) % 97) == 1


def _in_range(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"))


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. quick: an expression that every text with a span matches; sure: the score of a confirmed span without context."""

    kind: str
    pattern: str
    quick: str
    confirm: Callable[[Column], Column]
    sure: float
    context: str
    base: bool = False
    #: Where 1, the pattern matches a beginning only and its group holds the span, so that a span that is denied hides none that begins inside it.
    group: int = 0


#: Characters on each side of a span, over one neighbouring match of its kind at most, in which context words count; what such a word adds; the least score of a span that is not a base one.
AROUND, CONTEXT_GAIN, LEAST = 40, 0.3, 0.5

#: Characters of an account number by country, the countries that use them without being in the registry included.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    """Account numbers of any country, without what must not follow."""
    return "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())



#: Patterns of the kinds and the words of their contexts. Possessive quantifiers keep the matches and bound
#: the time; an account number is bounded by its country's length instead, since upper-case words and digits may follow it.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]++\.", lambda v: F.lit(True), 0.6, "e-?mail|mail|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", _in_range, 0.5, "ip|address|host|server|login", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}", lambda v: F.length(_digits(v)).between(12, 19) & luhn(v), 0.6, "card|visa|master|credit|payment", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda v: F.length(_digits(v)).between(9, 15), 0.5, "phone|tel|call|mobile|fax", True),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=((?:{iban_pattern()})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", mod97, 0.7, "iban|account|konto|compte|cuenta", group=1),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", lambda v: ~v.rlike("^(?:000|666|9)") & ~v.rlike("-00-") & ~v.rlike("0000$"), 0.3, "ssn|social|security"),
)


def _of_kind(text: Column, order: int, k: Kind) -> Column:
    """The confirmed and scored spans of one kind."""

    def score(s: Column) -> Column:
        return F.lit(k.sure) + F.when(F.concat_ws(" ", s.before, s.after).rlike(rf"(?i)(?<![a-z0-9_])(?:{k.context})(?![a-z0-9_])"), CONTEXT_GAIN).otherwise(0.0)

    spans = spans_where(text.rlike(k.quick), located(text, k.pattern, k.group, AROUND))
    spans = F.filter(spans, lambda s: k.confirm(s["value"]))
    if k.group:
        end = lambda s: s.start + F.length(s["value"])
        spans = apart(F.transform(spans, lambda s: F.struct(s.start.alias("start"), end(s).alias("end"), s["value"].alias("value"), s.before.alias("before"), s.after.alias("after"))))
    some = marked(spans, order, k.kind, score)
    return some if k.base else F.filter(some, lambda s: s.score >= LEAST)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per row of docs: ROW_KEY, doc_id, spans: array of (start, ord, end, kind, score) in order.

    Proposals are leftmost and non-overlapping for each kind; what a checksum or range denies is dropped, without another try, but for
    account numbers, which are tried at each beginning with their country's length (codes of other countries are none; one that begins inside the
    one before is dropped). A context word within AROUND characters, seen over one neighbouring match of the kind at most, raises a span's score; kinds that are not base kinds need LEAST. Null texts count as empty; rows without
    personal data have an empty array. Ids may be null or repeat. An empty table gives no rows; other columns are not read.
    One pass over the texts, nothing is shuffled.
    """
    keyed = with_row_key(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    found = [_of_kind(F.col("text"), order, k) for order, k in enumerate(kinds)]
    return keyed.select(*ROW_KEY, "doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def personal_data_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, the number of spans of each base kind, the digest of the base spans, all spans as a string, and their scores in the same order."""
    found = find_personal_data(docs, id_col, text_col, kinds)
    scores = F.array_join(F.transform("spans", lambda s: F.format_string("%.1f", s.score)), ",")
    return digests(found, [k.kind for k in kinds if k.base], scores.alias("scores"))
