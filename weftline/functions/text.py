"""Text expressions: folding, name cleaning and numbers. Every function takes and returns a Column."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.constants import AFTER_MARKERS, BEFORE_MARKERS, DROP_TOKENS, FILLER, GENERIC, LEGAL

#: Word boundaries by ASCII letters, as look-arounds: Java's \b counts letters of every script.
LEFT, RIGHT = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
#: The same by letters, marks and digits of every script.
WIDE_LEFT, WIDE_RIGHT = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"
NON_LATIN = r"[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]"
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
#: Legal forms that are also written with spaces.
SPACED_FORMS = ("sarl", "sasu", "sas", "eurl", "pllc", "llc", "llp", "pc")
DOMAINS = ("com", "net", "org", r"co\.in", "in", "fr", "biz", "info", "us")


@F.arrow_udf(T.StringType())
def nfkd(text: pa.Array) -> pa.Array:
    """Unicode compatibility decomposition, which Spark has no function for; one Arrow kernel for a batch."""
    return pc.utf8_normalize(text, form="NFKD")


def replaced(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Regular replacements one after the other."""
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def folded(text: Column) -> Column:
    """Decomposed, without accents on Latin letters, lower case."""
    return F.lower(F.regexp_replace(nfkd(text), r"(\p{IsLatin})\p{Mn}+", "$1"))


def clean_name(text: Column) -> Column:
    """The first name cleaner: words of letters, marks and digits, one space between."""
    rules = [(rf"{WIDE_LEFT}m/s{WIDE_RIGHT}", " "), (rf"\.com{WIDE_RIGHT}|{WIDE_LEFT}www\.", " "), ("&", " and "), (r"\.", ""), (NOT_WORD, " ")]
    return F.trim(replaced(folded(text), rules))


def tokens(cleaned: Column) -> Column:
    """Words of a cleaned text; none of an empty one."""
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def core_tokens(text: Column) -> Column:
    """Words of a name without legal forms and fillers (first cleaner)."""
    return F.filter(F.split(clean_name(text), " "), lambda t: (t != "") & ~t.isin(DROP_TOKENS))


def is_non_latin(text: Column) -> Column:
    """Whether any letter is of a script other than Latin; false for null."""
    return F.coalesce(text.rlike(NON_LATIN), F.lit(False))


def clean_name_v1(text: Column, after: Sequence[str] | None = None, before: Sequence[str] | None = None) -> Column:
    """The second name cleaner. after / before: markers whose following / preceding text is the name (None: the defaults; empty: none)."""
    after, before = AFTER_MARKERS if after is None else after, BEFORE_MARKERS if before is None else before
    rules = [("[‌‍]", "")]
    if after:
        rules.append((rf"(?s)^.*?{LEFT}(?:{'|'.join(after)}){RIGHT}[:\s]*", ""))
    if before:
        rules.append((rf"\s*\(?{LEFT}(?:{'|'.join(before)}){RIGHT}.*$", ""))
    rules += [(rf"{LEFT}m/s{RIGHT}", " "), (rf"https?://|{LEFT}www\.", " "), (rf"\.(?:{'|'.join(DOMAINS)}){RIGHT}", " "), ("[&+@]", " "), (r"\.", ""), (NOT_WORD, " ")]
    rules += [(LEFT + " ?".join(form) + RIGHT, form) for form in SPACED_FORMS]
    return F.trim(replaced(folded(text), rules))


def name_tokens_v1(text: Column, after: Sequence[str] | None = None, before: Sequence[str] | None = None) -> Column:
    return tokens(clean_name_v1(text, after, before))


def core_from_tokens(words: Column) -> Column:
    """Drops legal forms and fillers, and the generic words at the end if a legal form stands before them."""
    run = F.aggregate(words, F.lit(0), lambda n, w: F.when(w.isin(GENERIC), n + 1).otherwise(0))  # generic words at the end
    legal = F.array_position(F.transform(words, lambda w: w.isin(LEGAL)), F.lit(True))  # from 1; 0: none
    facts = F.struct(words.alias("words"), (F.size(words) - run).alias("tail"), legal.alias("legal"))
    # one element that holds the facts, so that they are computed once and not for each word
    kept = F.transform(F.array(facts), lambda f: F.filter(f.words, lambda w, i: ~w.isin(LEGAL) & ~w.isin(FILLER) & ~((i >= f.tail) & (f.legal > 0) & (f.legal <= i + 1))))
    return F.when(words.isNotNull(), kept[0])


def numbers(text: Column) -> Column:
    """Sorted distinct digit groups without leading zeros, as strings."""
    groups = F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda d: F.regexp_replace(d, "^0+", ""))
    return F.array_sort(F.array_distinct(F.filter(groups, lambda d: d != "")))


def numbers_int(text: Column) -> Column:
    """Sorted distinct positive digit groups; of long ones the last nine digits."""
    groups = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0)), lambda d: F.right(d, F.lit(9)).try_cast("long"))
    return F.array_sort(F.array_distinct(F.filter(groups, lambda d: d > 0)))
