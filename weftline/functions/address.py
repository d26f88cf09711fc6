"""Address parsing by country: state, informative tokens, cleaned string and native tokens, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import constants as K
from weftline.functions.text import LEFT, NON_LATIN, NOT_WORD, RIGHT, folded, replaced, tokens


@dataclass(frozen=True)
class Country:
    """How addresses of a country are read. code_first: a state's code wins over its name."""

    names: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    abbreviations: dict[str, str] = field(default_factory=dict)
    stop: tuple[str, ...] = ()
    has_codes: bool = True
    code_first: bool = False

    @property
    def codes(self) -> list[str]:
        return sorted({*self.names.values(), *self.aliases}) if self.has_codes else []


COUNTRIES = {
    "US": Country(K.US_STATES, {}, K.US_ABBREVIATIONS, (*K.COMMON_STOP, *K.US_STOP), code_first=True),
    "India": Country(K.INDIAN_STATES, K.INDIAN_ALIASES, K.INDIAN_ABBREVIATIONS, (*K.COMMON_STOP, *K.INDIAN_STOP)),
    "France": Country(K.FRENCH_REGIONS, {}, K.FRENCH_ABBREVIATIONS, (*K.COMMON_STOP, *K.FRENCH_STOP), has_codes=False),
}
OTHER = Country(stop=tuple(K.COMMON_STOP))
#: What parsing adds to a record.
PARSED = ("state", "addr_toks", "addr_str", "addr_native")


def clean_address(text: Column) -> Column:
    return F.trim(replaced(F.regexp_replace(folded(text), "[‌‍]", ""), [(rf"{LEFT}(?:n/a|c/o){RIGHT}", " "), (NOT_WORD, " ")]))


def looked_up(table: dict[str, str], key: Column, keep: bool = False) -> Column:
    """The entry of a fixed table, else null, or with keep the key itself."""
    if not table:
        return key if keep else F.lit(None).cast("string")
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(entries, key)
    return F.coalesce(found, key) if keep else found


def _parsed(clean: Column, c: Country) -> Column:
    """The parts of a cleaned address as a struct."""
    by_name, stripped = F.lit(None).cast("string"), clean
    if c.names:
        names = LEFT + "(" + "|".join(sorted(c.names, key=lambda n: (-len(n), n))) + ")" + RIGHT
        by_name = looked_up(c.names, F.try_element_at(F.regexp_extract_all(clean, F.lit(names), F.lit(1)), F.lit(-1)))
        stripped = F.regexp_replace(clean, names, " ")
    words = tokens(stripped)
    by_code = F.lit(None).cast("string")
    if c.codes:
        by_code = looked_up(c.aliases, F.try_element_at(F.filter(words, lambda w: w.isin(c.codes)), F.lit(-1)), keep=True)
    written = F.transform(words, lambda w: looked_up(c.abbreviations, w, keep=True))
    tells = F.filter(written, lambda w: ~w.isin(*c.stop, *c.codes) & ~w.rlike("^[0-9]+$") & (F.length(w) > 1) & ~w.rlike(NON_LATIN))
    return F.struct(
        (F.coalesce(by_code, by_name) if c.code_first else F.coalesce(by_name, by_code)).alias("state"),
        F.array_sort(F.array_distinct(tells)).alias("addr_toks"),
        F.array_join(written, " ").alias("addr_str"),
        F.array_sort(F.array_distinct(F.filter(written, lambda w: w.rlike(NON_LATIN)))).alias("addr_native"),
    )


def with_address(records: DataFrame, address: str = "business_address", country: str = "country") -> DataFrame:
    """records with PARSED columns; one pass over all countries, unknown and null ones read generically; null addresses give nulls."""
    cleaned = records.withColumn("_clean", clean_address(F.col(address)))
    clean, parts = F.col("_clean"), None
    for name, c in COUNTRIES.items():
        parts = F.when(F.col(country) == name, _parsed(clean, c)) if parts is None else parts.when(F.col(country) == name, _parsed(clean, c))
    parsed = cleaned.withColumn("_parts", F.when(clean.isNotNull(), parts.otherwise(_parsed(clean, OTHER))))
    return parsed.select(*records.columns, *[F.col(f"_parts.{p}").alias(p) for p in PARSED])
