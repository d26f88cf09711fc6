"""Small tables of names and addresses that reach every rule, and what the rules give, worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = [
    ("Café Du Monde S.A.R.L.", "cafe du monde sarl|cafe du monde"), ("Coex Ltd Services Services", "coex ltd services services|coex"), ("X Services Ltd", "x services ltd|x services"),
    ("G1obal Traders L L C", "g1obal traders llc|g1obal traders"), ("M/s. Dlp & Brothers Private Limited", "dlp brothers private limited|dlp brothers"), ("www.holleybrands.com", "holleybrands|holleybrands"),
    ("Nexbelo DBA Psv Education Ltd", "nexbelo|nexbelo"), ("Old Shop formerly Vela Corp", "vela corp|vela"),
]
ADDRESSES = [
    ("US", "N1211 Ii, Town Of Richford, WI", "wi", "ii n1211 richford town", "n1211 ii town of richford wi"), ("US", "5 Oak St, Fort Washington, MD", "md", "fort oak street", "5 oak street fort md"),
    ("US", "12 Elm Ct, Hartford, CT", "ct", "court elm hartford", "12 elm court hartford court"),
    ("India", "Shop No. 4B 22, Maharashtra, Thane, Highland Corporate Center, Old Bhiwandi Road", "mh", "4b bhiwandi center corporate highland old road thane", "shop no 4b 22 thane highland corporate center old bhiwandi road"),
    ("France", "2 Rue De Rouen, Lille", None, "lille rouen rue", "2 rue de rouen lille"), ("Atlantis", "7 The Quay, Null", None, "quay", "7 the quay null"), ("US", None, None, None, None),
]
NATIVE = [(1, "al x", False), (2, "al y", False), (3, "al z", False), (4, "tech ell", False), (5, "a b c", False), (101, "அல் எக்ஸ்", True), (102, "அல் ஒய்", True), (103, "அல் ஜெட்", True), (104, "டெக் அல்", True), (105, "அல்", True)]


def rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def _literal(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _names_sql() -> str:
    out = []
    for name, expected in NAMES:
        toks, core = expected.split("|")
        out.append(f"({_literal(name)}, {_literal(toks)}, {_literal(core)}, {_literal(core.replace(' ', ''))}, {_literal(' '.join(sorted(core.split())))})")
    return f"SELECT * FROM (VALUES {', '.join(out)}) t(name, tokens, core, k1, k2)"


NAMES_SQL = _names_sql()
ADDRESSES_SQL = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in ADDRESSES) + ") t(country, business_address, state, addr_toks, addr_str)"
# the first native token has three partners 'al' and one 'ell'; the others have a single one and are dropped
NATIVE_SQL = "SELECT 'அல்' AS native, 'al' AS latin, CAST(3 AS BIGINT) AS support, CAST(0.75 AS DOUBLE) AS share"
