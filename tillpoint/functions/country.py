"""Country normalisation as a native Column expression (no Python UDF).

Semantics of the reference's scalar function: NULL -> NULL; trim
surrounding white space (JavaScript ``trim`` strips tab, NBSP, BOM, every
Unicode space separator and line terminators, not just spaces); upper-case;
look the result up among known spellings; unknown text is returned trimmed
and upper-cased; ``''`` stays ``''``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's mapping (spelling -> ISO code).
COUNTRY_SPELLINGS = {
    "UK": "GB", "UNITED KINGDOM": "GB", "GREAT BRITAIN": "GB", "ENGLAND": "GB",
    "US": "US", "USA": "US", "UNITED STATES": "US", "UNITED STATES OF AMERICA": "US",
    "DE": "DE", "GERMANY": "DE", "DEUTSCHLAND": "DE",
    "FR": "FR", "FRANCE": "FR",
    "JP": "JP", "JAPAN": "JP",
    "AU": "AU", "AUSTRALIA": "AU",
    "CA": "CA", "CANADA": "CA",
}

# White space as JavaScript's String.prototype.trim defines it.
_WS = r"[\t\n\x0B\f\r \u00A0\uFEFF\u2028\u2029\p{Zs}]"
TRIM_PATTERN = rf"^{_WS}+|{_WS}+$"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, TRIM_PATTERN, "")


def normalize_country(c: Column | str, mapping: dict[str, str] | None = None) -> Column:
    """Return the normalised country code for a string column.

    ``mapping`` replaces the built-in spellings (e.g. loaded from a table and
    passed in as a dict); it is embedded as a map literal, so the lookup
    stays inside whole-stage codegen and works as a join key.
    """
    col = F.col(c) if isinstance(c, str) else c
    m = mapping if mapping is not None else COUNTRY_SPELLINGS
    s = F.upper(js_trim(col))
    lut = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    return F.coalesce(F.try_element_at(lut, s), s)


def normalize_country_sql(expr: str, mapping: dict[str, str] | None = None) -> str:
    """The same expression as SQL text for ``spark.sql`` users."""
    m = mapping if mapping is not None else COUNTRY_SPELLINGS
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in m.items())
    s = f"upper(regexp_replace({expr}, '{TRIM_PATTERN.replace(chr(92), chr(92) * 2)}', ''))"
    return f"coalesce(try_element_at(map({pairs}), {s}), {s})"
