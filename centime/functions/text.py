"""Text helpers (C1-C8), all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .dims import FALLBACK_INSIGHTS
from .money import col_


def clean_text(c) -> Column:
    """NULL -> ''; lower, trim; ASCII punctuation -> space; collapse spaces."""
    s = F.lower(F.coalesce(col_(c).cast("string"), F.lit("")))
    s = F.regexp_replace(s, r"\p{Punct}", " ")
    s = F.regexp_replace(s, r"\s+", " ")
    return F.trim(s)


def text_feature(merchant, description) -> Column:
    """C2: 'merchant merchant description', each part cleaned, trimmed."""
    m = clean_text(merchant)
    return F.trim(F.concat_ws(" ", m, m, clean_text(description)))


def strip_transaction_prefix(c) -> Column:
    """Remove a leading 'Transaction at' and trim."""
    return F.trim(F.regexp_replace(col_(c), r"^Transaction at\s*", ""))


def title_case(c) -> Column:
    """C4: first letter upper, the rest lower."""
    c = col_(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def display_description(c) -> Column:
    """Missing description shows as 'Untitled Transaction'."""
    return F.coalesce(F.nullif(col_(c), F.lit("")), F.lit("Untitled Transaction"))


def recurring_description(c) -> Column:
    """Description of a posted recurring copy."""
    return F.concat(display_description(c), F.lit(" (Recurring)"))


def money_text(c) -> Column:
    """Two decimals with thousands separators."""
    return F.format_number(col_(c), 2)


def truncated_one_decimal(c) -> Column:
    """Integer part with one decimal, as in the alert e-mail."""
    return F.format_string("%.1f", F.floor(col_(c)).cast("double"))


def strip_code_fence(c) -> Column:
    """Drop ``` / ```json fences and trim."""
    return F.trim(F.regexp_replace(col_(c), r"```(?:json)?\n?", ""))


def parse_insights(c) -> Column:
    """Reply text -> list of strings; unparsable -> the three fixed insights."""
    parsed = F.from_json(strip_code_fence(c), T.ArrayType(T.StringType()),
                         {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.array(*[F.lit(s) for s in FALLBACK_INSIGHTS]))


RECEIPT_FIELDS = ["amount", "date", "description", "merchantName", "category"]  # fixed names of the reply


def receipt_record(c) -> Column:
    """Reply text -> struct(parsed, amount, date, description, category,
    merchant_name).  ``parsed`` is false for text that is no JSON (the caller
    quarantines it); a field that is missing or of another kind is null."""
    text = strip_code_fence(c)
    r = F.from_json(text, T.StructType([T.StructField(f, T.StringType()) for f in RECEIPT_FIELDS]), {"mode": "PERMISSIVE"})
    return F.struct(F.try_parse_json(text).isNotNull().alias("parsed"),
                    r["amount"].try_cast("double").alias("amount"),
                    F.try_to_timestamp(r["date"]).cast("timestamp_ntz").alias("date"),
                    r["description"].alias("description"), r["category"].alias("category"),
                    r["merchantName"].alias("merchant_name"))


def category_amounts_text(map_col) -> Column:
    """C8: 'cat: $amt' entries joined with ', ' (empty map: empty text)."""
    return F.array_join(
        F.transform(F.map_entries(col_(map_col)),
                    lambda e: F.concat(e["key"], F.lit(": $"), e["value"].cast("string"))),
        ", ")
