"""Names, set titles and recommendation text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix tokens that end a base name.
SUFFIX_TOKENS = ("ex", "EX", "GX", "V", "VMAX", "VSTAR", "BREAK", r"LV\.X", "TAG TEAM", "Prism Star")


def normalize_name(name: Column) -> Column:
    """Lower case, hyphens to spaces, quotes, dots and commas dropped."""
    return F.trim(F.translate(F.lower(name), "-'’.,", " "))


def name_key(name: Column, set_name: Column) -> Column:
    return F.concat_ws("|", normalize_name(name), normalize_name(F.coalesce(set_name, F.lit(""))))


def base_name(name: Column) -> Column:
    """Text before the first suffix token; the whole name where nothing is left."""
    head = F.trim(F.get(F.split(name, r"\s+(" + "|".join(SUFFIX_TOKENS) + r")\b", 2), F.lit(0)))
    return F.when(head == "", name).otherwise(head)


def parse_signal(text: Column) -> Column:
    up = F.upper(text)
    gather, dip = up.contains("ACCUMULATE"), up.contains("PULLBACK")
    return (
        F.when(up.contains("BUY NOW"), "buy").when(gather & ~dip, "accumulate").when(gather & dip, "watch")
        .when(up.contains("WATCH"), "watch").otherwise("hold")
    )


def parse_tier(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return (
        F.when(low.contains("premium"), "premium")
        .when(low.contains("mid-high") | low.contains("mid high"), "mid_high").when(low.contains("mid"), "mid")
    )


def set_title(group_name: Column) -> Column:
    """Group title without a leading ``CODE: ``, lower case."""
    return F.lower(F.trim(F.regexp_replace(group_name, r"^[A-Za-z0-9]+:\s*", "")))


def card_number(text: Column) -> Column:
    """Part before the slash; leading zeros go where the rest is numeric."""
    head = F.trim(F.get(F.split(text, "/"), F.lit(0)))
    return F.when(head.rlike("^[0-9]+$"), F.regexp_replace(head, "^0+(?=[0-9])", "")).otherwise(head)


def money(col: Column) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.2f", F.round(col + 1e-9, 2)))
