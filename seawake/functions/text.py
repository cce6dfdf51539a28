"""Normalisation of identifiers, ports, destinations and vessel types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of destinations and vessel types, in the order in which they are tried.
DESTINATION_ALIASES = {
    "RU LED": "RULED", "RULED": "RULED", "LT KLJ": "LTKLJ", "LTKLJ": "LTKLJ", "SE GOT": "SEGOT", "SEGOT": "SEGOT",
    "SE KAR": "SEKAR", "SEKAR": "SEKAR", "FI HEL": "FIHEL", "FIHEL": "FIHEL",
}
VESSEL_ALIASES = (
    ("tanker", "tanker"), ("oil tanker", "tanker"), ("chemical tanker", "tanker"), ("gas tanker", "tanker"),
    ("cargo ship", "cargo"), ("general cargo", "cargo"), ("bulk carrier", "cargo"), ("container ship", "container"), ("container", "container"),
    ("ro-ro cargo", "cargo"), ("passenger", "passenger"), ("passenger ship", "passenger"), ("tug", "service"), ("pilot", "service"),
    ("service", "service"), ("fishing", "service"), ("other", "unknown"), ("unknown", "unknown"),
)


def identifier(c: Column) -> Column:
    """Trimmed; `266232000.0` becomes `266232000`; null becomes empty."""
    return F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), r"^(\d+)\.0+$", "$1")


def locode(c: Column) -> Column:
    """Upper case without spaces; NAN and NONE are empty."""
    x = F.upper(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit("")))
    return F.when(x.isin("NAN", "NONE"), "").otherwise(x)


def named(c: Column) -> Column:
    """Trimmed text, `unknown` where there is none."""
    x = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.upper(x).isin("", "NAN", "NONE"), "unknown").otherwise(x)


def vessel_type(c: Column) -> Column:
    return F.lower(named(c))


def destination(c: Column) -> Column:
    """Upper case, punctuation to spaces, aliases, five letters in one word where they are a code; UNKNOWN where nothing is
    left."""
    up = F.trim(F.upper(F.coalesce(c, F.lit(""))))
    x = F.trim(F.regexp_replace(F.regexp_replace(up, "[^A-Z0-9 ]+", " "), " +", " "))
    tight = F.replace(x, F.lit(" "), F.lit(""))
    table = F.create_map(*(F.lit(v) for kv in DESTINATION_ALIASES.items() for v in kv))
    known = F.coalesce(F.try_element_at(table, x), F.try_element_at(table, tight))
    coded = F.when(tight.rlike("^[A-Z]{5}$"), tight).otherwise(x)
    return F.when(up.isin("", "NAN", "NONE") | (x == ""), "UNKNOWN").otherwise(F.coalesce(known, coded))


def plain_destination(c: Column) -> Column:
    """Upper case with single spaces."""
    return F.regexp_replace(F.upper(F.trim(c)), r"\s+", " ")


def digits(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c.cast("string"), r"\D", ""), F.lit(""))


def number(c: Column) -> Column:
    """A double; a comma may be the decimal point; null where it is no finite number."""
    x = F.expr("cast(null as double)") if c is None else F.coalesce(c.try_cast("double"), F.replace(c.cast("string"), F.lit(","), F.lit(".")).try_cast("double"))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def moment(c: Column) -> Column:
    """A timestamp in the session's zone (UTC), null where the text is none."""
    return F.try_to_timestamp(c.cast("string"))


def five_letter_code(c: Column) -> Column:
    return F.regexp_extract(c, "^([A-Z]{5})$", 1)


def port_key(code: Column, name: Column) -> Column:
    """The code, or else the upper-cased name with underscores."""
    return F.when(locode(code) != "", locode(code)).otherwise(F.replace(F.upper(named(name)), F.lit(" "), F.lit("_")))


def port_label(code: Column, name: Column) -> Column:
    return F.when(locode(code) != "", F.concat(named(name), F.lit(" ("), locode(code), F.lit(")"))).otherwise(named(name))


def country(code: Column) -> Column:
    """The first two letters of a code, UNK where it is too short."""
    return F.when(F.length(F.coalesce(code, F.lit(""))) < 2, "UNK").otherwise(F.upper(F.left(code, F.lit(2))))


def vessel_class(c: Column) -> Column:
    """An exact alias, else the first alias that the text contains, else unknown."""
    x = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    exact = F.try_element_at(F.create_map(*(F.lit(v) for kv in VESSEL_ALIASES for v in kv)), x)
    part = F.lit("unknown")
    for alias, kind in reversed(VESSEL_ALIASES):
        part = F.when(x.contains(alias), kind).otherwise(part)
    return F.coalesce(exact, part)


def truth(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes")


def alnum(c: Column) -> Column:
    """Upper-cased letters and digits only, to compare codes and call ids."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def first_known(*cs: Column) -> Column:
    """The first value that is neither null, empty nor `unknown`."""
    return F.coalesce(*(F.when(~F.lower(F.trim(c)).isin("", "unknown", "nan", "none"), F.trim(c)) for c in cs))


def chunk_texts(c: Column, size: int, overlap: int) -> Column:
    """Slices of `size` characters, `overlap` shared with the next; a short tail stays; empty text has none."""
    stride = max(1, size - overlap)
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), F.length(c) - 1, F.lit(stride)), lambda i: F.substring(c, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def tokens(c: Column) -> Column:
    """Distinct lower-cased word tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0)))


def overlap_share(a: Column, b: Column) -> Column:
    """The part of `a`'s tokens that are in `b`."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def novel(a: Column, b: Column) -> Column:
    """Whether `a` has tokens that `b` lacks."""
    return F.size(F.array_except(a, b)) > 0
