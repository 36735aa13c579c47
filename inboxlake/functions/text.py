"""Small text, time and JSON column helpers."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(form: str, **values: Column) -> Column:
    """A text form with its ``{names}`` replaced by columns; NULL when one of them is."""
    parts = []
    for text, name, _, _ in Formatter().parse(form):
        parts += [F.lit(text)] if text else []
        parts += [values[name]] if name else []
    return F.concat(*parts)


def trim_all(c: Column) -> Column:
    """Strip every kind of white space at both ends (``F.trim`` strips spaces only)."""
    return F.regexp_replace(c, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def instant(as_of) -> Column:
    """``as_of`` as a timestamp column: a Column, or text read in the session time zone."""
    return as_of if isinstance(as_of, Column) else F.to_timestamp(F.lit(str(as_of)))


def elapsed(later: Column, earlier: Column, unit_seconds: int, minus_from: int | None = None) -> Column:
    """Time between two instants in units, one decimal, half up; or ``minus_from`` less that."""
    micros = (F.unix_micros(later) - F.unix_micros(earlier)).cast("decimal(20,0)")
    units = micros / F.lit(unit_seconds * 1_000_000).cast("decimal(20,0)")
    if minus_from is not None:
        units = F.lit(minus_from).cast("decimal(20,0)") - units
    return F.round(units, 1).cast("decimal(22,1)")


def mask_email(e: Column) -> Column:
    """``john@x.com`` -> ``j***n@x.com``; two letters or fewer keep the first only."""
    parts = F.split(e, "@")
    local, domain = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    first = F.substring(local, 1, 1)
    hidden = F.when(F.length(local) <= 2, F.concat(first, F.lit("*"))).otherwise(
        F.concat(first, F.lit("***"), F.right(local, F.lit(1)))
    )
    return F.when(F.contains(e, F.lit("@")), F.concat(hidden, F.lit("@"), domain)).otherwise(
        F.coalesce(e, F.lit(""))
    )


def stamp(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, pattern)


def first_name(name: Column) -> Column:
    return F.coalesce(F.get(F.split(trim_all(F.coalesce(name, F.lit(""))), r"\s+"), F.lit(0)), F.lit(""))


def percent_encode(c: Column) -> Column:
    """URI component encoding: form encoding with its five differences put back."""
    encoded = F.regexp_replace(F.url_encode(c), r"\+", "%20")
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return encoded


def public_url(base: Column, bucket: Column, file: Column) -> Column:
    path = F.array_join(F.transform(F.split(file, "/"), percent_encode), "/")
    return F.concat(
        F.regexp_replace(base, "/+$", ""), F.lit("/storage/v1/object/public/"), percent_encode(bucket), F.lit("/"), path
    )


def escape_html(c: Column) -> Column:
    escaped = F.coalesce(c, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    return escaped


def json_object_in(c: Column) -> Column:
    """The span from the first ``{`` to the last ``}``; NULL when there is none."""
    return blank_to_null(F.regexp_extract(c, r"(?s)\{.*\}", 0))


def by_value(key: Column, values: dict[str, object], default: Column) -> Column:
    """A fixed lookup as one CASE."""
    result = F
    for name, value in values.items():
        result = result.when(key == name, F.lit(value))
    return result.otherwise(default)
