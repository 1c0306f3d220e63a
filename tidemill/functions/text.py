"""Parsing of month names, figures and HTML tables as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.columns import dbl, let

# Month abbreviations.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Unit suffixes and the factor that brings each to millions, in the order tried.
SUFFIX_TO_MILLIONS = (("M", 1.0), ("B", 1000.0), ("K", 0.001), ("Cr", 10.0))

# Entities that occur in published statistics tables.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

FLOAT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def parse_month(text: Column) -> Column:
    """First day of a month written like "Apr-16", "Jan 2016" or "apr/16".

    Two-digit years below 50 are 20xx, others 19xx; four-digit years are taken
    as they are. An unknown month name counts as January; anything without a
    whole-number year is null.
    """
    parts = F.split(F.trim(F.regexp_replace(F.lower(text), r"[\s/-]+", " ")), " ")
    numbers = F.create_map(*chain.from_iterable((F.lit(m), F.lit(i)) for i, m in enumerate(MONTHS, 1)))
    month = F.coalesce(numbers[F.substring(F.get(parts, F.lit(0)), 1, 3)], F.lit(1))
    token = F.get(parts, F.lit(1))
    year = F.when(token.rlike(r"^\d{1,4}$"), token.try_cast("int"))
    full = F.when(year < 50, year + 2000).when(year < 100, year + 1900).when(year >= 1000, year)
    return F.when(full.isNotNull(), F.make_date(full, month, F.lit(1)))


def _float(text: Column) -> Column:
    return F.when(text.rlike(FLOAT), text.try_cast("double"))


def parse_number(text: Column) -> Column:
    """Figure in millions: separators dropped, M / B / K / Cr suffixes applied, null if unreadable."""
    def read(bare: Column) -> Column:
        tries = []
        for suffix, factor in SUFFIX_TO_MILLIONS:
            tries.append(F.when(bare.contains(suffix), _float(F.replace(bare, F.lit(suffix), F.lit(""))) * dbl(factor)))
        return F.coalesce(*tries, _float(bare))

    return let(F.translate(text, ", ", ""), read)


def coerce_numeric(text: Column) -> Column:
    """Number with separators removed, null if it is not one."""
    return _float(F.regexp_replace(text.cast("string"), "[, ]", ""))


def plain_text(text: Column) -> Column:
    """Common entities decoded, white space collapsed and trimmed."""
    out = text
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    # single spaces, nearly all white space, need no change
    return F.trim(F.regexp_replace(out, r"\s{2,}|[\t\n\x0B\f\r]", " "))


def strip_tags(html: Column) -> Column:
    """Text of an HTML fragment: tags removed, common entities decoded, trimmed."""
    return plain_text(F.regexp_replace(html, r"(?s)<[^>]*>", ""))
