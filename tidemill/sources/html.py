"""Rows of statistics tables in page HTML, by expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import let
from tidemill.functions.text import parse_number, plain_text

HEADER_WORDS = ("transaction", "volume", "month")

# One character stands for each tag that matters; a cell's is followed by d or h.
OPEN, CLOSE, END, ROW, CELL = "\x1b", "\x1c", "\x1d", "\x1e", "\x1f"
MARKS = (
    (r"(?i)<t([dh])\b[^>]*>", CELL + "$1"), (r"(?i)</t(?:[dhr]|body)\b[^>]*>", END), (r"(?i)<tr\b[^>]*>", ROW),
    (r"(?i)<table\b[^>]*>", OPEN), (r"(?i)</table\b[^>]*>", CLOSE),
)
OTHER_TAG = r"<[/!?a-zA-Z][^>\x1b-\x1f]*>"


def has_table(html: Column) -> Column:
    return F.contains(F.lower(html), F.lit("<table"))


def _marked(html: Column) -> Column:
    """A page as plain text with marks in place of table tags; each pattern scans the page once."""
    out = F.regexp_replace(html, r"[\x1b-\x1f]", "")
    for pattern, mark in MARKS:
        out = F.regexp_replace(out, pattern, mark)
    return plain_text(F.regexp_replace(out, OTHER_TAG, ""))


def _pieces(text: Column, mark: str) -> Column:
    """What follows each mark, up to the next."""
    return F.slice(F.split(text, mark), F.lit(2), F.lit(1 << 30))


def _until(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def _tables(html: Column) -> Column:
    """Marked contents of the tables of a page in order of their opening; a nested table is left out of its outer one.

    A fold over the opening tags keeps the tables still open. A table without an end reaches to that of the
    table around it, or of the page.
    """
    pieces = _pieces(_marked(html), OPEN)
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("open"), none.alias("owners"), F.array().cast("array<string>").alias("texts"), F.lit(0).alias("count"))

    def add(state: Column, piece: Column) -> Column:
        segments = F.split(piece, CLOSE)
        stack = F.concat(F.array(state["count"]), state["open"])  # innermost first
        # every end closes the innermost table: segment k belongs to the k-th one, text outside all tables to -1
        owners = F.transform(segments, lambda _, k: F.coalesce(F.get(stack, k), F.lit(-1)))
        left = F.slice(stack, F.size(segments), F.size(stack))
        return F.struct(
            left.alias("open"), F.concat(state["owners"], owners).alias("owners"),
            F.concat(state["texts"], segments).alias("texts"), (state["count"] + 1).alias("count"),
        )

    def contents(state: Column) -> Column:
        def own(k: Column) -> Column:
            return F.array_join(F.filter(state["texts"], lambda _, at: F.get(state["owners"], at) == k), "")

        return F.when(state["count"] > 0, F.transform(F.sequence(F.lit(0), state["count"] - 1), own))

    return let(F.aggregate(pieces, start, add), contents)


def _rows(table: Column) -> Column:
    """Cells of every row: text from a cell's tag to its end, the row's or the next cell."""
    return F.transform(_pieces(table, ROW), _cells)


def _cells(row: Column) -> Column:
    return F.transform(_pieces(row, CELL), lambda c: F.trim(F.substring(_until(c, END), 2, 1 << 30)))


def _headings(table: Column) -> Column:
    heads = F.filter(_pieces(table, CELL), lambda c: F.lower(F.substring(c, 1, 1)) == "h")
    return F.transform(heads, lambda c: F.lower(F.trim(F.substring(_until(_until(c, END), ROW), 2, 1 << 30))))


def first_table_rows(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Month, volume and value of the first table: first row skipped, at least three cells."""
    with_table = pages.where(has_table(F.col(html)))
    first = F.get(_tables(F.col(html)), F.lit(0))

    def record(c: Column) -> Column:
        # every row is parsed once, inside the array: filters below see finished columns
        return F.struct(
            F.size(c).alias("cells"), F.get(c, F.lit(0)).alias("month"),
            parse_number(F.get(c, F.lit(1))).alias("volume"), parse_number(F.get(c, F.lit(2))).alias("value"),
        )

    rows = with_table.select(page_id, F.posexplode(F.transform(_rows(first), record)).alias("row_no", "_t"))
    rows = rows.where((F.col("row_no") >= 1) & (F.col("_t.cells") >= 3) & (F.col("_t.month") != "") & F.col("_t.volume").isNotNull())
    return rows.select(page_id, "row_no", "_t.month", "_t.volume", "_t.value")


def matching_table_rows(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Cells of the first table per page that has a telling header and any data row of two cells or more."""
    with_table = pages.where(has_table(F.col(html)))

    def parse(table: Column) -> Column:
        # the first row is left out before its cells are parsed
        later = F.slice(_pieces(table, ROW), F.lit(2), F.lit(1 << 30))
        data = F.filter(F.transform(later, _cells), lambda c: F.size(c) >= 2)
        return F.struct(_headings(table).alias("headers"), data.alias("data"))

    def telling(t: Column) -> Column:
        named = F.exists(t["headers"], lambda h: h.rlike("|".join(HEADER_WORDS)))
        return named & (F.size(t["data"]) > 0)

    tables = F.filter(F.transform(_tables(F.col(html)), parse), telling)
    picked = with_table.select(page_id, F.explode(F.slice(tables, 1, 1)).alias("_t"))  # a filter would parse again
    return picked.select(page_id, F.col("_t.headers").alias("headers"), F.posexplode("_t.data").alias("row_no", "cells"))
