"""Tables written in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions.text import lines, strip

#: Fixed value: the line between a table's header and its rows.
SEPARATOR = r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)+\|?\s*$"


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), strip)


def text_tables(text: Column) -> Column:
    """The pipe tables of a text: ``array<struct<table_index, headers, rows, markdown, row_count, column_count>>``.

    Gaps and islands inside the row: a table is a run of lines between pipes (a bullet before the first
    pipe is dropped, blank lines don't end a run); the first line is the header, separator lines anywhere
    are dropped, rows are padded or cut to the header's width. Runs of one line are not tables. One fold
    over the lines, no shuffle.
    """
    cleaned = F.filter(
        F.transform(F.coalesce(lines(text), F.array().cast("array<string>")), lambda x: F.regexp_replace(strip(x), r"^[-*+]\s*(?=\|)", "")),
        lambda x: x != "",
    )
    is_row = lambda x: x.startswith("|") & x.endswith("|")
    # lines of one run are joined by line feeds; runs are parted by a form feed, which no cleaned line keeps
    marked = F.transform(cleaned, lambda x: F.when(is_row(x), F.concat(x, F.lit("\n"))).otherwise(F.lit("\f")))
    runs = F.filter(F.split(F.array_join(marked, ""), "\f+"), lambda r: r != "")
    blocks = F.filter(F.transform(runs, lambda r: F.split(F.regexp_replace(r, r"\n\z", ""), "\n")), lambda b: F.size(b) >= 2)

    def table(b: Column, i: Column) -> Column:
        headers = _cells(F.get(b, F.lit(0)))
        width = F.size(headers)
        body = F.filter(F.slice(b, 2, F.size(b)), lambda x: ~x.rlike(SEPARATOR))
        pad = lambda c: F.slice(F.concat(c, F.array_repeat(F.lit(""), width)), 1, width)
        rows = F.transform(body, lambda x: pad(_cells(x)))
        return F.struct(
            (i + 1).alias("table_index"), headers.alias("headers"), rows.alias("rows"), F.array_join(b, "\n").alias("markdown"),
            F.size(rows).alias("row_count"), width.alias("column_count"),
        )

    return F.transform(blocks, table)


def extract_tables(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per table of every text."""
    return df.select(*keys, F.inline(text_tables(F.col(text))))


def column_scores(tables: Column, name: str = "cvss") -> Column:
    """The numbers in the first column of each table whose header mentions ``name``."""

    def of(t: Column) -> Column:
        at = F.array_position(F.transform(t["headers"], lambda h: F.contains(F.lower(h), F.lit(name))), F.lit(True))
        cells = F.transform(t["rows"], lambda r: F.when(at > 0, strip(F.get(r, (at - 1).cast("int"))).try_cast("double")))
        return F.filter(cells, lambda x: x.isNotNull())

    return F.flatten(F.transform(tables, of))


def to_markdown(headers: Column, rows: Column) -> Column:
    """Headers and rows as an aligned pipe table; headers ``Col_1``, ``Col_2``, ... where there are none."""
    headers = F.when(
        (F.size(headers) == 0) & (F.size(rows) > 0),
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.get(rows, F.lit(0))))), lambda i: F.concat(F.lit("Col_"), i.cast("string"))),
    ).otherwise(headers)
    width = lambda i: F.greatest(
        F.length(F.get(headers, i)), F.coalesce(F.array_max(F.transform(rows, lambda r: F.length(F.coalesce(F.get(r, i), F.lit(""))))), F.lit(0))
    )
    place = F.sequence(F.lit(0), F.size(headers) - 1)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = line(F.transform(headers, lambda h, i: F.rpad(h, width(i), " ")))
    rule = line(F.transform(headers, lambda h, i: F.repeat(F.lit("-"), F.greatest(F.lit(3), width(i)))))
    body = F.transform(rows, lambda r: line(F.transform(place, lambda i: F.rpad(F.coalesce(F.get(r, i), F.lit("")), width(i), " "))))
    return F.when(F.size(headers) == 0, "").otherwise(F.array_join(F.concat(F.array(head, rule), body), "\n"))
