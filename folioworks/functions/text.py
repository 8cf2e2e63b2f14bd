"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: what is cut from the end of a URL or domain found in running text.
TRAILING = ".,;:)'\"`]"


def strip(c: Column) -> Column:
    """``c`` without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines(c: Column) -> Column:
    """The lines of a text; a line break at its end doesn't begin another one."""
    return F.split(F.regexp_replace(c, r"(?:\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")


def token_estimate(c: Column) -> Column:
    """About four characters a token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def word_count(c: Column) -> Column:
    """The number of runs without white space."""
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"\s+")))


def sorted_set(c: Column) -> Column:
    """The distinct elements in code-point order."""
    return F.array_sort(F.array_distinct(c))


def joined(c: Column, empty: str, separator: str = ", ") -> Column:
    """The elements joined, or ``empty`` if there are none."""
    return F.when(F.size(c) > 0, F.array_join(c, separator)).otherwise(F.lit(empty))


def refang(c: Column) -> Column:
    """Defanged indicators as they are used: ``[.]``, ``(.)``, ``hxxp``, ``[at]`` and ``(@)``."""
    for written, meant in (("[.]", "."), ("(.)", "."), ("hxxp://", "http://"), ("hxxps://", "https://"), ("[at]", "@"), ("(@)", "@")):
        c = F.replace(c, F.lit(written), F.lit(meant))
    return c


def trim_trailing(c: Column) -> Column:
    return F.rtrim(c, F.lit(TRAILING))


def minutes_seconds(c: Column) -> Column:
    """Seconds as ``MM:SS``, rounded down."""
    return F.format_string("%02d:%02d", F.floor(c / 60).cast("long"), F.floor(c % 60).cast("long"))


def title_case(c: Column) -> Column:
    """A key such as ``slide_deck`` as ``Slide Deck``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def kilobytes(c: Column) -> Column:
    return F.round(c / 1024, 2)


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


@F.pandas_udf(StringType())
def _composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def normalize_text(c: Column, compose: bool = True) -> Column:
    """Text in one form: NFC, ``\\n`` line ends, no control characters but tab, no white space at line ends.

    A text ends with one ``\\n``; one without any visible line is empty. Composition leaves the JVM only for
    texts with a character beyond ASCII; with ``compose=False`` it is left out.
    """
    if compose:
        c = F.when(c.rlike(r"[^\x00-\x7F]"), _composed(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)
    s = F.regexp_replace(c, r"\r\n|\r", "\n")
    s = F.regexp_replace(s, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    s = F.regexp_replace(s, r"[ \t]+(?=\n|\z)", "")
    s = F.regexp_replace(s, r"\n+\z", "")
    return F.when(F.regexp_replace(s, r"\n", "") == "", "").otherwise(F.concat(s, F.lit("\n")))


def truncate_utf8(c: Column, limit: int) -> Column:
    """The longest prefix of whole characters within ``limit`` bytes."""
    if limit <= 0:
        return F.when(c.isNotNull(), F.lit(""))
    raw = F.encode(c, "UTF-8")
    cuts = [F.substring(raw, 1, limit - k) for k in range(4) if limit - k > 0]
    best = F.coalesce(*[F.when(F.is_valid_utf8(x.cast("string")), x.cast("string")) for x in cuts], F.lit(""))
    return F.when(F.octet_length(c) <= limit, c).when(c.isNotNull(), best)


def clean_ocr(c: Column) -> Column:
    """Recognised text without blank lines and runs of ruling characters."""
    kept = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"([~`|_\-=*#])\1{4,}", ""))
