"""Text helpers: labels, parsing of dumped fields, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(prefix: str, ident: Column) -> Column:
    """``'Topic ' + id`` and the like."""
    return F.concat(F.lit(prefix), F.lit(" "), ident.cast("string"))


def strip_cast(text: Column, head: int, tail: int, kind: str) -> Column:
    """Drop ``head`` leading and ``tail`` trailing characters, then cast; bad text gives null."""
    return F.substring(text, F.lit(head + 1), F.length(text) - F.lit(head + tail)).try_cast(kind)


def split_line(text: Column, sep: str = "\t") -> Column:
    """Trim a line and split it at ``sep``."""
    return F.split(F.btrim(text, F.lit(" \t\r\n")), sep.replace("|", r"\|"))


def percent_text(part: Column, total: Column) -> Column:
    """Percent of the total with three significant digits, ``< 0.1%`` below a tenth."""
    p = F.when(total != 0, part * 100.0 / total)
    digits = F.format_string("%.3g", p)
    small = digits.cast("double") < 0.1
    return F.when(p.isNull(), None).when(small, F.lit("< 0.1%")).otherwise(F.concat(digits, F.lit("%")))


def value_or_na(y: Column, digits: int = 2) -> Column:
    return F.coalesce(F.format_number(y, digits), F.lit("N/A"))


def fmt_number(y: Column, digits: int = 2) -> Column:
    """Thousands separators and a fixed number of decimals."""
    return F.format_number(y, digits)


def fmt_percent(y: Column) -> Column:
    """Share as a whole percent."""
    return F.concat(F.round(y * 100).cast("bigint").cast("string"), F.lit("%"))


def fmt_date(ts: Column, pattern: str = "MM/dd/yyyy") -> Column:
    return F.date_format(ts, pattern)


def ancestors(path: Column) -> Column:
    """Names on the way to a node, root left out."""
    return F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0)))


def slice_label(kind: str, key: Column, value: Column, share: Column, threshold: float = 0.02) -> Column:
    """Text on a share: key, value or percent; empty when the share is below ``threshold``."""
    body = {"key": key.cast("string"), "value": fmt_number(value), "percent": fmt_percent(share)}[kind]
    hidden = (value == 0) | (share < threshold)
    return F.when(F.coalesce(hidden, F.lit(True)), F.lit("")).otherwise(body)
