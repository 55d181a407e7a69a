"""Money, ratios and dates of statements and quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import vocabulary as V


def not_nan(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def margin(part: Column, whole: Column) -> Column:
    """Percent of the whole; null where the whole is zero or either is missing."""
    return F.try_divide(part, whole) * 100


def millions(x: Column) -> Column:
    return x / 1e6


def multiple(x: Column) -> Column:
    """Two decimals; zero and missing are N/A."""
    return F.when(x.isNotNull() & (x != 0), F.replace(F.format_number(x, 2), F.lit(","), F.lit(""))).otherwise("N/A")


def money(x: Column) -> Column:
    """Whole millions with separators; zero and missing are null."""
    return F.when(x.isNotNull() & (x != 0), F.format_number(millions(x), 0))


def price(x: Column) -> Column:
    return F.when(x.isNotNull() & (x != 0), F.format_number(x, 2))


def epoch_date(seconds: Column) -> Column:
    """The date of a Unix time in the session's time zone."""
    return F.to_date(F.timestamp_seconds(seconds))


def period_note(price_text: Column, as_of: Column, ttm_end: Column, forward_end: Column) -> Column:
    """The parts that are known, joined by bars."""
    return F.concat_ws(" | ", F.concat(F.lit("股價 $"), price_text, F.lit(" as of "), as_of.cast("string")), F.concat(F.lit("TTM 截至 "), ttm_end.cast("string")), F.concat(F.lit("Forward 預估至 "), forward_end.cast("string")))


def valuation_table(multiples: list[Column], note: Column) -> Column:
    """The valuation block: title with note, header, rule and one row of right-justified cells."""
    heads = list(V.MULTIPLES.values())
    widths = [F.greatest(F.lit(len(h)), F.length(m)) for h, m in zip(heads, multiples, strict=True)]
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *(F.lpad(c, w, F.lit(" ")) for c, w in zip(cells, widths, strict=True))), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.concat_ws("|", *(F.repeat(F.lit("-"), w + 2) for w in widths)), F.lit("|"))
    title = F.when(F.length(note) > 0, F.concat(F.lit(V.VALUATION_TITLE + " ("), note, F.lit(")\n"))).otherwise(V.VALUATION_TITLE + "\n")
    return F.concat(title, row([F.lit(h) for h in heads]), F.lit("\n"), rule, F.lit("\n"), row(multiples))
