"""Number functions; missing stays missing, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vendor_number(raw: Column) -> Column:
    """A vendor's figure; ``.`` and unreadable text are null."""
    return F.nullif(F.trim(raw), F.lit(".")).try_cast("double")


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def whole_number(text: Column) -> Column:
    """An integer with thousands separators; null if unreadable."""
    return F.regexp_replace(text, ",", "").try_cast("int")


def pct_change(value: Column, reference: Column) -> Column:
    return 100.0 * F.try_divide(value - reference, reference)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within the bounds; null stays null (``least`` and ``greatest`` would pass over it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ordinal(x: Column) -> Column:
    n = F.bround(x).cast("int")
    teen = F.pmod(n, F.lit(100)).between(10, 20)
    last = F.pmod(n, F.lit(10))
    suffix = F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def money(x: Column) -> Column:
    """Two-decimal money as decimal: sums do not depend on their order."""
    return x.cast("decimal(38,2)")


def direction(delta: Column) -> Column:
    return F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "flat").otherwise("none")


def text_colour(background: Column, dark: str, light: str) -> Column:
    """The readable of two text colours on a background ``#rrggbb``: the dark one where its luminance is over 150."""
    part = lambda at: F.conv(F.substring(background, at, 2), 16, 10).cast("int")
    return F.when(0.299 * part(2) + 0.587 * part(4) + 0.114 * part(6) > 150, dark).otherwise(light)
