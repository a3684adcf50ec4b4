"""Column functions that show money, percentages and ages as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUPEE, DASH = "₹", "—"


def decimal_fixed(x: Column, digits: int) -> Column:
    """Rounded half up from the shortest decimal that stands for the number: 1.005 is 1.01."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def fixed(x: Column, digits: int) -> Column:
    """Rounded from the number's exact binary value, a tie away from zero: 1.005 is 1.00, 0.125 is 0.13.

    format_number rounds exact values but ties to even; a tie has an odd multiple of a power of two below the
    last place, and is moved off by a fraction of it.
    """
    size = F.abs(x)
    doubled = size * float(2 ** (digits + 1))
    tie = (doubled == F.floor(doubled)) & (F.pmod(doubled, F.lit(2.0)) == 1)
    shown = F.replace(F.format_number(F.when(tie, size + 10.0 ** -(digits + 2)).otherwise(size), digits), F.lit(","), F.lit(""))
    return F.concat(_sign(x), shown)


def indian_grouping(x: Column, digits: int, rounded=fixed) -> Column:
    """Of a number that is not negative: the last three digits, then pairs."""
    text = rounded(x, digits)
    whole = F.regexp_replace(F.substring_index(text, ".", 1), r"(?<=\d)(?=(\d\d)*\d{3}$)", ",")
    return F.concat(whole, F.regexp_extract(text, r"\..*$", 0))


def _sign(x: Column) -> Column:
    return F.when(x < 0, "-").otherwise("")


def _scaled(x: Column, small: Column, units: tuple[tuple[float, int, str], ...]) -> Column:
    shown = None
    for size, digits, unit in units:
        text = F.concat(indian_grouping(F.abs(x) / size, digits), F.lit(unit))
        shown = (F if shown is None else shown).when(F.abs(x) >= size, text)
    return shown.otherwise(small)


def format_inr(x: Column) -> Column:
    """Crores and lakhs to two places, less as a grouped whole number."""
    return F.concat(_sign(x), F.lit(RUPEE), _scaled(x, indian_grouping(F.abs(x), 0), ((1e7, 2, "Cr"), (1e5, 2, "L"))))


def format_inr_full(x: Column) -> Column:
    return F.concat(_sign(x), F.lit(RUPEE), indian_grouping(F.abs(x), 0))


def format_price(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit(RUPEE), _sign(x), indian_grouping(F.abs(x), 2, decimal_fixed)), F.lit(DASH))


def format_pct(x: Column, digits: int = 1) -> Column:
    return F.coalesce(F.concat(F.when(x >= 0, "+").otherwise(""), fixed(x, digits), F.lit("%")), F.lit(DASH))


def format_sharpe(x: Column) -> Column:
    return F.coalesce(fixed(x, 2), F.lit(DASH))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def format_price_short(x: Column) -> Column:
    body = F.when(x >= 1e5, F.concat(fixed(x / 1e5, 1), F.lit("L"))).when(x >= 1000, indian_grouping(x, 0)).otherwise(fixed(x, 2))
    return F.when(_finite(x), F.concat(F.lit(RUPEE), body)).otherwise("--")


def format_yr1_pct(x: Column) -> Column:
    """A share as a signed percentage."""
    return F.when(_finite(x), format_pct(x * 100)).otherwise("--")


def fmt_rupees(x: Column) -> Column:
    body = F.when(F.abs(x) >= 1e7, F.concat(fixed(x / 1e7, 2), F.lit(" Cr"))).when(F.abs(x) >= 1e5, F.concat(fixed(x / 1e5, 1), F.lit(" L"))).otherwise(F.concat(_sign(x), indian_grouping(F.abs(x), 0)))
    return F.when(_finite(x), F.concat(F.lit(RUPEE), body)).otherwise(DASH)


def relative_age(seconds: Column) -> Column:
    """The words for an age in seconds, each unit rounded from the one before. Ages may be longer than any timestamps lie apart; null for null."""
    near = lambda x: F.floor(x + 0.5)
    minutes = near(seconds / 60)
    hours = near(minutes / 60)
    days = near(hours / 24)
    weeks = near(days / 7)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 60, "just now").when(minutes < 60, said(minutes, "m")).when(hours < 24, said(hours, "h")).when(days < 7, said(days, "d")).when(weeks < 5, said(weeks, "w")).otherwise(said(near(days / 30), "mo"))


def relative_time(then: Column, now: Column) -> Column:
    """The age of a timestamp in words; an empty text for null."""
    return F.when(then.isNull(), "").otherwise(relative_age(F.unix_timestamp(now) - F.unix_timestamp(then)))


def days_between(start: Column, end: Column) -> Column:
    """Whole days from one date to another; 0 where either is missing."""
    return F.coalesce(F.datediff(end, start), F.lit(0))
