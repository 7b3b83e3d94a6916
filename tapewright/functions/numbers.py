"""Number expressions: rounding, clamping, costs, Indian grouping. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cost model and the futures margin.
FLAT_FEE, OPTION_SALE, FUTURE_SALE, DAY_SALE, DELIVERY = 40, 0.0015, 0.0003, 0.0003, 0.0012
FUTURES_MARGIN = 0.15


def round2(x: Column) -> Column:
    """Two decimals, halves toward plus infinity."""
    return F.floor(x * 100 + 0.5) / 100


def ratio(a: Column, b: Column) -> Column:
    """a / b by the rules of floating point: over zero it is infinite or NaN, and no error. Both are doubles."""
    over_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, over_zero).otherwise(a / b)


def clamp(p: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(p, low), high)


def trading_costs(kind: Column, buy: Column, sell: Column, same_day: Column) -> Column:
    return (
        F.when(kind == "option", FLAT_FEE + sell * OPTION_SALE)
        .when(kind == "future", FLAT_FEE + sell * FUTURE_SALE)
        .when(same_day, FLAT_FEE + sell * DAY_SALE)
        .otherwise((buy + sell) * DELIVERY)
    )


def intrinsic(spot: Column, strike: Column, opt_type: Column) -> Column:
    return F.greatest(F.lit(0.0), F.when(opt_type == "CE", spot - strike).otherwise(strike - spot))


def paise(x: Column) -> Column:
    """Decimal text to integer hundredths."""
    return F.floor(x.try_cast("double") * 100 + 0.5).cast("long")


def compound(borrowed: Column, monthly: Column, first_day: Column, last_day: Column) -> Column:
    """What is owed after whole months of 21 trading days, one at least."""
    months = F.greatest(F.lit(1), F.ceil((last_day - first_day) / 21))
    return borrowed * F.pow(1 + monthly, months)


def grouped(n: Column) -> Column:
    """Indian digit grouping of a whole number: 12,34,567."""
    digits = F.abs(n).cast("long").cast("string")
    tail, front = F.right(digits, F.lit(3)), F.substring(digits, F.lit(1), F.length(digits) - 3)
    front = F.regexp_replace(front, r"(?<=\d)(?=(?:\d\d)+$)", ",")
    return F.when(F.length(digits) <= 3, digits).otherwise(F.concat(front, F.lit(","), tail))


def rupees(x: Column, signed: bool = False) -> Column:
    """Whole rupees, halves up; signed shows plus as well as minus."""
    n = F.floor(x + 0.5)
    sign = F.when(n < 0, F.lit("−")).otherwise(F.when((n > 0) & F.lit(signed), F.lit("+")).otherwise(F.lit("")))
    return F.concat(sign, F.lit("₹"), grouped(n))


def percent(x: Column, places: int = 0) -> Column:
    return F.concat(F.format_number(x * 100, places), F.lit("%"))


def fraction_table(most: int = 21) -> list[tuple[int, int, float]]:
    """Fractions a/b with a + b from 3 to ``most``, simplest first; equal parts are no change and left out."""
    return [(a, n - a, a / (n - a)) for n in range(3, most + 1) for a in range(1, n) if a != n - a]
