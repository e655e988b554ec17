"""Column helpers with one fixed meaning: rounding, guarded statistics, plurals, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round halves towards plus infinity: floor(x * 10**digits + 0.5) / 10**digits."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def mean_of_cents(cents: Column, n: Column) -> Column:
    """The mean of n amounts whose sum is given in cents, to one decimal, halves away from zero. In whole numbers, so that neither the order of the amounts nor a half decides; null without amounts."""
    x, d = F.abs(cents) + 5 * n, F.nullif(10 * n, F.lit(0))
    return F.signum(cents) * ((x - x % d) / d) / 10


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sd(x: Column) -> Column:
    """Sample standard deviation, 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's correlation from sums, 0 where a side does not vary."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 1e-12) & (vy > 1e-12), (n * sxy - sx * sy) / F.sqrt(vx * vy)).otherwise(0.0)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Slavic rule: 1, 21, ... one; 2 to 4, 22 to 24, ... few; else many; 11 to 14 many."""
    tens, ones = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    return F.when(tens.between(11, 14), many).when(ones == 1, one).when(ones.between(2, 4), few).otherwise(many)


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Replace {name} by its value; unknown names stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("-")))
    return template


def significant(x: Column, digits: int = 2) -> Column:
    """x to so many significant digits; 0 stays 0."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.floor(x * scale + 0.5) / scale)


def sum_of(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def median_of(xs: Column) -> Column:
    """Median of an array (0 if empty): the mean of the two middle values for an even number."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        low, high = F.get(s, F.floor((n - 1) / F.lit(2)).cast("int")), F.get(s, F.floor(n / F.lit(2)).cast("int"))
        return F.when(n == 0, 0.0).otherwise((low + high) / 2)

    return F.transform(F.array(F.array_sort(xs)), middle)[0]  # as an array of one, so that it is sorted once
