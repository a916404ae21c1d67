"""Price, date and banding expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelytics import fixed_values as fv


def implied_unit_price(total: Column, size: Column) -> Column:
    return total / F.nullif(size, F.lit(0.0))


def excel_serial(date: Column) -> Column:
    """Days since the spreadsheet epoch; NULL stays NULL."""
    return F.datediff(F.to_date(date), F.lit(fv.EXCEL_EPOCH).cast("date"))


def band_grade(n: Column, cuts: Sequence[tuple[int, str]] = fv.SUPPORT_GRADES, default: str = "none") -> Column:
    """First band whose lower bound is reached."""
    out = F.lit(default)
    for lower, label in reversed(list(cuts)):
        out = F.when(n >= lower, F.lit(label)).otherwise(out)
    return out


def first_true(conditions: Sequence[tuple[Column, str]], default: str) -> Column:
    """Label of the first condition that holds."""
    out = F.lit(default)
    for condition, label in reversed(list(conditions)):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def censor_flag(col: Column, ceiling: float = fv.CENSOR_TOLERANCE) -> Column:
    return (col >= ceiling).cast("int")


def clip(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(col, F.lit(high)), F.lit(low))


def sum_skip_null(cols: Sequence[Column]) -> Column:
    """Row-wise sum where NULL counts as zero."""
    out = F.lit(0.0)
    for col in cols:
        out = out + F.coalesce(col.cast("double"), F.lit(0.0))
    return out


def mean_skip_null(cols: Sequence[Column]) -> Column:
    """Row-wise mean over the present values; NULL when none is present."""
    present = F.array_compact(F.array(*[c.cast("double") for c in cols]))
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    return total / F.nullif(F.size(present), F.lit(0))


def normal_cdf(z: Column) -> Column:
    """Standard normal CDF by the Abramowitz-Stegun 26.2.17 polynomial (absolute error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)
