"""Column-expression helpers shared by the operators.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen. Conventions:

* money is summed as ``decimal(12,2)`` inputs into a ``decimal(38,2)`` result,
  so sums are exact and independent of the summation order;
* ratios, averages and z-scores are doubles rounded to 6 places with
  ``round(x * 1e6) / 1e6`` (half away from zero);
* months are ``'yyyy-MM'`` strings.
"""

from __future__ import annotations

from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Union[Column, str]

MONEY = "decimal(12,2)"
MONEY_TOTAL = "decimal(38,2)"


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: ColumnOrName) -> Column:
    """A money value as an exact 2-place decimal."""
    return col(c).cast(MONEY)


def total(c: ColumnOrName) -> Column:
    """Cast any decimal sum/expression to the money-total type."""
    return col(c).cast(MONEY_TOTAL)


def round6(c: ColumnOrName) -> Column:
    """Round a double to 6 places, half away from zero."""
    return F.round(col(c).cast("double") * F.lit(1e6)) / F.lit(1e6)


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den`` as a double; null when ``den`` is 0 or null."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def mean_of(sum_col: ColumnOrName, count_col: ColumnOrName) -> Column:
    """Average from an exact sum and a count, rounded to 6 places."""
    return round6(ratio(sum_col, count_col))


def month_of(ts: ColumnOrName) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def quarter_of(ts: ColumnOrName) -> Column:
    c = col(ts)
    return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))


def month_index(ts: ColumnOrName) -> Column:
    """Months since year 0: consecutive calendar months differ by exactly 1."""
    c = col(ts)
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def nan_to_null(c: ColumnOrName) -> Column:
    """pandas reads NaN as missing; Spark does not. For floating columns."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def date_key(ts: ColumnOrName) -> Column:
    """``yyyymmdd`` integer key of a date or timestamp."""
    return F.date_format(col(ts), "yyyyMMdd").cast("int")


def contains_any(text: Column, words) -> Column:
    """True when ``text`` contains any of the plain substrings ``words``."""
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(text, F.lit(w))
    return cond
