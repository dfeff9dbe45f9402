"""Scalar column functions shared by the operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds per hour and per day.
MS_PER_HOUR = 3_600_000.0
MS_PER_DAY = 86_400_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Empty string -> NULL (the source treats '' like a missing value)."""
    return F.nullif(_col(c), F.lit(""))


# Money is summed as DECIMAL(38, 18): exact, so totals do not depend on how the
# data is split (float sums do), and with 18 places no small cost is lost.
MONEY_TYPE = "decimal(38,18)"


def money_units(c: Column | str) -> Column:
    """Amount as a decimal that sums exactly."""
    return _col(c).cast(MONEY_TYPE)


def from_units(units: Column | str) -> Column:
    return _col(units).cast("double")


def money_sum(c: Column | str) -> Column:
    """Exact sum of amounts (an aggregate expression), as a double."""
    return from_units(F.sum(money_units(c)))


def _tie_fix(c: Column, digits: int) -> Column:
    """Java's DecimalFormat rounds a value whose shortest form is exactly
    5e-(n+1) (rounding position before its first digit) half-even on that
    form, where Python uses the exact binary value. For that one value the
    correct result is known up front: compare the double with the decimal."""
    tie = 5 * 10.0 ** -(digits + 1)
    up = Decimal(tie) > Decimal(5) * Decimal(10) ** -(digits + 1)
    return F.when(F.abs(c) == F.lit(tie), F.signum(c) * F.lit(10.0 ** -digits if up else 0.0)).otherwise(c)


def _format(c: Column, pattern: str) -> Column:
    """``format_number`` with a DecimalFormat pattern (no digit grouping),
    rounding half-even on the exact binary value like Python's ``format``."""
    digits = len(pattern.split(".")[1]) if "." in pattern else 0
    return F.call_function("format_number", _tie_fix(c, digits), F.lit(pattern))


def py_round(c: Column | str, digits: int) -> Column:
    """Round half-even on the exact binary value, like Python's ``round(x, n)``.

    ``F.round`` rounds half-up on the decimal string and ``F.bround`` rounds the
    shortest decimal string; both differ from Python on a few percent of
    3-decimal inputs. ``format_number`` with a plain pattern (no grouping)
    rounds the exact value half-even, which is Python's rule.
    """
    pattern = "0." + "0" * digits if digits > 0 else "0"
    return _format(_col(c), pattern).cast("double")


def money_text(c: Column | str) -> Column:
    """``f"{x:.2f}"``."""
    return _format(_col(c), "0.00")


def percent_text(c: Column | str) -> Column:
    """``f"{x:.1%}"`` (value times 100, one decimal, percent sign)."""
    return F.concat(_format(_col(c) * F.lit(100.0), "0.0"), F.lit("%"))


def utc_day(ms: Column | str) -> Column:
    """Epoch milliseconds -> 'yyyy-MM-dd' of the UTC day, in any session time zone."""
    return F.date_from_unix_date(F.floor(_col(ms) / F.lit(MS_PER_DAY)).cast("int")).cast("string")


def workers_from(num_workers: Column, min_workers: Column, max_workers: Column, strategy: str = "average") -> Column:
    """Workers billed: ``num_workers`` when set (0 counts), else the autoscale
    bounds by strategy (``max``, ``min``, anything else = midpoint), else 0."""
    lo, hi = min_workers.cast("double"), max_workers.cast("double")
    if strategy == "max":
        scaled = hi
    elif strategy == "min":
        scaled = lo
    else:
        scaled = (lo + hi) / F.lit(2.0)
    return F.coalesce(num_workers.cast("double"), scaled, F.lit(0.0))


def worker_count(spec: Column | str, strategy: str = "average") -> Column:
    """Workers billed for a cluster spec struct (see :func:`workers_from`)."""
    spec = _col(spec)
    return workers_from(spec["num_workers"], spec["autoscale"]["min_workers"], spec["autoscale"]["max_workers"], strategy)
