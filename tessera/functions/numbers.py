"""Cell value cleaning and exact sums (Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE, _col

# A plain decimal number with optional sign and exponent. Everything else
# ('nan', 'inf', '1_000', '12%', '(12)', '1.0d') is not a number here, although
# Python's float() or Spark's string cast would take some of them.
NUMBER_PATTERN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"

# Decimals of the exact accumulator: a double with this many decimals or fewer
# (and up to 10^26) is summed without any rounding.
EXACT_DECIMALS = 12


def stripped(c) -> Column:
    return F.btrim(_col(c).cast("string"), F.lit(WHITE))


def is_suppressed(raw) -> Column:
    """the cell text is exactly '.' after stripping."""
    return F.coalesce(stripped(raw) == F.lit("."), F.lit(False))


def clean_number(raw, kind=None) -> Column:
    """cell → DOUBLE or null.

    Numeric cells cast directly, boolean cells give 1/0. Text: strip, drop
    ``$``, ``,`` and any Unicode whitespace, then accept only a plain decimal
    number. Blank, '-', '.', and unparsable text give null.
    """
    s = F.translate(_col(raw).cast("string"), "$," + WHITE, "")
    parsed = F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))
    if kind is None:
        return parsed
    k = _col(kind)
    return (F.when(k == "n", _col(raw).try_cast("double"))
             .when(k == "b", F.when(F.upper(stripped(raw)).isin("TRUE", "1"), F.lit(1.0))
                   .when(F.upper(stripped(raw)).isin("FALSE", "0"), F.lit(0.0)))
             .otherwise(parsed))


def exact_sum(c, decimals: int = EXACT_DECIMALS) -> Column:
    """Null-skipping sum as DOUBLE; null when every input is null (A1's rule).

    Inputs that a DECIMAL of ``decimals`` places holds exactly are summed there, so
    the result does not depend on the order in which tasks finish. If one input of
    the group is not held exactly (finer, larger, not finite), or the sum leaves the
    DECIMAL, the group's sum is a plain DOUBLE sum: no digit is cut, nothing fails.
    """
    x = _col(c).cast("double")
    d = x.try_cast(f"decimal(38,{decimals})")
    lost = F.count_if(x.isNotNull() & ~d.cast("double").eqNullSafe(x))
    return F.coalesce(F.when(lost == 0, F.try_sum(d).cast("double")), F.sum(x))


def exact_sum0(c, decimals: int = EXACT_DECIMALS) -> Column:
    """F8 / A2: the same sum with null → 0 (empty → 0)."""
    return F.coalesce(exact_sum(c, decimals), F.lit(0.0))


def safe_ratio(num, den) -> Column:
    """num / den, null when den is 0 or null (ANSI division by zero never raises)."""
    d = _col(den)
    return F.when(d != 0, _col(num) / d)


def growth_pct(now, base) -> Column:
    """(now − base) / base × 100; null when base is 0/null or now is null (Q9 keeps sign flips)."""
    n, b = _col(now), _col(base)
    return F.when(n.isNotNull() & b.isNotNull() & (b != 0), (n - b) / b * F.lit(100.0))
