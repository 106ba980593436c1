"""Display labels (F9-F13, F17) as Column expressions.

Rounding is done on DECIMAL (half away from zero) before formatting, because
``format_number`` on a double rounds half-even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog as C
from .text import _col


def _dec(x: Column) -> Column:
    return x.cast("decimal(38,10)")


def _trim_fraction(s: Column) -> Column:
    """Drop trailing zeros of the fraction only, then a dangling point."""
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def money_label(c, scale: str | int = "auto") -> Column:
    """'$' + value scaled to T/B/M/K (auto) or a fixed divisor.

    Two fraction digits at most when a suffix is shown, none otherwise;
    trailing fraction zeros are dropped.
    """
    v = _col(c)
    if scale == "auto":
        a = F.abs(v)
        div = F.lit(1.0)
        suf = F.lit("")
        for thr, d, s in reversed(C.MONEY_SCALES):
            div = F.when(a >= thr, F.lit(d)).otherwise(div)
            suf = F.when(a >= thr, F.lit(s)).otherwise(suf)
    else:
        d = int(scale)
        div, suf = F.lit(float(d)), F.lit(C.FIXED_SCALE_SUFFIX.get(d, ""))
    n = v / div
    with_suffix = _trim_fraction(F.format_number(F.round(_dec(n), 2), 2))
    no_suffix = F.format_number(F.round(_dec(n), 0), 0)
    body = F.when(suf != "", with_suffix).otherwise(no_suffix)
    return F.when(v.isNotNull(), F.concat(F.lit("$"), body, suf))


def _one_decimal(x: Column) -> Column:
    """One decimal, no grouping of thousands."""
    return F.round(_dec(x), 1).cast("decimal(38,1)").cast("string")


def pct_label(c) -> Column:
    """fraction → percent with one decimal, e.g. 0.1234 → '12.3%', 12.345 → '1234.5%'."""
    v = _col(c)
    return F.when(v.isNotNull(), F.concat(_one_decimal(v * 100), F.lit("%")))


def growth_label(c) -> Column:
    """signed percent with one decimal, '+' when ≥ 0."""
    v = _col(c)
    sign = F.when(v >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.when(v.isNotNull(), F.concat(sign, _one_decimal(v), F.lit("%")))


def count_label(c) -> Column:
    """round half toward +∞, then group thousands."""
    v = _col(c)
    return F.when(v.isNotNull(), F.format_number(F.floor(v + F.lit(0.5)), 0))


def or_dash(label: Column) -> Column:
    """null → '—', never 0."""
    return F.coalesce(label, F.lit(C.NULL_LABEL))


def metric_label(c, metric_id: str, scale: str | int = "auto") -> Column:
    """F9/F10/F12 chosen by the metric kind, with F13."""
    kind = C.metric(metric_id).kind
    if kind == "pct":
        lab = pct_label(c)
    elif kind == "money":
        lab = money_label(c, scale)
    else:
        lab = count_label(c)
    return or_dash(lab)


def labelled(df, metric_id: str, value_col: str = "value", share_col: str | None = None,
             growth_cols: tuple[str, ...] = (), scale: str | int = "auto"):
    """add ``<col>_label`` beside the raw columns, chosen by column role."""
    out = df.withColumn(f"{value_col}_label", metric_label(value_col, metric_id, scale))
    if share_col:
        out = out.withColumn(f"{share_col}_label", or_dash(pct_label(share_col)))
    for g in growth_cols:
        out = out.withColumn(f"{g}_label", or_dash(growth_label(g)))
    return out
