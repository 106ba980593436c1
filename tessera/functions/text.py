"""Text and key functions (all JVM-side Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog as C


#: The characters that ``(?U)\\s`` matches.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                          0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_header(c) -> Column:
    """Header normal form — null → '', whitespace runs → one space, trim, lower.

    ``(?U)`` makes ``\\s`` match Unicode spaces (NBSP, line separators), which
    Java's default character class would leave in place.
    """
    x = _col(c).cast("string")
    return F.coalesce(F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), F.lit(""))


def clean_key(c) -> Column:
    """Text key — null → '', strip Unicode whitespace at both ends."""
    x = _col(c).cast("string")
    return F.coalesce(F.btrim(x, F.lit(WHITE)), F.lit(""))


def segment_line(c) -> Column:
    """segment text → line of business by case-insensitive prefix, else 'Other'."""
    low = F.lower(clean_key(c))
    expr = None
    for prefix, line in C.LINE_PREFIXES:
        cond = low.startswith(prefix)
        expr = F.when(cond, F.lit(line)) if expr is None else expr.when(cond, F.lit(line))
    return expr.otherwise(F.lit(C.OTHER_LINE))


def segment_wind_only(c) -> Column:
    """segment text mentions 'wind only' (any case)."""
    return F.lower(clean_key(c)).contains(C.WIND_ONLY_TEXT)


def segment_family(c) -> Column:
    """product family — the text between the line prefix and the wind suffix."""
    alts = "|".join(p for p, _ in C.LINE_PREFIXES)
    x = F.regexp_replace(clean_key(c), rf"(?i)^({alts})\s*-?\s*", "")
    x = F.regexp_replace(x, r"(?i)\s*-?\s*wind only.*$", "")
    return F.trim(x)


def period_text(year, quarter) -> Column:
    """`YYYYQn` from integer year and quarter columns."""
    return F.concat(_col(year).cast("string"), F.lit("Q"), _col(quarter).cast("string"))


def period_of(ts) -> Column:
    """`YYYYQn` of a date/timestamp."""
    return period_text(F.year(_col(ts)), F.quarter(_col(ts)))


def period_key(c) -> Column:
    """sortable integer year*10 + quarter of a `YYYYQn` text."""
    p = _col(c)
    return (F.substring(p, 1, 4).cast("int") * 10 + F.substring(p, -1, 1).cast("int"))


def period_end(c) -> Column:
    """Quarter-end date of a `YYYYQn` text."""
    p = _col(c)
    y = F.substring(p, 1, 4).cast("int")
    q = F.substring(p, -1, 1).cast("int")
    return F.last_day(F.make_date(y, q * 3, F.lit(1)))


def short_name(c, limit: int = 34, keep: int = 32) -> Column:
    """names longer than ``limit`` → first ``keep`` characters + '…'."""
    x = _col(c)
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, keep), F.lit("…"))).otherwise(x)


def short_segment(c) -> Column:
    """the first occurrence of each line prefix → 'C: ' / 'P: '."""
    x = _col(c)
    for long, short in C.SHORT_LINE_PREFIXES:
        x = F.regexp_replace(x, "(?s)^(.*?)" + long.replace("-", r"\-"), "$1" + short)
    return x


def marked_segment(segment, wind_only) -> Column:
    """F16: wind marker before wind-only segments, then the short form."""
    mark = F.when(_col(wind_only), F.lit(C.WIND_MARK)).otherwise(F.lit(""))
    return F.concat(mark, short_segment(segment))


def naic_sort_keys(c) -> list[Column]:
    """Q10: deterministic tie order — integer-like keys ascending, then text.

    Integers without leading zeros compare by their number of digits, then digit by
    digit, whatever their length.
    """
    x = _col(c)
    digits = F.when(x.rlike(r"^(0|[1-9][0-9]*)$"), F.length(x))
    return [digits.asc_nulls_last(), x.asc()]


def title_period(title) -> Column:
    """SRC10: period from an explicit date range in the title (end date), if any.

    Recognises 'M/D/YYYY' and 'Month D, YYYY' end dates; the file-name period
    stays authoritative, this is a cross-check column.
    """
    t = _col(title)
    d1 = F.try_to_timestamp(F.regexp_extract(t, r"-\s*(\d{1,2}/\d{1,2}/\d{4})", 1),
                            F.lit("M/d/yyyy"))
    d2 = F.try_to_timestamp(F.regexp_extract(t, r"-\s*([A-Za-z]+ \d{1,2}, \d{4})", 1),
                            F.lit("MMMM d, yyyy"))
    d = F.coalesce(d1, d2)
    return F.when(d.isNotNull(), F.concat(F.year(d).cast("string"), F.lit("Q"),
                                          F.quarter(d).cast("string")))
