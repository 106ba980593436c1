"""Entity and segment search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import marked_segment, short_name


def search_entities(companies: DataFrame, query: str = "") -> DataFrame:
    """Case-insensitive substring in the display name, any historic name, or the key.

    Columns: naic, name, label ('<short name> · <naic>'), by name; empty query = all.
    """
    q = (query or "").lower()
    out = companies
    if q:
        hit = (F.lower(F.col("name")).contains(q) | F.col("naic").contains(q)
               | F.exists(F.col("names"), lambda n: F.lower(n).contains(q)))
        out = out.filter(hit)
    label = F.concat(short_name(F.col("name")), F.lit(" · "), F.col("naic"))
    return out.select("naic", "name", label.alias("label")).orderBy(F.lower("name"), "naic")


def entity_history(filings: DataFrame, matches: DataFrame) -> DataFrame:
    """Every fact of the matched entities, across all their names (semi join on the key)."""
    return filings.join(matches.select("naic"), "naic", "left_semi")


def search_segments(segments: DataFrame, query: str = "", line: str = "all",
                    wind_only: bool = False) -> DataFrame:
    """Segments of a line (and wind-only), case-insensitive substring; with picker label."""
    out = segments
    if line != "all":
        out = out.filter(F.col("line") == line)
    if wind_only:
        out = out.filter(F.col("is_wind_only"))
    if query:
        out = out.filter(F.lower(F.col("policy_type")).contains(query.lower()))
    label = marked_segment(F.col("policy_type"), F.col("is_wind_only"))
    return out.select("policy_type", "line", "is_wind_only", label.alias("label")).orderBy(
        "policy_type")
