"""An n-gram index for entity search (P7-P9): substrings without scanning every name.

``name_grams`` has one row per n-gram and entity that has it in its display name, a historic
name or its key; ``gram_counts`` one row per n-gram with its number of entities. Both are tables
to publish beside the companies, ``name_grams`` sorted by gram, so a look-up of some grams opens
only the row groups that may hold them (``In`` filters reach the scan).

A search takes the query's rarest grams (their counts are a few rows), keeps the entities
that have all of them, and checks the substring itself on those: the result is that of
``search.search_entities``. A query shorter than a gram scans, as that does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import search_entities

SIZE = 3
#: Grams of a query that are looked up; the rest is left to the check of the substring.
LOOKED_UP = 3


def grams_of(text: Column, size: int = SIZE) -> Column:
    """The distinct n-grams of a lower-cased text."""
    low = F.lower(text)
    at = F.when(F.length(low) >= size, F.sequence(F.lit(1), F.length(low) - (size - 1)))
    return F.array_distinct(F.coalesce(
        F.transform(at, lambda i: F.substring(low, i, F.lit(size))),
        F.array().cast("array<string>")))


def name_grams(companies: DataFrame, size: int = SIZE) -> DataFrame:
    """gram, naic: one row per entity and gram of any of its names or its key."""
    texts = F.concat(F.array("name", "naic"), F.coalesce("names", F.array().cast("array<string>")))
    held = F.array_distinct(F.flatten(F.transform(
        F.filter(texts, lambda t: t.isNotNull()), lambda t: grams_of(t, size))))
    rows = companies.select("naic", F.explode(held).alias("gram")).select("gram", "naic")
    # A gram that most entities have spreads over ranges of its entities.
    return rows.repartitionByRange("gram", "naic").sortWithinPartitions("gram", "naic")


def gram_counts(grams: DataFrame) -> DataFrame:
    """gram, entities."""
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("entities"))


def index_tables(companies: DataFrame, size: int = SIZE) -> dict[str, DataFrame]:
    """The tables of the index, to publish with the dataset."""
    grams = name_grams(companies, size)
    return {"name_grams": grams, "gram_counts": gram_counts(grams)}


def search_index(companies: DataFrame, grams: DataFrame, counts: DataFrame, query: str = "",
                 size: int = SIZE) -> DataFrame:
    """P7 through the index: the rows of ``search_entities(companies, query)``."""
    low = (query or "").lower()
    wanted = list(dict.fromkeys(low[i:i + size] for i in range(len(low) - size + 1)))
    if not wanted:
        return search_entities(companies, query)
    # One row per gram of the query.
    known = {r.gram: r.entities for r in counts.where(F.col("gram").isin(wanted)).collect()}
    rare = sorted(wanted, key=lambda g: (known.get(g, 0), g))[:LOOKED_UP]
    if any(g not in known for g in rare):
        return search_entities(companies.limit(0), query)
    found = grams.where(F.col("gram").isin(rare)).groupBy("naic").agg(
        F.count_distinct("gram").alias("n")).where(F.col("n") == len(rare))
    return search_entities(companies.join(found.select("naic"), "naic", "left_semi"), query)
