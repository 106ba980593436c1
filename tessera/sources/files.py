"""Workbook discovery (SRC1-SRC5, SRC7, SRC9, SRC10).

The listing is a DataFrame (``binaryFile`` without reading contents), so a
folder with any number of quarters is listed by Spark's parallel file index,
and the newest-pull choice is a window over (layout, period) — a partition
holds the re-pulls of one quarter, a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.text import period_end, title_period  # noqa: F401


class NoWorkbooksError(RuntimeError):
    """SRC9: no file in the folder qualifies."""


def list_files(spark: SparkSession, folder: str, glob: str = "*.xlsx") -> DataFrame:
    """SRC1: files in one folder (not recursive): path, modificationTime, length."""
    return (spark.read.format("binaryFile")
                 .option("pathGlobFilter", glob)
                 .option("recursiveFileLookup", "false")
                 .load(folder)
                 .select("path", "modificationTime", "length"))


def base_name(path) -> F.Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def describe_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """SRC2-SRC4: layout from the name, period token, pull token.

    Adds ``name, layout ('A'|'B'|null), period, period_end, pull_ts`` ('' when none).
    """
    name = base_name(F.col(path_col))
    low = F.lower(name)
    layout = (F.when(low.contains(C.LAYOUT_B_TOKEN), F.lit("B"))
               .when(low.contains(C.LAYOUT_A_TOKEN), F.lit("A")))
    y = F.regexp_extract(low, C.PERIOD_TOKEN, 1)
    q = F.regexp_extract(low, C.PERIOD_TOKEN, 2)
    period = F.when(y != "", F.concat(y, F.lit("Q"), q))
    return (files.withColumn("name", name)
                 .withColumn("layout", layout)
                 .withColumn("period", period)
                 .withColumn("period_end", period_end(F.col("period")))
                 .withColumn("pull_ts", F.regexp_extract(low, C.PULL_TOKEN, 1)))


def newest_pulls(described: DataFrame) -> DataFrame:
    """SRC5: keep the newest pull per (layout, period); ties keep the first path.

    Files of no known layout or without a period are ignored.
    """
    ok = described.filter(F.col("layout").isNotNull() & F.col("period").isNotNull())
    w = Window.partitionBy("layout", "period").orderBy(F.col("pull_ts").desc(),
                                                        F.col("path").asc())
    return ok.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def require_files(chosen: DataFrame) -> DataFrame:
    """SRC9: fail with a message when nothing qualifies (one-row probe)."""
    if not chosen.take(1):
        raise NoWorkbooksError("no workbook with a known layout and a period token was found")
    return chosen


def title_and_pulled(grid: DataFrame) -> DataFrame:
    """SRC7: title = cell (1,1); pull date = text after 'data pulled on ' up to ')',
    else the whole cell (2,1). Returns path, title, pulled."""
    from ..operators.grid import cells_of
    # Only the first two rows are read, never the whole grid.
    top = cells_of(grid.filter(F.col("row_no") <= 2))
    first = top.filter(F.col("col_no") == 1).groupBy("path").agg(
        F.max(F.when(F.col("row_no") == 1, F.col("raw"))).alias("title"),
        F.max(F.when(F.col("row_no") == 2, F.col("raw"))).alias("_p"))
    m = F.regexp_extract(F.col("_p"), C.PULLED_ON, 1)
    pulled = F.when(m != "", F.trim(m)).otherwise(F.coalesce(F.trim(F.col("_p")), F.lit("")))
    return (top.select("path").distinct().join(first, "path", "left")
               .select("path", F.coalesce("title", F.lit("")).alias("title"),
                       pulled.alias("pulled")))
