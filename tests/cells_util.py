"""Cells DataFrames for tests."""

from tessera.operators.grid import CELLS_SCHEMA


def cells_df(spark, path, rows):
    """A cells DataFrame from a list of rows (None = empty cell), 1-based positions."""
    data = []
    for r, row in enumerate(rows, start=1):
        if row is None:
            continue
        for c, v in enumerate(row, start=1):
            if v is None:
                continue
            kind = "n" if isinstance(v, (int, float)) and not isinstance(v, bool) else (
                "b" if isinstance(v, bool) else "s")
            raw = ("TRUE" if v else "FALSE") if isinstance(v, bool) else str(v)
            data.append((path, r, c, kind, raw))
    return spark.createDataFrame(data, CELLS_SCHEMA)
