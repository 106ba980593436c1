"""Small tables with the awkward cases every operator must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = ["key", "raw", "size", "prefix", "print", "free", "component", "label", "score",
            "chunk", "words", "n", "ids", "start", "_text", "items", "cover", "host", "_row", "_key",
            "_gone", "_bit", "_probable", "_set_row", "_all", "_h", "_own", "_told", "_found0", "row",
            "told", "lang_pred", "contaminated", "longest_run"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
                    for _ in range(n))


def awkward_rows(seed: int = 1) -> list[tuple]:
    """Nulls, empty and very long texts, copies, near copies and repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, 60) for _ in range(12)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "b", None), (21, base[0].replace(" ", "\n\t"), None, None, 1),
             (22, base[1] + " ", "en", "a", 5), (23, "", "en", "a", 0), (24, None, "en", "a", None),
             (25, " \t\n", None, "a", 3), (26, "!!! ... 123", "en", "a", 9),
             (27, prose(rng, 30_000), "en", "a", 7), (28, base[2] + " zz " + base[3], "en", "a", 1),
             (29, "word " * 500, "en", "a", 1), (None, base[4], "en", "a", 1),
             (30, "Ünï 中文   x y <|endoftext|>", "en", "a", 1)]
    return rows + [rows[3], rows[3], (5, base[6], "en", "z", 2)]


def awkward(spark, rows=None, clashing: bool = True):
    df = spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit("x") for c in CLASHING})
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()
