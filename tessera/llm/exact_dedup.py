"""Exact duplicate texts by progressive refinement.

Three rounds, each on what the one before could not settle:

1. rows are grouped by the length of the normalised text;
2. rows that share a length are grouped by a hash of the text's first part;
3. only rows that share length and prefix hash have their whole text hashed
   (SHA-256), and equal hashes are one group.

One scan computes length and prefix hash, and rounds 1 and 2 exchange these with a
count after a map-side sum. Pairs that survive become a set of hash bits of a fixed size,
which is broadcast; a second scan reads the whole content of the rows whose pair may be in it.
So no text is ever shuffled; rounds 2 and 3 then decide exactly on rows of a few numbers.
A group that holds a third of all rows is a join key whose other side is one small row
of a written table, which Spark's skew join splits. Everything is built from SQL functions.

Texts are equal when identical after deleting every separator character. Of a
group, the row with most code points in its original text stays, then the one
with the smallest key. Rows that agree in both are interchangeable: exactly one
stays. A null text is an empty text and all of those form one group; null keys
sort before others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import (
    SEPARATORS,
    probable_set,
    text_or_empty,
    with_probable,
    without_keys,
)
from tessera.session import materialize

PREFIX_CHARS = 256


def _sized(docs: DataFrame, key: str, text: str, prefix_chars: int) -> DataFrame:
    raw = text_or_empty(text)
    norm = F.translate("raw", SEPARATORS, "")
    return docs.select(F.col(key).alias("key"), raw.alias("raw")).select(
        "key", "raw", F.length("raw").alias("size"), F.length(norm).alias("length"),
        F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("prefix"))


def _whole_hash():
    return F.sha2(F.translate("raw", SEPARATORS, "").cast("binary"), 256)


def refine(docs: DataFrame, key: str = "doc_id", text: str = "text",
           prefix_chars: int = PREFIX_CHARS, settle_hash: bool = False) -> DataFrame:
    """One row per input row: key, size (code points), length (normalised), prefix,
    alive (shares both with another row), full_hash (null where not alive, unless
    ``settle_hash`` asks for the digest of every row)."""
    rows = _sized(docs, key, text, prefix_chars)
    pairs = rows.groupBy("length", "prefix").agg(F.count(F.lit(1)).alias("n"))
    # Round 1 settles rows alone in their length; round 2 counts the pairs of the rest.
    lengths = (pairs.groupBy("length").agg(F.sum("n").alias("rows"))
               .where("rows > 1").select("length"))
    alive = materialize(pairs.where("n > 1").join(lengths, "length", "left_semi")
                        .select("length", "prefix", F.lit(True).alias("alive")), "exact-pairs")
    told = with_probable(rows, probable_set(alive, "length", "prefix"), "length", "prefix")
    whole = _whole_hash()
    told = told.select(
        "key", "size", "length", "prefix",
        (whole if settle_hash else F.when(F.col("_probable"), whole)).alias("full_hash"))
    told = told.join(alive, ["length", "prefix"], "left")
    keep_hash = F.col("full_hash") if settle_hash else F.when(F.col("alive"), F.col("full_hash"))
    return told.select("key", "size", "length", "prefix",
                       F.coalesce("alive", F.lit(False)).alias("alive"),
                       keep_hash.alias("full_hash"))


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text",
         prefix_chars: int = PREFIX_CHARS, settle_hash: bool = False) -> DataFrame:
    """One row per input row: key, keep_key, group_size, kept, full_hash, and the
    length and prefix that round 1 and 2 compared."""
    rows = materialize(refine(docs, key, text, prefix_chars, settle_hash), "exact-rows")
    settled = rows.where("NOT alive").select(
        "key", F.col("key").alias("keep_key"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "full_hash", "length", "prefix")
    # Rows equal in size and key collapse here; n carries how many there were.
    copies = (rows.where("alive").groupBy("full_hash", "length", "prefix", "size", "key")
              .agg(F.count(F.lit(1)).alias("n")))
    order = F.struct((-F.col("size")).alias("shorter"), F.col("key").alias("key"))
    groups = materialize(copies.groupBy("full_hash").agg(
        F.min(order).alias("best"), F.sum("n").alias("group_size")), "exact-groups")
    first = ((F.col("size") == -F.col("best.shorter"))
             & F.col("key").eqNullSafe(F.col("best.key")))
    told = copies.join(groups, "full_hash").select(
        "key", F.col("best.key").alias("keep_key"), "group_size", first.alias("first"),
        "full_hash", "length", "prefix",
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    told = told.select("key", "keep_key", "group_size",
                       (F.col("first") & (F.col("copy") == 1)).alias("kept"),
                       "full_hash", "length", "prefix")
    return settled.unionByName(told)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text",
                prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows go by key. Keys that both stay and go (a repeated key) are looked at row
    by row; of interchangeable rows the first by all columns as JSON stays.
    """
    marks = materialize(mark(docs, key, text, prefix_chars), "exact-marks")
    fates = marks.groupBy("key").agg(F.count_if("kept").alias("stay"),
                                     F.count_if(~F.col("kept")).alias("go"))
    gone = materialize(fates.where("go > 0"), "exact-gone")
    kept = without_keys(docs, key, gone, "key")
    mixed = gone.where("stay > 0").select(F.col("key").alias("_gone"))
    if mixed.isEmpty():
        return kept
    winners = marks.where("kept").select(
        F.col("key").alias("_key"), F.col("length").alias("_length"),
        F.col("prefix").alias("_prefix"), F.col("full_hash").alias("_hash"))
    # A row travels as one value, so its columns meet no name of this function.
    again = docs.select(F.struct("*").alias("_row"), F.col(f"`{key}`").alias("_own")).join(
        mixed, F.col("_own").eqNullSafe(F.col("_gone")), "left_semi").withColumn(
        "_all", F.to_json("_row"))
    raw = text_or_empty(F.col(f"_row.`{text}`"))
    norm = F.translate(raw, SEPARATORS, "")
    again = again.withColumns({
        "_l": F.length(norm), "_p": F.xxhash64(F.substring(norm, 1, prefix_chars)),
        "_h": F.sha2(norm.cast("binary"), 256), "_size": F.length(raw)})
    on = (F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_l") == F.col("_length"))
          & (F.col("_p") == F.col("_prefix"))
          & (F.col("_hash").isNull() | (F.col("_hash") == F.col("_h"))))
    nth = F.row_number().over(Window.partitionBy("_key", "_h")
                              .orderBy(F.col("_size").desc(), "_all"))
    again = again.join(winners, on).withColumn("_nth", nth).where("_nth = 1")
    return kept.unionByName(again.select("_row.*"))
