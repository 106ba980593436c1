"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of characters that are not letters becomes one
space, and its 1- to 3-grams are hashed into a fixed number of buckets. Training
counts the buckets per label over **all** labelled rows it is given: each task
adds up one vector per label, Spark sums the nonzero entries per (label, bucket)
with a map-side combine, and the driver gets labels x buckets smoothed log
probabilities, a size fixed by ``buckets`` and ``max_labels``. The matrix is
broadcast; tasks score whole texts in numpy, a bounded block of n-grams at a time.

A text that is null or has no letter is ``und`` with score 0. Ties go to the
first label in code point order. The score is the posterior of the predicted
label. With no training row at all, every text is ``und``.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_name, text_slices, texts_in
from tessera.session import materialize

UNDETERMINED = "und"
BUCKETS = 1 << 15
#: Documented bound of the model: more labels than this are refused, not cut.
MAX_LABELS = 512
BLOCK = 1 << 18


@functools.cache
def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool,
                       sys.maxunicode + 1)


def ngram_buckets(text: str | None, buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of all 1- to 3-grams, in blocks; nothing if there is no letter."""
    if not text:
        return
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[code]
    if not letter.any():
        return
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first non-letter after a letter stands for its run
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    code = np.concatenate([[np.uint64(32)], code, [np.uint64(32)]]) if code[-1] != 32 else \
        np.concatenate([[np.uint64(32)], code])
    shift = np.uint64(64 - buckets.bit_length() + 1)
    for at in range(0, len(code), BLOCK):
        c = code[at:at + BLOCK + 2]
        n = min(BLOCK, len(c))
        one = c[:n] * np.uint64(0x9E3779B97F4A7C15)
        two = (c[:n - 1 if len(c) == n else n] << np.uint64(21)) + c[1:n + 1]
        three = (two[:len(c) - 2] << np.uint64(21)) + c[2:n + 2]
        yield np.concatenate([
            one >> shift,
            ((two + np.uint64(0x51ED)) * np.uint64(0xD6E8FEB86659FD93)) >> shift,
            ((three ^ (three >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift,
        ]).astype(np.int64)


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    log_prob: np.ndarray   # buckets x labels, float32
    log_prior: np.ndarray  # labels
    buckets: int

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels:
            return UNDETERMINED, 0.0
        total, seen = self.log_prior.astype(np.float64).copy(), False
        # Many labels widen a gathered row; shorter blocks keep the same memory.
        step = max(1 << 10, (1 << 21) // len(self.labels))
        for grams in ngram_buckets(text, self.buckets):
            seen = True
            for at in range(0, len(grams), step):
                total += self.log_prob.take(grams[at:at + step], axis=0).sum(
                    axis=0, dtype=np.float64)
        if not seen:
            return UNDETERMINED, 0.0
        best = int(total.argmax())
        return self.labels[best], float(1.0 / np.exp(total - total[best]).sum())


def train(rows: DataFrame, text: str = "text", label: str = "lang",
          buckets: int = BUCKETS, max_labels: int = MAX_LABELS,
          smoothing: float = 0.5) -> Model:
    """Fit on every row with a label and a text."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    schema = pa.schema([("label", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for lab, txt in texts_in(batches, "label", "text"):
            if lab not in sums:
                sums[lab], docs[lab] = np.zeros(buckets, np.int64), 0
                if len(sums) > max_labels:
                    raise ValueError(f"over {max_labels} labels: the model is bounded")
            docs[lab] += 1
            for grams in ngram_buckets(txt, buckets):
                sums[lab] += np.bincount(grams, minlength=buckets)
        for lab, vector in sums.items():
            hit = np.flatnonzero(vector)
            # Bucket -1 carries the number of rows.
            yield pa.RecordBatch.from_arrays(
                [pa.array([lab] * (len(hit) + 1), pa.string()),
                 pa.array(np.append(hit, -1).astype(np.int32)),
                 pa.array(np.append(vector[hit], docs[lab]))], schema=schema)

    used = rows.select(F.col(label).alias("label"), F.col(text).alias("text")).where(
        "label IS NOT NULL AND text IS NOT NULL")
    counted = materialize(used.mapInArrow(count, "label string, bucket int, n long")
                          .groupBy("label", "bucket").agg(F.sum("n").alias("n")), "ngrams")
    names = sorted(r.label for r in counted.select("label").distinct()
                   .limit(max_labels + 1).collect())
    if len(names) > max_labels:
        raise ValueError(f"over {max_labels} labels: the model is bounded")
    counted = counted.toArrow()  # labels x buckets numbers at most
    place = {n: i for i, n in enumerate(names)}
    if not names:
        return Model((), np.zeros((buckets, 0), np.float32), np.zeros(0), buckets)
    lab = np.array([place[x] for x in counted.column("label").to_pylist()])
    bucket = counted.column("bucket").to_numpy()
    n = counted.column("n").to_numpy()
    matrix, prior = np.zeros((buckets, len(names))), np.zeros(len(names))
    inside = bucket >= 0
    matrix[bucket[inside], lab[inside]] = n[inside]
    prior[lab[~inside]] = n[~inside]
    log_prob = np.log(matrix + smoothing) - np.log(matrix.sum(axis=0) + smoothing * buckets)
    log_prior = np.log(prior + 1) - np.log((prior + 1).sum())
    return Model(tuple(names), log_prob.astype(np.float32), log_prior, buckets)


def predictor(spark: SparkSession, model: Model):
    """A column function: text -> struct<lang: string, score: double>."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        known = shared.value
        told = [known.predict(t) for part in text_slices(texts) for t in part]
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in told], pa.string()),
             pa.array([s for _, s in told], pa.float64())], names=["lang", "score"])

    return predict


def identify(docs: DataFrame, model: Model, text: str | Column = "text",
             lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows with two more columns: predicted label and its posterior. If a name is
    taken, the input's column stays and the new one gets a number (``score_2``)."""
    col = F.col(f"`{text}`") if isinstance(text, str) else text
    told = docs.select(F.struct("*").alias("_row"),
                       predictor(docs.sparkSession, model)(col).alias("_told"))
    return told.select("_row.*", F.col("_told.lang").alias(free_name(docs, lang)),
                       F.col("_told.score").alias(free_name(docs, score)))


def keep_identified(docs: DataFrame, model: Model, text: str = "text",
                    min_score: float = 0.5) -> DataFrame:
    """The rows whose language was told with a posterior of ``min_score`` or more, with all
    their columns; texts without a letter go. A model that knows no label tells nothing about
    any text: then every text with a letter stays."""
    if not model.labels:
        return docs.where(F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(r"\p{L}"))
    own = docs.select(F.struct("*").alias("_row"), F.col(f"`{text}`").alias("_text"))
    told = identify(own, model, "_text", "_lang", "_score")
    return told.where((F.col("_lang") != UNDETERMINED) & (F.col("_score") >= min_score)).select(
        "_row.*")
