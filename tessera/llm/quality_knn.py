"""Quality scores by nearest-neighbour voting among latent-semantic vectors.

Features of a whole text: counts of hashed words, of hashed word shapes (runs of upper
case, lower case, digits, each other sign kept) and of shape pairs, each with the usual
1 + log weighting, plus how much of the text repeats itself. Latent vectors come from a
truncated singular value decomposition (by subspace iteration) of the labelled rows'
weighted feature matrix.

The labelled rows are a bounded sample: the ``max_labelled`` rows with the least hash
of their key. Tasks reduce their whole texts to sparse feature rows; the driver gets
these (``max_labelled`` x ``FEATURES`` numbers at most), fits, and broadcasts the projection
and the labelled vectors, both of a size fixed by parameters. Every document is projected
and compared with all labelled vectors: exact cosine products, a block of documents at a
time. Its ``neighbours`` nearest vote with their similarity to the power ``sharpness``.

Null and empty texts have no features: they get the share of label 1 among the labelled
rows, as does every text if there are no labels at all (then 0.5). Ties in similarity
are broken by the order of the labelled rows' hashes.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Growing, free_name, text_slices

WORDS, SHAPES, PAIRS, REPEATS = 2048, 512, 1024, 16
FEATURES = WORDS + SHAPES + PAIRS + REPEATS
MAX_LABELLED, DIMENSIONS, NEIGHBOURS, SHARPNESS = 4096, 64, 25, 4.0
BLOCK = 256
#: Of the subspace iteration: spare dimensions, rounds and the seed of its start.
EXTRA, ROUNDS, SEED = 16, 6, 7
VOCABULARY = 250_000
#: Weight of each group of features after it is scaled to length one.
WEIGHTS = (1.0, 2.0, 2.0, 1.5)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 11)


@functools.lru_cache(1 << 14)
def _shape_hash(form: str) -> int:
    return _hash(form)


SIGNS = ".,;:!?\"'()[]*#$%&|"


def shape(word: str) -> str:
    """Upper, lower, digits and signs of a word, runs as one."""
    if word.isalpha():
        if word.islower():
            return "a"
        if word.isupper():
            return "A"
        if word[1:].islower():
            return "Aa"
    out = ""
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if out[-1:] != k:
            out += k
    return out


class Vocabulary:
    """Raw words to hash buckets; a cache that starts anew when full."""

    def __init__(self, size: int = VOCABULARY) -> None:
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.word, self.shape = Growing(np.int64), Growing(np.uint64)

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, word buckets and shape hashes of words."""
        if len(self.ids) > self.size:
            self.clear()
        ids = list(map(self.ids.get, words))
        if None in ids:
            new = {w for w, i in zip(words, ids, strict=True) if i is None}
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            self.word.extend([_hash(w.strip(SIGNS).lower() or w) % WORDS for w in new])
            self.shape.extend([_shape_hash(shape(w)) for w in new])
            ids = list(map(self.ids.__getitem__, words))
        ids = np.array(ids, np.int64)
        return ids, self.word.data[ids], self.shape.data[ids]


def _scaled(counts: np.ndarray, weight: float) -> np.ndarray:
    out = np.zeros(len(counts), np.float32)
    hit = counts > 0
    out[hit] = 1 + np.log(counts[hit])
    norm = float(np.sqrt((out * out).sum()))
    return out * (weight / norm) if norm else out


def features(text: str | None, vocabulary: Vocabulary) -> np.ndarray:
    """The feature vector of one whole text."""
    words = text.split() if text else []
    if not words:
        return np.zeros(FEATURES, np.float32)
    ids, word, form = vocabulary.look_up(words)
    pair = (form[:-1] * np.uint64(0x9E3779B97F4A7C15) + form[1:]) >> np.uint64(33)
    # Shares of repeated words and word pairs, as soft marks on two scales.
    near = ids[:-1] * np.int64(1 << 31) + ids[1:]
    fresh = [len(np.unique(x)) / max(1, len(x)) for x in (ids, near)]
    marks = np.zeros(REPEATS, np.float32)
    half = REPEATS // 2
    for k, share in enumerate(fresh):
        at = share * (half - 1)
        low = min(int(at), half - 2)
        marks[k * half + low] += 1 - (at - low)
        marks[k * half + low + 1] += at - low
    return np.concatenate([
        _scaled(np.bincount(word, minlength=WORDS), WEIGHTS[0]),
        _scaled(np.bincount((form % np.uint64(SHAPES)).astype(np.int64), minlength=SHAPES),
                WEIGHTS[1]),
        _scaled(np.bincount((pair % np.uint64(PAIRS)).astype(np.int64), minlength=PAIRS),
                WEIGHTS[2]),
        marks * (WEIGHTS[3] / max(1e-6, float(np.sqrt((marks * marks).sum()))))])


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray         # FEATURES
    projection: np.ndarray  # FEATURES x dimensions
    vectors: np.ndarray     # dimensions x labelled, unit columns
    labels: np.ndarray      # labelled, 0 or 1
    prior: float
    neighbours: int
    sharpness: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Scores of a block of feature vectors."""
        out = np.full(len(rows), self.prior)
        if not len(self.labels):
            return out
        latent = _unit((rows * self.idf) @ self.projection)
        told = np.flatnonzero((latent != 0).any(axis=1))
        if not len(told):
            return out
        near = latent[told] @ self.vectors
        k = min(self.neighbours, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(near, best, axis=1), 0, 1).astype(np.float64)
        weight = weight ** self.sharpness
        total = weight.sum(axis=1)
        vote = (weight * self.labels[best]).sum(axis=1)
        # One pseudo-neighbour of little weight votes with the prior.
        out[told] = (vote + 1e-3 * self.prior) / (total + 1e-3)
        return np.clip(out, 0, 1)


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label",
        max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS,
        neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS) -> Model:
    """Fit on the bounded sample of the labelled rows."""
    vocabulary: list[Vocabulary] = []

    @F.arrow_udf("place array<int>, value array<float>")
    def sparse(texts: pa.Array) -> pa.Array:
        if not vocabulary:
            vocabulary.append(Vocabulary())
        places, values = [], []
        for part in text_slices(texts):
            for t in part:
                x = features(t, vocabulary[0])
                hit = np.flatnonzero(x)
                places.append(hit.tolist())
                values.append(x[hit].tolist())
        return pa.StructArray.from_arrays(
            [pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
            names=["place", "value"])

    # Keys first: the sample is chosen without moving texts.
    used = rows.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"),
                       F.col(text).alias("text")).where("key IS NOT NULL AND label IS NOT NULL")
    chosen = (used.select("key", F.xxhash64("key").alias("h")).orderBy("h", "key")
              .limit(max_labelled))
    edge = chosen.agg(F.max("h")).first()[0]
    if edge is None:
        return Model(np.ones(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32),
                     np.zeros((1, 0), np.float32), np.zeros(0), 0.5, neighbours, sharpness)
    told = (used.where(F.xxhash64("key") <= edge)
            .withColumn("x", sparse("text")).select("key", "label", "x.place", "x.value")
            .orderBy(F.xxhash64("key"), "key", "label").limit(max_labelled).toArrow())
    n = told.num_rows
    x = np.zeros((n, FEATURES), np.float32)
    for i, (place, value) in enumerate(zip(told.column("place"), told.column("value"),
                                           strict=True)):
        x[i, np.array(place.as_py(), np.int64)] = value.as_py()
    y = told.column("label").to_numpy().astype(np.float64).clip(0, 1)
    idf = (np.log((n + 1) / ((x > 0).sum(axis=0) + 1)) + 0.5).astype(np.float32)
    idf[-REPEATS:] = 1
    x *= idf
    # Leading right singular vectors of x by subspace iteration: memory stays at a few
    # times x, whatever the number of features.
    size = min(dimensions, FEATURES, n)
    basis = np.random.default_rng(SEED).standard_normal(
        (FEATURES, min(FEATURES, size + EXTRA))).astype(np.float32)
    for _ in range(ROUNDS):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    turn = np.linalg.svd(x @ basis, full_matrices=False)[2]
    projection = np.ascontiguousarray(basis @ turn[:size].T, np.float32)
    vectors = np.ascontiguousarray(_unit(x @ projection).T)
    return Model(idf, projection, vectors, y, float(y.mean()), neighbours, sharpness)


def scorer(spark: SparkSession, model: Model):
    """A column function: text -> score."""
    shared = spark.sparkContext.broadcast(model)
    vocabulary: list[Vocabulary] = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        known = shared.value
        if not vocabulary:
            vocabulary.append(Vocabulary())
        parts = [known.score(np.stack([features(t, vocabulary[0]) for t in part]))
                 for part in text_slices(texts, BLOCK)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The rows with their score. If the name is taken, the input's column stays and the new
    one gets a number (``score_2``)."""
    return docs.withColumn(free_name(docs, name),
                           scorer(docs.sparkSession, model)(F.col(f"`{text}`")))
