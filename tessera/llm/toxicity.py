"""Toxicity by a learned lexicon, its misspellings, and the context of each hit.

* **Lexicon.** Document frequencies of words over *all* labelled rows, split by label, are
  counted in tasks and summed by Spark, with the set of a word's toxic contexts (neighbouring
  words) as 64 hash bits. Copies of one text repeat contexts, so evidence counts different
  ones. A word becomes a term if toxic contexts beside clean documents cannot be chance (Chernoff
  bound ``n * KL(share || base) >= EVIDENCE``) and its log odds are high. A prefix that many different words share, none of them half of its toxic
  documents, becomes a stem under the same rule with twice the evidence; the shortest counts. The lexicon is bounded by ``max_terms``,
  the strongest first.
* **Levenshtein automata and a trie.** Terms and stems form a trie. Reading a word moves a set
  of (trie node, edits) pairs: the intersection of the trie with the Levenshtein automaton of
  the word. The sets are made into states of a table only when a word first reaches them, so a
  word costs one look-up a character and most words end in the empty set after a few.
  Short terms must match exactly, longer ones within one or two edits; a stem matches
  whatever follows it. Words that come near a term but are frequent in clean documents are known
  from the same counts and never match.
* **Context windows.** ``WINDOW`` words around a hit are searched for signs of quotation (quotation
  marks around it, words of reporting) and of abuse (second person, exclamation, further hits).
  A hit in quotation counts for less; its weight is a logistic function of both.
* **Score.** Logistic regression on a few numbers of a document, fitted on a bounded sample of
  labelled rows (``max_labelled`` least key hashes), pulled towards fixed weights where rows
  are few.

Defined cases: a null or empty text has no hit and gets the score of the intercept, as has every
text without a hit; without any labelled row that is ``BASE``. Rows without a label are not
learned from; repeated labelled rows count as often as they are there. One row per input
row comes out; further columns are left out. Ties between terms go to fewer edits, then the
greater weight, then the first term. The model does not depend on the rows' order.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import probable_set, text_slices, texts_in, with_probable
from tessera.session import materialize

#: Least natural logarithm of the chance against a term; 14 is about 1 : 1,200,000.
EVIDENCE = 14.0
LEAST_LOG_ODDS = 2.0
STEM_LENGTHS, STEM_WORDS = (4, 8), 5
LENGTHS = (3, 32)
#: Documented bounds of the model.
MAX_TERMS, MAX_LABELLED, MAX_SPARED = 4096, 16384, 65536
WINDOW = 6
BASE = 0.1
#: Entries of a worker's tables before they are emptied.
MAX_WORDS, MAX_MOVES = 1_000_000, 400_000
#: Weights that the fit is pulled towards: intercept, evidence, quoted evidence, what
#: misspelt terms alone would add, density. The fourth tells whether misspellings mislead.
PRIOR = np.array([-2.5, 6.0, 0.5, 0.0, 1.0])
PULL = np.array([0.05, 0.1, 0.5, 0.5, 1.0])
#: Evidence of which two thirds count in full; share that one edit leaves.
FULL, EDIT = 6.0, 0.85

# Fixed values.
QUOTES_OPEN = "\"'`“„«‹‘‚「『"
QUOTES_CLOSE = "\"'`”“»›’‘」』"
EDGES = "!#$%&()*+,-./:;<=>?@[\\]^_{|}~¡¿…–—·•" + QUOTES_OPEN + QUOTES_CLOSE
REPORTING = frozenset("""said says called calls wrote writes quote quoted quoting word words term
    sagte sagt nannte schrieb zitat wort begriff dit disait écrit citation mot terme dijo dice llamó
    escribió cita palabra término""".split())
SECOND_PERSON = frozenset("""you your you're yours u ur du dich dir dein deine ihr euch tu te toi ton
    ta vous votre tú ti tuyo usted ustedes eres vosotros""".split())
LOOKALIKES = str.maketrans("013457@$", "oieastas")


def bare(word: str) -> str:
    """A lower-cased word without signs at its ends."""
    return word.strip(EDGES)


def allowed_edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


# -- the automaton ------------------------------------------------------------------------

class Automaton:
    """Trie of terms and stems, intersected with Levenshtein automata, determinised lazily."""

    def __init__(self, terms: list[str], weights: list[float], stem: list[bool]) -> None:
        self.terms, self.weights, self.stem = terms, weights, stem
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.stems: list[int] = [-1]
        self.room = [0]
        for at, term in enumerate(terms):
            node, room = 0, self._room(at)
            self.room[0] = max(self.room[0], room)
            for ch in term:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                    self.stems.append(-1)
                    self.room.append(0)
                node = self.next[node][ch]
                self.room[node] = max(self.room[node], room)
            (self.stems if stem[at] else self.ends)[node] = at
        self.letters = {ch for kids in self.next for ch in kids}
        self.clear()

    def _room(self, at: int) -> int:
        n = len(self.terms[at])
        return allowed_edits(n) if not self.stem[at] else int(n >= 7)

    def clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0}, None)

    def _better(self, a: tuple[int, int] | None, b: tuple[int, int]) -> tuple[int, int]:
        """The better of two (edits, term)."""
        if a is None:
            return b
        return min(a, b, key=lambda x: (x[0], -self.weights[x[1]], self.terms[x[1]]))

    def _state(self, reached: dict[int, int], stem: tuple[int, int] | None) -> int:
        """Number of the state of a set of nodes with their least edits, after skipping
        letters of terms; ``stem`` is the best stem the word has gone through."""
        todo = list(reached.items())
        while todo:
            node, edits = todo.pop()
            if edits > reached.get(node, 99):
                continue
            for kid in self.next[node].values():
                if edits + 1 <= self.room[kid] and edits + 1 < reached.get(kid, 99):
                    reached[kid] = edits + 1
                    todo.append((kid, edits + 1))
        for node, edits in reached.items():
            at = self.stems[node]
            if at >= 0 and edits <= self._room(at):
                stem = self._better(stem, (edits, at))
        key = (tuple(sorted(reached.items())), stem)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
        return self.states[key]

    def _move(self, state: int, ch: str) -> int:
        nodes, stem = self.sets[state]
        reached: dict[int, int] = {}
        for node, edits in nodes:
            if edits + 1 <= self.room[node]:
                reached[node] = min(edits + 1, reached.get(node, 99))
            for letter, kid in self.next[node].items():
                cost = edits + (letter != ch)
                if cost <= self.room[kid]:
                    reached[kid] = min(cost, reached.get(kid, 99))
        return self._state(reached, stem)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, number of the term) of the best term or stem, or None."""
        if len(self.moves) > MAX_MOVES:
            self.clear()
        state = self.start
        for ch in word:
            if ch not in self.letters:
                ch = ""
            to = self.moves.get((state, ch))
            if to is None:
                to = self.moves[state, ch] = self._move(state, ch)
            state = to
            if not self.sets[state][0]:
                break
        nodes, best = self.sets[state]
        for node, edits in nodes:
            at = self.ends[node]
            if at >= 0 and edits <= self._room(at):
                best = self._better(best, (edits, at))
        return best


# -- documents ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Hit:
    place: int
    word: str
    term: str
    edits: int
    weight: float
    quoted: float


@dataclass(frozen=True)
class Lexicon:
    terms: tuple[str, ...] = ()
    weights: tuple[float, ...] = ()
    stem: tuple[bool, ...] = ()
    spared: frozenset[str] = frozenset()


class Matcher(dict):
    """Raw word → (edits, term number), or () for the many that are none."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon
        self.automaton = Automaton(list(lexicon.terms), list(lexicon.weights), list(lexicon.stem))

    def __missing__(self, raw: str):
        if len(self) > MAX_WORDS:
            self.clear()
        word, told = bare(raw), ()
        if word and word not in self.lexicon.spared:
            told = self.automaton.match(word) or ()
            if (not told or told[0]) and not word.isalpha() and any(c.isalpha() for c in word):
                plain = word.translate(LOOKALIKES)
                if plain != word and plain not in self.lexicon.spared:
                    told = self.automaton.match(plain) or told
        self[raw] = told
        return told

    def hits(self, text: str | None) -> tuple[list[Hit], int]:
        """The hits of a whole text and its number of words."""
        words = text.lower().split() if text else []
        told = list(map(self.__getitem__, words))
        places = [i for i, t in enumerate(told) if t]
        return [self._hit(words, told, i, places) for i in places], len(words)

    def _hit(self, words, told, at: int, places: list[int]) -> Hit:
        edits, number = told[at]
        before, after = words[max(0, at - WINDOW):at], words[at + 1:at + 1 + WINDOW]
        quote = _inside_quotes(before, words[at], after)
        near = [bare(w) for w in before + after]
        quoted = 1.0 if quote else 0.5 if any(w in REPORTING for w in near) else 0.0
        abuse = (0.5 * any(w in SECOND_PERSON for w in near)
                 + 0.25 * any(w.endswith("!") for w in (words[at], *after))
                 + 0.5 * any(told[i] for i in range(max(0, at - WINDOW), min(len(words), at + WINDOW + 1))
                             if i != at))
        weight = (self.lexicon.weights[number] * EDIT ** edits
                  / (1 + math.exp(-(1.5 + 2 * abuse - 3 * quoted))))
        return Hit(at, words[at], self.lexicon.terms[number], edits, weight, quoted)


def _inside_quotes(before: list[str], word: str, after: list[str]) -> bool:
    """A quotation opens at or before the word and closes at or after it."""
    opened = word[0] in QUOTES_OPEN
    for w in reversed(before):
        if opened or (len(w) > 1 and w.rstrip(".,;:!?")[-1:] in QUOTES_CLOSE):
            break
        opened = w[0] in QUOTES_OPEN
    if not opened:
        return False
    return any(w.rstrip(".,;:!?)")[-1:] in tuple(QUOTES_CLOSE) for w in (word, *after))


def features(hits: list[Hit], words: int) -> list[float]:
    """Intercept, evidence outside quotation, evidence in it, evidence of misspelt terms,
    density. Of a term the strongest hit of each kind counts."""
    kinds: tuple[dict[str, float], ...] = ({}, {}, {})
    for h in hits:
        for side in (kinds[1],) if h.quoted else kinds[::2] if h.edits else kinds[:1]:
            side[h.term] = max(h.weight, side.get(h.term, 0.0))
    loud = sum(1 for h in hits if not h.quoted)
    return [1.0, *(1 - math.exp(-sum(k.values()) / FULL) for k in kinds),
            math.sqrt(loud / words) if words else 0.0]


# -- learning ----------------------------------------------------------------------------

def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold a word, and the set of the word's contexts in
    toxic ones, as 64 bits of hashes; the empty word counts the documents."""
    names = ["word", "toxic", "clean", "bits"]
    held: dict[str, list[int]] = {"": [0, 0, 0]}
    forms: dict[str, str] = {}

    def flush():
        columns = list(zip(*held.values(), strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array(columns[0], pa.int64()),
             pa.array(columns[1], pa.int64()),
             pa.array(np.array(columns[2], np.uint64).view(np.int64))], names=names)

    for label, text in texts_in(batches, "label", "text"):
        side = 0 if label else 1
        held[""][side] += 1
        words, seen = text.lower().split() if text else [], set()
        for i, raw in enumerate(words):
            if raw in seen:
                continue
            seen.add(raw)
            word = forms.get(raw)
            if word is None:
                word = forms[raw] = bare(raw)
            if not LENGTHS[0] <= len(word) <= LENGTHS[1]:
                continue
            row = held.get(word)
            if row is None:
                row = held[word] = [0, 0, 0]
            row[side] += 1
            if not side:
                row[2] |= 1 << (zlib.crc32(" ".join(words[max(0, i - 1):i + 2]).encode(
                    "utf-8", "surrogatepass")) & 63)
        if len(held) > 200_000 or len(forms) > 400_000:
            yield flush()
            held, forms = {"": [0, 0, 0]}, {}
    yield flush()


def _apart() -> Column:
    """About how many different contexts the hash bits hold (linear counting); the number
    of toxic documents where the set is nearly full."""
    ones = F.bit_count("bits")
    told = -64 * F.log((64 - F.least(ones, F.lit(60))) / F.lit(64.0))
    documents = F.col("toxic").cast("double")
    return F.when(ones >= 60, documents).otherwise(F.least(told, documents))


def _strong(df: DataFrame, base: float, total, evidence: float, max_terms: int) -> DataFrame:
    """Rows whose contexts cannot be toxic that often by chance, strongest first."""
    df = df.withColumns({"t": _apart(), "c": F.col("clean").cast("double")})
    n, share = F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c"))
    against = F.when((F.col("t") > 0) & (share > base), n * (
        share * F.log(share / base)
        + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)))
    # Log odds less one standard error: little is known of a word in few contexts.
    lift = (F.log((F.col("t") + 0.5) / (total.toxic + 1.0))
            - F.log((F.col("c") + 0.5) / (total.clean + 1.0)))
    weight = lift - F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    return (df.withColumns({"against": against, "weight": weight})
            .where((F.col("against") >= evidence) & (F.col("weight") >= LEAST_LOG_ODDS))
            .orderBy(F.col("against").desc(), "word").limit(max_terms))


def learn_lexicon(rows: DataFrame, max_terms: int = MAX_TERMS) -> Lexicon:
    """``rows``: label (0 or 1) and text of every labelled document."""
    both = [F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"),
            F.bit_or("bits").alias("bits")]
    counts = materialize(
        rows.select("label", "text").mapInArrow(
            _count, "word string, toxic long, clean long, bits long")
        .groupBy("word").agg(*both), "toxic-words")
    total = counts.where("word = ''").first()
    if total is None or not total.toxic or not total.clean:
        return Lexicon()
    base = total.toxic / (total.toxic + total.clean)
    words = counts.where("word <> ''")
    terms = _strong(words.where(F.col("word").rlike(r"\p{L}")), base, total, EVIDENCE,
                    max_terms).collect()
    lo, hi = STEM_LENGTHS
    prefixes = words.where(F.length("word") > lo).withColumn("word", F.explode(F.transform(
        F.sequence(F.lit(lo), F.least(F.lit(hi), F.length("word") - 1)),
        lambda n: F.substring("word", F.lit(1), n))))
    stems = _strong(prefixes.groupBy("word").agg(*both, F.count(F.lit(1)).alias("words"), F.max(
        "toxic").alias("most")).where((F.col("words") >= STEM_WORDS) & (
            F.col("most") * 2 <= F.col("toxic"))), base, total, 2 * EVIDENCE, max_terms).collect()
    found = {r.word for r in stems}
    kept = [r for r in stems if not any(r.word[:n] in found for n in range(lo, len(r.word)))]
    told = sorted([(r.word, False, r.weight) for r in terms] + [(r.word, True, r.weight) for r in kept])
    lexicon = Lexicon(tuple(w for w, _, _ in told), tuple(float(x) for _, _, x in told),
                      tuple(s for _, s, _ in told))
    return Lexicon(lexicon.terms, lexicon.weights, lexicon.stem, _spared(words, lexicon))


def _spared(words: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Words of clean documents that only come near a term: no misspellings of it."""
    if not lexicon.terms:
        return frozenset()
    exact = frozenset(t for t, s in zip(lexicon.terms, lexicon.stem, strict=True) if not s)

    def near(batches):
        automaton = Automaton(list(lexicon.terms), list(lexicon.weights), list(lexicon.stem))
        for batch in batches:
            hit = [w for w in batch.column(0).to_pylist() if w not in exact and automaton.match(w)]
            n = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hit, pa.string()), pa.array([n[w] for w in hit], pa.int64())],
                names=["word", "clean"])

    # Seen in two clean documents and at most as often in toxic ones.
    common = words.where("clean >= 2 AND clean >= toxic").select("word", "clean")
    told = common.mapInArrow(near, "word string, clean long")
    return frozenset(r.word for r in told.orderBy(F.col("clean").desc(), "word")
                     .limit(MAX_SPARED).collect())


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression, pulled towards ``PRIOR``; Newton steps."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - PULL * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(PULL)
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def score(self, x: list[float]) -> float:
        z = max(-30.0, min(30.0, float(np.dot(self.weights, x))))
        return 1 / (1 + math.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "label", max_terms: int = MAX_TERMS,
        max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from the documents that ``labels`` (key, label) names."""
    told = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias(
        "label")).where("key IS NOT NULL AND label IS NOT NULL")
    told = materialize(told.withColumn("label", (F.col("label") > 0).cast("int")), "toxic-labels")
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    # Texts of unlabelled documents stay where they are.
    named = with_probable(own, probable_set(told, "key"), "key").where("_probable").select(
        "key", "text")
    # Labels grow with the documents: one plan at every size, never a broadcast of them.
    lexicon = learn_lexicon(told.hint("merge").join(named, "key").select("label", "text"), max_terms)
    sample = told.orderBy(F.xxhash64("key"), "key", "label").limit(max_labelled)

    def measured(batches):
        matcher = Matcher(lexicon)
        for y, t in texts_in(batches, "label", "text"):
            yield pa.RecordBatch.from_pydict(
                {"y": pa.array([y], pa.int32()),
                 "x": pa.array([features(*matcher.hits(t))], pa.list_(pa.float64()))})

    # At most ``max_labelled`` rows of numbers are broadcast and come back.
    rows = (named.join(F.broadcast(sample), "key").select("label", "text")
            .mapInArrow(measured, "y int, x array<double>").toArrow())
    if not rows.num_rows:
        start = PRIOR.copy()
        start[0] = math.log(BASE / (1 - BASE))
        return Model(lexicon, start)
    x = np.array(rows.column("x").to_pylist())
    y = rows.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # sums do not depend on the rows' order
    return Model(lexicon, _regression(x[order], y[order]))


FOUND = ("array<struct<place: int, word: string, term: string, edits: int, weight: double, "
         "quoted: double>>")


def judge(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, score, found (its hits, in order)."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    matcher: list[Matcher] = []
    kind = pa.list_(pa.struct([("place", pa.int32()), ("word", pa.string()), ("term", pa.string()),
                               ("edits", pa.int32()), ("weight", pa.float64()),
                               ("quoted", pa.float64())]))

    @F.arrow_udf(f"struct<score: double, found: {FOUND}>")
    def told(texts: pa.Array) -> pa.Array:
        known = shared.value
        if not matcher:
            matcher.append(Matcher(known.lexicon))
        scores, found = [], []
        for part in text_slices(texts):
            for t in part:
                hits, words = matcher[0].hits(t)
                scores.append(known.score(features(hits, words)))
                found.append([vars(h) for h in hits])
        return pa.StructArray.from_arrays(
            [pa.array(scores, pa.float64()), pa.array(found, kind)], names=["score", "found"])

    return docs.select(F.col(f"`{key}`").alias("key"), told(F.col(f"`{text}`")).alias("told")).select(
        "key", "told.score", "told.found")
