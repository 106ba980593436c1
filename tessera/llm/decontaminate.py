"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: numbers, units and names turn into
typed placeholders, every other word into its lower-case form without punctuation.
Number words and units are known in English, German, French and Spanish.
A name is a word with one capital at its front that does not begin a sentence; a second
form of each text takes such words for names at the front of a sentence too. A third form
is the raw values (words without case, figures, names and units as they stand).

Every window of ``window`` tokens of the benchmark is a row of a table (hash -> item and
place, with the window's values and kinds). Every window of every whole document is looked
up, each form its own, by a hash join with that table. Before the join a set of hash bits of
the table's keys drops most windows that cannot match; its size follows the number of keys
up to ``filter_bits`` bits, and what it lets through wrongly finds no partner. So neither the
benchmark nor the documents pass through the driver or one task.

Hits on one diagonal of (document, item) are looked at together. Their slots must be
consistent: over the alignment, one value of the item stands for one value of the document
and the other way round. Windows with a slot that breaks the mapping are discarded.
What remains must make up a run of at least ``min_run`` tokens (or the whole item,
if shorter), or ``min_cover`` of the item. Such a document holds the item, verbatim
or with other numbers, names and units. Of the ways to read an alignment (plain
template, all windows with openers as names, raw values alone) the best one counts.

Only template windows with at least ``min_literal`` words that are not placeholders are
used, so a list of other names or figures matches nothing; windows of raw values need no
such words, so a verbatim list does. Items with fewer than ``window`` tokens use windows of
their own length. Items under ``min_literal`` tokens are one window of raw values, which
counts where it stands by itself: from the front of a sentence (or text) to the end of one.

Rows of equal texts get equal results, which are worked out once. Null and empty texts hold
nothing; null items and items without a token are ignored; items of equal text are looked at
once and all their ids are named. ``docs`` is read three times (windows, rows that
are certainly clean, the others), so it should be a stored table.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import (
    MASK64,
    ROW_BITS,
    Growing,
    free_name,
    mix64,
    probable_set,
    rolling,
    with_probable,
)
from tessera.session import materialize

WINDOW, MIN_LITERAL, MIN_RUN, MIN_COVER = 8, 5, 12, 0.6
#: Most bits of the set of window hashes (64 MB), and its bits a key below that.
FILTER_BITS, BITS_A_KEY = 1 << 29, 32
#: Characters of documents that are looked at together (one text at least).
BATCH_CHARS = 1 << 18
VOCABULARY = 400_000
BASE = 0x9E3779B97F4A7C15

# Units and spelled numbers (English, German, French, Spanish).
UNITS = frozenset((
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec min h hr hrs ms hz khz mhz ghz "
    "w kw mw j kj n pa kpa v mv a ma k c f kb mb gb tb bit byte mph kph usd eur gbp "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch "
    "inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces "
    "litre litres liter liters second seconds minute minutes hour hours day days week weeks "
    "month months year years dollar dollars cent cents euro euros percent degree degrees "
    "zentimeter gramm kilogramm pfund tonne tonnen sekunde sekunden minuten stunde stunden tag "
    "tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad "
    "mètre mètres kilomètre kilomètres gramme grammes kilogramme kilogrammes tonnes seconde "
    "secondes heure heures jour jours semaine semaines mois ans année années degré degrés "
    "metro metros kilómetro kilómetros gramo gramos kilogramo kilogramos litro litros segundo "
    "segundos minuto minutos hora horas día días semana semanas mes meses año años grado "
    "grados").split())
NUMBER_WORDS = frozenset((
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    "fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy "
    "eighty ninety hundred thousand million billion "
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn "
    "fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig "
    "siebzig achtzig neunzig hundert tausend milliarde "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize "
    "vingt vingts trente quarante cinquante soixante cent mille milliard "
    "cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince "
    "dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta "
    "setenta ochenta noventa cien ciento mil millón").split())
#: Joints of compound numbers: twenty-five, vingt-et-un, fünfundzwanzig, veinticinco.
JOINTS = re.compile(r"-(?:et-)?|(?<=[a-zß])und(?=[a-z])|(?<=^veint)i")

SPECIAL = UNITS | NUMBER_WORDS
CLOSING = ".,;:!?\"')]”’"

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: Words of a raw, white-space-free string: figures, or runs of letters.
PIECE = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’-][^\W\d_]+)*")
ENDS = re.compile(r"[.!?:][\"'”’)\]]*$")


def _is_number(low: str) -> bool:
    """A spelled number, or a compound of them."""
    return low in NUMBER_WORDS or all(
        p in NUMBER_WORDS or p in ("ein", "un", "veint", "ún", "dós", "trés", "séis")
        for p in JOINTS.split(low)) and bool(JOINTS.search(low))


def _kind(piece: str, alone: bool) -> int:
    """The placeholder of one piece; letters beside figures ("12km") can be units only there."""
    if piece[0].isdigit() or _is_number(piece.lower()):
        return NUMBER
    if piece.lower() in UNITS and (len(piece) > 2 or not alone):
        return UNIT
    return NAME if piece[0].isupper() and piece[1:].islower() else LITERAL


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 7)


class Vocabulary:
    """Raw words to runs of tokens (hash, kind); a cache that starts anew when full."""

    def __init__(self, size: int = VOCABULARY) -> None:
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.first, self.count = Growing(np.int64), Growing(np.int64)
        self.ends = Growing(bool)
        self.hash, self.kind = Growing(np.uint64), Growing(np.int8)

    def _learn(self, words: Iterable[str]) -> None:
        first, count, ends, hashes, kinds = [], [], [], [], []
        at, ids, digest = self.hash.n, self.ids, xxhash.xxh64_intdigest
        for word in words:
            ids[word] = len(ids)
            first.append(at + len(hashes))
            stem = word.rstrip(CLOSING)
            ends.append(stem != word and ENDS.search(word) is not None)
            if stem.isalpha():  # the common case: one run of letters
                low = stem.lower()
                count.append(1)
                hashes.append(digest(low, 7))  # letters always have a UTF-8 form
                common = low == stem and low not in SPECIAL and not JOINTS.search(low)
                kinds.append(LITERAL if common else _kind(stem, True))
                continue
            pieces = PIECE.findall(word)
            count.append(len(pieces))
            for p in pieces:
                hashes.append(_hash(p.lower()))
                kinds.append(_kind(p, len(pieces) == 1))
        for array, values in ((self.first, first), (self.count, count), (self.ends, ends),
                              (self.hash, hashes), (self.kind, kinds)):
            array.extend(values)

    def tokens(self, *texts: str | None) -> Tokens:
        """The tokens of some texts, one text after the other."""
        split = [t.split() if t else [] for t in texts]
        words = list(itertools.chain.from_iterable(split))
        first = np.cumsum([0] + [len(w) for w in split])
        if len(self.ids) > self.size:
            self.clear()
        ids = np.fromiter(map(self.ids.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(ids < 0)
        if len(new):
            unknown = [words[k] for k in new.tolist()]
            self._learn(dict.fromkeys(unknown))
            ids[new] = np.fromiter(map(self.ids.__getitem__, unknown), np.int64, len(new))
        n = self.count.data[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        begin, edge = upto[:-1], upto[first]
        place = np.repeat(self.first.data[ids] - begin, n) + np.arange(upto[-1])
        named = self.kind.data[place]
        plain = named.copy()
        # The first token after a word that ends a sentence is no name.
        ends = self.ends.data[ids]
        opening = np.concatenate([[False], ends[:-1]]) if len(ids) else np.zeros(0, bool)
        opening[first[:-1][np.diff(first) > 0]] = True
        at = begin[opening & (n > 0)]
        plain[at[plain[at] == NAME]] = LITERAL
        cut = np.zeros(upto[-1] + 1, bool)
        cut[edge] = True
        cut[upto[1:][ends]] = True
        return Tokens(self.hash.data[place], plain, named, cut, edge)


@dataclass(frozen=True)
class Tokens:
    """Value hash of every token, its kind with the words that open a sentence as literals,
    and as names; whether a sentence begins or ends in front of it; where each text begins."""

    value: np.ndarray
    plain: np.ndarray
    named: np.ndarray
    cut: np.ndarray
    edge: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.edge) - 1), np.diff(self.edge))


PLACEHOLDERS = mix64(np.arange(4, dtype=np.uint64))
PLAIN, NAMED, RAW, ALONE = 0, 1, 2, 3


@dataclass(frozen=True)
class Settings:
    window: int = WINDOW
    min_literal: int = MIN_LITERAL
    min_run: int = MIN_RUN
    min_cover: float = MIN_COVER


def window_hashes(tokens: Tokens, size: int, settings: Settings):
    """Form, places and hashes of the windows that may be matched.

    No window leaves its text. Raw values need no literals; windows too short for templates
    must be bounded by sentence ends. The hash depends on form and size too."""
    value, last = tokens.value, len(tokens.value) - size + 1
    if last <= 0:
        return
    owner = tokens.owner()
    inside = owner[:last] == owner[size - 1:]
    words = mix64(value)

    def told(form, where, units):
        at = np.flatnonzero(where)
        salt = np.uint64(BASE * (4 * size + form) & MASK64)
        return form, at, mix64(rolling(units, size, BASE)[at] + salt)

    if size < settings.min_literal:
        yield told(ALONE, inside & tokens.cut[:last] & tokens.cut[size:], words)
        return
    for form, kind in ((PLAIN, tokens.plain), (NAMED, tokens.named)):
        literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
        enough = literal[size:] - literal[:-size] >= min(size, settings.min_literal)
        yield told(form, inside & enough, np.where(kind == LITERAL, words, PLACEHOLDERS[kind]))
    yield told(RAW, inside, words)


def _stacked(values: np.ndarray, size: int, at: np.ndarray) -> pa.Array:
    """The windows at some places, each one the bytes of its values."""
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(values, size)[at])
    width = size * values.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(width), len(at), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(",")]


ITEM_WINDOWS = ("h long, t1 long, t2 long, total int, size int, form int, place int, own binary, "
                "plain binary, named binary")


def item_windows(vocabulary: Vocabulary, t1: int, t2: int, text: str,
                 settings: Settings) -> Iterator[pa.RecordBatch]:
    """Rows of the window table: those of one item."""
    tokens = vocabulary.tokens(text)
    total = len(tokens.value)
    size = min(settings.window, total)
    if not size:
        return
    for form, at, h in window_hashes(tokens, size, settings):
        k = len(at)
        yield pa.RecordBatch.from_arrays([
            pa.array(h.view(np.int64)), pa.array(np.full(k, t1, np.int64)),
            pa.array(np.full(k, t2, np.int64)), pa.array(np.full(k, total, np.int32)),
            pa.array(np.full(k, size, np.int32)), pa.array(np.full(k, form, np.int32)),
            pa.array(at.astype(np.int32)), _stacked(tokens.value, size, at),
            _stacked(tokens.plain, size, at), _stacked(tokens.named, size, at),
        ], names=_names(ITEM_WINDOWS))


@dataclass(frozen=True)
class Bits:
    """Two bits of each key in a set of 2 ** ``width`` bits."""

    width: int
    data: np.ndarray

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """Places of the keys that may be in the set."""
        some = np.flatnonzero(self._held(h >> np.uint64(64 - self.width)))
        return some[self._held(h[some] & np.uint64((1 << self.width) - 1))]

    def _held(self, bit: np.ndarray) -> np.ndarray:
        return (self.data[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bits_of(keys: DataFrame, most: int) -> Bits:
    """The set of the column ``h``, put together by Spark: ``most`` bits, or fewer for few keys."""
    n = keys.count()
    width = min(max(3, (BITS_A_KEY * n).bit_length()), most.bit_length() - 1)
    both = keys.select(F.explode(F.array(
        F.shiftrightunsigned("h", 64 - width),
        F.col("h").bitwiseAND(F.lit((1 << width) - 1)))).alias("bit"))
    rows = both.groupBy(F.floor(F.col("bit") / ROW_BITS).alias("row")).agg(
        F.bitmap_construct_agg(F.col("bit") % ROW_BITS).alias("bits")).toArrow()
    data = np.zeros((max(1, (1 << width) // ROW_BITS), ROW_BITS // 8), np.uint8)
    for row, bits in zip(rows.column("row").to_pylist(), rows.column("bits").to_pylist(),
                         strict=True):
        data[row] = np.frombuffer(bits, np.uint8)
    return Bits(width, data.reshape(-1))


HITS = "d1 long, d2 long, h long, at int, there binary"


def document_windows(vocabulary: Vocabulary, d1: list, d2: list, texts: list, sizes: list[int],
                     bits: Bits, settings: Settings) -> Iterator[pa.RecordBatch]:
    """Windows of some documents that may be in the table."""
    tokens = vocabulary.tokens(*texts)
    owner = tokens.owner()
    d1, d2 = np.array(d1, np.int64), np.array(d2, np.int64)
    for size in sizes:
        for _, at, h in window_hashes(tokens, size, settings):
            some = bits.may_hold(h)
            if not len(some):
                continue
            at, h = at[some], h[some]
            text = owner[at]
            yield pa.RecordBatch.from_arrays([
                pa.array(d1[text]), pa.array(d2[text]), pa.array(h.view(np.int64)),
                pa.array((at - tokens.edge[text]).astype(np.int32)),
                _stacked(tokens.value, size, at)], names=_names(HITS))


# -- alignments --------------------------------------------------------------------

def judge(total: int, size: int, form: np.ndarray, place: np.ndarray, at: np.ndarray,
          own: np.ndarray, there: np.ndarray, plain: np.ndarray, named: np.ndarray,
          settings: Settings) -> tuple[int, float] | None:
    """Longest run and cover of the best alignment of a document and an item, if one suffices.

    One row per window hit; ``own``, ``there`` (values), ``plain`` and ``named`` (kinds) have
    one column per token of the window."""
    kinds = np.where((form == PLAIN)[:, None], plain, np.where((form == NAMED)[:, None], named,
                                                               LITERAL))
    real = np.flatnonzero(((own == there) | (kinds != LITERAL)).all(axis=1))  # no hash alike by chance
    real = real[np.lexsort((place[real], (at - place)[real]))]
    diagonal = (at - place)[real]
    best = None
    for rows in np.split(real, np.flatnonzero(np.diff(diagonal)) + 1):
        if not len(rows):
            continue
        first, whole = rows[form[rows] == PLAIN], rows[form[rows] >= RAW]
        for some, kind in ((first, plain), (rows, named), (whole, None)):
            if len(some):
                told = _reading(total, size, place[some], own[some], there[some],
                                None if kind is None else kind[some], settings)
                best = max((t for t in (best, told) if t), default=None)
    return best


def _covered(total: int, size: int, places: np.ndarray) -> np.ndarray:
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, places, 1)
    np.add.at(step, places + size, -1)
    return np.cumsum(step[:-1]) > 0


def _reading(total, size, places, own, there, kind, settings):
    covered = _covered(total, size, places)
    if kind is not None:  # raw values stand for themselves
        spot = places[:, None] + np.arange(size)
        slot = np.flatnonzero((kind != LITERAL).ravel())
        where, one = np.unique(spot.ravel()[slot], return_index=True)
        slot = slot[one]
        forth: dict[tuple, int] = {}
        back: dict[tuple, int] = {}
        broken = np.zeros(total + 1, np.int64)
        for s, k, a, b in zip(where.tolist(), kind.ravel()[slot].tolist(),
                              own.ravel()[slot].tolist(), there.ravel()[slot].tolist(), strict=True):
            if forth.setdefault((k, a), b) != b or back.setdefault((k, b), a) != a:
                broken[s + 1] = 1
        if broken.any():
            before = np.cumsum(broken)
            covered = _covered(total, size, places[before[places + size] == before[places]])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    run = int((edges[1::2] - edges[::2]).max(initial=0))
    cover = float(covered.mean())
    enough = run >= min(settings.min_run, total) or cover >= settings.min_cover
    return (run, cover) if run and enough else None


JUDGED = "d1 long, d2 long, t1 long, t2 long, run int, cover double"
JUDGED_ROWS = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("t1", pa.int64()),
                         ("t2", pa.int64()), ("run", pa.int32()), ("cover", pa.float64())])
PAIR = ["d1", "d2", "t1", "t2"]


def judged(batches: Iterable[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    """Rows of hits in the order of (document, item) to the pairs that match."""
    waiting: list[pa.Table] = []

    def pair(rows: pa.Table) -> dict | None:
        def column(name):
            return rows.column(name).to_numpy()

        total, size = int(column("total")[0]), int(column("size")[0])

        def stacked(name, kind):
            return np.frombuffer(b"".join(rows.column(name).to_pylist()), kind).reshape(-1, size)

        told = judge(total, size, column("form"), column("place"), column("at"),
                     stacked("own", np.uint64), stacked("there", np.uint64),
                     stacked("plain", np.int8), stacked("named", np.int8), settings)
        return told and {n: rows.column(n)[0].as_py() for n in PAIR} | {
            "run": told[0], "cover": told[1]}

    def closed(rows: list[pa.Table]) -> list[dict]:
        found = pair(pa.concat_tables(rows)) if rows else None
        return [found] if found else []

    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        keys = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy() for n in PAIR])
        starts = np.concatenate([[0], np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1])
        out = []
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            own = tuple(keys[:, i].tolist())
            if own != key:
                out += closed(waiting)
                key, waiting = own, []
            waiting.append(rows.slice(i, j - i))
        yield pa.RecordBatch.from_pylist(out, schema=JUDGED_ROWS)
    yield pa.RecordBatch.from_pylist(closed(waiting), schema=JUDGED_ROWS)


# -- Spark -------------------------------------------------------------------------

def _text_keys(text: str, *names: str) -> dict[str, Column]:
    """128 bits that stand for a text."""
    return {names[0]: F.xxhash64(text), names[1]: F.xxhash64(F.lit(1), text)}


def benchmark_windows(items: DataFrame, settings: Settings) -> DataFrame:
    """The window table of a benchmark of rows (t1, t2, text); equal texts count once."""
    def run(batches):
        vocabulary = Vocabulary()
        for batch in batches:
            for row in batch.to_pylist():
                yield from item_windows(vocabulary, row["t1"], row["t2"], row["text"], settings)

    texts = items.select("t1", "t2", "text").distinct()
    return materialize(texts.mapInArrow(run, ITEM_WINDOWS), "leak-windows")


def hits_of(docs: DataFrame, windows: DataFrame, filter_bits: int, settings: Settings) -> DataFrame:
    """Windows of documents (d1, d2, text) that may be in the window table; of equal texts once."""
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # ``window`` at most
    shared = docs.sparkSession.sparkContext.broadcast(bits_of(windows.select("h"), filter_bits))

    def run(batches):
        vocabulary, bits = Vocabulary(), shared.value

        def flush(rows):
            return document_windows(vocabulary, *map(list, zip(*rows, strict=True)), sizes, bits,
                                    settings) if rows else ()

        rows, chars = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128).to_pydict()
                for row in zip(part["d1"], part["d2"], part["text"], strict=True):
                    if rows and chars + len(row[2]) > BATCH_CHARS:
                        yield from flush(rows)
                        rows, chars = [], 0
                    rows.append(row)
                    chars += len(row[2])
        yield from flush(rows)

    return docs.where("text IS NOT NULL").mapInArrow(run, HITS).distinct()


def matches(docs: DataFrame, benchmark: DataFrame, filter_bits: int = FILTER_BITS,
            settings: Settings = Settings()) -> DataFrame:
    """One row per distinct text of ``docs`` (d1, d2, text) that holds an item of ``benchmark``
    (key, text): d1, d2, items, longest_run, cover."""
    items = benchmark.where("text IS NOT NULL").withColumns(_text_keys("text", "t1", "t2"))
    windows = benchmark_windows(items, settings)
    joined = hits_of(docs, windows, filter_bits, settings).join(windows, "h")
    pairs = joined.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInArrow(
        lambda batches: judged(batches, settings), JUDGED)
    named = pairs.join(items.select("t1", "t2", "key").distinct(), ["t1", "t2"])
    return materialize(named.groupBy("d1", "d2").agg(
        F.array_sort(F.collect_set("key")).alias("items"), F.max("run").alias("longest_run"),
        F.max("cover").alias("cover")), "leaks")


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
         item_text: str = "text", filter_bits: int = FILTER_BITS,
         settings: Settings = Settings()) -> DataFrame:
    """The rows with ``items`` (ids of the items held), ``longest_run``, ``cover`` and
    ``contaminated``. If a name is taken, the input's column stays and the new one gets a
    number (``items_2``).

    Texts are not shuffled but for those that, by a set of hash bits of a fixed size
    (``common.probable_set``), may hold an item."""
    # A row travels as one value, so its columns meet no name of this function.
    rows = docs.select(F.struct("*").alias("_row"), F.col(f"`{text}`").alias("_text")).withColumns(
        _text_keys("_text", "d1", "d2"))
    found = matches(rows.select("d1", "d2", F.col("_text").alias("text")),
                    benchmark.select(F.col(f"`{item_key}`").cast("long").alias("key"),
                                     F.col(f"`{item_text}`").alias("text")), filter_bits, settings)
    marked = with_probable(rows.drop("_text"), probable_set(found, "d1", "d2"), "d1", "d2")
    clean_rows = marked.where("NOT _probable").select(
        "_row", F.lit(None).cast("array<long>").alias("items"),
        F.lit(None).cast("int").alias("longest_run"), F.lit(None).cast("double").alias("cover"))
    others = marked.where("_probable").join(found, ["d1", "d2"], "left").select(
        "_row", "items", "longest_run", "cover")
    told = {"items": F.coalesce("items", F.array().cast("array<long>")),
            "longest_run": F.coalesce("longest_run", F.lit(0)),
            "cover": F.coalesce("cover", F.lit(0.0)), "contaminated": F.col("longest_run").isNotNull()}
    return clean_rows.unionByName(others).select(
        "_row.*", *[c.alias(free_name(docs, n)) for n, c in told.items()])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The rows that hold no benchmark item, with all their columns."""
    own = docs.select(F.struct("*").alias("_row"), F.col(f"`{text}`").alias("_text"))
    told = mark(own, benchmark, "_text", **settings)
    return told.where("NOT contaminated").select("_row.*")
