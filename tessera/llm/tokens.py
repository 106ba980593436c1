"""Exact, cached encoding with a public byte-level BPE tokenizer.

A byte-level BPE splits before a space that stands between two characters which are not
white space, and between a letter and a sign after it: no token reaches across. ``Encoder``
cuts a batch of texts there, hashes all segments at once, looks them up in a sorted table of
hashes and has the tokenizers library encode only segments not seen before; plain words
go to its model in one string, as its splitter leaves them whole. So the ids equal those of
the whole text encoded at once (tested against it) at a fraction of the time. A segment
is known by 96 bits of two independent hashes. The table is emptied when full. A text that
holds the string of an added token (an end mark) is given to the library as it is.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterable, Iterator

import numpy as np

from tessera.llm.common import Growing, mix64, powers

MAX_SEGMENTS, MAX_IDS = 1_500_000, 1 << 26
#: Characters encoded at once: enough that the table is seldom rebuilt.
BATCH_CHARS = 400_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes hashed at once, if no segment is longer: the powers that a worker keeps are as many.
HASHED_BYTES = 1 << 16
#: Bytes of new segments given to the library in one string.
JOINED_BYTES = 1 << 16


def _byte_characters() -> np.ndarray:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the
    characters from 256 on, in order."""
    shown = np.arange(256, dtype="<u2")
    hidden = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
    shown[hidden] = 256 + np.arange(len(hidden))
    return shown


def _ascii_letters(raw: np.ndarray) -> np.ndarray:
    low = raw | 0x20
    return (low >= 0x61) & (low <= 0x7A)


def _letters(raw: np.ndarray) -> np.ndarray:
    """Bytes of letters that every version of Unicode calls letters: ASCII's, and two-byte ones
    from U+00C0 up to U+024F."""
    lead, second = raw[:-1], raw[1:]
    pair = (lead >= 0xC3) & (lead <= 0xC9) & ((second & 0xC0) == 0x80)
    pair &= ~((lead == 0xC3) & ((second == 0x97) | (second == 0xB7)))  # times and divided by
    pair &= (lead < 0xC9) | (second <= 0x8F)
    out = _ascii_letters(raw)
    out[:-1] |= pair
    out[1:] |= pair
    return out


def segments(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where segments begin in the UTF-8 bytes of texts laid end to end.

    A segment begins with a text; with a space or a line feed between two characters that are
    plainly not white space: printable ASCII, or a two-byte character from U+00C0 on; after
    such a line feed; and with a printable ASCII character other than a letter that follows
    an ASCII letter."""
    plain = (raw >= 0x21) & (raw <= 0x7E)
    lead = (raw >= 0xC3) & (raw <= 0xC9)
    before, after = plain.copy(), plain | lead
    before[1:] |= ((raw[1:] & 0xC0) == 0x80) & lead[:-1]
    begin = np.zeros(len(raw), bool)
    between = before[:-2] & after[2:]
    begin[1:-1] = (raw[1:-1] == 0x20) & between
    line = 1 + np.flatnonzero((raw[1:-1] == 0x0A) & between)
    begin[line] = begin[line + 1] = True
    some = ends > starts
    begin[ends[some] - 1] = False  # the byte after belongs to the next text
    letter = _ascii_letters(raw)
    begin[1:] |= letter[:-1] & (plain & ~letter)[1:]
    begin[starts[some]] = True
    return np.flatnonzero(begin)


def _hashes(raw: np.ndarray, at: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """A polynomial hash of every segment for each base; segments lie end to end."""
    out = [np.empty(len(at), np.uint64) for _ in BASES]
    size = (stop - at).astype(np.uint64)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(stop, at[i] + HASHED_BYTES, "right")))
        wide = raw[at[i]:stop[j - 1]].astype(np.uint64)
        wide += np.uint64(1)
        sums = np.zeros(len(wide) + 1, np.uint64)
        first, last = at[i:j] - at[i], stop[i:j] - at[i]
        for base, hashes in zip(BASES, out, strict=True):
            power, back = powers(base, max(HASHED_BYTES, 1 << (len(wide) - 1).bit_length()))
            np.multiply(wide, power[:len(wide)], out=sums[1:])
            np.cumsum(sums[1:], out=sums[1:])
            hashes[i:j] = mix64((sums[last] - sums[first]) * back[first] + size[i:j])
        i = j
    return out


class Encoder:
    def __init__(self, path: str, max_segments: int = MAX_SEGMENTS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit
        self.tokenizer = Tokenizer.from_file(path)
        # A text with an added token's string goes to the library whole.
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        # The model alone, for words that a line feed parts.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        self.characters = _byte_characters()
        # A token has a character for each byte it stands for.
        vocab = self.model.get_vocab()
        self.width = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.width[list(vocab.values())] = [len(t) for t in vocab]
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.kind = np.uint16 if top < 1 << 16 else np.uint32
        self.max_segments = max_segments
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int32)
        self.pool = Growing(self.kind)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    # -- new segments ----------------------------------------------------------------

    def _mixed(self, raw: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments laid end to end, and how many each has."""
        bounds = np.append(0, end).tolist()
        told = self.plain([raw[i:j].tobytes().decode("utf-8", "surrogatepass")
                           for i, j in zip(bounds[:-1], bounds[1:], strict=True)])
        return (np.array([i for t in told for i in t], np.uint32),
                np.array([len(t) for t in told], np.int32))

    def _words(self, raw: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_mixed`` for words, which the splitter leaves whole: the model is given them as one
        string, and the bytes of its tokens tell where a word's ids end."""
        shown = np.full(len(raw) + len(end), ord("\n"), "<u2")
        at = np.arange(len(raw))
        shown[at + np.searchsorted(end, at, "right")] = self.characters[raw]
        told = self.model.encode_batch_fast([shown.tobytes().decode("utf-16-le")],
                                            add_special_tokens=False)
        ids = np.array(told[0].ids, np.uint32)
        upto = np.cumsum(self.width[ids])
        edge = np.searchsorted(upto, end)
        if not len(upto) or upto[-1] != len(raw) or (upto[edge] != end).any():
            return self._mixed(raw, end)  # bytes that the vocabulary has no token for
        return ids, np.diff(edge, prepend=-1).astype(np.int32)

    def _encode_new(self, raw: np.ndarray, at: np.ndarray,
                    stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the pool and numbers of ids of segments that are added to it."""
        others = np.append(0, np.cumsum(~_letters(raw)))
        body = at + (raw[at] == 0x20)
        word = (stop > body) & (others[stop] == others[body])
        start, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int32)
        for some, tell in ((np.flatnonzero(word), self._words),
                           (np.flatnonzero(~word), self._mixed)):
            full = np.cumsum(stop[some] - at[some]) // JOINED_BYTES
            for part in np.split(some, np.flatnonzero(np.diff(full)) + 1):
                if not len(part):
                    continue
                size = stop[part] - at[part]
                end = np.cumsum(size)
                ids, many = tell(raw[np.repeat(stop[part] - end, size) + np.arange(end[-1])], end)
                start[part], count[part] = self.pool.n + np.cumsum(many) - many, many
                self.pool.extend(ids)
        return start, count

    # -- a batch ---------------------------------------------------------------------

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts as unsigned 32-bit integers."""
        whole = [k for k, t in enumerate(texts) if t and any(a in t for a in self.added)]
        if whole:
            told = self.encode_many([None if k in set(whole) else t for k, t in enumerate(texts)])
            for k, ids in zip(whole, self.plain([texts[k] for k in whole]), strict=True):
                told[k] = np.array(ids, np.uint32)
            return told
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(d) for d in data])
        starts = ends - [len(d) for d in data]
        blob = b"".join(data)
        if not blob:
            return [np.zeros(0, np.uint32) for _ in texts]
        if len(self.keys) > self.max_segments or self.pool.n > MAX_IDS:
            self.clear()
        raw = np.frombuffer(blob, np.uint8)
        at = segments(raw, starts, ends)
        stop = np.append(at[1:], len(raw))
        hashes = _hashes(raw, at, stop)
        key, check = hashes[0], (hashes[1] >> np.uint64(32)).astype(np.uint32)
        known, first, each = np.unique(key, return_index=True, return_inverse=True)
        if (check[first][each] != check).any():  # two segments of one hash in a batch
            return [np.array(i, np.uint32) for i in self.plain([t or "" for t in texts])]
        start, count = self._look_up(known, check[first], at[first], stop[first], raw)
        count = count[each]
        upto = np.cumsum(count)
        place = np.repeat(start[each] - upto + count, count)
        place += np.arange(upto[-1])
        ids = self.pool.data[place].astype(np.uint32)
        # Ids before each text: those of the segments before its first.
        before = np.concatenate([[0], upto])
        edge = np.searchsorted(at, np.append(starts, len(raw)))
        return [ids[before[i]:before[j]] for i, j in zip(edge[:-1], edge[1:], strict=True)]

    def _look_up(self, key, check, at, stop, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of ids in the pool of distinct segments in hash order; new
        ones are encoded and added."""
        place = np.searchsorted(self.keys, key)
        there = np.zeros(len(key), bool)
        inside = place < len(self.keys)
        there[inside] = self.keys[place[inside]] == key[inside]
        same = there.copy()
        same[there] = self.checks[place[there]] == check[there]
        start, count = np.zeros(len(key), np.int64), np.zeros(len(key), np.int32)
        start[same], count[same] = self.starts[place[same]], self.counts[place[same]]
        new = np.flatnonzero(~same)
        if len(new):
            start[new], count[new] = self._encode_new(raw, at[new], stop[new])
            add = np.flatnonzero(~there)
            at = place[add] + np.arange(len(add))
            old = np.ones(len(self.keys) + len(add), bool)
            old[at] = False
            for name, values in (("keys", key), ("checks", check), ("starts", start),
                                 ("counts", count)):
                held = getattr(self, name)
                wider = np.empty(len(old), held.dtype)
                wider[old], wider[at] = held, values[add]
                setattr(self, name, wider)
        return start, count

    def rows(self, rows: Iterable[tuple[object, str | None]]) -> Iterator[tuple[object, np.ndarray]]:
        """(key, ids) of (key, text) rows, encoded a bounded batch at a time."""
        keys, texts, size = [], [], 0
        for key, text in rows:
            keys.append(key)
            texts.append(text)
            size += len(text or "")
            if size >= BATCH_CHARS:
                yield from zip(keys, self.encode_many(texts), strict=True)
                keys, texts, size = [], [], 0
        if keys:
            yield from zip(keys, self.encode_many(texts), strict=True)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)
