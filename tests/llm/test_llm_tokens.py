"""Encoder, token plane files and packing."""

import io
import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_util import awkward, awkward_rows, empty

from tessera.llm import packing, token_planes
from tessera.llm.queries import tokenizer_path
from tessera.llm.tokens import Encoder


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: list(t.encode(text or "", add_special_tokens=False).ids)


def test_encoder_equals_the_library(plain):
    rng = random.Random(2)
    parts = [*"ab c  \n\t.'s1é,!$%)]İß×", "the ", " don't ", "<|endoftext|>", "\x1c", "\x85",
             "\u200b", "e\u0301", "\u3000", "中文", "\r\n", "Ⅷ", "word.\nNext", "x" * 80, "\xa0", "ɐ "]
    coder = Encoder(tokenizer_path(), max_segments=50)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    texts += [t for _, t, *_ in awkward_rows()] + [None, ""]
    for at in range(0, len(texts), 37):
        batch = texts[at:at + 37]
        for text, ids in zip(batch, coder.encode_many(batch), strict=True):
            assert ids.tolist() == plain(text), repr(text)
    for text in texts[:300]:
        assert coder.encode(text).tolist() == plain(text)
    assert [k for k, _ in coder.rows((i, t) for i, t in enumerate(texts))] == list(range(len(texts)))


def test_colliding_hashes_are_noticed(plain, monkeypatch):
    """With a table and a batch full of equal keys the ids stay right."""
    from tessera.llm import tokens
    monkeypatch.setattr(tokens, "mix64", lambda x: (x % np.uint64(7)) * np.uint64((1 << 61) + (1 << 33)))
    coder = Encoder(tokenizer_path())
    for text in ("one", "two", " three four five six seven", "one two three", "eight nine ten"):
        assert coder.encode(text).tolist() == plain(text)


@pytest.mark.parametrize("kind", [token_planes.BITS, token_planes.BYTES])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(1)
    for top in (1, 2, 200, 1 << 9, 1 << 17, 1 << 32):
        for n in (1, 7, 8, 1000):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
            planes = token_planes.to_planes(ids, kind)
            assert (token_planes.from_planes(planes, n, kind) == ids).all()


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_file_round_trip_and_chunk_index():
    rng = np.random.default_rng(2)
    made = token_planes.FileParts(64, token_planes.BITS)
    docs = [(None if k == 0 else k * 3, rng.integers(0, 60_000, n).astype("<u4"))
            for k, n in enumerate((0, 1, 64, 63, 500, 0, 2))]
    data = token_planes.MAGIC + b"".join(p for k, ids in docs for p in made.add(k, ids))
    file = File(data + b"".join(made.close()))
    got = list(token_planes.documents_in(file))
    assert [(k, i.tolist()) for k, i in got] == [(k, i.tolist()) for k, i in docs]
    _, counts, index, kind = token_planes.read_index(file)
    whole = np.concatenate([i for _, i in docs])
    assert counts.sum() == len(whole)
    assert (token_planes.read_block(file, index[3], kind) == whole[192:256]).all()
    none = token_planes.FileParts(64, token_planes.BITS)
    assert list(token_planes.documents_in(File(token_planes.MAGIC + b"".join(none.close())))) == []
    with pytest.raises(ValueError, match="not a token plane file"):
        token_planes.read_index(File(b"x" * 200))


def test_written_files_read_back(spark, plain):
    rows = awkward_rows()
    files = token_planes.write(awkward(spark).repartition(3), tokenizer_path(), end_id=2,
                               block=128, file_ids=3000)
    assert files.count() > 2
    got = sorted(token_planes.read(files).collect(), key=lambda r: r.start)
    def tie(text):
        h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) if h >= 1 << 63 else h

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    at = 0
    for r, (doc, text, *_) in zip(got, order, strict=True):
        assert (r.key, r.start, r.ids) == (doc, at, [*plain(text), 2])
        at += len(r.ids)
    crc = token_planes.read(files, token_planes.crc32_of, "ids_crc32 long").collect()
    assert Counter((r.key, r.ids_crc32) for r in crc) == Counter(
        (d, zlib.crc32(array("I", [*plain(t), 2]).tobytes())) for d, t, *_ in rows)


def test_empty_table_writes_and_reads(spark):
    files = token_planes.write(empty(spark), tokenizer_path())
    assert token_planes.read(files).count() == 0
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0


def check_pieces(pieces, size):
    """Gapless sequences of at most ``size``; all but the last of each shard are full."""
    sequences = defaultdict(list)
    for p in pieces:
        assert p.length > 0
        sequences[p.sequence_id].append(p)
    short = Counter()
    for s, members in sequences.items():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        short[s >> 32] += at < size
    assert not short or max(short.values()) <= 1


def test_packing_is_a_partition_of_all_ids(spark, plain):
    rows = awkward_rows()
    for shard_ids in (1 << 21, 3000):
        pieces = packing.pack(awkward(spark), tokenizer_path(), size=64,
                              shard_ids=shard_ids).collect()
        check_pieces(pieces, 64)
        docs = defaultdict(list)
        for p in pieces:
            assert len(p.ids) == p.length
            docs[p.key, p.doc_tokens].append(p)
        want = Counter((d, len(plain(t)) + 1) for d, t, *_ in rows)
        total = sum(n * m for (_, n), m in want.items())
        assert sum(p.length for p in pieces) == total and set(docs) == set(want)
        for (doc, n), m in want.items():
            if m == 1:
                parts = sorted(docs[doc, n], key=lambda p: p.start)
                text = next(t for d, t, *_ in rows if d == doc and len(plain(t)) + 1 == n)
                assert sum((p.ids for p in parts), []) == [*plain(text), 0]
                assert [p.start for p in parts] == list(
                    np.cumsum([0, *(p.length for p in parts[:-1])]))


def test_frequencies_cover_all_documents(spark, plain):
    coded, frequencies = packing.encode(awkward(spark), tokenizer_path())
    assert coded.count() == len(awkward_rows())
    got = {r.term: r.docs for r in frequencies.collect()}
    want = Counter(t for _, text, *_ in awkward_rows() for t in {*plain(text), 0})
    assert got == dict(want)


def test_scores_are_bm25_and_neighbours_share_words():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 50, rng.integers(1, 60)) for _ in range(40)]
    idf = rng.random(50).astype(np.float32)
    index = packing.Index(docs, idf, 25.0)
    got = index.scores(3, 1000)
    for d, ids in enumerate(docs):
        want = 0.0
        for t in np.unique(docs[3]):
            n = (ids == t).sum()
            norm = packing.K1 * (1 - packing.B + packing.B * len(ids) / 25.0)
            want += idf[t] * n * (packing.K1 + 1) / (n + norm)
        assert abs(got[d] - want) < 1e-3
    # Two topics: a window filled by retrieval holds one topic only.
    topics = [np.concatenate([np.full(3, 1 + k % 2), rng.integers(10, 12, 13) + 10 * (k % 2)])
              for k in range(32)]
    pieces = packing.pack_shard(topics, np.ones(50, np.float32), 16.0, 64, 24, 32)
    by_sequence = defaultdict(set)
    for d, _, _, s, _ in pieces:
        by_sequence[s].add(d % 2)
    assert all(len(x) == 1 for x in by_sequence.values()) and len(by_sequence) == 8


def test_like_documents_share_a_shard(spark):
    """Eight topics in shards of about one topic: retrieval meets its own topic, not a random slice."""
    rng = random.Random(5)
    topics = [["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
               for _ in range(60)] for _ in range(8)]
    rows = [(i, " ".join(rng.choices(topics[i % 8], k=60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = packing.pack(docs, tokenizer_path(), size=128, shard_ids=16_000).collect()
    check_pieces(pieces, 128)
    shards, sizes = defaultdict(Counter), Counter()
    for p in pieces:
        shards[p.sequence_id >> 32][p.key % 8] += p.length
        sizes[p.sequence_id >> 32] += p.length
    assert len(sizes) >= 4 and max(sizes.values()) <= 16_000
    mixed = defaultdict(set)
    for p in pieces:
        mixed[p.sequence_id].add(p.key % 8)
    assert np.mean([len(m) == 1 for m in mixed.values()]) > 0.9
    best = Counter()
    for counts in shards.values():
        for topic, n in counts.items():
            best[topic] = max(best[topic], n)
    assert sum(best.values()) > 0.8 * sum(sizes.values())


def test_equal_documents_fill_shards_of_bounded_size(spark):
    docs = spark.createDataFrame([(i, "one and the same text " * 8) for i in range(600)],
                                 "doc_id long, text string")
    pieces = packing.pack(docs, tokenizer_path(), size=64, shard_ids=3000).collect()
    check_pieces(pieces, 64)
    sizes = Counter()
    for p in pieces:
        sizes[p.sequence_id >> 32] += p.length
    assert max(sizes.values()) < 6000 and len(sizes) >= sum(sizes.values()) // 6000


def test_windows_are_filled_with_neighbours_beyond_the_first_candidates():
    """Short documents of two topics: 64 of them fill a window, twice the first block."""
    topics = [np.array([1 + k % 2, 10 + k % 2] * 2) for k in range(256)]
    for candidates in (4, 32):
        pieces = packing.pack_shard(topics, np.ones(50, np.float32), 4.0, 256, 24, candidates)
        by_sequence = defaultdict(set)
        for d, _, _, s, _ in pieces:
            by_sequence[s].add(d % 2)
        assert all(len(x) == 1 for x in by_sequence.values()) and len(by_sequence) == 4


def test_a_query_holds_all_terms_of_a_document():
    """Neighbours that share only the lighter terms have a score."""
    docs = [np.arange(200), np.arange(150, 180), np.arange(300, 330)] + [np.arange(150, 200)] * 30
    idf = np.linspace(5, 1, 400).astype(np.float32)
    seen = packing.Index(docs, idf, 60.0).scores(0, packing.QUERY_TERMS)
    assert seen[1] > 0 and seen[2] == 0 and (seen[3:] > 0).all()


def test_the_table_of_segments_is_seldom_rebuilt():
    coder, sizes = Encoder(tokenizer_path()), []
    encode_many = coder.encode_many
    coder.encode_many = lambda texts: sizes.append(len(texts)) or encode_many(texts)
    assert len(list(coder.rows((k, "a word or two " * 100) for k in range(900)))) == 900
    assert len(sizes) <= 4 and sum(sizes) == 900  # 1,260,000 characters
    before = coder.keys
    coder.encode_many([f"new{chr(97 + k % 26)}{chr(97 + k // 26)} word" for k in range(400)])
    assert len(coder.keys) > len(before) and (np.diff(coder.keys.astype(object)) > 0).all()
    assert len(coder.keys) == len(coder.checks) == len(coder.starts) == len(coder.counts)


def test_a_word_is_known_whatever_sign_follows(plain):
    coder, rng = Encoder(tokenizer_path()), random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(9)) + "n" for _ in range(200)]
    texts = [" ".join(w + sign for w in words) for sign in (".", ",", "!)", "'s", "-3", ".\nNext")]
    texts += [text[1:] for text in texts] + ["naïve×3 a÷b ªb Ⱦx ɏ. ɐ. don't'll 'twas\n\nx", "x\ny\n"]
    for text, ids in zip(texts, coder.encode_many(texts), strict=True):
        assert ids.dtype == np.uint32 and ids.tolist() == plain(text)
    assert len(coder.keys) < 2 * len(set(words))


def test_a_vocabulary_without_some_bytes():
    """Where the model drops bytes, a word's ids are those of the word alone."""
    coder = Encoder(tokenizer_path())
    coder.width = coder.width + 1
    text = "some words of another vocabulary"
    assert coder.encode(text).tolist() == coder.plain([text])[0]


def test_a_worker_keeps_few_bytes_besides_its_table(plain, monkeypatch):
    from tessera.llm import tokens
    sizes, powers = [], tokens.powers
    monkeypatch.setattr(tokens, "powers", lambda base, size: sizes.append(size) or powers(base, size))
    coder = Encoder(tokenizer_path())
    texts = ["some words of a text é " * 900 for _ in range(30)] + ["x" * 70_000 + " end"]
    for (_, ids), text in zip(coder.rows(enumerate(texts)), texts, strict=True):
        assert len(text) < 70_000 or ids.tolist() == plain(text)
    assert sorted(set(sizes)) == [1 << 16, 1 << 17]  # the longer for the one long word alone
    assert sizes.count(1 << 17) == len(tokens.BASES) and coder.pool.data.itemsize == 2
