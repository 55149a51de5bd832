"""Tokenizer operators against the libraries themselves."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tickloom.llm import bpesql, chunks, packing, tokenbin, tokencount
from tickloom.llm.chunks import LATIN_WORD, Ids
from tickloom.llm.tokencount import Merger

JSON, RANKS, WORDS = (P.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def texts(base, odd):
    return base + [t for _, t in rows_of(odd)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def key(r):
    return tuple((x is None, x) for x in r)


def test_ids_equal_the_library(base, odd, library):
    pick = random.Random(9)
    alphabet = "ab '’.,!?-_\n\t   ́éßΣςİÅǅ١½²x|<>09🙂日　"
    own = texts(base, odd) + ["".join(pick.choice(alphabet) for _ in range(pick.randrange(1, 60))) for _ in range(1500)]
    for path, drop in ((JSON, False), (WORDS, True)):
        each = Tokenizer.from_file(path)
        for text, got in zip(own, Ids(path, drop).encode(own), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == each.encode(text, add_special_tokens=False).ids, text[:80]
    counter = tokencount.Counter(JSON)
    for text, n in zip(own, counter.count(own), strict=True):
        assert n == len(library.encode(text, add_special_tokens=False).ids), text[:80]


def test_latin_words_equal_the_library():
    """Words that go to the model at once: every letter, alone and in words, and runs of thousands."""
    pick = random.Random(4)
    letters = [chr(c) for c in range(0x41, 0x250) if LATIN_WORD.fullmatch(chr(c))]
    assert len(letters) > 400
    own = letters + ["".join(pick.choice(letters) for _ in range(pick.randrange(1, 25))) for _ in range(2000)] + ["a" * 5000, "Straße" * 500, "".join(letters)]
    own += [" " + w for w in own]
    for path, drop in ((JSON, False), (WORDS, True)):
        each = Tokenizer.from_file(path)
        for text, got in zip(own, Ids(path, drop).encode(own), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == each.encode(text, add_special_tokens=False).ids, text[:80]


def test_merger_on_runs():
    m = Merger(JSON)
    library = Tokenizer.from_file(JSON)
    words = [b"a" * n for n in range(1, 40)] + [b"abab" * 7, b"the", b"\xff\xfe", b"aaabaaab"]
    got = m.counts(words).tolist()
    for w, n in zip(words, got, strict=True):
        try:
            assert n == len(library.encode(w.decode(), add_special_tokens=False).ids), w
        except UnicodeDecodeError:
            assert n >= 1


def test_counts(spark, odd, empty, library):
    got = sorted((tuple(r) for r in tokencount.token_counts(odd, JSON, limit=100).collect()), key=key)
    want = sorted(((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 100) for i, t in rows_of(odd)), key=key)
    assert got == want
    assert tokencount.token_counts(empty, JSON).collect() == []


def test_sql_round_trip(odd, empty):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    small = odd.where("length(text) < 3000 or text is null or text like 'word%'")
    got = sorted((tuple(r) for r in bpesql.encoded(small, RANKS, P.PATTERN).collect()), key=key)
    want = []
    for i, t in rows_of(small):
        ids = own.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=key)
    assert bpesql.encoded(empty, RANKS, P.PATTERN).collect() == []


def test_pieces():
    for n in range(1, 5000, 7):
        own = packing.piece_lengths(n, 2048)
        assert sum(own) == n and all(x & (x - 1) == 0 and x <= 2048 for x in own) and own == sorted(own, reverse=True) and len(set(x for x in own if x < 2048)) == sum(x < 2048 for x in own)


def test_packing(odd, empty, library):
    got = packing.pack(odd, JSON, with_ids=True).collect()
    docs = {}
    for r in got:
        assert r["offset"] == 0 and len(r["ids"]) == r["length"] and zlib.crc32(array("I", r["ids"]).tobytes()) == r["ids_crc32"]
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    buckets = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert buckets == sorted(buckets, reverse=True)
    for i, t in rows_of(odd):
        want = [*library.encode(t, add_special_tokens=False).ids, 1]
        pieces = sorted({(r["start"], tuple(r["ids"])) for r in docs[i, len(want)]})
        if i not in (None, 14):
            assert [x for _, p in pieces for x in p] == want
    assert sum(r["length"] for r in got) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows_of(odd))
    assert packing.pack(empty, JSON).collect() == []
    with pytest.raises(ValueError):
        packing.pack(odd, JSON, size=1000)


def test_files(spark, odd, empty, tmp_path):
    words = Tokenizer.from_file(WORDS)
    got = [tuple(r) for r in tokenbin.token_files(odd.repartition(5), WORDS, folder=f"file://{tmp_path}/t").collect()]
    order = sorted(rows_of(odd), key=lambda r: ((r[0] is not None, r[0]), r[1]))
    want, start = [], 0
    for i, t in order:
        ids = [*words.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert tokenbin.token_files(empty, WORDS).collect() == []
    files = sorted(p.name.split(".")[-1] for p in (tmp_path / "t").iterdir() if not p.name.startswith("."))
    assert set(files) == {"bin", "off", "doc"}


def test_cache_looks_at_the_wanted_chunks_alone():
    """A lookup costs what it looks up, however much the cache holds; chunks that were met move up, and the rest is made."""

    class Held(dict):
        def keys(self):
            raise AssertionError("goes through all that it holds")

        __iter__ = keys

    made = []
    cache = chunks.ChunkCache(lambda own: made.extend(own) or [x.upper() for x in own])
    cache.young, cache.old = Held(a="A", b="B"), {"c": "C", "d": "D"}
    found = cache.lookup([["a", "c"], ["e", "a"]])
    assert [found[x] for x in "ace"] == ["A", "C", "E"]
    assert made == ["e"] and "c" in cache.young and "d" not in cache.young
