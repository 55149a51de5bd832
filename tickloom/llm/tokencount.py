"""Token counts by rank-synchronous merging of ragged numpy arrays.

Distinct pre-tokens of a batch lie end to end as arrays of symbol ids. In each round every sequence finds the
lowest rank among its adjacent pairs and merges all places of that pair at once, from the left where they overlap;
sequences without a pair leave with their number of symbols. That equals merging one place at a time, because no
merge makes a pair of a lower rank (checked when the file is read).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tickloom.llm.chunks import ChunkCache, added_strings, byte_letters, groups, splitter
from tickloom.llm.shared import bounded_batches, hold, texts_of

#: The byte-level split of a text before the merges (a fixed value of the vocabulary).
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
NONE = np.iinfo(np.int64).max


class Merger:
    """The merge table of a byte-level BPE file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(self.size, -1, np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        if (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge comes before one that makes its parts")
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.of_byte = np.array([vocab[c] for _, c in sorted(byte_letters().items())], np.int64)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive of each word; none of the words is empty."""
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            keys = np.full(len(symbols), -1, np.int64)
            keys[:-1] = np.where(owner[1:] == owner[:-1], symbols[:-1] * self.size + symbols[1:], -1)
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            known = self.keys[at] == keys
            ranks = np.where(known, self.ranks[at], NONE)
            lengths = np.diff(np.concatenate([first, [len(symbols)]]))
            least = np.minimum.reduceat(ranks, first)
            over = least == NONE
            out[owner[first[over]]] = lengths[over]
            hit = known & (ranks == np.repeat(least, lengths))
            places = np.flatnonzero(hit)
            if len(places):  # of overlapping places every second one, from the left
                run = np.concatenate([[True], np.diff(places) != 1])
                begin = places[np.flatnonzero(run)][np.cumsum(run) - 1]
                places = places[(places - begin) % 2 == 0]
                symbols[places] = self.made[at[places]]
            keep = np.repeat(~over, lengths)
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out


class Counter:
    """Token counts of whole texts, as the tokenizers library gives them for the byte-level file at path."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.strings = set(added_strings(path))
        self.split = splitter(list(self.strings))
        self.merger, self.library = Merger(path), Tokenizer.from_file(path).pre_tokenizer
        self.cache = ChunkCache(self.make)

    def pre_tokens(self, chunk: str) -> list[str]:
        """By our own pattern, or beyond Greek by the library, whose tables of letters may be of another year."""
        if chunk.isascii() or max(chunk) < chr(0x370):
            return PATTERN.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenize_str(chunk)]

    def make(self, chunks: list[str]) -> Iterable[int]:
        split = [[] if c in self.strings else self.pre_tokens(c) for c in chunks]
        words = list({w for own in split for w in own})
        counts = dict(zip(words, self.merger.counts([w.encode() for w in words]).tolist(), strict=True)) if words else {}
        return [1 if c in self.strings else sum(counts[w] for w in own) for c, own in zip(chunks, split, strict=True)]

    def count(self, texts: Iterable[str]) -> Iterator[int]:
        for own in groups(texts):
            lists = [self.split(x) for x in own]
            found = self.cache.lookup(lists)
            for chunks in lists:
                yield sum(map(found.__getitem__, chunks))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per row of docs, for the byte-level tokenizers file at path.

    A null text counts as empty, with 0 tokens; special strings inside texts are one token each, as is the library's
    default; a null doc_id stays null, repeated rows are counted each, other columns are left alone. Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = hold(("counts", path), lambda: Counter(path))
        for batch in batches:
            texts = batch.column(1)
            tokens = np.fromiter(counter.count(texts.to_pylist()), np.int64, len(texts))
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
