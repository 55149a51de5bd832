"""Byte-level BPE as SQL: DuckDB runs a recursive query in each task, over the distinct pieces of its texts.

A piece is a run of rows (place, piece, token, after), each of which names the place after it. One step joins each
adjacent pair to the merge table, takes per piece the leftmost pair of the lowest rank and contracts it; pieces
without a pair take no further part. The recursion is keyed by place, so a step replaces rows and memory holds each
piece once. Decoding is an ordered aggregate of the tokens' bytes. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tickloom.llm.chunks import CHUNK, ChunkCache, groups
from tickloom.llm.shared import bounded_batches, hold, texts_of

#: Bytes of the pieces that one recursive query takes, and tokens that one decoding query takes.
QUERY_BYTES, DECODE_TOKENS = 100_000, 500_000
#: Characters of text whose chunks are looked up at once, and of chunks in either half of the cache.
GROUP_CHARS, HALF_CHARS = 1_000_000, 6_000_000
GONE = -1

ENCODE = f"""
WITH RECURSIVE state(place, piece, token, after) USING KEY (place) AS (
    SELECT place, piece, token, after FROM given
    UNION
    (WITH live AS MATERIALIZED (
        SELECT place, piece, token, after FROM recurring.state WHERE token <> {GONE} AND piece IN (SELECT piece FROM state)),
     best AS (
        SELECT a.piece, min(merges.made * 4294967296 + a.place) AS pick
        FROM live AS a JOIN live AS b ON a.after = b.place JOIN merges ON merges.pair = a.token * 16777216 + b.token GROUP BY a.piece),
     chosen AS (
        SELECT a.place, a.piece, best.pick // 4294967296 AS made, a.after FROM best JOIN live AS a ON a.place = best.pick % 4294967296)
     SELECT chosen.place, chosen.piece, chosen.made, b.after FROM chosen JOIN live AS b ON chosen.after = b.place
     UNION ALL
     SELECT after, piece, {GONE}, {GONE} FROM chosen)
)
SELECT piece, token FROM state WHERE token <> {GONE} ORDER BY place
"""

DECODE = """
SELECT text, string_agg(bytes, '' ORDER BY place) AS bytes
FROM ids JOIN vocabulary USING (token) GROUP BY text ORDER BY text
"""


class SqlBpe:
    """The rank file at path as tables of a DuckDB connection of one thread."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.names = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.names[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        rows = [(self.ranks[token[:k]], self.ranks[token[k:]], rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if token[:k] in self.ranks and token[k:] in self.ranks]
        left, right, made = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "250MB"})
        self.db.execute("SET preserve_insertion_order = false")
        self.db.register("merge_rows", pa.table({"lhs": left, "rhs": right, "made": made}))
        self.db.execute("CREATE TABLE merges AS SELECT lhs * 16777216 + rhs AS pair, made FROM merge_rows")
        self.db.register("names", pa.table({"token": pa.array(range(len(self.names)), pa.int64()), "bytes": pa.array([x.hex() for x in self.names])}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM names")
        self.cache = ChunkCache(self.make, HALF_CHARS, 100_000)

    def contract(self, pieces: list[bytes]) -> list[bytes]:
        """The fixpoint of each piece, as packed little-endian unsigned 32-bit ids."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        numbers = np.repeat(np.arange(len(pieces)), sizes)
        places = np.arange(ends[-1])
        after = places + 1
        after[ends - 1] = GONE
        given = pa.table({"place": places, "piece": numbers, "token": self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)], "after": after})
        self.db.register("given", given)
        got = self.db.execute(ENCODE).fetchnumpy()
        self.db.unregister("given")
        ids, cuts = np.asarray(got["token"]).astype("<u4"), np.searchsorted(np.asarray(got["piece"]), np.arange(len(pieces) + 1))
        packed = ids.tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def make(self, chunks: list[str]) -> Iterable[bytes]:
        split = [[w.encode() for w in self.pattern.findall(c)] for c in chunks]
        found: dict[bytes, bytes] = {}
        todo = []
        for word in {w for own in split for w in own}:
            rank = self.ranks.get(word)
            if rank is None:
                todo.append(word)
            else:
                found[word] = rank.to_bytes(4, "little")
        todo.sort(key=len)  # pieces of like length need like numbers of steps
        while todo:
            take, size = 0, 0
            while take < len(todo) and (not take or size + len(todo[take]) <= QUERY_BYTES):
                size += len(todo[take])
                take += 1
            own, todo = todo[:take], todo[take:]
            found.update(zip(own, self.contract(own), strict=True))
        return [b"".join(found[w] for w in own) for own in split]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of each text."""
        for own in groups(texts, GROUP_CHARS):
            lists = [CHUNK.findall(x) for x in own]
            found = self.cache.lookup(lists)
            for chunks in lists:
                yield b"".join(map(found.__getitem__, chunks))

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """The bytes of each list of packed ids; a long list is decoded in runs."""
        out = [bytearray() for _ in packed]
        at = 0
        todo = [(k, a) for k, x in enumerate(packed) for a in range(0, len(x), 4 * DECODE_TOKENS)]
        while at < len(todo):
            own, size = [], 0
            while at < len(todo) and (not own or size + len(packed[todo[at][0]]) // 4 <= DECODE_TOKENS):
                k, a = todo[at]
                own.append((k, packed[k][a : a + 4 * DECODE_TOKENS]))
                size += len(own[-1][1]) // 4
                at += 1
            sizes = [len(x) // 4 for _, x in own]
            ids = np.frombuffer(b"".join(x for _, x in own), "<u4").astype(np.int64)
            self.db.register("ids", pa.table({"text": np.repeat(np.arange(len(own)), sizes), "place": np.arange(len(ids)), "token": ids}))
            for k, text in self.db.execute(DECODE).fetchall():
                out[own[k][0]] += bytes.fromhex(text)
            self.db.unregister("ids")
        return [bytes(x) for x in out]


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]): each text encoded by the rank file and decoded again.

    pattern splits a text into pieces, none of which may join white space and what follows but for one space. A null text
    counts as empty: no ids, and the digests of no bytes. A null doc_id stays null, repeated rows are encoded each, other
    columns are left alone, an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = hold(("sql", path, pattern), lambda: SqlBpe(path, pattern))
        for batch in batches:
            packed = list(bpe.encode(batch.column(1).to_pylist()))
            columns = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array([len(x) // 4 for x in packed], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in bpe.decode(packed)], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in packed], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>" if with_ids else "")
    return texts_of(docs, id_col, text_col).mapInArrow(run, schema)
