"""Packing by power-of-two decomposition: each document becomes pieces of binary length, each a sequence of its own.

A document of n ids (its end id included) is cut into n // size pieces of the full size and one piece for each one bit
of the rest, the longest first. A sequence holds one piece, so it never crosses documents and needs no padding, and
sequences of equal length lie in one bucket: their numbers follow each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.chunks import HALF_CHARS, ids_of
from tickloom.llm.shared import bounded_batches, materialize, texts_of

END_ID = 1


def piece_lengths(n: int, size: int) -> list[int]:
    """Full pieces, then the binary digits of the rest from the highest."""
    whole, rest = divmod(n, size)
    return [size] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids.

    size is a power of two. sequence_id counts from 0 without gaps, the longest bucket first; offset is 0, since a sequence
    holds one piece. A null text counts as empty and has the end id alone. Rows repeated under a doc_id are packed each; a
    null doc_id stays null; other columns are left alone; an empty table gives an empty one. Texts aren't shuffled: a task
    numbers its own pieces, and prefix sums over (length, task) place them.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"]
    kinds = [pa.int64()] * 7
    if with_ids:
        names, kinds = [*names, "ids"], [*kinds, pa.list_(pa.int64())]

    half = HALF_CHARS if with_ids else 2 * HALF_CHARS  # rows with their ids take the memory that a larger cache would

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, ranks = ids_of(path, half=half), TaskContext.get().partitionId(), {}
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc, packed in zip(batch.column(0).to_pylist(), ids.encode(batch.column(1).to_pylist()), strict=True):
                packed += end
                at, n = 0, len(packed) // 4
                for length in piece_lengths(n, size):
                    own = packed[4 * at : 4 * (at + length)]
                    rank = ranks.get(length, 0)
                    ranks[length] = rank + 1
                    rows.append((doc, at, length, zlib.crc32(own), n, task, rank, *([memoryview(own).cast("I").tolist()] if with_ids else [])))
                    at += length
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = ", ".join(f"{n} {'array<long>' if n == 'ids' else 'long'}" for n in names)
    pieces = materialize(texts_of(docs, id_col, text_col).mapInArrow(run, schema), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))  # a row for each task and length at most
    before = Window.orderBy(F.desc("length"), "task").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its size is known: it is broadcast while it is small, and the pieces stay where they are.
    bases = materialize(counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "pieces-bases")
    out = pieces.join(bases, ["length", "task"])
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))
