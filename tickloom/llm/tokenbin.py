"""Token files: flat unsigned ids and 64-bit document offsets, one shard per range of doc_id, read by memory map.

Shard k has three files: k.bin, all ids of its documents in order, 16 bits each if the tokenizer's largest id allows, else 32;
k.off, n + 1 signed 64-bit offsets into k.bin, in ids; k.doc, n signed 64-bit doc_ids and then n bytes, 0 where the
doc_id was null. Shards are ranges of doc_id in order; a shard's base is the prefix sum of the ids in those before it.
Files are written under a name of their own and then renamed, so a task that runs twice leaves one whole shard.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.chunks import ids_of
from tickloom.llm.shared import bounded_batches, materialize, new_folder, texts_of

END_ID = 1


def _open(folder: str):
    return arrow_fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder))


def _uri(folder: str) -> str:
    return "file://" + folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder


def largest_id(path: str) -> int:
    """The largest id that the tokenizers file at path can give."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    return max([*own["model"]["vocab"].values(), *(x["id"] for x in own["added_tokens"])])


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID, drop_white: bool = True, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Encodes docs by the tokenizers file at path and writes the shards; returns the folder and the manifest (shard, n_docs, n_ids).

    Documents lie in ascending doc_id order, null doc_ids first, rows of one doc_id by their text; a null text counts as
    empty and has the end id alone; a very long one is encoded whole. drop_white: the tokenizer ignores white space, so words may be looked up alone. Other
    columns are left alone; an empty table writes no shard.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = _uri(folder or new_folder(spark, "tokens"))
    kind = "<u2" if max(largest_id(path), end_id) < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, shard = ids_of(path, drop_white), TaskContext.get().partitionId()
        store, top = _open(folder)
        store.create_dir(top, recursive=True)
        own, names = uuid.uuid4().hex, ("bin", "off", "doc")
        out, total, offsets, numbers, valid = None, 0, [np.zeros(1, np.int64)], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or store.open_output_stream(f"{top}/.{shard}.bin.{own}")
            sizes = []
            for packed in ids.encode(batch.column(1).to_pylist()):
                values = np.append(np.frombuffer(packed, "<u4"), np.uint32(end_id)).astype(kind)
                out.write(values.tobytes())
                sizes.append(len(values))
            offsets.append(total + np.cumsum(sizes))
            total = int(offsets[-1][-1])
            numbers.append(batch.column(0).fill_null(0).to_numpy())
            valid.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
        if out:
            out.close()
            with store.open_output_stream(f"{top}/.{shard}.off.{own}") as f:
                f.write(np.concatenate(offsets).astype("<i8").tobytes())
            with store.open_output_stream(f"{top}/.{shard}.doc.{own}") as f:
                f.write(np.concatenate(numbers).astype("<i8").tobytes() + np.concatenate(valid).tobytes())
            for name in names:
                store.move(f"{top}/.{shard}.{name}.{own}", f"{top}/{shard}.{name}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [sum(map(len, numbers))], "n_ids": [total]})

    ranged = texts_of(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return folder, materialize(ranged.mapInArrow(run, "shard long, n_docs long, n_ids long"), "manifest")


def _mapped(store, name: str, kind: str) -> np.ndarray:
    """A file as a memory map; one that isn't on a mounted file system is first copied to this executor's disk."""
    if isinstance(store, arrow_fs.LocalFileSystem):
        return np.memmap(name, kind, "r") if os.path.getsize(name) else np.zeros(0, kind)
    with tempfile.NamedTemporaryFile() as local, store.open_input_stream(name) as f:
        while part := f.read(1 << 22):
            local.write(part)
        local.flush()
        return np.memmap(local.name, kind, "r") if local.tell() else np.zeros(0, kind)


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False, rows: int = 4096) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in the files; start counts the ids of all documents before it. An id's width is that of the file by its ids.

    The manifest has one row per shard, so its prefix sums fit the driver; each shard is one task.
    """
    shards = sorted((x["shard"], x["n_ids"]) for x in manifest.select("shard", "n_ids").collect())
    bases, total = [], 0
    for shard, n in shards:
        bases.append((shard, total))
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard, base = bases[k]
                flat, offsets = _mapped(store, f"{top}/{shard}.bin", "u1"), _mapped(store, f"{top}/{shard}.off", "<i8")
                ids = flat.view("<u2" if len(flat) == 2 * offsets[-1] else "<u4")
                raw, n = _mapped(store, f"{top}/{shard}.doc", "u1"), len(offsets) - 1
                numbers, valid = raw[: 8 * n].view("<i8"), raw[8 * n :]
                for a in range(0, n, rows):
                    b = min(n, a + rows)
                    each = [ids[offsets[i] : offsets[i + 1]].astype("<u4") for i in range(a, b)]
                    columns = [
                        pa.array(np.asarray(numbers[a:b]), mask=np.asarray(valid[a:b]) == 0),
                        pa.array(base + np.asarray(offsets[a:b])),
                        pa.array(np.diff(np.asarray(offsets[a : b + 1]))),
                        pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return spark.range(0, len(bases), 1, max(1, len(bases))).mapInArrow(run, schema)


def token_files(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes docs as token files in the shared folder and returns what the files hold, one row per document."""
    folder, manifest = write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, folder, manifest)
