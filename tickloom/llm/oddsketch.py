"""Near-duplicate documents: MinHash bands, odd sketches as a filter, exact Jaccard on full sets, components.

Each document becomes its set of distinct word shingles. Documents of equal sets form one class, whose
smallest doc_id stands for it, so copies cost nothing further. Of each class, k MinHash samples give band keys
and fold into an odd sketch: sample j toggles one bit of a bitmap. Of two documents that differ in d samples
the bitmaps' XOR has n/2 (1 - (1 - 2/n)^2d) ones on average, which tells high similarities apart precisely.
Candidates of the bands whose sketches are surely too far apart are dropped before any text moves; the others
are confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import hashing
from tickloom.llm.linking import buckets, link
from tickloom.llm.shared import bounded_batches, discard, hold, materialize, texts_of, utf8


@dataclass(frozen=True)
class Near:
    """words: of a shingle. percent: least Jaccard similarity. bands, rows: at 75 % a linked pair meets in no band with a chance of 2e-5.
    bits: of a sketch. slack: standard deviations of the estimate by which a pair may miss the threshold and still be confirmed exactly."""

    words: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 5
    bits: int = 1024
    slack: float = 6.0

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def most_ones(self) -> int:
        """Ones in the XOR of two sketches beyond which the pair is surely below the threshold."""
        j, k, n = self.percent / 100, self.samples, self.bits
        differ = k * (1 - j) + self.slack * math.sqrt(k * j * (1 - j))
        mean = n / 2 * (1 - (1 - 2 / n) ** (2 * min(differ, k)))
        return math.ceil(mean + self.slack / 2 * math.sqrt(max(mean * (1 - mean / n) * (2 * differ / n), 1)))

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        small, large = sorted((len(a), len(b)))
        if not small or 100 * small < self.percent * large:
            return False
        both = hashing.shared_count(a, b)
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def odd_sketches(minima: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps of rows of MinHash samples, packed into bytes."""
    n, k = minima.shape
    out = np.zeros((n, bits // 8), np.uint8)
    place = (hashing.mix(minima ^ hashing.constants(41, k)) % np.uint64(bits)).astype(np.int64)
    for a in range(0, n, 512):
        part = place[a : a + 512]
        flat = np.bincount((part + np.arange(len(part))[:, None] * bits).ravel(), minlength=len(part) * bits)
        out[a : a + 512] = np.packbits((flat & 1).astype(np.uint8).reshape(len(part), bits), axis=1)
    return out


def ones_apart(sketches: np.ndarray) -> np.ndarray:
    """Matrix of XOR population counts of rows of bytes."""
    words = np.ascontiguousarray(sketches).view(np.uint64)
    out = np.zeros((len(words), len(words)), np.int32)
    for j in range(words.shape[1]):
        out += np.bitwise_count(words[:, j][:, None] ^ words[:, j][None, :])
    return out


def _signer(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            sets = hashing.shingle_sets(*utf8(batch.column(1)), near.words)
            minima = hashing.minhashes(sets, near.samples)
            digest = hashing.set_digest(sets)
            keys = hashing.band_keys(minima, near.bands, near.rows)
            sketch = odd_sketches(minima, near.bits)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(digest[:, 0]),
                    pa.array(digest[:, 1]),
                    pa.array([x.tobytes() for x in keys], pa.binary()),
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "keys", "sketch"],
            )

    return run


def _ones(column_a: str, column_b: str, bits: int):
    """XOR population count of two binary columns as an expression."""
    part = lambda c, i: F.conv(F.substring(F.hex(c), i * 15 + 1, 15), 16, 10).cast("long")  # noqa: E731  15 hex digits stay positive
    total = F.lit(0)
    for i in range(math.ceil(bits / 4 / 15)):
        total = total + F.bit_count(part(column_a, i).bitwiseXOR(part(column_b, i)))
    return total


def near_duplicates(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of docs.

    Words are runs without ASCII white space, A-Z lower-cased. A text with fewer words than a shingle is one shingle;
    one without words (null, empty, blank) has none and is linked with nothing. component_id is the smallest doc_id
    reachable over links of at least near.percent, kept says that it is the row's own. Sets are of 64-bit shingle hashes.
    Equal sets tie to the smallest doc_id. Rows that share a doc_id are one document: its links are those of all of them,
    and each row gets the common component. A row with a null doc_id joins its class's component but stands for nothing:
    it is kept unless the class has a doc_id. Other columns are left alone; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = texts_of(docs, id_col, text_col)
    signed = materialize(plain.mapInArrow(_signer(near), "doc_id long, n_shingles long, set_a long, set_b long, keys binary, sketch binary"), "near-signed")
    classes = materialize(signed.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id")), "near-classes")
    stand = signed.where("n_shingles > 0").select("set_a", "set_b", F.col("doc_id").alias("id"), "keys", "sketch").join(classes, ["set_a", "set_b", "id"]).dropDuplicates(["set_a", "set_b", "id"])
    stand = materialize(stand.select("id", "keys", "sketch"), "near-stand")
    members = buckets(stand, near.bands * stand.count(), "near-members")
    most = near.most_ones()
    known = link(
        members,
        lambda ids: plain.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi"),
        lambda data, bounds: hashing.shingle_sets(data, bounds, near.words),
        near.linked,
        near.percent,
        "near",
        stand.select("id", "sketch"),
        lambda pairs: pairs.where(_ones("sketch_a", "sketch_b", near.bits) <= most),
        lambda group: ones_apart(group) <= most,
    )
    discard(stand)
    named = classes.join(known, "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_a")).alias("set_a"), "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep_one(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose document isn't the one that stays of its component; all columns as they were.

    Rows with a null doc_id stay: nothing names them.
    """
    gone = near_duplicates(docs, near, id_col, text_col).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__tickloom_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__tickloom_gone"], "left_anti")
