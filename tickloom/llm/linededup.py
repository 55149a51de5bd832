"""Fuzzy duplicate lines: character shingles, MinHash bands, exact Jaccard, union-find, one line per component.

Equal lines share a 64-bit hash and are one from the start. Of each different line, minima over its hashed character
shingles give band keys; candidates are confirmed on the full shingle sets of their texts. Of each component the first
line stays, in the order of (doc_id, line); the others are cut from their documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import hashing
from tickloom.llm.linking import buckets, link
from tickloom.llm.shared import beside, bounded_batches, discard, hold, materialize, utf8


#: Characters that are hashed at once, and hashes of lines that a task remembers to have given band keys for.
BLOCK_CHARS, SEEN_LINES = 1 << 18, 1 << 19
#: Bits of a candidate's sketch.
SKETCH_BITS = 256
#: Bits of each minimum in a line's signature, minima in a word of it, and the lowest bit of each of them.
MINIMUM_BITS, IN_WORD = 3, 21
_LOWEST = np.uint64(sum(1 << (MINIMUM_BITS * k) for k in range(IN_WORD)))


@dataclass(frozen=True)
class Lines:
    """size: characters of a shingle, so few that a line of 79 characters is still linked after one edit, one of 153 after two. percent: least Jaccard similarity of two lines. bands, rows: at 85 % a pair meets in no band with a chance of 3e-4, at 90 % of 8e-6."""

    size: int = 6
    percent: int = 85
    bands: int = 11
    rows: int = 4

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        small, large = sorted((len(a), len(b)))
        if not small or 100 * small < self.percent * large:
            return False
        both = hashing.shared_count(a, b)
        return 100 * both >= self.percent * (len(a) + len(b) - both)

    @property
    def signed(self) -> int:
        """Minima in a signature."""
        return min(2 * IN_WORD, self.bands * self.rows)

    def most_unlike(self) -> int:
        """Minima in which the signatures of linked lines may be unlike: in more they are with a chance under 1e-9 at the threshold, and less above it."""
        n, apart, tail = self.signed, (1 - self.percent / 100) * (1 - 0.5**MINIMUM_BITS), 0.0
        for k in range(n, 0, -1):
            tail += comb(n, k) * apart**k * (1 - apart) ** (n - k)
            if tail > 1e-9:
                return k
        return 0


def _code_table(seed: int) -> np.ndarray:
    return hashing.mix(np.arange(1, 65_537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hashing.constants(seed, 1))


_CODES = _code_table(53)
_BLANK = np.zeros(65_536, bool)
_BLANK[[9, 11, 12, 13, 32]] = True


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _looked_up(table: np.ndarray, points: np.ndarray) -> np.ndarray:
    """table's value of each character; beyond the table's end one that is mixed from both halves of the number."""
    if not len(points) or int(points.max()) < len(table):
        return table[points]
    out = table[points & 0xFFFF]
    high = points > 0xFFFF
    if out.dtype == bool:
        out[high] = False
    else:
        out[high] = hashing.mix(out[high] + points[high].astype(np.uint64))
    return out


def line_bounds(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each line; the newlines belong to none."""
    breaks = np.flatnonzero(points == 10)
    return np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(points)]])


def prefix_sums(points: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
    """Sums of the characters' codes times powers of the base, from 0 on: any run's hash is a difference."""
    out = np.zeros(len(points) + 1, np.uint64)
    up, _ = hashing.table(len(points) + 1)
    np.cumsum((_looked_up(_CODES, points) if codes is None else codes) * up[: len(points)], out=out[1:])
    return out


def char_grams(sums: np.ndarray, size: int) -> np.ndarray:
    """The hash of the shingle that begins at each character."""
    n = max(0, len(sums) - size)
    _, down = hashing.table(len(sums))
    return hashing.mix((sums[size : size + n] - sums[:n]) * down[:n])


def line_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each line, of its characters and their order."""
    _, down = hashing.table(len(sums))
    return hashing.mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)).view(np.int64)


def line_checks(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of each line, of its characters' codes without their order."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes, out=sums[1:])
    return hashing.mix((sums[end] - sums[begin]) ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)


def _not_blank(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which lines have more than white space; most show it in their first character."""
    out = end > begin
    out[out] = ~_looked_up(_BLANK, points[begin[out]])
    for k in np.flatnonzero(~out & (end > begin)).tolist():
        out[k] = not _looked_up(_BLANK, points[begin[k] : end[k]]).all()
    return out


def _windows(text: str, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of a long line (begin, characters of its own, its characters and the next size - 1 ones) of windows that cover it."""
    for a in range(0, len(text), BLOCK_CHARS):
        yield a, min(BLOCK_CHARS, len(text) - a), characters(text[a : a + BLOCK_CHARS + size - 1])


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of a line's shingles; a line shorter than one is one."""
    if len(text) < size:
        points = characters(text)
        return line_hashes(prefix_sums(points), np.array([0]), np.array([len(points)])).view(np.uint64)
    return np.unique(np.concatenate([np.unique(char_grams(prefix_sums(points), size)) for _, _, points in _windows(text, size)]))


def line_sets(lines: Lines):
    """Of texts that are one line each the sorted sets of their shingles' hashes; many are hashed at once."""
    size = lines.size

    def sets(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        while len(out) < len(bounds) - 1:
            k = len(out)
            to = max(k + 1, int(np.searchsorted(bounds, bounds[k] + BLOCK_CHARS, "right")) - 1)
            part = data[bounds[k] : bounds[to]]
            text = part.tobytes().decode("utf-8")
            if len(text) > BLOCK_CHARS:
                out.append(shingle_set(text, size))
                continue
            at = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[bounds[k : to + 1] - bounds[k]].tolist()
            grams = char_grams(prefix_sums(characters(text)), size)
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b - a < size:
                    out.append(shingle_set(text[a:b], size))
                else:
                    own = np.sort(grams[a : b - size + 1])
                    new = np.ones(len(own), bool)
                    np.not_equal(own[1:], own[:-1], out=new[1:])
                    out.append(own[new])
        return out

    return sets


def line_sketches(lines: Lines):
    """For mapInArrow over (id, text): (id, sketch) of lines, the size of the shingle set and then, for each of SKETCH_BITS, the parity of the shingles that fall to it."""
    sets = line_sets(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sets(*utf8(batch.column(1)))
            sizes = np.array([len(x) for x in own], np.uint64)
            out = [np.zeros(0, np.uint64)]
            for a in range(0, len(own), 512):
                n = len(own[a : a + 512])
                place = np.concatenate(own[a : a + n]) % np.uint64(SKETCH_BITS) + np.repeat(np.arange(n, dtype=np.uint64), sizes[a : a + n].astype(np.int64)) * np.uint64(SKETCH_BITS)
                odd = np.bincount(place.astype(np.int64), minlength=n * SKETCH_BITS) & 1
                bits = np.packbits(odd.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.uint64)
                out.append(np.concatenate([sizes[a : a + n, None], bits], axis=1).ravel())
            packed = np.concatenate(out).reshape(len(own), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in packed], pa.binary())], names=["id", "sketch"])

    return run


def may_link(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of sketches may be of linked lines. Exact: two sets differ in as many shingles as their parities at least, and linked ones of m and n in
    (m + n) (100 - percent) / (100 + percent) at most."""
    apart = np.bitwise_count(a[..., 1:] ^ b[..., 1:]).sum(axis=-1, dtype=np.int64)
    return apart * (100 + percent) <= (a[..., 0] + b[..., 0]).astype(np.int64) * (100 - percent)


def signatures(minima: np.ndarray, n: int) -> np.ndarray:
    """Of rows of 32-bit minima two words with a few bits of each of the first n."""
    bits = ((minima[:, :n] * np.uint32(0x9E3779B1)) >> np.uint32(32 - MINIMUM_BITS)).astype(np.uint64)
    out = np.zeros((len(bits), 2), np.uint64)
    for k in range(n):
        out[:, k // IN_WORD] |= bits[:, k] << np.uint64(MINIMUM_BITS * (k % IN_WORD))
    return out.view(np.int64)


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many minima signatures differ."""
    apart = a ^ b
    return np.bitwise_count((apart | (apart >> np.uint64(1)) | (apart >> np.uint64(2))) & _LOWEST).sum(axis=-1, dtype=np.int64)


def _words(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), ">u8").astype(np.uint64).reshape(len(column), -1)


def _close_pairs(most: int):
    """For mapInArrow over (a, b, sketch_a, sketch_b): the pairs whose signatures are unlike in so many minima at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = unlike(*(_words(batch.column(k).to_pylist()) for k in (2, 3))) <= most
                yield batch.select([0, 1]).filter(pa.array(near))

    return lambda pairs: pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _close_block(most: int):
    """From a group's signatures to its matrix of pairs that may be linked."""

    def matrix(sketches: np.ndarray) -> np.ndarray:
        words = np.ascontiguousarray(sketches).view(">u8").astype(np.uint64)
        return np.stack([unlike(x, words) <= most for x in words])

    return matrix


def segments(texts: list[str]) -> Iterator[tuple[int, int, str]]:
    """(text, number of its first line, lines) of pieces of texts, cut at newlines; only a single line is longer than BLOCK_CHARS."""
    for k, text in enumerate(texts):
        at = line = 0
        while len(text) - at > BLOCK_CHARS:
            cut = text.rfind("\n", at, at + BLOCK_CHARS)
            cut = text.find("\n", at + BLOCK_CHARS) if cut < 0 else cut
            if cut < 0:
                break
            yield k, line, text[at:cut]
            line += text.count("\n", at, cut) + 1
            at = cut + 1
        yield k, line, text[at:]


def _blocks(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """Runs of segments of about BLOCK_CHARS; a longer line is alone."""
    own: list[tuple[int, int, str]] = []
    held = 0
    for x in segments(texts):
        if own and held + len(x[2]) > BLOCK_CHARS:
            yield own
            own, held = [], 0
        own.append(x)
        held += len(x[2]) + 1
    if own:
        yield own


class _Signer:
    """Hashes of lines, and minima over the shingles of those that weren't met before."""

    def __init__(self, lines: Lines):
        self.lines, self.seen = lines, set()
        self.times, self.plus = (hashing.constants(seed, lines.bands * lines.rows).astype(np.uint32) for seed in (55, 56))

    def new(self, hashes: np.ndarray) -> np.ndarray:
        """Which are met for the first time, as far back as the task remembers."""
        _, first = np.unique(hashes, return_index=True)
        first.sort()
        values = hashes[first].tolist()
        if len(self.seen) > SEEN_LINES:
            self.seen = set()
        keep = first[np.fromiter((x not in self.seen for x in values), bool, len(values))]
        self.seen.update(values)
        return keep

    def minima(self, grams: np.ndarray, cuts: np.ndarray, step: int) -> np.ndarray:
        out = np.empty((len(self.times), -(-len(cuts) // step)), np.uint32)
        scratch = np.empty_like(grams)
        for j in range(len(out)):
            np.multiply(grams, self.times[j], out=scratch)
            np.add(scratch, self.plus[j], out=scratch)
            out[j] = np.minimum.reduceat(scratch, cuts)[::step]
        return out.T

    def keys(self, minima: np.ndarray) -> np.ndarray:
        return hashing.band_keys(minima.astype(np.uint64), self.lines.bands, self.lines.rows)

    def block(self, own: list[tuple[int, int, str]]) -> tuple[np.ndarray, ...] | None:
        """(text, line number, hash, check, rows with keys, their keys, their signatures) of the lines that aren't blank."""
        size = self.lines.size
        points = characters("\n".join(x for *_, x in own))
        begin, end = line_bounds(points)
        per = np.array([x.count("\n") + 1 for *_, x in own])
        doc = np.repeat([k for k, *_ in own], per)
        number = np.arange(len(begin)) - np.repeat(np.cumsum(per) - per, per) + np.repeat([n for _, n, _ in own], per)
        full = _not_blank(points, begin, end)
        begin, end, doc, number = begin[full], end[full], doc[full], number[full]
        if not len(begin):
            return None
        codes = _looked_up(_CODES, points)
        sums = prefix_sums(points, codes)
        hashes, check = line_hashes(sums, begin, end), line_checks(codes, begin, end)
        new = self.new(hashes)
        long = new[end[new] - begin[new] >= size]  # a short line is one shingle, so only an equal one is like it
        minima = np.zeros((0, len(self.times)), np.uint32)
        if len(long):
            grams = (char_grams(sums, size) >> np.uint64(32)).astype(np.uint32)
            cuts = np.empty(2 * len(long), np.int64)
            cuts[::2], cuts[1::2] = begin[long], end[long] - size + 1
            minima = self.minima(grams, cuts[:-1] if cuts[-1] >= len(grams) else cuts, 2)
        return doc, number, hashes, check, long, self.keys(minima), signatures(minima, self.lines.signed)

    def line(self, doc: int, number: int, text: str) -> tuple[np.ndarray, ...] | None:
        """As block(), of one line that is longer than a block, window by window."""
        if not text.strip(" \t\v\f\r"):
            return None
        total = check = 0
        least = np.full(len(self.times), np.iinfo(np.uint32).max, np.uint32)
        for a, n, points in _windows(text, self.lines.size):
            codes = _looked_up(_CODES, points)
            sums = prefix_sums(points, codes)
            total += int(sums[n]) * hashing.power(a)
            check += int(codes[:n].sum(dtype=np.uint64))
            grams = (char_grams(sums, self.lines.size) >> np.uint64(32)).astype(np.uint32)
            if len(grams):
                least = np.minimum(least, self.minima(grams, np.array([0]), 1)[0])
        whole = [np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64) for x in (total + len(text), check ^ 0x5851F42D4C957F2D)]
        hashes, checks = (hashing.mix(x).view(np.int64) for x in whole)
        rows = self.new(hashes)
        minima = least[None][: len(rows)]
        return np.array([doc]), np.array([number]), hashes, checks, rows, self.keys(minima), signatures(minima, self.lines.signed)

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        self.seen = set()
        for batch in batches:
            ids, parts, at = batch.column(0).to_numpy(zero_copy_only=False), [], 0
            for own in _blocks(batch.column(1).to_pylist()):
                found = self.line(*own[0]) if len(own[0][2]) > BLOCK_CHARS else self.block(own)
                if found:
                    doc, number, hashes, check, rows, *of_rows = found
                    parts.append((doc, number, hashes, check, rows + at, *of_rows))
                    at += len(hashes)
            if parts:
                doc, number, hashes, check, rows, keys, words = (np.concatenate(x) for x in zip(*parts, strict=True))
                packed: list[bytes | None] = [None] * len(hashes)
                for k, own in zip(rows.tolist(), keys, strict=True):
                    packed[k] = own.tobytes()
                order = np.lexsort((number, hashes, doc))
                first = np.ones(len(order), bool)
                first[1:] = (doc[order[1:]] != doc[order[:-1]]) | (hashes[order[1:]] != hashes[order[:-1]])
                lead = np.empty(len(order), np.int32)
                lead[order] = number[order[first]][np.cumsum(first) - 1]
                signature, none = np.zeros((len(hashes), 2), np.int64), np.ones(len(hashes), bool)
                signature[rows], none[rows] = words, False
                columns = [pa.array(ids[doc]), pa.array(number.astype(np.int32)), pa.array(lead), pa.array(hashes), pa.array(check), pa.array(packed, pa.binary()), *(pa.array(x, mask=none) for x in signature.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "lead", "hash", "check", "keys", "s0", "s1"])


def _hashes(own: list[str]) -> np.ndarray:
    """The hashes that a signer gives the lines."""
    out = np.zeros(len(own), np.int64)
    a = 0
    while a < len(own):
        b, size = a, 0
        while b < len(own) and (b == a or size + len(own[b]) <= BLOCK_CHARS):
            size += len(own[b]) + 1
            b += 1
        if size > BLOCK_CHARS + 1:
            total = sum(int(prefix_sums(points)[n]) * hashing.power(k) for k, n, points in _windows(own[a], 1))
            out[a:b] = hashing.mix(np.array([(total + len(own[a])) & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)
        else:
            points = characters("\n".join(own[a:b]))
            out[a:b] = line_hashes(prefix_sums(points), *line_bounds(points))
        a = b
    return out


def _picker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, lines, hashes) to (id, text) of those lines; of texts that share a doc_id only the one that has the line gives it."""
    for batch in batches:
        wanted, out, ids = batch.column(1), [], batch.column(2).flatten().to_numpy()
        numbers, ends = wanted.flatten().to_pylist(), wanted.offsets.to_numpy()
        ends = (ends - ends[0]).tolist()
        keep = np.zeros(len(ids), bool)
        for k, text in enumerate(batch.column(0).to_pylist()):
            own = text.split("\n")
            for i in range(ends[k], ends[k + 1]):
                if numbers[i] < len(own):
                    keep[i] = True
                    out.append(own[numbers[i]])
        same = _hashes(out) == ids[keep]
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep][same]), pa.array(out, pa.string()).filter(pa.array(same))], names=["id", "text"])


def _cutter(at: int, width: int):
    """Column at without the lines that the last column lists; a text that loses all its lines becomes empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, texts = batch.column(width), batch.column(at)
            hit = pc.and_(gone.is_valid(), texts.is_valid())
            drops, left = [set(x) for x in gone.filter(hit).to_pylist()], []
            for text, drop in zip(texts.filter(hit).to_pylist(), drops, strict=True):
                left.append("\n".join([x for k, x in enumerate(text.split("\n")) if k not in drop]))
            if left:
                texts = pc.replace_with_mask(texts, hit, pa.array(left, texts.type))
            columns = [texts if k == at else batch.column(k) for k in range(width)]
            counts = np.zeros(batch.num_rows, np.int64)
            counts[hit.to_numpy(zero_copy_only=False)] = [len(x) for x in drops]
            lost = pa.array(counts)
            yield pa.RecordBatch.from_arrays([*columns, lost], names=[*batch.schema.names[:width], batch.schema.names[width]])

    return run


def dropped_lines(docs: DataFrame, lines: Lines = Lines(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, gone: array of line numbers from 0) of the documents that lose lines."""
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    signed = plain.mapInArrow(_Signer(lines).run, "doc_id long, line int, lead int, hash long, check long, keys binary, s0 long, s1 long")
    # A row with keys becomes two, so that the keys, most of what is written, can go as soon as they have been dealt.
    both = F.when(F.col("keys").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    signed = signed.select("*", F.explode(both).alias("keyed"))
    signed = materialize(signed.withColumn("keys", F.when(F.col("keyed"), F.col("keys"))).withColumns({c: F.when(~F.col("keyed"), F.col(c)) for c in ("doc_id", "line", "lead", "check", "s0", "s1")}), "lines-signed", "zstd", "keyed")
    keyed = beside(signed)
    members = buckets(keyed.select(F.col("hash").alias("id"), "keys"), lines.bands * keyed.count(), "lines-members")
    discard(keyed)
    # lead is a document's first line of that hash, the same in all its rows, so these are plain numbers, which a hash table can hold.
    once = signed.groupBy("hash").agg(
        F.min("doc_id").alias("doc_id"), F.min_by("lead", "doc_id").alias("line"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.count(F.lit(1)).alias("n"),
        F.max("s0").alias("s0"), F.max("s1").alias("s1"),
    )
    once = once.select("hash", F.struct("doc_id", "line").alias("first"), "c0", "c1", "n", "s0", "s1")
    # Lines that came once and share no band's key are alone, so only the others are written: most lines are never dealt again.
    flagged = members.select(F.col("id").alias("hash"), F.lit(True).alias("shares")).distinct()
    held = materialize(once.join(flagged.hint("shuffle_hash"), "hash", "left").where("n > 1 or shares"), "lines-held")

    def texts(ids: DataFrame) -> DataFrame:
        """One place of each line, then its text from that document. The documents are the larger side, and needn't be sorted."""
        one = held.join(ids.withColumnRenamed("id", "hash").hint("shuffle_hash"), "hash", "left_semi").select(F.col("first.doc_id"), F.struct("first.line", "hash").alias("own"))
        wanted = one.groupBy("doc_id").agg(F.collect_list("own").alias("own"))  # a document's own lines at most
        return plain.join(wanted.hint("shuffle_hash"), "doc_id").select("text", F.col("own.line").alias("lines"), F.col("own.hash").alias("hashes")).mapInArrow(_picker, "id long, text string")

    # Lines of a large table meet others by chance, with the square of their number, so pairs are held against signatures before any text moves.
    word = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    sketches = held.where("shares").select(F.col("hash").alias("id"), F.concat(word("s0"), word("s1")).alias("sketch"))
    most = lines.most_unlike()
    known = link(members, texts, line_sets(lines), lines.linked, lines.percent, "lines", sketches, _close_pairs(most), _close_block(most))
    each = held.drop("s0", "s1", "shares").join(known.withColumnRenamed("id", "hash").hint("shuffle_hash"), "hash", "left").where("n > 1 or component is not null")  # the others are alone
    each = materialize(each.withColumn("component", F.coalesce("component", "hash")), "lines-each")
    # Written, so that the join on a component, which may hold many lines, has two plain shuffles.
    stays = materialize(each.groupBy("component").agg(F.min("first").alias("stays"), F.sum("n").alias("all")).where("all > 1"), "lines-stays")
    fate = each.where("c0 = c1").join(stays, "component").select("hash", "stays")  # two lines that share a hash by chance both stay
    gone = signed.select("hash", "doc_id", "line").join(fate.hint("shuffle_hash"), "hash").where("stays.doc_id <> doc_id or stays.line <> line")
    out = materialize(gone.groupBy("doc_id").agg(F.collect_set("line").alias("gone")), "lines-gone")
    for x in (signed, held, each, stays, known):
        discard(x)
    return out


def dedup_lines(docs: DataFrame, lines: Lines = Lines(), id_col: str = "doc_id", text_col: str = "text", lost_col: str = "lines_dropped") -> DataFrame:
    """docs with one line of each component of like lines in the text column, and lost_col: how many lines a row lost.

    Lines end at newlines; blank ones always stay and are compared with nothing. Lines are linked at lines.percent of Jaccard
    similarity of their character shingles; a line shorter than a shingle is like equal ones only. The smallest (doc_id, line)
    of a component stays. Null and empty texts stay as they are; a text that loses all its lines becomes empty. Rows with a null
    doc_id are left whole. doc_id names a text: rows repeated under one lose the same lines. All other columns keep their values.
    A text longer than a block is hashed piece by piece, one long line window by window. An empty table gives an empty one.
    """
    names = docs.columns
    gone = dropped_lines(docs, lines, id_col, text_col).select(F.col("doc_id").alias("__tickloom_doc"), F.col("gone").alias("__tickloom_gone"))
    # The documents are the larger side: dealt by their id at any size, and not sorted.
    both = docs.join(gone.hint("shuffle_hash"), docs[id_col].cast("long") == F.col("__tickloom_doc"), "left").select(*[docs[c] for c in names], F.col("__tickloom_gone").alias(lost_col))
    schema = docs.select(*names).withColumn(lost_col, F.lit(0).cast("long")).schema
    return both.mapInArrow(_cutter(names.index(text_col), len(names)), schema)
