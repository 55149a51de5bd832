"""Copies of images, cropped, turned, scaled or edited, by local descriptors.

Corners are found at scales a factor of 1.2 apart; a patch about each, turned to its orientation, gives 256 binary tests, which are 1 only if
the difference stands out of the patch. Tables on parts of 32 of these bits find the images that share several corners with a query: a
part that many images share is looked up with 16 more bits, and not at all if many share it even so. Of a query with such common parts every
part is also looked up with all images in blocks, however many share it, and images are found by the places whose parts agree on a
rough transform. A query nearly all of whose parts are common is compared with every descriptor of the index. What is found is compared
descriptor by descriptor, and a similarity transform makes two images copies that enough of their matches agree on: enough places, and more
than so many matches would bring together by chance. Alike corners, as of plain shapes, match many others, and some of those agree on anything.
Images that are equal byte by byte are one class from the start and are searched once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.hashing import constants, mix
from tickloom.llm.shared import bounded_batches, discard, hold, materialize

BITS, RADIUS, TURNS, SCALE = 256, 11, 40, 1.2
#: Pixels about a level's image that repeat its edge, nearest place of a corner to the edge, and the least side of a level.
PAD, EDGE, SIDE_LEAST = 14, 4, 36
#: Corners of a block of images and of queries, and of how many of each are compared at once; corners of such blocks where only parts are looked up.
INDEX_BLOCK, QUERY_BLOCK, STEP = 1 << 14, 1 << 13, (32, 512)
PART_INDEX_BLOCK, PART_QUERY_BLOCK = 1 << 17, 1 << 15
#: Entries of the tables that a task holds, in 8 bytes each, and shared parts of blocks that are counted at once.
PART_ENTRIES, SHARED_STEP = 1 << 22, 1 << 20
#: Pixels, levels and turns by which the parts of a cell of rough transforms may differ. A second grid of cells lies half a cell off.
CELL = (24, 3, 5)

CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("level", "u1"), ("turn", "u1"), ("tests", "u1", BITS // 8)])


@dataclass(frozen=True)
class Copies:
    """area: pixels of a level for each corner that it keeps, the strongest first. least: corners of a level at least.
    stand_out: deviations of the patch by which two places must differ. tables: of the 8 parts. most: images that share a part without its being
    common. votes: parts that a query and an image must share. enough: parts of a query, so many of which must not be common.
    apart: most differing bits of a match. miss: pixels by which a match may miss the transform. agree, share: places that must agree, and
    their part of the places of the image that has fewer. chance: transforms that so many places may be expected to agree on by chance."""

    area: int = 900
    least: int = 8
    stand_out: float = 0.25
    tables: int = 6
    most: int = 32
    votes: int = 4
    enough: int = 40
    apart: int = 32
    miss: float = 2.5
    agree: int = 7
    share: float = 0.3
    chance: float = 1e-6


def _tests() -> np.ndarray:
    """(turn, test, point, yx): the places that each test compares, for each turn of a patch."""
    draws = mix(constants(71, 4 * BITS)).reshape(4, BITS)
    unit = draws.astype(np.float64) / 2.0**64
    radius, angle = RADIUS * np.sqrt(unit[[0, 2]]), 2 * np.pi * unit[[1, 3]]
    turned = angle[None] + (2 * np.pi / TURNS) * np.arange(TURNS)[:, None, None]
    return np.rint(np.stack([radius * np.sin(turned), radius * np.cos(turned)], axis=-1)).astype(np.int64).transpose(0, 2, 1, 3)


def _disk() -> np.ndarray:
    own = np.arange(-RADIUS, RADIUS + 1)
    y, x = np.meshgrid(own, own, indexing="ij")
    inside = y * y + x * x <= RADIUS * RADIUS
    return np.stack([y[inside], x[inside]], axis=1)


TESTS, DISK = _tests(), _disk()


def _slide(images: np.ndarray, r: int, axis: int, combine: np.ufunc) -> np.ndarray:
    """combine over 2 r + 1 neighbours along an axis, edges repeated."""
    padded = np.pad(images, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="edge")
    part = lambda k: padded[tuple(slice(k, k + n) if a == axis else slice(None) for a, n in enumerate(images.shape))]
    out = part(0).copy()
    for k in range(1, 2 * r + 1):
        combine(out, part(k), out=out)
    return out


def box(images: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2 r + 1, edges repeated."""
    return _slide(_slide(images, r, 1, np.add), r, 2, np.add) * np.float32(1 / (2 * r + 1) ** 2)


def corner_strength(images: np.ndarray) -> np.ndarray:
    smooth = box(images, 1)
    gy, gx = np.zeros_like(smooth), np.zeros_like(smooth)
    gy[:, 1:-1] = smooth[:, 2:] - smooth[:, :-2]
    gx[:, :, 1:-1] = smooth[:, :, 2:] - smooth[:, :, :-2]
    xx, yy, xy = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
    return xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2


def peaks(strength: np.ndarray) -> np.ndarray:
    """strength where it is the largest of its 5 x 5 square and lies off the edge, else 0."""
    out = np.where((strength > 1) & (strength == _slide(_slide(strength, 2, 1, np.maximum), 2, 2, np.maximum)), strength, 0)
    inside = np.zeros(strength.shape[1:], bool)
    inside[EDGE:-EDGE, EDGE:-EDGE] = True
    return out * inside


def describe_level(images: np.ndarray, corners: int, stand_out: float) -> tuple[np.ndarray, ...]:
    """(image, y, x, turn, packed tests) of the strongest corners of images of one size."""
    n, h, w = images.shape
    found = peaks(corner_strength(images)).reshape(n, -1)
    order = np.argsort(-found, axis=1, kind="stable")[:, :corners]
    image, column = np.nonzero(np.take_along_axis(found, order, 1) > 0)
    y, x = np.divmod(order[image, column], w)
    wide = w + 2 * PAD
    smooth = np.pad(box(images, 2), ((0, 0), (PAD, PAD), (PAD, PAD)), mode="edge").reshape(n, -1)
    centre = ((y + PAD) * wide + x + PAD)[:, None]
    patch = smooth[image[:, None], centre + (DISK[:, 0] * wide + DISK[:, 1])]
    angle = np.arctan2(patch @ DISK[:, 0].astype(np.float32), patch @ DISK[:, 1].astype(np.float32))
    turn = np.rint(angle / (2 * np.pi / TURNS)).astype(np.int64) % TURNS
    places = (TESTS[..., 0] * wide + TESTS[..., 1])[turn]
    a, b = (smooth[image[:, None], centre + places[:, :, k]] for k in (0, 1))
    return image, y, x, turn, np.packbits(a - b > stand_out * patch.std(axis=1)[:, None], axis=1)


def shrunk(images: np.ndarray, h: int, w: int) -> np.ndarray:
    """Images at another size, between their pixels in proportion."""
    for axis, n in ((1, h), (2, w)):
        size = images.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.minimum(at.astype(np.int64), max(size - 2, 0))
        part = (at - low).astype(np.float32).reshape([n if a == axis else 1 for a in range(3)])
        images = np.take(images, low, axis) * (1 - part) + np.take(images, np.minimum(low + 1, size - 1), axis) * part
    return images


def describe(images: np.ndarray, copies: Copies) -> list[np.ndarray]:
    """Of each image of one size its corners, as rows of CORNER, over scales a factor of SCALE apart."""
    n, height, width = images.shape
    level, h, w, parts = images.astype(np.float32), height, width, []
    while min(h, w) >= SIDE_LEAST:
        image, y, x, turn, tests = describe_level(level, max(copies.least, h * w // copies.area), copies.stand_out)
        rows = np.zeros(len(image), CORNER)
        rows["x"], rows["y"] = (x + 0.5) * width / w - 0.5, (y + 0.5) * height / h - 0.5
        rows["level"], rows["turn"], rows["tests"] = min(len(parts), 255), turn, tests
        parts.append((image, rows))
        h, w = (round(x / SCALE ** len(parts)) for x in (height, width))
        level = shrunk(level, h, w) if min(h, w) >= SIDE_LEAST else level
    if not parts:
        return [np.zeros(0, CORNER)] * n
    image, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(image, kind="stable")
    return np.split(rows[order], np.searchsorted(image[order], np.arange(1, n)))


def described(images: DataFrame, copies: Copies = Copies(), id_col: str = "id") -> DataFrame:
    """(id, digest, corners) of images (id_col, width, height, pixels: one byte each, by rows), in one pass over the pixels.

    corners are packed rows of CORNER. digest is of the size and the bytes, null for a null image; what isn't an image has no corners.
    """
    bounded_batches(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            ids, widths, heights, pixels = (batch.column(k).to_pylist() for k in range(4))
            found: dict[int, bytes] = {}
            sizes: dict[tuple, list[int]] = {}
            for i, (w, h, p) in enumerate(zip(widths, heights, pixels, strict=True)):
                if p is not None and w and h and len(p) == w * h:
                    sizes.setdefault((h, w), []).append(i)
            for (h, w), own in sizes.items():
                step = max(1, (1 << 19) // (h * w))
                for a in range(0, len(own), step):
                    part = own[a : a + step]
                    stack = np.stack([np.frombuffer(pixels[i], np.uint8).reshape(h, w) for i in part])
                    found.update(zip(part, (x.tobytes() for x in describe(stack, copies)), strict=True))
            digests = [None if p is None else hashlib.sha256(b"%d,%d," % (w or 0, h or 0) + p).digest() for w, h, p in zip(widths, heights, pixels, strict=True)]
            columns = [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array([found.get(i, b"") for i in range(len(ids))], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "corners"])

    columns = images.select(F.col(id_col).cast("long").alias("id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels").where("id is not null")
    return columns.mapInArrow(run, "id long, digest binary, corners binary")


def entries(tests: np.ndarray, table: int) -> np.ndarray:
    """48 bits of each packed row of tests: a table's part, and 16 bits of the next part."""
    parts = np.ascontiguousarray(tests).view("<u4").astype(np.uint64)
    return parts[:, table] << np.uint64(16) | parts[:, (table + 1) % parts.shape[1]] & np.uint64(0xFFFF)


def _sender(copies: Copies, side: int, slots: int):
    """From (id, corners) to rows (slot, side, entries, ids): a batch's entries of a slot, each 48 bits and the place of its id. Of what more
    than `most` images of a batch share only so many and one more go on, which tells that it is common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << 16):
                ids, raw = (batch.column(k).slice(a, 1 << 16).to_pylist() for k in (0, 1))
                place = np.repeat(np.arange(len(ids), dtype=np.uint64), [len(x) // CORNER.itemsize for x in raw])
                tests = np.frombuffer(b"".join(raw), CORNER)["tests"]
                rows = []
                for table in range(copies.tables if len(tests) else 0):
                    key = entries(tests, table)
                    slot = (mix(key >> np.uint64(16)) % np.uint64(slots)).astype(np.int64)
                    order = np.lexsort((place, key, slot))
                    key, own, slot = key[order], place[order], slot[order]
                    if side == 0:
                        new = np.ones(len(key), bool)
                        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])  # an image counts once
                        key, own, slot = key[new], own[new], slot[new]
                        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                        nth = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
                        keep = nth <= copies.most
                        key, own, slot = key[keep], own[keep], slot[keep]
                    cuts = [0, *(np.flatnonzero(slot[1:] != slot[:-1]) + 1).tolist(), len(slot)]
                    for b, c in zip(cuts[:-1], cuts[1:], strict=True):
                        used, back = np.unique(own[b:c], return_inverse=True)
                        rows.append((table * slots + int(slot[b]), (key[b:c] << np.uint64(16) | back.astype(np.uint64)).tobytes(), np.array([ids[k] for k in used.tolist()], np.int64).tobytes()))
                if rows:
                    slot, packed, names = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array([side] * len(rows), pa.int32()), pa.array(packed, pa.binary()), pa.array(names, pa.binary())], names=["slot", "side", "entries", "ids"])

    return run


def _meeter(copies: Copies):
    """Of a partition's rows of _sender() the (query, id, votes) of queries and images that share parts, and of each query with common
    parts (query, null, those that are common with 16 bits more)."""

    def slot(index: list[tuple], asked: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
        def sides(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
            packed = [np.frombuffer(x, np.uint64) for x, _ in rows]
            names = [np.frombuffer(n, np.int64)[(x & np.uint64(0xFFFF)).astype(np.int64)] for x, (_, n) in zip(packed, rows, strict=True)]
            return np.concatenate([x >> np.uint64(16) for x in packed]), np.concatenate(names)

        query_key, query = sides(asked)
        if not index:
            return
        key, image = sides(index)
        order = np.argsort(key)
        key, image = key[order], image[order]
        short = key >> np.uint64(16)
        bounds = [(np.searchsorted(k, q, "left"), np.searchsorted(k, q, "right")) for k, q in ((short, query_key >> np.uint64(16)), (key, query_key))]
        common = bounds[0][1] - bounds[0][0] > copies.most
        low, high = (np.where(common, b, a) for a, b in zip(*bounds, strict=True))
        hot = high - low > copies.most
        names, place = np.unique(query[common], return_inverse=True)
        if len(names):
            yield names, pa.nulls(len(names), pa.int64()), np.bincount(place, hot[common], len(names)).astype(np.int64)
        n = np.where(hot, 0, high - low)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
        if len(row):
            pairs, votes = np.unique(np.stack([query[row], image[at]], axis=1), axis=0, return_counts=True)
            yield pairs[:, 0], pa.array(pairs[:, 1]), votes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for number, side, packed, names in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                held.setdefault(number, ([], []))[side].append((packed, names))
        for index, asked in held.values():
            if asked:
                for query, image, votes in slot(index, asked):
                    yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), image, pa.array(votes, pa.int64())], names=["query", "id", "votes"])

    return run


def met(asked: DataFrame, index: DataFrame, copies: Copies) -> DataFrame:
    """(query, id, votes) of described queries and images, and a row with a null id of each query that has common parts, see _meeter()."""
    corners = index.select(F.coalesce(F.sum(F.length("corners")), F.lit(0))).first()[0] // CORNER.itemsize
    parts = max(1, -(-corners * copies.tables // PART_ENTRIES), index.sparkSession.sparkContext.defaultParallelism)
    schema = "slot int, side int, entries binary, ids binary"
    rows = [df.select("id", "corners").mapInArrow(_sender(copies, side, parts), schema) for side, df in enumerate((index, asked))]
    return rows[0].unionByName(rows[1]).repartition(parts, "slot").mapInArrow(_meeter(copies), "query long, id long, votes long").groupBy("query", "id").agg(F.sum("votes").alias("votes"))


def places(corners: np.ndarray) -> np.ndarray:
    """A number for the square of four pixels that each corner lies in: one corner of the scene is found at several scales."""
    return (np.rint(corners["y"] / 4) * (1 << 20) + np.rint(corners["x"] / 4)).astype(np.int64)


def _distinct(alike: np.ndarray, places: np.ndarray) -> np.ndarray:
    """By rows of alike, how many different places its columns have."""
    order = np.argsort(places, kind="stable")
    own = places[order]
    return np.count_nonzero(np.logical_or.reduceat(alike[:, order], np.flatnonzero(np.append(True, own[1:] != own[:-1])), axis=1), axis=1)


def _support(scaled: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Of each match how many scale and turn as it does, roughly."""
    level = scaled - scaled.min(initial=0) + 1
    levels = int(level.max(initial=0)) + 2
    count = np.bincount(level.astype(np.int64) * TURNS + turned, minlength=levels * TURNS).reshape(levels, TURNS)
    near = sum(np.roll(count, k, axis=1) for k in range(-2, 3))
    near[1:-1] = near[1:-1] + near[:-2] + near[2:]
    return near[level, turned]


def places_of(corners: np.ndarray, owner: np.ndarray, images: int) -> np.ndarray:
    """How many places each of so many images has whose corners these are, by owner."""
    order = np.lexsort((at := places(corners), owner))
    at, owner = at[order], owner[order]
    return np.bincount(owner[np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))], minlength=images) if len(at) else np.zeros(images, np.int64)


def consensus(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, copies: Copies, need: int = 0) -> int:
    """The most places, different on both sides, whose matches i to j of corners a to b one similarity transform explains; fewer than need don't matter.

    Each match tells a rough transform by how its patches turn and scale. The matches that roughly share one's transform are fitted
    to it, closer in each round; every match is taken as such a beginning unless too few share its transform to be more than what is known.
    """
    need = max(need, copies.agree)
    centre = complex(a["x"].mean(), a["y"].mean())
    za, zb = (a["x"] + 1j * a["y"] - centre)[i], (b["x"] + 1j * b["y"])[j]
    own, other = places(a)[i], places(b)[j]
    scaled = b["level"][j].astype(np.int16) - a["level"][i]
    turned = (b["turn"][j].astype(np.int8) - a["turn"][i].astype(np.int8)) % TURNS
    shift = (zb - SCALE ** scaled.astype(np.float64) * np.exp(2j * np.pi / TURNS * turned.astype(np.float64)) * za).astype(np.complex64)
    most, tried, begin = 0, set(), np.flatnonzero(_support(scaled, turned) >= need)
    for at in range(0, len(begin), 512):
        part = begin[at : at + 512]
        off = sum(np.square(far := x[part, None] - x, out=far) for x in (shift.real.copy(), shift.imag.copy()))
        alike = off <= 400
        some = np.count_nonzero(alike, axis=1) >= max(need, most + 1)
        part, alike = part[some], alike[some]
        alike &= np.abs(scaled[part, None] - scaled) <= 1
        turns = np.abs(turned[part, None] - turned)
        alike &= (turns <= 2) | (turns >= TURNS - 2)
        for where in (own, other):
            alike = alike[_distinct(alike, where) >= max(need, most + 1)]
        support = np.minimum(_distinct(alike, own), _distinct(alike, other))
        for k in np.argsort(-support, kind="stable"):
            if support[k] <= max(most, need - 1):
                break
            row = alike[k].tobytes()
            if row in tried:  # the same matches lead to the same transform
                continue
            tried.add(row)
            chosen = np.flatnonzero(alike[k])
            for close in (12.0, 6.0, 2 * copies.miss, copies.miss, copies.miss):
                x, y = za[chosen], zb[chosen]
                mean = x.mean()
                spread = (np.abs(x - mean) ** 2).sum()
                if spread < 64:
                    chosen = chosen[:0]
                    break
                rate = ((x - mean).conj() * (y - y.mean())).sum() / spread
                near = np.abs(rate * (za - mean) + y.mean() - zb) <= close * max(1.0, abs(rate))
                chosen = np.flatnonzero(near & alike[k] if close > copies.miss else near)
                if len(chosen) < copies.agree or not 0.3 < abs(rate) < 3.3:
                    chosen = chosen[:0]
                    break
            most = max(most, min(len(np.unique(own[chosen])), len(np.unique(other[chosen]))))
    return int(most)


def matches(ta: np.ndarray, tb: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of all pairs of packed tests that differ in apart bits at most, compared in full."""
    a, b = (np.ascontiguousarray(t).view(np.uint64).T.copy() for t in (ta, tb))
    out = [(np.zeros(0, np.int64),) * 3]
    words, ones, more = np.empty(STEP, np.uint64), np.empty(STEP, np.uint8), np.empty(STEP, np.uint8)
    for p in range(0, a.shape[1], STEP[0]):
        for q in range(0, b.shape[1], STEP[1]):
            x, y = a[:, p : p + STEP[0]], b[:, q : q + STEP[1]]
            word, half, other = (own[: x.shape[1], : y.shape[1]] for own in (words, ones, more))
            np.bitwise_count(np.bitwise_xor(x[0][:, None], y[0], out=word), out=half)
            half += np.bitwise_count(np.bitwise_xor(x[1][:, None], y[1], out=word), out=other)
            i, j = np.divmod(np.flatnonzero(half <= apart), y.shape[1])  # half the bits can't differ more than all
            full = half[i, j].astype(np.int64) + np.bitwise_count(x[2][i] ^ y[2][j]) + np.bitwise_count(x[3][i] ^ y[3][j])
            good = full <= apart
            out.append((i[good] + p, j[good] + q, full[good]))
    return tuple(np.concatenate(own) for own in zip(*out, strict=True))


def beyond_chance(pairs: np.ndarray, area: np.ndarray, copies: Copies) -> np.ndarray:
    """Places that must agree for as many to be expected on less than copies.chance of the transforms that two of the pairs of places tell.

    If pairs of places lie by chance in an area of so many pixels, those that miss a transform by little are nearly a Poisson number; two agree anyway.
    """
    mean = np.maximum(pairs * np.pi * copies.miss**2 / np.maximum(area, 1.0), 1e-9)[:, None]
    most = int(max(pairs.max(initial=0), copies.agree))
    k = np.arange(min(most, 1 << 12) + 1)
    factorial = np.append(0.0, np.cumsum(np.log(np.maximum(k[1:], 1))))
    with np.errstate(divide="ignore"):
        tail = np.where(k + 1 > mean, k * np.log(mean) - mean - factorial - np.log(np.maximum(1 - mean / (k + 1), 0)), 0.0)  # an upper bound
        good = np.log(np.maximum(pairs * (pairs - 1) / 2, 1))[:, None] + tail <= np.log(copies.chance)
    return np.where(good.any(axis=1), good.argmax(axis=1), len(k)) + 2


def agreeing(a: np.ndarray, b: np.ndarray, owner: np.ndarray, images: int, copies: Copies) -> list[tuple[int, int]]:
    """(image, places that agree) of the copies of a query's corners a among the images whose corners are b, by owner."""
    i, j, _ = matches(a["tests"], b["tests"], copies.apart)
    order = np.lexsort((j, i, owner[j]))
    i, j = i[order], j[order]
    image = owner[j]
    names, place = np.unique(places(a), return_inverse=True)
    mine = np.bincount(np.unique(image * len(a) + place[i]) // max(len(a), 1), minlength=images)
    theirs = np.bincount(owner[np.unique(j)], minlength=images)
    all_ = places_of(b, owner, images)
    need = np.maximum(copies.agree, np.ceil(copies.share * np.minimum(len(names), all_))).astype(np.int64)
    some = np.flatnonzero(np.minimum(mine, theirs) >= need)
    if not len(some):
        return []
    good = np.isin(image, some)
    seen = np.stack([image[good], place[i[good]], places(b)[j[good]]], axis=1)
    pairs = np.bincount(np.unique(seen, axis=0)[:, 0], minlength=images)[some]
    span = np.empty(len(some))
    for n, t in enumerate(some.tolist()):
        own = b[slice(*np.searchsorted(owner, (t, t + 1)))]
        span[n] = float(np.ptp(own["x"])) * float(np.ptp(own["y"]))
    need[some] = np.maximum(need[some], beyond_chance(pairs, span, copies))
    out = []
    for t in np.flatnonzero(np.minimum(mine, theirs) >= need).tolist():  # fewer places can't agree
        own = slice(*np.searchsorted(image, (t, t + 1)))
        n = consensus(a, b, i[own], j[own], copies, int(need[t]))
        if n >= need[t]:
            out.append((t, n))
    return out


def _answer(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["query", "id", "agreeing"])


def _judge(copies: Copies):
    """For mapInArrow over (query, id, corners of the query, corners of the image): (query, id, agreeing) of copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            out = []
            for query, image, *corners in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                a, b = (np.frombuffer(x, CORNER) for x in corners)
                out += [(query, image, n) for _, n in agreeing(a, b, np.zeros(len(b), np.int64), 1, copies)]
            yield _answer(out)

    return run


def blocks(rows: DataFrame, prefix: str, most: int) -> DataFrame:
    """rows of described images packed to blocks of about most corners: ids, corners of each, and all corners."""
    names = [prefix + n for n in ("ids", "counts", "corners")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[int, bytes]] = []

        def packed() -> pa.RecordBatch:
            joined = [np.array([i for i, _ in own], np.int64).tobytes(), np.array([len(x) // CORNER.itemsize for _, x in own], np.int64).tobytes(), b"".join(x for _, x in own)]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in joined], names=names)

        held = 0
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                n = len(r[1]) // CORNER.itemsize
                if held and held + n > most:
                    yield packed()
                    own, held = [], 0
                if n:
                    own.append(r)
                    held += n
        if own:
            yield packed()

    return rows.select("id", "corners").mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def _transforms() -> tuple[np.ndarray, ...]:
    """By (levels + 255) * 2 * TURNS + turns + TURNS between two corners: the transform's rate, and the cell of levels and turns in each grid, mixed."""
    levels, turns = np.divmod(np.arange(511 * 2 * TURNS), 2 * TURNS)
    turns = (turns - TURNS) % TURNS
    rate = (SCALE ** np.clip(levels - 255.0, -64, 64) * np.exp(2j * np.pi / TURNS * turns)).astype(np.complex64)
    cells = [(levels + off * (CELL[1] // 2)) // CELL[1] * TURNS + (turns + off * (CELL[2] // 2)) % TURNS // CELL[2] for off in (0, 1)]
    return rate, *(mix(c.astype(np.uint64)) for c in cells)


def _half_cells(corners: np.ndarray) -> np.ndarray:
    return ((corners["x"] + 1j * corners["y"]) * (2 / CELL[0])).astype(np.complex64)


def _part_keys(corners: np.ndarray, table: int) -> np.ndarray:
    """A table's part of each corner and, after it, that of the table before."""
    parts = np.ascontiguousarray(corners["tests"]).view("<u4").astype(np.uint64)
    return parts[:, table] << np.uint64(32) | (parts[:, table - 1] if table else np.uint64(0))


def parts_of(b: np.ndarray, owner: np.ndarray, images: int, copies: Copies) -> tuple:
    """Tables of images' corners b: each table's sorted keys, and by those of all tables place in half cells, level and turn, and
    image; places of each image; and parts, places, levels and turns in the order of b, and where each image begins there."""
    far, code = _half_cells(b) + np.complex64(8192 + 8192j), b["level"].astype(np.int64) * (2 * TURNS) + b["turn"]
    keys = [_part_keys(b, table) for table in range(copies.tables)]
    order = [np.argsort(key, kind="stable") for key in keys]
    every = np.concatenate(order)
    plain = np.ascontiguousarray(b["tests"]).view("<u4")[:, : copies.tables].T.copy(), far, code, np.searchsorted(owner, np.arange(images + 1))
    return [key[own] for key, own in zip(keys, order, strict=True)], far[every], code[every], owner[every].astype(np.uint32), places_of(b, owner, images), plain


def _ranges(a: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first, rows) of each corner of a in each table, in two ranges: the corners with its part but not that of the table before, which are met there."""
    first, rows = np.zeros((2, len(a), 2 * len(keys)), np.int64)
    order = [np.argsort(_part_keys(a, table)) for table in range(len(keys))]  # near ones are looked up one after the other
    for table, key in enumerate(keys):
        own, past = _part_keys(a, table)[order[table]], table * len(key)
        part = own & np.uint64(0xFFFFFFFF << 32)
        low, high = np.searchsorted(key, part, "left"), np.searchsorted(key, part | np.uint64(0xFFFFFFFF), "right")
        left, right = (np.searchsorted(key, own, side) for side in ("left", "right")) if table else (low, low)
        first[order[table], 2 * table], first[order[table], 2 * table + 1] = low + past, right + past
        rows[order[table], 2 * table], rows[order[table], 2 * table + 1] = left - low, high - right
    return first, rows


def _kept_once(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _full(keys: np.ndarray, bits: int, room: int, need: np.ndarray) -> np.ndarray:
    """Images that have a cell with as many of the sorted keys as they need, each key once."""
    cell, k = keys >> keys.dtype.type(bits), int(need.min()) - 1
    begin = np.flatnonzero(cell[k:] == cell[: max(len(cell) - k, 0)])
    begin = begin[(begin == 0) | (cell[begin - 1] != cell[begin])]
    image = (cell[begin] >> keys.dtype.type(room)).astype(np.int64)
    last = begin + need[image] - 1
    return image[(last < len(cell)) & (cell[np.minimum(last, len(cell) - 1)] == cell[begin])]


def roughly_alike(a: np.ndarray, counts: np.ndarray, tables: tuple, copies: Copies) -> Iterator[tuple[int, np.ndarray]]:
    """(query, images) of queries, with so many of the corners a each, and of images by their parts_of(), where as many places of the query as
    copies of so many places must have share a part with corners of the image by one rough transform. Every part counts, whatever else shares it.
    If r places share one, r - d of them do without the d that share most; only images that have so many are looked up by all places.
    Cells are told apart by a hash, so an image may be one too many.
    """
    keys, far, code, owner, seen, plain = tables
    rate, *cells = _transforms()
    first, rows = _ranges(a, keys)
    ends = np.append(0, np.cumsum(counts))
    for query in range(len(counts)):
        own = slice(ends[query], ends[query + 1])
        names, place = np.unique(places(a[own]), return_inverse=True)
        if len(names) < copies.agree:
            continue
        need = np.maximum(copies.agree, np.ceil(copies.share * np.minimum(len(names), seen))).astype(np.int64)
        middle = _half_cells(a[own])
        middle -= middle.mean()
        turned = a[own]["level"].astype(np.int64) * (2 * TURNS) + a[own]["turn"] - (255 * 2 + 1) * TURNS
        bits = len(names).bit_length()
        room = 32 - bits - len(seen).bit_length()  # bits of a cell
        kind, room = (np.uint32, room) if room >= 10 else (np.uint64, 20)

        def grids(i: np.ndarray, far: np.ndarray, code: np.ndarray, image: np.ndarray, own=(middle, turned, place.astype(kind)), bits=bits, room=room, kind=kind) -> list[np.ndarray]:
            """By grid the sorted keys (image, cell, place), each once, of the query's corners i and those of images that have a part of theirs."""
            z, turn, which = (x[i] for x in own)
            turn = code - turn
            half = (far - rate[turn] * z).view(np.float32).astype(np.int32)
            which |= image.astype(kind, copy=False) << kind(room + bits)
            out = []
            for off in (0, 1):
                cell = ((half + off if off else half) >> 1).view(np.uint64)
                cell = cell * np.uint64(0x9E3779B97F4A7C15) + cells[off][turn]
                cell *= np.uint64(0xD6E8FEB86659FD93)
                key = (cell >> np.uint64(64 - room)).astype(kind, copy=False) << kind(bits)
                out.append(_kept_once(key | which))
            return out

        def joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
            return parts[0] if len(parts) == 1 else [_kept_once(np.concatenate(x)) for x in zip(*parts, strict=True)]

        fewer = int(need.min()) - 3
        share = np.bincount(place, rows[own].sum(axis=1))
        rest = np.flatnonzero(~np.isin(place, np.argsort(-share, kind="stable")[: max(fewer, 0)]))
        low, n = first[own][rest].ravel(), rows[own][rest].ravel()
        upto, corner = np.append(0, np.cumsum(n)), np.repeat(rest, first.shape[1])
        parts, p = [], 0
        while p < len(n):
            q = max(p + 1, int(np.searchsorted(upto, upto[p] + SHARED_STEP, "right")) - 1)
            j = np.arange(upto[q] - upto[p]) + np.repeat(low[p:q] - (upto[p:q] - upto[p]), n[p:q])
            parts.append(grids(np.repeat(corner[p:q], n[p:q]), far[j], code[j], owner[j]))
            p = q
        likely = np.unique(np.concatenate([_full(key, bits, room, need - max(fewer, 0)) for key in joined(parts)])) if parts else np.zeros(0, np.int64)
        hits, asked = [], np.ascontiguousarray(a[own]["tests"]).view("<u4")
        for at in range(0, len(likely), 256):
            some = likely[at : at + 256]
            image = np.repeat(some, plain[3][some + 1] - plain[3][some])
            j = np.concatenate([np.arange(plain[3][x], plain[3][x + 1]) for x in some.tolist()])
            same = np.zeros((len(asked), len(j)), bool)
            for table in range(copies.tables):
                same |= asked[:, table, None] == plain[0][table][j]
            i, k = np.divmod(np.flatnonzero(same), len(j))
            hits += [_full(key, bits, room, need) for key in grids(i, plain[1][j[k]], plain[2][j[k]], image[k])]
        if hits and len(hit := np.unique(np.concatenate(hits))):
            yield query, hit


def _judge_blocks(copies: Copies, every: bool):
    """For mapInArrow over pairs of a block of queries and one of images: (query, id, agreeing) of copies, among every pair or those that are roughly_alike()."""

    def block(batch: pa.RecordBatch, at: int, row: int) -> tuple[np.ndarray, ...]:
        ids, counts, corners = (np.frombuffer(batch.column(at + k)[row].as_buffer(), kind) for k, kind in enumerate((np.int64, np.int64, CORNER)))
        return ids, counts, corners, np.concatenate([[0], np.cumsum(counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        known, tables = None, ()
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                asked, own, a, begin = block(batch, 0, row)
                ids, counts, b, first = block(batch, 3, row)
                owner = np.repeat(np.arange(len(ids)), counts)
                if not every:
                    if known is None or not np.array_equal(known, ids):  # one block of images follows itself, each time with other queries
                        known, tables = ids.copy(), parts_of(b, owner, len(ids), copies)
                    for k, hit in roughly_alike(a, own, tables, copies):
                        for t in range(0, len(hit), 256):
                            some = hit[t : t + 256]
                            part = np.concatenate([b[first[x] : first[x + 1]] for x in some.tolist()])
                            found = agreeing(a[begin[k] : begin[k + 1]], part, np.repeat(np.arange(len(some)), counts[some]), len(some), copies)
                            out += [(int(asked[k]), int(ids[some[x]]), n) for x, n in found]
                    continue
                for k, query in enumerate(asked.tolist()):
                    out += [(query, int(ids[t]), n) for t, n in agreeing(a[begin[k] : begin[k + 1]], b, owner, len(ids), copies)]
            yield _answer(out)

    return run


def compared_in_full(asked: DataFrame, index: DataFrame, copies: Copies) -> DataFrame:
    """(query, id, agreeing) of described queries and images, every one with every one, in blocks."""
    return _in_blocks(asked, index, copies, True)


def compared_where_alike(asked: DataFrame, index: DataFrame, copies: Copies) -> DataFrame:
    """(query, id, agreeing) of described queries and images whose parts, common ones too, agree on a rough transform."""
    return _in_blocks(asked, index, copies, False)


def _in_blocks(asked: DataFrame, index: DataFrame, copies: Copies, every: bool) -> DataFrame:
    images = blocks(index, "b_", INDEX_BLOCK if every else PART_INDEX_BLOCK)
    if not every:
        images = images.repartition(8 * index.sparkSession.sparkContext.defaultParallelism)
    both = blocks(asked, "a_", QUERY_BLOCK).crossJoin(images) if every else images.crossJoin(blocks(asked, "a_", PART_QUERY_BLOCK)).select(*(f"{x}_{n}" for x in "ab" for n in ("ids", "counts", "corners")))
    return both.mapInArrow(_judge_blocks(copies, every), "query long, id long, agreeing long")


def classes(index: DataFrame) -> DataFrame:
    """(id, class_id) of described images: those equal in size and bytes share the smallest id; a null image is in a class of its own."""
    least = index.where("digest is not null").groupBy("digest").agg(F.min("id").alias("class_id"))
    return index.select("id", "digest").join(least, "digest", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def found_by_corners(asked: DataFrame, index: DataFrame, copies: Copies) -> DataFrame:
    """(query, id, agreeing) of described queries and images, whose ids are distinct, written to the shared folder."""
    shared = materialize(met(asked, index, copies), "media-met")
    pairs = shared.where(F.col("id").isNotNull() & (F.col("votes") >= copies.votes)).select("query", "id")
    corners = lambda df, name: df.select(F.col("id").alias(name), F.col("corners").alias(f"corners_{name}"))
    both = pairs.join(corners(asked, "query"), "query").join(corners(index, "id"), "id").select("query", "id", "corners_query", "corners_id")
    found = both.mapInArrow(_judge(copies), "query long, id long, agreeing long")
    common = shared.where("id is null").select(F.col("query").alias("id"), "votes")
    told = F.length("corners") / CORNER.itemsize * copies.tables - F.col("votes")
    common_ones = materialize(asked.join(common, "id").select("id", "corners", (told < copies.enough).alias("every")), "media-rest")
    for every, compared in ((True, compared_in_full), (False, compared_where_alike)):
        rest = common_ones.where(F.col("every") == every)
        if not rest.isEmpty():
            found = found.unionByName(compared(rest, index, copies))
    out = materialize(found.groupBy("query", "id").agg(F.max("agreeing").alias("agreeing")), "media-found")
    for x in (shared, common_ones):
        discard(x)
    return out


def find_copies(queries: DataFrame, images: DataFrame, copies: Copies = Copies(), query_id: str = "id", image_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """((query, id, agreeing) of each query image and each class of images that it is a copy of; (id, class_id) of every image).

    Both tables hold (id, width, height, pixels), grey images one byte a pixel by rows. A null image, one whose bytes don't fit its
    size, or one too small or too plain for corners is a copy of nothing. Rows with a null id are left out; rows repeated under an id
    are one image. Other columns are left alone; an empty table gives empty ones. Every image is indexed, equal images once. The work follows
    the parts that are shared, common ones too; only queries nearly all of whose parts are common are compared with every image.
    """
    indexed = materialize(described(images, copies, image_id), "media-index")
    members = materialize(classes(indexed), "media-classes")
    index = indexed.join(members.where("id = class_id").select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    asked = materialize(described(queries, copies, query_id).where("length(corners) > 0"), "media-queries")
    out = found_by_corners(asked, index, copies)
    for x in (indexed, asked):
        discard(x)
    return out, members


SIDE, SHAPES = 112, 21
#: What render() can do to an image, as a copier would.
EDITS = ("cropped", "noisy", "blurred", "turned 15", "turned 90", "scaled 0.8", "scaled 1.25", "halved", "cropped to 60 %")


def _between(images: np.ndarray, turn: float, size: int, rate: float) -> np.ndarray:
    """Images turned about their middle and scaled to a size, edges repeated."""
    y, x = np.meshgrid(*[(np.arange(size) - (size - 1) / 2) / rate] * 2, indexing="ij")
    side, angle = images.shape[1], np.deg2rad(turn)
    at = [np.clip(v + (side - 1) / 2, 0, side - 1.001) for v in (np.cos(angle) * y - np.sin(angle) * x, np.sin(angle) * y + np.cos(angle) * x)]
    (top, left), (down, right) = zip(*((v.astype(np.int64), v - v.astype(np.int64)) for v in at), strict=True)
    upper = images[:, top, left] * (1 - right) + images[:, top, left + 1] * right
    return upper * (1 - down) + (images[:, top + 1, left] * (1 - right) + images[:, top + 1, left + 1] * right) * down


def edit(images: np.ndarray, kind: str) -> np.ndarray:
    side = images.shape[1]
    grain = (mix(np.arange(side * side, dtype=np.uint64)) % np.uint64(7)).astype(np.float32).reshape(side, side) - 3
    if kind == "cropped":
        return (0.8 * images + 15 + grain)[:, 9 : side - 11, 6 : side - 8]
    if kind == "noisy":
        return images + 2 * grain
    if kind == "blurred":
        return box(images, 1)
    if kind == "turned 15":
        return _between(images, 15, side, 1)
    if kind == "turned 90":
        return np.rot90(images, 1, (1, 2))
    if kind == "halved":
        return images.reshape(len(images), side // 2, 2, side // 2, 2).mean(axis=(2, 4))
    if kind == "cropped to 60 %":
        own = round(side * 0.6**0.5)
        return images[:, (side - own) // 3 :, (side - own) // 2 :][:, :own, :own]
    rate = float(kind.removeprefix("scaled "))
    return _between(images, 0, round(side * rate), rate)


def drawn(vectors: np.ndarray) -> np.ndarray:
    """Rectangles on plain ground, whose places, sizes and greys follow each vector."""
    frac = lambda x: x - np.floor(x)
    k = np.arange(SHAPES)
    a, b, c = (vectors[:, d : 3 * SHAPES : 3] for d in range(3))
    left, top, wide, high = frac(7 * a + 0.618 * k) * SIDE, frac(7 * b + 0.414 * k) * SIDE, 10 + 26 * frac(5 * c), 10 + 26 * frac(11 * c)
    x0, x1, y0, y1 = (np.ceil(v).astype(np.int64).tolist() for v in (left, left + wide, top, top + high))
    grey = (255 * frac(13 * a + 17 * b)).tolist()
    out = np.full((len(vectors), SIDE, SIDE), 128.0, np.float32)
    for i, image in enumerate(out):
        for j in range(SHAPES):
            image[y0[i][j] : y1[i][j], x0[i][j] : x1[i][j]] = grey[i][j]
    return out


def render(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", edited: bool | str = False) -> DataFrame:
    """(id, width, height, pixels): a media column for tables that have none, rectangles whose places, sizes and greys follow a vector.

    edited gives an edited version instead, as a copier would make: the edit of that name, or if it is True the one that edit_of() tells of the
    id. A null or short vector gives a null image.
    """
    bounded_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            ids, own, kinds = (batch.column(k).to_pylist() for k in range(3))
            pixels: list[bytes | None] = [None] * len(own)
            sizes = [(SIDE, SIDE)] * len(own)
            groups: dict[str | None, list[int]] = {}
            for i, v in enumerate(own):
                if v is not None and len(v) >= 3 * SHAPES and all(x is not None for x in v):
                    groups.setdefault(kinds[i], []).append(i)
            for kind, good in groups.items():
                for a in range(0, len(good), 64):
                    part = good[a : a + 64]
                    image = drawn(np.array([own[i][: 3 * SHAPES] for i in part], np.float64))
                    image = image if kind is None else edit(image, kind)
                    for i, x in zip(part, np.clip(np.rint(image), 0, 255).astype(np.uint8), strict=True):
                        pixels[i], sizes[i] = x.tobytes(), x.shape
            columns = [pa.array(ids, pa.int64()), *(pa.array([s[k] for s in sizes], pa.int32()) for k in (1, 0)), pa.array(pixels, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "width", "height", "pixels"])

    kind = edit_of(F.col(id_col)) if edited is True else F.lit(edited if edited else None).cast("string")
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), kind.alias("kind")).mapInArrow(run, "id long, width int, height int, pixels binary")


def edit_of(id_column):
    """The edit that a query's id stands for: every twentieth id the next one."""
    return F.element_at(F.array(*map(F.lit, EDITS)), (F.pmod(F.floor(F.coalesce(id_column.cast("long"), F.lit(0)) / 20), F.lit(len(EDITS))) + 1).cast("int"))
