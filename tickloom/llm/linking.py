"""From banded keys to components: stars through each bucket's least member first, then what is left, in bounded blocks.

A bucket is never expanded into its pairs. A batch combines its own rows first: of the ids that share a key in it only the
least goes on to the shuffle, the others are tied to that one. Then each member is checked against the least one
that it met. A bucket whose members lie in one component is done. In the others only members of different components can
still be linked: the largest component's blocks meet those of the others, and never each other. A bucket with
many others is first cut by prefix filtering, which is exact: two sets that are linked share one of their rarest values.
So every pair of a bucket is checked, known to be connected, or known not to be linked; there is no cap on partners.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.hashing import like_pairs, mix
from tickloom.llm.shared import discard, hold, materialize, utf8
from tickloom.llm.unionfind import labels, stars

#: Members of a block; a group holds two blocks. Buckets with more than twice as many members beside their largest component are cut finer first.
BLOCK_ROWS = 512
#: Keys that a task sorts at once, in 16 bytes each.
PART_KEYS = 1 << 20

Sets = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]
Linked = Callable[[np.ndarray, np.ndarray], bool]

def combined(ids: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a batch's rows (id, its keys: those up to ends) what goes on to the shuffle, (key, id) with the batch's least id of each key, and
    (key, id, centre) of the keys that several ids of the batch share, where centre is the least of them: key, id, near key, near id, near centre."""
    row = np.repeat(np.arange(len(ids)), np.diff(ends))
    order = np.argsort(keys)
    key, own = keys[order], ids[row[order]]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    group = np.cumsum(first) - 1
    size = np.bincount(group) if len(key) else group
    tied = np.flatnonzero(size[group] > 1)  # few: only these are put in order of their ids
    own[tied] = own[tied[np.lexsort((own[tied], group[tied]))]]
    last = np.append(first[1:], True)[: len(key)]
    fresh = first.copy()
    fresh[1:] |= own[1:] != own[:-1]
    near = fresh & (own[last] != own[first])[group]
    return key[first], own[first], key[near], own[near], own[first][group][near]


def _packer(slots: int):
    """From (id, keys: binary) to rows of packed columns (slot, keys, ids, centres), a slot's keys of a batch in one row; centres is empty but
    for the rows that met in the batch, which lie in one row of any slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            key, own, *near = combined(batch.column(0).to_numpy(), bounds // 8, np.frombuffer(data.tobytes(), np.int64))
            if not len(key):
                continue
            slot = key.view(np.uint64) % np.uint64(slots)
            order = np.argsort(slot)
            slot, key, own = slot[order], key[order], own[order]
            cuts = [0, *(np.flatnonzero(slot[1:] != slot[:-1]) + 1).tolist(), len(slot)]
            rows = [(int(slot[a]), key[a:b].tobytes(), own[a:b].tobytes(), b"") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if len(near[0]):
                rows.append((int(near[0][0].view(np.uint64) % np.uint64(slots)), *(x.tobytes() for x in near)))
            slot, *packed = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], names=["slot", "keys", "ids", "centres"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's packed rows those (key, id) whose key has several ids, with the least of them and the number of rows, and those that met before."""
    names, kinds = ["key", "id", "centre", "n"], [pa.int64()] * 4
    parts = [[np.zeros(0, np.int64)] * 2]
    for batch in batches:
        for key, own, centre in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            columns = [np.frombuffer(x, np.int64) for x in (key, own, centre)]
            if centre:
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(columns[0]), pa.int64())], names=names)
            else:
                parts.append(columns[:2])
    key, own = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.argsort(key)
    key = key[order]
    alone = np.ones(len(key) + 1, bool)
    alone[1:-1] = key[1:] != key[:-1]
    tied = np.flatnonzero(~(alone[:-1] & alone[1:]))
    key, own = key[tied], own[order[tied]]
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    last = np.append(first[1:], True)[: len(key)]
    group = np.cumsum(first) - 1
    keep = (own[last] != own[first])[group]
    columns = [key, own, own[first][group], np.bincount(group)[group] if len(key) else group]
    for a in range(0, len(key), 1 << 16):
        part = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(x[part][keep[part]], kind) for x, kind in zip(columns, kinds, strict=True)], names=names)


def buckets(rows: DataFrame, most: int, label: str) -> DataFrame:
    """(key, id, centre, n) of the rows (id, keys: packed 64-bit integers) whose key has several ids; centre is the least id that the row's one met, n how many rows
    did in the shuffle, null where they met in a batch.

    The keys, of which there are `most` at most, are shuffled once, packed, to partitions of about PART_KEYS each; keys are hashes, so partitions
    are even but for hot keys, and a hot key has a row for each batch there, not for each id.
    """
    parts = max(1, -(-most // PART_KEYS))
    packed = rows.select("id", "keys").mapInArrow(_packer(8 * parts), "slot int, keys binary, ids binary, centres binary")
    return materialize(packed.repartition(parts, "slot").mapInArrow(_shared, "key long, id long, centre long, n long"), label)


def verifier(sets: Sets, linked: Linked):
    """For mapInArrow over (a, b, text_a, text_b): the rows (a, b) whose texts are linked; the sets of a batch are made at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ids = np.concatenate([a, b])
            _, first, back = np.unique(ids, return_index=True, return_inverse=True)
            texts = pa.chunked_array([batch.column(2), batch.column(3)]).take(pa.array(first)).combine_chunks()
            own = []
            for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
                own += sets(*utf8(part))
            n = len(a)
            keep = np.fromiter((linked(own[back[i]], own[back[n + i]]) for i in range(n)), bool, n)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, sets: Sets, linked: Linked) -> DataFrame:
    """The pairs (a, b) that are linked; texts: (id, text) of all the ids in them."""
    text = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")).hint("shuffle_hash")  # noqa: E731  one row for an id, and long rows needn't be sorted
    both = pairs.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(verifier(sets, linked), "a long, b long")


def unresolved(at: DataFrame, label: str, least: int) -> DataFrame:
    """(key, main, n0, n) of the keys of (key, id, component) that hold several components and at least so many members: the largest
    component, its members and all members. Buckets of the same members, as the bands of a group of copies are, are one."""
    parts = at.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.bit_xor(F.xxhash64("id")).alias("all"))
    left = parts.groupBy("key").agg(
        F.max_by("component", "n").alias("main"), F.max("n").alias("n0"), F.sum("n").alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1"),
        F.min("first").alias("first"), F.bit_xor("all").alias("all"),
    ).where(f"c0 < c1 and n >= {least}")
    left = left.groupBy("c0", "c1", "n", "first", "all").agg(F.min("key").alias("key"), F.min_by("main", "key").alias("main"), F.min_by("n0", "key").alias("n0"))
    return materialize(left.select("key", "main", "n0", "n"), label)


def dealt(at: DataFrame, left: DataFrame) -> DataFrame:
    """(key, lo, hi, id, component): the members of the unresolved keys in pairs of blocks, but for pairs within the largest component.

    With n1 members beside that component's n0 there are about n0 n1 / BLOCK_ROWS + n1 n / BLOCK_ROWS rows.
    """
    rows, size = at.join(left, "key"), F.lit(BLOCK_ROWS)
    n0, n1, largest = F.col("n0"), F.col("n") - F.col("n0"), F.col("component") == F.col("main")
    b0, b1 = F.ceil(n0 / size).cast("long"), F.ceil(n1 / size).cast("long")
    own = F.pmod(F.xxhash64("id"), F.when(largest, b0).otherwise(b1))
    zero = F.lit(0).cast("long")
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    with_others = F.transform(F.sequence(zero, b1 - 1), lambda j: pair(F.col("own"), F.col("b0") + j))
    with_main = F.transform(F.sequence(zero, b0 - 1), lambda i: pair(i, F.col("b0") + F.col("own")))
    among = F.transform(F.sequence(zero, b1 - 1), lambda j: pair(F.col("b0") + F.least("own", j), F.col("b0") + F.greatest("own", j)))
    groups = F.when(F.col("n") <= size, F.array(pair(zero, zero))).when(largest, with_others).otherwise(F.concat(with_main, among))
    return rows.withColumn("b0", b0).withColumn("own", own).select("key", F.inline(groups), "id", "component").select("key", "lo", "hi", "id", "component")


def finer(rows: DataFrame, texts: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """(key, id, component) of finer buckets, by prefix filtering, of the rows (key, id, component, n) of large ones.

    Of a set of n values the n - ceil(percent n) + 1 first ones, in any order that all sets of a bucket share, meet those of every
    set that is linked to it, so no link is lost. The order puts values last that many members of the bucket have, as counted on
    about BLOCK_ROWS of them; the choice of those changes how much work is left and never a result. A bucket lies in blocks, so
    it is spread over tasks, and its rows grow with the members and the sizes of their sets.
    """
    blocks = F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("long")
    none, zero = F.lit(None), F.lit(0).cast("long")
    full = rows.withColumn("blocks", blocks).join(texts, "id")

    def counted(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        own, keys, out = sets(*utf8(_one(table.column("text")))), table.column("key").to_pylist(), []
        for a, b in groups:
            values, times = np.unique(np.concatenate(own[a:b]), return_counts=True)
            common = times >= max(2, (b - a) // 16)
            out.append((keys[a], values[common].view(np.int64), times[common]))
        return pa.table({"key": pa.array([x[0] for x in out], pa.int64()), "values": pa.array([x[1] for x in out], pa.list_(pa.int64())), "times": pa.array([x[2] for x in out], pa.list_(pa.int64()))})

    some = full.where(F.pmod(F.xxhash64("id", F.lit(7)), "blocks") == 0).select("key", zero.alias("lo"), zero.alias("hi"), "text")
    common = by_block(some, counted, "key long, values array<long>, times array<long>")
    spots = rows.select("key", "n").distinct().withColumn("lo", F.explode(F.sequence(zero, blocks - 1)))
    heads = spots.join(common, "key").select("key", "lo", zero.alias("hi"), none.cast("long").alias("id"), none.cast("long").alias("component"), none.cast("string").alias("text"), "values", "times")
    members = full.select("key", F.pmod(F.xxhash64("id"), "blocks").alias("lo"), zero.alias("hi"), "id", "component", "text", none.cast("array<long>").alias("values"), none.cast("array<long>").alias("times"))

    def cut(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        own, keys = sets(*utf8(_one(table.column("text").fill_null("")))), table.column("key").to_numpy()
        ids, parts = table.column("id").to_pylist(), table.column("component").to_pylist()
        out: list[list] = [[np.zeros(0, np.int64)], [], [], []]
        for a, b in groups:
            values, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for i in range(a, b):
                if ids[i] is None:
                    values, times = (np.array(table.column(c)[i].as_py(), np.int64) for c in ("values", "times"))
                    values = values.view(np.uint64)
            for i in range(a, b):
                x = own[i]
                if ids[i] is None or not len(x):
                    continue
                rank = np.zeros(len(x), np.int64)
                if len(values):
                    at = np.searchsorted(values, x) % len(values)
                    rank = np.where(values[at] == x, times[at], 0)
                first = np.lexsort((x, rank))[: len(x) - -(-percent * len(x) // 100) + 1]
                out[0].append(mix(x[first] ^ mix(keys[i : i + 1].astype(np.int64).view(np.uint64))).view(np.int64))
                out[1].append(ids[i])
                out[2].append(parts[i])
                out[3].append(len(first))
        each = [np.repeat(np.array(c, np.int64), np.array(out[3], np.int64)) for c in out[1:3]]
        return pa.table({"key": np.concatenate(out[0]), "id": each[0], "component": each[1]})

    return by_block(heads.unionByName(members), cut, "key long, id long, component long")


def _one(column: pa.ChunkedArray) -> pa.Array:
    """A table's column as one array."""
    whole = column.combine_chunks()
    return whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole


def by_block(df: DataFrame, work: Callable[[pa.Table, list[tuple[int, int]]], pa.Table], schema: str) -> DataFrame:
    """work(rows of whole pairs of blocks, where each begins and ends) over df's rows, dealt and sorted by (key, lo, hi).

    A task streams its groups; it holds a batch and the group that the batch's end cuts, which is two blocks at most.
    """
    keys = ["key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        left = None
        for batch in _with_end(batches):
            parts = [t for t in (left, None if batch is None else pa.Table.from_batches([batch])) if t is not None]
            if not parts:
                continue
            table = pa.concat_tables(parts).combine_chunks()
            columns = [table.column(k).to_numpy() for k in keys]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            cuts = [0, *change.tolist(), *([len(table)] if batch is None else [])]
            left = table.slice(cuts[-1])
            if len(cuts) > 1:
                yield from work(table.slice(0, cuts[-1]), list(zip(cuts[:-1], cuts[1:], strict=True))).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _with_end(batches: Iterator) -> Iterator:
    """The batches with rows, and then None."""
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def pruner(sketches_close: Callable[[np.ndarray], np.ndarray]):
    """For by_block(): the rows that have some partner of another component at a close enough sketch."""

    def work(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        size = len(table.column("sketch")[0].as_py())
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, size)
        parts = table.column("component").to_numpy()
        keep = np.zeros(len(table), bool)
        for a, b in groups:
            close = sketches_close(sketches[a:b])
            close &= parts[a:b, None] != parts[None, a:b]
            keep[a:b] = close.any(axis=1)
        return table.select(["key", "lo", "hi", "id", "component"]).filter(pa.array(keep))

    return work


def block_linker(sets: Sets, linked: Linked, percent: int, few: int = 8):
    """For by_block(): links that join two components of a group, each of which is a set of one or more members. A few members are compared one by one."""

    def work(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        ids, parts = table.column("id").to_pylist(), table.column("component").to_pylist()
        own = sets(*utf8(_one(table.column("text"))))
        out: list[tuple[int, int]] = []
        for a, b in groups:
            root = {c: c for c in parts[a:b]}

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            if b - a <= few:
                found = ((i, j) for i in range(b - a) for j in range(i + 1, b - a) if find(parts[a + i]) != find(parts[a + j]) and linked(own[a + i], own[a + j]))
            else:
                like = np.triu(like_pairs(own[a:b], percent), 1)
                numbers = np.array(parts[a:b])
                like &= numbers[:, None] != numbers[None]
                found = zip(*(x.tolist() for x in np.nonzero(like)), strict=True)
            for i, j in found:
                p, q = find(parts[a + i]), find(parts[a + j])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((ids[a + i], ids[a + j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return work


def link(members: DataFrame, texts_of: Callable[[DataFrame], DataFrame], sets: Sets, linked: Linked, percent: int, label: str, sketches: DataFrame | None = None, close_pairs=None, close_block=None) -> DataFrame:
    """(id, component) of the linked ids.

    members: what buckets() returned, which is deleted. texts_of: from (id) to (id, text). sketches: (id, sketch), with close_pairs, a
    condition on columns sketch_a and sketch_b, and close_block, from a group's sketches to its matrix of close pairs;
    both let a pair pass unless it is surely too far apart, before any text moves. Texts move again only where a first pair didn't bring them.
    """
    pairs = members.where("id > centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()

    def close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        both = pairs.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b").join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a")
        return close_pairs(both).select("a", "b")

    whole = sketches is None  # then each member was in a pair, so its text is there
    if not whole:
        pairs = close(pairs, sketches)
    pairs = materialize(pairs, f"{label}-pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = materialize(texts_of(wanted), f"{label}-texts")
    first = stars(confirm(pairs, texts, sets, linked), f"{label}-first")
    # Two rows that met across batches, neither of which met others in its own, have been compared with each other.
    near = members.where("n is null").select(F.col("key").alias("near_key")).distinct()
    open_ = members.where("n = 2").join(near.hint("shuffle_hash"), F.col("key") == F.col("near_key"), "left_semi").unionByName(members.where("n is null or n > 2"))
    at = open_.select("key", "id").join(labels(first).hint("shuffle_hash"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")).distinct()
    at = materialize(at, f"{label}-at")
    left = unresolved(at, f"{label}-left", 3)  # the members of smaller buckets have been compared
    used = [members, pairs, texts, at, left]
    large = F.col("n") - F.col("n0") > 2 * BLOCK_ROWS
    ordinary, hot = (left.select(F.count(F.when(c, 1))).first()[0] for c in (~large, large))
    rest = dealt(at, left.where(~large))
    if hot:
        rows = at.join(left.where(large).select("key", "n"), "key")
        own = texts if whole else materialize(texts_of(rows.select("id").distinct()), f"{label}-hot-texts")
        cut = materialize(finer(rows, own, sets, percent).distinct(), f"{label}-finer")
        still = unresolved(cut, f"{label}-still", 2)
        rest = rest.unionByName(dealt(cut, still))
        used += [cut, still] if whole else [own, cut, still]
    if ordinary or hot:
        if not whole:
            rest = materialize(by_block(rest.join(sketches, "id"), pruner(close_block), "key long, lo long, hi long, id long, component long"), f"{label}-close")
            used.append(rest)
            missing = materialize(rest.select("id").distinct().join(texts.select("id").hint("shuffle_hash"), "id", "left_anti"), f"{label}-missing")
            used.append(missing)
            if not missing.isEmpty():
                more_texts = materialize(texts_of(missing), f"{label}-rest")
                used.append(more_texts)
                texts = texts.union(more_texts)
        more = by_block(rest.join(texts.hint("shuffle_hash"), "id"), block_linker(sets, linked, percent), "a long, b long")
        found = stars(first.select(F.col("u").alias("a"), F.col("v").alias("b")).union(more), f"{label}-second")
        used.append(first)
    else:
        found = first
    for x in used:
        discard(x)
    return labels(found)
