"""Exact, near and line deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import exactdedup, hashing, linededup, linking, oddsketch
from tickloom.llm.linking import BLOCK_ROWS, _packer, _shared, combined, dealt, finer, unresolved
from tickloom.llm.unionfind import components


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def near_truth(rows, percent=75):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    flat = [(i, s) for i, own in sets.items() for s in own]
    links = [(a, b) for k, (a, x) in enumerate(flat) for b, y in flat[:k] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return closure(sets, links)


@pytest.fixture(scope="module")
def copies(base):
    """Base texts with exact copies, near copies at all distances, chains and a large group of near copies."""
    pick = random.Random(6)
    rows = [(1000 + i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:12]):
        words = t.split(" ")
        for k in range(6):
            own = list(words)
            for _ in range(pick.randrange(0, 6)):
                own[pick.randrange(len(own))] = f"edit{pick.randrange(99)}"
            rows.append((pick.randrange(1, 999) * 100 + i * 7 + k, " ".join(own)))
        rows.append((5000 + i, t.upper()))
    chain = base[0].split(" ")
    for k in range(20):
        chain = [*chain[3:], f"w{3 * k}", f"w{3 * k + 1}", f"w{3 * k + 2}"]
        rows.append((9000 - k, " ".join(chain)))
    return list({i: (i, t) for i, t in rows}.values())


def test_hashes_follow_words():
    pick = random.Random(3)
    texts = ["".join(pick.choice("abAB \t\n\x0bé") for _ in range(pick.randrange(0, 40))) for _ in range(300)] + ["", " ", "x" * (hashing.BLOCK + 50) + " y", ("ab " * hashing.BLOCK)]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    words, at = hashing.hash_words(np.frombuffer(b"".join(raw), np.uint8), bounds)
    seen, back = {}, {}
    for k, t in enumerate(texts):
        own = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        assert len(own) == at[k + 1] - at[k]
        for w, h in zip(own, words[at[k] : at[k + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h and back.setdefault(h, w) == w
    sets = hashing.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), bounds)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]


def test_components(spark):
    pick = random.Random(2)
    links = [(pick.randrange(200), pick.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 380)] + [(500, k) for k in range(501, 560)]
    df = spark.createDataFrame([*links, (None, 3), (3, None)], "x long, y long")
    got = {r["id"]: r["component"] for r in components(df).collect()}
    want = closure({n for e in links for n in e}, links)
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: c for n, c in want.items() if n in linked}
    assert components(df.where("false")).count() == 0


def test_near(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in oddsketch.near_duplicates(df).collect()}
    want = near_truth(copies)
    assert got == {i: (len(shingles(t)), want[i], want[i] == i) for i, t in copies}
    assert len(set(want.values())) < len(copies) - 40


def test_near_in_blocks(spark, base, monkeypatch):
    """Buckets whose members are near each other but not to the least one are resolved in blocks."""
    pick = random.Random(12)
    words = base[1].split(" ")[:60]
    rows = []
    for i in range(120):
        own = list(words)
        for _ in range(pick.choice([1, 2, 3, 8])):
            own[pick.randrange(len(own))] = f"e{pick.randrange(999)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr("tickloom.llm.linking.BLOCK_ROWS", 16)
    near = oddsketch.Near(bands=60, rows=2)  # so many buckets that every linked pair meets
    got = {r["doc_id"]: r["component_id"] for r in oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near).collect()}
    assert got == near_truth(rows) and BLOCK_ROWS > 16


def test_near_odd(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = oddsketch.near_duplicates(odd).collect()
    want = near_truth(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
        else:
            assert r["kept"] and r["component_id"] is None
    left = oddsketch.keep_one(odd)
    assert left.columns == odd.columns and sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == sorted(i for i, _ in rows if i is not None and want[i] == i)
    assert oddsketch.near_duplicates(empty).collect() == [] and oddsketch.keep_one(empty).count() == 0


def test_like_pairs():
    pick = np.random.default_rng(1)
    sets = [np.unique(pick.integers(0, 60, pick.integers(0, 50)).astype(np.uint64)) for _ in range(40)] + [np.zeros(0, np.uint64)] * 2
    for cells in (1, 100, 1 << 22):
        got = hashing.like_pairs(sets, 50, cells)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                x, y = set(a.tolist()), set(b.tolist())
                assert got[i, j] == bool(x and y and 100 * len(x & y) >= 50 * len(x | y))


def test_sketches_tell_similarity():
    pick = np.random.default_rng(4)
    near = oddsketch.Near()
    for j in (0.2, 0.5, 0.75, 0.9):
        n = 400
        both = int(2 * n * j / (1 + j))
        pool = pick.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n - both :])
        sketch = oddsketch.odd_sketches(hashing.minhashes([a, b], near.samples), near.bits)
        ones = int(oddsketch.ones_apart(sketch)[0, 1])
        assert (ones <= near.most_ones()) == (j >= 0.75) or j == 0.5
    assert int(oddsketch.ones_apart(sketch)[0, 0]) == 0


def test_exact(odd, empty, spark):
    for salts in (1, 16):
        rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
        groups = {}
        for i, t in rows:
            groups.setdefault(t, []).append(i)
        got = exactdedup.exact_groups(odd.repartition(6), salts=salts).collect()
        want = []
        for i, t in rows:
            ids = [x for x in groups[t] if x is not None]
            keep = max(ids) if ids else None
            want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert exactdedup.exact_groups(empty).collect() == []
    left = exactdedup.keep_largest(odd)
    assert left.columns == odd.columns and left.where("doc_id = 13").count() == 0 and left.where("doc_id = 14").count() == 2


def test_exact_is_native(odd):
    plan = exactdedup.exact_groups(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def line_truth(rows, lines):
    """Which lines stay, by brute force over all pairs of different lines."""

    def grams(t):
        return {t[i : i + lines.size] for i in range(len(t) - lines.size + 1)} if len(t) >= lines.size else {t}

    places = [((i, k), line) for i, t in rows if i is not None and t is not None for k, line in enumerate(t.split("\n")) if line.strip(" \t\v\f\r")]
    texts = sorted({line for _, line in places})
    number = {t: k for k, t in enumerate(texts)}
    own = [grams(t) for t in texts]
    close = lambda x, y: 100 * min(len(x), len(y)) >= lines.percent * max(len(x), len(y)) and 100 * len(x & y) >= lines.percent * len(x | y)
    links = [(a, b) for a in range(len(texts)) for b in range(a) if close(own[a], own[b])]
    part = closure(range(len(texts)), links)
    first = {}
    for at, line in sorted(places):
        first.setdefault(part[number[line]], at)
    keep = set(first.values())
    out = {}
    for i, t in rows:
        if t is None or i is None:
            out.setdefault(i, []).append(t)
        else:
            out.setdefault(i, []).append("\n".join(line for k, line in enumerate(t.split("\n")) if not line.strip(" \t\v\f\r") or (i, k) in keep))
    return out


def test_lines(spark, base):
    pick = random.Random(7)
    pool = [line for t in base for line in t.split("\n") if len(line) > 30]
    rows = []
    for i in range(40):
        own = []
        for _ in range(pick.randrange(1, 9)):
            line = pick.choice(pool)
            if pick.random() < 0.4:
                at = pick.randrange(len(line))
                line = line[:at] + pick.choice("xyz") + line[at + 1 :]
            own.append(line)
        rows.append((i, "\n".join([*own, "", "short", "All rights reserved."])))
    lines = linededup.Lines(bands=60, rows=2)  # so many that every linked pair meets
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [r["text"]] for r in linededup.dedup_lines(df, lines).collect()}
    assert got == line_truth(rows, lines)


def test_lines_with_few_edits(spark):
    """With the parameters as they are, lines that differ in one or two characters are one from 79 and 153 characters on."""
    pick = random.Random(9)
    rows = []
    for i in range(200):
        edits = 1 + i % 2
        line = [pick.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range((79, 153)[edits - 1] + pick.randrange(10))]
        rows.append((i, "x" + "".join(line[1:])))
        for k in range(edits):
            line[(k + 1) * len(line) // (edits + 1)] = "0123456789"[i % 10]
        rows.append((1000 + i, "x" + "".join(line[1:])))
    got = {r["doc_id"]: r["lines_dropped"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i >= 1000) for i, _ in rows}


def test_lines_odd(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = {}
    result = linededup.dedup_lines(odd)
    assert result.columns == [*odd.columns, "lines_dropped"]
    for r in result.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
        assert (r["n_tokens"], r["keep_id"]) == ("x", "y")
    want = line_truth(rows, linededup.Lines())
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert linededup.dedup_lines(empty).count() == 0


def test_lines_recall_at_the_threshold(spark):
    """With the parameters as they are, at least 0.99 of the pairs of 85 % and more, as found by brute force, are linked."""
    pick = random.Random(17)
    rows, linked, close = [], set(), 0

    def grams(t):
        return {t[i : i + 6] for i in range(len(t) - 5)}

    for i in range(1500):
        line = "".join(pick.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(pick.randrange(80, 260)))
        own = list("x" + line)
        for _ in range(pick.randrange(1, 5)):
            own[pick.randrange(1, len(own))] = pick.choice("0123456789")
        a, b = "x" + line, "".join(own)
        rows += [(i, a), (10_000 + i, b)]
        share = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        if share >= 0.85:
            linked.add(10_000 + i)
            close += share < 0.88
    got = {r["doc_id"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("lines_dropped > 0").collect()}
    assert close > 100 and got <= linked and len(got) >= 0.99 * len(linked)


def test_long_lines_by_windows(monkeypatch):
    """A text that is hashed in pieces, and a line that is hashed in windows, get what they get at once."""
    pick = random.Random(23)
    long = "".join(pick.choice("abcde é日🙂") for _ in range(9000))
    texts = ["first line here\n" + long + "\n\nlast line\n" + long[:4000], "short", long + "z", "\n".join(long[k : k + 70] for k in range(0, 9000, 70)), " " * 5000]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    raw = [x.encode() for t in texts for x in t.split("\n")]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])

    def run():
        out = pa.Table.from_batches(linededup._Signer(linededup.Lines()).run(iter([batch]))).to_pylist()
        return out, [x.tolist() for x in linededup.line_sets(linededup.Lines())(data, bounds)], linededup._hashes([x.decode() for x in raw]).tolist()

    whole = run()
    monkeypatch.setattr(linededup, "BLOCK_CHARS", 1000)
    assert run() == whole
    assert [(r["doc_id"], r["line"]) for r in whole[0]] == [(i, k) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if x.strip()]


def test_keys_meet_in_batches_and_partitions():
    """What several ids share is found whether they meet in a batch or later, and each key goes on once a batch."""
    pick = np.random.default_rng(3)
    rows = [(int(i), pick.integers(0, 300, 4)) for i in pick.integers(0, 90, 120)]
    shared = {}
    for i, keys in rows:
        for k in keys.tolist():
            shared.setdefault(k, set()).add(i)
    sent = []
    for a in range(0, len(rows), 30):
        part = rows[a : a + 30]
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in part]), pa.array([k.tobytes() for _, k in part], pa.binary())], names=["id", "keys"])
        sent += list(_packer(5)(iter([batch])))
        key, own, *_ = combined(np.array([i for i, _ in part]), np.arange(0, 121, 4), np.concatenate([k for _, k in part]))
        assert len(set(key.tolist())) == len(key) and all(i == min(j for j, ks in part if k in ks.tolist()) for k, i in zip(key.tolist(), own.tolist(), strict=True))
    got, links = {}, []
    for r in pa.Table.from_batches(_shared(iter(sent))).to_pylist():
        got.setdefault(r["key"], set()).add(r["id"])
        links.append((r["centre"], r["id"]))
        assert r["id"] in shared[r["key"]] and r["centre"] in shared[r["key"]]
    assert got == {k: ids for k, ids in shared.items() if len(ids) > 1}


def test_large_buckets_of_unlike_members(spark):
    """What is dealt of a bucket whose members are unlike each other grows with the members, and no link of it is lost."""
    pick, near = random.Random(31), oddsketch.Near()
    common = [f"c{k}" for k in range(25)]
    sets = lambda data, bounds: hashing.shingle_sets(data, bounds, near.words)
    size = {}
    for n in (6000, 12_000):
        rows, links = [], []
        for i in range(n):
            words = common + [f"w{pick.randrange(10**9)}" for _ in range(35)]
            rows.append((i, " ".join(words)))
            if i % 300 == 0:
                words[30 + i % 20] = "edited"
                rows.append((n + i, " ".join(words)))
                links.append((i, n + i))
        df = spark.createDataFrame(rows, "id long, text string").repartition(8)
        members = df.selectExpr("cast(1 as bigint) as key", "id", "id as component")
        left = unresolved(members, "test-left", 3)
        assert [tuple(r) for r in left.collect()] == [(1, r[1], 1, len(rows)) for r in left.collect()]
        cut = finer(members.join(left.select("key", "n"), "key"), df, sets, near.percent)
        still = unresolved(cut, "test-still", 2)
        got = dealt(cut, still).collect()
        groups = {}
        for r in got:
            groups.setdefault((r["key"], r["lo"], r["hi"]), set()).add(r["id"])
        assert all(any({a, b} <= g for g in groups.values()) for a, b in links)
        size[n] = cut.count(), len(got)
    assert size[12_000][0] <= 2.2 * size[6000][0] and size[12_000][1] <= 2.5 * size[6000][1] <= 6000


def test_line_sketches_lose_no_link():
    """The filter before texts move passes every linked pair, and few of those that are far apart."""
    pick, lines = random.Random(41), linededup.Lines()
    texts, far = [], []
    for i in range(400):
        a = [pick.choice("abcdefghij ") for _ in range(pick.randrange(6, 300))]
        b = list(a)
        for _ in range(pick.choice((0, 1, 2, 3, max(4, len(a) // 10)))):
            b[pick.randrange(len(b))] = pick.choice("0123456789")
        texts += ["".join(a), "".join(b)]
    raw = [t.encode() for t in texts]
    sets = linededup.line_sets(lines)(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    got = pa.Table.from_batches(linededup.line_sketches(lines)(iter([batch]))).to_pylist()
    sketches = np.stack([np.frombuffer(r["sketch"], np.uint64) for r in got])
    passed = linededup.may_link(sketches[::2], sketches[1::2], lines.percent)
    linked = np.array([lines.linked(a, b) for a, b in zip(sets[::2], sets[1::2], strict=True)])
    far = np.array([len(np.intersect1d(a, b)) < 0.7 * len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2], strict=True)])
    assert linked.sum() > 50 and (passed | ~linked).all()
    assert far.sum() > 50 and passed[far].mean() < 0.05


def test_lone_lines_are_written_once(spark, monkeypatch):
    """Lines that came once and share no key with another are written as they are signed, and dealt and written no more."""
    pick = random.Random(43)
    rows = [(i, "\n".join("".join(pick.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(100)) for _ in range(10)) + ("\nthe same line in two texts" if i < 2 else "")) for i in range(60)]
    written, plain = {}, linededup.materialize

    def counted(df, label, *rest):
        out = plain(df, label, *rest)
        written[label] = out.count()
        return out

    monkeypatch.setattr(linededup, "materialize", counted)
    got = {r["doc_id"]: r["lines_dropped"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i == 1) for i in range(60)}
    assert written.pop("lines-signed") == 602
    assert sum(written.values()) < 20


def test_lines_of_repeated_rows_without_text(spark):
    """A row without a text beside one of the same doc_id that loses a line stays as it is."""
    rows = [(1, "a line that is here twice"), (2, "a line that is here twice\nand one that is not"), (2, None), (2, "")]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"], r["text"] or "", r["text"] is None, r["lines_dropped"]) for r in out)
    assert [x[:3] for x in got] == [(1, rows[0][1], False), (2, "", False), (2, "", True), (2, "and one that is not", False)]
    assert [x[3] for x in got if x[2]] == [0]


def test_signatures_lose_no_link():
    """The filter before any text moves passes every linked pair, and few of those that are far apart."""
    pick, lines = random.Random(47), linededup.Lines()
    texts = []
    for _ in range(400):
        a = [pick.choice("abcdefghij ") for _ in range(pick.randrange(6, 300))]
        b = list(a)
        for _ in range(pick.choice((0, 1, 2, 3, max(4, len(a) // 10)))):
            b[pick.randrange(len(b))] = pick.choice("0123456789")
        texts += ["".join(a), "".join(b)]
    raw = [t.encode() for t in texts]
    sets = linededup.line_sets(lines)(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    rows = [pa.Table.from_batches(linededup._Signer(lines).run(iter([pa.RecordBatch.from_pydict({"doc_id": [0], "text": [t]})]))).to_pylist()[0] for t in texts]
    words = np.array([(r["s0"], r["s1"]) for r in rows], np.int64).view(np.uint64)
    passed = linededup.unlike(words[::2], words[1::2]) <= lines.most_unlike()
    linked = np.array([lines.linked(a, b) for a, b in zip(sets[::2], sets[1::2], strict=True)])
    far = linededup.unlike(words[:-2:2], words[2::2]) <= lines.most_unlike()
    assert linked.sum() > 50 and (passed | ~linked).all()
    assert far.mean() < 0.02


def test_lines_that_meet_by_chance_move_no_text(spark, monkeypatch):
    """Unlike lines that share a band's key, as in a large table most do, are told apart before their texts are fetched."""
    pick = random.Random(53)
    letters = lambda n: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    common = letters(38)
    rows = [(i, "\n".join(common + letters(82) for _ in range(10))) for i in range(200)]
    rows.append((200, rows[0][1].split("\n")[0][:-1] + "!"))
    written, plain = {}, linking.materialize

    def counted(df, label, *rest):
        out = plain(df, label, *rest)
        written[label] = out.count()
        return out

    monkeypatch.setattr(linking, "materialize", counted)
    got = {r["doc_id"]: r["lines_dropped"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i == 200) for i in range(201)}
    assert written["lines-members"] > 100 and written["lines-texts"] < 60
