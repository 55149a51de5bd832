"""Language identification, licence scans and image copies."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import langid, licences, media
from tickloom.llm.licences import Automaton, Scanner

SYLLABLES = {"en": "th er on an re he in ed nd ha", "fr": "eau eux ieu oi que ment tion è é", "de": "sch ung keit ein ich ber zu ß"}


@pytest.fixture(scope="module")
def spoken(spark):
    pick = random.Random(5)
    rows = []
    for i in range(600):
        lang = pick.choice(list(SYLLABLES))
        own = SYLLABLES[lang].split()
        text = " ".join("".join(pick.choice(own) for _ in range(pick.randrange(1, 4))) for _ in range(pick.randrange(5, 60)))
        said = lang if pick.random() < 0.9 else pick.choice(list(SYLLABLES))
        rows.append((i, text, lang, said, f"host{pick.randrange(5)}.{lang if pick.random() < 0.8 else 'com'}"))
    return spark.createDataFrame(rows, "doc_id long, text string, truth string, lang string, host string")


def test_language_accuracy(spoken):
    train, held = spoken.where("doc_id % 2 = 0"), spoken.where("doc_id % 2 = 1")
    model = langid.fit(train, label_col="lang")
    assert model.languages == ("de", "en", "fr")
    got = langid.identify(held, model, declared=F.col("lang"), host=F.col("host"), suffix=F.substring_index("host", ".", -1)).join(held.select("doc_id", "truth"), "doc_id").collect()
    assert len(got) == 300 and sum(r["language"] == r["truth"] for r in got) >= 295 and all(r["accepted"] and 0 <= r["posterior"] <= 1 for r in got)
    assert sum(r["text_language"] == r["truth"] for r in got) >= 290


def test_evidence_decides_where_text_is_thin(spark, spoken):
    model = langid.fit(spoken)
    rows = [(i, "xyz", "fr", "h") for i in range(40)] + [(99, "xyz", None, "h"), (100, "xyz", None, None), (101, "xyz", "fr-CA", None), (102, "xyz", "klingon", None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, said string, host string"), model, declared=F.col("said"), host=F.col("host")).collect()}
    assert got[99]["posterior"] > got[100]["posterior"] or got[99]["language"] == "fr"
    assert got[101]["declared"] == "fr" and got[102]["declared"] is None


def test_labels_are_plain(spark):
    """Labels and declarations count without region and case; rare languages are modelled, and those with too few rows aren't."""
    rows = [(i, "the other hand and then there " * 3, "EN") for i in range(400)] + [(1000 + i, "eau que tion ment ieu " * 3, "fr-CA") for i in range(6)] + [(2000, "zzz zzz", "xx"), (2001, "the", None), (2002, "the", "-")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.Settings(sample=40))
    assert model.languages == ("en", "fr")


def test_fusion_by_hand(spark, spoken):
    """The posterior of every row, from text likelihoods, declarations and host counts that are computed here row by row."""
    model, settings = langid.fit(spoken), langid.Settings()
    rows = [(r["doc_id"], r["text"], r["lang"] if r["doc_id"] % 7 else ("klingon" if r["doc_id"] % 2 else None), r["host"] if r["doc_id"] % 11 else None) for r in spoken.collect()] + [(9001, "", "fr", "host1.fr"), (9002, None, None, None), (9003, "12 34", "de", "host1.fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, said string, host string")
    names = model.languages
    text, seen = [], []
    for _, t, _, _ in rows:
        raw = (t or "").encode()
        total, count = langid.log_likelihoods(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), model)
        x = total[0] * (min(count[0], settings.evidence) / max(count[0], 1))
        p = np.exp(x - x.max())
        text.append(p / p.sum())
        seen.append(count[0] > 0)
    kind = lambda d: None if d is None else d if d in names else "*"
    given = {d: np.full(len(names), 0.5) for d in (*names, "*")}
    for (_, _, d, _), p, has in zip(rows, text, seen, strict=True):
        if has and d is not None:
            given[kind(d)] += p
    whole = sum(given.values())
    own = [p * given[kind(d)] / whole if d is not None else p for (_, _, d, _), p in zip(rows, text, strict=True)]
    own = [p / p.sum() for p in own]
    end = lambda h: None if h is None else h.rsplit(".", 1)[-1]
    hosts, ends, world = {}, {}, np.ones(len(names))
    for (_, _, _, h), p, has in zip(rows, own, seen, strict=True):
        if has:
            hosts[h] = hosts.get(h, 0) + p
            ends[end(h)] = ends.get(end(h), 0) + p
            world = world + p
    world /= world.sum()
    got = {r["doc_id"]: r for r in langid.identify(df, model, declared=F.col("said"), host=F.col("host"), suffix=F.substring_index("host", ".", -1)).collect()}
    assert len(got) == len(rows)
    for (i, _, _, h), p, has in zip(rows, own, seen, strict=True):
        prior, mine = world, p if has else 0 * p
        if h is not None:
            for counts in (ends[end(h)], hosts[h]):
                left = np.maximum(counts - mine, 0)
                prior = (left + settings.strength * prior) / (left.sum() + settings.strength)
        q = p * prior / (p * prior).sum()
        assert abs(got[i]["posterior"] - q.max()) < 2e-6
        assert got[i]["language"] == (names[int(q.argmax())] if has and q.max() >= settings.least else "und")


def test_language_odd(odd, empty, spoken):
    model = langid.fit(spoken)
    got = langid.identify(odd, model, declared=F.col("label"), host=F.col("host")).collect()
    assert len(got) == odd.count()
    silent = {r["doc_id"] for r in got if not r["accepted"]}
    assert {1, 2, 3} <= silent and all(r["language"] == "und" for r in got if not r["accepted"])
    kept = langid.keep_identified(odd, langid.identify(odd, model))
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2, 3)").count() == 0 and kept.where("doc_id = 13").count() == 1
    assert langid.identify(empty, model).collect() == []
    assert langid.fit(spoken.where("false")).languages == ("und",)


def test_long_texts_by_blocks(spoken, monkeypatch):
    model = langid.fit(spoken)
    text = ("the other and " * 3000 + "eau que " * 500).encode()
    whole = langid.log_likelihoods(np.frombuffer(text, np.uint8), np.array([0, len(text)]), model)
    monkeypatch.setattr(langid, "BLOCK", 1000)
    cut = langid.log_likelihoods(np.frombuffer(text, np.uint8), np.array([0, len(text)]), model)
    assert np.allclose(whole[0], cut[0], rtol=1e-5) and whole[1].tolist() == cut[1].tolist()


def test_page_evidence(spark):
    by = langid.page_evidence()
    rows = [("https://u@blog.x.FR:80/a?b", '<!DOCTYPE html><html class="a" lang="fr-FR"><script>the()</script><p>mot&amp;s</p><!-- x --></html>'), (None, None), ("nonsense", "plain")]
    got = spark.createDataFrame(rows, "url string, html string").select(*(c.alias(k) for k, c in by.items())).collect()
    assert got[0]["declared"] == "fr" and got[0]["host"] == "blog.x.fr" and got[0]["suffix"] == "fr" and got[0]["text"].split() == ["mot", "s"]
    assert got[1]["declared"] is None and got[2]["host"] is None


def longest(symbols, sequences):
    """Length of the longest substring of any sequence that ends at each symbol, by brute force."""
    known = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    return [max((k for k in range(1, i + 2) if tuple(symbols[i + 1 - k : i + 1]) in known), default=0) for i in range(len(symbols))]


def test_automaton():
    pick = random.Random(8)
    for _ in range(60):
        sequences = [[pick.randrange(1, 4) for _ in range(pick.randrange(1, 9))] for _ in range(pick.randrange(1, 5))]
        own = Automaton(sequences)
        symbols = [pick.randrange(1, 5) for _ in range(40)]
        states = list(own.statistics(symbols))
        assert [n for _, n in states] == longest(symbols, sequences)
        for i, (state, n) in enumerate(states):
            if n:
                here = {(k, e) for k, s in enumerate(sequences) for e in range(n, len(s) + 1) if s[e - n : e] == symbols[i + 1 - n : i + 1]}
                assert own.ends[state] == here


def base_truth(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licences.PHRASES:
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licences(spark, odd, empty):
    texts = [
        "x Released under the MIT License. y", "Licensed under CC BY-NC 4.0. cc-by CC/BY", "all rights\nRESERVED all rights reserved", "GNU General Public License general public license", "cc by" * 3, "İALL RIGHTS RESERVEDé all rights reserved",
        "Permission is hereby granted, free of charge, to anybody obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice",
    ]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {(r["doc_id"], r["text"]): r for r in licences.scan_licences(df, with_spans=True).join(df.select(F.col("doc_id").alias("d"), "text"), F.col("doc_id").eqNullSafe(F.col("d"))).collect()}
    for (doc, text), r in got.items():
        if doc is not None:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_truth(text), text
            assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    labels = {d: r["labels"] for (d, _), r in got.items()}
    assert "mit" in labels[100] and "cc-by-nc-4.0" in labels[101] and labels[102] == "reserved" and "mit" in labels[106] and labels[4] == ""
    assert licences.scan_licences(empty).collect() == []


def test_cut_templates_are_found():
    s = Scanner()
    words = licences.words_of(next(t for label, _, t in licences.TEMPLATES if label == "bsd-2-clause").encode())
    for keep in (0.7, 0.3):
        text = b" ".join([*words[: int(len(words) * keep)], b"zzz"])
        assert ("bsd-2-clause" in s.scan_text(text)[5]) == (keep > 0.6)


def test_each_template_names_itself():
    """Every notice and whole text gets its own licence's label and no sister's, alone and in other words."""
    s = Scanner()
    for label, _, text in licences.TEMPLATES:
        got = s.scan_text(f"Some words before it. {text} And some behind it.".encode())
        assert set(got[5].split(",")) - set(got[4].split(",")) == {label} and got[6] == 1.0, (label, text[:80], got[5])
    for text, label in (
        ("licensed under the GNU General Public License, version 2", "gpl-2.0"), ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or", "lgpl-3.0"),
        ("Licensed under CC BY 4.0", "cc-by-4.0"), ("CC BY-SA 3.0", "cc-by-sa-3.0"), ("the terms of the GNU General Public License", ""), ("may be used under the License, version 2.0", ""),
    ):
        got = s.scan_text(text.encode())
        assert set(got[5].split(",")) - set(got[4].split(",")) == ({label} if label else set()), text


def test_chains_against_brute_force():
    """The fullest chain of each template, against one that tries every chain of matches found by comparing all places."""
    pick = random.Random(13)
    for _ in range(150):
        templates = [("a", "", " ".join(pick.choice("pqrst") for _ in range(pick.randrange(4, 14)))) for _ in range(2)]
        scan = licences.Scan(least=2, gap=1, cover=0.1)
        scanner = Scanner(templates, (), scan, ())
        words = [pick.choice("pqrstx") for _ in range(24)]
        symbols = np.array([scanner.symbol.get(w.encode(), 0) for w in words], np.int32)
        for number, (_, _, text) in enumerate(templates):
            own = text.split()
            found = []
            for i in range(len(words)):
                for j in range(len(own)):
                    if (i == 0 or j == 0 or words[i - 1] != own[j - 1]) and words[i] == own[j]:
                        n = 0
                        while i + n < len(words) and j + n < len(own) and words[i + n] == own[j + n]:
                            n += 1
                        if n >= scan.least:
                            found.append((i + n, j + n, n))
            known = {}
            for end, at, n in sorted(found, key=lambda m: (m[0] - m[2], m)):
                ways = [c + min(n, at - b, end - a) for (a, b), cs in known.items() for c in cs if end - n - a <= 1 and at - n - b <= 1 and min(n, at - b, end - a) > 0]
                known.setdefault((end, at), []).append(max([n, *ways]))
            want = max((c for cs in known.values() for c in cs), default=0)
            got = [c[3] for c in scanner.chains(symbols) if c[2] == number]
            assert max(got, default=0) == want


def test_notice_after_a_piece_of_its_tail():
    """A whole notice counts in full after a heading, whose words stand late in the template."""
    scanner = Scanner()
    for label, heading in (("cc-by-4.0", "Creative Commons Attribution 4.0."), ("gpl-3.0", "GNU General Public License, version 3.")):
        notice = next(t for own, _, t in licences.TEMPLATES if own == label and len(t) > 60)
        got = scanner.scan_text(f"{heading} {notice}".encode())
        assert label in got[5].split(",") and got[6] == 1.0


@pytest.fixture(scope="module")
def vectors():
    pick = random.Random(3)
    return [[pick.uniform(-0.5, 0.5) for _ in range(64)] for _ in range(120)]


def test_media(spark, vectors):
    rows = [(i, v) for i, v in enumerate(vectors[:60])] + [(100 + i, vectors[0]) for i in range(20)] + [(200, None), (201, [0.1]), (None, vectors[1]), (5, vectors[5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    images = media.render(df).withColumn("query", F.lit(1)).withColumn("corners", F.lit("x")).withColumn("votes", F.lit("y"))
    found, members = media.find_copies(media.render(df.where("vec_id < 40"), edited="cropped"), images)
    got = {(r["query"], r["id"]) for r in found.collect()}
    assert len({q for q, i in got if q == i}) >= 39 and len(got) <= 43
    assert {r["class_id"] for r in members.where("id >= 100 and id < 200").collect()} == {0}
    blank, _ = media.find_copies(images.where("false"), images)
    assert blank.collect() == [] and media.find_copies(images, images.where("false"))[0].collect() == []
    odd = spark.createDataFrame([(1, 3, 3, b"x" * 9), (2, 40, 40, b"x" * 1600), (3, 10, 10, b"x"), (4, None, None, None)], "id long, width int, height int, pixels binary")
    assert all(r["corners"] == b"" for r in media.described(odd).collect())


def test_media_by_edit_against_full_comparison(spark, vectors):
    """Of each kind of edit at least 0.9 of the copies are found, and at least 0.9 of what comparing every descriptor with every one finds."""
    images = media.render(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    asked = spark.createDataFrame([(20 * k, vectors[k]) for k in range(90)], "vec_id long, embedding array<double>")
    edits = {r["vec_id"]: r["edit"] for r in asked.select("vec_id", media.edit_of(F.col("vec_id")).alias("edit")).collect()}
    queries = media.render(asked, edited=True)
    got = {(r["query"], r["id"]) for r in media.find_copies(queries, images)[0].collect()}
    full = {(r["query"], r["id"]) for r in media.compared_in_full(media.described(queries), media.described(images), media.Copies()).collect()}
    assert len(set(edits.values())) == len(media.EDITS) and got <= full and len(got) >= 0.9 * len(full)
    for edit in media.EDITS:
        own = [q for q, e in edits.items() if e == edit]
        assert sum((q, q // 20) in got for q in own) >= 0.9 * len(own), edit


def test_media_with_common_parts(spark, vectors):
    """Images that differ in one pixel share all their parts, more than count as common: their queries are compared with all images, and all copies are found."""
    image = media.drawn(np.array([v[:63] for v in vectors[:30]])).astype(np.uint8)
    rows = []
    for k in range(60):
        own = image[0].copy()
        own[k, 111] ^= 255
        rows.append((k, 112, 112, own.tobytes()))
    rows += [(100 + k, 112, 112, x.tobytes()) for k, x in enumerate(image[1:])]
    df = spark.createDataFrame(rows, "id long, width int, height int, pixels binary")
    found, members = media.find_copies(df.where("id in (7, 110)"), df, media.Copies(most=8))
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], set()).add(r["id"])
    assert got[7] >= set(range(60)) and 110 in got[110] and len(got[7]) <= 62
    assert members.where("id <> class_id").count() == 0


def test_media_finds_copies_by_common_parts_alone(spark):
    """A query that has many corners of its own, and shares with its copies only parts that more images have than count as common, finds them all."""
    draw, copies = np.random.default_rng(9), media.Copies(most=8)

    def corners(n, side):
        out = np.zeros(n, media.CORNER)
        out["tests"], out["turn"] = draw.integers(0, 256, (n, 32), dtype=np.uint8), draw.integers(0, media.TURNS, n)
        out["x"], out["y"] = draw.uniform(0, side, (2, n))
        return out

    shared = corners(20, 100)
    images = [np.concatenate([shared, corners(20, 100)]) for _ in range(30)]
    scattered = []
    for _ in range(30):  # have the same corners elsewhere, which makes no copy of them
        other = shared.copy()
        other["x"], other["y"], other["turn"] = *draw.uniform(0, 100, (2, 20)), draw.integers(0, media.TURNS, 20)
        scattered.append(np.concatenate([other, corners(20, 100)]))
    rows = lambda own, first: spark.createDataFrame([(first + k, x.tobytes()) for k, x in enumerate(own)], "id long, corners binary")
    query, index = rows([np.concatenate([shared, corners(20, 100)])], 1000), rows(images + scattered, 0)
    by_parts = media.met(query, index, copies).collect()
    assert not [r for r in by_parts if r["id"] is not None and r["votes"] >= copies.votes]
    told = 40 * copies.tables - sum(r["votes"] for r in by_parts if r["id"] is None)
    assert told >= copies.enough  # so the query isn't compared with every image
    got = {r["id"] for r in media.found_by_corners(query, index, copies).collect()}
    assert got == set(range(30)) == {r["id"] for r in media.compared_in_full(query, index, copies).collect()}


def test_media_does_not_take_chance_for_copies():
    """Images of corners that all look alike agree in some places on any transform, which makes no copies; those that lie alike throughout are ones."""
    draw, copies = np.random.default_rng(4), media.Copies()
    images = np.zeros((40, 24), media.CORNER)
    images["x"], images["y"] = draw.uniform(0, 100, (2, 40, 24))
    owner = np.repeat(np.arange(40), 24)
    for k in range(40):
        assert [t for t, _ in media.agreeing(images[k], images.ravel(), owner, 40, copies)] == [k]


def test_media_looks_up_every_common_part():
    """What shares parts of as many places by one rough transform is met, whichever places are looked up last, as by counting all that they share."""
    draw, copies = np.random.default_rng(5), media.Copies()
    kinds, often = draw.integers(0, 256, (12, 32), dtype=np.uint8), np.array([20, 10, 5, *[1] * 9]) / 44
    images = np.zeros((60, 30), media.CORNER)
    images["x"], images["y"] = draw.uniform(0, 100, (2, 60, 30))
    images["turn"], images["level"], images["tests"] = draw.integers(0, 2, (60, 30)) * 10, draw.integers(0, 4, (60, 30)), kinds[draw.choice(12, (60, 30), p=often)]
    images["tests"][:, :, 4:24][draw.random((60, 30)) < 0.5] = draw.integers(0, 256, 20, dtype=np.uint8)  # share some parts, not all
    got = {(k, t) for k, hit in media.roughly_alike(images[:20].ravel(), np.full(20, 30), media.parts_of(images.ravel(), np.repeat(np.arange(60), 30), 60, copies), copies) for t in hit.tolist()}
    want, (rate, *cells) = set(), media._transforms()
    parts, code = np.ascontiguousarray(images["tests"]).view("<u4")[..., : copies.tables], images["level"].astype(np.int64) * 2 * media.TURNS + images["turn"]
    for k in range(20):
        own, far = media.places(images[k]), media._half_cells(images[k])
        for t in range(60):
            i, j = np.nonzero((parts[k][:, None] == parts[t][None]).any(axis=2))
            turn = code[t][j] - code[k][i] + (2 * 255 + 1) * media.TURNS
            z = media._half_cells(images[t])[j] + np.complex64(8192 + 8192j) - rate[turn] * (far - far.mean())[i]
            need = max(copies.agree, int(np.ceil(copies.share * min(len(np.unique(own)), len(np.unique(media.places(images[t])))))))
            for off in (0, 1):
                held = {}
                for x, y, c, at in zip((z.real.astype(int) + off) // 2, (z.imag.astype(int) + off) // 2, cells[off][turn].tolist(), own[i].tolist(), strict=True):
                    held.setdefault((x, y, c), set()).add(at)
                if max(map(len, held.values()), default=0) >= need:
                    want.add((k, t))
    assert {(k, k) for k in range(20)} <= want <= got and 20 < len(want) < 1100 and len(got - want) <= 0.02 * 1200


def test_media_finds_far_matches(spark):
    """Copies whose 20 common corners differ in as many bits as still count as a match are all found by the full comparison."""
    draw, copies = np.random.default_rng(8), media.Copies()
    base = np.zeros((40, 20), media.CORNER)
    base["tests"] = draw.integers(0, 256, (40, 20, 32), dtype=np.uint8)
    base["x"], base["y"] = draw.uniform(0, 100, (2, 40, 20))
    for bits in (0, 16, copies.apart):
        flipped = np.unpackbits(base["tests"], axis=2)
        for own in flipped.reshape(-1, 256):
            own[draw.permutation(256)[:bits]] ^= 1
        other = base.copy()
        other["tests"] = np.packbits(flipped, axis=2)
        rows = lambda t: spark.createDataFrame([(k, t[k].tobytes()) for k in range(40)], "id long, corners binary")
        got = media.compared_in_full(rows(other), rows(base), copies).collect()
        assert [(r["query"], r["id"]) for r in sorted(got)] == [(k, k) for k in range(40)] and all(r["agreeing"] >= 15 for r in got)
        i, j, d = media.matches(other["tests"].reshape(-1, 32), base["tests"].reshape(-1, 32), copies.apart)
        assert sorted(zip(i, j, d, strict=True)) == [(k, k, bits) for k in range(800)]


def test_drawn_images_are_flat(spark):
    """The drawn images are rectangles on plain ground, whose corners are alike in many images: nothing is added to tell them apart."""
    pick = random.Random(4)
    rows = [(i, [pick.uniform(-0.5, 0.5) for _ in range(64)]) for i in range(3)]
    for r in media.render(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        assert len(set(r["pixels"])) <= media.SHAPES + 1
