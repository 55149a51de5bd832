"""The pipeline's stages on a small table, each against what it should do."""

from pathlib import Path

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_dedup import line_truth, near_truth
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tickloom.llm import linededup, queries


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == columns
        rows = after.collect()
        assert 0 < len(rows) <= docs.count()
        if name == "language_id":
            gone = docs.join(after.select("doc_id"), "doc_id", "left_anti").collect()
            assert all(not any(c.isalpha() for c in (r["text"] or "")) for r in gone)
        if name == "line_dedup":
            seen = [line for r in rows for line in (r["text"] or "").split("\n") if line.strip()]
            assert len(seen) == len(set(seen)) and all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
        docs = spark.createDataFrame(rows, after.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in packed) == sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())


def test_registered():
    own = entry.queries()
    assert "pipeline" in own and {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in own if k.startswith("op")}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "packing"]


def test_run_against_brute_force(spark, sf):
    """What language id leaves, deduplicated line by line and document by document over all pairs, and counted by the library, is what the pipeline packs."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in corpus_pipeline.language_id(spark, docs, sf).collect()]
    before = dict(rows)
    lined = {i: own[0] for i, own in line_truth(rows, linededup.Lines()).items()}
    lined = {i: t for i, t in lined.items() if t == before[i] or t.strip(" ")}
    part = near_truth(list(lined.items()))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in lined.items() if part[i] == i}
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r["doc_id"]] = r["doc_tokens"]
    assert got == want and 0 < len(want) < len(rows)


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_stages_on_odd_rows(spark, sf, request, rows):
    docs = request.getfixturevalue(rows)
    docs = docs.withColumns({"lang": F.when(F.col("doc_id") % 3 == 0, "en-US"), "source": F.when(F.col("doc_id") % 2 == 0, "host.example"), "n_chars": F.when(F.col("doc_id") != 4, F.length("text").cast("long"))})
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString()
        docs = spark.createDataFrame(after.collect(), after.schema)
        assert docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert (rows == "empty") == (before == 0) and len({r["sequence_id"] for r in packed}) == len(packed)


def test_line_dedup_deletes_band_keys_before_texts_move(spark, sf, monkeypatch):
    """Band keys are most of what the stage writes; they are gone when its lines are linked."""
    apart, there, beside, link = [], [], linededup.beside, linededup.link

    def noted(df):
        apart.append(beside(df))
        return apart[-1]

    def linked(*args):
        there.extend(Path(x._tickloom_path.removeprefix("file://")).exists() for x in apart)
        return link(*args)

    monkeypatch.setattr(linededup, "beside", noted)
    monkeypatch.setattr(linededup, "link", linked)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.line_dedup(spark, docs, sf).count() > 0
    assert there == [False]
