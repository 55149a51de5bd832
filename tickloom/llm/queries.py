"""The registered queries of the operators, each over its whole table, and their DuckDB twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpesql, exactdedup, langid, licences, linededup, media, oddsketch, packing, tokenbin, tokencount


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: declared in lang, from the host source; the trigram model is fitted on about 4,000 of them."""
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs), declared=F.col("lang"), host=F.col("source"))


def op1_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages: declared in the markup, with the host and suffix of their address; the model is that of documents."""
    by = langid.page_evidence()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("__text", by["text"])
    found = langid.identify(pages, langid.fit(documents(spark, sf_dir)), id_col="page_id", text_col="__text", declared=by["declared"], host=by["host"], suffix=by["suffix"])
    return found.withColumnRenamed("doc_id", "page_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of each document."""
    left = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return left.select("doc_id", F.col("lines_dropped"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op3_bpe_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of documents by the rank file, and what they decode to. Null texts are empty ones; a row comes out for each that went in, repeated and odd ones too."""
    return bpesql.encoded(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, licences and score of every whole text of documents. Null texts are empty ones; a row comes out for each that went in, repeated and odd ones too."""
    return licences.scan_licences(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents, counted without the library. Null texts are empty ones; a row comes out for each that went in, repeated and odd ones too."""
    return tokencount.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents. Null texts are empty ones; a row comes out for each that went in, repeated and odd ones too."""
    return exactdedup.exact_groups(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of binary lengths, a sequence each; a null text has its end id alone."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited versions of the images of every twentieth row of embeddings, searched among the images of all its rows.

    The tables have no image column, so images are drawn from the vectors; the edits take turns. A row per query and class of equal images that it copies.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found, members = media.find_copies(media.render(vectors.where("vec_id % 20 = 0"), edited=True), media.render(vectors))
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    named = found.join(sizes, F.col("id") == F.col("class_id")).join(members.select(F.col("id").alias("query"), F.col("class_id").alias("own_class")), "query")
    return named.select("query", media.edit_of(F.col("query")).alias("edit"), "class_id", "class_size", "agreeing", (F.col("class_id") == F.col("own_class")).alias("own"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents at 75 % of five-word shingles. Null texts are empty ones; a row comes out for each that went in, repeated and odd ones too."""
    return oddsketch.near_duplicates(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back. Null texts are empty ones; a row comes out for each that went in, repeated and odd ones too."""
    return tokenbin.token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op1_language_id_pages,
        op2_line_dedup,
        op3_bpe_sql,
        op4_licence_scan,
        op5_token_counts,
        op6_exact_dedup,
        op7_packing,
        op8_media_copies,
        op9_minhash_near_dedup,
        op10_token_files,
    )
}

ORACLE_SQL = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_minhash_near_dedup": r"""
        WITH RECURSIVE
        w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
        e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
              FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
        both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, t.b FROM r JOIN both_ways AS t ON r.other = t.a)
        SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
        FROM s JOIN (SELECT id, min(other) AS component_id FROM r GROUP BY id) AS c ON s.doc_id = c.id""",
}
