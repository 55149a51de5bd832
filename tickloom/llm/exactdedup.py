"""Exact duplicates by skew-safe combining, in DataFrame operations only.

Three stages, each of which groups by the content itself beside its digest, so that equal digests alone never
merge two texts: within a task (the partial aggregate), within a salt of a digest, then across a digest's
salts. The salt is the number of the task that read the row, folded, so a hot text reaches each salt as one
row per task, and its digest as one row per salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import materialize, texts_of

SALTS = 16


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of docs.

    Texts are equal if they are identical; null counts as empty. Of equal texts the row with the largest doc_id stays.
    Rows repeated under that doc_id are all marked as kept, being the same document; group_size counts rows. A null doc_id
    is smaller than any other: such a row is kept only if its group has no doc_id, and keep_id is null then. Other columns
    are left alone; an empty table gives an empty one.
    """
    rows = texts_of(docs, id_col, text_col).withColumn("digest", F.sha2("text", 256))
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    local = salted.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Salt winners meet by digest alone; grouping by (digest, text) and then by digest needs no further exchange.
    winners = local.select("digest", "text", "keep_id", "group_size").repartition("digest").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = materialize(groups, "exact-groups")
    # Content has shown that a digest with one text stands for that text; the others, if any, are compared again by content.
    plain = rows.select("doc_id", "digest").join(groups.where("texts = 1"), "digest").select("doc_id", "digest", "keep_id", "group_size")
    clashing = groups.where("texts > 1").select("digest")
    if not clashing.isEmpty():
        apart = rows.join(clashing, "digest", "left_semi")
        by_text = apart.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        plain = plain.unionByName(apart.join(by_text, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size"))
    return plain.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_largest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """docs without the rows that exact_groups() doesn't keep; all columns as they were, rows with a null doc_id stay."""
    gone = exact_groups(docs, id_col, text_col, salts).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__tickloom_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__tickloom_gone"], "left_anti")
