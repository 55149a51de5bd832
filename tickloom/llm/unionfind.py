"""Connected components of links as joins: alternate large and small stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import discard, materialize


def _nodes(edges: DataFrame, label: str) -> DataFrame:
    """(u, m, ends): each node's least neighbour, and twice its smaller neighbours, plus 1 if it has larger ones; written, so that a join with it has two plain shuffles, which Spark splits where they are skewed."""
    both = edges.select("u", "v", F.lit(2).alias("end")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("end")))
    own = both.groupBy("u").agg(F.min("v").alias("m"), (F.sum("end") + F.max(F.when(F.col("end") == 0, 1).otherwise(0))).alias("ends"))
    return materialize(own, label)


def _large(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Of each node's neighbours the larger ones go to the least of them all."""
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))  # an edge's u is the larger end
    return larger.join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Of each node's smaller neighbours, and the node itself, all go to the least."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def stars(links: DataFrame, label: str = "stars") -> DataFrame:
    """(u, v): each linked node u but the smallest of its component, with that smallest v.

    links has two long columns, whose names don't matter; order, repeats and loops are of no account, rows with a null are left out.
    Hot nodes are safe: minima are combined before the shuffle, and the joins are ones that Spark splits. Rounds grow with the
    logarithm of a component's diameter; each is written to the shared folder, and the one before is deleted.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and `{a}` != `{b}`").distinct()
    edges = materialize(edges, label)
    while True:
        nodes = _nodes(edges, f"{label}-nodes")
        if nodes.where("ends > 2").isEmpty():  # each node has one edge, to a node that has none
            discard(nodes)
            return edges
        after = materialize(_small(_large(edges, nodes.select("u", "m"))), label)
        discard(edges)
        discard(nodes)
        edges = after


def labels(star_edges: DataFrame) -> DataFrame:
    """(id, component) of every node that the stars hold."""
    roots = star_edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    out = star_edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
    out._tickloom_path = getattr(star_edges, "_tickloom_path", None)  # type: ignore[attr-defined]  discard() deletes what it reads
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each linked node reaches."""
    return labels(stars(links))
