"""Connected components over an edge table of any size, with no edge or label on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node it can reach.

    Alternates large-star and small-star steps until the edges are stars around their roots, which a count a node
    tells without a step more. Each step keeps at most one edge a node and smaller neighbour, takes minima before it
    shuffles, and is written to the shared folder. Self-loops keep their node; null ends are ignored; an empty
    edge table gives an empty result.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    met = written(both.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    now, loops = met.where("u <> v"), met.where("u = v")
    step = None
    while not _starred(now):
        large = _star(now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        now = written(_star(large, larger=False), "edges")
        if step is not None:
            dropped(step)
        step = now
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = ends.unionByName(roots)
    if loops.isEmpty():
        return found
    return found.unionByName(loops.select(F.col("u").alias("node")).join(found, "node", "left_anti").select("node", F.col("node").alias("root")))


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Hooks the neighbours of each u to the smallest of them and u; larger: only those above u, else u as well.

    The larger ones are a row an edge, with repeats, which the other step takes out.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = pairs.join(least, "u")
    if larger:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _starred(edges: DataFrame) -> bool:
    """Whether each node is the upper end of one edge and the lower end of none, or of no edge the upper end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    per = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return per.where("ups > 1 or ups = 1 and least = 0").agg(F.count("*")).first()[0] == 0
