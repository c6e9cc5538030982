"""Connected components of an edge table by alternating large-star and small-star steps.

Repeated edges count once; an edge from a node to itself, or with a null end, names no component. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import settle


def _attach(rows: DataFrame, least: DataFrame, often: int) -> DataFrame:
    """``rows`` with their node's m. Nodes of ``often`` neighbours or more are few and are broadcast, as one task would get all rows of such a node."""
    hot = F.broadcast(least.where(F.col("n") >= often).select("a", "m"))
    rest = least.where(F.col("n") < often).select("a", "m")
    return rows.join(hot, "a").unionByName(rows.join(hot.select("a"), "a", "left_anti").join(rest, "a"))


def connected(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); component is the least node that can be reached.

    Every step writes its edges to the shared folder. Each star is an aggregate of the
    neighbours' least value, so that no node's neighbours have to meet in one row, and the rows of
    a node with very many neighbours are never brought together in one task.
    """
    now = settle(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    held = print_of(now)
    for _ in range(most_steps):
        often = max(1000, held[0] // 1000)
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).selectExpr("a", "least(a, m) AS m", "n")
        large = settle(_attach(both.where("b > a"), least, often).selectExpr("b AS a", "m AS b").distinct(), "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _attach(large, least, often).selectExpr("CASE WHEN b = m THEN a ELSE b END AS a", "m AS b").where("a <> b").distinct()
        now = settle(small, "edges")
        then, held = held, print_of(now)
        if then == held:
            return now.selectExpr("a AS node", "b AS component").unionByName(now.selectExpr("b AS node", "b AS component")).distinct()
    raise RuntimeError("components did not settle")
