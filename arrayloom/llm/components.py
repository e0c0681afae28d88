"""Connected components by hooking and shortcutting over parent tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.runtime import discard, written

JUMPS = 3


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex in edges (a, b); root is the least vertex of its component.

    Each round hooks every root to the least root it touches, shortcuts the
    parent table by pointer jumping, and contracts the edges to what still joins
    two roots. A parent is never larger than its child, so there are no cycles
    and the least vertex stays its own root. Rounds end when no edge is left.
    Nulls in a or b are left out, loops and repeated edges change nothing.
    """
    edges = written(edges.select("a", "b").filter("a is not null and b is not null").distinct(), "edges")
    parents = edges.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().withColumn("root", F.col("vertex"))
    edges_left = edges.filter("a <> b")
    old: DataFrame | None = None
    while not edges_left.isEmpty():
        both = edges_left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        hooked = both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("p"))
        hooked = written(hooked, "hooked")
        jumped = hooked
        for _ in range(JUMPS):
            up = hooked.select(F.col("v").alias("w"), F.col("p").alias("q"))
            jumped = jumped.join(up, F.col("p") == F.col("w"), "left").select("v", F.coalesce("q", "p").alias("p"))
        jumped = written(jumped, "jumped")
        p_of = jumped.select(F.col("v").alias("w"), F.col("p").alias("q"))
        new_parents = written(
            parents.join(p_of, F.col("root") == F.col("w"), "left").select("vertex", F.coalesce("q", "root").alias("root")), "parents"
        )
        ends = edges_left.join(jumped.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(
            jumped.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b"
        )
        new_edges = written(ends.select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b").distinct(), "edges")
        for done in (hooked, jumped, edges, *([old] if old is not None else [])):
            discard(done)
        parents = old = new_parents
        edges = edges_left = new_edges
    return parents
