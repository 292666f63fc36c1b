"""Connected components of an edge list by alternating large-star and small-star rounds.

Labels only ever travel as rows of ``(a, b)`` through shuffles; the driver sees two numbers a round. A node with more
than a ``HEAVY``-th of all links is a hub: there are fewer than ``HEAVY`` of these, so their labels are broadcast and
their links stay where they are instead of meeting in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

HEAVY = 1000
LEAST_HEAVY = 64


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, larger: bool, total: int) -> DataFrame:
    """Hang neighbours on the smallest label around. The minimum is joined back, never gathered in a list."""
    low = stage(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "low")
    hub = F.col("n") > max(LEAST_HEAVY, 2 * total // HEAVY)
    hubs = F.broadcast(low.where(hub).select(F.col("a").alias("h"), F.col("m").alias("hm")))  # fewer than HEAVY rows
    l = links.join(hubs, F.col("a") == F.col("h"), "left")
    rest = l.where("h is null").select("a", "b").join(low.where(~hub).select("a", "m"), "a")
    j = rest.select("a", "b", "m").union(l.where("h is not null").select("a", "b", "hm"))
    if larger:
        return j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    hung = j.select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = low.select("a", F.col("m").alias("b"))
    return hung.union(own).where("a <> b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; ``root`` is the smallest node of its component.

    Self loops, repeated and mirrored edges are allowed. No edges give no rows.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    last, total = None, e.count()
    for _ in range(most):
        e = stage(_star(_both(e), True, 2 * total), "edges")
        e = stage(_star(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False, total), "edges")
        # a fixed point is a forest of stars: its edge set, and so this digest, no longer changes
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            break
        last, total = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
