"""Connected components of a table of links, by large and small stars.

Each round gives every node's neighbours to the least of them; rounds grow with the logarithm of the longest chain.
Only DataFrame operations, and each round's links are written to the shared folder: nothing of the graph reaches the
driver but two sums. A node with very many neighbours is aggregated before it is shuffled, and its join is one that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.session import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b). Large star: of a node and its neighbours, the larger neighbours get the least; small star: the
    smaller neighbours and the node itself do."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    met = both.join(least, "a")
    if large:
        met = met.where("b > a")
    else:
        met = met.unionByName(least.select("a", F.col("a").alias("b"), "m"))
    return met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node it reaches) for each node of a link; a node without links isn't there.
    Links of a node to itself and null ends count for nothing."""
    now = scratch.save(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "links")
    sign = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = None
    while True:
        nxt = scratch.save(_star(_star(now, True), False), "links")
        scratch.drop(now)
        now, seen = nxt, tuple(nxt.agg(sign.alias("s")).first()["s"])
        if seen == before:
            break
        before = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
