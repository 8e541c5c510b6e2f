"""Connected components of a link table, in Spark only.

Alternating rounds of *large star* and *small star* rewire links until every
node hangs directly on the smallest node of its component.  Each round is a
pair of aggregations and joins on the node, written to the shared folder; the
links never reach the driver.  A node with very many links is spread by the
partial aggregation (a minimum) and by AQE's skew handling of the join.

Null ends are ignored, self links and repeated links do no harm, and an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserql.llm.common import checkpointed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One rewiring; ``links`` holds (a, b) with a > b, each once."""
    if large:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node that has a link to another one;
    the component is its smallest node."""
    x, y = F.col(a), F.col(b)
    now = checkpointed(
        links.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
        .distinct()
    )
    before = None
    while True:
        # of a star forest the number of links and the sum of their ends stay
        sums = now.agg(
            F.count("*").alias("n"),
            F.sum(F.col("a").cast("decimal(38,0)")).alias("a"),
            F.sum(F.col("b").cast("decimal(38,0)")).alias("b"),
        ).first()
        if sums.n == 0 or sums == before:
            break
        before = sums
        now = checkpointed(_star(_star(now, large=True), large=False))
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
