"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join, so no component is ever
gathered in one task; a round's edges are written to the shared folder, which
cuts the lineage and survives lost executors.  The number of rounds grows with
the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans import materialize, release


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Map each node that has an edge to the least node it can reach.

    ``edges`` holds two columns of one orderable type.  Returns ``node`` and
    ``root``; nodes without an edge to another node are absent.  Null ends and
    self-loops are ignored, repeated edges count once, and an empty table gives
    an empty table.
    """
    a, b = F.col(left), F.col(right)
    start = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    now = materialize(start.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(lowest, "hi")
            .where("lo > m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionAll(lowest.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        then = materialize(small, "edges")
        release(now)
        now, last, state = then, state, _state(then)
        if state == last:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
