"""Closures over ledger graphs: reachability, levels and taint times.

Each round joins only what the round before found (semi-naive evaluation) and
writes its rows to the shared folder, so the plan does not grow and a lost
executor costs no more than its last round.  All joins carry ``log_id``: many
ledgers advance together, and no ledger is gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans import materialize, release


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Everything reachable from ``seeds`` along ``edges``, seeds included.

    ``seeds`` has ``log_id`` and ``node``; ``edges`` has ``log_id``, ``src`` and
    ``dst``.  Returns distinct ``log_id``, ``node`` and ``level`` (fewest steps).
    Cycles end, as a node is entered once.
    """
    edges = materialize(edges.select("log_id", "src", "dst"), "edges")  # every round reads them
    fresh = materialize(seeds.select("log_id", "node").distinct().withColumn("level", F.lit(0)), "closure")
    rounds = [fresh]
    level = 0
    while True:
        level += 1
        seen = reduce(DataFrame.unionAll, rounds).select("log_id", "node")
        step = (
            fresh.select("log_id", F.col("node").alias("src")).join(edges, ["log_id", "src"])
            .select("log_id", F.col("dst").alias("node")).distinct()
            .join(seen, ["log_id", "node"], "left_anti").withColumn("level", F.lit(level))
        )
        fresh = materialize(step, "closure")
        if fresh.isEmpty():
            release(fresh)
            release(edges)
            return reduce(DataFrame.unionAll, rounds)
        rounds.append(fresh)


def descents(starts: DataFrame, back: DataFrame) -> DataFrame:
    """Breadth-first descent from many starts at once.

    ``starts`` has ``log_id`` and ``start``; ``back`` has ``log_id``, ``src``,
    ``dst``, ``via`` and ``ordinal`` (order of an edge at its source).  Returns
    ``log_id``, ``start``, ``node``, ``via``, ``level`` and ``rank``: every node
    once, reached over the edge that a queue would take first, and its place in
    that order within its level.
    """
    back = materialize(back.select("log_id", "src", "dst", "via", "ordinal"), "edges")  # every round reads them
    fresh = materialize(
        starts.select("log_id", "start", F.col("start").alias("node"), F.lit(None).cast("string").alias("via"), F.lit(0).alias("level"), F.lit("").alias("rank")),
        "descent",
    )
    rounds = [fresh]
    level = 0
    while True:
        level += 1
        seen = reduce(DataFrame.unionAll, rounds).select("log_id", "start", "node")
        # A path's rank is the ranks of its edges one after the other, at fixed width.
        rank = F.concat("rank", F.lpad(F.hex("ordinal"), 8, "0"))
        step = (
            fresh.alias("f").join(back.alias("b"), F.expr("f.log_id = b.log_id and f.node = b.src"))
            .select("f.log_id", "start", F.col("b.dst").alias("node"), F.struct(rank.alias("rank"), F.col("b.via").alias("via")).alias("p"))
            .groupBy("log_id", "start", "node").agg(F.min("p").alias("p"))
            .join(seen, ["log_id", "start", "node"], "left_anti")
            .select("log_id", "start", "node", "p.via", F.lit(level).alias("level"), F.col("p.rank").alias("rank"))
        )
        fresh = materialize(step, "descent")
        if fresh.isEmpty():
            release(fresh)
            release(back)
            return reduce(DataFrame.unionAll, rounds).where("level > 0")
        rounds.append(fresh)


def taint_times(records: DataFrame, edges: DataFrame) -> DataFrame:
    """When each record becomes tainted, if ever.

    ``records`` has ``log_id``, ``id``, ``time`` and ``ret_time`` (null: never
    retracted); ``edges`` has ``log_id``, ``src`` and ``dst`` for Use and
    Require references of accepted records.  A record is tainted from the
    moment that it stands and one of its targets is retracted or tainted:
    taint(r) = min over targets x of max(time(r), min(ret(x), taint(x))).
    Returns ``log_id``, ``id`` and ``taint_time`` of tainted records.  Each
    round improves times only, and there are finitely many.
    """
    linked = edges.select("log_id", "src", "dst").join(
        records.select("log_id", F.col("id").alias("src"), "time"), ["log_id", "src"]
    )
    linked = materialize(linked, "taint-edges")
    known = None
    fresh = materialize(records.where("ret_time is not null").select("log_id", "id", F.col("ret_time").alias("at")), "taint")
    while not fresh.isEmpty():
        step = (
            fresh.select("log_id", F.col("id").alias("dst"), "at").join(linked, ["log_id", "dst"])
            .groupBy("log_id", F.col("src").alias("id")).agg(F.min(F.greatest("time", "at")).alias("at"))
        )
        if known is None:
            better, merged = step, step
        else:
            better = step.join(known.withColumnRenamed("at", "old"), ["log_id", "id"], "left").where("old is null or at < old").drop("old")
            merged = known.unionAll(step).groupBy("log_id", "id").agg(F.min("at").alias("at"))
        better, merged = materialize(better, "taint"), materialize(merged, "taint")
        release(fresh)
        release(known)
        fresh, known = better, merged
    if known is None:
        known = fresh
    return known.withColumnRenamed("at", "taint_time")
