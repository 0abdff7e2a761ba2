"""State of a ledger just before each record, as window and grouped aggregates.

Nothing here folds a log in sequence: a slot as of time t is the last event of
its key before t.  Windows are partitioned by slot, of which there are more than
logs, so one long log does not become one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(events: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add the last value that the key had before this row; null values don't count."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(name, F.last(value, ignorenulls=True).over(before))


def open_before(events: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column, name: str) -> DataFrame:
    """Add the number of opened less closed actions of the key before this row."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(opens, 1).when(closes, -1).otherwise(0)
    return events.withColumn(name, F.coalesce(F.sum(change).over(before), F.lit(0)))


def turns(responses: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``turn_index``: how many accepted responses the request had before."""
    return responses.withColumn("turn_index", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def gap_free(records: DataFrame, log: str, pos: str) -> DataFrame:
    """``log``, ``n`` and ``gap_free``: whether times count on by one from the first."""
    step = F.col(pos) - F.lag(pos).over(Window.partitionBy(log).orderBy(pos))
    return records.select(log, step.alias("step")).groupBy(log).agg(
        F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("step") == 1), F.lit(True)).alias("gap_free")
    )


def usage_counts(usages: DataFrame, keys: list[str], outcome: str) -> DataFrame:
    """Counts of the three outcomes of a record's use in a role."""
    return usages.groupBy(*keys).agg(*(F.count_if(F.col(outcome) == o).alias(o) for o in ("done", "not_done", "no_change")))


def context(records: DataFrame, thread: str, time: str, ident: str, most: int) -> DataFrame:
    """The newest ``most`` records of every thread: by time, newest first, then id."""
    order = Window.partitionBy(thread).orderBy(F.col(time).desc(), F.col(ident).asc())
    return records.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def head_hashes(records: DataFrame, log: str, pos: str, ident: str) -> DataFrame:
    """SHA-256 over a log's 32-byte ids in log order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(pos, ident))), lambda x: F.hex(x[ident]))
    return records.groupBy(log).agg(F.sha2(F.unhex(F.array_join(ids, "")), 256).alias("head_hash"), F.count("*").alias("n"))
