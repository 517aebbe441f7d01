"""Scheduling predicates over tasks and their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.sequence import first_wins


def last_state(events: DataFrame, key: str = "task") -> DataFrame:
    """The last event of each task."""
    return first_wins(events, [key], [F.desc("ts"), F.desc("event_id")])


def ready(tasks: DataFrame) -> DataFrame:
    """Pending tasks without a parent, or whose parent is done; tasks: task, parent, state."""
    done = tasks.filter("state = 'done'").select(F.col("task").alias("parent"), F.lit(True).alias("_done"))
    return tasks.filter("state = 'pending'").join(done, "parent", "left").filter("parent is null or _done").select("task", "parent", "state")


def blocked(tasks: DataFrame) -> DataFrame:
    """Pending tasks whose parent failed."""
    failed = tasks.filter("state = 'failed'").select(F.col("task").alias("parent"))
    return tasks.filter("state = 'pending'").join(failed, "parent", "left_semi").select("task", "parent", "state")


def dispatched(waiting: DataFrame, rank: dict[str, int], slots: int) -> DataFrame:
    """The first waiting tasks by kind's rank, then task, as far as slots go."""
    order = F.element_at(F.create_map(*(x for k, v in rank.items() for x in (F.lit(k), F.lit(v)))), F.col("kind"))
    return waiting.withColumn("rank", F.coalesce(order, F.lit(len(rank)))).orderBy("rank", "task").limit(slots)


def reclaimed(leases: DataFrame, now, seconds: int) -> DataFrame:
    """Leases older than this many seconds."""
    return leases.withColumn("age", F.unix_timestamp(now) - F.unix_timestamp(F.col("ts").cast("timestamp"))).filter(F.col("age") > seconds)


def superseded(base: DataFrame, repair: DataFrame, key: str) -> DataFrame:
    """Rows of base with those of repair in their place."""
    r = repair.select(key, F.struct(*[c for c in repair.columns if c != key]).alias("_r"))
    joined = base.join(r, key, "left")
    return joined.select(key, *(F.when(F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) for c in base.columns if c != key), F.col("_r").isNotNull().alias("repaired"))


def packed(rows: DataFrame, key: str, order: list, size: int) -> DataFrame:
    """Groups of size in order; a last group of one joins the one before it."""
    w = Window.partitionBy(key)
    own = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    lone = (F.col("_n") % size == 1) & (F.col("_n") > 1)
    return own.withColumn("group", F.when(lone & (F.col("_i") == F.col("_n") - 1), F.expr(f"(_n - 2) div {size}")).otherwise(F.expr(f"_i div {size}")).cast("long")).drop("_i", "_n")
