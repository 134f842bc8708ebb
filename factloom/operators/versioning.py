"""Append-only versions, current views and idempotent loads; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def key_id(*columns: str):
    """A deterministic id of a natural key; nulls count, so keys that differ in a null differ."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256), 1, 32)


def new_versions(captures: DataFrame) -> DataFrame:
    """Captures (artifact_id, capture_id, captured_at, sha256) as versions: the first of each content, chained.

    previous_id is the version before it of the same artifact.
    """
    first = captures.groupBy("artifact_id", "sha256").agg(F.min(F.struct("captured_at", "capture_id")).alias("c"))
    rows = first.select("artifact_id", "sha256", "c.captured_at", "c.capture_id")
    order = Window.partitionBy("artifact_id").orderBy("captured_at", "capture_id")
    return rows.withColumn("previous_id", F.lag("capture_id").over(order)).withColumn("version", F.row_number().over(order))


def changed(states: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """States that differ from the one before (null-safe); the first counts as changed."""
    w = Window.partitionBy(key).orderBy(*order)
    before = states.withColumn("_before", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    return before.where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_n")


def current(rows: DataFrame, run_key: str, run_order: list[str]) -> DataFrame:
    """Rows of the latest run of each document; earlier ones are superseded by a window over runs alone."""
    runs = rows.select(run_key, *run_order).distinct()
    w = Window.partitionBy(run_key).orderBy(*(F.col(c).desc() for c in run_order))
    last = runs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return rows.join(last, [run_key, *run_order], "left_semi")


def missing(new: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """What an idempotent load appends: rows whose natural key (null-safe) is not known, each key once."""
    k = known.select(*(F.col(c).alias(f"_{c}") for c in on)).distinct()
    cond = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        cond = same if cond is None else cond & same
    return new.dropDuplicates(on).join(k, cond, "left_anti")


def interval_history(states: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """State changes as intervals [from, to): the end is the next change, null while it lasts."""
    w = Window.partitionBy(key).orderBy(at)
    return changed(states, key, [at], value).select(key, value, F.col(at).alias("from_ts"), F.lead(at).over(w).alias("to_ts"))
