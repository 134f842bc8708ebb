"""Repairs as pure transforms: a row and an outcome for each thing looked at; applying one appends its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_from_consensus(rows: DataFrame, key: str, group: str, column: str) -> DataFrame:
    """(key, outcome, column) of rows without a value: FILLED by the only value of their group, else AMBIGUOUS or NO_ISSUER."""
    known = rows.groupBy(F.col(group).alias("of")).agg(F.countDistinct(column).alias("n"), F.min(column).alias("only"))
    open_ = rows.where(F.col(column).isNull()).select(key, F.col(group).alias("wanted")).join(known, F.col("wanted") == F.col("of"), "left")
    outcome = F.when(F.col("n") == 1, "FILLED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("NO_ISSUER")
    return open_.select(key, outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("only")).alias(column))


def backfill_dates(assignments: DataFrame, events: DataFrame) -> DataFrame:
    """(assignment_id, outcome, legal_from): the date of the start event where the assignment has none."""
    a = assignments.select("assignment_id", "start_event_id", F.coalesce("valid_from", "legal_from").alias("dated"))
    e = events.select("event_id", "published_on")
    x = a.join(e, F.col("start_event_id") == F.col("event_id"), "left")
    outcome = F.when(F.col("dated").isNotNull(), "DATED").when(F.col("event_id").isNull(), "NO_EVENT").when(F.col("published_on").isNull(), "NO_DATE").otherwise("FILLED")
    return x.select("assignment_id", outcome.alias("outcome"), F.when(F.col("dated").isNull(), F.col("published_on")).alias("legal_from"))


def recount(said: DataFrame, key: str, column: str, rows: DataFrame) -> DataFrame:
    """(key, column, n, outcome): a stated number of rows against the rows there are."""
    n = rows.groupBy(F.col(key).alias("of")).agg(F.count(F.lit(1)).alias("n"))
    x = said.join(n, F.col(key) == F.col("of"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.select(key, column, "n", F.when(F.col(column) == F.col("n"), "SAME").otherwise("CORRECTED").alias("outcome"))
