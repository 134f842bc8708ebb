"""Review workflow: decisions are events, states are folds of them, reprocessing appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Actions that decide a task, that only add to it, and that need a note.
TERMINAL, OPEN, NOTED = ("ACCEPT", "REJECT"), ("COMMENT",), ("REJECT",)


def decided(decisions: DataFrame) -> DataFrame:
    """Adds `problem` to decisions (event_id, task_id, ts, action, note): null where the decision counts.

    Each row stands by itself: a wrong one is refused with its reason and leaves the
    others be. The first valid terminal action decides a task; what comes later
    finds it decided. Order is by time, then id; a task's decisions are few.
    """
    own = F.when(~F.coalesce(F.col("action").isin(*TERMINAL, *OPEN), F.lit(False)), "unknown action").when(F.col("action").isin(*NOTED) & F.col("note").isNull(), "note required")
    before = Window.partitionBy("task_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    x = decisions.withColumn("own", own)
    ends = (F.col("own").isNull() & F.col("action").isin(*TERMINAL)).cast("int")
    late = F.when(F.coalesce(F.sum(ends).over(before), F.lit(0)) > 0, "task is not pending")
    return x.withColumn("problem", F.coalesce("own", late)).drop("own")


def states(found: DataFrame) -> DataFrame:
    """(task_id, state, recorded, refused) of tasks from decisions with their problems; undecided ones are PENDING."""
    counts = F.col("problem").isNull()
    state = F.max(F.when(counts & F.col("action").isin(*TERMINAL), F.col("action")))
    return found.groupBy("task_id").agg(F.coalesce(state, F.lit("PENDING")).alias("state"), F.count(F.when(counts, 1)).alias("recorded"), F.count(F.when(~counts, 1)).alias("refused"))


def reprocessed(rows: DataFrame, key: str, document: str, run: str, natural: list[str]) -> DataFrame:
    """(key, status, carried) after a new run of documents, from rows with status and decided.

    Rows of older runs become SUPERSEDED unless a person rejected them; what a
    person decided on a row carries over to the newest run's row of the same
    document and natural key, compared with nulls as equal.
    """
    latest = rows.groupBy(F.col(document).alias("l_doc")).agg(F.max(run).alias("latest"))
    human = rows.where("decided is not null").groupBy(F.col(document).alias("d_doc"), *(F.col(c).alias(f"d_{c}") for c in natural)).agg(F.max("decided").alias("d_decided"))
    same = F.col(document) == F.col("d_doc")
    for c in natural:
        same = same & F.col(c).eqNullSafe(F.col(f"d_{c}"))
    x = rows.join(latest, F.col(document) == F.col("l_doc")).join(human, same, "left")
    now = F.col(run) == F.col("latest")
    status = F.when(now | (F.col("status") == "HUMAN_REJECTED"), F.col("status")).otherwise("SUPERSEDED")
    return x.select(key, status.alias("status"), F.when(now, F.coalesce("decided", "d_decided")).alias("carried"))
