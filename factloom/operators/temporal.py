"""Valid-time and legal-time operators over assignments.

Rows have: assignment_id, position_id, person_id, label, valid_from, valid_to
(stated dates), legal_from, legal_to (dates a norm gives), superseded_at,
recorded_at, start_event_id, end_event_id. Intervals are closed at both ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("superseded_at").isNull())


def effective(stated: str, legal: str, out: str) -> list[Column]:
    """The date that counts and where it comes from: the source first, then the norm."""
    s, g = F.col(stated), F.col(legal)
    return [F.coalesce(s, g).alias(out), F.when(s.isNotNull(), "source").when(g.isNotNull(), "legal_rule").alias(f"{out}_basis")]


def with_effective(rows: DataFrame) -> DataFrame:
    return rows.select("*", *effective("valid_from", "legal_from", "eff_start"), *effective("valid_to", "legal_to", "eff_end"))


def may_cover(start: Column, end: Column, on: Column) -> Column:
    """Not ruled out on a date: unknown ends pass."""
    return ~F.coalesce(start > on, F.lit(False)) & ~F.coalesce(end < on, F.lit(False))


def covers(start: Column, end: Column, on: Column) -> Column:
    """In force on a date: an unknown start does not, an unknown end does."""
    return F.coalesce(start <= on, F.lit(False)) & (end.isNull() | (end >= on))


def holder_decision(assignments: DataFrame, questions: DataFrame) -> DataFrame:
    """Who held a position on a date, for every question (position_id, on_date).

    no_data without an assignment, confirmed with covering ones of known start
    and no uncertain one (the last recorded wins), vacant where dates rule all
    out, else unresolved. Positions meet questions by an equi-join, and each
    question is one aggregation with partial sums; a supporting row is never
    collected.
    """
    a = with_effective(live(assignments)).select("position_id", "assignment_id", "person_id", "recorded_at", "eff_start", "eff_end", "eff_start_basis", "eff_end_basis")
    q = questions.select(F.col("position_id").alias("q_position"), "on_date").distinct()
    x = q.join(a, q["q_position"] == a["position_id"], "left")
    open_ = F.col("assignment_id").isNotNull() & may_cover(F.col("eff_start"), F.col("eff_end"), F.col("on_date"))
    sure = open_ & F.col("eff_start").isNotNull()
    by_law = (F.coalesce(F.col("eff_start_basis") == "legal_rule", F.lit(False))) | (F.coalesce(F.col("eff_end_basis") == "legal_rule", F.lit(False)))
    counted = x.groupBy("q_position", "on_date").agg(
        F.count("assignment_id").alias("n"),
        F.sum(sure.cast("long")).alias("n_sure"),
        F.sum((open_ & ~sure).cast("long")).alias("n_open"),
        F.max(F.when(sure, F.struct("recorded_at", "assignment_id", "person_id"))).alias("last"),
        F.max((sure & by_law).cast("int")).alias("sure_law"),
        F.max(by_law.cast("int")).alias("any_law"),
    )
    status = F.when(F.col("n") == 0, "no_data").when((F.col("n_sure") > 0) & (F.col("n_open") == 0), "confirmed").when((F.col("n_sure") == 0) & (F.col("n_open") == 0), "vacant").otherwise("unresolved")
    law = F.when(status == "confirmed", F.col("sure_law")).when(status == "vacant", F.col("any_law"))
    return counted.select(
        F.col("q_position").alias("position_id"),
        "on_date",
        status.alias("status"),
        F.when(status == "confirmed", F.col("last.assignment_id")).alias("assignment_id"),
        F.when(status == "confirmed", F.col("last.person_id")).alias("person_id"),
        F.when(law == 1, "legal_rule").when(law == 0, "source").alias("basis"),
    )


def covering_pairs(assignments: DataFrame, dates: DataFrame) -> DataFrame:
    """(assignment_id, on_date) where the assignment may be in force, by an equi-join on months.

    Intervals are closed and an unknown end passes, so it reaches as far as the
    dates do. Intervals enter every month they touch, dates enter theirs, so no
    row meets every date.
    """
    asked = dates.select("on_date").where("on_date is not null").distinct()
    reach = asked.agg(F.min("on_date").alias("first"), F.max("on_date").alias("last"))
    a = with_effective(live(assignments)).select("assignment_id", "eff_start", "eff_end").crossJoin(F.broadcast(reach))
    a = a.select("assignment_id", F.greatest("eff_start", "first").alias("low"), F.least("eff_end", "last").alias("high")).where("low <= high")
    month = F.explode(F.sequence(F.trunc("low", "month"), F.trunc("high", "month"), F.expr("interval 1 month"))).alias("month")
    a = a.select("assignment_id", "low", "high", month)
    d = asked.select("on_date", F.trunc("on_date", "month").alias("month"))
    return a.join(d, "month").where("on_date between low and high").select("assignment_id", "on_date")


def pair_periods(assignments: DataFrame) -> DataFrame:
    """Joins a start and an end of the same post into one period where only one start fits.

    (person_id, label, start_id, end_id): ends in order of recording take the one
    unused start that no organisation, position or date contradicts; none or
    several leave the end alone. The order decides, so each (person, label) is
    walked by itself, in one sorted pass over its partition; only rows that are a
    bare start or a bare end are walked. Rows without a person are left out.
    """
    import pandas as pd

    a = with_effective(live(assignments))
    bare = a.where("(start_event_id is not null and end_event_id is null and eff_end is null) or (end_event_id is not null and start_event_id is null)")
    other = a.join(bare.select("assignment_id"), "assignment_id", "left_anti")

    def walk(rows: list) -> list:
        starts = [r for r in rows if pd.notna(r.start_event_id)]
        used, out = set(), []
        for e in rows:
            if pd.notna(e.start_event_id):
                continue
            fits = [s for s in starts if s.assignment_id not in used and agrees(s, e)]
            if len(fits) == 1:
                used.add(fits[0].assignment_id)
            out.append((e.person_id, e.label, fits[0].assignment_id if len(fits) == 1 else None, e.assignment_id))
        return out + [(s.person_id, s.label, s.assignment_id, None) for s in starts if s.assignment_id not in used]

    def walk_all(batches):
        """Rows come sorted by key; the rows of one key at a time are held."""
        key, held = None, []
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if held and (r.person_id, r.label) != key:
                    out += walk(held)
                    held = []
                key = (r.person_id, r.label)
                held.append(r)
            yield framed(out)
        yield framed(walk(held))

    def framed(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["person_id", "label", "start_id", "end_id"]).astype({"start_id": "Int64", "end_id": "Int64"})

    def agrees(s, e) -> bool:
        for name in ("position_id", "organization_id"):
            x, y = getattr(s, name), getattr(e, name)
            if pd.notna(x) and pd.notna(y) and x != y:
                return False
        return pd.isna(s.eff_start) or pd.isna(e.eff_end) or s.eff_start <= e.eff_end

    cols = ["assignment_id", "person_id", "label", "position_id", "organization_id", "recorded_at", "start_event_id", "end_event_id", "eff_start", "eff_end"]
    dealt = bare.where("person_id is not null").select(*cols).repartition("person_id", "label").sortWithinPartitions("person_id", "label", "recorded_at", "assignment_id")
    paired = dealt.mapInPandas(walk_all, "person_id long, label string, start_id long, end_id long")
    return paired.unionByName(other.select("person_id", "label", F.col("assignment_id").alias("start_id"), F.lit(None).cast("long").alias("end_id")))


def project_legal_dates(assignments: DataFrame, events: DataFrame) -> DataFrame:
    """Legal dates on assignments whose own date is not stated: an END event gives the end, any other the start.

    events: (event_id, effect, legal_date).
    """
    starts = events.where("effect <> 'END'").select(F.col("event_id").alias("start_event_id"), F.col("legal_date").alias("rule_from"))
    ends = events.where("effect = 'END'").select(F.col("event_id").alias("end_event_id"), F.col("legal_date").alias("rule_to"))
    x = assignments.join(starts, "start_event_id", "left").join(ends, "end_event_id", "left")
    return x.select("assignment_id", F.when(F.col("valid_from").isNull(), F.col("rule_from")).alias("legal_from"), F.when(F.col("valid_to").isNull(), F.col("rule_to")).alias("legal_to"))
