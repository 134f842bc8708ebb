"""Claims held against what the source says, word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTE = 15


def verify(claims: DataFrame, vocabulary: tuple[str, ...], reserved: tuple[str, ...] = ()) -> DataFrame:
    """Adds outcome and paragraph to claims (predicate, quote, paragraphs, ...).

    A claim is verified only if its predicate is listed and not reserved for the
    rules, and its quote of QUOTE characters or more stands literally in a
    paragraph; paragraph is the first such place, from 0. A null quote is short.
    """
    quote = F.coalesce("quote", F.lit(""))
    place = F.array_position(F.transform("paragraphs", lambda p: p.contains(quote)), True).cast("int") - 1
    outcome = (
        F.when(F.col("predicate").isin(*reserved), "reserved predicate")
        .when(~F.coalesce(F.col("predicate").isin(*vocabulary), F.lit(False)), "unknown predicate")
        .when(F.length(quote) < QUOTE, "short quote")
        .when(F.coalesce(place, F.lit(-1)) < 0, "not literal")
        .otherwise("verified")
    )
    return claims.withColumn("outcome", outcome).withColumn("paragraph", F.when(F.col("outcome") == "verified", place))


def highlight_state(section: Column, quote: Column, char_start: Column) -> Column:
    """Whether a quote still stands where it was found: intact, shifted to another place, or altered."""
    there = F.substr(section, char_start + 1, F.length(quote)) == quote
    return F.when(there, "intact").when(section.contains(quote), "shifted").otherwise("altered")


def recital_matches(ended: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each candidate of an ended event with whether its post is the one that ended.

    ended: (event_id, label, cited); candidates: (event_id, person_id, label, cited_number).
    """
    c = candidates.select("event_id", "person_id", F.col("label").alias("recital_label"), "cited_number")
    return ended.join(c, "event_id").withColumn("same_position", F.col("recital_label").eqNullSafe(F.col("label")))


def recital_verdict(ended: DataFrame, candidates: DataFrame) -> DataFrame:
    """(event_id, verdict) of every ended event.

    No candidate leaves it UNCONFIRMED, several are a CONFLICT, another or no post
    confirms nothing, an instrument that the article does not cite is a CONFLICT.
    """
    c = candidates.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("recital_label"), F.min("cited_number").alias("cited_number"))
    other = F.col("cited_number").isNotNull() & ~F.array_contains("cited", F.col("cited_number"))
    verdict = (
        F.when(F.col("n").isNull(), "UNCONFIRMED")
        .when(F.col("n") > 1, "CONFLICT")
        .when(~F.col("recital_label").eqNullSafe(F.col("label")), "UNCONFIRMED")
        .when(other, "CONFLICT")
        .otherwise("CORROBORATED")
    )
    return ended.join(c, "event_id", "left").withColumn("verdict", verdict)
