"""Projection to quads (graph, subject, predicate, object, kind) and the constraints on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = "https://facts.example/"
ACCEPTED = ("AUTO_ACCEPTED", "HUMAN_ACCEPTED")


def quads(rows: DataFrame, graph: Column | str, subject: Column, values: dict[str, tuple[Column, str]]) -> DataFrame:
    """A quad for each non-null value of each row, in one pass: predicate -> (object, iri or literal)."""
    made = F.array(*(F.struct(F.lit(BASE + "o#" + p).alias("p"), v.cast("string").alias("o"), F.lit(k).alias("kind")) for p, (v, k) in values.items()))
    g = F.lit(BASE + "g/" + graph) if isinstance(graph, str) else graph
    return rows.select(g.alias("g"), subject.alias("s"), F.explode(made).alias("x")).select("g", "s", "x.p", "x.o", "x.kind").where("o is not null")


def iri(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{BASE}{kind}/"), key.cast("string"))


def _object() -> Column:
    """The object as N-Quads and TriG write it."""
    quoted = F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    return F.when(F.col("kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), quoted, F.lit('"')))


def statement(q: DataFrame) -> DataFrame:
    """The quads as lines of N-Quads in column value."""
    return q.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), _object(), F.lit(" <"), "g", F.lit("> .")).alias("value"))


def trig(q: DataFrame) -> DataFrame:
    """The quads as lines of TriG in column value, each a graph block of one triple, so that files can be split anywhere."""
    return q.select(F.concat(F.lit("<"), "g", F.lit("> { <"), "s", F.lit("> <"), "p", F.lit("> "), _object(), F.lit(" . }")).alias("value"))


def json_ld(q: DataFrame) -> DataFrame:
    """A node a subject: its id and the sorted values of each predicate, as JSON in column value."""
    by = q.groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("o"))
    node = by.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "o")))).alias("m"))
    return node.select("s", F.to_json(F.map_concat(F.create_map(F.lit("@id"), F.array("s")), "m")).alias("value"))


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, id) of every row a rule names as wrong."""
    out = None
    for name, wrong in rules.items():
        own = wrong.select(F.lit(name).alias("rule"), F.col(wrong.columns[0]).cast("string").alias("id"))
        out = own if out is None else out.unionByName(own)
    return out
