"""Entity resolution of arriving mentions, where earlier mentions make the persons later ones meet.

A mention links to a person by a shared identifier, or by the same name in the
same singular office; never by the name alone. Signals that point at different
persons link nothing (CONFLICT). Mentions that share no signal, over any number
of steps, never affect each other, so each connected component is walked in
order by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import normalize as N
from factloom.operators.lineage import saved

OUT = "mention_id long, outcome string, person_id long, signal string"


def signals(mentions: DataFrame) -> DataFrame:
    """(mention_id, seq, key) of (mention_id, seq, name, label, scheme, value): a row for each signal of a mention."""
    ident, office = N.identifier(F.col("value")), N.singular_office(N.position_label(F.col("label")))
    keys = F.array(F.when(ident != "", F.concat(F.lit("i|"), "scheme", F.lit("|"), ident)), F.when(office.isNotNull(), F.concat(F.lit("o|"), N.person_name(F.col("name")), F.lit("|"), office)))
    return mentions.select("mention_id", "seq", F.explode_outer(F.filter(keys, lambda k: k.isNotNull())).alias("key"))


def components(rows: DataFrame, rounds: int = 30) -> DataFrame:
    """(mention_id, component): the least mention reachable over shared keys, by rounds until nothing moves."""
    pairs = saved(rows.where("key is not null").select("mention_id", "key").distinct())
    cur = saved(rows.select("mention_id", F.col("mention_id").alias("component")).distinct())
    for _ in range(rounds):
        least = pairs.join(cur, "mention_id").groupBy("key").agg(F.min("component").alias("least"))
        best = pairs.join(least, "key").groupBy("mention_id").agg(F.min("least").alias("least"))
        nxt = cur.join(best, "mention_id", "left").select("mention_id", F.coalesce("least", "component").alias("found"), "component")
        jump = nxt.select(F.col("mention_id").alias("_m"), F.col("found").alias("_f"))
        nxt = saved(nxt.join(jump, F.col("found") == F.col("_m"), "left").select("mention_id", F.least("found", "_f").alias("component"), (F.least("found", "_f") != F.col("component")).alias("moved")))
        cur = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    return cur


def resolve(mentions: DataFrame) -> DataFrame:
    """(mention_id, outcome, person_id, signal): NEW persons carry the id of their first mention.

    seq orders the mentions, ties by mention_id. A mention without a signal is a
    new person. One component's rows are in memory at a time.
    """
    import pandas as pd

    rows = saved(signals(mentions))
    placed = rows.join(components(rows), "mention_id")
    dealt = placed.repartition("component").sortWithinPartitions("component", "seq", "mention_id", "key")

    def walk(held: list) -> list:
        owner, out, at = {}, [], 0
        while at < len(held):
            m, keys = held[at].mention_id, []
            while at < len(held) and held[at].mention_id == m:
                if held[at].key is not None:
                    keys.append(held[at].key)
                at += 1
            targets = {owner[k] for k in keys if k in owner}
            if len(targets) > 1:
                out.append((m, "CONFLICT", None, None))
                continue
            person = next(iter(targets), m)
            how = next((n for p, n in (("i|", "identifier"), ("o|", "office")) if any(k.startswith(p) and k in owner for k in keys)), None)
            out.append((m, "LINKED" if targets else "NEW", person, how))
            for k in keys:
                owner.setdefault(k, person)
        return out

    def run(batches):
        component, held = None, []
        for pdf in batches:
            done = []
            for r in pdf.itertuples():
                if held and r.component != component:
                    done += walk(held)
                    held = []
                component = r.component
                held.append(r)
            yield framed(done)
        yield framed(walk(held))

    def framed(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["mention_id", "outcome", "person_id", "signal"]).astype({"person_id": "Int64"})

    return dealt.mapInPandas(run, OUT)
