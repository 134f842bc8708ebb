"""Review workflow, repairs and the parts that composite questions are built of."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import normalize as N
from factloom.operators import identity, temporal
from factloom.plans import quads as Q
from factloom.plans.registry import query


@query("src_12_point_lookup", "SELECT m.mention_id, p.name FROM mention m JOIN person p ON p.person_id = m.person_id")
def _(t):
    return t.mention.select("mention_id", "person_id").join(t.person.select("person_id", "name"), "person_id").select("mention_id", "name")


@query("fn_05_variant_predicate", """
WITH x AS (SELECT a.person_id, string_split(a.name, ' ') AS s, string_split(b.name, ' ') AS t FROM person a JOIN person b ON b.person_id = a.person_id + 120)
SELECT person_id, len(s) >= 3 AND len(t) >= 3 AND s <> t AND s[-2:] = t[-2:] AND ((list_has_all(t[:len(t) - 2], s[:len(s) - 2]) AND NOT list_has_all(s[:len(s) - 2], t[:len(t) - 2])) OR (list_has_all(s[:len(s) - 2], t[:len(t) - 2]) AND NOT list_has_all(t[:len(t) - 2], s[:len(s) - 2]))) AS variant FROM x""")
def _(t):
    a, b = t.person.select("person_id", "name"), t.person.select((F.col("person_id") - 120).alias("person_id"), F.col("name").alias("other"))
    return a.join(b, "person_id").select("person_id", N.is_name_variant(N.tokens(F.col("name")), N.tokens(F.col("other"))).alias("variant"))


@query("ex_21_suggested_queries", "SELECT DISTINCT person_id, lower(q) AS q FROM (SELECT person_id, name AS q FROM person UNION ALL SELECT person_id, name || ' ' || role FROM mention WHERE person_id IS NOT NULL)")
def _(t):
    a = t.person.select("person_id", F.lower("name").alias("q"))
    b = t.mention.where("person_id is not null").select("person_id", F.lower(F.concat_ws(" ", "name", "role")).alias("q"))
    return a.unionByName(b).distinct()


@query("mut_08_manual_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'note required' WHEN o_orderkey % 4 = 1 THEN 'not a date' WHEN o_orderkey % 4 = 2 THEN 'rule decides' ELSE 'accepted' END AS outcome FROM orders")
def _(t):
    k = F.col("o_orderkey") % 4
    given = F.when(k == 1, "2026-02-31").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    note, decided = F.when(k != 0, F.lit("visto")), k == 2
    outcome = F.when(note.isNull(), "note required").when(F.try_to_date(given, "yyyy-MM-dd").isNull(), "not a date").when(decided, "rule decides").otherwise("accepted")
    return t.orders.select("o_orderkey", outcome.alias("outcome"))


@query("mut_11_corroborating_links", "SELECT event_id, document_id, 'CORROBORATING' AS role FROM event WHERE authority <> 'OFFICIAL_GAZETTE'")
def _(t):
    return t.event.where("authority <> 'OFFICIAL_GAZETTE'").select("event_id", "document_id", F.lit("CORROBORATING").alias("role"))


@query("rdf_02_mention_quads", "SELECT 'https://facts.example/g/candidate' AS g, 'https://facts.example/mention/' || mention_id AS s, 'https://facts.example/o#' || p AS p, o, kind FROM (SELECT mention_id, 'name' AS p, name AS o, 'literal' AS kind FROM mention UNION ALL SELECT mention_id, 'resolvedTo', 'https://facts.example/person/' || person_id, 'iri' FROM mention) WHERE o IS NOT NULL")
def _(t):
    person = F.when(F.col("person_id").isNotNull(), Q.iri("person", F.col("person_id")))
    return Q.quads(t.mention, "candidate", Q.iri("mention", F.col("mention_id")), {"name": (F.col("name"), "literal"), "resolvedTo": (person, "iri")})


@query("rm_01_scored_candidates", "SELECT DISTINCT m.mention_id, p.person_id, CAST(0.8 AS DOUBLE) AS score FROM mention m JOIN person p ON p.name = m.name WHERE p.merged_into IS NULL")
def _(t):
    return identity.by_name(t.mention, t.person.where("merged_into is null")).withColumn("score", F.lit(0.8))


@query("rm_05_dated_with_evidence", "SELECT e.event_id, e.published_on FROM event e WHERE e.published_on IS NOT NULL AND e.document_id IN (SELECT document_id FROM section WHERE text LIKE '%publicación%')")
def _(t):
    proof = t.section.where(F.col("text").contains("publicación")).select(F.col("document_id")).distinct()
    return t.event.where("published_on is not null").join(proof, "document_id", "left_semi").select("event_id", "published_on")


@query("rm_08_web_entries", "SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS pages FROM pages GROUP BY 1")
def _(t):
    return t.pages.groupBy(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


@query("rm_10_alias_order", "SELECT person_id, name, min(rnk) AS rnk FROM (SELECT person_id, name, 0 AS rnk FROM person UNION ALL SELECT person_id, name, 1 FROM mention WHERE person_id IS NOT NULL) GROUP BY 1, 2")
def _(t):
    a = t.person.select("person_id", "name", F.lit(0).alias("rnk"))
    b = t.mention.where("person_id is not null").select("person_id", "name", F.lit(1).alias("rnk"))
    return a.unionByName(b).groupBy("person_id", "name").agg(F.min("rnk").alias("rnk"))


@query("rm_12_linked_person", "SELECT document_id, min(person_id) AS person_id FROM mention WHERE person_id IS NOT NULL GROUP BY 1")
def _(t):
    return t.mention.where("person_id is not null").groupBy("document_id").agg(F.min("person_id").alias("person_id"))


@query("rm_15_pending_by_discovery", "SELECT item_id, started_at FROM run_item WHERE status IN ('RETRY_PENDING', 'FAILED')")
def _(t):
    return t.run_item.where(F.col("status").isin("RETRY_PENDING", "FAILED")).select("item_id", "started_at")


@query("rm_16_has_document", "SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AS has_document FROM orders")
def _(t):
    d = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("hit")).distinct()
    return t.orders.select("o_orderkey").join(d, "o_orderkey", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("has_document"))


@query("rm_18_missing_sources", "SELECT DISTINCT document_id FROM event WHERE document_id NOT IN (SELECT document_id FROM event WHERE authority = 'OFFICIAL_GAZETTE' AND event_type = 'DESIGNATION')")
def _(t):
    have = t.event.where("authority = 'OFFICIAL_GAZETTE' and event_type = 'DESIGNATION'").select("document_id")
    return t.event.select("document_id").distinct().join(have, "document_id", "left_anti")


@query("rm_19_latest_verdict", "SELECT user_id, arg_max(event_type IN ('purchase', 'click'), ROW(ts, event_id)) AS accepted FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by(F.col("event_type").isin("purchase", "click"), F.struct("ts", "event_id")).alias("accepted"))


@query("rm_21_catalog_row", "SELECT a.org_id, min(b.org_id) AS row_id FROM org a JOIN org b ON b.name = a.name GROUP BY 1")
def _(t):
    return t.org.select("org_id", "name").join(t.org.groupBy("name").agg(F.min("org_id").alias("row_id")), "name").select("org_id", "row_id")


@query("rm_23_applicable_actions", "SELECT e.event_id, a.action FROM event e CROSS JOIN (VALUES ('ACCEPT'), ('REJECT'), ('SET_DATE')) AS a(action) WHERE NOT (a.action = 'SET_DATE' AND e.stated = 'EXPLICIT')")
def _(t):
    actions = F.when(F.col("stated") == "EXPLICIT", F.array(F.lit("ACCEPT"), F.lit("REJECT"))).otherwise(F.array(F.lit("ACCEPT"), F.lit("REJECT"), F.lit("SET_DATE")))
    return t.event.select("event_id", F.explode(actions).alias("action"))


@query("rm_25_preview_kind", "SELECT page_id, CASE WHEN url LIKE '%.pdf' THEN 'pdf' WHEN url LIKE '%.png' THEN 'image' ELSE 'html' END AS kind FROM pages")
def _(t):
    u = F.col("url")
    return t.pages.select("page_id", F.when(u.endswith(".pdf"), "pdf").when(u.endswith(".png"), "image").otherwise("html").alias("kind"))


@query("rm_27_event_detail", "SELECT e.event_id, e.event_type, count(p.person_id) AS participants FROM event e LEFT JOIN participant p ON p.event_id = e.event_id WHERE e.document_id = 7 GROUP BY 1, 2")
def _(t):
    p = t.participant.groupBy("event_id").agg(F.count("person_id").alias("participants"))
    return t.event.where("document_id = 7").select("event_id", "event_type").join(p, "event_id", "left").select("event_id", "event_type", F.coalesce("participants", F.lit(0)).alias("participants"))


@query("assignments_of_person", "SELECT person_id, list(assignment_id ORDER BY recorded_at, assignment_id) AS ids FROM assignment WHERE superseded_at IS NULL GROUP BY 1")
def _(t):
    return temporal.live(t.assignment).groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("recorded_at", "assignment_id"))), lambda x: x["assignment_id"]).alias("ids"))
