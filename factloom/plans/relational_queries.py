"""Joins, aggregations, windows, sets, chains, versions, quads and constraints over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import normalize as N
from factloom.operators import closure, identity, relational, temporal, versioning
from factloom.plans.registry import query

HOLDER_SQL = """
WITH a AS (
  SELECT position_id, assignment_id, person_id, recorded_at, coalesce(valid_from, legal_from) AS s, coalesce(valid_to, legal_to) AS e,
    (valid_from IS NULL AND legal_from IS NOT NULL) OR (valid_to IS NULL AND legal_to IS NOT NULL) AS law FROM assignment WHERE superseded_at IS NULL
), x AS (
  SELECT q.position_id, q.on_date, a.assignment_id, a.person_id, a.recorded_at, a.law,
    a.assignment_id IS NOT NULL AND NOT coalesce(s > on_date, false) AND NOT coalesce(e < on_date, false) AS open, s IS NOT NULL AS known
  FROM question q LEFT JOIN a ON a.position_id = q.position_id
), g AS (
  SELECT position_id, on_date, count(assignment_id) AS n, count(*) FILTER (open AND known) AS sure, count(*) FILTER (open AND NOT known) AS unsure,
    arg_max(assignment_id, ROW(recorded_at, assignment_id)) FILTER (open AND known) AS a_id, arg_max(person_id, ROW(recorded_at, assignment_id)) FILTER (open AND known) AS p_id,
    coalesce(bool_or(law) FILTER (open AND known), false) AS sure_law, coalesce(bool_or(law), false) AS any_law
  FROM x GROUP BY ALL
), d AS (
  SELECT *, CASE WHEN n = 0 THEN 'no_data' WHEN sure > 0 AND unsure = 0 THEN 'confirmed' WHEN sure = 0 AND unsure = 0 THEN 'vacant' ELSE 'unresolved' END AS status FROM g
)
SELECT position_id, on_date, status, CASE WHEN status = 'confirmed' THEN a_id END AS assignment_id, CASE WHEN status = 'confirmed' THEN p_id END AS person_id,
  CASE WHEN status = 'confirmed' THEN CASE WHEN sure_law THEN 'legal_rule' ELSE 'source' END WHEN status = 'vacant' THEN CASE WHEN any_law THEN 'legal_rule' ELSE 'source' END END AS basis
FROM d"""


@query("q_08_holder_decision", HOLDER_SQL)
def _(t):
    return temporal.holder_decision(t.assignment, t.question)


@query("ag_08_holder_status_counts", f"SELECT on_date, status, count(*) AS n FROM ({HOLDER_SQL}) h GROUP BY ALL".replace("SELECT on_date, status, count(*) AS n FROM (", "SELECT on_date, status, count(*) AS n FROM (", 1))
def _(t):
    return temporal.holder_decision(t.assignment, t.question).groupBy("on_date", "status").agg(F.count(F.lit(1)).alias("n"))


@query("jn_14_interval_join", """
SELECT assignment_id, on_date FROM (SELECT assignment_id, coalesce(valid_from, legal_from) AS s, coalesce(valid_to, legal_to) AS e FROM assignment WHERE superseded_at IS NULL) a
JOIN (SELECT DISTINCT on_date FROM question) d ON NOT coalesce(s > on_date, false) AND NOT coalesce(e < on_date, false)""")
def _(t):
    return temporal.covering_pairs(t.assignment, t.question)


@query("wn_04_period_pairing")
def _(t):
    return temporal.pair_periods(t.assignment)


@query("rm_04_project_legal_dates", """
SELECT a.assignment_id, CASE WHEN valid_from IS NULL THEN s.published_on END AS legal_from, CASE WHEN valid_to IS NULL THEN e.published_on END AS legal_to FROM assignment a
LEFT JOIN event s ON s.event_id = a.start_event_id AND s.effect <> 'END' LEFT JOIN event e ON e.event_id = a.end_event_id AND e.effect = 'END'""")
def _(t):
    return temporal.project_legal_dates(t.assignment, t.event.select("event_id", "effect", F.col("published_on").alias("legal_date")))


# Joins


@query("jn_01_name_candidates", "SELECT DISTINCT m.mention_id, p.person_id FROM mention m JOIN person p ON p.name = m.name WHERE p.merged_into IS NULL")
def _(t):
    return identity.by_name(t.mention, t.person.where("merged_into is null"))


@query("jn_02_identifier_join", r"""
SELECT DISTINCT a.mention_id, b.person_id FROM (SELECT mention_id, scheme, upper(regexp_replace(value, '[\s.\-]', '', 'g')) AS v FROM mention) a
JOIN (SELECT person_id, scheme, upper(regexp_replace(value, '[\s.\-]', '', 'g')) AS v FROM mention WHERE person_id IS NOT NULL) b ON a.scheme = b.scheme AND a.v = b.v""")
def _(t):
    m = t.mention
    return identity.by_identifier(m, m.where("person_id is not null"))


@query("jn_03_four_way_join", "SELECT l.l_orderkey, l.l_linenumber, n.n_name, r.r_name FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey WHERE l.l_discount = 0")
def _(t):
    li = t.lineitem.where("l_discount = 0").select("l_orderkey", "l_linenumber", "l_suppkey")
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    return li.join(s, "l_suppkey").join(t.nation, "n_nationkey").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("l_orderkey", "l_linenumber", "n_name", "r_name")


@query("jn_04_either_key_join", "SELECT DISTINCT e.event_id, a.assignment_id, e.event_type FROM event e JOIN assignment a ON a.start_event_id = e.event_id OR a.end_event_id = e.event_id")
def _(t):
    return relational.either_key_join(t.assignment, t.event, "start_event_id", "end_event_id", "event_id").select("event_id", "assignment_id", "event_type")


@query("jn_05_left_lookup", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'")
def _(t):
    c = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t.orders.join(c, "o_custkey", "left").select("o_orderkey", "c_name")


HOLD = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT user_id FROM events WHERE event_type = 'purchase'"


@query("jn_06_referenced", f"SELECT c_custkey FROM customer WHERE c_custkey IN ({HOLD})")
def _(t):
    return relational.referenced(t.customer.select("c_custkey"), "c_custkey", [(t.orders.where("o_orderstatus = 'F'"), "o_custkey"), (t.events.where("event_type = 'purchase'"), "user_id")])


@query("jn_07_orphans", f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN ({HOLD})")
def _(t):
    return relational.referenced(t.customer.select("c_custkey"), "c_custkey", [(t.orders.where("o_orderstatus = 'F'"), "o_custkey"), (t.events.where("event_type = 'purchase'"), "user_id")], False)


@query("jn_08_without_events", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def _(t):
    return t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("jn_09_unplaced_persons", """
SELECT m.person_id, count(*) AS mentions FROM mention m WHERE m.person_id IS NOT NULL AND m.person_id NOT IN (SELECT person_id FROM assignment WHERE superseded_at IS NULL) AND m.person_id NOT IN (SELECT person_id FROM participant) GROUP BY 1""")
def _(t):
    m = t.mention.where("person_id is not null").groupBy("person_id").agg(F.count(F.lit(1)).alias("mentions"))
    return m.join(temporal.live(t.assignment), "person_id", "left_anti").join(t.participant, "person_id", "left_anti")


@query("jn_10_relevant_but_empty", "SELECT o.o_orderkey, 0 AS n FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_quantity > 40 WHERE o.o_orderstatus = 'O' GROUP BY 1 HAVING count(l.l_orderkey) = 0")
def _(t):
    n = t.lineitem.where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    x = t.orders.where("o_orderstatus = 'O'").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).cast("int").alias("n"))
    return x.where("n = 0")


@query("jn_11_containing_names", """
SELECT DISTINCT a.name AS probe, b.name FROM org a JOIN org b ON a.name <> b.name AND length(a.name) >= 12 AND (strpos(a.name, b.name) > 0 OR strpos(b.name, a.name) > 0)""")
def _(t):
    return identity.containing_names(t.org, t.org)


VARIANT_SQL = """
WITH p AS (SELECT DISTINCT name, string_split(name, ' ') AS t FROM person), q AS (SELECT name, t, t[-2:] AS last, t[:len(t) - 2] AS given FROM p WHERE len(t) >= 3)
SELECT a.name AS name_a, b.name AS name_b FROM q a JOIN q b ON a.last = b.last AND a.name < b.name
WHERE (list_has_all(b.given, a.given) AND NOT list_has_all(a.given, b.given)) OR (list_has_all(a.given, b.given) AND NOT list_has_all(b.given, a.given))"""


@query("jn_12_name_variants", VARIANT_SQL)
def _(t):
    return identity.name_variants(t.person)


@query("jn_13_short_forms")
def _(t):
    runs = t.sql("SELECT DISTINCT split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 3) AS run FROM person")
    return identity.short_forms(runs, t.person)


@query("jn_15_same_office", f"""
WITH o AS (SELECT item_id AS mention_id, office, 'N' || CAST(item_id % 50 AS VARCHAR) AS name FROM (
  SELECT item_id, CASE item_id % 12 WHEN 0 THEN 'MINISTERIO::PRODUCCION' WHEN 1 THEN 'PRESIDENCIA_DE_LA_REPUBLICA' WHEN 4 THEN 'MINISTERIO::INTERIOR' WHEN 5 THEN 'DEFENSORIA_DEL_PUEBLO' WHEN 7 THEN 'PRESIDENCIA_DEL_CONSEJO_DE_MINISTROS' WHEN 8 THEN 'FISCALIA_DE_LA_NACION' WHEN 9 THEN 'CONTRALORIA_GENERAL' END AS office FROM label))
SELECT DISTINCT a.mention_id, b.mention_id % 200 AS person_id FROM o a JOIN o b ON a.name = b.name AND a.office = b.office""")
def _(t):
    # a label is normalised once, however many rows have it
    known = t.label.select("label").distinct().select("label", N.position_label(F.col("label")).alias("normal"))
    x = t.label.join(known, "label").select(F.col("item_id").alias("mention_id"), F.col("normal").alias("label"), F.concat(F.lit("N"), (F.col("item_id") % 50).cast("string")).alias("name"))
    return identity.same_office(x, x.select((F.col("mention_id") % 200).alias("person_id"), "name", "label"))


PRECEDENT_SQL = """
SELECT m.mention_id, min(p.person_id) AS person_id, arg_min(p.precedent_id, ROW(p.role IS NULL, p.created_at, p.precedent_id)) AS precedent_id
FROM mention m JOIN precedent p ON p.name = m.name AND (p.role IS NULL OR p.role = m.role) WHERE p.revoked_at IS NULL GROUP BY 1 HAVING count(DISTINCT p.person_id) = 1"""


@query("jn_16_precedents", PRECEDENT_SQL)
def _(t):
    return identity.by_precedent(t.mention, t.precedent)


@query("jn_17_null_safe_lookup", "SELECT a.assignment_id, count(*) AS n FROM assignment a JOIN (SELECT DISTINCT position_id, organization_id FROM assignment) b ON a.position_id = b.position_id AND a.organization_id IS NOT DISTINCT FROM b.organization_id GROUP BY 1")
def _(t):
    a = t.assignment.select("assignment_id", "position_id", "organization_id")
    b = a.select(F.col("position_id").alias("p2"), F.col("organization_id").alias("o2")).distinct()
    return a.join(b, (F.col("position_id") == F.col("p2")) & F.col("organization_id").eqNullSafe(F.col("o2"))).groupBy("assignment_id").agg(F.count(F.lit(1)).alias("n"))


@query("jn_18_catalog_spelling", """
WITH s AS (SELECT r_regionkey AS entity, r_name AS spelling, true AS current FROM region UNION ALL SELECT r_regionkey, r_name || '–' || substr(r_name, 1, 2), true FROM region UNION ALL SELECT r_regionkey, substr(r_name, 1, 2), false FROM region)
SELECT n.n_nationkey, s.entity, s.current FROM (SELECT n_nationkey, n_regionkey, CASE n_nationkey % 4 WHEN 0 THEN r_name WHEN 1 THEN r_name || '–' || substr(r_name, 1, 2) WHEN 2 THEN substr(r_name, 1, 2) ELSE 'X' END AS name FROM nation JOIN region ON r_regionkey = n_regionkey) n LEFT JOIN s ON s.spelling = n.name""")
def _(t):
    short = F.substring("r_name", 1, 2)
    s = t.region.select(F.col("r_regionkey").alias("entity"), F.inline(F.array(F.struct(F.col("r_name").alias("spelling"), F.lit(True).alias("current")), F.struct(F.concat("r_name", F.lit("–"), short).alias("spelling"), F.lit(True).alias("current")), F.struct(short.alias("spelling"), F.lit(False).alias("current")))))
    k = F.col("n_nationkey") % 4
    n = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", F.when(k == 0, F.col("r_name")).when(k == 1, F.concat("r_name", F.lit("–"), short)).when(k == 2, short).otherwise("X").alias("spelling"))
    return n.join(s, "spelling", "left").select("n_nationkey", "entity", "current")


@query("jn_19_only_match", "SELECT c.c_custkey, CASE WHEN g.n = 1 THEN g.only END AS s_suppkey FROM customer c LEFT JOIN (SELECT s_nationkey, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS only FROM supplier GROUP BY 1) g ON g.s_nationkey = c.c_nationkey")
def _(t):
    return relational.only_match(t.customer.withColumnRenamed("c_nationkey", "s_nationkey"), t.supplier, ["s_nationkey"], ["c_custkey"], "s_suppkey")


@query("jn_20_latest_issuer", "SELECT user_id, arg_max(event_type, ROW(ts, event_id)) AS issuer FROM events WHERE value > 5 GROUP BY 1")
def _(t):
    return t.events.where("value > 5").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("issuer"))


@query("jn_21_issue_link", "SELECT e.event_id, i.issue_id, CASE WHEN e.published_on IS NULL THEN 'no date' WHEN i.issue_id IS NULL THEN 'no issue' ELSE 'linked' END AS reason FROM event e LEFT JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y%m%d') AS issue_id FROM orders WHERE o_orderkey % 3 = 0) i ON i.d = e.published_on")
def _(t):
    i = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderdate").cast("date").alias("published_on"), F.date_format("o_orderdate", "yyyyMMdd").alias("issue_id")).distinct()
    x = t.event.join(i, "published_on", "left")
    return x.select("event_id", "issue_id", F.when(F.col("published_on").isNull(), "no date").when(F.col("issue_id").isNull(), "no issue").otherwise("linked").alias("reason"))


@query("jn_22_official_publication", "SELECT document_id, arg_min(event_id, ROW(CASE authority WHEN 'OFFICIAL_GAZETTE' THEN 0 ELSE 1 END, event_id)) AS event_id FROM event GROUP BY 1")
def _(t):
    rank = F.struct(F.when(F.col("authority") == "OFFICIAL_GAZETTE", 0).otherwise(1), F.col("event_id"))
    return t.event.groupBy("document_id").agg(F.min_by("event_id", rank).alias("event_id"))


@query("jn_23_parent_article", "SELECT document_id, order_index, max(CASE WHEN kind = 'ARTICLE' THEN order_index END) OVER (PARTITION BY document_id ORDER BY order_index ROWS UNBOUNDED PRECEDING) AS article FROM (SELECT DISTINCT document_id, order_index, kind FROM section)")
def _(t):
    w = Window.partitionBy("document_id").orderBy("order_index").rowsBetween(Window.unboundedPreceding, 0)
    return t.section.select("document_id", "order_index", "kind").distinct().select("document_id", "order_index", F.last(F.when(F.col("kind") == "ARTICLE", F.col("order_index")), True).over(w).alias("article"))


@query("jn_24_reasoned_candidates", """
SELECT c_custkey, string_agg(reason, ',' ORDER BY reason) AS reasons FROM (
  SELECT DISTINCT o_custkey AS c_custkey, 'order' AS reason FROM orders WHERE o_orderstatus = 'P' UNION SELECT DISTINCT user_id, 'event' FROM events WHERE value > 20 UNION SELECT c_custkey, 'segment' FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""")
def _(t):
    parts = [(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "order"), (t.events.where("value > 20").select(F.col("user_id").alias("c_custkey")), "event"), (t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey"), "segment")]
    x = None
    for f, r in parts:
        own = f.select("c_custkey", F.lit(r).alias("reason")).distinct()
        x = own if x is None else x.unionByName(own)
    return x.groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@query("ag_01_homonyms", "SELECT name, count(DISTINCT person_id) AS persons FROM person WHERE merged_into IS NULL GROUP BY 1")
def _(t):
    return t.person.where("merged_into is null").groupBy("name").agg(F.countDistinct("person_id").alias("persons"))


@query("ag_02_events_per_publication", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1")
def _(t):
    n = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.orders.select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("ag_03_run_status", "SELECT run_id, count(*) AS n, count(*) FILTER (status = 'FAILED') AS n_failed, count(*) FILTER (status = 'RETRY_PENDING') AS n_retry, CASE WHEN count(*) FILTER (status IN ('FAILED', 'RETRY_PENDING')) > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS run_status FROM run_item GROUP BY 1")
def _(t):
    return relational.status_of_run(t.run_item, "run_id", "status")


@query("ag_04_alias_table", "SELECT name, count(*) AS mentions, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, bool_or(person_id IS NOT NULL) AS confirmed FROM mention GROUP BY 1")
def _(t):
    return t.mention.groupBy("name").agg(F.count(F.lit(1)).alias("mentions"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.bool_or(F.col("person_id").isNotNull()).alias("confirmed"))


@query("ag_05_distinct_aliases", "SELECT DISTINCT person_id, name FROM mention WHERE person_id IS NOT NULL")
def _(t):
    return t.mention.where("person_id is not null").select("person_id", "name").distinct()


@query("ag_06_signing_capacities", "SELECT role, count(DISTINCT document_id) AS documents, count(DISTINCT person_id) AS persons FROM mention WHERE mention_id NOT IN (SELECT mention_id FROM assignment WHERE superseded_at IS NULL) AND mention_id IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def _(t):
    m = t.mention.join(temporal.live(t.assignment), "mention_id", "left_anti").join(t.lineitem.select(F.col("l_orderkey").alias("mention_id")), "mention_id", "left_semi")
    return m.groupBy("role").agg(F.countDistinct("document_id").alias("documents"), F.countDistinct("person_id").alias("persons"))


@query("ag_07_coverage", "SELECT m.document_id, count(DISTINCT m.mention_id) AS mentions, bool_or(e.event_id IS NOT NULL) AS has_event FROM mention m LEFT JOIN (SELECT * FROM event WHERE event_type = 'TERMINATION') e ON e.document_id = m.document_id GROUP BY 1")
def _(t):
    m = t.mention.groupBy("document_id").agg(F.countDistinct("mention_id").alias("mentions"))
    e = t.event.where("event_type = 'TERMINATION'").select("document_id", F.lit(True).alias("hit")).distinct()
    return m.join(e, "document_id", "left").select("document_id", "mentions", F.coalesce("hit", F.lit(False)).alias("has_event"))


SIGNAL = "SELECT o_orderkey % 4000 AS mention_id, CASE o_orderkey % 3 WHEN 0 THEN 'identifier' WHEN 1 THEN 'precedent' ELSE 'office' END AS signal, o_custkey % 3 AS person_id FROM orders"


@query("ag_10_identity_decision", f"SELECT mention_id, CASE WHEN n = 1 THEN 'LINKED' ELSE 'CONFLICT' END AS outcome, CASE WHEN n = 1 THEN who END AS person_id, CASE WHEN n = 1 THEN how END AS signal FROM (SELECT mention_id, count(DISTINCT person_id) AS n, min(person_id) AS who, arg_min(signal, CASE signal WHEN 'identifier' THEN 1 WHEN 'precedent' THEN 2 ELSE 3 END) AS how FROM ({SIGNAL}) GROUP BY 1)")
def _(t):
    return identity.decide(t.sql(SIGNAL))


@query("ag_11_issuer_consensus", "SELECT position_id, CASE WHEN count(*) FILTER (organization_id IS NULL) > 0 THEN 'NO_ISSUER' WHEN count(DISTINCT organization_id) > 1 THEN 'CONFLICTING' ELSE 'RESOLVED' END AS outcome, CASE WHEN count(*) FILTER (organization_id IS NULL) = 0 AND count(DISTINCT organization_id) = 1 THEN min(organization_id) END AS organization_id FROM assignment GROUP BY 1")
def _(t):
    return relational.unique_value(t.assignment, "position_id", "organization_id")


@query("ag_12_catalog_groups", "SELECT name, count(*) AS members, min(org_id) AS survivor FROM org GROUP BY 1")
def _(t):
    return t.org.groupBy("name").agg(F.count(F.lit(1)).alias("members"), F.min("org_id").alias("survivor"))


@query("ag_13_search_hits", "SELECT m.person_id, count(DISTINCT m.document_id) AS documents, count(DISTINCT m.name) AS spellings FROM mention m WHERE strpos(' ' || m.name, ' BL') > 0 AND m.person_id IS NOT NULL GROUP BY 1")
def _(t):
    from factloom.functions.classify import prefix_search

    m = t.mention.where(prefix_search(F.col("name"), F.array(F.lit("BL")))).where("person_id is not null")
    return m.groupBy("person_id").agg(F.countDistinct("document_id").alias("documents"), F.countDistinct("name").alias("spellings"))


@query("ag_14_counts_per_key", "SELECT precedent_id, count(*) AS n FROM (SELECT m.mention_id, p.precedent_id FROM mention m JOIN precedent p ON p.name = m.name WHERE p.revoked_at IS NULL) GROUP BY 1")
def _(t):
    p = t.precedent.where("revoked_at is null").select("precedent_id", "name")
    return t.mention.groupBy("name").count().join(p, "name").select("precedent_id", F.col("count").alias("n"))


@query("ag_15_dispatch_eligibility", "SELECT m.mention_id, count(DISTINCT p.person_id) = 1 AS eligible FROM mention m JOIN person p ON p.name = m.name WHERE m.person_id IS NULL AND p.merged_into IS NULL GROUP BY 1")
def _(t):
    p = t.person.where("merged_into is null").groupBy("name").agg(F.countDistinct("person_id").alias("n"))
    return t.mention.where("person_id is null").join(p, "name").select("mention_id", (F.col("n") == 1).alias("eligible"))


# Windows and top-k


@query("wn_01_latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def _(t):
    return relational.latest(t.events, ["user_id", "event_type"], [F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


@query("wn_02_latest_with_count", "SELECT user_id, arg_max(event_id, ROW(ts, event_id)) AS event_id, count(*) AS versions FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("versions"))


@query("wn_03_version_chain", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_id FROM events")
def _(t):
    return t.events.select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("previous_id"))


@query("wn_05_chronology", "SELECT person_id, assignment_id, row_number() OVER (PARTITION BY person_id ORDER BY coalesce(valid_from, legal_from, valid_to, legal_to) DESC NULLS LAST, assignment_id) AS place FROM assignment")
def _(t):
    w = Window.partitionBy("person_id").orderBy(F.coalesce("valid_from", "legal_from", "valid_to", "legal_to").desc_nulls_last(), "assignment_id")
    return t.assignment.select("person_id", "assignment_id", F.row_number().over(w).alias("place"))


@query("wn_06_first_appearances", "SELECT document_id, event_id, r AS place FROM (SELECT document_id, event_id, row_number() OVER (PARTITION BY document_id ORDER BY published_on ASC NULLS LAST, event_id) AS r FROM event) WHERE r <= 4")
def _(t):
    return relational.first_k(t.event, ["document_id"], [F.asc_nulls_last("published_on"), F.asc("event_id")], 4).select("document_id", "event_id", F.col("_rank").alias("place"))


@query("wn_07_task_queue", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 100")
def _(t):
    return t.orders.where("o_orderstatus = 'P'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority")


@query("wn_08_page", "SELECT event_id, published_on FROM event ORDER BY published_on NULLS FIRST, event_id LIMIT 20 OFFSET 40")
def _(t):
    return t.event.orderBy("published_on", "event_id").offset(40).limit(20).select("event_id", "published_on")


@query("wn_09_nulls_last", "SELECT position_id, list(assignment_id ORDER BY valid_from ASC NULLS LAST, recorded_at, assignment_id) AS ids FROM assignment GROUP BY 1")
def _(t):
    key = F.struct(F.col("valid_from").isNull().alias("a"), F.col("valid_from").alias("b"), F.col("recorded_at").alias("c"), F.col("assignment_id").alias("d"))
    return t.assignment.groupBy("position_id").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["d"]).alias("ids"))


@query("wn_11_ordered_dedupe", r"SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]), chr(10)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def _(t):
    return t.documents.select("doc_id", F.array_join(F.array_distinct(F.split("text", "\n")), "\n").alias("text"))


# Sets and closure


@query("set_01_union_first_reason", "SELECT c_custkey, arg_min(reason, rnk) AS reason FROM (SELECT o_custkey AS c_custkey, 'order' AS reason, 0 AS rnk FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT user_id, 'event', 1 FROM events) GROUP BY 1")
def _(t):
    return relational.union_first([(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "order"), (t.events.select(F.col("user_id").alias("c_custkey")), "event")], "c_custkey")


@query("set_02_intersection", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def _(t):
    return t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).intersect(t.events.where("event_type = 'error'").select("user_id"))


@query("set_03_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("id")).exceptAll(t.orders.where("o_totalprice > 300000").select("o_custkey").distinct())


SURVIVOR = """
WITH RECURSIVE walk(node, cur, depth) AS (
  SELECT person_id, person_id, 0 FROM person UNION ALL SELECT w.node, p.merged_into, w.depth + 1 FROM walk w JOIN person p ON p.person_id = w.cur WHERE p.merged_into IS NOT NULL AND w.depth < 400)
SELECT node AS person_id, arg_max(cur, depth) AS survivor FROM walk GROUP BY 1"""


@query("rec_01_merge_survivor", SURVIVOR)
def _(t):
    return closure.survivors(t.person.select(F.col("person_id").alias("node"), F.col("merged_into").alias("target"))).withColumnRenamed("node", "person_id")


@query("rec_02_org_survivor", "WITH RECURSIVE walk(node, cur, depth) AS (SELECT org_id, org_id, 0 FROM org UNION ALL SELECT w.node, p.merged_into, w.depth + 1 FROM walk w JOIN org p ON p.org_id = w.cur WHERE p.merged_into IS NOT NULL AND w.depth < 10) SELECT node AS org_id, arg_max(cur, depth) AS survivor FROM walk GROUP BY 1")
def _(t):
    return closure.survivors(t.org.select(F.col("org_id").alias("node"), F.col("merged_into").alias("target"))).withColumnRenamed("node", "org_id")


CHAIN = "WITH RECURSIVE walk(node, member, depth) AS (SELECT org_id, org_id, 0 FROM org UNION ALL SELECT w.node, p.predecessor_id, w.depth + 1 FROM walk w JOIN org p ON p.org_id = w.member WHERE p.predecessor_id IS NOT NULL AND w.depth < 10)"


@query("rec_03_succession_chain", f"{CHAIN} SELECT node, member, -depth AS era FROM walk UNION ALL SELECT member, node, depth FROM walk WHERE depth > 0")
def _(t):
    return closure.succession(t.spark, t.org.select(F.col("org_id").alias("node"), F.col("predecessor_id").alias("target")))


@query("rec_04_assignments_across", f"{CHAIN} SELECT w.node AS org_id, o.name AS era, a.assignment_id FROM walk w JOIN org o ON o.org_id = w.member JOIN assignment a ON a.organization_id = w.member")
def _(t):
    c = closure.chain(t.spark, t.org.select(F.col("org_id").alias("node"), F.col("predecessor_id").alias("target")))
    o = t.org.select(F.col("org_id").alias("member"), F.col("name").alias("era"))
    return c.join(o, "member").join(t.assignment.select(F.col("organization_id").alias("member"), "assignment_id"), "member").select(F.col("node").alias("org_id"), "era", "assignment_id")


@query("rec_05_unit_labels", f"{CHAIN} SELECT w.node, string_agg(o.name, ' > ' ORDER BY w.depth) AS path FROM walk w JOIN org o ON o.org_id = w.member GROUP BY 1")
def _(t):
    return closure.labels_up(t.spark, t.org.select(F.col("org_id").alias("node"), F.col("predecessor_id").alias("target")), t.org.select(F.col("org_id").alias("node"), F.col("name").alias("label")))


# Versions, sinks and workflow


@query("snk_03_new_versions", "SELECT artifact_id, sha256, captured_at, capture_id, lag(capture_id) OVER w AS previous_id, row_number() OVER w AS version FROM (SELECT artifact_id, sha256, min(captured_at) AS captured_at, arg_min(capture_id, ROW(captured_at, capture_id)) AS capture_id FROM capture GROUP BY 1, 2) WINDOW w AS (PARTITION BY artifact_id ORDER BY captured_at, capture_id)")
def _(t):
    return versioning.new_versions(t.capture)


@query("snk_04_magic_bytes", "SELECT page_id, page_id % 3 = 0 AS ok FROM pages")
def _(t):
    x = t.sql("SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('%PDF-1.7 ', html) WHEN 1 THEN concat(' %PDF-', html) ELSE html END AS content FROM pages")
    return x.select("page_id", F.col("content").cast("binary").substr(1, 5).eqNullSafe(F.lit(b"%PDF-")).alias("ok"))


@query("snk_05_changed_listing", "SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r = 1 OR event_type IS DISTINCT FROM b")
def _(t):
    return versioning.changed(t.events, "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id")


@query("snk_06_upsert_keys", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    k = t.orders.select("o_custkey", "o_orderpriority", "o_orderstatus")
    return versioning.missing(k.where("o_orderstatus = 'O'").drop("o_orderstatus"), k.where("o_orderstatus = 'F'").drop("o_orderstatus"), ["o_custkey", "o_orderpriority"])


@query("snk_01_content_address", "SELECT sha256(text) AS sha, substr(sha256(text), 1, 2) AS shard, count(*) AS n FROM documents GROUP BY 1, 2")
def _(t):
    return t.documents.groupBy(N.sha256(F.col("text")).alias("sha")).agg(F.count(F.lit(1)).alias("n")).select("sha", F.substring("sha", 1, 2).alias("shard"), "n")


@query("snk_08_payloads", """SELECT o_orderkey, '{"id":' || CAST(o_orderkey AS VARCHAR) || ',"lines":[' || string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) || ']}' AS payload FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t):
    li = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines"))
    return t.orders.select("o_orderkey").join(li, "o_orderkey").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("id"), "lines")).alias("payload"))


@query("mut_01_idempotent_load", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("mut_03_orphan_sweep", f"SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AND s_acctbal > 0")
def _(t):
    return relational.referenced(t.supplier.where("s_acctbal > 0").select("s_suppkey"), "s_suppkey", [(t.lineitem.where("l_quantity > 49"), "l_suppkey")], False)


@query("mut_04_supersession_view", "SELECT assignment_id FROM assignment a WHERE NOT EXISTS (SELECT 1 FROM assignment b WHERE b.start_event_id = a.assignment_id * 2 AND b.superseded_at IS NOT NULL)")
def _(t):
    gone = t.assignment.where("superseded_at is not null and start_event_id is not null").select((F.col("start_event_id") / 2).cast("long").alias("assignment_id"))
    return t.assignment.select("assignment_id").join(gone, "assignment_id", "left_anti")


@query("mut_06_precedent_sweep", f"SELECT m.mention_id, p.person_id FROM mention m JOIN ({PRECEDENT_SQL}) p ON p.mention_id = m.mention_id WHERE m.person_id IS NULL")
def _(t):
    pending = t.mention.where("person_id is null")
    return identity.by_precedent(pending, t.precedent).select("mention_id", "person_id")


@query("state_interval_history", "SELECT user_id, event_type, ts AS from_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS to_ts FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE r = 1 OR event_type IS DISTINCT FROM b")
def _(t):
    return versioning.interval_history(t.events, "user_id", "ts", "event_type")
