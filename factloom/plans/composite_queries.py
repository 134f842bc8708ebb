"""Composite questions, review workflow, graphs and invariants over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import classify as C
from factloom.functions import normalize as N
from factloom.operators import closure, identity, review, temporal
from factloom.plans import quads as Q
from factloom.plans.registry import query

WALK = """WITH RECURSIVE pw(node, cur, depth) AS (
  SELECT person_id, person_id, 0 FROM person UNION ALL SELECT w.node, p.merged_into, w.depth + 1 FROM pw w JOIN person p ON p.person_id = w.cur WHERE p.merged_into IS NOT NULL AND w.depth < 400),
sv AS (SELECT node AS person_id, arg_max(cur, depth) AS survivor FROM pw GROUP BY 1)"""
ORG_WALK = """WITH RECURSIVE ow(node, cur, depth) AS (
  SELECT org_id, org_id, 0 FROM org UNION ALL SELECT w.node, p.merged_into, w.depth + 1 FROM ow w JOIN org p ON p.org_id = w.cur WHERE p.merged_into IS NOT NULL AND w.depth < 10),
so AS (SELECT node AS org_id, arg_max(cur, depth) AS survivor FROM ow GROUP BY 1)"""
PARENTS = """WITH RECURSIVE up(node, member, depth) AS (
  SELECT org_id, org_id, 0 FROM org UNION ALL SELECT w.node, p.predecessor_id, w.depth + 1 FROM up w JOIN org p ON p.org_id = w.member WHERE p.predecessor_id IS NOT NULL AND w.depth < 10)"""


def person_survivors(t) -> DataFrame:
    return closure.survivors(t.person.select(F.col("person_id").alias("node"), F.col("merged_into").alias("target"))).withColumnRenamed("node", "person_id")


def org_survivors(t) -> DataFrame:
    return closure.survivors(t.org.select(F.col("org_id").alias("node"), F.col("merged_into").alias("target"))).withColumnRenamed("node", "org_id")


def parents(t) -> DataFrame:
    return closure.chain(t.spark, t.org.select(F.col("org_id").alias("node"), F.col("predecessor_id").alias("target")))


@query("q_01_person_search", f"""{WALK},
spell AS (SELECT person_id, name FROM person UNION SELECT person_id, name FROM mention WHERE person_id IS NOT NULL),
hom AS (SELECT s.name, count(DISTINCT sv.survivor) AS n FROM spell s JOIN sv ON sv.person_id = s.person_id GROUP BY 1),
hit AS (SELECT sv.survivor, s.name, hom.n FROM spell s JOIN sv ON sv.person_id = s.person_id JOIN hom ON hom.name = s.name WHERE strpos(' ' || s.name, ' RED') > 0),
docs AS (SELECT sv.survivor, count(DISTINCT m.document_id) AS documents FROM mention m JOIN sv ON sv.person_id = m.person_id GROUP BY 1)
SELECT h.survivor AS person_id, list_sort(list(DISTINCT h.name)) AS spellings, coalesce(max(d.documents), 0) AS documents, max(h.n) AS homonyms FROM hit h LEFT JOIN docs d ON d.survivor = h.survivor GROUP BY 1 ORDER BY 1 LIMIT 50""")
def _(t):
    sv = person_survivors(t)
    spelled = t.person.select("person_id", "name").union(t.mention.where("person_id is not null").select("person_id", "name")).distinct().join(sv, "person_id").select("survivor", "name").distinct()
    homonyms = spelled.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    hit = spelled.where(C.prefix_search(F.col("name"), F.array(F.lit("RED")))).join(homonyms, "name")
    found = hit.groupBy("survivor").agg(F.array_sort(F.collect_set("name")).alias("spellings"), F.max("n").alias("homonyms"))
    documents = t.mention.select("person_id", "document_id").join(sv, "person_id").groupBy("survivor").agg(F.countDistinct("document_id").alias("documents"))
    out = found.join(documents, "survivor", "left").select(F.col("survivor").alias("person_id"), "spellings", F.coalesce("documents", F.lit(0)).alias("documents"), "homonyms")
    return out.orderBy("person_id").limit(50)


@query("q_02_person_dossier", f"""{WALK},
m AS (SELECT sv.survivor, list_sort(list(DISTINCT m.name)) AS aliases, list_sort(list(DISTINCT m.role)) AS capacities, count(DISTINCT m.document_id) AS documents FROM mention m JOIN sv ON sv.person_id = m.person_id GROUP BY 1),
a AS (SELECT sv.survivor, list_sort(list(a.assignment_id)) AS assignments, min(coalesce(a.valid_from, a.legal_from)) AS first_start FROM assignment a JOIN sv ON sv.person_id = a.person_id WHERE a.superseded_at IS NULL GROUP BY 1)
SELECT s.survivor AS person_id, m.aliases, m.capacities, coalesce(m.documents, 0) AS documents, a.assignments, a.first_start, m.documents IS NOT NULL AND a.survivor IS NULL AS unplaced
FROM (SELECT DISTINCT survivor FROM sv) s LEFT JOIN m ON m.survivor = s.survivor LEFT JOIN a ON a.survivor = s.survivor""")
def _(t):
    sv = person_survivors(t)
    m = t.mention.join(sv, "person_id").groupBy("survivor").agg(F.array_sort(F.collect_set("name")).alias("aliases"), F.array_sort(F.collect_set("role")).alias("capacities"), F.countDistinct("document_id").alias("documents"))
    a = temporal.with_effective(temporal.live(t.assignment)).join(sv, "person_id").groupBy("survivor").agg(F.array_sort(F.collect_list("assignment_id")).alias("assignments"), F.min("eff_start").alias("first_start"))
    x = sv.select("survivor").distinct().join(m, "survivor", "left").join(a, "survivor", "left")
    return x.select(F.col("survivor").alias("person_id"), "aliases", "capacities", F.coalesce("documents", F.lit(0)).alias("documents"), "assignments", "first_start", (F.col("documents").isNotNull() & F.col("assignments").isNull()).alias("unplaced"))


@query("rm_06_appointment_assembly", f"""{ORG_WALK}
SELECT a.assignment_id, coalesce(a.valid_from, a.legal_from) AS starts_on, CASE WHEN a.valid_from IS NOT NULL THEN 'source' WHEN a.legal_from IS NOT NULL THEN 'legal_rule' END AS start_basis,
  coalesce(a.valid_to, a.legal_to) AS ends_on, CASE WHEN a.valid_to IS NOT NULL THEN 'source' WHEN a.legal_to IS NOT NULL THEN 'legal_rule' END AS end_basis, s.event_type AS lead_event, e.event_type AS end_event, so.survivor AS organization_id
FROM assignment a LEFT JOIN event s ON s.event_id = a.start_event_id LEFT JOIN event e ON e.event_id = a.end_event_id - 1 LEFT JOIN so ON so.org_id = a.organization_id WHERE a.superseded_at IS NULL""")
def _(t):
    a = temporal.with_effective(temporal.live(t.assignment))
    basis = lambda own, law: F.when(F.col(own).isNotNull(), "source").when(F.col(law).isNotNull(), "legal_rule")
    s = t.event.select(F.col("event_id").alias("s_id"), F.col("event_type").alias("lead_event"))
    e = t.event.select((F.col("event_id") + 1).alias("e_id"), F.col("event_type").alias("end_event"))
    o = org_survivors(t).select("org_id", "survivor")
    x = a.join(s, F.col("start_event_id") == F.col("s_id"), "left").join(e, F.col("end_event_id") == F.col("e_id"), "left").join(o, F.col("organization_id") == F.col("org_id"), "left")
    return x.select("assignment_id", F.col("eff_start").alias("starts_on"), basis("valid_from", "legal_from").alias("start_basis"), F.col("eff_end").alias("ends_on"), basis("valid_to", "legal_to").alias("end_basis"), "lead_event", "end_event", F.col("survivor").alias("organization_id"))


RUNS = "SELECT mention_id, document_id, mention_id % 3 AS run_id, name, role, CASE WHEN mention_id % 11 = 0 THEN 'HUMAN_REJECTED' WHEN mention_id % 7 = 0 THEN 'HUMAN_ACCEPTED' ELSE 'AUTO' END AS status, CASE WHEN mention_id % 7 = 0 AND mention_id % 11 > 0 THEN person_id END AS decided FROM mention"


@query("mut_02_reprocess", f"""
WITH r AS ({RUNS}), l AS (SELECT document_id, max(run_id) AS latest FROM r GROUP BY 1),
d AS (SELECT document_id, name, role, max(decided) AS decided FROM r WHERE decided IS NOT NULL GROUP BY 1, 2, 3)
SELECT r.mention_id, CASE WHEN r.run_id = l.latest OR r.status = 'HUMAN_REJECTED' THEN r.status ELSE 'SUPERSEDED' END AS status, CASE WHEN r.run_id = l.latest THEN coalesce(r.decided, d.decided) END AS carried
FROM r JOIN l ON l.document_id = r.document_id LEFT JOIN d ON d.document_id = r.document_id AND d.name = r.name AND d.role IS NOT DISTINCT FROM r.role""")
def _(t):
    return review.reprocessed(t.sql(RUNS), "mention_id", "document_id", "run_id", ["name", "role"])


DECISIONS = "SELECT event_id, user_id AS task_id, ts, CASE event_type WHEN 'purchase' THEN 'ACCEPT' WHEN 'error' THEN 'REJECT' WHEN 'click' THEN 'COMMENT' ELSE 'SHRUG' END AS action, CASE WHEN event_id % 5 > 0 THEN 'visto' END AS note FROM events"
PROBLEMS = f"""
WITH d AS ({DECISIONS}), v AS (SELECT *, CASE WHEN action NOT IN ('ACCEPT', 'REJECT', 'COMMENT') THEN 'unknown action' WHEN action = 'REJECT' AND note IS NULL THEN 'note required' END AS own FROM d),
c AS (SELECT *, coalesce(sum(CASE WHEN own IS NULL AND action <> 'COMMENT' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v)
SELECT event_id, task_id, action, coalesce(own, CASE WHEN before > 0 THEN 'task is not pending' END) AS problem FROM c"""


@query("mut_09_batch_decisions", PROBLEMS)
def _(t):
    return review.decided(t.sql(DECISIONS)).select("event_id", "task_id", "action", "problem")


@query("mut_05_decision_fold", f"SELECT task_id, coalesce(max(CASE WHEN problem IS NULL AND action <> 'COMMENT' THEN action END), 'PENDING') AS state, count(*) FILTER (problem IS NULL) AS recorded, count(*) FILTER (problem IS NOT NULL) AS refused FROM ({PROBLEMS.replace('WITH d', 'WITH d', 1)}) p GROUP BY 1")
def _(t):
    return review.states(review.decided(t.sql(DECISIONS)))


@query("mut_07_merged_positions", f"""{ORG_WALK}
SELECT a.assignment_id, so.survivor AS organization_id, min(a.position_id) OVER (PARTITION BY so.survivor, a.label) AS position_id FROM assignment a JOIN so ON so.org_id = a.organization_id""")
def _(t):
    x = t.assignment.select("assignment_id", "organization_id", "label", "position_id").join(org_survivors(t), F.col("organization_id") == F.col("org_id"))
    kept = x.groupBy(F.col("survivor").alias("s"), F.col("label").alias("l")).agg(F.min("position_id").alias("kept"))
    return x.join(kept, (F.col("survivor") == F.col("s")) & (F.col("label") == F.col("l"))).select("assignment_id", F.col("survivor").alias("organization_id"), F.col("kept").alias("position_id"))


@query("mut_10_retry_queue", """
SELECT r.item_id, r.status FROM run_item r LEFT JOIN summary s ON s.item_id = r.item_id
WHERE r.status = 'RETRY_PENDING' OR (r.status = 'FAILED' AND regexp_matches(upper(strip_accents(s.summary)), '\\b(DESIGNAN|NOMBRAN|NOMBRASE|ENCARGAN|ACEPTAN (LA )?RENUNCIA|DAN POR CONCLUIDA|DEJAN SIN EFECTO DESIGNACION|DECLARAN VACANCIA)\\b'))""")
def _(t):
    relevant = t.summary.where(C.relevance(F.col("summary"))["relevance"] == "RELEVANT").select("item_id")
    retry = t.run_item.where("status = 'RETRY_PENDING'").select("item_id", "status")
    return retry.unionByName(t.run_item.where("status = 'FAILED'").select("item_id", "status").join(relevant, "item_id", "left_semi"))


@query("rec_06_equivalent_units", f"""{PARENTS},
path AS (SELECT u.node, string_agg(o.name, ' > ' ORDER BY u.depth) AS path FROM up u JOIN org o ON o.org_id = u.member GROUP BY 1)
SELECT node AS org_id, min(node) OVER (PARTITION BY path) AS keeps FROM path""")
def _(t):
    # units are equivalent if their names are, and their parents' up to the root: then the whole paths are
    named = closure.labels_up(t.spark, t.org.select(F.col("org_id").alias("node"), F.col("predecessor_id").alias("target")), t.org.select(F.col("org_id").alias("node"), F.col("name").alias("label")))
    kept = named.groupBy(F.col("path").alias("of")).agg(F.min("node").alias("keeps"))
    return named.join(kept, F.col("path") == F.col("of")).select(F.col("node").alias("org_id"), "keeps")


@query("rec_07_subtree", f"""{PARENTS},
held AS (SELECT DISTINCT u.member FROM up u JOIN assignment a ON a.organization_id = u.node WHERE a.superseded_at IS NULL AND a.organization_id % 4 = 0)
SELECT node AS org_id, max(depth) AS depth FROM up WHERE node NOT IN (SELECT member FROM held) GROUP BY 1""")
def _(t):
    walked = parents(t)
    used = temporal.live(t.assignment).where("organization_id % 4 = 0").select(F.col("organization_id").alias("node")).distinct()
    held = walked.join(used, "node", "left_semi").select(F.col("member").alias("node")).distinct()
    # the deepest go first
    return walked.groupBy("node").agg(F.max("depth").alias("depth")).join(held, "node", "left_anti").select(F.col("node").alias("org_id"), "depth")


@query("ex_13_event_fan_out", """
SELECT 'evidence' AS t, event_id AS key, NULL AS detail FROM event UNION ALL SELECT 'assertion', event_id, CASE WHEN stated = 'EXPLICIT' THEN 'AUTO_ACCEPTED' ELSE 'CANDIDATE' END FROM event
UNION ALL SELECT 'verdict', event_id, CASE WHEN authority <> 'OFFICIAL_GAZETTE' OR published_on IS NULL OR coalesce(deferred, '') = 'INDETERMINATE' THEN 'VETOED' ELSE 'DETERMINED' END FROM event WHERE stated = 'NOT_STATED' AND event_type <> 'ACTING_ASSIGNMENT'
UNION ALL SELECT 'task', event_id, 'unknown end' FROM event WHERE effect = 'END' AND event_id + 1 NOT IN (SELECT end_event_id FROM assignment WHERE end_event_id IS NOT NULL)
UNION ALL SELECT 'participant', event_id, CAST(person_id AS VARCHAR) FROM participant WHERE event_id IN (SELECT event_id FROM event)""")
def _(t):
    e = t.event
    verdict = C.legal_effect(*(F.col(c) for c in ("event_type", "stated", "published_on", "authority", "deferred")))["outcome"]
    known = t.assignment.where("end_event_id is not null").select((F.col("end_event_id") - 1).alias("event_id"))
    row = lambda x, name, detail: x.select(F.lit(name).alias("t"), F.col("event_id").alias("key"), detail.cast("string").alias("detail"))
    parts = [
        row(e, "evidence", F.lit(None)),
        row(e, "assertion", F.when(F.col("stated") == "EXPLICIT", "AUTO_ACCEPTED").otherwise("CANDIDATE")),
        row(e.withColumn("v", verdict).where("v <> 'NOT_APPLICABLE'"), "verdict", F.col("v")),
        row(e.where("effect = 'END'").join(known, "event_id", "left_anti"), "task", F.lit("unknown end")),
        row(t.participant.join(e.select("event_id"), "event_id", "left_semi"), "participant", F.col("person_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


MENTIONED = "SELECT org_id, CASE WHEN org_id % 5 = 0 THEN name || ' BAJO EL REGIMEN CAS' ELSE name END AS name FROM org"


@query("ex_15_organization_resolution", f"""
WITH m AS ({MENTIONED}), g AS (SELECT name, min(org_id) AS survivor FROM m GROUP BY 1),
v AS (SELECT DISTINCT a.name FROM g a JOIN g b ON a.name <> b.name AND (strpos(a.name, b.name) > 0 OR strpos(b.name, a.name) > 0) AND length(a.name) >= 12)
SELECT m.org_id, g.survivor, CASE WHEN g.survivor = m.org_id THEN 'NEW' ELSE 'EXISTING' END AS outcome,
  CASE WHEN g.survivor < m.org_id THEN NULL WHEN strpos(m.name, 'BAJO EL REGIMEN') > 0 THEN 'contamination' WHEN v.name IS NOT NULL THEN 'variant' ELSE 'uncatalogued' END AS task
FROM m JOIN g ON g.name = m.name LEFT JOIN v ON v.name = m.name""")
def _(t):
    m = t.sql(MENTIONED)
    s = m.groupBy("name").agg(F.min("org_id").alias("survivor"))
    variant = identity.containing_names(s, s).select(F.col("probe").alias("name"), F.lit(True).alias("variant")).distinct()
    x = m.join(s, "name").join(variant, "name", "left")
    new = F.col("survivor") == F.col("org_id")
    task = F.when(~new, F.lit(None)).when(N.contamination(F.col("name")).isNotNull(), "contamination").when(F.col("variant"), "variant").otherwise("uncatalogued")
    return x.select("org_id", "survivor", F.when(new, "NEW").otherwise("EXISTING").alias("outcome"), task.alias("task"))


@query("ex_16_position_keys", "SELECT organization_id, label, min(position_id) AS first_position, organization_id IS NULL AS needs_task FROM assignment GROUP BY 1, 2")
def _(t):
    return t.assignment.groupBy("organization_id", "label").agg(F.min("position_id").alias("first_position")).withColumn("needs_task", F.col("organization_id").isNull())


@query("rm_13_built_rows", r"""
SELECT 'identifier' AS t, mention_id AS key, upper(regexp_replace(v, '[\s.\-]', '', 'g')) AS detail, NULL AS confidence FROM (SELECT mention_id, CASE WHEN mention_id % 4 = 0 THEN ' .- ' ELSE value END AS v FROM mention) WHERE regexp_replace(v, '[\s.\-]', '', 'g') <> ''
UNION ALL SELECT 'assertion', m.mention_id, 'HUMAN_ACCEPTED', CAST(1 AS DOUBLE) FROM mention m WHERE m.mention_id IN (SELECT m2.mention_id FROM mention m2 JOIN precedent p ON p.name = m2.name AND (p.role IS NULL OR p.role = m2.role) WHERE p.revoked_at IS NULL GROUP BY 1 HAVING count(DISTINCT p.person_id) = 1)""")
def _(t):
    value = N.identifier(F.when(F.col("mention_id") % 4 == 0, " .- ").otherwise(F.col("value")))
    ids = t.mention.select(F.lit("identifier").alias("t"), F.col("mention_id").alias("key"), value.alias("detail"), F.lit(None).cast("double").alias("confidence")).where("detail <> ''")
    linked = identity.by_precedent(t.mention, t.precedent)
    return ids.unionByName(linked.select(F.lit("assertion").alias("t"), F.col("mention_id").alias("key"), F.lit("HUMAN_ACCEPTED").alias("detail"), F.lit(1.0).alias("confidence")))


@query("snk_08_event_payloads", """
SELECT e.event_id, '{"id":' || e.event_id || ',"type":"' || e.event_type || '"' || coalesce(',"published_on":"' || strftime(e.published_on, '%Y-%m-%d') || '"', '') || ',"participants":[' || coalesce(p.people, '') || ']}' AS payload
FROM event e LEFT JOIN (SELECT event_id, string_agg(CAST(person_id AS VARCHAR), ',' ORDER BY person_id) AS people FROM (SELECT DISTINCT event_id, person_id FROM participant) GROUP BY 1) p ON p.event_id = e.event_id""")
def _(t):
    p = t.participant.groupBy(F.col("event_id").alias("of")).agg(F.array_sort(F.collect_set("person_id")).alias("people"))
    x = t.event.join(p, F.col("event_id") == F.col("of"), "left")
    body = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), "published_on", F.coalesce("people", F.array().cast("array<bigint>")).alias("participants"))
    return x.select("event_id", F.to_json(body).alias("payload"))


@query("snk_08_assignment_payloads", """
SELECT assignment_id, '{"id":' || assignment_id || coalesce(',"person_id":' || person_id, '') || ',"label":"' || label || '","period":{' || concat_ws(',', '"from":"' || strftime(coalesce(valid_from, legal_from), '%Y-%m-%d') || '"', '"to":"' || strftime(coalesce(valid_to, legal_to), '%Y-%m-%d') || '"') || '}}' AS payload FROM assignment WHERE superseded_at IS NULL""")
def _(t):
    a = temporal.with_effective(temporal.live(t.assignment))
    body = F.struct(F.col("assignment_id").alias("id"), "person_id", "label", F.struct(F.col("eff_start").alias("from"), F.col("eff_end").alias("to")).alias("period"))
    return a.select("assignment_id", F.to_json(body).alias("payload"))


GRAPHS_SQL = """
SELECT 'document/' || doc_id AS s, 'lang' AS p, lang AS o FROM documents UNION SELECT 'event/' || event_id, 'type', event_type FROM event UNION SELECT 'mention/' || mention_id, 'name', name FROM mention
UNION SELECT 'person/' || person_id, 'name', name FROM person UNION SELECT 'event/' || event_id, 'status', stated FROM event WHERE stated = 'EXPLICIT'"""


def graphs(t) -> DataFrame:
    """The five graphs as quads: source, extraction, candidate, identity, accepted."""
    lit = lambda c: (F.col(c), "literal")
    parts = [
        Q.quads(t.documents, "source", Q.iri("document", F.col("doc_id")), {"lang": lit("lang")}),
        Q.quads(t.event, "extraction", Q.iri("event", F.col("event_id")), {"type": lit("event_type")}),
        Q.quads(t.mention, "candidate", Q.iri("mention", F.col("mention_id")), {"name": lit("name")}),
        Q.quads(t.person, "identity", Q.iri("person", F.col("person_id")), {"name": lit("name")}),
        Q.quads(t.event.where("stated = 'EXPLICIT'"), "accepted", Q.iri("event", F.col("event_id")), {"status": lit("stated")}),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("rdf_05_graph_merge", f"SELECT 'https://facts.example/' || s AS s, 'https://facts.example/o#' || p AS p, o FROM ({GRAPHS_SQL}) WHERE o IS NOT NULL")
def _(t):
    return graphs(t).select("s", "p", "o").distinct()


@query("snk_07_trig", "SELECT '<https://facts.example/g/source> { <https://facts.example/nation/' || n_nationkey || '> <https://facts.example/o#name> \"' || n_name || '\" . }' AS value FROM nation")
def _(t):
    return Q.trig(Q.quads(t.nation, "source", Q.iri("nation", F.col("n_nationkey")), {"name": (F.col("n_name"), "literal")}))


@query("rdf_03_unresolved_ends", "SELECT 'https://facts.example/g/extraction' AS g, 'https://facts.example/event/' || event_id AS s, 'https://facts.example/o#affectedAssignmentUnresolved' AS p, 'true' AS o, 'literal' AS kind FROM event WHERE effect = 'END' AND event_id + 1 NOT IN (SELECT end_event_id FROM assignment WHERE end_event_id IS NOT NULL)")
def _(t):
    known = t.assignment.where("end_event_id is not null").select((F.col("end_event_id") - 1).alias("event_id"))
    ends = t.event.where("effect = 'END'").join(known, "event_id", "left_anti")
    return Q.quads(ends, "extraction", Q.iri("event", F.col("event_id")), {"affectedAssignmentUnresolved": (F.lit("true"), "literal")})


@query("rdf_03_participants", "SELECT 'https://facts.example/g/extraction' AS g, 'https://facts.example/event/' || event_id AS s, 'https://facts.example/o#participant' AS p, 'https://facts.example/person/' || person_id AS o, 'iri' AS kind FROM participant")
def _(t):
    return Q.quads(t.participant, "extraction", Q.iri("event", F.col("event_id")), {"participant": (Q.iri("person", F.col("person_id")), "iri")})


@query("rdf_01_version_quads", "SELECT 'https://facts.example/g/source' AS g, 'https://facts.example/version/' || capture_id AS s, 'https://facts.example/o#' || p AS p, o, kind FROM (SELECT capture_id, 'versionOf' AS p, 'https://facts.example/artifact/' || artifact_id AS o, 'iri' AS kind FROM capture UNION ALL SELECT capture_id, 'sha256', sha256, 'literal' FROM capture)")
def _(t):
    return Q.quads(t.capture, "source", Q.iri("version", F.col("capture_id")), {"versionOf": (Q.iri("artifact", F.col("artifact_id")), "iri"), "sha256": (F.col("sha256"), "literal")})


#: Rules on stored data, each a query of the rows that break it.
INVARIANTS = {
    "assertion_has_evidence": "SELECT event_id AS id FROM event WHERE document_id IS NULL",
    "version_has_hash": "SELECT capture_id AS id FROM capture WHERE sha256 IS NULL OR sha256 = ''",
    "one_row_an_id": "SELECT assignment_id AS id FROM assignment GROUP BY assignment_id HAVING count(*) > 1",
    "starts_before_ends": "SELECT assignment_id AS id FROM assignment WHERE coalesce(valid_from, legal_from) > coalesce(valid_to, legal_to)",
    "law_never_replaces_source": "SELECT assignment_id AS id FROM assignment WHERE valid_from IS NOT NULL AND legal_from IS NOT NULL",
    "law_never_replaces_source_end": "SELECT assignment_id AS id FROM assignment WHERE valid_to IS NOT NULL AND legal_to IS NOT NULL",
    "law_date_has_event": "SELECT a.assignment_id AS id FROM assignment a LEFT JOIN event e ON e.event_id = a.start_event_id WHERE a.legal_from IS NOT NULL AND a.start_event_id IS NOT NULL AND e.event_id IS NULL",
    "publication_declares_publisher": "SELECT event_id AS id FROM event WHERE authority IS NULL",
    "one_authoritative_source": "SELECT document_id AS id FROM event WHERE authority = 'OFFICIAL_GAZETTE' GROUP BY document_id HAVING count(DISTINCT published_on) > 1",
    "versions_stay_in_their_artifact": "SELECT capture_id AS id FROM (SELECT capture_id, artifact_id, lag(artifact_id) OVER (PARTITION BY artifact_id ORDER BY captured_at, capture_id) AS before FROM capture) v WHERE before <> artifact_id",
    "merge_target_exists": "SELECT p.person_id AS id FROM person p LEFT JOIN person q ON q.person_id = p.merged_into WHERE p.merged_into IS NOT NULL AND q.person_id IS NULL",
    "no_merge_by_name_alone": "SELECT p.person_id AS id FROM person p JOIN person q ON q.person_id = p.merged_into AND q.name = p.name WHERE NOT EXISTS (SELECT 1 FROM mention m WHERE m.person_id = p.person_id)",
    "identifier_link_has_identifier": "SELECT mention_id AS id FROM mention WHERE person_id IS NOT NULL AND value IS NULL",
    "alias_names_one_person": "SELECT p.precedent_id AS id FROM precedent p WHERE p.role IS NULL AND p.revoked_at IS NULL AND p.name IN (SELECT name FROM person WHERE merged_into IS NULL GROUP BY name HAVING count(*) > 1)",
    "every_item_has_a_status": "SELECT item_id AS id FROM run_item WHERE status IS NULL",
    "pending_can_be_decided": "SELECT event_id AS id FROM event WHERE stated = 'NOT_STATED' AND authority IS NULL",
    "ending_an_encargo_ends_no_other": "SELECT a.end_event_id AS id FROM assignment a WHERE a.end_event_id IS NOT NULL GROUP BY a.end_event_id HAVING count(DISTINCT a.label) > 1",
    "participant_has_event": "SELECT p.event_id AS id FROM participant p LEFT JOIN orders o ON o.o_orderkey * 2 = p.event_id WHERE o.o_orderkey IS NULL",
    "assignment_has_mention": "SELECT assignment_id AS id FROM assignment WHERE mention_id IS NULL",
    "unknown_organization_is_flagged": "SELECT assignment_id AS id FROM assignment WHERE organization_id IS NULL AND label IS NULL",
    "superseded_after_recorded": "SELECT assignment_id AS id FROM assignment WHERE superseded_at < recorded_at",
    "chain_has_no_self_merge": "SELECT org_id AS id FROM org WHERE merged_into = org_id",
    "succession_has_no_self_link": "SELECT org_id AS id FROM org WHERE predecessor_id = org_id",
    "stated_date_is_published_or_before": "SELECT event_id AS id FROM event WHERE stated = 'EXPLICIT' AND published_on IS NULL AND effect = 'START'",
    "every_document_has_an_event": "SELECT DISTINCT m.document_id AS id FROM mention m LEFT JOIN event e ON e.document_id = m.document_id WHERE e.event_id IS NULL",
    "precedent_has_person": "SELECT precedent_id AS id FROM precedent WHERE person_id IS NULL",
    "section_order_is_unique": "SELECT document_id AS id FROM section GROUP BY document_id, order_index HAVING count(*) > 1",
    "no_empty_section": "SELECT document_id AS id FROM section WHERE trim(text) = ''",
    "benchmark_quote_not_empty": "SELECT item_id AS id FROM benchmark WHERE coalesce(text, '') = ''",
    "identifiers_stay_out_of_graphs": "SELECT m.mention_id AS id FROM mention m WHERE m.name = m.value",
}
INVARIANTS_SQL = "\nUNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS n FROM ({broken}) x" for rule, broken in INVARIANTS.items())


@query("val_02_invariants", INVARIANTS_SQL)
def _(t):
    return reduce(DataFrame.unionByName, (t.sql(broken).agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, broken in INVARIANTS.items()))
