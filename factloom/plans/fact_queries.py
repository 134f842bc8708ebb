"""Extraction, references, claims, repairs and catalogue syncs over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import normalize as N
from factloom.operators import claims, repair
from factloom.plans.registry import query
from factloom.sources import gazette, references

#: Articles made of order and customer keys, so that any number of names, posts and days is read.
NAME = "'ANA LUZ N' || chr(CAST(65 + o_custkey % 26 AS INT)) || 'R ROJAS' || chr(CAST(65 + o_orderkey % 26 AS INT))"
DAY = "(1 + o_orderkey % 28)"
DATE = f"CAST({DAY} AS STRING) || ' de marzo de ' || CAST(2000 + o_custkey % 27 AS STRING)"
ISO = f"CAST(2000 + o_custkey % 27 AS STRING) || '-03-' || lpad(CAST({DAY} AS STRING), 2, '0')"
POST = "'Jefa de la Oficina de Archivo ' || chr(CAST(65 + o_custkey % 26 AS INT)) || ' del Ministerio de Cultura'"


def oracle(where: str, text: str, **columns: str) -> str:
    """SQL of the rows that an article's text states, with the place of the name in it."""
    own = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    return f"SELECT article_id, {own}, person, CAST(strpos(text, person) - 1 AS INT) AS person_start FROM (SELECT o_orderkey AS article_id, o_orderkey, o_custkey, {text} AS text, {NAME} AS person FROM orders WHERE {where})"


def events(t, text: str, *columns: str):
    found = gazette.article_events(t.sql(f"SELECT o_orderkey AS article_id, {text} AS text FROM orders"))
    return found.select("article_id", *columns, "person", "person_start")


START = f"CASE o_orderkey % 4 WHEN 0 THEN 'Artículo 1.- Designar a la señora ' || {NAME} || ', en el cargo de ' || {POST} || ', siendo su primer día de labores el ' || {DATE} || '.' WHEN 1 THEN 'Artículo Único.- Nombrar, a partir del ' || {DATE} || ', a la señora ' || {NAME} || ' como miembro del Directorio.' WHEN 2 THEN 'Artículo 2.- Se designa a la señora ' || {NAME} || ' en el puesto de ' || {POST} || ', a partir de la fecha.' ELSE 'Artículo 3.- Publicar la presente resolución.' END"


@query("ex_03_individual_start", oracle(
    "o_orderkey % 4 < 3", START,
    event_type="CASE o_orderkey % 4 WHEN 1 THEN 'APPOINTMENT' ELSE 'DESIGNATION' END", assignment_kind="CASE o_orderkey % 4 WHEN 1 THEN 'BOARD_MEMBERSHIP' ELSE 'TITULAR' END",
    valid_from=f"CASE WHEN o_orderkey % 4 < 2 THEN {ISO} END", position_label=f"CASE o_orderkey % 4 WHEN 1 THEN 'miembro del Directorio' ELSE {POST} END",
))
def _(t):
    return events(t, START, "event_type", "assignment_kind", "valid_from", "position_label")


RESIGN = f"CASE o_orderkey % 3 WHEN 0 THEN 'Artículo 1.- Aceptar la renuncia presentada por la señora ' || {NAME} || ' al cargo de ' || {POST} || ', dándosele las gracias por los servicios prestados.' WHEN 1 THEN 'Aceptar la renuncia, a partir del ' || {DATE} || ', de la señora ' || {NAME} || ' al puesto de ' || {POST} || '.' ELSE 'Aceptar la renuncia formulada por la señora ' || {NAME} || ' como ' || {POST} || ', considerándosele como último día de labores el ' || {DATE} || ', dándosele las gracias.' END"


@query("ex_06_accept_resignation", oracle("true", RESIGN, valid_to=f"CASE WHEN o_orderkey % 3 > 0 THEN {ISO} END", position_label=POST, organization="'Ministerio de Cultura'"))
def _(t):
    return events(t, RESIGN, "valid_to", "position_label", "organization")


ENDS = f"'Artículo 1.- Dar por concluida la designación de la señora ' || {NAME} || ' en el cargo de ' || {POST} || '; asimismo, dejar sin efecto la designación de la señora MARTA PAZ SOL como Asesora'"


@query("ex_07_end_designations", f"SELECT o_orderkey AS article_id, clause, CASE clause WHEN 0 THEN {NAME} ELSE 'MARTA PAZ SOL' END AS person, CASE clause WHEN 0 THEN 'Jefa' ELSE 'Asesora' END AS role, CAST(strpos({ENDS}, CASE clause WHEN 0 THEN {NAME} ELSE 'MARTA PAZ SOL' END) - 1 AS INT) AS person_start FROM orders CROSS JOIN (VALUES (0), (1)) AS c(clause)")
def _(t):
    return gazette.article_events(t.sql(f"SELECT o_orderkey AS article_id, {ENDS} AS text FROM orders")).select("article_id", "clause", "person", "role", "person_start")


RECITALS = f"'Que, mediante la Ley N° 29158 y la Resolución Suprema N° ' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || '-2025-EF, se encarga a la señora ' || {NAME} || ', Vocal de la Sala, el puesto de ' || {POST}"


@query("ex_08_recital_candidates", f"SELECT o_custkey AS document_id, CAST(o_orderkey AS INT) AS order_index, {NAME} AS person, {POST} AS position_label, 'Vocal de la Sala' AS substantive_role, lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || '-2025-EF' AS cited_number, 0.6::DOUBLE AS confidence FROM orders")
def _(t):
    found = gazette.recital_candidates(t.sql(f"SELECT o_custkey AS document_id, o_orderkey AS order_index, {RECITALS} AS text FROM orders"))
    return found.select("document_id", "order_index", "person", "position_label", "substantive_role", "cited_number", "confidence")


ENCARGO = f"CASE o_orderkey % 4 WHEN 0 THEN 'Encargar a la señora ' || {NAME} || ', las funciones de ' || {POST} || ', hasta el retorno de la señora ROSA DIAZ PEÑA.' WHEN 1 THEN 'Se encarga a la señora ' || {NAME} || ', Directora de Archivo, en adición a sus funciones, el puesto de ' || {POST} || '.' WHEN 2 THEN 'Encargar, a la servidora civil ' || {NAME} || ', con eficacia anticipada a partir del ' || {DATE} || ', la obligación de informar, cuyas funciones se enmarcan en la norma.' ELSE 'Encargar a la Oficina General de Administración el cumplimiento de la presente resolución.' END"


@query("ex_09_encargar_person", oracle(
    "o_orderkey % 4 < 3", ENCARGO,
    event_type="CASE o_orderkey % 4 WHEN 0 THEN 'ACTING_ASSIGNMENT' ELSE 'ADDITIONAL_RESPONSIBILITY' END", end_condition="CASE o_orderkey % 4 WHEN 0 THEN 'hasta el retorno de la señora ROSA DIAZ PEÑA' END",
    returning_holder="CASE o_orderkey % 4 WHEN 0 THEN 'ROSA DIAZ PEÑA' END", substantive_role="CASE o_orderkey % 4 WHEN 1 THEN 'Directora de Archivo' END",
    valid_from=f"CASE o_orderkey % 4 WHEN 2 THEN {ISO} END", position_label=f"CASE o_orderkey % 4 WHEN 2 THEN 'la obligación de informar' ELSE {POST} END",
))
def _(t):
    return events(t, ENCARGO, "event_type", "end_condition", "returning_holder", "substantive_role", "valid_from", "position_label")


TABLE = "CASE o_orderkey % 3 WHEN 0 THEN 'N° | APELLIDOS Y NOMBRES | DNI' WHEN 1 THEN 'Entidad | Nombre completo | Doc. Identidad' ELSE 'N° | Cargo' END"


@query("ex_05_tabular_collective", f"SELECT o_orderkey AS document_id, CASE o_orderkey % 3 WHEN 0 THEN {NAME} WHEN 1 THEN {NAME} END AS person, CASE WHEN o_custkey % 2 = 0 THEN lpad(CAST(o_custkey AS VARCHAR), 8, '7') END AS identifier, CASE o_orderkey % 3 WHEN 1 THEN 'ENTIDAD ' || CAST(o_custkey AS VARCHAR) END AS organization FROM orders WHERE o_orderkey % 3 < 2")
def _(t):
    head = t.sql(f"SELECT o_orderkey AS document_id, 0 AS order_index, 'ARTICLE' AS type, 'Artículo 1.- Designar en el cargo de Jefe a los siguientes profesionales:' AS text FROM orders UNION ALL SELECT o_orderkey, 1, 'TABLE_ROW', {TABLE} FROM orders")
    number = "CASE WHEN o_custkey % 2 = 0 THEN lpad(CAST(o_custkey AS STRING), 8, '7') ELSE 'S/N' END"
    row = t.sql(f"SELECT o_orderkey AS document_id, 2 AS order_index, 'TABLE_ROW' AS type, CASE o_orderkey % 3 WHEN 0 THEN '1 | ' || {NAME} || ' | ' || {number} WHEN 1 THEN 'ENTIDAD ' || CAST(o_custkey AS STRING) || ' | ' || {NAME} || ' | ' || {number} ELSE '1 | Jefe' END AS text FROM orders")
    return gazette.collective_events(head.unionByName(row)).select("document_id", "person", "identifier", "organization")


SECTIONS = """
SELECT o_orderkey AS document_id, 0 AS order_index, 'VISTOS' AS type, 'VISTOS: la Resolución Ministerial N° ' || o_custkey || '-2025-X y la resolución ministerial Nº ' || o_custkey || '-2025-x;' AS text FROM orders
UNION ALL SELECT o_orderkey, 1, 'CONSIDERANDO', CASE WHEN o_orderkey % 2 = 0 THEN 'Que, por Resolución Suprema N° ' || o_custkey || '-2024-Y se designó a una jefa' ELSE 'Que, la Ley N° 1 no trata de eso' END FROM orders
UNION ALL SELECT o_orderkey, 2, 'CONSIDERANDO', 'De conformidad con la Ley N° 29158 y el Decreto Supremo N° 004-2019-JUS' FROM orders"""


@query("ex_11_document_references", """
SELECT o_orderkey AS document_id, 'SEEN' AS relation, 'Resolución Ministerial' AS kind, o_custkey || '-2025-X' AS number FROM orders
UNION ALL SELECT o_orderkey, 'PRIOR_APPOINTMENT', 'Resolución Suprema', o_custkey || '-2024-Y' FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'NORMATIVE', 'Ley', '29158' FROM orders UNION ALL SELECT o_orderkey, 'NORMATIVE', 'Decreto Supremo', '004-2019-JUS' FROM orders""")
def _(t):
    return references.document_references(t.sql(SECTIONS))


@query("fn_22_table_columns", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE 1 END AS name_at, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE 2 END AS identifier_at, CASE o_orderkey % 3 WHEN 1 THEN 0 END AS organization_at FROM orders")
def _(t):
    return t.sql(f"SELECT o_orderkey, {TABLE} AS header FROM orders").select("o_orderkey", F.inline(F.array(references.table_columns(F.col("header")))))


IDS = "'La señora ' || name_a || ', identificada con D.N.I. N° ' || lpad(CAST(o_custkey AS STRING), 8, '1') || ', y el señor LUIS PAZ ROJAS, con Carné de Extranjería N° ' || lpad(CAST(o_orderkey AS STRING), 9, '0') || ' y N° 12345678'"


@query("fn_24_labelled_identifiers", f"""
WITH x AS (SELECT o_orderkey, o_custkey, {NAME} AS name_a FROM orders), y AS (SELECT *, {IDS} AS text FROM x)
SELECT o_orderkey, 'DNI' AS scheme, lpad(CAST(o_custkey AS VARCHAR), 8, '1') AS value, CAST(strpos(text, 'D.N.I.') - 1 AS INT) AS char_start FROM y
UNION ALL SELECT o_orderkey, 'CARNE_EXTRANJERIA', lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), CAST(strpos(text, 'Carné') - 1 AS INT) FROM y""")
def _(t):
    x = t.sql(f"WITH x AS (SELECT o_orderkey, o_custkey, {NAME} AS name_a FROM orders) SELECT o_orderkey, {IDS} AS text FROM x")
    return references.identifiers(x, "o_orderkey").select("o_orderkey", "scheme", "value", "char_start")


@query("fn_25_identifiers_of_name", f"SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'DNI' ELSE 'CARNE_EXTRANJERIA' END AS scheme, CASE o_orderkey % 2 WHEN 0 THEN lpad(CAST(o_custkey AS VARCHAR), 8, '1') ELSE lpad(CAST(o_orderkey AS VARCHAR), 9, '0') END AS value FROM orders")
def _(t):
    x = t.sql(f"WITH x AS (SELECT o_orderkey, o_custkey, {NAME} AS name_a FROM orders) SELECT o_orderkey, {IDS} AS text, CASE o_orderkey % 2 WHEN 0 THEN name_a ELSE 'LUIS PAZ ROJAS' END AS name FROM x")
    return references.identifiers(x, "o_orderkey", "name").select("o_orderkey", "scheme", "value")


@query("fn_26_organization_path", "SELECT o_orderkey, 'Jefa de Archivo ' || o_custkey AS role, 'Oficina de Archivo > Oficina General de Gestión' AS unit, CASE o_orderkey % 2 WHEN 0 THEN 'Ministerio de la Producción' END AS organization FROM orders")
def _(t):
    x = t.sql("SELECT o_orderkey, 'Jefa de Archivo ' || o_custkey || ' de la Oficina de Archivo de la Oficina General de Gestión' || CASE o_orderkey % 2 WHEN 0 THEN ' del Ministerio de la Producción' ELSE '' END AS text FROM orders")
    return references.paths(x, "o_orderkey")


CLAIMS = """
SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN substr(text, 5, 20) WHEN 1 THEN upper(substr(text, 5, 20)) WHEN 2 THEN substr(text, 5, 8) ELSE substr(text, 3, 40) END AS quote,
  CASE WHEN conv_id % 5 = 0 THEN 'BELIEVES' WHEN conv_id % 5 = 1 THEN 'MENTIONS' ELSE 'SIGNED' END AS predicate FROM conversations"""


@query("ex_20_quoted_paragraph", f"""
WITH c AS ({CLAIMS}), p AS (SELECT *, list_position(list_transform(string_split(text, chr(10)), lambda x: strpos(x, quote) > 0), true) - 1 AS place FROM c)
SELECT conv_id, turn, quote, CASE WHEN predicate = 'BELIEVES' THEN 'unknown predicate' WHEN predicate = 'MENTIONS' THEN 'reserved predicate' WHEN coalesce(length(quote), 0) < 15 THEN 'short quote' WHEN coalesce(place, -1) < 0 THEN 'not literal' ELSE 'verified' END AS outcome,
  CASE WHEN predicate = 'SIGNED' AND length(quote) >= 15 AND place >= 0 THEN CAST(place AS INT) END AS paragraph FROM p""")
def _(t):
    shouted = N.upper_by_character(F.substr("text", F.lit(5), F.lit(20)))
    x = t.sql(CLAIMS).withColumn("quote", F.when(F.col("turn") % 4 == 1, shouted).otherwise(F.col("quote"))).withColumn("paragraphs", F.split("text", "\n"))
    return claims.verify(x, ("SIGNED", "HOLDS"), ("MENTIONS",)).select("conv_id", "turn", "quote", "outcome", "paragraph")


@query("jn_25_recital_matches", """
SELECT e.event_id, c.person_id, c.label IS NOT DISTINCT FROM e.label AS same_position FROM (SELECT end_event_id - 1 AS event_id, min(label) AS label FROM assignment WHERE end_event_id IS NOT NULL GROUP BY 1) e
JOIN (SELECT l_orderkey * 2 AS event_id, l_suppkey AS person_id, 'CARGO ' || CAST(l_suppkey % 12 AS STRING) AS label FROM lineitem WHERE l_quantity > 35) c ON c.event_id = e.event_id""")
def _(t):
    return claims.recital_matches(*recital_tables(t)).select("event_id", "person_id", "same_position")


CITED = "CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey % 3 AS STRING) || '-2025' END"


def recital_tables(t):
    ended = t.sql("SELECT end_event_id - 1 AS event_id, min(label) AS label, array('0-2025', '1-2025') AS cited FROM assignment WHERE end_event_id IS NOT NULL GROUP BY 1")
    found = t.sql(f"SELECT l_orderkey * 2 AS event_id, l_suppkey AS person_id, 'CARGO ' || CAST(l_suppkey % 12 AS STRING) AS label, {CITED} AS cited_number FROM lineitem WHERE l_quantity > 35")
    return ended, found


@query("ag_09_recital_verdict", f"""
WITH c AS (SELECT l_orderkey * 2 AS event_id, 'CARGO ' || CAST(l_suppkey % 12 AS STRING) AS label, {CITED} AS cited FROM lineitem WHERE l_quantity > 35),
g AS (SELECT event_id, count(*) AS n, min(label) AS label, min(cited) AS cited FROM c GROUP BY 1)
SELECT e.event_id, CASE WHEN g.n IS NULL THEN 'UNCONFIRMED' WHEN g.n > 1 THEN 'CONFLICT' WHEN g.label IS DISTINCT FROM e.label THEN 'UNCONFIRMED' WHEN g.cited NOT IN ('0-2025', '1-2025') THEN 'CONFLICT' ELSE 'CORROBORATED' END AS verdict
FROM (SELECT end_event_id - 1 AS event_id, min(label) AS label FROM assignment WHERE end_event_id IS NOT NULL GROUP BY 1) e LEFT JOIN g ON g.event_id = e.event_id""")
def _(t):
    return claims.recital_verdict(*recital_tables(t)).select("event_id", "verdict")


@query("ex_18_position_repair", """
WITH k AS (SELECT position_id, count(DISTINCT organization_id) AS n, min(organization_id) AS only FROM assignment WHERE superseded_at IS NULL GROUP BY 1)
SELECT a.assignment_id, CASE WHEN k.n = 1 THEN 'FILLED' WHEN k.n > 1 THEN 'AMBIGUOUS' ELSE 'NO_ISSUER' END AS outcome, CASE WHEN k.n = 1 THEN k.only END AS organization_id
FROM assignment a LEFT JOIN k ON k.position_id = a.position_id WHERE a.organization_id IS NULL AND a.superseded_at IS NULL""")
def _(t):
    return repair.fill_from_consensus(t.assignment.where("superseded_at is null"), "assignment_id", "position_id", "organization_id")


@query("ex_18_legal_date_backfill", """
SELECT a.assignment_id, CASE WHEN a.valid_from IS NOT NULL OR a.legal_from IS NOT NULL THEN 'DATED' WHEN e.event_id IS NULL THEN 'NO_EVENT' WHEN e.published_on IS NULL THEN 'NO_DATE' ELSE 'FILLED' END AS outcome,
  CASE WHEN a.valid_from IS NULL AND a.legal_from IS NULL THEN e.published_on END AS legal_from FROM assignment a LEFT JOIN event e ON e.event_id = a.start_event_id""")
def _(t):
    return repair.backfill_dates(t.assignment, t.event.select("event_id", "published_on"))


@query("ex_18_issue_link_backfill", """
WITH d AS (SELECT document_id, count(DISTINCT published_on) AS n, min(published_on) AS only FROM event GROUP BY 1)
SELECT e.event_id, CASE WHEN d.n = 1 THEN 'FILLED' WHEN d.n > 1 THEN 'AMBIGUOUS' ELSE 'NO_ISSUER' END AS outcome, CASE WHEN d.n = 1 THEN d.only END AS published_on FROM event e JOIN d ON d.document_id = e.document_id WHERE e.published_on IS NULL""")
def _(t):
    return repair.fill_from_consensus(t.event, "event_id", "document_id", "published_on")


@query("ex_18_event_counts", "SELECT d.document_id, d.said, coalesce(c.n, 0) AS n, CASE WHEN d.said = coalesce(c.n, 0) THEN 'SAME' ELSE 'CORRECTED' END AS outcome FROM (SELECT DISTINCT o_orderkey % 3000 AS document_id, (o_orderkey % 3000) % 7 AS said FROM orders) d LEFT JOIN (SELECT document_id, count(*) AS n FROM event GROUP BY 1) c ON c.document_id = d.document_id")
def _(t):
    said = t.sql("SELECT DISTINCT o_orderkey % 3000 AS document_id, (o_orderkey % 3000) % 7 AS said FROM orders")
    return repair.recount(said, "document_id", "said", t.event)


@query("snk_02_verified_read", "SELECT item_id, sha256(text) AS sha FROM benchmark WHERE item_id % 3 < 2")
def _(t):
    stored = t.sql("SELECT item_id, text AS content, CASE WHEN item_id % 3 < 2 THEN sha2(text, 256) ELSE sha2(concat(text, '!'), 256) END AS sha FROM benchmark")
    return stored.where(N.sha256(F.col("content")) == F.col("sha")).select("item_id", "sha")


@query("fn_32_evidence_integrity", "SELECT mention_id, CASE WHEN mention_id % 7 = 0 THEN 'shifted' WHEN mention_id % 7 = 1 THEN 'altered' ELSE 'intact' END AS state FROM mention")
def _(t):
    x = t.sql("SELECT mention_id, 'Designar a ' || name || ' en el cargo' AS section, CASE WHEN mention_id % 7 = 1 THEN lower(name) || '.' ELSE name END AS quote, CASE WHEN mention_id % 7 = 0 THEN 10 ELSE 11 END AS char_start FROM mention")
    return x.select("mention_id", claims.highlight_state(F.col("section"), F.col("quote"), F.col("char_start")).alias("state"))


@query("fn_21_table_cells", """
SELECT o_orderkey, place, cell, CAST(char_start AS INT) AS char_start, CAST(char_start + length(cell) AS INT) AS char_end FROM (
  SELECT o_orderkey, unnest([0, 1, 2]) AS place, unnest([CAST(o_orderkey AS VARCHAR), o_clerk, o_orderstatus]) AS cell, unnest([0, length(CAST(o_orderkey AS VARCHAR)) + 3, length(CAST(o_orderkey AS VARCHAR)) + length(o_clerk) + 6]) AS char_start FROM (SELECT *, 'C' || o_custkey AS o_clerk FROM orders))""")
def _(t):
    rows = t.sql("SELECT o_orderkey, o_orderkey || ' | C' || o_custkey || ' | ' || o_orderstatus AS text FROM orders")
    return rows.select("o_orderkey", F.posexplode(references.cells(F.col("text"))).alias("place", "c")).select("o_orderkey", "place", "c.cell", "c.char_start", "c.char_end")


@query("fn_34_entity_decode", "SELECT page_id, sha256(regexp_replace(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')) AS sha FROM pages")
def _(t):
    return references.unescaped(t.pages, "page_id", "html").select("page_id", N.sha256(F.col("text")).alias("sha"))


@query("mut_12_succession_links", "SELECT org_id, lag(org_id) OVER (PARTITION BY name ORDER BY org_id) AS previous FROM org WHERE org_id % 3 > 0")
def _(t):
    kept = t.org.where("org_id % 3 > 0").select("org_id", "name")
    return kept.select("org_id", F.lag("org_id").over(Window.partitionBy("name").orderBy("org_id")).alias("previous"))


@query("wn_12_signature_groups", """
WITH x AS (SELECT conv_id, turn, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS island FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, row_number() OVER v AS nth, max(CASE WHEN row_number_ = 1 THEN 0 WHEN length(text) > 120 OR regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END) OVER v AS closed,
  sum(CASE WHEN row_number_ = 1 THEN 0 ELSE length(text) + 2 END) OVER v AS total FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) AS row_number_ FROM x WHERE island > 0) WINDOW v AS (PARTITION BY conv_id, island ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, island, coalesce(string_agg(text, ', ' ORDER BY turn) FILTER (row_number_ > 1 AND closed = 0 AND total - 2 <= 380), '') AS capacity FROM y GROUP BY 1, 2""")
def _(t):
    x = t.conversations.select("conv_id", "turn", "text", (F.col("role") == "user").alias("is_name"))
    return references.signature_groups(x, "conv_id", "turn").select("conv_id", "island", "capacity")
