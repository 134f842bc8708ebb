"""Scalar functions, filters and classifiers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import classify as C
from factloom.functions import normalize as N
from factloom.plans.registry import query

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'), ' ')"


def up(x: str) -> str:
    return f"upper({ws(f'strip_accents({x})')})"


def dash(x: str) -> str:
    return f"rtrim(regexp_replace({up(x)}, '\\s*-\\s*', '-', 'g'), '.')"


@query("fn_01_collapse_whitespace", f"SELECT doc_id, {ws('text')} AS clean FROM documents")
def _(t):
    return t.documents.select("doc_id", N.collapse_whitespace(F.col("text")).alias("clean"))


@query("fn_02_strip_accents", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def _(t):
    return t.documents.select("doc_id", N.strip_accents(F.col("text")).alias("plain"))


@query("fn_03_person_name", r"""
SELECT person_id, CASE WHEN length(s) > 0 AND length(g) > 0 THEN g || ' ' || s ELSE u END AS name FROM (
  SELECT person_id, u, trim(split_part(u, ',', 1)) AS s, CASE WHEN strpos(u, ',') > 0 THEN trim(split_part(u, ',', 2)) ELSE '' END AS g
  FROM (SELECT person_id, CASE WHEN person_id % 2 = 0 THEN split_part(name, ' ', 2) || ', ' || split_part(name, ' ', 1) ELSE name END AS u FROM person))""")
def _(t):
    raw = t.sql("SELECT person_id, CASE WHEN person_id % 2 = 0 THEN split_part(lower(name), ' ', 2) || ' ,  ' || split_part(name, ' ', 1) ELSE name END AS raw FROM person")
    return raw.select("person_id", N.person_name(F.col("raw")).alias("name"))


@query("fn_04_name_tokens", "SELECT person_id, len(string_split(name, ' ')) AS n_tokens, string_split(name, ' ')[-1] AS last FROM person")
def _(t):
    x = t.person.select("person_id", N.tokens(F.col("name")).alias("t"))
    return x.select("person_id", F.size("t").cast("long").alias("n_tokens"), F.element_at("t", -1).alias("last"))


@query("fn_06_identifier", r"SELECT mention_id, upper(regexp_replace(scheme || ' ' || value, '[\s.\-]', '', 'g')) AS id FROM mention")
def _(t):
    return t.mention.select("mention_id", N.identifier(F.concat_ws(" ", "scheme", "value")).alias("id"))


@query("fn_07_organization_name", f"SELECT item_id, {dash('label')} AS name FROM label")
def _(t):
    return t.label.select("item_id", N.organization_name(F.col("label")).alias("name"))


@query("fn_08_position_label", f"SELECT item_id, {dash('label')} AS label FROM label")
def _(t):
    return t.label.select("item_id", N.position_label(F.col("label")).alias("label"))


@query("fn_09_document_number", rf"SELECT item_id, upper(replace(regexp_replace({ws('number')}, '(?i)^\s*(?:n\s*[º°oO]\.?|n\.\s*[º°]|num(?:ero)?\.?)\s*', ''), ' ', '')) AS number FROM number")
def _(t):
    return t.number.select("item_id", N.document_number(F.col("number")).alias("number"))


@query("fn_10_spanish_date", "SELECT item_id, CAST(o_orderdate AS DATE) AS stated FROM dateline")
def _(t):
    return t.dateline.select("item_id", N.spanish_date(F.col("line")).alias("stated"))


@query("fn_11_issue_line", "SELECT item_id, split_part(line, ',', 1) AS place, CAST(o_orderdate AS DATE) AS issued_on FROM dateline")
def _(t):
    return t.dateline.select("item_id", F.inline(F.array(N.issue_line(F.col("line")))))


@query("fn_12_slashed_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders")
def _(t):
    raw = F.when(F.col("o_orderkey") % 7 == 0, "31/02/2026").otherwise(F.concat(F.lit("el "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" en Lima")))
    return t.orders.select("o_orderkey", N.slashed_date(raw).alias("d"))


@query("fn_13_effective_dates", """
SELECT assignment_id, coalesce(valid_from, legal_from) AS eff_start, CASE WHEN valid_from IS NOT NULL THEN 'source' WHEN legal_from IS NOT NULL THEN 'legal_rule' END AS eff_start_basis,
  coalesce(valid_to, legal_to) AS eff_end, CASE WHEN valid_to IS NOT NULL THEN 'source' WHEN legal_to IS NOT NULL THEN 'legal_rule' END AS eff_end_basis FROM assignment""")
def _(t):
    from factloom.operators.temporal import with_effective

    return with_effective(t.assignment).select("assignment_id", "eff_start", "eff_start_basis", "eff_end", "eff_end_basis")


OFFICE_SQL = f"""
SELECT item_id, CASE WHEN regexp_matches(u, '^PRESIDENT[EA] DE LA REPUBLICA$') THEN 'PRESIDENCIA_DE_LA_REPUBLICA'
  WHEN regexp_matches(u, '^PRESIDENT[EA] DEL CONSEJO DE MINISTROS$') THEN 'PRESIDENCIA_DEL_CONSEJO_DE_MINISTROS'
  WHEN regexp_matches(u, '^MINISTR[OA] DE') THEN 'MINISTERIO::' || regexp_replace(regexp_extract(u, '^MINISTR[OA] DE(?:L)?\\s+(?:ESTADO EN EL DESPACHO DE(?:L)?\\s+)?(.+)$', 1), '^(?:LA|EL|LOS|LAS)\\s+', '')
  WHEN regexp_matches(u, '^CONTRALORA? GENERAL DE LA REPUBLICA$') THEN 'CONTRALORIA_GENERAL' WHEN regexp_matches(u, '^DEFENSORA? DEL PUEBLO$') THEN 'DEFENSORIA_DEL_PUEBLO'
  WHEN regexp_matches(u, '^FISCAL DE LA NACION$') THEN 'FISCALIA_DE_LA_NACION' END AS office FROM (SELECT item_id, {dash('label')} AS u FROM label)"""


@query("fn_14_singular_office", OFFICE_SQL)
def _(t):
    return t.label.select("item_id", N.singular_office(N.position_label(F.col("label"))).alias("office"))


@query("fn_15_structural_title", rf"""
SELECT item_id, nullif(regexp_extract(u, '^[A-Z]+ DEL? (SISTEMA ADMINISTRATIVO|PROGRAMA SECTORIAL) [IVXL]+', 1), '') AS family, nullif(regexp_extract(u, '^[A-Z]+ DEL? (SISTEMA ADMINISTRATIVO|PROGRAMA SECTORIAL) ([IVXL]+)', 2), '') AS level FROM (SELECT item_id, {dash('label')} AS u FROM label)""")
def _(t):
    return t.label.select("item_id", F.inline(F.array(N.structural_title(N.position_label(F.col("label"))))))


URL_SQL = """SELECT page_id, lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)', 1)) || regexp_extract(regexp_replace(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*', ''), '^([^?]*)', 1)
  || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS url FROM (
  SELECT page_id, u, list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|fbclid|gclid|yclid|mc_cid|mc_eid|ref_src)')) AS k
  FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM url))"""


@query("fn_16_canonical_url", URL_SQL)
def _(t):
    return t.sql("SELECT * FROM url").select("page_id", N.canonical_url(F.col("url")).alias("url"))


@query("fn_17_web_code", f"SELECT page_id, substr(sha256(url), 1, 16) AS code FROM ({URL_SQL})")
def _(t):
    return t.sql("SELECT * FROM url").select("page_id", N.web_code(F.col("url")).alias("code"))


@query("fn_18_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def _(t):
    return t.documents.select("doc_id", N.sha256(F.col("text")).alias("sha"))


CITED = "SELECT o_orderkey, 'Mediante Resolución Suprema Nº ' || CAST(o_custkey AS STRING) || '-2026-EF y la Ley ' || CAST(o_orderkey % 30 + 100 AS STRING) || ', otra vez la ley ' || CAST(o_orderkey AS STRING) AS text FROM orders"


@query("fn_19_norm_citations", "SELECT o_orderkey, unnest(['Resolución Suprema', 'Ley']) AS kind, unnest([CAST(o_custkey AS STRING) || '-2026-EF', CAST(o_orderkey % 30 + 100 AS STRING)]) AS number FROM orders")
def _(t):
    return t.sql(CITED).select("o_orderkey", F.explode(N.norm_citations(F.col("text"))).alias("c")).select("o_orderkey", "c.kind", "c.number")


@query("fn_20_bare_number", r"SELECT item_id, nullif(upper(regexp_extract(number, '(\d[\dA-Za-z./-]*[\dA-Za-z]|\d)', 1)), '') AS number FROM number")
def _(t):
    return t.number.select("item_id", N.bare_number(F.col("number")).alias("number"))


@query("fn_23_identity_cell", r"SELECT o_orderkey, CASE WHEN regexp_matches(c, '^\d{8}$') THEN c END AS dni FROM (SELECT o_orderkey, lpad(CAST(o_custkey * 7919 AS STRING), CAST(7 + o_orderkey % 3 AS INT), '0') AS c FROM orders)")
def _(t):
    cell = t.sql("SELECT o_orderkey, ' ' || lpad(CAST(o_custkey * 7919 AS STRING), CAST(7 + o_orderkey % 3 AS INT), '0') || ' ' AS c FROM orders")
    x = F.trim("c")
    return cell.select("o_orderkey", F.when(x.rlike(r"^\d{8}$"), x).alias("dni"))


@query("fn_27_strip_clauses", r"""
SELECT item_id, rtrim(trim(regexp_replace(role, '(?i)[;,]?\s*d[áa]ndosele?s? las gracias.*$', '')), '.;,') AS no_thanks,
  rtrim(trim(regexp_replace(regexp_replace(role, '(?i)[,;]\s*(?:y\s+)?bajo el r[ée]gimen\b.*$', ''), '\s*[-–—]\s*Director de Sistema Administrativo [IVXL]+\s*$', '')), '.;,') AS no_admin,
  CASE WHEN role LIKE '%CAP Provisional%' THEN 'CAP_PROVISIONAL' END AS scheme, CASE WHEN role LIKE '%CAP Provisional%' THEN '123' END AS code,
  regexp_replace(role, ', identificada con DNI N° \d+', '') AS no_identity FROM role""")
def _(t):
    r = F.col("role")
    x = t.role.select("item_id", N.strip_thanks(r).alias("no_thanks"), N.strip_admin_clauses(r).alias("no_admin"), N.staffing_slot(r).alias("slot"), N.strip_identity_clause(r).alias("no_identity"))
    return x.select("item_id", "no_thanks", "no_admin", "slot.scheme", "slot.code", "no_identity")


@query("fn_28_clause_split", "SELECT item_id, unnest(string_split(role, '; asimismo, ')) AS clause FROM role")
def _(t):
    return t.role.select("item_id", F.explode(N.clauses(F.col("role"))).alias("clause"))


EFFECT_SQL = """
SELECT event_id, CASE WHEN stated <> 'NOT_STATED' OR basis IS NULL THEN 'NOT_APPLICABLE' WHEN authority <> 'OFFICIAL_GAZETTE' OR published_on IS NULL OR coalesce(deferred, '') = 'INDETERMINATE' THEN 'VETOED' ELSE 'DETERMINED' END AS outcome,
  CASE WHEN stated = 'NOT_STATED' AND basis IS NOT NULL AND authority = 'OFFICIAL_GAZETTE' AND coalesce(deferred, '') <> 'INDETERMINATE' THEN CAST(published_on + INTERVAL (CASE WHEN deferred IS NULL THEN 0 ELSE 1 END) DAY AS DATE) END AS effect_from,
  CASE WHEN stated = 'NOT_STATED' THEN basis END AS basis
FROM (SELECT *, CASE WHEN event_type IN ('DESIGNATION', 'APPOINTMENT') THEN 'Ley N.º 27594, artículo 6' WHEN event_type <> 'ACTING_ASSIGNMENT' THEN 'D.S. N.º 040-2014-PCM, artículo 233.3' END AS basis FROM event)"""


@query("fn_29_legal_effect", EFFECT_SQL)
def _(t):
    v = C.legal_effect(*(F.col(c) for c in ("event_type", "stated", "published_on", "authority", "deferred")))
    return t.event.select("event_id", F.inline(F.array(v)))


KIND_SQL = "CASE WHEN regexp_matches(text, '(?i)d[íi]a\\s+h[áa]bil\\s+siguiente|posterg\\w+\\s+(?:su\\s+)?vigencia') THEN 'INDETERMINATE' WHEN regexp_matches(text, '(?i)d[íi]a\\s+siguiente\\s+de su publicaci[óo]n') THEN 'DAY_AFTER_PUBLICATION' END"


@query("fn_30_deferral_clause", f"""
SELECT document_id, arg_min(kind, ROW(order_index, kind)) AS kind, min(order_index) AS order_index FROM (SELECT document_id, order_index, {KIND_SQL} AS kind FROM section) WHERE kind IS NOT NULL GROUP BY document_id""")
def _(t):
    x = t.section.select("document_id", "order_index", C.deferral_kind(F.col("text")).alias("kind")).where("kind is not null")
    return x.groupBy("document_id").agg(F.min_by("kind", F.struct("order_index", "kind")).alias("kind"), F.min("order_index").alias("order_index"))


@query("fn_31_effect_payload", f"SELECT event_id, '{{\"outcome\":\"' || outcome || '\"' || CASE WHEN effect_from IS NOT NULL THEN ',\"effect_from\":\"' || strftime(effect_from, '%Y-%m-%d') || '\"' ELSE '' END || '}}' AS payload FROM ({EFFECT_SQL})")
def _(t):
    v = C.legal_effect(*(F.col(c) for c in ("event_type", "stated", "published_on", "authority", "deferred")))
    x = t.event.select("event_id", v.alias("v"))
    return x.select("event_id", F.to_json(F.struct("v.outcome", "v.effect_from")).alias("payload"))


@query("fn_33_document_type", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'RESOLUCION_SUPREMA' WHEN 1 THEN 'RESOLUCION_MINISTERIAL' WHEN 2 THEN 'DECRETO_SUPREMO' ELSE 'OTHER' END AS type FROM orders")
def _(t):
    return t.sql("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'rs' WHEN 1 THEN 'RM' WHEN 2 THEN 'DS' ELSE 'XX' END AS code FROM orders").select("o_orderkey", N.document_type(F.col("code")).alias("type"))


@query("fn_35_url_parts", "SELECT page_id, regexp_extract(url, '://([^/?#:]*)', 1) AS host, substr(url, 1, 20) AS preview FROM pages")
def _(t):
    return t.pages.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.substring("url", 1, 20).alias("preview"))


# Filters and classifiers


@query("flt_01_live", "SELECT assignment_id FROM assignment WHERE superseded_at IS NULL")
def _(t):
    from factloom.operators.temporal import live

    return live(t.assignment).select("assignment_id")


@query("flt_02_not_merged", "SELECT person_id, name FROM person WHERE merged_into IS NULL")
def _(t):
    return t.person.where("merged_into is null").select("person_id", "name")


COVER = "DATE '1998-01-01'"


@query("flt_03_may_cover", f"SELECT assignment_id FROM assignment WHERE NOT coalesce(coalesce(valid_from, legal_from) > {COVER}, false) AND NOT coalesce(coalesce(valid_to, legal_to) < {COVER}, false)")
def _(t):
    from factloom.operators.temporal import may_cover, with_effective

    return with_effective(t.assignment).where(may_cover(F.col("eff_start"), F.col("eff_end"), F.lit("1998-01-01").cast("date"))).select("assignment_id")


@query("flt_04_covers", f"SELECT assignment_id FROM assignment WHERE coalesce(valid_from, legal_from) <= {COVER} AND (coalesce(valid_to, legal_to) IS NULL OR coalesce(valid_to, legal_to) >= {COVER})")
def _(t):
    from factloom.operators.temporal import covers, with_effective

    return with_effective(t.assignment).where(covers(F.col("eff_start"), F.col("eff_end"), F.lit("1998-01-01").cast("date"))).select("assignment_id")


@query("flt_05_prefix_search", "SELECT person_id, name FROM person WHERE strpos(' ' || name, ' RE') > 0 AND strpos(' ' || name, ' B') > 0")
def _(t):
    return t.person.where(C.prefix_search(F.col("name"), F.array(F.lit("RE"), F.lit("B")))).select("person_id", "name")


@query("flt_06_substring_search", "SELECT DISTINCT conv_id FROM conversations WHERE strpos(lower(text), 'tion') > 0")
def _(t):
    return t.conversations.where(F.lower("text").contains("tion")).select("conv_id").distinct()


RELEVANT = r"""CASE WHEN regexp_matches(u, '\b(DESIGNAN|DESIGNASE|NOMBRAN|NOMBRASE|ENCARGAN)\b|\bACEPTAN\s+(?:LA\s+)?RENUNCIA\b|\bDAN\s+POR\s+CONCLUID[AO]\b|\bDEJAN\s+SIN\s+EFECTO\s+(?:LA\s+)?DESIGNACION(?:ES)?\b|\bDECLARAN\s+VACANCIA\b') THEN 'RELEVANT'
  WHEN regexp_matches(u, '^(APRUEBAN|AUTORIZAN|RECTIFICAN|MODIFICAN|PRORROGAN|CONFIRMAN|REVOCAN|RESUELVEN)\b|^DISPONEN\s+LA\s+(NOTIFICACION|PUBLICACION)\b|^DECLARAN\s+(NUL[AO]|FUNDAD[AO]|INFUNDAD[AO]|IMPROCEDENTE|INADMISIBLE)\b|^INTEGRAN\s+CREDENCIAL(?:ES)?\b') THEN 'NOT_RELEVANT' ELSE 'UNDECIDED' END"""


@query("flt_09_relevance", f"SELECT item_id, {RELEVANT} AS relevance FROM (SELECT item_id, {up('summary')} AS u FROM summary)")
def _(t):
    return t.summary.select("item_id", C.relevance(F.col("summary"))["relevance"].alias("relevance"))


@query("flt_10_event_type_limit", "SELECT event_id, event_type FROM event WHERE event_type = 'DESIGNATION' ORDER BY event_id LIMIT 50")
def _(t):
    return t.event.where("event_type = 'DESIGNATION'").select("event_id", "event_type").orderBy("event_id").limit(50)


@query("flt_11_polymorphic_target", "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    targets = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return t.events.where("event_type = 'click'").join(targets, "user_id", "left_semi").select("event_id", "user_id")


@query("flt_12_listed_date_mismatch", "SELECT o_orderkey, o_orderdate <> TIMESTAMP '1998-01-01' AND o_orderkey % 5 > 0 AS vetoed FROM orders")
def _(t):
    listed = F.when(F.col("o_orderkey") % 5 == 0, "sin fecha").otherwise(F.concat(F.lit("Fecha: "), F.date_format("o_orderdate", "dd.MM.yyyy")))
    d = F.try_to_date(F.regexp_extract(listed, r"(\d{2}\.\d{2}\.\d{4})", 1), "dd.MM.yyyy")
    return t.orders.select("o_orderkey", F.coalesce(d != F.lit("1998-01-01").cast("date"), F.lit(False)).alias("vetoed"))


@query("flt_13_failure_status", """
SELECT item_id, CASE WHEN http_status IN (404, 408, 409, 425, 429, 500, 502, 503, 504) OR kind IN ('network', 'database') THEN 'RETRY_PENDING' WHEN kind IN ('parse', 'capture', 'data') OR http_status IS NOT NULL THEN 'FAILED' ELSE 'RETRY_PENDING' END AS status FROM failure""")
def _(t):
    return t.failure.select("item_id", C.failure_status(F.col("http_status"), F.col("kind")).alias("status"))


@query("flt_14_contamination", f"SELECT item_id, CASE WHEN strpos(u, 'BAJO EL REGIMEN') > 0 THEN 'BAJO EL REGIMEN' WHEN strpos(u, 'DE SISTEMA ADMINISTRATIVO') > 0 THEN 'DE SISTEMA ADMINISTRATIVO' END AS fragment FROM (SELECT item_id, {dash('role')} AS u FROM role)")
def _(t):
    return t.role.select("item_id", N.contamination(N.organization_name(F.col("role"))).alias("fragment"))


@query("flt_15_uncatalogued", "SELECT item_id, label FROM label WHERE label LIKE 'Ministr%' AND label NOT IN ('Ministro del Interior')")
def _(t):
    known = t.spark.createDataFrame([("Ministro del Interior",)], "label string")
    return t.label.where(F.col("label").startswith("Ministr")).join(known, "label", "left_anti").select("item_id", "label")


@query("flt_16_looks_like_person", r"SELECT person_id, len(string_split(name, ' ')) BETWEEN 2 AND 8 AND NOT regexp_matches(name, '\d') AS yes FROM person")
def _(t):
    return t.person.select("person_id", N.looks_like_person(F.col("name")).alias("yes"))


@query("flt_17_context_predicate", "SELECT event_id, event_type IN ('view', 'click') AND starts_with(event_type, 'v') AS yes FROM events")
def _(t):
    return t.events.select("event_id", (F.col("event_type").isin("view", "click") & F.col("event_type").startswith("v")).alias("yes"))


@query("flt_18_json_attribute", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50""")
def _(t):
    k = F.variant_get(F.parse_json("props"), "$.k", "long")
    return t.events.select("event_id", k.alias("k")).where("k > 50")


@query("ex_10_article_class", f"""
SELECT document_id, order_index, CASE WHEN document_id % 5 = 0 THEN 'EVENT' WHEN text LIKE '%refrendada por%' THEN 'COUNTERSIGNATURE' WHEN text LIKE '%Declaración Jurada%' THEN 'SWORN_DECLARATION' WHEN {KIND_SQL} IS NOT NULL THEN 'EFFECTIVE_DATE_CLAUSE'
  WHEN text LIKE 'Publicar la presente%' THEN 'PUBLICATION_NOTICE' WHEN text LIKE 'Notificar la presente%' THEN 'NOTIFICATION' ELSE 'OTHER' END AS class FROM section""")
def _(t):
    return t.section.select("document_id", "order_index", C.article_class(F.col("text"), F.col("document_id") % 5 == 0).alias("class"))
