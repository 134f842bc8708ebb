"""The domain's tables as views of the test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MONTHS = "enero febrero marzo abril mayo junio julio agosto setiembre octubre noviembre diciembre".split()


def days(column: str, n: int) -> str:
    return f"CAST(CAST({column} AS DATE) + INTERVAL '{n}' DAY AS DATE)"


def pick(key: str, values: list[str]) -> str:
    """One of the values by key modulo their number."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def texts(key: str, values: list[str]) -> str:
    return pick(key, ["'" + v.replace("'", "''") + "'" for v in values])


SUMMARIES = [
    "Designan Directora General de Administración", "Aprueban el Plan Operativo Institucional", "Aceptan renuncia de Jefe de Gabinete", "Autorizan viaje de funcionaria a Chile",
    "Dejan sin efecto designación y designan fedatarios", "Dan por concluída designación", "Confirman la resolución del Jurado", "Declaran nula la resolución", "Declaran vacancia del cargo de regidor",
    "Disponen la publicación del proyecto de norma", "Encargan funciones  de Secretaria General", "Modifican el Reglamento de Organización", "Otorgan subvención", "Nómbrase a docentes", "Nombran Viceministro", "Integran credenciales de consejeros",
]
LABELS = [
    "Ministra de Estado en el Despacho de la Producción", "Presidenta de la República", "Jefe de la Oficina General -CENEPRED", "Directora del Sistema Administrativo II", "Ministro del Interior",
    "Defensor del Pueblo", "Asesor de Programa Sectorial IV de la Alta Dirección", "Presidente del Consejo de Ministros", "Fiscal de la Nación", "Contralora General de la República", "Gerente General.", "Secretaria  Técnica – SERVIR",
]
SECTIONS = [
    "La presente resolución entra en vigencia el día siguiente de su publicación.", "Regirá a partir del día hábil siguiente de la publicación.", "Publicar la presente resolución en el diario oficial.",
    "Es refrendada por el Ministro de Economía.", "La designación se posterga su vigencia hasta nuevo aviso.", "Presentar la Declaración Jurada de ingresos.", "Notificar la presente resolución al interesado.", "Encargar el cumplimiento.",
]
ROLES = [
    "Directora de la Oficina; dándosele las gracias por los servicios prestados.", "Jefe del Área, bajo el régimen de la Ley N° 30057", "Asesora del Ministerio - Director de Sistema Administrativo II",
    "ANA ROJAS DIAZ, identificada con DNI N° 09342789", "Analista, prevista en el CAP Provisional con número correlativo 123", "Dar por concluido X; asimismo, designar a Y", "Especialista II",
]
NUMBERS = ["Nº D000284-2026-MIDAGRI-DM", "nº 027-2026-ef", "N.° 044 - 2025-EF", "Num. 12-2024/PCM", "No. 55-2023-IN", "299-2026-VIVIENDA", "numero 7-2022"]

ADAPTERS = {
    "person": """
SELECT c_custkey AS person_id, CASE WHEN c_custkey % 10 = 3 AND c_custkey > 10 THEN c_custkey - 3 WHEN c_custkey % 10 = 0 AND c_custkey > 10 THEN c_custkey - 10 END AS merged_into,
  CASE WHEN c_custkey % 3 = 0 THEN split_part(upper(a.p_name), ' ', 2) || ' ' || upper(b.p_name) ELSE upper(a.p_name) || ' ' || upper(b.p_name) END AS name,
  c_nationkey AS nation_id
FROM customer JOIN part a ON a.p_partkey = c_custkey % 40 JOIN part b ON b.p_partkey = (c_custkey * 7 + 3) % 60""",
    "mention": """
SELECT o_orderkey AS mention_id, o_orderkey % 3000 AS document_id, name, o_orderpriority AS role, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS person_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'dni' ELSE 'ce' END AS scheme, CAST(o_custkey % 900 AS STRING) || '-' || CAST(o_orderkey % 5 AS STRING) AS value
FROM orders JOIN person ON person_id = o_custkey""",
    "assignment": f"""
SELECT o_orderkey AS assignment_id, o_custkey % 1400 AS position_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 25 END AS organization_id, o_custkey % 700 AS person_id, o_orderkey AS mention_id,
  'CARGO ' || CAST(o_custkey % 12 AS STRING) AS label,
  CASE WHEN o_orderpriority < '3' OR o_orderkey % 9 = 0 THEN CAST(o_orderdate AS DATE) END AS valid_from, CASE WHEN o_orderstatus = 'F' THEN {days('o_orderdate', 120)} END AS valid_to,
  CASE WHEN o_orderpriority >= '3' AND o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS legal_from, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN {days('o_orderdate', 200)} END AS legal_to,
  CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate END AS superseded_at, o_orderdate AS recorded_at,
  CASE WHEN o_orderkey % 3 <> 1 THEN o_orderkey * 2 END AS start_event_id, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey * 2 + 1 END AS end_event_id
FROM orders""",
    "question": """
SELECT DISTINCT c_custkey % 1410 AS position_id, d.on_date FROM customer CROSS JOIN (VALUES (DATE '1996-06-30'), (DATE '1997-12-31'), (DATE '1999-03-15')) AS d(on_date)""",
    "summary": f"SELECT o_orderkey AS item_id, {texts('o_orderkey', SUMMARIES)} || CASE WHEN o_orderkey % 5 = 0 THEN ' del Perú' ELSE '' END AS summary FROM orders",
    "label": f"SELECT o_orderkey AS item_id, {texts('o_orderkey', LABELS)} AS label FROM orders",
    "dateline": f"""
SELECT o_orderkey AS item_id, o_orderdate, {texts('o_orderkey', ['Lima', 'Jesús María', 'San Isidro'])} || ', ' || CAST(extract(DAY FROM o_orderdate) AS STRING) || ' de ' || {pick('(extract(MONTH FROM o_orderdate) - 1)', ["'" + m + "'" for m in MONTHS])} || ' del ' || CAST(extract(YEAR FROM o_orderdate) AS STRING) AS line
FROM orders""",
    "section": f"SELECT l_orderkey AS document_id, l_linenumber AS order_index, CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN {texts('l_orderkey', SECTIONS)} ELSE {texts('(l_partkey + l_linenumber)', SECTIONS)} END AS text, CASE WHEN l_linenumber % 3 = 1 THEN 'ARTICLE' ELSE 'LIST' END AS kind FROM lineitem",
    "role": f"SELECT o_orderkey AS item_id, {texts('o_orderkey', ROLES)} AS role FROM orders",
    "number": f"SELECT o_orderkey AS item_id, {texts('o_orderkey', NUMBERS)} || CAST(o_custkey % 3 AS STRING) AS number FROM orders",
    "event": f"""
SELECT o_orderkey * 2 AS event_id, o_orderkey % 3000 AS document_id, {texts('o_orderkey', ['DESIGNATION', 'APPOINTMENT', 'ACCEPT_RESIGNATION', 'END_DESIGNATION', 'ACTING_ASSIGNMENT', 'TERMINATION'])} AS event_type,
  CASE WHEN o_orderkey % 6 IN (2, 3, 5) THEN 'END' ELSE 'START' END AS effect, CASE WHEN o_orderkey % 7 = 0 THEN 'EXPLICIT' ELSE 'NOT_STATED' END AS stated,
  CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_orderdate AS DATE) END AS published_on, CASE WHEN o_orderkey % 12 > 0 THEN 'OFFICIAL_GAZETTE' ELSE 'PRESS' END AS authority,
  {pick('o_orderkey', ["NULL", "'DAY_AFTER_PUBLICATION'", "NULL", "'INDETERMINATE'", "NULL"])} AS deferred
FROM orders""",
    "participant": "SELECT l_orderkey * 2 AS event_id, l_suppkey AS person_id, l_linenumber AS position_no FROM lineitem WHERE l_linenumber % 2 = 0",
    "capture": "SELECT user_id AS artifact_id, event_id AS capture_id, ts AS captured_at, event_type || CAST(CAST(floor(value) AS BIGINT) % 3 AS STRING) AS sha256 FROM events",
    "run_item": f"SELECT event_id AS item_id, user_id AS run_id, {texts('event_id', ['INGESTED', 'FAILED', 'INGESTED', 'RETRY_PENDING', 'SKIPPED', 'INGESTED', 'INGESTED'])} AS status, ts AS started_at FROM events WHERE user_id % 3 > 0 OR event_id % 7 IN (0, 2)",
    "failure": f"SELECT event_id AS item_id, CAST({pick('event_id', ['404', '500', 'NULL', '403', 'NULL', '429', 'NULL'])} AS INT) AS http_status, {texts('event_id', ['http', 'http', 'network', 'http', 'parse', 'http', 'strange'])} AS kind FROM events",
    "org": "SELECT s_suppkey AS org_id, 'INSTITUTO NACIONAL ' || upper(p_name) || CASE WHEN s_suppkey % 4 = 0 THEN ' REGIONAL' ELSE '' END AS name, CASE WHEN s_suppkey % 5 = 4 THEN s_suppkey - 1 WHEN s_suppkey % 5 = 3 THEN s_suppkey - 2 END AS merged_into, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey - 1 END AS predecessor_id FROM supplier JOIN part ON p_partkey = s_suppkey % 37",
    "precedent": "SELECT c_custkey AS precedent_id, name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE '1-URGENT' END AS role, person_id % 3 AS person_id, CASE WHEN c_custkey % 7 = 0 THEN DATE '2020-01-01' END AS revoked_at, DATE '2019-01-01' AS created_at FROM customer JOIN person ON person_id = c_custkey WHERE c_custkey % 50 < 4",
    "url": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '&utm_source=x' WHEN 1 THEN upper(split_part(url, '://', 1)) || '://' || split_part(url, '://', 2) WHEN 2 THEN url || '?fbclid=9&k=1' ELSE url END AS url FROM pages",
}


def sources(sql: str) -> list[str]:
    """Adapters that a query needs, each after those it needs itself."""
    out: list[str] = []
    for name in ADAPTERS:
        if re.search(rf"\b{name}\b", sql):
            inner = [x for x in sources(ADAPTERS[name]) if x != name] if name in ("mention", "precedent") else []
            out += [x for x in [*inner, name] if x not in out]
    return out


def with_adapters(sql: str) -> str:
    """The query with the adapters it names as common table expressions."""
    body = sql.strip()
    ctes = ",\n".join(f"{n} AS ({ADAPTERS[n].strip()})" for n in sources(sql))
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    return f"WITH {ctes},\n{body[4:]}" if body.upper().startswith("WITH") else f"WITH {ctes}\n{body}"


class Tables:
    """Base tables and adapters of a folder, as DataFrames by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str) -> DataFrame:
        """A query in SQL over base tables and adapters."""
        full = with_adapters(text)
        for name in TABLES:
            if re.search(rf"\b{name}\b", full):
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(full)
