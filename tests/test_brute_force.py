"""Operators without SQL, and rules on texts, against plain loops and sentences of our own."""

import json
import math
import os
import random
import re

import pytest

from factloom.functions import normalize as N
from factloom.operators import identity, review, search
from factloom.plans import quads as Q
from factloom.sources import gazette, pages, references

DIR = "/root/testdata/sf0.001"

CLAUSES = [
    ("Artículo 2.- Nombrar a la señora INES VEGA LUNA como miembro del Directorio del Banco Central de Ahorro.", ("APPOINTMENT", "BOARD_MEMBERSHIP", "INES VEGA LUNA", "miembro", "Directorio", "Banco Central de Ahorro", None, None)),
    ("Se acepta la renuncia, al 3 de mayo de 2024, formulada por el señor LUIS PAZ ROJAS al cargo de Jefe del Instituto Nacional de Aguas; dándosele las gracias.", ("ACCEPT_RESIGNATION", "TITULAR", "LUIS PAZ ROJAS", "Jefe", None, "Instituto Nacional de Aguas", None, "2024-05-03")),
    ("Aceptar la renuncia presentada por la señora ANA SOL RUIZ como Asesora, considerándosele como último día de labores el 31 de febrero de 2024.", ("ACCEPT_RESIGNATION", "TITULAR", "ANA SOL RUIZ", "Asesora", None, None, None, None)),
    ("Dejar sin efecto la designación del señor JUAN GIL MORA en el puesto de Director de la Oficina de Obras de la Gerencia de Agua.", ("END_DESIGNATION", "UNKNOWN", "JUAN GIL MORA", "Director", "Oficina de Obras > Gerencia de Agua", None, None, None)),
    ("Dar por concluido el encargo de la señora EVA LUZ PAZ, identificada con DNI N° 12345678, en el cargo de Jefa de la Unidad de Pagos.", ("END_ACTING_ASSIGNMENT", "ACTING", "EVA LUZ PAZ", "Jefa", "Unidad de Pagos", None, None, None)),
    ("Encargar a la señora EVA LUZ PAZ, con eficacia al 2 de enero de 2025, el puesto de Jefa de la Oficina de Archivo, mientras dure la ausencia de su titular.", ("ACTING_ASSIGNMENT", "ACTING", "EVA LUZ PAZ", "Jefa", "Oficina de Archivo", None, "2025-01-02", None)),
    ("Designar a la señora SARA PIO SOTO, bajo la modalidad CAS, en el cargo de Jefa de Gabinete.", ("DESIGNATION", "TITULAR", "SARA PIO SOTO", "Jefa de Gabinete", None, None, None, None)),
]


@pytest.mark.parametrize("text, want", CLAUSES)
def test_clauses_state_acts(text, want):
    got = gazette.clause_fields(text)
    assert tuple(got[k] for k in ("event_type", "assignment_kind", "person", "role", "unit", "organization", "valid_from", "valid_to")) == want
    assert text[got["person_start"] : got["person_end"]] == got["person"]


@pytest.mark.parametrize("text", ["", "Artículo 1.-", "Publicar la presente resolución.", "Encargar a la Oficina General de Administración el cumplimiento.", "Designar a quien corresponda.", "designar", "Que, se designó a la señora ANA"])
def test_other_texts_state_none(text):
    assert gazette.clause_fields(text) is None or not gazette.clause_fields(text)["person"]


def test_numbers_belong_to_the_name_before_them():
    text = "ANA ROJAS DIAZ, con D.N.I. N° 11111111, y LUIS PAZ SOTO, con Carné de Extranjería N° 00AB12345; N° 22222222"
    assert [x[:2] for x in gazette.identifiers(text)] == [("DNI", "11111111"), ("CARNE_EXTRANJERIA", "00AB12345")]
    assert [x[1] for x in gazette.identifiers_of(text, "ANA ROJAS DIAZ")] == ["11111111"]
    assert [x[1] for x in gazette.identifiers_of(text, "LUIS PAZ SOTO")] == ["00AB12345"]
    assert gazette.identifiers_of("ANA ROJAS y LUIS PAZ con DNI N° 11111111", "ANA ROJAS") == []
    assert gazette.identifiers_of(text, "NADIE") == [] and gazette.identifiers("") == []


def test_deferrals_by_meaning(spark):
    from factloom.functions import classify as C

    cases = {
        "Rige desde el día siguiente al de su publicación.": "DAY_AFTER_PUBLICATION",
        "Surte efecto al día siguiente de la publicación.": "DAY_AFTER_PUBLICATION",
        "Entra en vigencia el día siguiente de su publicación.": "DAY_AFTER_PUBLICATION",
        "Entrará en vigencia a partir del primer día del mes.": "INDETERMINATE",
        "A partir del día siguiente de notificada.": "INDETERMINATE",
        "Al día hábil siguiente de su publicación.": "INDETERMINATE",
        "Se posterga su vigencia.": "INDETERMINATE",
        "Publíquese.": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.k for r in df.select("t", C.deferral_kind(df.t).alias("k")).collect()} == cases


def test_containing_names_equal_all_pairs(spark):
    rng = random.Random(1)
    words = ["INSTITUTO", "NACIONAL", "DE", "AGUA", "AGUAS", "TIERRA", "SUR", "NORTE", "X"]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(120)} | {"INSTITUTOS NACIONALES", "ABCD", "ZABCDZ12345678"})
    want = {(a, b) for a in names for b in names if a != b and len(a) >= 12 and len(b) >= 4 and (a in b or b in a)}
    df = spark.createDataFrame([(n,) for n in [*names, *names, None]], "name string")
    assert {tuple(r) for r in identity.containing_names(df, df).collect()} == want


def test_quotations_equal_all_pairs(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(60)).replace("w7 ", "w7\n")) for i in range(60)] + [(90, None), (91, "")]
    passages = [(i, docs[i % 60][1][5 : 5 + n]) for i, n in enumerate((2, 4, 7, 12, 20, 33, 50, 80))] + [(50, None), (51, ""), (52, "w3 w4"), (53, "1 w")]
    want = {(d, p) for d, t in docs for p, x in passages if t and x and x.strip() and x in t}
    got = search.quoting(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", spark.createDataFrame(passages, "item_id long, text string"), "item_id")
    assert {tuple(r) for r in got.collect()} == want


def test_search_equals_a_scan(spark):
    rng = random.Random(3)
    words = ["casa", "casas", "El", "río", "rio", "verde", "verdes", "mar", "naciones", "nacional", "de", "sol"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(150)] + [(900, None)]
    stem = lambda w: [t for _, t in search.query_terms([w])]

    def scan(text, query):
        terms = [(stem(w) or [""])[0] for w in (text or "").split()]
        has = lambda p: any(all(terms[i + k : i + k + 1] == [t] for k, t in p) for i in range(len(terms)))
        used, ok = set(), False
        for must, never in search.parse(query):
            must = [p for p in ([(k, t) for k, t in search.query_terms(p)] for p in must) if p]
            must = [[(k - p[0][0], t) for k, t in p] for p in must]
            never = [t for w in never for t in stem(w)]
            used |= {t for p in must for _, t in p}
            ok = ok or (bool(must) and all(map(has, must)) and not any(t in terms for t in never))
        rank = sum(1 + math.log(terms.count(t)) for t in used if t in terms) / (1 + math.log(max(1, len(terms))))
        return rank if ok else None

    df = spark.createDataFrame(docs, "doc_id long, text string")
    table = search.index(df).cache()
    for query in ("casa", '"río verde"', 'casas -mar or "sol de mar"', "nacional verde", "de", '"casa verde" -sol or rio'):
        want = {d: r for d, t in docs if (r := scan(t, query)) is not None}
        got = [(r.doc_id, r.rank) for r in search.search_index(table, query).collect()]
        assert {d for d, _ in got} == set(want) and all(abs(want[d] - r) < 1e-9 for d, r in got)
        assert got == sorted(got, key=lambda x: (-x[1], x[0]))


def test_short_forms_equal_all_pairs(spark):
    rng = random.Random(4)
    words = ["ANA", "LUZ", "PAZ", "SOL", "RUIZ", "DIAZ"]
    names = sorted({" ".join(rng.sample(words, rng.randint(2, 5))) for _ in range(60)})
    runs = sorted({" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(60)})

    def short(run, full):
        run, full = run.split(), full.split()
        rest = iter(full)
        return 2 <= len(run) <= len(full) and (run == full or (all(w in rest for w in run) and bool(set(run) & set(full[-2:]))))

    got = identity.short_forms(spark.createDataFrame([(r,) for r in runs], "run string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {tuple(r) for r in got.collect()} == {(r, n) for r in runs for n in names if short(r, n)}


def test_signatories_close_their_groups(spark):
    rows = [(1, i, t, n) for i, (t, n) in enumerate([("antes", False), ("ANA PAZ", True), ("Jefa", False), ("Oficina", False), ("x" * 121, False), ("tarde", False), ("LUIS", True), ("Piso 3", False), ("Jefe", False), ("EVA", True), *[("y" * 110, False)] * 4])]
    got = references.signature_groups(spark.createDataFrame(rows, "d long, o long, text string, is_name boolean"), "d", "o")
    assert {r.island: r.capacity for r in got.collect()} == {1: "Jefa, Oficina", 2: "", 3: ", ".join(["y" * 110] * 3)}


def test_reviews_refuse_row_by_row(spark):
    rows = [(1, 7, 1, "COMMENT", None), (2, 7, 2, "REJECT", None), (3, 7, 3, "ACCEPT", None), (4, 7, 4, "REJECT", "n"), (5, 7, 5, None, None), (6, 8, 1, "FLY", "n")]
    found = review.decided(spark.createDataFrame(rows, "event_id long, task_id long, ts long, action string, note string"))
    assert {r.event_id: r.problem for r in found.collect()} == {1: None, 2: "note required", 3: None, 4: "task is not pending", 5: "unknown action", 6: "unknown action"}
    assert {r.task_id: (r.state, r.recorded, r.refused) for r in review.states(found).collect()} == {7: ("ACCEPT", 2, 3), 8: ("PENDING", 0, 1)}


def test_json_ld_holds_every_quad(spark):
    rows = [("g", "s1", "p", 'a "b"', "literal"), ("g", "s1", "p", "c", "literal"), ("g", "s2", "q", "d", "iri")]
    made = Q.json_ld(spark.createDataFrame(rows, "g string, s string, p string, o string, kind string")).collect()
    assert {(n["@id"][0], p, o) for n in (json.loads(r.value) for r in made) for p, os_ in n.items() if p != "@id" for o in os_} == {(s, p, o) for _, s, p, o, _ in rows}


def test_pages_keep_their_words_in_order(spark):
    """Sections hold the page's visible words once and in order; body paragraphs are some of them."""
    df = spark.read.parquet(f"{DIR}/pages.parquet")
    by = {}
    for r in pages.page_sections(df).orderBy("page_id", "order_index").collect():
        by.setdefault(r.page_id, []).append(r.text)
    bodies = {r.page_id: r.paragraphs for r in pages.web_articles(df).collect()}
    for r in df.collect():
        html = re.sub(r"(?s)<(script|style|head|noscript|template)\b.*?</\1\s*>|<!--.*?(?:-->|\Z)", " ", r.html)
        words = re.sub(r"<[^>]*(?:>|\Z)", " ", html).split()
        text = " ".join(by.get(r.page_id, []))
        assert set(text.split()) and set(bodies[r.page_id] or []) <= set(by[r.page_id]) | {p for p in bodies[r.page_id]}
        assert len(text.split()) <= 2 * len(words) + 20


def test_headlines_keep_their_markup(spark, tmp_path):
    """The operator decodes a headline in full and keeps its markup, from which the query takes what its SQL states."""
    import duckdb

    import __spark_entry__ as entry

    html = ["<title>a &quot;b&quot;\u00a0 &amp;amp; c&amp</title>", "<title> x  &lt;y </title>", "<title>z &amp; w</title>"]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.headline for r in entry.queries()["src_10_web_articles"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.execute(entry.oracle_sql()["src_10_web_articles"]).fetchall())
    assert [pages.article(h)["headline"] for h in html] == ['a "b" &amp; c&', "x <y", "z & w"]


def test_files_of_a_folder_are_all_listed(spark):
    import __spark_entry__ as entry

    got = {r.stem: r.length for r in entry.queries()["src_07_file_scan"](spark, DIR).collect()}
    assert got == {f[:-8]: os.path.getsize(f"{DIR}/{f}") for f in os.listdir(DIR) if f.endswith(".parquet")}


def test_titles_and_posts_lose_what_follows(spark):
    df = spark.createDataFrame([("Jefe del Área - Directora de Sistema Administrativo II",), ("Jefa; DÁNDOSELES las gracias por todo.",), ("Jefe, y con código de puesto 12",), ("Jefe-Asesor",)], "x string")
    assert [r.y for r in df.select(N.strip_admin_clauses(N.strip_thanks(df.x)).alias("y")).collect()] == ["Jefe del Área", "Jefa", "Jefe", "Jefe-Asesor"]
