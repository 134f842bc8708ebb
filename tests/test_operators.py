from datetime import date, datetime

from factloom.operators import closure, identity, relational, temporal, versioning

COLS = "assignment_id long, position_id long, organization_id long, person_id long, label string, valid_from date, valid_to date, legal_from date, legal_to date, superseded_at timestamp, recorded_at timestamp, start_event_id long, end_event_id long"


def at(n):
    return datetime(2026, 1, n)


def test_timeline_answers_vacant_then_confirmed(spark):
    rows = [
        (1, 7, 1, 11, "J", date(2025, 1, 1), date(2026, 8, 4), None, None, None, at(1), 1, None),
        (2, 7, 1, 12, "J", None, None, date(2026, 8, 6), None, None, at(2), 2, None),
        (3, 8, 1, 13, "K", None, None, None, None, None, at(3), 3, None),
        (4, 9, 1, 13, "K", None, None, None, None, at(9), at(3), 3, None),
    ]
    a = spark.createDataFrame(rows, COLS)
    q = spark.createDataFrame([(p, d) for p in (7, 8, 9, 10) for d in (date(2026, 8, 4), date(2026, 8, 5), date(2026, 8, 6))], "position_id long, on_date date")
    got = {(r.position_id, r.on_date.day): (r.status, r.person_id, r.basis) for r in temporal.holder_decision(a, q).collect()}
    assert got[7, 4] == ("confirmed", 11, "source")
    assert got[7, 5] == ("vacant", None, "legal_rule")
    assert got[7, 6] == ("confirmed", 12, "legal_rule")
    assert got[8, 5][0] == "unresolved" and got[9, 5][0] == "no_data" and got[10, 5][0] == "no_data"


def test_pairing_never_chooses_between_two(spark):
    def row(i, start, end, label="J", org=1, rec=1, frm=None, to=None):
        return (i, None, org, 5, label, frm, to, None, None, None, at(rec), start, end)

    rows = [row(1, 1, None), row(2, None, 2, rec=2), row(3, 3, None, "K"), row(4, 4, None, "K", rec=2), row(5, None, 5, "K", rec=3), row(6, 6, None, "L", org=2), row(7, None, 7, "L", org=3, rec=4), row(8, 8, 9, "M")]
    got = {(r.label, r.start_id, r.end_id) for r in temporal.pair_periods(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {("J", 1, 2), ("K", None, 5), ("K", 3, None), ("K", 4, None), ("L", None, 7), ("L", 6, None), ("M", 8, None)}
    assert temporal.pair_periods(spark.createDataFrame([], COLS)).count() == 0


def test_month_bucketed_interval_join(spark):
    a = spark.createDataFrame([(1, 1, 1, 1, "x", date(2026, 1, 31), date(2026, 3, 1), None, None, None, at(1), 1, None), (2, 1, 1, 1, "x", date(2026, 3, 1), date(2026, 2, 1), None, None, None, at(1), 1, None)], COLS)
    d = spark.createDataFrame([(date(2026, 1, 31),), (date(2026, 2, 15),), (date(2026, 3, 1),), (date(2026, 3, 2),)], "on_date date")
    assert temporal.covering_pairs(a, d).count() == 3


def test_chains_and_cycles(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5)], "node long, target long")
    got = {r.node: r.survivor for r in closure.survivors(links, rounds=6).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [1] * 4 and got[5] in (5, 6)
    assert closure.chain(spark, links, 3).where("node = 4").count() == 4


def test_survivors_of_long_chains(spark):
    """The end of a chain, however long; a walk of bounded depth would stop on the way."""
    links = spark.range(1501).selectExpr("id AS node", "CASE WHEN id > 0 THEN id - 1 END AS target")
    got = closure.survivors(links)
    assert got.count() == 1501 and got.where("survivor <> 0").isEmpty()


def test_decisions_need_agreement(spark):
    s = spark.createDataFrame([(1, "office", 5), (1, "identifier", 5), (2, "office", 5), (2, "precedent", 6)], "mention_id long, signal string, person_id long")
    got = {r.mention_id: (r.outcome, r.person_id, r.signal) for r in identity.decide(s).collect()}
    assert got == {1: ("LINKED", 5, "identifier"), 2: ("CONFLICT", None, None)}


def test_either_key_join_gives_a_pair_once(spark):
    a = spark.createDataFrame([(1, 10, 10), (2, 10, 11), (3, None, None)], "id long, s long, e long")
    b = spark.createDataFrame([(10,), (11,)], "k long")
    assert sorted((r.id, r.k) for r in relational.either_key_join(a, b, "s", "e", "k").collect()) == [(1, 10), (2, 10), (2, 11)]


def test_agreeing_pairs_are_distinct(spark):
    left = [(1, "a", 1), (1, "b", 1), (1, "a", 1), (2, "b", 1), (3, None, 1), (4, "a", 2), (None, "b", 1)]
    right = [(7, "a", 1), (7, "b", 1), (8, "b", 1), (8, "b", 1), (9, None, 1), (None, "a", 2)]
    a, b = spark.createDataFrame(left, "l long, x string, y long"), spark.createDataFrame(right, "r long, x string, y long")
    want = sorted({(i, j) for i, *k in left for j, *m in right if k == m and k[0] is not None}, key=str)
    for splits in (1, 3):
        assert sorted(map(tuple, relational.agreeing_pairs(a, b, ["x", "y"], "l", "r", splits).collect()), key=str) == want


def test_pairs_by_block_are_distinct(spark, monkeypatch):
    """Each pair once where ids have several names or are null, with blocks cut, in one and in many tasks."""
    left = [(i, "a") for i in range(7)] + [(1, "a"), (1, "b"), (2, "b"), (20, None), (None, "b"), (30, "c")]
    right = [(i, "a") for i in range(40, 45)] + [(41, "b"), (50, "b"), (50, "b"), (51, None), (None, "a"), (60, "d")]
    a, b = spark.createDataFrame(left, "mention_id long, name string"), spark.createDataFrame(right, "person_id long, name string")
    want = sorted({(i, j) for i, x in left for j, y in right if x == y and x is not None}, key=str)
    for block, task in ((2, 100_000_000), (100, 1)):
        monkeypatch.setattr(relational, "BLOCK", block)
        monkeypatch.setattr(relational, "TASK_PAIRS", task)
        assert sorted(map(tuple, identity.by_name(a, b).collect()), key=str) == want
    assert identity.by_name(a.limit(0), b).isEmpty()


def test_pairs_of_a_name_take_little_room(spark, tmp_path):
    """Files hold pairs of a common name in half a byte each, however many ids share it."""
    a, b = spark.range(600).selectExpr("id AS mention_id", "'a' AS name"), spark.range(4003).selectExpr("id AS person_id", "'a' AS name")
    out = str(tmp_path / "pairs")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as large tables are joined
    try:
        identity.by_name(a, b).write.parquet(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert spark.read.parquet(out).count() == 600 * 4003
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 600 * 4003 / 2


def test_named_pairs_come_from_blocks(spark):
    import __spark_entry__ as entry

    for name in ("jn_01_name_candidates", "rm_01_scored_candidates"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.split("Join")[0].count("Generate explode(") == 2


def test_pairs_are_not_shuffled(spark):
    import __spark_entry__ as entry

    for name in ("jn_01_name_candidates", "jn_02_identifier_join", "jn_15_same_office", "rm_01_scored_candidates"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan.split("Join")[0]


def test_lists_through_groups(spark, monkeypatch):
    """The same lists by broadcast, by the planner's join and with a key's values in many tasks; no values are shuffled by key."""
    members, values = [(1, 10), (1, 10), (1, 11), (2, 11), (3, 12), (4, None), (None, 10)], [(10, 5), (10, 3), (11, 5), (11, 9), (11, None), (None, 8), (13, 1)]
    m, v = spark.createDataFrame(members, "k long, g long"), spark.createDataFrame(values, "g long, x long")
    want = {1: [3, 5, 9], 2: [5, 9], None: [3, 5]}
    for most, task in ((8_000_000, 16_000_000), (0, 16_000_000), (8_000_000, 1)):
        monkeypatch.setattr(relational, "BROADCAST_VALUES", most)
        monkeypatch.setattr(relational, "TASK_VALUES", task)
        out = relational.lists_through(m, v, "k", "g", "x")
        assert {r.k: r.list for r in out.collect()} == want
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert most == 0 or "Exchange" not in plan.split("BroadcastHashJoin")[0]


def test_versions_and_ids(spark):
    c = spark.createDataFrame([(1, 1, at(1), "a"), (1, 2, at(2), "a"), (1, 3, at(3), "b")], "artifact_id long, capture_id long, captured_at timestamp, sha256 string")
    assert [(r.capture_id, r.previous_id, r.version) for r in versioning.new_versions(c).orderBy("version").collect()] == [(1, None, 1), (3, 1, 2)]
    k = spark.createDataFrame([("a", None), (None, "a")], "x string, y string").select(versioning.key_id("x", "y").alias("k"))
    assert k.distinct().count() == 2


def test_resolution_follows_the_order_and_never_links_by_name(spark):
    from factloom.operators.resolution import resolve

    rows = [
        (1, 1, "Ana Paz", None, "dni", "1"), (2, 2, "ANA PAZ", None, "dni", None), (3, 3, "A. Paz", "Ministra del Interior", "dni", "1-"), (4, 4, "A. Paz", "Ministro del Interior", "dni", "2"),
        (5, 5, "Luz", None, "dni", "3"), (6, 6, "A. PAZ", "Ministra de Interior", "dni", "3"), (7, 7, "Otro", None, "dni", "2"),
    ]
    got = {r.mention_id: (r.outcome, r.person_id, r.signal) for r in resolve(spark.createDataFrame(rows, "mention_id long, seq long, name string, label string, scheme string, value string")).collect()}
    assert got == {1: ("NEW", 1, None), 2: ("NEW", 2, None), 3: ("LINKED", 1, "identifier"), 4: ("LINKED", 1, "office"), 5: ("NEW", 5, None), 6: ("CONFLICT", None, None), 7: ("LINKED", 1, "identifier")}


def test_listing_guards():
    from factloom.sources import listing

    html = "<p>Normas del 07/08/2026 al 07/08/2026: 2 resultados</p><article><a href='/op/2539123-1'>Designan</a> 07/08/2026<footer>2539123-1</footer></article><li><a href='/op/2539124-1'>x</a><footer>9999999</footer></li><li><a href='/about'>y</a></li>"
    got = listing.entries(html)
    assert [(e[1], e[4], e[7]) for e in got] == [("2539123-1", True, 2), ("2539124-1", False, 2)] and got[0][5:7] == ("07/08/2026", "07/08/2026")


def test_article_events():
    from factloom.sources.gazette import clause_event, collective

    e = clause_event("Designar a la señora ANA ROJAS DIAZ, identificada con DNI N° 09342789, en el cargo de Directora de la Oficina General de Planeamiento del Ministerio de Cultura, siendo su primer día de labores el 7 de agosto de 2026.")
    assert e == ("DESIGNATION", "START", "ANA ROJAS DIAZ", "09342789", "Directora", "Oficina General de Planeamiento", "Ministerio de Cultura", "7 de agosto de 2026", None, False)
    assert clause_event("Encargar a la Oficina General de Administración el cumplimiento") is None
    assert clause_event("Encargar al señor PABLO RUIZ, las funciones de Jefe, a partir de la fecha, en adición a sus funciones")[7:] == (None, None, True)
    table = [("TABLE_ROW", "N° | Cargo"), ("TABLE_ROW", "1 | Jefe")]
    assert collective("Designar como Fedatarios a los siguientes servidores:", table) == []
