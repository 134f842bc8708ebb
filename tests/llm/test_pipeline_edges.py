"""The pipeline's stages on nulls, repeated rows, ties, empty tables and clashing columns."""

import random

import pytest

WORDS = [f"w{i}" for i in range(300)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, node long, root long, label int, window string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en" if d is None or d % 2 else None, "s", 0, 1, 2, 3, 4, "k") for d, t in rows], DOCS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rng = random.Random(41)
    clean = [(i, " ".join(rng.choice(WORDS) for _ in range(60))) for i in range(120)]
    toxic = [(200 + i, " ".join([*(rng.choice(WORDS) for _ in range(30)), "vilest", *(rng.choice(WORDS) for _ in range(30)), "vilest"])) for i in range(40)]
    passage = " ".join(f"p{i}" for i in range(30))
    odd = [(300, None), (301, ""), (302, "short"), (None, clean[0][1] + " tail"), (303, clean[1][1]), (304, clean[2][1] + " end"), (305, clean[3][1] + " " + passage), (306, "same five words again and " * 20), (2, clean[2][1]), (2, clean[2][1])]
    spark.createDataFrame([(d, 1, int(d >= 200)) for d, _ in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    table(spark, clean + toxic + odd).write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_each_stage_takes_effect_and_keeps_clean_documents(spark, folder):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(P.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda d: -1 if d is None else d)
    good = stages["quality_rules"](spark, docs, folder)
    assert good.columns == docs.columns and set(ids(docs)) - set(ids(good)) == {300, 301, 302, 306}
    calm = stages["toxicity"](spark, good, folder)
    assert calm.columns == docs.columns and set(ids(good)) - set(ids(calm)) == set(range(200, 240))
    one = stages["near_dedup"](spark, calm, folder)
    assert one.columns == docs.columns and ids(one) == sorted([*range(120), 305])
    bare = stages["decontamination"](spark, one, folder)
    assert bare.columns == docs.columns and ids(bare) == list(range(120))
    packed = stages["packing"](spark, bare, folder)
    assert sorted(r.doc_id for r in packed.collect()) == list(range(120))


def test_empty_tables_pass_every_stage(spark, folder):
    import corpus_pipeline as P

    none = table(spark, [])
    for name, stage in P.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_training_hands_its_memory_back(spark, monkeypatch):
    """Freed memory leaves the driver's process, so that a later stage doesn't start with the training's."""
    import psutil

    from factloom.llm import common, toxicity

    taken = [bytes(1000) for _ in range(200_000)]
    taken = taken[-1:]
    before = psutil.Process().memory_info().rss
    common.release_memory()
    assert taken and before - psutil.Process().memory_info().rss > 100_000_000
    calls = []
    monkeypatch.setattr(toxicity, "release_memory", lambda: calls.append(1))
    docs, labels = spark.createDataFrame([(1, "bad words"), (2, "good words")], "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    toxicity.fit(docs, labels)
    assert calls == [1]


def test_memos_go_when_a_task_of_another_kind_begins(spark):
    """Workers are reused, so what a packing or counting task kept would count against every later stage."""
    import gc

    import public_tokenizers
    from factloom.llm import common, packing, token_counts

    def left(batches):
        import pyarrow as pa

        held = [len(o.known) for o in gc.get_objects() if isinstance(o, token_counts.Encoder)]
        for part in batches:
            yield pa.RecordBatch.from_arrays([pa.array([max(held, default=0)] * part.num_rows, pa.int64())], ["held"])

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, [(i, f"alpha{i} beta gamma{i}") for i in range(400)])
    assert packing.pack_documents(docs, path).count() == 400
    assert token_counts.count_tokens(docs, path).count() == 400
    assert {r.held for r in spark.range(400).repartition(8).mapInArrow(common.lean(left), "held long").collect()} == {0}


def test_a_task_frees_what_it_held_before_memory_is_handed_back(monkeypatch):
    import weakref

    from factloom.llm import common

    class Memo(dict):
        pass

    made, found = [], []

    def run(batches):
        memo = Memo()
        made.append(weakref.ref(memo))
        for part in batches:
            memo[part] = part
            yield part

    monkeypatch.setattr(common, "release_memory", lambda: found.append(made[0]()))
    assert list(common.lean(run)(iter([1, 2]))) == [1, 2]
    assert found == [None]


def test_stages_hand_rows_to_python_in_short_batches(spark, folder):
    import corpus_pipeline as P
    from factloom.llm import common

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, then in (("10000", common.BATCH), ("0", common.BATCH), ("100", 100)):
            spark.conf.set(name, given)
            P.pack(spark, table(spark, [(1, "one text")]), folder)
            assert int(spark.conf.get(name)) == then
        spark.conf.set(name, str(common.BATCH))
        docs = spark.range(0, 3000, 1, 1)
        assert max(r.n for r in docs.mapInPandas(lambda parts: (p.assign(n=len(p))[["n"]] for p in parts), "n long").collect()) == common.BATCH
    finally:
        spark.conf.set(name, before)
