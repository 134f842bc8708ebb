from datetime import datetime

from factloom.streaming import intake

HTML = "<html><body><h1>RESOLUCIÓN MINISTERIAL N° 1-2026-X</h1><p>CONSIDERANDO:</p><p>Que, es necesario;</p><p>SE RESUELVE:</p><p>Artículo 1.- Designar a la señora ANA ROJAS DIAZ, en el cargo de Directora.</p></body></html>"


def test_pages_arrive_once_and_batches_append(spark, tmp_path):
    inbox, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    row = lambda i, day, html=HTML: (i, f"https://x.example/{i}", html, datetime(2026, 8, day))
    spark.createDataFrame([row(1, 1), row(1, 1), row(2, 2, None)], intake.PAGE).write.parquet(f"{inbox}/a")
    flow = lambda: intake.start(intake.arrivals(spark, f"{inbox}/*"), out, check).awaitTermination(120)
    assert flow()
    events = spark.read.parquet(f"{out}/events")
    assert [(r.page_id, r.event_type, r.person) for r in events.collect()] == [(1, "DESIGNATION", "ANA ROJAS DIAZ")]
    spark.createDataFrame([row(1, 3), row(3, 3)], intake.PAGE).write.parquet(f"{inbox}/b")
    assert flow()
    assert sorted(r.page_id for r in spark.read.parquet(f"{out}/events").collect()) == [1, 3]
    assert spark.read.parquet(f"{out}/sections").where("page_id = 3").count() > 0
