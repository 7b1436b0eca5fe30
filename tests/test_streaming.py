from __future__ import annotations

from datetime import datetime

from arbora.streaming import ingest


def test_ingest(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    at = datetime(2024, 1, 1)

    def arrive(*rows):
        spark.createDataFrame([(*r, at) for r in rows], ingest.SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.changed(ingest.arriving(spark, source))
        ingest.indexed(stream, out, checkpoint).awaitTermination()

    arrive((1, "# A\nx"), (2, "# B\ny"))
    arrive((1, "# A\nx"), (2, "# C\nz"))
    got = {(r["doc_id"], r["title"]) for r in ingest.latest(spark, out).collect()}
    assert got == {(1, "A"), (2, "C")}


def test_windows(spark):
    rows = spark.createDataFrame([(1, "abcd", datetime(2024, 1, 1, 0, 1)), (2, None, datetime(2024, 1, 1, 0, 2)), (3, "x" * 8, datetime(2024, 1, 1, 0, 7))], ingest.SCHEMA)
    got = [(r["docs"], r["tokens"]) for r in ingest.arrivals(rows).orderBy("start").collect()]
    assert got == [(2, 1), (1, 2)]
