"""Streams give what the batch operators give."""

import glob

import pytest
from pyspark.sql import functions as F

from test_activity import EVENT, _events, at, budget_model
from textwarden.operators import risk
from textwarden.streaming import jobs


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    jobs.use_rocksdb(spark)


def _stream(spark, df, path, order):
    for i, part in enumerate(df.orderBy(order).randomSplit([1.0], 1)):
        part.coalesce(1).write.parquet(f"{path}/p{i}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(path)


def _drain(stream, spark, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / ("ck" + name))).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def test_risk_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(_events(300, 9), EVENT)
    want = risk.risk_as_of_event(df, "event_id").select("event_id", "risk_score", "pii_attempts_last_hour", "quarantined")
    got = _drain(jobs.stream_risk(_stream(spark, df, str(tmp_path / "in"), "ts")), spark, tmp_path, "risk")
    a = {r.event_id: r for r in want.collect()}
    rows = got.collect()
    assert len(rows) == 300
    for r in rows:
        assert (r.pii_attempts_last_hour, r.quarantined) == (a[r.event_id].pii_attempts_last_hour, a[r.event_id].quarantined)
        assert r.risk_score == pytest.approx(a[r.event_id].risk_score, abs=0.011)


def test_budget_stream_equals_model(spark, tmp_path):
    rows = [(i, f"a{i % 3}", i * 400_000, 100 * (i % 50)) for i in range(600)]
    df = spark.createDataFrame([(a, b, at(c), d) for a, b, c, d in rows], "request_id bigint, actor string, ts timestamp, tokens bigint")
    out = jobs.stream_budget(_stream(spark, df, str(tmp_path / "in"), "ts"), 20, 60_000_000, 0.4)
    got = {r.request_id: r.decision for r in _drain(out, spark, tmp_path, "budget").collect()}
    assert got == budget_model(rows, 20, 60_000_000, 0.4)


def test_documents_and_sinks(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("SSN 321-54-9876")
    (docs / "b.tmp").write_text("no")
    stream = jobs.stream_documents(spark, str(docs))
    target, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    from textwarden.sources.sinks import outbox_writer

    for _ in range(2):  # the second run finds nothing new
        jobs.start_available(stream.select("file", "text"), outbox_writer(target), ck).awaitTermination(120)
    assert spark.read.json(target).count() == 1
    (docs / "c.txt").write_text("more")
    jobs.start_available(stream.select("file", "text"), outbox_writer(target), ck).awaitTermination(120)
    assert spark.read.json(target).count() == 2


def test_snapshot_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, "a", at(i * 1_000_000), i * 1_000_000, 5.0, True, False, False) for i in range(5)], EVENT)
    stream = _stream(spark, df, str(tmp_path / "in"), "ts")
    write = jobs.control_room_writer(str(tmp_path / "store"), str(tmp_path / "snap"), lambda: "2024-01-01 00:10:00", jobs.risk_snapshot)
    jobs.start_available(stream, write, str(tmp_path / "ck")).awaitTermination(120)
    r = spark.read.json(str(tmp_path / "snap")).first()
    assert (r.open_alerts, r.quarantined_users) == (1, 1)


def test_hourly_and_daily_streams(spark, tmp_path):
    df = spark.createDataFrame(_events(100, 4), EVENT)
    hours = _drain(jobs.stream_hourly(_stream(spark, df, str(tmp_path / "h"), "ts")), spark, tmp_path, "hours")
    assert hours.agg(F.sum("n_events")).first()[0] <= 100
    days = _drain(jobs.stream_daily_first(_stream(spark, df, str(tmp_path / "d"), "ts")), spark, tmp_path, "days")
    assert days.count() == 1 and glob.glob(str(tmp_path / "ckdays"))
