from datetime import datetime, timedelta

from pyspark.sql import functions as F

from firegrid.operators import event_state
from firegrid.operators.clustering import cluster
from firegrid.streaming.pipeline import Pass, latest_events, start

HEAD = "latitude,longitude,brightness,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,frp,daynight,type\n"


def lines(k0, k1):
    out = []
    for k in range(k0, k1):
        at = datetime(2024, 1, 1) + timedelta(hours=2 * k)
        out.append(f"{43.5 + 0.004 * (k % 7):.5f},{6.1 + 0.3 * (k % 3):.5f},,330,0.4,0.4,{at:%Y-%m-%d},{at:%H%M},N20,VIIRS,n,2,5.0,D,\n")
    return out


def test_stream_equals_one_pass(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    stage = Pass(spark, str(tmp_path / "tables"), "VIIRS_NRT", now="2024-02-01 00:00:00")
    for n, (a, b) in enumerate([(0, 15), (10, 30), (30, 45)]):  # rows 10 to 15 come twice
        (landing / f"{n}.csv").write_text(HEAD + "".join(lines(a, b)) + "bad,row,,,,,,,,,,,,,\n")
        query = start(stage, str(landing), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert query.exception() is None
    detections, members = stage.table("detections"), stage.table("members")
    assert detections.count() == 45 and detections.select("provider_key").distinct().count() == 45
    assert stage.table("rejects").count() == 3
    whole = {r.provider_key: r.event_id for r in cluster(detections).collect()}
    assert {r.provider_key: r.event_id for r in members.collect()} == whole


def figures(members, detections):
    rows = members.select("id", "event_id").join(detections, "id")
    return {r.event_id: (r.n, r.first, r.last, round(r.lon, 6), r.sensors) for r in rows.groupBy("event_id").agg(
        F.count("*").alias("n"), F.min("acquired_at").alias("first"), F.max("acquired_at").alias("last"), F.sum("longitude").alias("lon"), F.array_sort(F.collect_set("sensor")).alias("sensors")).collect()}


def test_late_rows_and_snapshots_equal_one_pass(spark, tmp_path, monkeypatch):
    """Rows come up to eight hours late; a batch reads open events near it, not all members."""
    landing = tmp_path / "landing"
    landing.mkdir()
    stage = Pass(spark, str(tmp_path / "tables"), "VIIRS_NRT", now="2024-02-01 00:00:00", lateness_h=9.0)
    rows = lines(0, 120)
    late = [k for k in range(120) if k % 7 == 3]
    order = sorted(range(120), key=lambda k: k + (4 if k in late else 0))
    read, real = [], event_state.nearby
    monkeypatch.setattr(event_state, "nearby", lambda *a: (read.append(a[0].count()), real(*a))[1])
    for n in range(3):
        (landing / f"{n}.csv").write_text(HEAD + "".join(rows[k] for k in order[40 * n : 40 * n + 40]))
        start(stage, str(landing), str(tmp_path / "checkpoint")).awaitTermination()
    assert stage.of_batch("waiting", 2).count() > 0
    stage.flush(3)
    assert stage.of_batch("waiting", 3).isEmpty()
    detections, members = stage.table("detections"), stage.table("members")
    whole = {r.provider_key: r.event_id for r in cluster(detections.drop("batch")).collect()}
    assert {r.provider_key: r.event_id for r in members.collect()} == whole and len(whole) == 120
    got = {r.event_id: (r.detection_count, r.first_detected_at, r.last_detected_at, round(r.lon_sum, 6), r.sensors) for r in latest_events(stage.table("events")).collect()}
    assert got == figures(members, detections)
    assert len(read) == 3 and max(read) < 40  # places of open events, while 120 rows are stored
    before = {r.event_id for r in stage.of_batch("events", 2).collect()}
    stage.run(spark.read.schema(stage_schema()).option("header", True).csv(str(landing / "2.csv")), 2)  # a replay writes the same
    assert {r.event_id for r in stage.of_batch("events", 2).collect()} == before and stage.table("members").count() == 120


def stage_schema():
    from firegrid.streaming.pipeline import RAW_SCHEMA

    return RAW_SCHEMA
