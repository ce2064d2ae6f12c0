"""The ledger of a sweep: isolation of failures and resumption."""

import pytest
from pyspark.sql import functions as F

from firegrid.functions.rules import ClusteringParams
from firegrid.operators import calibration, clustering, event_state
from tests.test_operators import cloud, never_silent, sequential

ROWS = cloud(4, 60)


def test_resume_measures_only_what_is_missing(spark, tmp_path):
    path, calls = str(tmp_path / "ledger"), []
    data = spark.createDataFrame([(r[0], *r, "VIIRS" if k % 3 else "MODIS") for k, r in enumerate(ROWS)], "id string, provider_key string, acquired_at timestamp, longitude double, latitude double, sensor string")

    def measure(detections, sets):
        calls.append([p.version for p in sets])
        if any(p.version == "bad" for p in sets) and len(calls) < 6:
            raise RuntimeError("no such set")
        return calibration.measures(detections, sets)

    sets = [ClusteringParams("a"), ClusteringParams("bad", min_score=0.5), ClusteringParams("c", base_radius_m=1000)]
    assert calibration.resume_sweep(data, sets, path, together=3, measure=measure) == ["bad"]
    rows = {r.version: r for r in calibration.ledger(spark, path).collect()}
    assert rows["bad"].failed == "RuntimeError: no such set" and rows["bad"].events is None and [p.version for p in calibration.missing(spark, path, sets)] == ["bad"]
    for p in sets[::2]:
        owner = sequential(ROWS, p)
        assert (rows[p.version].events, rows[p.version].detections, rows[p.version].failed) == (len({*owner.values()}), len(ROWS), None)
    calls.extend([[]] * 6)  # from now on the set is measured
    assert calibration.resume_sweep(data, sets, path, together=3, measure=measure) == [] and calls[-1] == ["bad"]
    assert calibration.ledger(spark, path).filter("failed is null").count() == 3
    done = len(calls)
    assert calibration.resume_sweep(data, sets, path, measure=measure) == [] and len(calls) == done
    with pytest.raises(ValueError, match="repeat"):
        calibration.resume_sweep(data, sets + sets, path)


def test_labels():
    grid = {p.version: p for p in clustering.crossed_grid()}
    some = "calib-r1000-w6-s0.20, calib-r5000-w48-s0.65,calib-reference"
    assert calibration.finalists(some) == [grid["calib-r1000-w6-s0.20"], grid["calib-r5000-w48-s0.65"], ClusteringParams("calib-reference")]
    for wrong in ("", "calib-r1000", "calib-reference,calib-reference", "calib-r1000-w6-s0.2"):
        with pytest.raises(ValueError):
            calibration.finalists(wrong)


def test_shapes_of_events(spark):
    """Rows, instants and diagonals of events against the plain rule over all pairs of members."""
    data = spark.createDataFrame([(r[0], *r) for r in ROWS], "id string, provider_key string, acquired_at timestamp, longitude double, latitude double")
    members = clustering.cluster(data).repartition(5)
    groups = {}
    for r in members.collect():
        groups.setdefault(r.event_id, []).append((r.longitude, r.latitude, r.acquired_at))
    got = {r.event_id: (r.n, r.first, r.last, round(r.diagonal_km, 9)) for r in clustering.event_shapes(members).collect()}
    wide = lambda g: max(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a in g for b in g) * 111
    assert got == {e: (len(g), min(x[2] for x in g), max(x[2] for x in g), round(wide(g), 9)) for e, g in groups.items()}
    assert clustering.event_shapes(members.limit(0)).count() == 0


def test_events_are_told_where_they_are_found(spark, monkeypatch):
    """Measures of a sweep over groups, large groups and slices, against the shapes of its rows; no row of a member is made."""
    sets = [ClusteringParams("a"), ClusteringParams("b", min_score=0.5)]
    data = spark.createDataFrame([(r[0], *r, ["VIIRS", "MODIS", None][k % 3]) for k, r in enumerate(never_silent(200) + cloud(5, 150))], "id string, provider_key string, acquired_at timestamp, longitude double, latitude double, sensor string")
    data = data.withColumn("provider_key", F.concat("provider_key", F.monotonically_increasing_id().cast("string"))).withColumn("id", F.col("provider_key")).localCheckpoint()
    plain = lambda shapes: {(r.version, r.event_id): (r.n, r.first, r.last, round(r.diagonal_km, 9), r.sensor_count) for r in shapes.collect()}
    wanted = plain(clustering.event_shapes(clustering.sweep(data, sets).join(data.select("id", "sensor"), "id")))
    assert len({v for v, _ in wanted}) == 2 and max(x[0] for x in wanted.values()) > 5
    made, real = [], clustering.attach_closed
    monkeypatch.setattr(clustering, "attach_closed", lambda *a: made.append(a) or real(*a))
    monkeypatch.setattr(clustering, "_HULL_PLACES", 4)
    for group, large in ((50_000, 2_000_000), (40, 2_000_000), (50_000, 150)):
        monkeypatch.setattr(clustering, "GROUP_ROWS", group)
        monkeypatch.setattr(clustering, "LARGE_ROWS", large)
        assert plain(clustering.sweep_shapes(data, sets)) == wanted and not made
    monkeypatch.setattr(clustering, "GROUP_ROWS", 40)
    lost = data.unionByName(data.limit(1).withColumn("longitude", F.lit(None).cast("double")))
    with pytest.raises(Exception, match="no coordinate"):
        clustering.sweep_shapes(lost, sets).collect()


def test_reach_is_told_once(monkeypatch):
    """Every group starts a replay, and there are as many groups as fires."""
    asked, real = [], clustering.np.linspace
    monkeypatch.setattr(clustering.np, "linspace", lambda *a: asked.append(a) or real(*a))
    p = ClusteringParams("only here", base_radius_m=1234)
    assert len({clustering.Replay(p).reach_m for _ in range(50)}) == 1 and len(asked) <= 1


def test_older_events_are_not_measured(monkeypatch):
    """Events are asked in order of their last instants, and no further than it takes to win."""
    asked, pair = [], clustering.geodesic_pair_m
    monkeypatch.setattr(clustering, "geodesic_pair_m", lambda *a: asked.append(a) or pair(*a))
    replay = clustering.Replay(ClusteringParams())
    for k in range(10):
        replay.know(f"e{k}", 6.0 + k / 1000, 44.0, int(k * 3.6e9), (0, f"e{k}"))
    assert replay.attach(6.0095, 44.0, int(10 * 3.6e9), "n")[0] == "e9" and len(asked) == 1


def test_small_slices_search_no_components(spark, monkeypatch):
    """Few rows and open places are one group: no neighbours are joined, and the events are those of the rule."""
    rows = never_silent(90)
    whole = clustering.rows_of(spark.createDataFrame([(r[0], *r) for r in rows], "id string, provider_key string, acquired_at timestamp, longitude double, latitude double"))
    for name in ("closed_components", "nearby"):
        monkeypatch.setattr(event_state, name, lambda *a: pytest.fail("searched"))
    got = {r.provider_key: r.event_id for r in event_state.replay_slices(whole, ClusteringParams(), 30).collect()}
    assert got == sequential(rows, ClusteringParams())
