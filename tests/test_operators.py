import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from firegrid.functions.geo import geodesic_m
from firegrid.functions.rules import ClusteringParams
from firegrid.operators import clustering, corpus, event_state, spatial
from firegrid.sources import providers, sinks

T0 = datetime(2024, 1, 1)


def sequential(rows, params):
    """The rule, straight: every earlier member of every event is a candidate."""
    events, owner, ids = [], [], []
    for i, (key, at, lon, lat) in enumerate(rows):
        nearest = {}
        before = np.array([r[2:] for r in rows[:i]]).reshape(-1, 2)
        for j, d in enumerate(geodesic_m(before[:, 0], before[:, 1], np.full(i, lon), np.full(i, lat)).tolist() if i else []):
            if d <= params.max_radius_m:
                nearest[owner[j]] = min(d, nearest.get(owner[j], 1e18))
        best, score = None, 0.0
        for d, e in sorted((d, e) for e, d in nearest.items()):
            hours = (at - events[e]).total_seconds() / 3600
            if 0 <= hours <= params.attach_window_hours:
                radius = min(params.base_radius_m + params.growth_m_per_hour * hours, params.max_radius_m)
                s = round((1 - d / radius) * (1 - hours / params.attach_window_hours), 6) if d <= radius else 0.0
                if s > score:
                    best, score = e, s
        if best is None or score < params.min_score:
            best = len(events)
            events.append(at)
            ids.append(clustering.founder_id(key))
        events[best] = max(events[best], at)
        owner.append(best)
    return {r[0]: ids[o] for r, o in zip(rows, owner, strict=True)}


def cloud(seed, n=120, span_h=200, side=0.4):
    rng = random.Random(seed)
    rows, x, y = [], 6.0, 43.5
    for k in range(n):
        if rng.random() < 0.3:
            x, y = 6.0 + rng.random() * side, 43.5 + rng.random() * side
        x, y = x + rng.gauss(0, 0.01), y + rng.gauss(0, 0.01)
        rows.append((f"k{k:04d}", T0 + timedelta(minutes=rng.randrange(span_h * 60)), round(x, 5), round(y, 5)))
    return sorted(rows, key=lambda r: (r[1], r[0]))


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([ClusteringParams(), ClusteringParams(min_score=0.2, attach_window_hours=48), ClusteringParams(base_radius_m=1000, min_score=0.65)]))
def test_kernel_is_the_sequential_rule(seed, params):
    rows = cloud(seed, 45)
    micros = np.array([int((r[1] - T0).total_seconds() * 1e6) for r in rows])
    lon, lat = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    got, _ = clustering.attach(lon, lat, micros, [r[0] for r in rows], [None] * len(rows), params)
    assert dict(zip([r[0] for r in rows], got, strict=True)) == sequential(rows, params)


def frame(spark, rows):
    return spark.createDataFrame([(r[0], *r) for r in rows], "id string, provider_key string, acquired_at timestamp, longitude double, latitude double")


def test_parallel_equals_sequential_and_chunks(spark):
    rows = cloud(3, 90) + [("walk%d" % k, T0 + timedelta(hours=5 * k), 8.0 + 0.015 * k, 44.0) for k in range(30)]
    rows.sort(key=lambda r: (r[1], r[0]))
    expected = sequential(rows, ClusteringParams())
    whole = clustering.cluster(frame(spark, rows))
    assert {r.provider_key: r.event_id for r in whole.collect()} == expected
    members = None
    for part in (rows[:40], rows[40:80], rows[80:]):
        members = clustering.shared_checkpoint(clustering.cluster(frame(spark, part), members))
    assert {r.provider_key: r.event_id for r in members.collect()} == expected
    signature = clustering.partition_signature
    assert signature(whole).first().signature == signature(members).first().signature


def test_silence_is_counted_from_the_events_last_member(spark):
    hours_metres = [(0, 0), (0.1, 1500), (0.2, 3000), (0.3, 4500), (10, 4500), (16, 0)]
    rows = [(f"k{i}", T0 + timedelta(hours=h), 6.0 + m / 80000, 44.0) for i, (h, m) in enumerate(hours_metres)]
    assert {r.event_id for r in clustering.cluster(frame(spark, rows)).collect()} == {clustering.founder_id("k0")}


GLOBE = [(14.0, 80.0), (-179.999, 10.0), (179.999, -10.0), (30.0, 89.95), (-60.0, -89.9), (0.0, 0.0)]


def around_the_globe(seed, n):
    """Drifting clouds at high latitudes, at the poles and on both sides of the 180th meridian."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        lon, lat = rng.choice(GLOBE)
        lat += rng.gauss(0, 0.02)
        lon += rng.gauss(0, 0.02) / max(0.002, float(np.cos(np.radians(min(89.9, abs(lat))))))
        rows.append((f"k{k:04d}", T0 + timedelta(minutes=rng.randrange(60 * 60)), (lon + 540) % 360 - 180, max(-90.0, min(90.0, lat))))
    return sorted(rows, key=lambda r: (r[1], r[0]))


def test_clusters_at_the_poles_and_across_the_180th_meridian(spark, monkeypatch):
    rows = around_the_globe(5, 160)
    expected = sequential(rows, ClusteringParams())
    assert {r.provider_key: r.event_id for r in clustering.cluster(frame(spark, rows)).collect()} == expected
    monkeypatch.setattr(clustering, "GROUP_ROWS", 10)  # cubes and pieces, in place of one group
    assert {r.provider_key: r.event_id for r in clustering.cluster(frame(spark, rows)).collect()} == expected
    assert len({*expected.values()}) < 120


def never_silent(n, seed=2):
    """Rows that follow each other within minutes, in some drifting fires: one component of all."""
    rng, fires = random.Random(seed), [[6.0 + 0.03 * k, 43.5] for k in range(4)]
    rows = []
    for k in range(n):
        fire = rng.choice(fires)
        fire[0], fire[1] = fire[0] + rng.gauss(0, 0.002), fire[1] + rng.gauss(0, 0.002)
        rows.append((f"k{k:06d}", T0 + timedelta(minutes=10 * k + rng.randrange(10)), round(fire[0], 2), round(fire[1], 2)))
    return sorted(rows, key=lambda r: (r[1], r[0]))


def test_slices_of_a_component_that_is_never_silent(spark, monkeypatch):
    rows = never_silent(300)
    whole = frame(spark, rows)
    expected = {r.provider_key: (r.event_id, r.score) for r in clustering.cluster(whole).collect()}
    assert {k: e for k, (e, _) in expected.items()} == sequential(rows, ClusteringParams())
    monkeypatch.setattr(clustering, "LARGE_ROWS", 90)
    held, real = [], event_state.attach_closed
    monkeypatch.setattr(event_state, "attach_closed", lambda closed, sets: (held.append(closed.count()), real(closed, sets))[1])
    assert {r.provider_key: (r.event_id, r.score) for r in clustering.cluster(whole).collect()} == expected
    assert len(held) >= 3 and max(held) < 250  # a slice and the open places near it, never all


def test_forgotten_events_change_nothing():
    replay = clustering.Replay(ClusteringParams())
    replay.know("a", 6.0, 44.0, 0, (0, "a"))
    replay.know("b", 7.0, 44.0, int(20 * 3.6e9), (0, "b"))
    replay.forget(int(21 * 3.6e9))
    assert replay.places == 1 and [*replay.slot_of] == ["b"]
    assert replay.attach(7.0, 44.0, int(21 * 3.6e9), "c")[0] == "b"
    assert replay.attach(6.0, 44.0, int(21 * 3.6e9), "d")[0] == clustering.founder_id("d")


def test_empty_input(spark):
    assert clustering.cluster(frame(spark, [])).count() == 0


def test_corpus_rules(spark):
    d = lambda s: datetime.fromisoformat(s)
    rows = [
        ("SNPP", "standard", "fire_archive_a.csv", d("2024-01-10"), 1.0, 1.0),
        ("SNPP", "nrt", "fire_nrt_a.csv", d("2024-01-10"), 2.0, 1.0),  # on the bound: dropped
        ("SNPP", "nrt", "fire_nrt_a.csv", d("2024-01-11"), 1.0, 1.0),
        ("SNPP", "nrt", "fire_nrt_b.csv", d("2024-01-11"), 1.0, 1.0),  # a duplicate: the first file stays
        ("N21", "nrt", "fire_nrt_c.csv", d("2020-01-01"), 1.0, 1.0),  # no standard: kept
    ]
    df = spark.createDataFrame(rows, "satellite string, corpus string, source_file string, detected_at timestamp, latitude double, longitude double")
    got = {(r.satellite, r.source_file) for r in corpus.merge(df).collect()}
    assert got == {("SNPP", "fire_archive_a.csv"), ("SNPP", "fire_nrt_a.csv"), ("N21", "fire_nrt_c.csv")}
    shuffled = corpus.merge(df.orderBy(F.desc("source_file")))
    keys = ["satellite", "detected_at", "latitude", "longitude"]
    assert corpus.fingerprint(shuffled, keys).first() == corpus.fingerprint(corpus.merge(df), keys).first()
    with pytest.raises(Exception, match="unexpected file name"):
        spark.range(1).select(corpus.corpus_label(F.lit("other.csv"))).collect()


def test_static_sources(spark):
    rows = [(6.0 + 0.0001 * (k % 5), 44.0, 2, T0 + timedelta(days=31 * m)) for m in range(7) for k in range(4)]
    rows += [(7.0, 44.0, 2, T0 + timedelta(days=k)) for k in range(30)]  # one season only
    rows += [(8.0, 44.0, 2, T0 + timedelta(days=40 * k)) for k in range(10)]  # too few
    df = spark.createDataFrame(rows, "longitude double, latitude double, type int, detected_at timestamp")
    got = corpus.derive_static_sources(df).collect()
    assert [(r.detection_count, r.month_count, r.match_radius_m) for r in got] == [(28, 7, 500)]


def test_strata(spark):
    s = (corpus.Stratum("a", 0, 1, 0, 1, "2024-01-01", "2024-02-01"), corpus.Stratum("b", 1, 2, 0, 1, "2024-01-01", "2024-02-01"))
    df = spark.createDataFrame([(1.0, 1.0, T0), (0.5, 0.5, datetime(2024, 2, 1)), (2.0, 0.0, T0)], "longitude double, latitude double, detected_at timestamp")
    assert [r.strata for r in corpus.extract_strata(df, s).collect()] == [["a", "b"], ["b"]]
    assert {r.stratum: r.n for r in corpus.stratum_report(df, s).collect()} == {"a": 1, "b": 2, "overlap": 1}
    with pytest.raises(ValueError):
        corpus.extract_strata(df, s + s)


def test_distance_join_against_brute_force(spark):
    rng = np.random.default_rng(5)
    left = [(str(k), float(x), float(y)) for k, (x, y) in enumerate(rng.uniform([5, 43], [6, 44], (150, 2)))]
    right = [(f"s{k}", float(x), float(y), int(r), True) for k, (x, y, r) in enumerate(rng.uniform([5, 43, 500], [6, 44, 15000], (25, 3)))]
    expected = {}
    for i, x, y in left:
        hits = sorted((float(geodesic_m([x], [y], [a], [b])[0]), k) for k, a, b, r, _ in right if geodesic_m([x], [y], [a], [b])[0] <= r)
        expected[i] = hits[0][1] if hits else None
    got = spatial.classify_known(spark.createDataFrame(left, "id string, longitude double, latitude double"), spark.createDataFrame(right, "source_key string, longitude double, latitude double, match_radius_m int, is_active boolean"))
    assert {r.id: r.known_source_key for r in got.collect()} == expected


def test_radius_search_anywhere(spark):
    rng = random.Random(11)
    right = [(f"s{k}", *rng.choice(GLOBE), r, True) for k, r in enumerate([1.0, 300.0, 500.0, 501.0, 4_000.0, 20_000.0, 60_000.0, 900_000.0, 3_000_000.0] * 3)]
    left = [(str(k), r[2], r[3]) for k, r in enumerate(around_the_globe(9, 120))] + [("d1", 15.0, 80.0), ("d2", 179.999, 10.0), ("n", None, 3.0)]
    expected = {(i, k) for i, x, y in left if x is not None for k, a, b, r, _ in right if geodesic_m([x], [y], [a], [b])[0] <= r}
    sides = spark.createDataFrame(left, "id string, longitude double, latitude double"), spark.createDataFrame(right + [("none", None, 1.0, 5.0, True)], "source_key string, lon2 double, lat2 double, r double, a boolean")
    got = spatial.within_distance(*sides, F.col("r"))
    assert {(r.id, r.source_key) for r in got.collect()} == expected and len(expected) > 250 and got.count() == len(expected)
    assert spatial.within_distance(sides[0], sides[1].limit(0), F.col("r")).count() == 0


def test_polygons_with_holes_and_borders(spark):
    p = lambda *xy: [(float(x), float(y)) for x, y in xy]
    outer, hole = p((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), p((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))
    concave = p((4, 0), (8, 0), (8, 4), (6, 1), (4, 4), (4, 0))
    area = "code string, rings array<array<struct<lon:double,lat:double>>>, lon_min double, lon_max double, lat_min double, lat_max double, centre_lon double, centre_lat double"
    areas = spark.createDataFrame([("A", [outer, hole], 0.0, 4.0, 0.0, 4.0, 2.0, 2.0), ("B", [concave], 4.0, 8.0, 0.0, 4.0, 6.0, 2.0)], area)
    cases = {"in": (3, 3, "A"), "hole": (1.5, 1.5, None), "hole edge": (1, 1.5, "A"), "corner": (0, 0, "A"), "shared": (4, 2, "A"), "notch": (6, 3, None), "b": (7.5, 2, "B"), "out": (9, 9, None)}
    pts = spark.createDataFrame([(k, float(v[0]), float(v[1])) for k, v in cases.items()], "id string, longitude double, latitude double")
    assert {r.id: r.code for r in spatial.point_in_polygon(pts, areas).collect()} == {k: v[2] for k, v in cases.items()}


def test_csv_scan_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(
        "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight\n"
        "43.50000,6.10000,330.1,0.4,0.4,2024-01-01,45,N20,VIIRS,n,2.0NRT,290.0,4.2,D\n"
        "x,6.1,330,0.4,0.4,2024-01-01,45,N20,VIIRS,n,2.0NRT,290,4.2,D\n"
    )
    rows = providers.read_csv(spark, str(tmp_path / "in"))
    parsed = providers.parse_rows(rows, "VIIRS_NOAA20_NRT")
    ok = providers.accepted(parsed).collect()
    assert len(ok) == 1 and ok[0].acquired_at == datetime(2024, 1, 1, 0, 45) and ok[0].brightness == 330.1 and ok[0].confidence_score == 0.6
    assert [r.rejects for r in providers.rejected(parsed).collect()] == [["latitude"]]
    import hashlib

    assert ok[0].provider_key == hashlib.sha256(b"nasa_firms|VIIRS_NOAA20_NRT|N20|VIIRS|2024-01-01T00:45:00+00:00|43.50000|6.10000|2.0NRT").hexdigest()
    store = str(tmp_path / "store")
    for _ in range(2):
        stored = sinks.append_detections(providers.accepted(parsed), store)
    assert stored.count() == 1 and sinks.between_times(stored, "2024-01-01", "2024-01-02").count() == 1
    with pytest.raises(ValueError), sinks.import_run(spark, str(tmp_path / "runs"), "s", "j") as run:
        run["records_read"] = 3
        raise ValueError("broken")
    assert [(r.status, r.records_read, r.error) for r in spark.read.parquet(str(tmp_path / "runs")).collect()] == [("failed", 3, "broken")]
    assert spark.range(1).select(providers.looks_like_csv(F.lit("Invalid key"))).first()[0] is False


def test_geojson(spark):
    body = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},"properties":{"code":"83001","nom":"Les Adrets","codesPostaux":["83600"],"surface":2310,"centre":{"type":"Point","coordinates":[6.8,43.5]}}},{"type":"Feature","geometry":null,"properties":{"code":"x","nom":""}}]}'
    rows = providers.parse_features(spark.createDataFrame([(body,)], "body string")).collect()
    assert rows[0].department_code == "83" and rows[0].area_km2 == 23.1 and rows[0].polygons[0][0][1].lon == 1.0 and rows[0].rejects == []
    assert rows[1].rejects == ["code", "name", "department", "geometry"]


def test_latest_bulletin(spark):
    tree = '{"2024":{"01":{"02":{"0600":["CDP_CARTE_EXTERNE.json"],"1600":["other.txt"]}}}}'
    got = providers.latest_bulletin(spark.createDataFrame([(tree,)], "tree string")).collect()
    assert [(r.day, r.stamp) for r in got] == [("02", "0600")]
