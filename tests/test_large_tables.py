"""What only larger tables show: more sites, larger groups, many small ones."""

import datetime

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from firegrid.functions import geo, text
from firegrid.operators import clustering, corpus, search, shapes, spatial, tiles
from firegrid.sources import bulletins


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def make(spark, path, rows: list[tuple]):
    """A folder with an events table of (event_id, user_id)."""
    at = datetime.datetime(2024, 1, 2, 12)
    kind = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(e, at, u, "view", 1.0, "{}") for e, u in rows], kind).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["j9_point_in_polygon", "j10_department_fallback", "q9_resolve_municipality", "q9_resolve_all"])
def test_sites_west_of_the_areas(spark, tmp_path, name):
    """User 4364 lies one band west of the areas, where the SQL's division still gives band 0; user 4363 lies beyond."""
    path = make(spark, tmp_path, [(k, u) for k, u in enumerate([4364, 4363, 4364 - 15, 0, 14, 149, 150, 4350])])
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    assert {tuple(r) for r in entry.queries()[name](spark, path).collect()} == {*want}
    assert sum((code or "").startswith("D") for _, code in want) == 4


def test_buffers_of_many_groups(spark):
    """Small groups share a task's batches; rings are those of each hull alone."""
    hulls = [np.array(h, float) for h in ([(2, 45)], [(2, 45), (2.1, 45.05)], [(3, 44), (3.1, 44), (3.1, 44.1), (3, 44.1)])]
    for ring, hull in zip(shapes._buffers(hulls, 190, 32), hulls, strict=True):
        np.testing.assert_allclose(ring, shapes._buffers([hull], 190, 32)[0], rtol=0, atol=1e-12)
    points = spark.createDataFrame([(k, float(x), float(y)) for k, h in enumerate(hulls) for x, y in h.tolist()] + [(None, 5.0, 45.0)], "id int, longitude double, latitude double")
    rings = shapes.buffered_groups(points, "id")
    assert "FlatMapGroups" not in plan(rings)
    assert {r.id: len(r.ring) for r in rings.collect()} == {None: 33, **{k: len(shapes._buffers([h], 190, 32)[0]) for k, h in enumerate(hulls)}}


def test_equal_polygons_are_repaired_once(spark):
    point = lambda x, y: {"lon": float(x), "lat": float(y)}
    tie = [[point(0, 0), point(2, 2), point(2, 0), point(0, 2), point(0, 0)]]
    kind = pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))
    polygons, at = shapes.distinct_polygons(pa.array([tie, None, [], tie, tie + tie, [[]]], kind).slice(0))
    assert at.tolist() == [0, -1, 1, 0, 2, 3] and [len(p) for p in polygons] == [1, 0, 2, 1]
    df = spark.createDataFrame([(k, p) for k, p in enumerate([tie, None, [], tie])], f"id int, rings array<{shapes.RING}>").coalesce(1)
    got = {r.id: r.fixed for r in df.select("id", shapes.repaired_rings("rings").alias("fixed")).collect()}
    assert got[1] is None and got[2] == [] and got[0] == got[3] and len(got[0]) == 2


def test_only_the_nearest_places_are_measured(monkeypatch):
    """A crowded event costs a few geodesics a detection, and the distance is that of its nearest place."""
    asked = []
    pair = clustering.geodesic_pair_m
    monkeypatch.setattr(clustering, "geodesic_pair_m", lambda *a: asked.append(a) or pair(*a))
    replay = clustering.Replay(clustering.REFERENCE)
    places = [(2 + x / 1000, 45 + y / 1000) for x in range(20) for y in range(15)]
    for lon, lat in places:
        replay.know("E", lon, lat, 0, (0, "k"))
    event, score = replay.attach(2.0104, 45.0071, 3_600_000_000, "n")
    d = geo.geodesic_m(np.full(300, 2.0104), np.full(300, 45.0071), *zip(*places, strict=True)).min()
    p = clustering.REFERENCE
    radius = min(p.base_radius_m + p.growth_m_per_hour, p.max_radius_m)
    assert event == "E" and score == round((1 - d / radius) * (1 - 1 / p.attach_window_hours), 6) and len(asked) < 10
    assert pair(2.0, 45.0, 2.01, 45.02) == pytest.approx(float(geo.geodesic_m([2.0], [45.0], [2.01], [45.02])[0]), abs=1e-6)


def test_no_satellite_is_one_task(spark):
    """Superseded rows are told without putting each satellite's corpus in one task."""
    rows = spark.createDataFrame([("N20", "standard", 1), ("N20", "nrt", 1), ("N20", "nrt", 2), ("N21", "nrt", 1)], "satellite string, corpus string, detected_at int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus.drop_superseded(rows)
        assert "SortMergeJoin" not in plan(kept)
        assert sorted((r.satellite, r.corpus, r.detected_at) for r in kept.collect()) == [("N20", "nrt", 2), ("N20", "standard", 1), ("N21", "nrt", 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sources_of_one_place_are_joined_once(spark, monkeypatch):
    joined = []
    within = spatial.within_distance
    monkeypatch.setattr(spatial, "within_distance", lambda left, right, radius: joined.append(right.count()) or within(left, right, radius))
    det = spark.createDataFrame([("a", 2.0, 45.0), ("b", 2.02, 45.0), ("c", 9.0, 45.0)], "id string, longitude double, latitude double")
    sources = spark.createDataFrame([(f"s{k}", 2.0, 45.0, 500 + k % 2 * 1500, True) for k in range(40)] + [("r", 2.0, 45.0, 9000, False)], "source_key string, longitude double, latitude double, match_radius_m int, is_active boolean")
    got = {r.id: r.known_source_key for r in spatial.classify_known(det, sources).collect()}
    assert got == {"a": "s0", "b": "s1", "c": None} and joined == [2]


def test_tiles_are_dealt_before_they_are_cut(spark):
    point = lambda x, y: {"lon": float(x), "lat": float(y)}
    ring = [point(2, 45), point(2.5, 45), point(2.5, 45.5), point(2, 45.5), point(2, 45)]
    rows = spark.createDataFrame([(f"c{k}", [ring], 2.0, 2.5, 45.0, 45.5) for k in range(6)], f"code string, rings array<{shapes.RING}>, lon_min double, lon_max double, lat_min double, lat_max double")
    cut = tiles.clip_to_tiles(rows.coalesce(1), 8, margin=64)
    assert "RepartitionByExpression" in plan(cut)
    parts = {}
    for r in cut.collect():
        parts.setdefault(r.code, set()).add((r.x, r.y, r.area, str(r.rings)))
    assert len(parts) == 6 and all(p == parts["c0"] for p in parts.values()) and len(parts["c0"]) > 1


def test_bulletins_are_dealt_before_they_are_counted(spark):
    """A partial count over bulletins that are all different would hold a whole file's in one task."""
    rows = spark.createDataFrame([("a", 1, "x", None), ("a", 1, "w", "bad"), ("b", 1, None, None)], "bulletin_domain string, published_at int, snapshot_id string, reject string")
    counted = bulletins.bulletins_of(rows)
    assert "RepartitionByExpression" in plan(counted)
    assert sorted(counted.collect()) == [("a", 1, "w", 1, 1), ("b", 1, None, 1, 0)]


def test_closest_names_by_blocks(spark, monkeypatch):
    """Names and searches in many blocks; each block gives no more than its closest names."""
    monkeypatch.setattr(search, "NAMES", 12)
    monkeypatch.setattr(search, "SEARCHES", 2)
    names = spark.createDataFrame([(f"{k:05}", f"Customer#{k % 40:03}", ["1"]) for k in range(60)], "insee_code string, name string, postal_codes array<string>")
    asked = spark.createDataFrame([(k, f"customer {k * 9:03}") for k in range(5)] + [(9, "")], "search_id int, q string")
    norm = text.normalize_name(F.col("name"))
    told = names.select("insee_code", "name", text.trigrams(norm).alias("grams"))
    wanted = asked.filter("q <> ''").select("search_id", text.trigrams(F.col("q")).alias("asked"))
    pairs = {}
    for r in told.crossJoin(wanted).withColumn("s", text.similarity(F.col("grams"), F.col("asked"))).filter("s >= 0.3").collect():
        pairs.setdefault(r.search_id, []).append((-r.s, r.name, r.insee_code))
    got = search.closest_names(told, wanted.withColumnRenamed("asked", "grams"), 3).collect()
    assert len(got) < sum(map(len, pairs.values()))
    for k, every in pairs.items():
        assert {x[2] for x in sorted(every)[:3]} <= {r.insee_code for r in got if r.search_id == k}
    first = {(r.search_id, r.place): r.insee_code for r in search.search_many(names, asked, 3).collect()}
    assert first[0, 1] == "00000" and first[0, 2] == "00040" and (9, 1) not in first
