import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from firegrid.functions.geo import convex_hull, geodesic_direct, geodesic_m, polygon_covers
from firegrid.operators import shapes
from firegrid.operators.tiles import doubled_area

SCHEMA = "region string, rings array<array<struct<lon:double,lat:double>>>"


def box(x, y, w=1.0, h=1.0):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def frame(spark, rows):
    return spark.createDataFrame([(k, [[(float(a), float(b)) for a, b in r] for r in rings]) for k, rings in rows], SCHEMA)


def test_dissolve_cancels_shared_edges(spark):
    grid = [("A", [box(x, y)]) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [("B", [box(9, 9)])]
    got = {r.region: r.rings for r in shapes.dissolve(frame(spark, grid), "region").collect()}
    assert sorted(len(r) for r in got["A"]) == [5, 13] and len(got["B"]) == 1  # an outline with a hole
    edges = {(p.lon, p.lat) for r in got["A"] for p in r}
    assert (1.0, 1.0) in edges and (0.0, 0.0) in edges


def test_simplify_area_and_inner_points(spark):
    wavy = [(x / 10, 0.0001 * (x % 2)) for x in range(11)] + [(1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    ushape = [(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3), (0, 0)]
    df = frame(spark, [("wavy", [wavy]), ("u", [ushape]), ("ring", [box(0, 0, 4, 4), box(1, 1, 2, 2)])])
    rows = {r.region: r for r in df.select("region", "rings", shapes.simplify("rings").alias("small"), shapes.area_km2("rings").alias("area"), shapes.inner_point("rings").alias("p")).collect()}
    assert len(rows["wavy"].small[0]) == 5 and len(rows["u"].small[0]) == len(ushape)
    assert rows["ring"].area == pytest.approx(12308 * 12, rel=5e-3)
    inside = df.join(spark.createDataFrame([(k, r.p.lon, r.p.lat) for k, r in rows.items()], "region string, x double, y double"), "region")
    assert all(r[0] for r in inside.select(polygon_covers(F.col("rings"), F.col("x"), F.col("y"))).collect())


@pytest.mark.parametrize("lat", [0.0, 45.0, 80.0, -33.0])
def test_buffers_lie_at_their_distance(spark, lat):
    """Every vertex of the ring is 190 m from the hull's nearest vertex, and no hull vertex is nearer."""
    rng = np.random.default_rng(3)
    clouds = [np.array([[6.0, lat]]), np.array([[6.0, lat], [6.02, lat + 0.01]]), np.column_stack([6 + rng.normal(0, 0.02, 60), lat + rng.normal(0, 0.01, 60)]), np.array([[179.9999, lat], [179.9999, lat + 0.01], [179.99, lat]])]
    points = [(str(k), float(x), float(y)) for k, c in enumerate(clouds) for x, y in c]
    df = spark.createDataFrame([*points, ("0", None, 1.0)], "id string, longitude double, latitude double")
    rings = {r.id: np.array([(p.lon, p.lat) for p in r.ring]) for r in shapes.buffered_groups(df, "id").collect()}
    assert len(rings) == len(clouds)
    for k, cloud in enumerate(clouds):
        ring, hull = rings[str(k)], convex_hull(cloud)
        away = np.array([geodesic_m(np.full(len(hull), x), np.full(len(hull), y), hull[:, 0], hull[:, 1]).min() for x, y in ring])
        assert np.all(abs(away - 190) < 0.1) and tuple(ring[0]) == tuple(ring[-1]) and doubled_area(ring[:-1]) > 0
        edges = np.roll(hull, -1, axis=0) - hull
        for x, y in ring if len(hull) > 2 else []:
            inside = [e[0] * (y - h[1]) - e[1] * (x - h[0]) >= 0 for h, e in zip(hull, edges, strict=True)]
            assert not all(inside)


def test_direct_and_inverse_agree():
    rng = np.random.default_rng(1)
    lon, lat, turn, way = rng.uniform(-180, 180, 500), rng.uniform(-89, 89, 500), rng.uniform(0, 2 * np.pi, 500), rng.uniform(1, 500_000, 500)
    x, y = geodesic_direct(lon, lat, turn, way)
    assert np.all(abs(geodesic_m(lon, lat, x, y) - way) < 1e-3)


def test_bow_tie_and_friends():
    ring = lambda *xy: np.array([*xy, xy[0]], float)
    tie = shapes.repaired([ring((0, 0), (2, 2), (2, 0), (0, 2))])
    assert len(tie) == 2 and sorted(doubled_area(r[:-1]) / 2 for r in tie) == [1.0, 1.0]
    holed = shapes.repaired([ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (3, 1), (3, 3), (1, 3))])
    assert sorted(doubled_area(r[:-1]) / 2 for r in holed) == [-4.0, 16.0]
    spike = shapes.repaired([ring((0, 0), (2, 0), (2, 2), (2, 5), (2, 2), (0, 2))])
    assert len(spike) == 1 and doubled_area(spike[0][:-1]) / 2 == 4.0
    assert shapes.repaired([ring((0, 0), (1, 1), (0, 0), (1, 1))]) == [] and shapes.repaired([]) == []


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6), st.integers(4, 14), st.booleans())
def test_random_rings_against_points(seed, n, whole):
    """Even-odd membership of random places is the same before and after, and no two segments cross any more."""
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 6, (n, 2)).astype(float) if whole else rng.uniform(0, 6, (n, 2))
    raw = [np.vstack([points, points[:1]])]
    done = shapes.repaired(raw)

    def inside(rings, x, y):
        odd = False
        for r in rings:
            a, b = r[:-1], r[1:]
            spans = (a[:, 1] > y) != (b[:, 1] > y)
            at = a[spans, 0] + (y - a[spans, 1]) / (b[spans, 1] - a[spans, 1]) * (b[spans, 0] - a[spans, 0])
            odd ^= bool(np.count_nonzero(at < x) % 2)
        return odd

    for x, y in rng.uniform(0, 6, (60, 2)):
        assert inside(raw, x, y) == inside(done, x, y)
    assert all(tuple(r[0]) == tuple(r[-1]) for r in done)
    xs, ys = rng.uniform(0, 6, 20000), rng.uniform(0, 6, 20000)
    share = np.mean([inside(raw, x, y) for x, y in zip(xs[:400], ys[:400], strict=True)])
    assert abs(sum(doubled_area(r[:-1]) / 2 for r in done) - 36 * share) < 36 * 0.12


def test_repair_in_a_column(spark):
    got = frame(spark, [("tie", [[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]), ("none", [])]).withColumn("fixed", shapes.repaired_rings("rings"))
    assert {r.region: len(r.fixed) for r in got.collect()} == {"tie": 2, "none": 0}


def test_rings_are_repaired(spark):
    rows = [("a", [[(0, 0), (0, 0), (1, 0), (1, 1)], [(5, 5), (6, 6)]])]
    got = frame(spark, rows).select(shapes.valid_rings(F.col("rings"))).first()[0]
    assert [[tuple(p) for p in r] for r in got] == [[(0, 0), (1, 0), (1, 1), (0, 0)]]
