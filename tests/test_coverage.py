"""Noded dissolve, levels and simplification of areas that tile a territory."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from firegrid.operators import coverage
from firegrid.operators.tiles import doubled_area

SCHEMA = "code string, department string, region string, rings array<array<struct<lon:double,lat:double>>>"


def box(x, y, w=1.0, h=1.0):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def area(rings):
    return sum(doubled_area(np.array([(p.lon, p.lat) for p in r])[:-1]) / 2 for r in rings)


def test_bricks_dissolve_over_t_junctions(spark):
    """Rows of bricks that are half a brick apart: no two neighbours in different rows share an edge."""
    rows = [(f"{i}-{j}", "east" if i >= 3 else "west", "all", [box(float(i) + 0.5 * (j % 2), float(j))[:: -1 if (i + j) % 3 == 0 else 1]]) for i in range(6) for j in range(4)]
    levels = coverage.dissolve_levels(spark.createDataFrame(rows, SCHEMA), "code", ["department", "region"])
    got = {r.department: r.rings for r in coverage.rings_of(levels["department"], "department").collect()}
    assert {k: len(v) for k, v in got.items()} == {"east": 1, "west": 1} and area(got["east"]) == area(got["west"]) == 12.0
    whole = coverage.rings_of(levels["region"], "region").first().rings
    assert len(whole) == 1 and area(whole) == 24.0
    assert {r.area for r in coverage.planar_area(levels["department"], "department").collect()} == {12.0}
    inner = {(p.lon, p.lat) for r in whole for p in r} & {(float(i), float(j)) for i in range(2, 5) for j in range(1, 3)}
    assert not inner


def test_holes_and_touching_corners(spark):
    ring = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    rows = [(f"r{x}{y}", "ring", "a", [box(float(x), float(y))]) for x, y in ring] + [("d1", "corners", "b", [box(10.0, 0.0)]), ("d2", "corners", "b", [box(11.0, 1.0)])]
    rows += [("h", "holed", "c", [box(20.0, 0.0, 4.0, 4.0), box(21.0, 1.0, 2.0, 2.0)]), ("i", "holed", "c", [box(21.0, 1.0, 2.0, 2.0)])]
    levels = coverage.dissolve_levels(spark.createDataFrame(rows, SCHEMA), "code", ["department"])
    got = {r.department: r.rings for r in coverage.rings_of(levels["department"], "department").collect()}
    assert sorted(area([r]) for r in got["ring"]) == [-1.0, 9.0] and sorted(area([r]) for r in got["corners"]) == [1.0, 1.0]
    assert [area([r]) for r in got["holed"]] == [16.0]


def wavy_grid(seed, n=4, steps=12):
    """Cells whose common borders are the same wavy lines, split where a row has another number of cells."""
    rng = random.Random(seed)

    def line(a, b):
        normal = (a[1] - b[1], b[0] - a[0])
        inner = [(a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t, 0.04 * rng.uniform(-1, 1)) for t in [k / steps for k in range(1, steps)]]
        return [a, *((x + normal[0] * w, y + normal[1] * w) for x, y, w in inner), b]

    h = {(i, j): line((float(i), float(j)), (i + 1.0, float(j))) for i in range(n) for j in range(n + 1)}
    v = {(i, j): line((float(i), float(j)), (float(i), j + 1.0)) for i in range(n + 1) for j in range(n)}
    cells = {(i, j): h[i, j] + v[i + 1, j][1:] + h[i, j + 1][::-1][1:] + v[i, j][::-1][1:] for i in range(n) for j in range(n)}
    return cells


def test_neighbours_keep_the_same_vertices(spark):
    cells = wavy_grid(3)
    rows = [(f"{i}-{j}", "d", "r", [ring]) for (i, j), ring in cells.items()]
    island = [(1.5 + 0.2 * math.cos(t / 20 * math.pi), 1.5 + 0.2 * math.sin(t / 20 * math.pi)) for t in range(40)]
    rows.append(("island", "d", "r", [[*island, island[0]]]))
    rows[5] = (rows[5][0], "d", "r", [rows[5][3][0], [*island, island[0]][::-1]])
    assert rows[5][0] == "1-1"
    df = spark.createDataFrame(rows, SCHEMA)
    small = coverage.simplify_coverage(df, "code", 0.02)
    rings = {r.code: r.rings for r in small.collect()}
    assert {*rings} == {r[0] for r in rows}
    before, after = sum(len(r) for x in rows for r in x[3]), sum(len(r) for x in rings.values() for r in x)
    assert after < 0.8 * before and len(rings["1-1"]) == 2 and len(rings["island"]) == 1
    # No gap and no overlap: all inner edges cancel, so the outline's area is the sum of the areas.
    edges = coverage.noded_edges(small.withColumn("all", F.lit(1)), "code")
    left = coverage.outline(edges, "all")
    assert abs(coverage.planar_area(left, "all").first().area - sum(area(x) for x in rings.values())) < 1e-9
    assert len(coverage.rings_of(left, "all").first().rings) == 1
    raw = {r.code: r.rings for r in df.collect()}
    for code in rings:
        assert abs(area(rings[code]) - sum((1 if k == 0 else -1) * abs(area([r])) for k, r in enumerate(raw[code]))) < 0.1
    corners = {(float(i), float(j)) for i in range(5) for j in range(5)}
    assert corners <= {(p.lon, p.lat) for x in rings.values() for r in x for p in r}


def test_no_areas(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert coverage.rings_of(coverage.dissolve_levels(none, "code", ["department"])["department"], "department").count() == 0
    assert coverage.simplify_coverage(none, "code", 0.1).count() == 0
