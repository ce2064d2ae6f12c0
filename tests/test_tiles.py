"""Clipping of polygons to tiles, and redaction at depth."""

import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from firegrid.operators import tiles
from firegrid.sources import sinks

FEATURE = "code string, rings array<array<struct<lon:double,lat:double>>>, lon_min double, lon_max double, lat_min double, lat_max double"


def star(rng, x, y, size):
    """A closed simple ring around a place, with notches."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randrange(5, 30)))
    ring = [(x + size * r * math.cos(t), y + size * r * math.sin(t)) for t in turns for r in [rng.uniform(0.2, 1)]]
    return [*ring, ring[0]]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_parts_of_a_ring_add_up(seed):
    rng = random.Random(seed)
    ring = np.array(star(rng, rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(0.1, 6)))[:-1]
    total = sum(tiles.doubled_area(tiles.clip_ring(ring - [i, j], 0.0, 4.0)) for i in range(-8, 20, 4) for j in range(-8, 20, 4))
    assert abs(total - tiles.doubled_area(ring)) < 1e-9 * max(1, abs(total))
    for part in (tiles.clip_ring(ring - [4, 4], 0.0, 4.0),):
        assert len(part) == 0 or (part.min() >= 0 and part.max() <= 4)


def test_features_over_many_tiles(spark):
    rng = random.Random(6)
    rows = []
    for k in range(25):
        outer = star(rng, rng.uniform(-20, 20), rng.uniform(-40, 60), rng.uniform(0.5, 6))
        rings = [outer]
        if k % 3 == 0:  # a triangle in a square, as a hole
            x, y = outer[0]
            rings = [[(x, y), (x + 5, y), (x + 5, y + 5), (x, y + 5), (x, y)], [(x + 1, y + 1), (x + 4, y + 1), (x + 2, y + 3), (x + 1, y + 1)]]
        flat = np.array([p for r in rings for p in r])
        rows.append((f"f{k}", rings, *(float(v) for v in (flat[:, 0].min(), flat[:, 0].max(), flat[:, 1].min(), flat[:, 1].max()))))
    features = spark.createDataFrame([*rows, (None, rows[0][1], 0.0, 1.0, 0.0, 1.0), ("none", None, 0.0, 1.0, 0.0, 1.0), ("empty", [], 0.0, 1.0, 0.0, 1.0), ("flat", [[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]], 0.0, 1.0, 0.0, 0.0)], FEATURE)
    parts = tiles.clip_to_tiles(features, 7, extent=1 << 20).collect()
    got = {}
    for r in parts:
        got[r.code] = got.get(r.code, 0.0) + r.area
        flat = [p for ring in r.rings for p in ring]
        assert all(0 <= v <= 1 << 20 for p in flat for v in p) and all(ring[0] == ring[-1] for ring in r.rings)
    for code, rings, *_ in rows:
        whole = [tiles.doubled_area(tiles.world(*np.array(r)[:-1].T, 7) * (1 << 20)) / 2 for r in rings]
        assert abs(got[code] - (abs(whole[0]) - sum(abs(x) for x in whole[1:]))) < 1e-4 * abs(whole[0]) + 1e7
    assert {*got} == {r[0] for r in rows} and len(parts) > 60


def test_nothing_sensitive_at_any_depth(spark):
    deep = F.struct(F.lit(1).alias("id"), F.array(F.struct(F.lit("s").alias("API_Key"), F.create_map(F.lit("password"), F.struct(F.lit(5).alias("v")), F.lit("b"), F.struct(F.lit(6).alias("v"))).alias("m"))).alias("list"), F.lit(7).alias("secret_number"))
    df = spark.range(1).select(F.lit("t").alias("accessToken"), F.lit(None).cast("string").alias("key"), deep.alias("deep"), F.create_map(F.lit(1), F.struct(F.lit("x").alias("authorization"))).alias("by_number"), F.lit("plain").alias("a.b"))
    r = sinks.redact(df).first()
    assert r.accessToken == "[redacted]" and r.key is None and r["a.b"] == "plain" and r.deep.id == 1 and r.deep.secret_number is None
    assert r.deep.list[0].API_Key == "[redacted]" and r.deep.list[0].m["password"] is None and r.deep.list[0].m["b"].v == 6 and r.by_number[1].authorization == "[redacted]"
    assert sinks.redact(spark.range(2)).count() == 2
