import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from firegrid.functions import geo, parsing, rules, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_windows_and_scores(spark):
    h = [0.0, 5.0, 19.0, 40.0]
    rows = spark.createDataFrame([(x,) for x in h], "h double").select(rules.spatial_window_m(F.col("h"))).collect()
    assert [r[0] for r in rows] == [2500, 5000, 12000, 12000]
    got = one(spark, rules.attachment_score(F.lit(0.0), F.lit(0.0)), rules.attachment_score(F.lit(2500.0), F.lit(0.0)), rules.attachment_score(F.lit(10.0), F.lit(24.5)), rules.attachment_score(F.lit(1250.0), F.lit(0.0)))
    assert [*got] == [1.0, 0.0, 0.0, 0.5]
    assert one(spark, rules.confidence_score(F.lit(0), F.lit(1), F.lit(0.9), F.lit(0), F.lit(1.0)))[0] == 0
    assert one(spark, rules.confidence_score(F.lit(6), F.lit(2), F.lit(1.0), F.lit(0), F.lit(6.0)))[0] == 1
    assert one(spark, rules.confidence_score(F.lit(6), F.lit(2), F.lit(1.0), F.lit(6), F.lit(6.0)))[0] == pytest.approx(0.4)


def test_parameters_are_validated():
    for bad in ({"base_radius_m": 0}, {"max_radius_m": 1}, {"attach_window_hours": 0}, {"min_score": 0}, {"min_score": 1.5}):
        with pytest.raises(ValueError):
            rules.ClusteringParams(**bad)


def test_acquisition_times(spark):
    cases = {"45": "00:45", "1230": "12:30", "12:30": "12:30", "2460": None, "2400": None, "x": None, "": None, "12345": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.date_format(parsing.acquisition_time(F.lit("2024-02-29"), F.col("t")), "HH:mm")).collect()
    assert {r[0]: r[1] for r in rows} == cases
    assert one(spark, parsing.acquisition_time(F.lit("2024-02-30"), F.lit("10")))[0] is None


def test_confidence_and_floats(spark):
    rows = [("VIIRS", "h", 0.9), ("VIIRS", "N", 0.6), ("VIIRS", "9", None), ("MODIS", "87", 0.87), ("MODIS", "101", None), ("MODIS", "x", None), ("MODIS", "", None)]
    got = spark.createDataFrame(rows, "s string, r string, e double").select(parsing.confidence(F.col("r"), F.col("s")), "e").collect()
    assert all(a == b for a, b in got)
    assert one(spark, parsing.number(F.lit("nan")), parsing.number(F.lit(" 1.5 ")), parsing.number(F.lit("")))[0:3] == (None, 1.5, None)


def test_names(spark):
    assert one(spark, text.normalize_name(F.lit("Saint-Étienne-de-Tinée")), text.slugify(F.lit("L'Œuf d'Aÿ"))) == ("saint etienne de tinee", "l-ouf-d-ay")
    t = text.trigrams(F.lit("word")), text.trigrams(F.lit("two words"))
    assert one(spark, text.similarity(*t))[0] == pytest.approx(4 / 11)
    assert one(spark, text.similarity(text.trigrams(F.lit("")), text.trigrams(F.lit(""))))[0] == 0


def test_status_change_rules(spark):
    f = lambda **k: one(spark, rules.status_change(*(F.lit(k.get(n)).cast(t) for n, t in (("actor", "string"), ("id", "string"), ("role", "string"), ("cur", "string"), ("nxt", "string"), ("ctl", "string"), ("nctl", "string"), ("sets", "boolean"), ("src", "string"), ("at", "string"), ("reason", "string")))))[0]
    r = f(actor="job", cur="probable_event", nxt="officially_confirmed", sets=False, reason="x")
    assert not r.allowed and r.violations == ["JOB_CANNOT_SET_VERIFICATION", "MISSING_OFFICIAL_SOURCE", "MISSING_OFFICIAL_TIMESTAMP"]
    r = f(actor="admin", id="a", role="data_admin", cur="probable_event", nxt="officially_confirmed", sets=True, nctl="active", src="s", at="t", reason="x")
    assert r.allowed and r.requires_audit and not r.is_regression
    r = f(actor="job", cur="probable_event", nxt="satellite_detection", sets=False, reason="x")
    assert r.allowed and r.is_regression
    assert f(actor="admin", cur="satellite_detection", sets=False).allowed


def test_model_time(spark):
    at = F.lit("2024-01-01 02:00:00").cast("timestamp")
    run = parsing.model_run(at)
    assert one(spark, run.cast("string"), parsing.next_noon(run).cast("string"))[:] == ("2023-12-31 21:00:00", "2024-01-01 11:00:00")
    spans = [r[0] for r in spark.createDataFrame([(x,) for x in (-1, 0, 6, 7, 12, 48, 49)], "l int").select(parsing.lead_span(F.col("l"))).collect()]
    assert spans == [None, "00H06H", "00H06H", "07H12H", "07H12H", "43H48H", None]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 50), st.integers(0, 60), st.integers(1, 12))
def test_bands_partition_the_columns(x0, n, count):
    bands = geo.column_bands(x0, x0 + n, count)
    assert [x for a, b in bands for x in range(a, b + 1)] == [*range(x0, x0 + n + 1)] and len(bands) <= count


def test_geodesic_against_known_arcs():
    assert geo.geodesic_m([0.0], [0.0], [1.0], [0.0])[0] == pytest.approx(111319.4908, abs=1e-3)  # a degree of the equator
    assert geo.geodesic_m([0.0], [0.0], [0.0], [1.0])[0] == pytest.approx(110574.3886, abs=1e-3)  # a degree of the meridian
    assert geo.geodesic_m([2.0], [45.0], [2.0], [45.0])[0] == 0
    rng = np.random.default_rng(1)
    a = rng.uniform(-10, 10, (4, 50)) + np.array([[0], [45], [0], [45]])
    assert np.allclose(geo.geodesic_m(*a), geo.geodesic_m(a[2], a[3], a[0], a[1]), atol=1e-6)


def test_hull_and_area():
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5], [0.5, 0]])
    assert len(geo.convex_hull(square)) == 4 and geo.diameter(geo.convex_hull(square)) == pytest.approx(math.sqrt(2))
    assert geo.diameter(geo.convex_hull(square[:1])) == 0
    # a one-degree cell at the equator
    assert geo.ring_area_km2([0, 1, 1, 0, 0], [0, 0, 1, 1, 0]) == pytest.approx(12308.8, rel=1e-3)
