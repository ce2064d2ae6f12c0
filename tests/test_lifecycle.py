"""Bulletins, boundaries, archives, passes and upkeep on small tables."""

import json
import urllib.error
import zipfile

import pytest
from pyspark.sql import functions as F

from firegrid.operators import passes, upkeep
from firegrid.sources import archives, boundaries, bulletins, providers
from firegrid.sources.area_api import UnavailableError


def refuse(code):
    def request(url, headers):
        raise urllib.error.HTTPError(url, code, "no", {}, None)

    return request


def test_bulletins_come_live_or_from_the_archive():
    seen = []

    def request(url, headers):
        seen.append((url, headers.get("apikey")))
        return "{}"

    got = bulletins.fetch_bulletin("http://live", lambda: "http://old", "k3y", request)
    assert (got.access, got.url) == ("live", "http://live") and bulletins.fetch_bulletin("http://live", lambda: "http://old", " ", request).access == "archive"
    assert seen == [("http://live", "k3y"), ("http://old", None)]
    for code, reason in ((401, "refused"), (403, "refused"), (429, "quota"), (500, "no bulletin")):
        with pytest.raises(UnavailableError, match=reason) as e:
            bulletins.fetch_bulletin("http://live", lambda: "http://old", "k3y", refuse(code))
        assert "k3y" not in str(e.value) and str(code) in str(e.value)
    with pytest.raises(UnavailableError, match="no bulletin"):
        bulletins.fetch_bulletin("http://live", lambda: "http://old", None, refuse(401))


def bulletin(domain, at, colours):
    items = [{"domain_id": "06", "phenomenon_items": [{"phenomenon_id": str(k + 1), "phenomenon_max_color_id": c} for k, c in enumerate(colours)]}]
    period = {"echeance": "J", "begin_validity_time": "2024-01-01T06:00:00Z", "end_validity_time": "2024-01-02T00:00:00Z", "timelaps": {"domain_ids": items}}
    return (json.dumps({"product": {"warning_type": "vigilance", "domain_id": domain, "update_time": at, "periods": [period]}}),)


def test_bulletins_are_stored_once(spark, tmp_path):
    parse = lambda rows: providers.parse_warnings(spark.createDataFrame(rows, "body string"))
    first = [bulletin("FRA", "2024-01-01T05:00:00Z", [1, 3]), bulletin("FRA", "2024-01-01T11:00:00Z", [2, 9])]
    root = str(tmp_path / "warnings")
    for _ in range(2):
        stored, levels = bulletins.store_bulletins(parse(first + first), root)
        assert (stored.count(), levels.count()) == (2, 3)
    stored, levels = bulletins.store_bulletins(parse([first[0], bulletin("FRB", "2024-01-01T05:00:00Z", [4])]), root)
    assert (stored.count(), levels.count()) == (3, 4)
    assert sorted(r.colour for r in bulletins.active_warnings(levels).collect()) == ["jaune", "orange", "rouge"]


def test_boundary_lists_and_source(spark, tmp_path):
    (tmp_path / "departements" / "06").mkdir(parents=True)
    (tmp_path / "regions.json").write_text(json.dumps([{"code": "93", "nom": "Sud"}, {"code": "9", "nom": "x"}, {"code": "84", "nom": " "}, 7]))
    (tmp_path / "departements.json").write_text(json.dumps([{"code": "2a", "nom": "Corse", "codeRegion": "94"}, {"code": "06", "nom": "AM", "codeRegion": "p"}, {"code": "971", "nom": "G", "codeRegion": "01"}]))
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    (tmp_path / "departements" / "06" / "communes.json").write_text(json.dumps({"features": [{"properties": {"code": "06004", "nom": "Antibes"}, "geometry": {"type": "Polygon", "coordinates": square}}]}))
    spark.dataSource.register(boundaries.BoundarySource)
    landed = spark.read.format("boundaries").option("base", str(tmp_path)).option("departments", "06").load().cache()
    of = lambda name: landed.filter(F.col("endpoint") == name)
    assert [(r.code, r.reject) for r in boundaries.parse_regions(of("regions")).orderBy("place").collect()] == [("93", None), ("9", "code"), ("84", "name"), ("", "code")]
    assert [(r.code, r.reject) for r in boundaries.parse_departments(of("departments")).orderBy("place").collect()] == [("2A", None), ("06", "region"), ("971", "code")]
    assert [r.insee_code for r in providers.parse_features(of("municipalities")).collect()] == ["06004"]
    assert boundaries.parse_regions(spark.createDataFrame([("not json",), (None,), ("{}",)], "body string")).filter("reject is null").count() == 0
    with pytest.raises(Exception, match="cannot be reached"):
        spark.read.format("boundaries").option("base", str(tmp_path / "none")).load().collect()


def test_archives_are_read_with_provenance(spark, tmp_path):
    head = "latitude,longitude,acq_date,acq_time,satellite\n"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("fire_archive_1.csv", head + "1,2,2024-01-01,0010,N20\n3,4,2024-01-02,0020,N20\n")
        z.writestr("fire_nrt_2.csv", head + '5,6,2024-01-03,0030,"N,21"\n')
        z.writestr("readme.txt", "x")
    (tmp_path / "fire_nrt_2.csv").write_text(head + "9,9,2024-01-09,0000,loose\n")
    (tmp_path / "fire_nrt_3.csv").write_text(head + "7,8,2024-01-04,0040,SNPP\n")
    got = archives.read_archives(spark, str(tmp_path)).select("source_file", "corpus", "latitude", "satellite", "bright_t31").collect()
    assert sorted(map(tuple, got)) == [("fire_archive_1.csv", "standard", "1", "N20", None), ("fire_archive_1.csv", "standard", "3", "N20", None), ("fire_nrt_2.csv", "nrt", "5", "N,21", None), ("fire_nrt_3.csv", "nrt", "7", "SNPP", None)]
    known = archives.provenance(spark, str(tmp_path)).collect()
    assert [(r.file, len(r.sha256), [m.member for m in r.members or []]) for r in known] == [("a.zip", 64, ["fire_archive_1.csv", "fire_nrt_2.csv"]), ("fire_nrt_2.csv", 64, []), ("fire_nrt_3.csv", 64, [])]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("")
    with pytest.raises(ValueError, match="no fire_"):
        archives.read_archives(spark, str(tmp_path / "empty"))


def test_passes_run_until_the_queue_is_empty(spark):
    rows = spark.range(23).select(F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.col("id")).alias("acquired_at"), F.col("id").cast("string").alias("provider_key"))
    taken = []

    def queue():
        return rows.filter(~F.col("id").isin(taken)) if taken else rows

    def step(batch):
        ids = [r.id for r in batch.collect()]
        taken.extend(ids)
        return len(ids)

    assert passes.run_passes(queue, step, 10) == (3, False) and taken == [str(k) for k in range(23)]
    taken.clear()
    assert passes.run_passes(queue, step, 10, most=2) == (2, True) and len(taken) == 20
    taken.clear()
    assert passes.run_passes(queue, step, None) == (1, False) and passes.was_capped(10, 10) and not passes.was_capped(9, 10)


def test_totals_add_up(spark):
    out = lambda rows: spark.createDataFrame(rows, "event_id string, is_new boolean")
    first = out([("a", True), ("a", True), ("b", True)])
    totals = passes.Totals()
    totals.add(first, None)
    totals.add(out([("a", False), ("a", True), ("c", True)]), first)
    assert (totals.passes, totals.processed, totals.created, totals.attached) == (2, 5, 3, 2)
    assert sorted(r.event_id for r in totals.touched_events().collect()) == ["a", "b", "c"]


def test_one_product_may_fail_alone():
    def step(product):
        if product == "bad":
            raise UnavailableError("down")
        return 3

    assert passes.run_products(["a", "bad", "c"], step) == [("a", 3, None), ("bad", 0, "down"), ("c", 3, None)]
    with pytest.raises(RuntimeError, match="every product failed"):
        passes.run_products(["bad", "bad"], step)
    with pytest.raises(KeyError):
        passes.run_products(["a"], lambda p: {}[p])


def test_empty_events_and_strata_are_errors(spark):
    events = spark.createDataFrame([("a",), ("b",)], "event_key string")
    assert upkeep.require_members(events, events.union(events)).count() == 2
    with pytest.raises(Exception, match="event without detections: b"):
        upkeep.require_members(events, events.filter("event_key = 'a'")).collect()
    report = spark.createDataFrame([("x", 3), ("overlap", 0)], "stratum string, n long")
    assert upkeep.require_rows(report).count() == 2
    with pytest.raises(Exception, match="empty: y"):
        upkeep.require_rows(report.union(spark.createDataFrame([("y", 0)], report.schema))).collect()
