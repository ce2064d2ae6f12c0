"""Further queries: guards, bulletins, features, tiles, envelopes, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.functions import geo
from firegrid.plans.registry import query
from firegrid.plans.relational import EVENTS, events
from firegrid.plans.scalars import stamp
from firegrid.plans.surface import PUB, check_bbox, envelope, published
from firegrid.sources import fixtures as fx
from firegrid.sources import providers
from firegrid.sources.fixtures import NOW, with_views


@query("s2_csv_guard", "SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS is_csv FROM orders")
def s2(spark, d):
    body = F.when(F.col("o_orderkey") % 3 == 0, F.lit("  Latitude,LONGITUDE,frp\n1,2,3")).when(F.col("o_orderkey") % 3 == 1, F.lit("Invalid key\nlatitude,longitude")).otherwise(F.lit("latitude,lon\n1,2"))
    return fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), providers.looks_like_csv(body).alias("is_csv"))


@query("s10_latest_bulletin", "SELECT '2024' AS year, '01' AS month, '29' AS day, '1600' AS stamp")
def s10(spark, d):
    days = fx.read(spark, d, "events").select(F.date_format("ts", "dd").alias("day")).distinct().filter("day <= '29'")
    tree = days.agg(F.to_json(F.struct(F.struct(F.map_from_entries(F.collect_list(F.struct("day", F.create_map(F.lit("0600"), F.array(F.lit("text.txt")), F.lit("1600"), F.array(F.lit("CDP_CARTE_EXTERNE.json")))))).alias("01")).alias("2024"))).alias("tree"))
    return providers.latest_bulletin(tree)


_S12 = """SELECT lpad(((10000 + c_custkey) % 100000)::VARCHAR, 5, '0') AS insee_code, c_name AS name, lpad(((10000 + c_custkey) % 100000)::VARCHAR, 5, '0')[1:2] AS department_code, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 3)::DOUBLE END AS area_km2, 5 AS points FROM customer"""


@query("s12_geojson", _S12)
@query("s12_all_geojson", _S12)
def s12(spark, d):
    """Codes start again after 99999, so every key has a valid one."""
    return features(fx.read(spark, d, "customer"), F.lpad(((10000 + F.col("c_custkey")) % 100000).cast("string"), 5, "0"))


def features(customers, code):
    """Feature collections made of customers, parsed."""
    body = F.format_string(
        '{"features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]]]},"properties":{"code":"%s","nom":"%s","surface":%s,"codesPostaux":[]}}]}',
        code, F.col("c_name"), (F.col("c_custkey") % 3 * 100).cast("string"),
    )
    rows = providers.parse_features(customers.select(body.alias("body"))).filter("size(rejects) = 0")
    return rows.select("insee_code", "name", "department_code", "area_km2", F.size(F.col("polygons")[0][0]).alias("points"))


@query("s23_raw_archive", "SELECT event_id AS id, 'raw/' || strftime(ts, '%Y/%m/%d') || '/' || strftime(ts, '%Y%m%dT%H%M%SZ') || '_' || event_type || '.csv' AS path, sha256(props) AS digest FROM events")
def s23(spark, d):
    path = F.concat(F.lit("raw/"), F.date_format("ts", "yyyy/MM/dd"), F.lit("/"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), F.col("event_type"), F.lit(".csv"))
    return fx.read(spark, d, "events").select(F.col("event_id").alias("id"), path.alias("path"), F.sha2("props", 256).alias("digest"))


@query("f2_algorithmic_events", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey % 4 <> 0 AND o_orderkey % 3 < 2 AND o_custkey % 7 <> 0")
def f2(spark, d):
    e = fx.read(spark, d, "orders").selectExpr(
        "o_orderkey as id", "if(o_orderkey % 5 = 0, 'demo-fixture', 'grouping-v1') as algorithm_version", "if(o_custkey % 4 = 0, 'active', null) as control",
        "element_at(array('satellite_detection', 'probable_event', 'publicly_reported'), cast(o_orderkey % 3 + 1 as int)) as verification", "if(o_custkey % 7 = 0, 'hidden', 'new') as freshness",
    )
    return algorithmic(e).select("id")


def algorithmic(e):
    """Events that no person has decided on; only these may be recomputed."""
    return e.filter((F.col("algorithm_version") != "demo-fixture") & F.col("control").isNull() & F.col("verification").isin("satellite_detection", "probable_event") & (F.col("freshness") != "hidden"))


@query("w5_ordinality", "SELECT o_orderkey AS id, unnest(range(0, 3)) AS place, unnest([o_orderpriority, o_orderstatus, 'x']) AS value FROM orders")
def w5(spark, d):
    return fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.posexplode(F.array("o_orderpriority", "o_orderstatus", F.lit("x"))).alias("p", "value")).select("id", F.col("p").cast("long").alias("place"), "value")


@query("a2_empty_events", EVENTS + " SELECT DISTINCT 'E-' || user_id || '-' || strftime(acquired_at, '%Y%m%d') AS event_key FROM det WHERE event_key NOT IN (SELECT event_key FROM ev)")
def a2(spark, d):
    every = fx.detections(spark, d).select(F.concat_ws("-", F.lit("E"), "user_id", F.date_format("acquired_at", "yyyyMMdd")).alias("event_key")).distinct()
    return every.join(events(spark, d).select("event_key"), "event_key", "left_anti")


@query("p29_feature_collection", PUB + f""" SELECT event_key, '{{"type":"Feature","properties":{{"freshness":"' || freshness || '","ageHours":' || greatest(0, date_diff('hour', last_at, TIMESTAMP '{NOW}')) || ',"detectionCount":' || detection_count || '}}}}' AS feature FROM (SELECT * REPLACE (date_trunc('hour', last_at) AS last_at) FROM pub) WHERE freshness <> 'hidden'""")
def p29(spark, d):
    age = F.greatest(F.lit(0), F.expr(f"timestampdiff(HOUR, date_trunc('hour', last_detected_at), timestamp '{NOW}')"))
    body = F.struct(F.lit("Feature").alias("type"), F.struct("freshness", age.alias("ageHours"), F.col("detection_count").alias("detectionCount")).alias("properties"))
    return published(spark, d).select("event_key", F.to_json(body).alias("feature"))


@query("q18_territory_children", with_views("terr") + " SELECT t.slug, t.name FROM terr t JOIN terr p ON p.type = 'region' AND p.code = t.parent_code WHERE p.slug = 'europe' AND t.status IN ('pilot', 'active')")
def q18(spark, d):
    t = fx.territories(spark, d)
    parent = t.filter("type = 'region' and slug = 'europe'").select(F.col("code").alias("parent_code"))
    return t.filter("status in ('pilot', 'active')").join(parent, "parent_code", "left_semi").select("slug", "name")


@query("q16_own_profile", "SELECT c_custkey AS user_id, c_mktsegment AS role FROM customer WHERE c_custkey = 7")
def q16(spark, d):
    return fx.read(spark, d, "customer").filter(F.col("c_custkey") == 7).select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"))


@query("q23_envelope", PUB + f" SELECT least(100, count(*))::INT AS rows, '{NOW}' AS generated_at, 'fresh' AS source FROM pub WHERE freshness <> 'hidden'")
def q23(spark, d):
    from firegrid.plans.surface import page

    sources = spark.createDataFrame([("main", "fresh")], "source_key string, freshness string")
    out = envelope(page(published(spark, d), "last_detected_at", "event_key"), fx.now(), sources)
    return out.select(F.size("data").alias("rows"), stamp("meta.generated_at").alias("generated_at"), F.col("meta.sources")["main"].alias("source"))


@query("c9_corrected_data_dates", with_views("runs") + f" SELECT source_key, records_read, strftime(finished_at, '%Y-%m-%d') AS finished, strftime(CASE WHEN source_data_at + INTERVAL 12 HOUR > finished_at THEN finished_at ELSE source_data_at + INTERVAL 12 HOUR END, '%Y-%m-%d %H:%M:%S') AS data_at FROM runs WHERE finished_at < TIMESTAMP '{fx.RUNS_NOW}'")
def c9(spark, d):
    claimed = F.expr("source_data_at + interval 12 hours")
    fixed = F.when(claimed > F.col("finished_at"), F.col("finished_at")).otherwise(claimed)
    rows = fx.import_runs(spark, d).filter(F.col("finished_at") < F.lit(fx.RUNS_NOW).cast("timestamp"))
    return rows.select("source_key", "records_read", F.date_format("finished_at", "yyyy-MM-dd").alias("finished"), stamp(fixed).alias("data_at"))


@query("st_daily_counts", with_views("det") + " SELECT sensor, strftime(acquired_at, '%Y-%m-%d') AS day, count(*) AS n FROM det GROUP BY ALL")
def st_daily(spark, d):
    from firegrid.streaming.pipeline import daily_counts

    return daily_counts(fx.detections(spark, d)).select("sensor", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")
