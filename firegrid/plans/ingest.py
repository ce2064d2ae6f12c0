"""Queries over the scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.plans.registry import query
from firegrid.plans.scalars import stamp
from firegrid.sources import fixtures as fx
from firegrid.sources import providers, sinks
from firegrid.sources.fixtures import with_views


def raw_rows(spark, d):
    """Provider rows as text, with some unusable ones."""
    return fx.detections(spark, d).select(
        "id", F.expr("case when event_id % 31 = 0 then 'x' when event_id % 37 = 0 then '95.5' else format_string('%.5f', latitude) end").alias("latitude"), F.format_string("%.5f", "longitude").alias("longitude"),
        F.date_format("acquired_at", "yyyy-MM-dd").alias("acq_date"), F.expr("if(event_id % 41 = 0, '2460', date_format(acquired_at, 'HHmm'))").alias("acq_time"), "satellite", F.lower("sensor").alias("instrument"),
        F.expr("if(sensor = 'VIIRS', element_at(array('l', 'n', 'h'), cast(event_id % 3 + 1 as int)), cast(event_id % 100 as string))").alias("confidence"), F.lit("2.0NRT").alias("version"),
        F.col("frp_mw").cast("string").alias("frp"), F.lower("day_night").alias("daynight"),
    )


_RAW = with_views("det") + """, p AS (SELECT *, event_id % 31 = 0 AS bad_lat, event_id % 37 = 0 AND event_id % 31 <> 0 AS bad_range, event_id % 41 = 0 AS bad_time FROM det)"""


@query("s1_parse_rows", _RAW + """ SELECT sensor, day_night, CASE WHEN sensor = 'VIIRS' THEN [250, 600, 900][event_id % 3 + 1] ELSE (event_id % 100) * 10 END::BIGINT AS conf_e3, strftime(date_trunc('minute', acquired_at), '%Y-%m-%d %H:%M:%S') AS at,
  CASE WHEN event_id % 37 = 0 THEN 9550000 ELSE lat_e5 END AS lat_e5, lon_e5, round(frp_mw * 100)::BIGINT AS frp_c FROM p WHERE NOT (bad_lat OR bad_range OR bad_time)""")
def s1(spark, d):
    ok = providers.accepted(providers.parse_rows(raw_rows(spark, d), "VIIRS_NRT"))
    n = lambda c, k: F.round(F.col(c) * k).cast("long")
    return ok.select("sensor", "day_night", n("confidence_score", 1000).alias("conf_e3"), stamp("acquired_at").alias("at"), n("latitude", 100000).alias("lat_e5"), n("longitude", 100000).alias("lon_e5"), n("frp_mw", 100).alias("frp_c"))


@query("s1_rejects", _RAW + " SELECT concat_ws(',', CASE WHEN bad_lat THEN 'latitude' END, CASE WHEN bad_range THEN 'coordinates out of range' END, CASE WHEN bad_time THEN 'acquisition time' END) AS reasons, count(*) AS n FROM p WHERE bad_lat OR bad_range OR bad_time GROUP BY 1")
def s1_rejects(spark, d):
    bad = providers.rejected(providers.parse_rows(raw_rows(spark, d), "VIIRS_NRT"))
    return bad.groupBy(F.array_join("rejects", ",").alias("reasons")).agg(F.count("*").alias("n"))


_S9 = """WITH x AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders) SELECT k, lpad((c % 95)::VARCHAR, 2, '0') AS department, c % 2 = 1 AS is_coastal, (k % 9 + 1)::INT AS phenomenon_id, ['vert', 'jaune', 'orange', 'rouge'][(k % 4 + 1)::INT] AS colour FROM x WHERE k % 10 <> 0 AND k % 7 <> 0
  UNION ALL SELECT k, NULL, false, NULL, NULL FROM x WHERE k % 10 = 0 UNION ALL SELECT k, lpad((c % 95)::VARCHAR, 2, '0'), c % 2 = 1, (k % 9 + 1)::INT, NULL FROM x WHERE k % 10 <> 0 AND k % 7 = 0"""


@query("s9_warning_map", _S9)
@query("s9_all_warnings", _S9)
def s9(spark, d):
    return warning_map(fx.read(spark, d, "orders"))


def warning_map(orders):
    """Levels of bulletins made of orders."""
    out = parsed_bulletins(orders)
    return out.select(F.col("bulletin_domain").cast("long").alias("k"), "department", F.coalesce("is_coastal", F.lit(False)).alias("is_coastal"), "phenomenon_id", "colour")


def parsed_bulletins(orders):
    """Bulletins made of orders, parsed."""
    x = orders.selectExpr("o_orderkey as k", "o_custkey as c")
    body = F.format_string(
        '{"product":{"warning_type":"vigilance","domain_id":"%s","version_cdp":"1","version_vigilance":"V6","update_time":"2024-01-01T05:00:00Z","periods":[{"echeance":"%s","begin_validity_time":"2024-01-01T06:00:00Z","end_validity_time":"2024-01-02T00:00:00Z","timelaps":{"domain_ids":[{"domain_id":"%s","phenomenon_items":[{"phenomenon_id":"%s","phenomenon_max_color_id":%s}]}]}}]}}',
        F.col("k").cast("string"), F.expr("if(k % 10 = 0, 'J9', 'J1')"), F.expr("concat(lpad(cast(c % 95 as string), 2, '0'), if(c % 2 = 1, '10', ''))"), F.expr("cast(k % 9 + 1 as string)"), F.expr("if(k % 7 = 0, '8', cast(k % 4 + 1 as string))"),
    )
    return providers.parse_warnings(x.select(body.alias("body")))


@query("s17_new_rows", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0")
def s17(spark, d):
    rows = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    batch = rows.filter("k % 3 = 0")
    return sinks.new_rows(batch.union(batch), rows.filter("k % 5 = 0"), ["k"]).select("k")


@query("s19_partition_months", "SELECT strftime(m, '%Y-%m') AS month FROM (SELECT date_trunc('month', min(o_orderdate)) AS a, date_trunc('month', max(o_orderdate)) AS b FROM orders), LATERAL (SELECT unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS m)")
def s19(spark, d):
    span = fx.read(spark, d, "orders").agg(F.trunc(F.min("o_orderdate"), "MM").alias("a"), F.trunc(F.max("o_orderdate"), "MM").alias("b"))
    return span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))


@query("s21_registry_upsert", "SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v, coalesce(a.is_active, true) AS is_active, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'keep' ELSE 'update' END AS action FROM (SELECT s_suppkey AS k, s_name AS v, s_acctbal > 0 AS is_active FROM supplier WHERE s_suppkey % 3 <> 0) a FULL JOIN (SELECT s_suppkey AS k, upper(s_name) AS v FROM supplier WHERE s_suppkey % 2 = 0) b ON a.k = b.k")
def s21(spark, d):
    s = fx.read(spark, d, "supplier")
    current = s.filter("s_suppkey % 3 <> 0").selectExpr("s_suppkey as k", "s_name as v", "s_acctbal > 0 as is_active")
    staged = s.filter("s_suppkey % 2 = 0").selectExpr("s_suppkey as k", "upper(s_name) as v", "true as is_active")
    return sinks.upsert(current, staged, "k", keep=["is_active"])


@query("s22_publish_validity", "WITH a AS (SELECT c_custkey AS k, c_name AS v, CASE WHEN c_custkey % 10 = 0 THEN DATE '2024-02-01' ELSE DATE '2020-01-01' END AS f, CASE WHEN c_custkey % 4 = 1 THEN DATE '2023-01-01' END AS t FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS k, upper(c_name) AS v FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v, CASE WHEN b.k IS NULL AND t IS NULL AND a.f < DATE '2024-02-01' THEN '2024-02-01' WHEN b.k IS NULL THEN strftime(t, '%Y-%m-%d') END AS valid_to, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NOT NULL THEN 'update' WHEN t IS NOT NULL THEN 'keep' WHEN a.f < DATE '2024-02-01' THEN 'retire' ELSE 'reject_retire' END AS action FROM a FULL JOIN b ON a.k = b.k")
def s22(spark, d):
    c = fx.read(spark, d, "customer")
    current = c.filter("c_custkey % 3 <> 0").selectExpr("c_custkey as k", "c_name as v", "if(c_custkey % 10 = 0, date'2024-02-01', date'2020-01-01') as valid_from", "if(c_custkey % 4 = 1, date'2023-01-01', null) as valid_to")
    staged = c.filter("c_custkey % 2 = 0").selectExpr("c_custkey as k", "upper(c_name) as v", "date'2024-02-01' as valid_from")
    return sinks.publish_validity(current, staged, "k", "2024-02-01").select("k", "v", F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"), "action")
