"""Queries over sinks, queues, snapshots, fallbacks and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.operators import passes, upkeep
from firegrid.plans.ingest import parsed_bulletins
from firegrid.plans.registry import query
from firegrid.plans.relational import EVENTS, areas, events
from firegrid.plans.scalars import stamp
from firegrid.plans.surface import PUB, published
from firegrid.sources import boundaries, bulletins
from firegrid.sources import fixtures as fx
from firegrid.sources.fixtures import NOW, with_views


@query("s20_new_bulletins", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 7 <> 0 THEN 1 ELSE 0 END::BIGINT AS levels FROM orders WHERE o_orderkey % 5 <> 0")
def s20(spark, d):
    orders = fx.read(spark, d, "orders")
    parsed = parsed_bulletins(orders)
    known = bulletins.bulletins_of(parsed_bulletins(orders.filter("o_orderkey % 5 = 0")))
    fresh, levels = bulletins.new_bulletins(parsed.union(parsed), known)
    counts = levels.groupBy("bulletin_domain").count()
    return fresh.join(counts, "bulletin_domain", "left").select(F.col("bulletin_domain").cast("long").alias("k"), F.coalesce("count", F.lit(0)).alias("levels"))


@query("f20_active_warnings", "SELECT o_orderkey AS k, ['vert', 'jaune', 'orange', 'rouge'][(o_orderkey % 4 + 1)::INT] AS colour FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 4 <> 0")
def f20(spark, d):
    levels = parsed_bulletins(fx.read(spark, d, "orders")).filter("reject is null")
    return bulletins.active_warnings(levels).select(F.col("bulletin_domain").cast("long").alias("k"), "colour")


@query("s13_regions", "SELECT lpad((r_regionkey + 10)::VARCHAR, 2, '0') AS code, trim(r_name) AS name, CASE WHEN r_regionkey = 3 THEN 'name' END AS reject FROM (SELECT r_regionkey, CASE WHEN r_regionkey = 3 THEN '' ELSE r_name END AS r_name FROM region)")
def s13_regions(spark, d):
    entry = F.struct(F.lpad((F.col("r_regionkey") + 10).cast("string"), 2, "0").alias("code"), F.when(F.col("r_regionkey") == 3, " ").otherwise(F.col("r_name")).alias("nom"))
    bodies = fx.read(spark, d, "region").select(F.to_json(F.array(entry)).alias("body"))
    return boundaries.parse_regions(bodies).select("code", "name", "reject")


@query("s13_departments", "SELECT CASE WHEN n_nationkey % 9 = 4 THEN 'X' || n_nationkey ELSE lpad(n_nationkey::VARCHAR, 2, '0') END AS code, n_name AS name, lpad((n_regionkey + 10)::VARCHAR, 2, '0') AS region_code, CASE WHEN n_nationkey % 9 = 4 THEN 'code' END AS reject FROM nation")
def s13_departments(spark, d):
    n = F.col("n_nationkey").cast("string")
    code = F.when(F.col("n_nationkey") % 9 == 4, F.concat(F.lit("x"), n)).otherwise(F.lpad(n, 2, "0"))
    entry = F.struct(code.alias("code"), F.col("n_name").alias("nom"), F.lpad((F.col("n_regionkey") + 10).cast("string"), 2, "0").alias("codeRegion"))
    bodies = fx.read(spark, d, "nation").select(F.to_json(F.array(entry)).alias("body"))
    return boundaries.parse_departments(bodies).select("code", "name", "region_code", "reject")


_FREE = ", q AS (SELECT id, provider_key, acquired_at FROM det WHERE is_public AND event_id % 13 <> 0 AND event_id % 3 <> 0)"


def _queue(spark, d):
    """Public detections off known sources (every 13th stands for one) that no event holds (every third is held)."""
    det = fx.detections(spark, d).withColumn("known_source_key", F.when(F.col("event_id") % 13 == 0, "static"))
    return passes.pending(det, det.filter("event_id % 3 = 0"))


@query("o9_capped_take", with_views("det") + _FREE + ", t AS (SELECT * FROM q ORDER BY acquired_at, provider_key LIMIT 250) SELECT id FROM t")
def o9(spark, d):
    return passes.take(_queue(spark, d), 250).select("id")


@query("x5_pass_cap", with_views("det") + _FREE + " SELECT least(count(*), 250) AS fetched, count(*) >= 250 AS truncated, greatest(count(*) - 250, 0) AS left_over FROM q")
def x5(spark, d):
    queue = _queue(spark, d)
    fetched, every = passes.take(queue, 250).count(), queue.count()
    return spark.createDataFrame([(fetched, passes.was_capped(fetched, 250), every - fetched)], "fetched long, truncated boolean, left_over long")


@query("a23_pending_count", with_views("det") + _FREE + " SELECT count(*) AS pending, strftime(max(acquired_at), '%Y-%m-%d %H:%M:%S') AS latest FROM q")
def a23(spark, d):
    return _queue(spark, d).agg(F.count("*").alias("pending"), stamp(F.max("acquired_at")).alias("latest"))


@query("a30_pass_totals", with_views("runs") + " SELECT source_key, strftime(finished_at, '%Y-%m-%d') AS day, records_read, sum(records_read) OVER (PARTITION BY source_key ORDER BY finished_at)::BIGINT AS total_records_read FROM runs WHERE status <> 'failed'")
def a30(spark, d):
    runs = fx.import_runs(spark, d).filter("status <> 'failed'")
    out = passes.cumulative(runs, "source_key", "finished_at", "records_read")
    return out.select("source_key", F.date_format("finished_at", "yyyy-MM-dd").alias("day"), "records_read", "total_records_read")


@query("f18_stale_snapshots", PUB + f" SELECT event_key FROM pub WHERE freshness <> 'hidden' AND (detection_count % 3 = 0 OR last_at < TIMESTAMP '{NOW}' - INTERVAL 600 MINUTE)")
def f18(spark, d):
    """Every event has a snapshot as old as its last detection, but those with a multiple of three detections have none."""
    e = published(spark, d, hidden=True)
    snapshots = e.filter("detection_count % 3 <> 0").select("event_key", F.col("last_detected_at").alias("generated_at"))
    return upkeep.stale_snapshots(e, snapshots, fx.now(), 600).select("event_key")


@query("f19_without_orphans", with_views("det") + " SELECT id FROM det WHERE event_id % 3 = 0")
def f19(spark, d):
    det = fx.detections(spark, d)
    members = det.filter("event_id % 3 = 0").select("id", "acquired_at")
    return upkeep.without_orphans(det, members.union(members)).select("id")


@query("j10_department_fallback", with_views("det") + " SELECT id, CASE WHEN b BETWEEN 0 AND 9 AND a BETWEEN 0 AND 14 THEN 'D' || lpad((b * 15 + a)::VARCHAR, 3, '0') ELSE upper(substr('2a' || lpad(user_id::VARCHAR, 3, '0'), 1, 2)) END AS department FROM (SELECT id, user_id, (lon_e5 + 440000) // 80000 AS a, (lat_e5 - 4170000) // 60000 AS b FROM det)")
def j10(spark, d):
    points = fx.detections(spark, d).select("id", "longitude", "latitude", F.concat(F.lit("2a"), F.lpad(F.col("user_id").cast("string"), 3, "0")).alias("nearest_code"))
    return upkeep.assign_department(points, areas(spark), "nearest_code").select("id", "department")


@query("j20_attached_parents", "SELECT n_nationkey AS code, CASE WHEN n_nationkey % 2 = 0 THEN 'kept' ELSE n_regionkey::VARCHAR END AS parent_code FROM nation")
def j20b(spark, d):
    units = fx.read(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_regionkey").cast("string").alias("region_code"), F.when(F.col("n_nationkey") % 2 == 0, "kept").alias("parent_code"))
    regions = fx.read(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("code"))
    return upkeep.attach_parents(units, regions).select("code", "parent_code")


@query("s18_staged_load", "SELECT 2 * count(*) AS staged, 2 * count(*) FILTER (WHERE o_orderkey % 11 = 0) AS rejected, count(*) FILTER (WHERE o_orderkey % 11 <> 0 AND o_orderkey % 4 <> 0) AS inserted, count(*) FILTER (WHERE o_orderkey % 11 <> 0) + count(*) FILTER (WHERE o_orderkey % 11 <> 0 AND o_orderkey % 4 = 0) AS already_known FROM orders")
def s18(spark, d):
    rows = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", F.when(F.col("o_orderkey") % 11 == 0, F.array(F.lit("latitude"))).otherwise(F.array().cast("array<string>")).alias("rejects"))
    _, counters = upkeep.staged_load(rows.union(rows), rows.filter("k % 4 = 0").drop("rejects"), ["k"])
    return counters


@query("a10_percent", "SELECT o_orderkey AS k, CASE WHEN o_custkey % 8 = 0 THEN 0 ELSE round_even(100.0::DOUBLE * (o_orderkey % 9) / (o_custkey % 8), 0) END::BIGINT AS percent FROM orders")
def a10(spark, d):
    return fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), upkeep.percent(F.col("o_orderkey") % 9, F.col("o_custkey") % 8).alias("percent"))


@query("a2_checked_events", EVENTS + " SELECT event_key FROM ev")
def a2_checked(spark, d):
    """Every event has its members, or the query fails."""
    return upkeep.require_members(events(spark, d).select("event_key"), fx.daily_events(spark, d)).select("event_key")
