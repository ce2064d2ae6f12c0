"""The public query surface: functions over tables, and queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.functions import rules, text
from firegrid.plans.registry import query
from firegrid.plans.relational import EVENTS, areas, events
from firegrid.plans.scalars import stamp
from firegrid.sources import fixtures as fx
from firegrid.sources.fixtures import NOW, SQL, with_views

MAX_AREA_DEG2 = 30


def clamp(n: int | None, default: int, high: int) -> int:
    return min(max(default if n is None else n, 1), high)


def check_bbox(min_lon, min_lat, max_lon, max_lat) -> None:
    box = (min_lon, min_lat, max_lon, max_lat)
    if any(x is None for x in box) or min_lon >= max_lon or min_lat >= max_lat or min_lon < -180 or max_lon > 180 or min_lat < -90 or max_lat > 90:
        raise ValueError("INVALID_BBOX")
    if (max_lon - min_lon) * (max_lat - min_lat) > MAX_AREA_DEG2:
        raise ValueError("BBOX_TOO_LARGE")


def bbox_outcome(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """check_bbox() over columns: ok, or the error's name."""
    valid = (min_lon < max_lon) & (min_lat < max_lat) & (min_lon >= -180) & (max_lon <= 180) & (min_lat >= -90) & (max_lat <= 90)
    return F.when(~F.coalesce(valid, F.lit(False)), "INVALID_BBOX").when((max_lon - min_lon) * (max_lat - min_lat) > MAX_AREA_DEG2, "BBOX_TOO_LARGE").otherwise("ok")


def fires_in_bbox(published: DataFrame, min_lon, min_lat, max_lon, max_lat, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Events in a box, latest first; the bounds are plain comparisons that reach the scan."""
    check_bbox(min_lon, min_lat, max_lon, max_lat)
    hit = published.filter(F.col("longitude").between(min_lon, max_lon) & F.col("latitude").between(min_lat, max_lat))
    if since:
        hit = hit.filter(F.col("last_detected_at") >= F.lit(since).cast("timestamp"))
    return hit.orderBy(F.desc("last_detected_at"), "event_key").limit(clamp(limit, 200, 500))


def filter_events(published: DataFrame, until=None, status=None, confidence=None, sensor=None, territory=None) -> DataFrame:
    """The further filters of the published contract."""
    if until:
        published = published.filter(F.col("last_detected_at") < F.lit(until).cast("timestamp"))
    for column, value in (("freshness", status), ("confidence_level", confidence), ("department_code", territory)):
        if value:
            published = published.filter(F.col(column).isin(value if isinstance(value, list) else [value]))
    return published.filter(F.array_contains("sensors", sensor)) if sensor else published


def page(df: DataFrame, time: str, key: str, cursor: tuple[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """A page in (time desc, key desc) order after the cursor."""
    if cursor:
        at = F.lit(cursor[0]).cast("timestamp")
        df = df.filter((F.col(time) < at) | ((F.col(time) == at) & (F.col(key) < cursor[1])))
    return df.orderBy(F.desc(time), F.desc(key)).limit(clamp(limit, 100, 500))


def search_municipalities(table: DataFrame, q: str | None, limit: int | None = None) -> DataFrame:
    """Tolerant name search: prefix, trigram similarity of 0.3, or an exact postal code."""
    wanted = text.normalize_name(F.lit(q or ""))
    name = text.normalize_name(F.col("name"))
    alike = text.similarity(text.trigrams(name), text.trigrams(wanted))
    hit = table.withColumn("similarity", alike).withColumn("is_exact", name == wanted).withColumn("is_prefix", name.startswith(wanted))
    hit = hit.filter((F.length(wanted) >= 1) & (F.col("is_prefix") | (F.col("similarity") >= 0.3) | F.array_contains("postal_codes", F.lit(q or ""))))
    return hit.orderBy(F.desc("is_exact"), F.desc("is_prefix"), F.desc("similarity"), "name", "insee_code").limit(clamp(limit, 10, 25))


def event_card(published: DataFrame, timeline: DataFrame) -> DataFrame:
    """Events with the count and the latest instant of their public timeline."""
    entries = timeline.groupBy("event_key").agg(F.count("*").alias("timeline_count"), F.max("occurred_at").alias("timeline_last"))
    return published.join(entries, "event_key", "left").withColumn("timeline_count", F.coalesce("timeline_count", F.lit(0)))


def snapshot(cards: DataFrame, generated_at) -> DataFrame:
    """(event_key, generated_at, data_at, payload) of visible events; payload is JSON with nulls kept."""
    visible = cards.filter("freshness <> 'hidden'")
    body = F.struct(*(c for c in visible.columns))
    return visible.select("event_key", generated_at.alias("generated_at"), F.col("last_detected_at").alias("data_at"), F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def snapshot_first(cards: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Payload from the snapshot where there is one, else live, with its origin."""
    live = cards.select("event_key", F.to_json(F.struct(*cards.columns), {"ignoreNullFields": "false"}).alias("live"))
    return live.join(snapshots.select("event_key", "payload"), "event_key", "left").select("event_key", F.coalesce("payload", "live").alias("payload"), F.when(F.col("payload").isNotNull(), "snapshot").otherwise("live").alias("origin"))


def envelope(data: DataFrame, generated_at, sources: DataFrame) -> DataFrame:
    """One row: the page's rows under `data`, and generation time and source states under `meta`. For bounded pages."""
    state = sources.agg(F.map_from_entries(F.collect_list(F.struct("source_key", "freshness"))).alias("sources"))
    rows = data.agg(F.collect_list(F.struct(*data.columns)).alias("data"))
    return rows.crossJoin(state).select("data", F.struct(generated_at.alias("generated_at"), "sources").alias("meta"))


def department_rollup(published: DataFrame, departments: DataFrame, since: str | None = None) -> DataFrame:
    """Events, substantiated events and latest instant of every department that has any."""
    seen = published if since is None else published.filter(F.col("last_detected_at") >= F.lit(since).cast("timestamp"))
    counts = seen.groupBy("department_code").agg(F.count("*").alias("events"), F.count_if(F.col("confidence_level").isin("medium", "high")).alias("substantiated"), F.max("last_detected_at").alias("last_detected_at"))
    return departments.select(F.col("code").alias("department_code"), "slug", "status").join(counts, "department_code")


# Queries over the stand-in tables.
_SITE = "(user_id % 25)::VARCHAR AS department_code"
PUB = EVENTS + f""", terr AS ({SQL["terr"]}), pub AS (SELECT *, {_SITE}, CASE WHEN user_id % 40 = 0 THEN 'hidden' WHEN TIMESTAMP '{NOW}' - last_at >= INTERVAL 7 DAY THEN 'archived' WHEN TIMESTAMP '{NOW}' - first_at < INTERVAL 3 HOUR THEN 'new'
    WHEN TIMESTAMP '{NOW}' - last_at < INTERVAL 24 HOUR THEN 'recent' ELSE 'not_recent' END AS freshness FROM ev)"""


def published(spark, d, hidden: bool = False):
    """Stand-in events with freshness and department; hidden ones only on request."""
    user = F.split_part("event_key", F.lit("-"), F.lit(2)).cast("long")
    e = events(spark, d).withColumn("freshness", rules.event_freshness(F.col("first_detected_at"), F.col("last_detected_at"), fx.now(), user % 40 == 0)).withColumn("department_code", (user % 25).cast("string"))
    return e if hidden else e.filter("freshness <> 'hidden'")


@query("q1_territories", with_views("terr") + " SELECT t.slug, t.code, t.type, t.name, p.slug AS parent_slug, t.status FROM terr t LEFT JOIN terr p ON p.type = 'region' AND p.code = t.parent_code WHERE t.status IN ('pilot', 'active')")
def q1(spark, d):
    t = fx.territories(spark, d)
    parent = t.filter("type = 'region'").select(F.col("code").alias("parent_code"), F.col("slug").alias("parent_slug"))
    return t.filter(F.col("status").isin("pilot", "active")).join(parent, "parent_code", "left").select("slug", "code", "type", "name", "parent_slug", "status")


@query("q2_official_links", with_views("terr") + ", links AS (SELECT s_nationkey::VARCHAR AS code, s_name AS title, s_suppkey AS display_order, s_acctbal > 0 AS is_active FROM supplier) SELECT t.slug AS territory_slug, title, display_order FROM links JOIN terr t ON t.type = 'department' AND t.code = links.code WHERE is_active AND t.status IN ('pilot', 'active')")
def q2(spark, d):
    links = fx.read(spark, d, "supplier").selectExpr("cast(s_nationkey as string) as code", "s_name as title", "s_suppkey as display_order", "s_acctbal > 0 as is_active")
    t = fx.territories(spark, d).filter("type = 'department' and status in ('pilot', 'active')").select("code", F.col("slug").alias("territory_slug"))
    return links.filter("is_active").join(t, "code").select("territory_slug", "title", "display_order")


_SOURCES = "(VALUES ('1-URGENT', 'active'), ('2-HIGH', 'disabled'), ('3-MEDIUM', 'active'), ('4-NOT SPECIFIED', 'paused'), ('5-LOW', 'active'), ('radar', 'disabled'), ('new', 'active')) s(key, status)"


@query(
    "q3_source_status",
    with_views("runs")
    + f""", ok AS (SELECT source_key, max(finished_at) AS f, max(source_data_at) AS a FROM runs WHERE status IN ('success', 'partial') GROUP BY 1),
    inc AS (SELECT source_key, max(finished_at) AS opened, max_by(records_read, (finished_at, records_read)) AS message FROM runs WHERE status = 'failed' GROUP BY 1)
    SELECT key, CASE WHEN s.status IN ('disabled', 'paused') AND f IS NULL THEN 'upcoming' WHEN s.status IN ('disabled', 'paused') THEN 'maintenance' WHEN f IS NULL THEN 'unavailable'
      WHEN TIMESTAMP '{fx.RUNS_NOW}' - coalesce(a, f) >= INTERVAL 60 DAY THEN 'stale' WHEN TIMESTAMP '{fx.RUNS_NOW}' - coalesce(a, f) >= INTERVAL 20 DAY THEN 'delayed' ELSE 'fresh' END AS freshness,
      strftime(a, '%Y-%m-%d %H:%M:%S') AS data_at, strftime(opened, '%Y-%m-%d %H:%M:%S') AS incident_at, message FROM {_SOURCES} LEFT JOIN ok ON ok.source_key = key LEFT JOIN inc ON inc.source_key = key""",
)
def q3(spark, d):
    runs = fx.import_runs(spark, d)
    sources = spark.createDataFrame([("1-URGENT", "active"), ("2-HIGH", "disabled"), ("3-MEDIUM", "active"), ("4-NOT SPECIFIED", "paused"), ("5-LOW", "active"), ("radar", "disabled"), ("new", "active")], "source_key string, status string")
    return source_status(sources.withColumn("stale_s", F.lit(60 * 86400)).withColumn("expected_s", F.lit(20 * 86400)), runs, runs.filter("status = 'failed'").select("source_key", F.col("finished_at").alias("opened_at"), F.col("records_read").alias("message")), F.lit(fx.RUNS_NOW).cast("timestamp"))


def source_status(sources: DataFrame, runs: DataFrame, open_incidents: DataFrame, now) -> DataFrame:
    """Freshness of every source over all its jobs, with its latest open incident."""
    ok = runs.filter("status in ('success', 'partial')").groupBy("source_key").agg(F.max("finished_at").alias("f"), F.max("source_data_at").alias("a"))
    incident = open_incidents.groupBy("source_key").agg(F.max(F.struct("opened_at", "message")).alias("i"))
    state = rules.source_status(F.col("status"), F.col("f"), F.col("a"), now, F.col("stale_s"), F.col("expected_s"))
    return sources.join(ok, "source_key", "left").join(incident, "source_key", "left").select(F.col("source_key").alias("key"), state.alias("freshness"), stamp("a").alias("data_at"), stamp("i.opened_at").alias("incident_at"), F.col("i.message").alias("message"))


@query("q4_fire_events", PUB + " SELECT event_key, freshness, level, department_code, detection_count FROM pub WHERE freshness <> 'hidden'")
def q4(spark, d):
    return published(spark, d).select("event_key", "freshness", F.col("confidence_level").alias("level"), "department_code", "detection_count")


@query("q5_fires_in_bbox", PUB + f" SELECT event_key, detection_count, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at FROM pub WHERE freshness <> 'hidden' AND longitude BETWEEN -1 AND 3 AND latitude BETWEEN 42 AND 46 AND last_at >= TIMESTAMP '2024-01-10' ORDER BY pub.last_at DESC, event_key LIMIT 200")
def q5(spark, d):
    return fires_in_bbox(published(spark, d), -1, 42, 3, 46, "2024-01-10").select("event_key", "detection_count", stamp("last_detected_at").alias("last_at"))


@query("q6_timeline", PUB + " SELECT event_key, 'first_detection' AS entry_type, strftime(first_at, '%Y-%m-%d %H:%M:%S') AS at FROM pub WHERE freshness <> 'hidden' UNION ALL SELECT event_key, 'new_detection', strftime(last_at, '%Y-%m-%d %H:%M:%S') FROM pub WHERE freshness <> 'hidden'")
def q6(spark, d):
    return timeline(spark, d).select("event_key", "entry_type", stamp("occurred_at").alias("at"))


def timeline(spark, d):
    from firegrid.operators.clustering import timeline_entries

    return timeline_entries(published(spark, d), fx.now())


@query("q8_search_municipalities", with_views("muni") + """, m AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS n FROM muni WHERE NOT is_retired),
  g AS (SELECT *, list_distinct(flatten(list_transform(string_split(n, ' '), lambda w: list_transform(range(0, length(w) + 1), lambda i: substr('  ' || w || ' ', i + 1, 3))))) AS a FROM m),
  q AS (SELECT list_distinct(flatten(list_transform(['customer', '000000012'], lambda w: list_transform(range(0, length(w) + 1), lambda i: substr('  ' || w || ' ', i + 1, 3))))) AS b),
  s AS (SELECT *, len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) AS alike FROM g, q)
  SELECT insee_code, name, round(alike, 6) AS similarity FROM s WHERE starts_with(n, 'customer 000000012') OR alike >= 0.3 OR list_contains(postal_codes, 'Customer 000000012')
  ORDER BY n = 'customer 000000012' DESC, starts_with(n, 'customer 000000012') DESC, alike DESC, name, insee_code LIMIT 25""")
def q8(spark, d):
    return search_municipalities(fx.municipalities(spark, d).filter("not is_retired"), "Customer 000000012", 25).select("insee_code", "name", F.round("similarity", 6).alias("similarity"))


@query("q8_trigram_similarity", """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), g AS (SELECT DISTINCT p_partkey, ('  ' || w || ' ')[i : i + 2] AS t FROM w, range(1, 40) r(i) WHERE i <= length(w) + 1),
  q AS (SELECT unnest(['  r', ' re', 'red', 'ed ', '  w', ' wi', 'wid', 'idg', 'dge', 'get', 'et ']) AS t), s AS (SELECT p_partkey, count(*) AS n, count(q.t) AS c FROM g LEFT JOIN q USING (t) GROUP BY 1)
  SELECT p_partkey, round(c / (n + 11 - c) * 1000000)::BIGINT AS similarity_e6 FROM s""")
def q8b(spark, d):
    alike = text.similarity(text.trigrams(text.normalize_name(F.col("p_name"))), text.trigrams(F.lit("red widget")))
    return fx.read(spark, d, "part").select("p_partkey", F.round(alike * 1e6).cast("long").alias("similarity_e6"))


_Q9 = with_views("det") + " SELECT id, CASE WHEN b BETWEEN 0 AND 9 AND a BETWEEN 0 AND 14 THEN 'D' || lpad((b * 15 + a)::VARCHAR, 3, '0') END AS code FROM (SELECT id, (lon_e5 + 440000) // 80000 AS a, (lat_e5 - 4170000) // 60000 AS b FROM det)"


@query("q9_resolve_municipality", _Q9)
@query("q9_resolve_all", _Q9)
def q9(spark, d):
    from firegrid.operators.spatial import point_in_polygon

    return point_in_polygon(fx.detections(spark, d).select("id", "longitude", "latitude"), areas(spark)).select("id", "code")


@query("q10_municipalities", f"WITH muni AS ({SQL['muni']}), terr AS ({SQL['terr']}) SELECT insee_code, muni.name, t.slug AS department_slug FROM muni LEFT JOIN terr t ON t.type = 'department' AND t.code = department_code WHERE NOT is_retired")
def q10(spark, d):
    t = fx.territories(spark, d).filter("type = 'department'").select(F.col("code").alias("department_code"), F.col("slug").alias("department_slug"))
    return fx.municipalities(spark, d).filter("not is_retired").join(t, "department_code", "left").select("insee_code", "name", "department_slug")


@query("q11_event_card", PUB + " SELECT event_key, detection_count, sensors, freshness, 2 AS timeline_count, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS timeline_last FROM pub WHERE freshness <> 'hidden'")
def q11(spark, d):
    cards = event_card(published(spark, d), timeline(spark, d))
    return cards.select("event_key", "detection_count", F.array_join("sensors", ",").alias("sensors"), "freshness", F.col("timeline_count").cast("int").alias("timeline_count"), stamp("timeline_last").alias("timeline_last"))


@query("q12_event_detections", with_views("mem") + " SELECT id, sensor, CASE WHEN confidence_score IS NULL THEN 'unknown' WHEN confidence_score >= 0.8 THEN 'high' WHEN confidence_score >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM mem WHERE user_id = 5 ORDER BY acquired_at DESC, id LIMIT 500")
def q12(spark, d):
    own = fx.daily_events(spark, d).filter("user_id = 5").orderBy(F.desc("acquired_at"), "id").limit(clamp(None, 500, 2000))
    return own.select("id", "sensor", rules.detection_level(F.col("confidence_score")).alias("level"))


@query("q13_snapshots")
def q13(spark, d):
    cards = event_card(published(spark, d, hidden=True), timeline(spark, d)).drop("mean_confidence")
    return snapshot(cards, fx.now()).withColumn("generated_at", stamp("generated_at"))


@query("q14_snapshot_first", PUB + " SELECT event_key, CASE WHEN detection_count > 1 THEN 'snapshot' ELSE 'live' END AS origin FROM pub WHERE freshness <> 'hidden'")
def q14(spark, d):
    cards = published(spark, d)
    return snapshot_first(cards, snapshot(cards.filter("detection_count > 1"), fx.now())).select("event_key", "origin")


@query("q15_department_rollup", PUB + " SELECT t.code AS department_code, t.slug, t.status, count(*) AS events, count(*) FILTER (WHERE level IN ('medium', 'high')) AS substantiated, strftime(max(last_at), '%Y-%m-%d %H:%M:%S') AS last_at FROM pub JOIN terr t ON t.type = 'department' AND t.code = pub.department_code WHERE freshness <> 'hidden' AND last_at >= TIMESTAMP '2024-01-20' GROUP BY 1, 2, 3")
def q15(spark, d):
    departments = fx.territories(spark, d).filter("type = 'department'")
    out = department_rollup(published(spark, d), departments, "2024-01-20")
    return out.select("department_code", "slug", "status", "events", "substantiated", stamp("last_detected_at").alias("last_at"))


@query("q17_roles", "SELECT o_custkey AS user_id, max(o_orderkey % 4) AS rank, max(o_orderkey % 4) >= 2 AS may_validate FROM orders GROUP BY 1")
def q17(spark, d):
    return fx.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max(F.col("o_orderkey") % 4).alias("rank")).withColumn("may_validate", F.col("rank").isin(2, 3))


@query("q21_contract_filters", PUB + " SELECT event_key FROM pub WHERE freshness <> 'hidden' AND last_at < TIMESTAMP '2024-01-25' AND level IN ('medium', 'high') AND contains(sensors, 'MODIS') AND department_code = '3'")
def q21(spark, d):
    return filter_events(published(spark, d), until="2024-01-25", confidence=["medium", "high"], sensor="MODIS", territory="3").select("event_key")


@query("q22_page", PUB + " SELECT event_key FROM pub WHERE freshness <> 'hidden' AND (last_at < TIMESTAMP '2024-01-15' OR (last_at = TIMESTAMP '2024-01-15' AND event_key < 'E-5')) ORDER BY last_at DESC, event_key DESC LIMIT 100")
def q22(spark, d):
    return page(published(spark, d), "last_detected_at", "event_key", ("2024-01-15 00:00:00", "E-5")).select("event_key")


