"""Queries over the rule, text, parsing and tile expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.functions import geo, parsing, rules, text
from firegrid.plans.registry import query
from firegrid.sources import fixtures as fx
from firegrid.sources.fixtures import NOW, with_views

DET = with_views("det")
_TS = "%Y-%m-%d %H:%M:%S"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("r1_spatial_window", DET + " SELECT id, CASE WHEN event_id % 30 >= 0 THEN least(2500.0 + 500.0 * (event_id % 30), 12000.0) END AS window_m FROM det")
def r1(spark, d):
    return fx.detections(spark, d).select("id", rules.spatial_window_m((F.col("event_id") % 30).cast("double")).alias("window_m"))


@query(
    "r2_attachment_score",
    DET
    + """, x AS (SELECT id, (event_id * 37 % 9000)::DOUBLE AS m, (event_id % 26)::DOUBLE AS h FROM det), y AS (SELECT *, least(2500.0 + 500.0 * h, 12000.0) AS w FROM x)
    SELECT id, CAST(CASE WHEN m <= w AND h <= 24.0 THEN floor((1.0 - m / w) * (1.0 - h / 24.0) * 1000000.0 + 0.5) ELSE 0 END AS BIGINT) AS score_e6 FROM y""",
)
def r2(spark, d):
    m, h = (F.col("event_id") * 37 % 9000).cast("double"), (F.col("event_id") % 26).cast("double")
    return fx.detections(spark, d).select("id", F.round(rules.attachment_score(m, h) * 1e6).cast("long").alias("score_e6"))


@query(
    "r3_confidence_score",
    DET
    + """, x AS (SELECT id, event_id % 12 AS n, event_id % 3 AS s, confidence_score AS c, event_id % 4 AS k, (event_id % 9)::DOUBLE AS span FROM det),
    y AS (SELECT *, 0.40::DOUBLE * coalesce(c, 0.5::DOUBLE) + 0.25::DOUBLE * least(n / 6.0::DOUBLE, 1.0) + 0.20::DOUBLE * CASE WHEN s >= 2 THEN 1.0::DOUBLE ELSE 0 END + 0.15::DOUBLE * least(span / 6.0::DOUBLE, 1.0) AS t FROM x),
    z AS (SELECT id, CASE WHEN n > 0 THEN floor(greatest(0.0, least(1.0, t * CASE WHEN k > 0 THEN 1.0 - 0.6::DOUBLE * least(k / n::DOUBLE, 1.0) ELSE 1.0 END)) * 10000.0 + 0.5) / 10000.0 ELSE 0.0 END AS v FROM y)
    SELECT id, round(v * 10000)::BIGINT AS score_e4, CASE WHEN v >= 0.70 THEN 'high' WHEN v >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM z""",
)
def r3(spark, d):
    n, s, k, span = F.col("event_id") % 12, F.col("event_id") % 3, F.col("event_id") % 4, (F.col("event_id") % 9).cast("double")
    score = rules.confidence_score(n, s, F.col("confidence_score"), k, span)
    return fx.detections(spark, d).select("id", F.round(score * 10000).cast("long").alias("score_e4"), rules.confidence_level(score).alias("level"))


@query("r5_detection_level", DET + " SELECT id, CASE WHEN confidence_score IS NULL THEN 'unknown' WHEN confidence_score >= 0.8 THEN 'high' WHEN confidence_score >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM det")
def r5(spark, d):
    return fx.detections(spark, d).select("id", rules.detection_level(F.col("confidence_score")).alias("level"))


@query(
    "r6_event_freshness",
    DET
    + f""", x AS (SELECT id, acquired_at - INTERVAL 1 HOUR * (event_id % 50) AS f, acquired_at AS l, TIMESTAMP '{NOW}' AS n, event_id % 40 = 0 AS h FROM det)
    SELECT id, CASE WHEN h THEN 'hidden' WHEN n - l >= INTERVAL 7 DAY THEN 'archived' WHEN n - f < INTERVAL 3 HOUR THEN 'new' WHEN n - l < INTERVAL 24 HOUR THEN 'recent' ELSE 'not_recent' END AS freshness FROM x""",
)
def r6(spark, d):
    first = F.expr("acquired_at - make_dt_interval(0, cast(event_id % 50 as int))")
    return fx.detections(spark, d).select("id", rules.event_freshness(first, F.col("acquired_at"), fx.now(), F.col("event_id") % 40 == 0).alias("freshness"))


@query(
    "r7_source_freshness",
    with_views("runs")
    + """ SELECT source_key, records_read, strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished, CASE WHEN records_read % 17 = 0 THEN 'maintenance' WHEN records_read % 13 = 0 OR source_data_at IS NULL THEN 'unavailable'
      WHEN TIMESTAMP '2001-09-01' - source_data_at >= INTERVAL 900 DAY THEN 'stale' WHEN TIMESTAMP '2001-09-01' - source_data_at >= INTERVAL 300 DAY THEN 'delayed' ELSE 'fresh' END AS freshness FROM runs""",
)
def r7(spark, d):
    n = F.col("records_read")
    state = rules.source_freshness(F.col("source_data_at"), F.lit(fx.RUNS_NOW).cast("timestamp"), F.lit(900 * 86400), F.lit(300 * 86400), n % 13 == 0, n % 17 == 0)
    return fx.import_runs(spark, d).select("source_key", "records_read", stamp("finished_at").alias("finished"), state.alias("freshness"))


_KNOWN = "['satellite_detection', 'probable_event', 'publicly_reported', 'officially_confirmed']"
_LEVELS = "['satellite_detection', 'probable_event', 'publicly_reported', 'officially_confirmed', 'other']"


@query(
    "r9_status_change",
    f"""WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'job' ELSE 'admin' END AS actor, CASE WHEN o_custkey % 3 <> 0 THEN 'a' || o_custkey END AS actor_id,
      ['viewer', 'data_admin', 'super_admin'][o_orderkey % 3 + 1] AS role, {_LEVELS}[o_custkey % 4 + 1] AS cur, CASE WHEN o_orderkey % 6 < 5 THEN {_LEVELS}[o_orderkey % 6 + 1] END AS nxt,
      CASE WHEN o_custkey % 5 = 0 THEN 'active' END AS ctl, CASE o_orderkey % 4 WHEN 0 THEN 'controlled' WHEN 1 THEN 'lost' END AS nctl, o_orderkey % 7 < 4 AS sets,
      CASE WHEN o_custkey % 4 = 0 THEN 's' END AS src, CASE WHEN o_custkey % 6 = 0 THEN 't' END AS stated, CASE WHEN o_orderkey % 5 <> 0 THEN 'because' ELSE ' ' END AS reason FROM orders),
    y AS (SELECT *, coalesce(nxt <> cur, false) AS moved, sets AND nctl IS DISTINCT FROM ctl AS rec, coalesce(nxt NOT IN ('satellite_detection', 'probable_event'), false) AS human,
      coalesce(nxt, cur) AS fin, CASE WHEN sets THEN nctl ELSE ctl END AS fctl FROM x),
    z AS (SELECT *, concat_ws(',', CASE WHEN nxt = 'other' THEN 'UNKNOWN_VALUE' END, CASE WHEN sets AND nctl = 'lost' THEN 'UNKNOWN_VALUE' END,
      CASE WHEN actor = 'job' AND moved AND human THEN 'JOB_CANNOT_SET_VERIFICATION' END, CASE WHEN actor = 'job' AND rec THEN 'JOB_CANNOT_SET_OFFICIAL_STATUS' END,
      CASE WHEN actor = 'admin' AND (rec OR moved AND human) AND actor_id IS NULL THEN 'MISSING_ACTOR_IDENTITY' END, CASE WHEN actor = 'admin' AND (rec OR moved AND human) AND role = 'viewer' THEN 'INSUFFICIENT_ROLE' END,
      CASE WHEN (moved OR rec) AND trim(reason) = '' THEN 'MISSING_REASON' END, CASE WHEN (fin = 'officially_confirmed' OR fctl IS NOT NULL) AND src IS NULL THEN 'MISSING_OFFICIAL_SOURCE' END,
      CASE WHEN (fin = 'officially_confirmed' OR fctl IS NOT NULL) AND stated IS NULL THEN 'MISSING_OFFICIAL_TIMESTAMP' END, CASE WHEN fctl IS NOT NULL AND fin <> 'officially_confirmed' THEN 'OFFICIAL_STATUS_REQUIRES_CONFIRMATION' END) AS v FROM y)
    SELECT id, v = '' AS allowed, v AS violations, moved AND coalesce(list_position({_KNOWN}, nxt), 0) < list_position({_LEVELS}, cur) AS is_regression, moved OR rec AS requires_audit FROM z""",
)
def r9(spark, d):
    levels = "array('satellite_detection', 'probable_event', 'publicly_reported', 'officially_confirmed', 'other')"
    x = fx.read(spark, d, "orders").selectExpr(
        "o_orderkey as id", "if(o_custkey % 2 = 0, 'job', 'admin') as actor", "if(o_custkey % 3 <> 0, concat('a', o_custkey), null) as actor_id",
        "element_at(array('viewer', 'data_admin', 'super_admin'), cast(o_orderkey % 3 + 1 as int)) as role", f"element_at({levels}, cast(o_custkey % 4 + 1 as int)) as cur",
        f"if(o_orderkey % 6 < 5, element_at({levels}, cast(o_orderkey % 6 + 1 as int)), null) as nxt", "if(o_custkey % 5 = 0, 'active', null) as ctl",
        "case o_orderkey % 4 when 0 then 'controlled' when 1 then 'lost' end as nctl", "o_orderkey % 7 < 4 as sets", "if(o_custkey % 4 = 0, 's', null) as src",
        "if(o_custkey % 6 = 0, 't', null) as at", "if(o_orderkey % 5 <> 0, 'because', ' ') as reason",
    )
    c = {k: F.col(k) for k in x.columns}
    out = rules.status_change(c["actor"], c["actor_id"], c["role"], c["cur"], c["nxt"], c["ctl"], c["nctl"], c["sets"], c["src"], c["at"], c["reason"])
    return x.select("id", out.alias("o")).select("id", "o.allowed", F.array_join("o.violations", ",").alias("violations"), "o.is_regression", "o.requires_audit")


@query("r10_contradiction", "SELECT o_orderkey AS id, coalesce(CASE o_orderkey % 4 WHEN 0 THEN 'controlled' WHEN 1 THEN 'active' WHEN 2 THEN 'extinguished' END IN ('controlled', 'extinguished'), false) AS review FROM orders")
def r10(spark, d):
    status = F.expr("case o_orderkey % 4 when 0 then 'controlled' when 1 then 'active' when 2 then 'extinguished' end")
    return fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), rules.contradicts_official(status).alias("review"))


@query(
    "p2_acquisition_time",
    """WITH x AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS d, CASE event_id % 4 WHEN 0 THEN (event_id % 2600)::VARCHAR WHEN 1 THEN strftime(ts, '%H:%M') WHEN 2 THEN 'x' ELSE ' 45 ' END AS t FROM events),
    y AS (SELECT id, d, replace(trim(t), ':', '') AS t FROM x), z AS (SELECT id, d, t, lpad(t, 4, '0') AS p FROM y)
    SELECT id, CASE WHEN regexp_matches(t, '^[0-9]{1,4}$') AND p[1:2] <= '23' AND p[3:4] <= '59' THEN d || ' ' || p[1:2] || ':' || p[3:4] || ':00' END AS acquired FROM z""",
)
def p2(spark, d):
    x = fx.read(spark, d, "events").withColumn("d", F.date_format("ts", "yyyy-MM-dd"))
    t = F.expr("case event_id % 4 when 0 then cast(event_id % 2600 as string) when 1 then date_format(ts, 'HH:mm') when 2 then 'x' else ' 45 ' end")
    return x.select(F.col("event_id").alias("id"), stamp(parsing.acquisition_time(F.col("d"), t)).alias("acquired"))


@query(
    "p3_confidence",
    DET
    + """, x AS (SELECT id, sensor, CASE WHEN sensor = 'VIIRS' THEN ['l', 'N', 'h', '?', ''][event_id % 5 + 1] ELSE ((event_id * 7) % 130)::VARCHAR END AS raw FROM det)
    SELECT id, CASE WHEN raw = '' THEN NULL WHEN sensor = 'VIIRS' THEN CASE lower(raw) WHEN 'l' THEN 250 WHEN 'n' THEN 600 WHEN 'h' THEN 900 END WHEN raw::INT BETWEEN 0 AND 100 THEN raw::INT * 10 END::BIGINT AS score_e3 FROM x""",
)
def p3(spark, d):
    raw = F.expr("case when sensor = 'VIIRS' then element_at(array('l', 'N', 'h', '?', ''), cast(event_id % 5 + 1 as int)) else cast(event_id * 7 % 130 as string) end")
    return fx.detections(spark, d).withColumn("raw", raw).select("id", F.round(parsing.confidence(F.col("raw"), F.col("sensor")) * 1000).cast("long").alias("score_e3"))


@query(
    "p5_provider_key",
    DET
    + """, x AS (SELECT *, CASE WHEN lat_e5 < 0 THEN '-' ELSE '' END || (abs(lat_e5) // 100000) || '.' || lpad((abs(lat_e5) % 100000)::VARCHAR, 5, '0') AS la, CASE WHEN lon_e5 < 0 THEN '-' ELSE '' END || (abs(lon_e5) // 100000) || '.' || lpad((abs(lon_e5) % 100000)::VARCHAR, 5, '0') AS lo FROM det)
    SELECT id, sha256('nasa_firms|' || sensor || '_NRT|' || satellite || '|' || sensor || '|' || strftime(acquired_at, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || la || '|' || lo || '|' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '2.0NRT' END) AS key FROM x""",
)
def p5(spark, d):
    x = fx.detections(spark, d)
    key = parsing.provider_key(F.concat("sensor", F.lit("_NRT")), F.col("satellite"), F.col("sensor"), F.col("acquired_at"), F.col("latitude"), F.col("longitude"), F.expr("if(event_id % 3 = 0, null, '2.0NRT')"))
    return x.select("id", key.alias("key"))


@query("p11_grid_cell", DET + " SELECT id, floor(longitude / 0.004::DOUBLE)::BIGINT AS cell_x, floor(latitude / 0.004::DOUBLE)::BIGINT AS cell_y FROM det")
def p11(spark, d):
    return fx.detections(spark, d).select("id", geo.grid_cell(F.col("longitude")).alias("cell_x"), geo.grid_cell(F.col("latitude")).alias("cell_y"))


_NORM = f"trim(regexp_replace(lower(translate(n, '{text.ACCENTED}', '{text.FOLDED}')), '[^a-z0-9]+', ' ', 'g'))"


@query("p14_normalize_name", f"WITH x AS (SELECT doc_id, text AS n FROM documents) SELECT doc_id, translate(n, '{text.ACCENTED}', '{text.FOLDED}') AS folded, {_NORM} AS normalized, replace({_NORM}, ' ', '-') AS slug FROM x")
def p14(spark, d):
    n = F.col("text")
    return fx.read(spark, d, "documents").select("doc_id", text.unaccent(n).alias("folded"), text.normalize_name(n).alias("normalized"), text.slugify(n).alias("slug"))


@query(
    "p18_domain_department",
    "WITH x AS (SELECT o_orderkey AS id, ['06', '2A', '0610', '2B10', 'FRA', '123', '9910'][o_orderkey % 7 + 1] AS d FROM orders) SELECT id, CASE WHEN regexp_matches(d, '^([0-9]{2}|2A|2B)$') THEN d WHEN regexp_matches(d, '^([0-9]{2}|2A|2B)10$') THEN d[1:2] END AS department, regexp_matches(d, '^([0-9]{2}|2A|2B)10$') AS is_coastal FROM x",
)
def p18(spark, d):
    domain = F.expr("element_at(array('06', '2A', '0610', '2B10', 'FRA', '123', '9910'), cast(o_orderkey % 7 + 1 as int))")
    return fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), parsing.department_of_domain(domain).alias("x")).select("id", "x.*")


@query(
    "p20_age_text",
    f"""{DET}, x AS (SELECT id, greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(acquired_at + INTERVAL 1 HOUR * (event_id % 3000))) // 1000 AS ms FROM det), y AS (SELECT id, ms, ms // 60000 AS m FROM x)
    SELECT id, ms::BIGINT AS age_ms, CASE WHEN m < 1 THEN 'moins d''une minute' WHEN m < 60 THEN m || ' min' WHEN m // 60 < 24 THEN (m // 60) || ' h' || CASE WHEN m % 60 = 0 THEN '' ELSE ' ' || (m % 60) || ' min' END
      ELSE (m // 1440) || ' j' || CASE WHEN (m // 60) % 24 = 0 THEN '' ELSE ' ' || ((m // 60) % 24) || ' h' END END AS age FROM y""",
)
def p20(spark, d):
    ms = rules.age_ms(F.expr("acquired_at + make_dt_interval(0, cast(event_id % 3000 as int))"), fx.now())
    return fx.detections(spark, d).withColumn("age_ms", ms).select("id", "age_ms", rules.age_text(F.col("age_ms")).alias("age"))


@query(
    "p22_style",
    DET
    + """, x AS (SELECT id, event_id % 600 AS n, event_id % 30 AS h, event_id % 26 - 2 AS z FROM det)
    SELECT id, CASE WHEN h < 3 THEN 'new' WHEN h < 12 THEN 'recent' WHEN h < 24 THEN 'notRecent' ELSE 'archived' END AS bucket,
      round(CASE WHEN n <= 1 THEN 5 WHEN n < 10 THEN 5 + 4 * (n - 1) / 9.0 WHEN n < 50 THEN 9 + 5 * (n - 10) / 40.0 WHEN n < 500 THEN 14 + 6 * (n - 50) / 450.0 ELSE 20 END * 1000)::BIGINT AS radius_e3,
      round(CASE WHEN n <= 0 THEN 0 WHEN n < 1 THEN 0.16 * n WHEN n < 10 THEN 0.16 + 0.18 * (n - 1) / 9 WHEN n < 50 THEN 0.34 + 0.16 * (n - 10) / 40 ELSE 0.5 END * 10000)::BIGINT AS fill_e4,
      CASE WHEN z <= 6 THEN 'departments' WHEN z <= 9 THEN 'departments+events' WHEN z <= 12 THEN 'events+municipalities+smoke' ELSE 'events+municipalities+smoke+detections' END AS tier FROM x""",
)
def p22(spark, d):
    n, z = F.col("event_id") % 600, F.col("event_id") % 26 - 2
    return fx.detections(spark, d).select(
        "id", rules.age_bucket(F.col("event_id") % 30).alias("bucket"), F.round(rules.ramp(n, rules.MARKER_RADIUS) * 1000).cast("long").alias("radius_e3"),
        F.round(rules.ramp(n, rules.DEPARTMENT_FILL) * 10000).cast("long").alias("fill_e4"), rules.zoom_tier(z).alias("tier"),
    )


def _tile_sql(z: int) -> str:
    n = 1 << z
    return f"CAST(trunc((longitude + 180.0::DOUBLE) / 360.0::DOUBLE * {n}) AS INT) AS x, CAST(trunc((1.0::DOUBLE - asinh(tan(radians(latitude))) / pi()) / 2.0::DOUBLE * {n}) AS INT) AS y"


@query("p24_tiles", DET + f" SELECT {_tile_sql(8)}, count(*) AS n FROM det GROUP BY ALL")
def p24(spark, d):
    x, y = geo.tile_of(F.col("longitude"), F.col("latitude"), 8)
    return fx.detections(spark, d).groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"))


_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


@query("p26_public_id", f"WITH x AS (SELECT o_orderkey AS id, sha256(o_orderkey::VARCHAR) AS h FROM orders) SELECT id, 'FR-' || list_aggregate(list_transform(range(0, 8), lambda i: '{_ALPHABET}'[(('0x' || h[i * 2 + 1 : i * 2 + 2])::INT % 32 + 1)::INT]), 'string_agg', '') AS public_id, true AS valid FROM x")
def p26(spark, d):
    pid = text.public_id(F.col("o_orderkey").cast("string"))
    return fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), pid.alias("public_id")).withColumn("valid", text.is_public_id(F.col("public_id")))


@query(
    "p32_model_run",
    DET
    + """, x AS (SELECT id, event_id % 55 - 2 AS lead, acquired_at - INTERVAL 210 MINUTE AS r FROM det), y AS (SELECT id, lead, date_trunc('day', r) + INTERVAL 1 HOUR * (hour(r) // 3 * 3) AS run FROM x),
    z AS (SELECT *, date_trunc('day', run) + INTERVAL 11 HOUR AS noon FROM y)
    SELECT id, strftime(run, '%Y-%m-%dT%H:00:00Z') AS run_key, CASE WHEN lead BETWEEN 0 AND 48 THEN ['00H06H', '07H12H', '13H18H', '19H24H', '25H30H', '31H36H', '37H42H', '43H48H'][CASE WHEN lead <= 6 THEN 1 ELSE (lead - 7) // 6 + 2 END] END AS span,
      strftime(CASE WHEN noon < run THEN noon + INTERVAL 1 DAY ELSE noon END, '%Y-%m-%d %H:%M:%S') AS noon FROM z""",
)
def p32(spark, d):
    x = fx.detections(spark, d).withColumn("run", parsing.model_run(F.col("acquired_at")))
    return x.select("id", F.date_format("run", "yyyy-MM-dd'T'HH:00:00'Z'").alias("run_key"), parsing.lead_span(F.col("event_id") % 55 - 2).alias("span"), stamp(parsing.next_noon(F.col("run"))).alias("noon"))


@query("p30_rounded_coordinates", DET + " SELECT id, ((lon_e5 + 18000000 + 50) // 100) - 180000 AS lon_e3, ((lat_e5 + 50) // 100) AS lat_e3 FROM det")
def p30(spark, d):
    near = lambda c: F.floor(F.col(c) / 100.0 + 0.5).cast("long")
    return fx.detections(spark, d).select("id", near("lon_e5").alias("lon_e3"), near("lat_e5").alias("lat_e3"))


@query("p28_event_json", DET + """ SELECT id, '{"id":"' || id || '","sensor":"' || sensor || '","type":' || coalesce(type::VARCHAR, 'null') || ',"flags":[' || is_public || ',"' || day_night || '"]}' AS payload FROM det""")
def p28(spark, d):
    body = F.to_json(F.struct("id", "sensor", "type", F.array(F.col("is_public").cast("string"), F.col("day_night")).alias("flags")), {"ignoreNullFields": "false"})
    return fx.detections(spark, d).select("id", F.regexp_replace(body, r'\["(true|false)"', r"[$1").alias("payload"))


@query("f15_future_quarantine", DET + f" SELECT id, acquired_at > TIMESTAMP '{NOW}' - INTERVAL 3 DAY + INTERVAL 1 HOUR AS quarantined, TIMESTAMP '{NOW}' - acquired_at > INTERVAL 6 HOUR AS is_stale FROM det")
def f15(spark, d):
    return fx.detections(spark, d).select("id", rules.is_future(F.col("acquired_at"), F.expr(f"timestamp '{NOW}' - interval 3 days")).alias("quarantined"), rules.is_stale_detection(F.col("acquired_at"), fx.now()).alias("is_stale"))


@query(
    "f17_snapshot_stale",
    DET + f" SELECT id, ['new', 'recent', 'not_recent', 'archived'][event_id % 4 + 1] IN ('new', 'recent') AND TIMESTAMP '{NOW}' - acquired_at >= INTERVAL 60 MINUTE AS stale FROM det",
)
def f17(spark, d):
    state = F.expr("element_at(array('new', 'recent', 'not_recent', 'archived'), cast(event_id % 4 + 1 as int))")
    return fx.detections(spark, d).select("id", rules.snapshot_is_stale(F.col("acquired_at"), fx.now(), state).alias("stale"))


@query(
    "f21_quality_rules",
    DET
    + """ SELECT count(*) AS rows, count(*) FILTER (WHERE NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)) AS bad_coordinates, count(*) FILTER (WHERE frp_mw < 1) AS bad_frp,
    count(*) FILTER (WHERE confidence_score NOT BETWEEN 0 AND 1) AS bad_confidence, count(*) FILTER (WHERE type IS NULL) AS no_type FROM det""",
)
def f21(spark, d):
    bad = lambda c: F.count_if(F.expr(c))
    return fx.detections(spark, d).agg(
        F.count("*").alias("rows"), bad("not (latitude between -90 and 90 and longitude between -180 and 180)").alias("bad_coordinates"), bad("frp_mw < 1").alias("bad_frp"),
        bad("not confidence_score between 0 and 1").alias("bad_confidence"), bad("type is null").alias("no_type"),
    )
