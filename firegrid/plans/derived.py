"""Ranges, boxes, labels and tiles derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.functions import geo
from firegrid.operators import calibration, clustering, coverage, event_state, search, shapes, spatial, tiles
from firegrid.plans.registry import query
from firegrid.plans.surface import bbox_outcome
from firegrid.sources import fixtures as fx
from firegrid.sources import providers, sinks
from firegrid.sources.fixtures import with_views


@query("s5_split_bbox", with_views("det") + """, b AS (SELECT user_id, min(longitude) - 6 AS x0, max(longitude) + 6 AS x1, min(latitude) - 9 AS y0, max(latitude) + 9 AS y1 FROM det GROUP BY 1),
  n AS (SELECT *, greatest(1, ceil((x1 - x0) / 10.0::DOUBLE))::INT AS nx, greatest(1, ceil((y1 - y0) / 10.0::DOUBLE))::INT AS ny FROM b), i AS (SELECT *, unnest(range(0, nx)) AS i FROM n), j AS (SELECT *, unnest(range(0, ny)) AS j FROM i)
  SELECT user_id, x0 + i * ((x1 - x0) / nx) AS min_lon, y0 + j * ((y1 - y0) / ny) AS min_lat, x0 + (i + 1) * ((x1 - x0) / nx) AS max_lon, y0 + (j + 1) * ((y1 - y0) / ny) AS max_lat FROM j""")
def s5(spark, d):
    """The request tiles of every site's surroundings."""
    box = fx.detections(spark, d).groupBy("user_id").agg(
        (F.min("longitude") - 6).alias("min_lon"), (F.max("longitude") + 6).alias("max_lon"), (F.min("latitude") - 9).alias("min_lat"), (F.max("latitude") + 9).alias("max_lat")
    )
    return providers.split_boxes(box)


@query("s6_windows", """WITH h AS (SELECT user_id, max(ts)::DATE + 1 AS e, date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS n FROM events GROUP BY 1), o AS (SELECT *, unnest(range(0, n, 5)) AS o FROM h)
  SELECT user_id, strftime(e - n::INT + o::INT, '%Y-%m-%d') AS start, least(5, n - o)::INT AS days FROM o""")
def s6(spark, d):
    """The request windows of every site's history."""
    day = lambda f: F.to_date(f("ts"))
    history = fx.read(spark, d, "events").groupBy("user_id").agg(F.date_add(day(F.max), 1).alias("end"), (F.datediff(day(F.max), day(F.min)) + 1).alias("history_days"))
    return providers.history_windows(history, 5).select("user_id", F.date_format("start", "yyyy-MM-dd").alias("start"), F.col("days").cast("int").alias("days"))


_BOX = "(o_custkey % 400 - 200) / 2.0::DOUBLE AS x0, (o_custkey % 400 - 200 + o_orderkey % 23 - 2) / 2.0::DOUBLE AS x1, CASE WHEN o_orderkey % 11 <> 0 THEN (o_custkey % 190 - 92) / 1.0::DOUBLE END AS y0, (o_custkey % 190 - 92 + o_orderkey % 9) / 1.0::DOUBLE AS y1"


@query("f7_bbox_validation", f"""WITH b AS (SELECT o_orderkey AS id, {_BOX} FROM orders) SELECT id, CASE WHEN x0 IS NULL OR y0 IS NULL OR x0 >= x1 OR y0 >= y1 OR x0 < -180 OR x1 > 180 OR y0 < -90 OR y1 > 90 THEN 'INVALID_BBOX'
  WHEN (x1 - x0) * (y1 - y0) > 30 THEN 'BBOX_TOO_LARGE' ELSE 'ok' END AS outcome FROM b""")
def f7(spark, d):
    boxes = fx.read(spark, d, "orders").selectExpr("o_orderkey as id", *(x.strip() for x in _BOX.replace("2.0::DOUBLE", "2.0D").replace("1.0::DOUBLE", "1.0D").split(", ")))
    return boxes.select("id", bbox_outcome(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("outcome"))


@query("p25_tile_bands", """WITH r AS (SELECT o_orderkey AS id, o_custkey % 50 AS x0, o_custkey % 50 + o_orderkey % 40 AS x1 FROM orders), w AS (SELECT *, ceil((x1 - x0 + 1) / least(3, x1 - x0 + 1)::DOUBLE)::BIGINT AS w FROM r),
  f AS (SELECT *, unnest(range(x0, x1 + 1, w)) AS f FROM w) SELECT id, f AS first, least(f + w - 1, x1) AS last FROM f""")
def p25(spark, d):
    ranges = fx.read(spark, d, "orders").selectExpr("o_orderkey as id", "o_custkey % 50 as x0", "o_custkey % 50 + o_orderkey % 40 as x1")
    starts, width = geo.band_starts(F.col("x0"), F.col("x1"), 3)
    return ranges.select("id", "x1", width.alias("w"), F.explode(starts).alias("first")).select("id", "first", F.least(F.col("first") + F.col("w") - 1, F.col("x1")).alias("last"))


@query("u5_generators", """WITH c AS (SELECT o_custkey AS id, date_trunc('month', min(o_orderdate)) AS a, date_trunc('month', max(o_orderdate)) AS b FROM orders GROUP BY 1), m AS (SELECT id, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM c)
  SELECT id, strftime(m, '%Y-%m') AS month, x FROM m, range(0, 2) t(x)""")
def u5(spark, d):
    """The months from every customer's first order to the last, twice."""
    month = lambda f: F.date_trunc("month", f("o_orderdate"))
    spans = fx.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(month(F.min).alias("a"), month(F.max).alias("b"))
    months = spans.select("id", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("m"))
    return months.select("id", F.date_format("m", "yyyy-MM").alias("month"), F.explode(F.expr("sequence(0L, 1L)")).alias("x"))


_LABELS = """SELECT o_orderkey AS id, 'calib-r' || [1000, 1500, 2000, 2500, 3000, 4000, 5000][o_custkey % 7 + 1] || '-w' || [6, 12, 24, 48][o_orderkey % 4 + 1] || CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE '-s' || ['0.20', '0.35', '0.50', '0.65'][o_custkey % 4 + 1] END AS version FROM orders"""


def _labels(spark, d):
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    threshold = F.when(order % 13 == 0, "").otherwise(F.concat(F.lit("-s"), pick(["0.20", "0.35", "0.50", "0.65"], customer % 4)))
    name = F.concat(F.lit("calib-r"), pick([*map(str, clustering.RADII)], customer % 7), F.lit("-w"), pick([*map(str, clustering.WINDOWS)], order % 4), threshold)
    return fx.read(spark, d, "orders").select(order.alias("id"), name.alias("version"))


@query("x11_parameter_grid", f"WITH l AS ({_LABELS}), p AS (SELECT id, regexp_extract(version, '^calib-r(\\d+)-w(\\d+)-s(\\d\\.\\d{{2}})$', ['r', 'w', 's']) AS p FROM l) SELECT id, TRY_CAST(p.r AS INT) AS radius, TRY_CAST(p.w AS INT) AS window_h, TRY_CAST(p.s AS DOUBLE) AS threshold FROM p")
def x11(spark, d):
    """The parameters behind every order's label; some labels are no sets."""
    return _labels(spark, d).select("id", calibration.label_parameters(F.col("version")).alias("p")).select("id", "p.radius", "p.window_h", "p.threshold")


@query("s28_remaining_sets", f"""WITH l AS ({_LABELS}), g AS (SELECT 'calib-r' || r || '-w' || w || '-s' || s AS version FROM (VALUES (1000), (1500), (2000), (2500), (3000), (4000), (5000)) a(r), (VALUES (6), (12), (24), (48)) b(w), (VALUES ('0.20'), ('0.35'), ('0.50'), ('0.65')) c(s))
  SELECT version FROM g WHERE version NOT IN (SELECT version FROM l WHERE id % 3 = 0)""")
def s28(spark, d):
    """The sets of the crossed grid that the orders of one kind do not name as measured."""
    sets = spark.createDataFrame([(p.version,) for p in clustering.crossed_grid()], "version string")
    return sets.join(_labels(spark, d).filter("id % 3 = 0").select("version"), "version", "left_anti")


def _places(spark, d):
    """A box of 0.6 by 0.5 degrees around every municipality, as a feature."""
    box = fx.municipalities(spark, d).selectExpr("insee_code as code", "longitude - 0.3D as lon_min", "longitude + 0.3D as lon_max", "latitude - 0.25D as lat_min", "latitude + 0.25D as lat_max")
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ring = F.array(corner("lon_min", "lat_min"), corner("lon_max", "lat_min"), corner("lon_max", "lat_max"), corner("lon_min", "lat_max"), corner("lon_min", "lat_min"))
    return box.withColumn("rings", F.array(ring))


_WX = lambda c: f"(({c}) + 180.0::DOUBLE) / 360.0::DOUBLE * 256.0::DOUBLE"
_WY = lambda c: f"(1.0::DOUBLE - asinh(tan(radians({c}))) / pi()) / 2.0::DOUBLE * 256.0::DOUBLE"
_CUT = lambda c, t: f"floor(least(greatest({c} * 4096 - {t} * 4096.0::DOUBLE, -64.0::DOUBLE), 4160.0::DOUBLE) + 0.5::DOUBLE)::BIGINT"
_TILED = (
    with_views("muni") + f""", b AS (SELECT insee_code AS code, {_WX("longitude - 0.3::DOUBLE")} AS x0, {_WX("longitude + 0.3::DOUBLE")} AS x1, {_WY("latitude + 0.25::DOUBLE")} AS y0, {_WY("latitude - 0.25::DOUBLE")} AS y1 FROM muni),
  tx AS (SELECT *, unnest(range(trunc(x0)::INT, trunc(x1)::INT + 1)) AS x FROM b), t AS (SELECT *, unnest(range(trunc(y0)::INT, trunc(y1)::INT + 1)) AS y FROM tx),
  u AS (SELECT code, x::INT AS x, y::INT AS y, {_CUT("x0", "x")} AS a, {_CUT("x1", "x")} AS b, {_CUT("y0", "y")} AS c, {_CUT("y1", "y")} AS d FROM t), p AS (SELECT code, x, y, ((b - a) * (d - c))::DOUBLE AS area FROM u WHERE b > a AND d > c)"""
)


@query("g15_clipped_tiles", _TILED + " SELECT * FROM p")
def g15(spark, d):
    """What of every municipality's box lies in each tile of zoom 8, with a margin of 64 units."""
    return tiles.clip_to_tiles(_places(spark, d), 8, margin=64).select("code", "x", "y", "area")


@query("j14_tile_features", _TILED + " SELECT x, y, count(*) AS features, sum(area) AS area FROM p GROUP BY 1, 2")
def j14(spark, d):
    return tiles.clip_to_tiles(_places(spark, d), 8, margin=64).groupBy("x", "y").agg(F.count("*").alias("features"), F.sum("area").alias("area"))


@query("p31_redacted_payloads", """SELECT event_id AS id, '{"user":{"id":' || user_id || ',"apiKey":"[redacted]"},"calls":[{"Authorization":"[redacted]","at":"' || event_type || '"},{"Authorization":"[redacted]","at":"x"}],"headers":{"kind":"' || event_type || '","x-token":"[redacted]"}}' AS payload FROM events""")
def p31(spark, d):
    """Payloads of every event with secrets in a struct, in structs of an array and in a map."""
    call = lambda at: F.struct(F.col("props").alias("Authorization"), at.alias("at"))
    body = fx.read(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.struct(
            F.struct(F.col("user_id").alias("id"), F.col("props").alias("apiKey")).alias("user"), F.array(call(F.col("event_type")), call(F.lit("x"))).alias("calls"),
            F.create_map(F.lit("kind"), F.col("event_type"), F.lit("x-token"), F.col("props")).alias("headers"),
        ).alias("payload"),
    )
    return sinks.redact(body).select("id", F.to_json("payload").alias("payload"))


_BRICK = "0.00390625::DOUBLE"


def _bricks(spark, d):
    """Every customer's brick on a wall 1000 bricks wide; odd rows are half a brick further, so all joints are T-junctions."""
    k = F.col("c_custkey").cast("long")
    x, y = k % 1000, F.expr("c_custkey div 1000")
    side = F.lit(1 / 256)
    place = fx.read(spark, d, "customer").select(k.cast("string").alias("code"), F.expr("c_custkey % 1000 div 100").alias("department"), F.expr("c_custkey % 1000 div 400").alias("region"), ((x + (y % 2) / 2) * side).alias("lon"), (y * side).alias("lat"))
    corner = lambda i, j: F.struct((F.col("lon") + i * side).alias("lon"), (F.col("lat") + j * side).alias("lat"))
    ring = F.array(*(corner(i, j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))
    return place.select("code", "department", "region", F.lit(0).cast("long").alias("country"), F.array(ring).alias("rings"))


@query("a27_dissolved_levels", f"""WITH b AS (SELECT c_custkey % 1000 // 100 AS department, c_custkey % 1000 // 400 AS region FROM customer), a AS (SELECT 'department' AS level, department AS code FROM b UNION ALL SELECT 'region', region FROM b UNION ALL SELECT 'country', 0 FROM b)
  SELECT level, code::BIGINT AS code, count(*) * {_BRICK} * {_BRICK} AS area FROM a GROUP BY 1, 2""")
def a27(spark, d):
    """Departments, regions and the country out of all bricks: their areas add up only if every inner joint cancels."""
    levels = coverage.dissolve_levels(_bricks(spark, d), "code", ["department", "region", "country"])
    rows = [coverage.planar_area(edges, key).select(F.lit(key).alias("level"), F.col(key).cast("long").alias("code"), "area") for key, edges in levels.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("g14_simplified_coverage", f"SELECT c_custkey::VARCHAR AS code, {_BRICK} * {_BRICK} AS area FROM customer")
def g14(spark, d):
    """All bricks, simplified together: straight borders lose no area."""
    small = coverage.simplify_coverage(_bricks(spark, d).select("code", "rings"), "code", 1e-6)
    edges = small.select("code", F.explode("rings").alias("r")).select("code", F.explode(F.arrays_zip(F.slice("r", F.lit(1), F.size("r") - 1).alias("a"), F.slice("r", F.lit(2), F.size("r") - 1).alias("b"))).alias("e"))
    return coverage.planar_area(edges.select("code", F.col("e.a.lon").alias("x0"), F.col("e.a.lat").alias("y0"), F.col("e.b.lon").alias("x1"), F.col("e.b.lat").alias("y1")), "code")


@query("q8_many_searches", with_views("muni") + """, m AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS n FROM muni WHERE NOT is_retired), w AS (SELECT s_suppkey AS search_id, trim(regexp_replace(lower('customer ' || lpad((s_suppkey * 7)::VARCHAR, 9, '0')), '[^a-z0-9]+', ' ', 'g')) AS q FROM supplier),
  tm AS (SELECT *, list_distinct(flatten(list_transform(string_split(n, ' '), lambda w: list_transform(range(0, length(w) + 1), lambda i: substr('  ' || w || ' ', i + 1, 3))))) AS a FROM m), tw AS (SELECT *, list_distinct(flatten(list_transform(string_split(q, ' '), lambda w: list_transform(range(0, length(w) + 1), lambda i: substr('  ' || w || ' ', i + 1, 3))))) AS b FROM w),
  s AS (SELECT search_id, insee_code, name, n, q, len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) AS alike FROM tm, tw),
  r AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY n = q DESC, starts_with(n, q) DESC, alike DESC, name, insee_code) AS place FROM s WHERE starts_with(n, q) OR alike >= 0.3) SELECT search_id, place, insee_code, round(alike, 6) AS similarity FROM r WHERE place <= 10""")
def q8_many(spark, d):
    """A search of ten places for every supplier, in one join."""
    wanted = fx.read(spark, d, "supplier").select(F.col("s_suppkey").alias("search_id"), F.concat(F.lit("Customer "), F.lpad((F.col("s_suppkey") * 7).cast("string"), 9, "0")).alias("q"))
    found = search.search_many(fx.municipalities(spark, d).filter("not is_retired"), wanted, 10)
    return found.select("search_id", "place", "insee_code", F.round("similarity", 6).alias("similarity"))


_MOVED = "(({}) + 716.0::DOUBLE) % 360.0::DOUBLE - 180.0::DOUBLE"
_APART = "((d.longitude - s.lon2 + 540.0::DOUBLE) % 360.0::DOUBLE - 180.0::DOUBLE)"
_LEVEL = "radians((d.latitude + s.lat2) / 2)"
_METRES = f"sqrt((radians(d.latitude - s.lat2) * 6335439.32729 / (1 - 0.00669437999014 * sin({_LEVEL}) ** 2) ** 1.5) ** 2 + (radians({_APART}) * 6378137.0 * cos({_LEVEL}) / sqrt(1 - 0.00669437999014 * sin({_LEVEL}) ** 2)) ** 2)"


@query("g16_radius_anywhere", with_views("det") + f""", d AS (SELECT {_MOVED.format("longitude")} AS longitude, latitude + 37.0::DOUBLE AS latitude FROM det),
  s AS (SELECT DISTINCT user_id, {_MOVED.format("((17600000 + (user_id % 15) * 80000 + (user_id // 150) * 1200000) % 36000000 - 18000000) / 100000.0::DOUBLE")} AS lon2, (7900000 + ((user_id % 150) // 15) * 60000) / 100000.0::DOUBLE AS lat2, 307 + user_id % 10 * 450 AS r FROM det)
  SELECT user_id, count(*) AS n FROM d, s WHERE abs(d.latitude - s.lat2) < 0.05 AND {_METRES} <= s.r GROUP BY 1""")
def g16(spark, d):
    """How many detections lie within every site's radius, all moved to 79 to 85 degrees north and around the 180th meridian."""
    moved = lambda c: (c + 716.0) % 360.0 - 180.0
    det = fx.detections(spark, d)
    points = det.select(moved(F.col("longitude")).alias("longitude"), (F.col("latitude") + 37.0).alias("latitude"))
    site = F.expr("((17600000 + (user_id % 15) * 80000 + (user_id div 150) * 1200000) % 36000000 - 18000000) / 100000.0D")
    sites = det.select("user_id").distinct().select("user_id", moved(site).alias("lon2"), F.expr("(7900000 + (user_id % 150 div 15) * 60000) / 100000.0D").alias("lat2"), (307 + F.col("user_id") % 10 * 450).alias("r"))
    return spatial.within_distance(points, sites, F.col("r")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("g9_repaired_rings", "SELECT c_custkey AS id, 2 AS rings, (1 + c_custkey % 8) * (1 + c_custkey % 5) / 2.0::DOUBLE AS area FROM customer")
def g9(spark, d):
    """A bow tie of every customer's size, repaired to its two wings."""
    k = F.col("c_custkey")
    w, h, zero = (1 + k % 8).cast("double"), (1 + k % 5).cast("double"), F.lit(0.0)
    ring = F.array(*(F.struct(x.alias("lon"), y.alias("lat")) for x, y in ((zero, zero), (w, h), (w, zero), (zero, h), (zero, zero))))
    # A small file is one task's; the rows are dealt before they are worked on.
    ties = fx.read(spark, d, "customer").select(k.alias("id"), F.array(ring).alias("rings")).repartition("id")
    fixed = ties.select("id", shapes.repaired_rings("rings").alias("fixed"))
    corners = fixed.select("id", F.size("fixed").alias("rings"), F.explode("fixed").alias("r")).select("id", "rings", F.explode(F.arrays_zip(F.slice("r", F.lit(1), F.size("r") - 1).alias("a"), F.slice("r", F.lit(2), F.size("r") - 1).alias("b"))).alias("e"))
    edges = corners.select("id", "rings", F.col("e.a.lon").alias("x0"), F.col("e.a.lat").alias("y0"), F.col("e.b.lon").alias("x1"), F.col("e.b.lat").alias("y1"))
    return coverage.planar_area(edges, "id", "rings")


@query("g7_site_buffers")
def g7(spark, d):
    """The ring at 190 m around every site's detections: its points and area."""
    rings = shapes.buffered_groups(fx.detections(spark, d).select("user_id", "longitude", "latitude"), "user_id")
    polygons = rings.select("user_id", F.size("ring").alias("points"), F.array("ring").alias("polygon"))
    return polygons.select("user_id", "points", F.round(shapes.area_km2("polygon"), 6).alias("area_km2"))


@query("x6_replay_in_slices")
def x6(spark, d):
    """All public detections replayed in eight slices of time, with the open events as state, against one pass."""
    rows = clustering.rows_of(fx.detections(spark, d).filter("is_public"))
    size = -(-rows.count() // 8)
    sliced = clustering.partition_signature(event_state.replay_slices(rows, clustering.REFERENCE, size))
    whole = clustering.partition_signature(clustering.cluster(rows))
    return sliced.join(whole.select("version", F.col("signature").alias("one_pass")), "version").select("events", (F.col("signature") == F.col("one_pass")).alias("equals_one_pass"))
