"""Views that project the star-schema tables on the shapes of the domain (FIXTURES.md).

Coordinates are integers in 1e-5 degrees until one last division, so every engine gets
the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"
RUNS_NOW = "2001-09-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id", "cast(event_id as string) as id", "user_id",
        "sha2(concat('p|', event_type, '|', event_id), 256) as provider_key",
        "case when event_type in ('view', 'click', 'signup') then 'VIIRS' else 'MODIS' end as sensor",
        "case event_type when 'view' then 'N20' when 'click' then 'N21' when 'signup' then 'SNPP' when 'error' then 'Terra' else 'Aqua' end as satellite",
        "cast(ts as timestamp) as acquired_at",
        "(17600000 + (user_id % 15) * 80000 + (user_id div 150) * 1200000 + ((event_id * 7 % 41) - 20) * 80) % 36000000 - 18000000 as lon_e5",
        "4200000 + (user_id % 150 div 15) * 60000 + ((event_id * 11 % 37) - 18) * 80 as lat_e5",
        "case when event_id % 20 <> 0 then event_id % 100 end as confidence_pct",
        "value as frp_mw",
        "case when hour(ts) between 6 and 17 then 'D' else 'N' end as day_night",
        "event_id % 50 <> 0 as is_public",
        "case when event_id % 7 = 0 then 2 when event_id % 11 = 0 then 3 when event_id % 5 = 0 then null else 0 end as type",
        "props",
    ).selectExpr("*", "lon_e5 / 100000.0D as longitude", "lat_e5 / 100000.0D as latitude", "confidence_pct / 100.0D as confidence_score")


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in events whose members SQL can name: the public detections of one site and day."""
    return detections(spark, sf_dir).filter("is_public").withColumn("event_key", F.concat_ws("-", F.lit("E"), "user_id", F.date_format("acquired_at", "yyyyMMdd")))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    standard = (F.col("l_linestatus") == "F") & (F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp")) & (flag != "N")
    label = F.when(standard, "standard").otherwise("nrt")
    return read(spark, sf_dir, "lineitem").select(
        F.when(flag == "A", "N20").when(flag == "N", "N21").otherwise("SNPP").alias("satellite"), label.alias("corpus"),
        F.concat(F.when(standard, "fire_archive_").otherwise("fire_nrt_"), flag, F.lit(".csv")).alias("source_file"),
        F.col("l_shipdate").cast("timestamp").alias("detected_at"), F.col("l_partkey").alias("latitude"), F.col("l_suppkey").alias("longitude"),
        F.expr("case when l_linenumber = 1 then null else l_linenumber % 4 end").alias("type"),
    )


def territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").selectExpr(
        "'department' as type", "cast(n_nationkey as string) as code", "lower(n_name) as slug", "n_name as name", "cast(n_regionkey as string) as parent_code",
        "element_at(array('draft', 'pilot', 'active', 'disabled'), n_nationkey % 4 + 1) as status",
    )
    region = read(spark, sf_dir, "region").selectExpr(
        "'region' as type", "cast(r_regionkey as string) as code", "lower(r_name) as slug", "r_name as name", "cast(null as string) as parent_code", "'active' as status"
    )
    return nation.unionByName(region)


def municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(
        "lpad(cast(c_custkey as string), 5, '0') as insee_code", "c_name as name", "cast(c_nationkey as string) as department_code",
        "array(lpad(cast(c_custkey * 10 as string), 5, '0')) as postal_codes",
        "(-400000 + (c_custkey % 15) * 80000) / 100000.0D as longitude", "(4200000 + ((c_custkey % 150) div 15) * 60000) / 100000.0D as latitude",
        "c_custkey % 25 = 0 as is_retired", "c_mktsegment as segment",
    )


def known_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr(
        "concat('static:', s_suppkey) as source_key", "(-400000 + (s_suppkey % 15) * 80000) / 100000.0D as longitude",
        "(4200000 + ((s_suppkey % 150) div 15) * 60000) / 100000.0D as latitude", "500 + (s_suppkey % 10) * 450 as match_radius_m", "s_acctbal > 0 as is_active",
    )


def import_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority as source_key", "case o_orderstatus when 'F' then 'success' when 'P' then 'partial' else 'failed' end as status",
        "cast(o_orderdate as timestamp) as finished_at", "case when o_custkey % 3 <> 0 then cast(o_orderdate - interval 6 hours as timestamp) end as source_data_at", "o_custkey as records_read",
    )


#: The same views in DuckDB.
SQL = {
    "det": """SELECT *, lon_e5 / 100000.0::DOUBLE AS longitude, lat_e5 / 100000.0::DOUBLE AS latitude, confidence_pct / 100.0::DOUBLE AS confidence_score FROM (
      SELECT event_id, event_id::VARCHAR AS id, user_id, sha256('p|' || event_type || '|' || event_id) AS provider_key,
        CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'VIIRS' ELSE 'MODIS' END AS sensor,
        CASE event_type WHEN 'view' THEN 'N20' WHEN 'click' THEN 'N21' WHEN 'signup' THEN 'SNPP' WHEN 'error' THEN 'Terra' ELSE 'Aqua' END AS satellite,
        ts AS acquired_at, (17600000 + (user_id % 15) * 80000 + (user_id // 150) * 1200000 + ((event_id * 7 % 41) - 20) * 80) % 36000000 - 18000000 AS lon_e5,
        4200000 + ((user_id % 150) // 15) * 60000 + ((event_id * 11 % 37) - 18) * 80 AS lat_e5,
        CASE WHEN event_id % 20 <> 0 THEN event_id % 100 END AS confidence_pct, value AS frp_mw,
        CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'D' ELSE 'N' END AS day_night, event_id % 50 <> 0 AS is_public,
        CASE WHEN event_id % 7 = 0 THEN 2 WHEN event_id % 11 = 0 THEN 3 WHEN event_id % 5 = 0 THEN NULL ELSE 0 END AS type, props FROM events)""",
    "mem": "SELECT *, 'E-' || user_id || '-' || strftime(acquired_at, '%Y%m%d') AS event_key FROM det WHERE is_public",
    "corpus": """SELECT CASE l_returnflag WHEN 'A' THEN 'N20' WHEN 'N' THEN 'N21' ELSE 'SNPP' END AS satellite,
        CASE WHEN std THEN 'standard' ELSE 'nrt' END AS corpus, CASE WHEN std THEN 'fire_archive_' ELSE 'fire_nrt_' END || l_returnflag || '.csv' AS source_file,
        l_shipdate AS detected_at, l_partkey AS latitude, l_suppkey AS longitude, CASE WHEN l_linenumber <> 1 THEN l_linenumber % 4 END AS type
      FROM (SELECT *, l_linestatus = 'F' AND l_shipdate < TIMESTAMP '2000-01-01' AND l_returnflag <> 'N' AS std FROM lineitem)""",
    "terr": """SELECT 'department' AS type, n_nationkey::VARCHAR AS code, lower(n_name) AS slug, n_name AS name, n_regionkey::VARCHAR AS parent_code,
        ['draft', 'pilot', 'active', 'disabled'][n_nationkey % 4 + 1] AS status FROM nation
      UNION ALL SELECT 'region', r_regionkey::VARCHAR, lower(r_name), r_name, NULL, 'active' FROM region""",
    "muni": """SELECT lpad(c_custkey::VARCHAR, 5, '0') AS insee_code, c_name AS name, c_nationkey::VARCHAR AS department_code, [lpad((c_custkey * 10)::VARCHAR, 5, '0')] AS postal_codes,
        (-400000 + (c_custkey % 15) * 80000) / 100000.0::DOUBLE AS longitude, (4200000 + ((c_custkey % 150) // 15) * 60000) / 100000.0::DOUBLE AS latitude,
        c_custkey % 25 = 0 AS is_retired, c_mktsegment AS segment FROM customer""",
    "known": """SELECT 'static:' || s_suppkey AS source_key, (-400000 + (s_suppkey % 15) * 80000) / 100000.0::DOUBLE AS longitude,
        (4200000 + ((s_suppkey % 150) // 15) * 60000) / 100000.0::DOUBLE AS latitude, 500 + (s_suppkey % 10) * 450 AS match_radius_m, s_acctbal > 0 AS is_active FROM supplier""",
    "runs": """SELECT o_orderpriority AS source_key, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'partial' ELSE 'failed' END AS status,
        o_orderdate AS finished_at, CASE WHEN o_custkey % 3 <> 0 THEN o_orderdate - INTERVAL 6 HOUR END AS source_data_at, o_custkey AS records_read FROM orders""",
}


def with_views(*names: str) -> str:
    """A WITH clause of the named views, and those they need."""
    wanted = [*dict.fromkeys(x for n in names for x in (("det", "mem") if n == "mem" else (n,)))]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
