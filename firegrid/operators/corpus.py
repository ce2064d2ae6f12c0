"""Multi-season archives: labels, normalisation, supersession, duplicates, strata, static sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.functions.geo import equirectangular_m, grid_cell
from firegrid.functions.parsing import acquisition_time, number

NATURAL_KEY = ["satellite", "detected_at", "latitude", "longitude"]
RANKS = {"standard": 0, "nrt": 1}


def corpus_label(file: Column) -> Column:
    """standard or nrt, by the file's name; any other name fails."""
    base = F.regexp_extract(file, r"([^/\\]*)$", 1)
    return F.when(base.startswith("fire_archive"), "standard").when(base.startswith("fire_nrt"), "nrt").otherwise(F.raise_error(F.concat(F.lit("unexpected file name: "), base)))


def normalise(df: DataFrame) -> DataFrame:
    """Typed corpus rows of string columns: instant, numbers, three-valued vegetation flag, rank."""
    kind = F.col("type").try_cast("tinyint") if "type" in df.columns else F.lit(None).cast("tinyint")
    numeric = [c for c in ("latitude", "longitude", "brightness", "scan", "track", "bright_t31", "frp") if c in df.columns]
    rank = F.when(F.col("corpus") == "standard", 0).when(F.col("corpus") == "nrt", 1).otherwise(F.raise_error(F.lit("corpus without a rank")))
    return (
        df.withColumns({c: number(F.col(c)) for c in numeric})
        .withColumn("instrument", F.lit("VIIRS")).withColumn("type", kind)
        .withColumn("detected_at", acquisition_time(F.col("acq_date"), F.col("acq_time")))
        .withColumn("is_vegetation", F.when(kind.isNotNull(), kind == 0)).withColumn("corpus_rank", rank.cast("tinyint"))
    )


def standard_bounds(df: DataFrame) -> DataFrame:
    """Latest standard observation of every satellite that has one."""
    return df.filter("corpus = 'standard'").groupBy("satellite").agg(F.max("detected_at").alias("standard_until"))


def drop_superseded(df: DataFrame) -> DataFrame:
    """Without the near-real-time rows that standard data of the same satellite cover, bound included."""
    # One row a satellite, few by nature: a join by key would put each satellite's whole corpus in one task.
    bounded = df.join(F.broadcast(standard_bounds(df)), "satellite", "left")
    return bounded.filter(~((F.col("corpus") == "nrt") & F.coalesce(F.col("detected_at") <= F.col("standard_until"), F.lit(False)))).drop("standard_until")


def drop_duplicates(df: DataFrame, file: str = "source_file") -> DataFrame:
    """One row for each natural key: the better corpus, then the first file name, then the other columns, so reruns agree."""
    rank = F.when(F.col("corpus") == "standard", 0).otherwise(1)
    others = [F.col(c).asc_nulls_last() for c, kind in sorted(df.dtypes) if c not in (*NATURAL_KEY, "corpus", file) and not kind.startswith(("map", "variant"))]
    order = Window.partitionBy(*NATURAL_KEY).orderBy(rank, F.col(file).asc_nulls_last(), *others)
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def merge(*frames: DataFrame) -> DataFrame:
    """All frames by name, without superseded and duplicate rows."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return drop_duplicates(drop_superseded(out))


def canonical_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in NATURAL_KEY))


def canonical_positions(df: DataFrame, name: str = "position") -> DataFrame:
    """`df` in canonical order with each row's place, from 1; NATURAL_KEY must be unique for it to be definite.

    A range-partitioned sort; the rows of the partitions before are counted, one row each.
    """
    from firegrid.operators.graph import shared_checkpoint

    # monotonically_increasing_id is the partition's number times 2**33 and the place in it.
    placed = shared_checkpoint(canonical_order(df).withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    before = placed.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).drop("count")
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_id", "_before")


def summary(df: DataFrame) -> DataFrame:
    """(dimension, key, n): rows in all, by satellite and corpus, and by type."""
    return (
        df.groupingSets([[], ["satellite", "corpus"], ["type"]], "satellite", "corpus", "type")
        .agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
        .select(
            F.when(F.col("g") == 7, "all").when(F.col("g") == 1, "satellite").otherwise("type").alias("dimension"),
            F.when(F.col("g") == 7, "").when(F.col("g") == 1, F.concat_ws("/", "satellite", "corpus")).otherwise(F.coalesce(F.col("type").cast("string"), F.lit("absent"))).alias("key"),
            "n",
        )
    )


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: count and order-free digest of the rows' contents; equal tables have equal digests."""
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", F.count("*"), F.sum(part(0)), F.sum(part(1))), 256).alias("fingerprint"))


@dataclass(frozen=True)
class Stratum:
    key: str
    lon_min: float
    lon_max: float
    lat_min: float
    lat_max: float
    start: str
    end: str


#: The calibration strata (fixed values): closed in space, half-open in time.
STRATA = (
    Stratum("grand-feu-gironde-2022", -1.45, 0.10, 44.10, 45.65, "2022-06-01", "2022-10-01"),
    Stratum("relief-var-2021", 5.55, 7.80, 42.90, 44.45, "2021-06-01", "2021-10-01"),
    Stratum("industriel-berre-2023", 4.70, 5.25, 43.30, 43.60, "2023-01-01", "2024-01-01"),
    Stratum("pilote-0683-2026", 5.55, 7.80, 42.90, 44.45, "2026-05-01", "2026-08-03"),
    Stratum("fond-epars-0683-2018", 5.55, 7.80, 42.90, 44.45, "2018-06-01", "2018-10-01"),
)


def in_stratum(s: Stratum, time: str = "detected_at") -> Column:
    at = F.col(time)
    return (
        F.col("longitude").between(s.lon_min, s.lon_max) & F.col("latitude").between(s.lat_min, s.lat_max)
        & (at >= F.lit(s.start).cast("timestamp")) & (at < F.lit(s.end).cast("timestamp"))
    )


def extract_strata(df: DataFrame, strata=STRATA, time: str = "detected_at") -> DataFrame:
    """Rows of any stratum, once each, with the list of their strata."""
    keys = [s.key for s in strata]
    if len({*keys}) < len(keys):
        raise ValueError("stratum keys repeat")
    held = F.array_compact(F.array(*(F.when(in_stratum(s, time), F.lit(s.key)) for s in strata)))
    return df.withColumn("strata", held).filter("size(strata) > 0")


def stratum_report(df: DataFrame, strata=STRATA, time: str = "detected_at") -> DataFrame:
    """(stratum, n) of every stratum and of their overlap, in one pass; empty strata show 0."""
    counts = df.agg(
        *(F.count_if(in_stratum(s, time)).alias(f"s{k}") for k, s in enumerate(strata)),
        F.count_if(_any(strata, time)).alias("union"),
    )
    total = sum((F.col(f"s{k}") for k in range(1, len(strata))), F.col("s0"))
    rows = [F.struct(F.lit(s.key).alias("stratum"), F.col(f"s{k}").alias("n")) for k, s in enumerate(strata)]
    rows.append(F.struct(F.lit("overlap").alias("stratum"), (total - F.col("union")).alias("n")))
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _any(strata, time: str) -> Column:
    out = in_stratum(strata[0], time)
    for s in strata[1:]:
        out = out | in_stratum(s, time)
    return out


MIN_DETECTIONS, MIN_MONTHS, STATIC_TYPE = 20, 6, 2
RADIUS_FLOOR_M, RADIUS_CEILING_M, HALF_PIXEL_M = 500, 5000, 265


def occupied_components(cells: DataFrame) -> DataFrame:
    """(cell_x, cell_y, zone_x, zone_y): 8-connected components, named by their smallest cell.

    Smallest names spread to the neighbours and then jump to their own names' names, until
    nothing changes. Cells are far fewer than observations; each round is checkpointed.
    """
    from firegrid.operators.graph import components_of

    own = cells.select("cell_x", "cell_y").distinct().withColumn("node", F.struct("cell_x", "cell_y"))
    near = own.select(
        F.col("node").alias("u"),
        F.explode(F.array(*(F.struct((F.col("cell_x") + dx).alias("cell_x"), (F.col("cell_y") + dy).alias("cell_y")) for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1))))).alias("v"),
    )
    links = near.join(own.select(F.col("node").alias("v")), "v").select("u", "v")
    return own.join(components_of(links), "node", "left").select(
        "cell_x", "cell_y", F.coalesce("component", "node")["cell_x"].alias("zone_x"), F.coalesce("component", "node")["cell_y"].alias("zone_y")
    )


def static_zones(df: DataFrame) -> DataFrame:
    """The type-2 rows of a corpus with their zone."""
    static = df.filter(F.col("type") == STATIC_TYPE).select(
        "longitude", "latitude", "detected_at", grid_cell(F.col("longitude")).alias("cell_x"), grid_cell(F.col("latitude")).alias("cell_y")
    )
    return static.join(occupied_components(static), ["cell_x", "cell_y"])


def derive_static_sources(df: DataFrame, min_detections: int = MIN_DETECTIONS, min_months: int = MIN_MONTHS, version: str = "static-v1") -> DataFrame:
    """Registry of recurrent static heat sources from the type-2 rows of a corpus."""
    zoned = static_zones(df)
    means = zoned.groupBy("zone_x", "zone_y").agg(
        F.count("*").alias("detection_count"), F.count_distinct(F.date_format("detected_at", "yyyy-MM")).alias("month_count"),
        F.avg("latitude").alias("mean_lat"), F.avg("longitude").alias("mean_lon"), F.min("detected_at").alias("first"), F.max("detected_at").alias("last"),
    ).filter((F.col("detection_count") >= min_detections) & (F.col("month_count") >= min_months))
    spread = (
        zoned.join(means.select("zone_x", "zone_y", "mean_lat", "mean_lon"), ["zone_x", "zone_y"])
        .groupBy("zone_x", "zone_y")
        .agg(F.max(equirectangular_m(F.col("mean_lon"), F.col("mean_lat"), F.col("longitude"), F.col("latitude"))).alias("spread_m"))
    )
    radius = F.least(F.lit(RADIUS_CEILING_M), F.greatest(F.lit(RADIUS_FLOOR_M), F.ceil(F.col("spread_m") + HALF_PIXEL_M))).cast("int")
    return means.join(spread, ["zone_x", "zone_y"]).select(
        F.concat_ws(":", F.lit(version), "zone_x", "zone_y").alias("source_key"), F.col("mean_lat").alias("latitude"), F.col("mean_lon").alias("longitude"),
        radius.alias("match_radius_m"), "detection_count", "month_count", F.to_date("first").alias("first_seen"), F.to_date("last").alias("last_seen"),
    )
