"""Scans of provider exports, each split into accepted and rejected rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.functions import parsing
from firegrid.operators.corpus import corpus_label

FIELDS = ("latitude", "longitude", "brightness", "bright_ti4", "scan", "track", "acq_date", "acq_time", "satellite", "instrument", "confidence", "version", "frp", "daynight", "type")


def looks_like_csv(body: Column) -> Column:
    """Whether the first line names both coordinates; providers answer errors as plain text."""
    first = F.lower(F.split_part(F.ltrim(body), F.lit("\n"), F.lit(1)))
    return F.contains(first, F.lit("latitude")) & F.contains(first, F.lit("longitude"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text under the header's names, with `source_file`; nothing is inferred."""
    return spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE").withColumn("source_file", F.col("_metadata.file_name"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """CSV archives with their corpus label."""
    return read_csv(spark, path).withColumn("corpus", corpus_label(F.col("source_file")))


def parse_rows(rows: DataFrame, product: str | Column) -> DataFrame:
    """Text rows to typed detections, with `rejects`: the reasons why a row is unusable, empty if it is accepted.

    Missing columns count as empty. A row is rejected for unreadable or impossible
    coordinates and for an unreadable instant; any other unreadable field is null.
    """
    product = F.lit(product) if isinstance(product, str) else product
    text = {c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("") for c in FIELDS}
    instrument = F.upper(F.trim(text["instrument"]))
    sensor = F.when(instrument == "", "UNKNOWN").otherwise(instrument)
    lat, lon = parsing.number(text["latitude"]), parsing.number(text["longitude"])
    at = parsing.acquisition_time(text["acq_date"], text["acq_time"])
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    satellite, version = F.coalesce(filled(text["satellite"]), F.lit("UNKNOWN")), filled(text["version"])
    rejects = F.array_compact(
        F.array(
            F.when(lat.isNull(), "latitude"), F.when(lon.isNull(), "longitude"),
            F.when(~lat.between(-90, 90) | ~lon.between(-180, 180), "coordinates out of range"), F.when(at.isNull(), "acquisition time"),
        )
    )
    return rows.select(
        "*", rejects.alias("rejects"), sensor.alias("_sensor"), satellite.alias("_satellite"), version.alias("product_version"), at.alias("acquired_at"),
        lat.alias("_lat"), lon.alias("_lon"), filled(text["confidence"]).alias("confidence_raw"), parsing.confidence(text["confidence"], sensor).alias("confidence_score"),
        parsing.number(text["frp"]).alias("frp_mw"), F.coalesce(parsing.number(text["brightness"]), parsing.number(text["bright_ti4"])).alias("_brightness"),
        parsing.day_night(text["daynight"]).alias("day_night"), parsing.number(text["scan"]).alias("scan_km"), parsing.number(text["track"]).alias("track_km"),
        filled(text["type"]).alias("thermal_type"), product.alias("product"),
        F.to_json(F.struct(*(F.col(c) for c in rows.columns if c in FIELDS))).alias("raw_payload"),
    ).select(
        "rejects", F.when(F.size("rejects") == 0, parsing.provider_key(F.col("product"), F.col("_satellite"), F.col("_sensor"), F.col("acquired_at"), F.col("_lat"), F.col("_lon"), F.col("product_version"))).alias("provider_key"),
        "product", F.col("_sensor").alias("sensor"), F.col("_satellite").alias("satellite"), "product_version", "acquired_at", F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"),
        "confidence_raw", "confidence_score", "frp_mw", F.col("_brightness").alias("brightness"), "day_night", "scan_km", "track_km", "thermal_type", "raw_payload",
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("size(rejects) = 0").drop("rejects")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter("size(rejects) > 0")


#: Product of a satellite; an unknown satellite fails the import.
PRODUCTS = {"N20": "VIIRS_NOAA20_SP", "N21": "VIIRS_NOAA21_NRT", "SNPP": "VIIRS_SNPP_SP"}


def product_of(satellite: Column, products: dict[str, str] = PRODUCTS) -> Column:
    known = F.create_map(*(F.lit(x) for kv in products.items() for x in kv))
    return F.coalesce(F.try_element_at(known, satellite), F.raise_error(F.concat(F.lit("unknown satellite: "), F.coalesce(satellite, F.lit("null")))).cast("string"))


def split_bbox(min_lon: float, min_lat: float, max_lon: float, max_lat: float, span: float = 10.0) -> list[tuple[float, float, float, float]]:
    """Equal tiles of at most `span` degrees on each axis, west to east in rows from the south."""
    nx, ny = max(1, math.ceil((max_lon - min_lon) / span)), max(1, math.ceil((max_lat - min_lat) / span))
    dx, dy = (max_lon - min_lon) / nx, (max_lat - min_lat) / ny
    return [(min_lon + i * dx, min_lat + j * dy, min_lon + (i + 1) * dx, min_lat + (j + 1) * dy) for j in range(ny) for i in range(nx)]


def windows(spark: SparkSession, end: str, history_days: int, chunk_days: int) -> DataFrame:
    """(start, days): chunks of history, oldest first; the last may be shorter."""
    starts = F.expr(f"explode(sequence(0, {history_days - 1}, {chunk_days}))")
    return spark.range(1).select(starts.alias("o")).select(
        F.expr(f"date_add(date'{end}', o - {history_days})").alias("start"), F.least(F.lit(chunk_days), F.lit(history_days) - F.col("o")).alias("days")
    )


def split_boxes(boxes: DataFrame, span: float = 10.0) -> DataFrame:
    """split_bbox() over rows (min_lon, min_lat, max_lon, max_lat, other columns): a row a tile."""
    parts = lambda low, high: F.greatest(F.lit(1), F.ceil((F.col(high) - F.col(low)) / span)).cast("int")
    sized = boxes.withColumn("_nx", parts("min_lon", "max_lon")).withColumn("_ny", parts("min_lat", "max_lat"))
    tiles = sized.withColumn("_i", F.explode(F.expr("sequence(0, _nx - 1)"))).withColumn("_j", F.explode(F.expr("sequence(0, _ny - 1)")))
    dx, dy = (F.col("max_lon") - F.col("min_lon")) / F.col("_nx"), (F.col("max_lat") - F.col("min_lat")) / F.col("_ny")
    box = {"min_lon": F.col("min_lon") + F.col("_i") * dx, "min_lat": F.col("min_lat") + F.col("_j") * dy, "max_lon": F.col("min_lon") + (F.col("_i") + 1) * dx, "max_lat": F.col("min_lat") + (F.col("_j") + 1) * dy}
    return tiles.select(*(c for c in boxes.columns if c not in box), *(x.alias(c) for c, x in box.items()))


def history_windows(histories: DataFrame, chunk_days: int) -> DataFrame:
    """windows() over rows (end date, history_days, other columns): start and days of every chunk; no days, no chunks."""
    days = F.col("history_days").cast("int")
    offsets = F.when(days > 0, F.sequence(F.lit(0), days - 1, F.lit(chunk_days)))
    return histories.withColumn("_o", F.explode(offsets)).withColumn("start", F.date_add("end", F.col("_o") - days)).withColumn("days", F.least(F.lit(chunk_days), days - F.col("_o"))).drop("_o")


_WARNING = (
    "struct<product:struct<warning_type:string,version_cdp:string,version_vigilance:string,update_time:string,domain_id:string,"
    "periods:array<struct<echeance:string,begin_validity_time:string,end_validity_time:string,timelaps:struct<domain_ids:array<struct<domain_id:string,"
    "phenomenon_items:array<struct<phenomenon_id:string,phenomenon_max_color_id:string>>>>>>>>,meta:struct<snapshot_id:string>>"
)


def parse_warnings(bulletins: DataFrame, body: str = "body") -> DataFrame:
    """One row for each period, domain and phenomenon of warning-map JSON bodies, with `reject`.

    reject is null for usable levels. A period of unknown name or without a valid duration
    is one rejected row; so is a domain without a name or an unreadable phenomenon.
    """
    doc = bulletins.select("*", F.from_json(body, _WARNING).alias("d")).filter("d.product.warning_type = 'vigilance'")
    head = doc.select(
        F.col("d.product.domain_id").alias("bulletin_domain"), F.try_to_timestamp("d.product.update_time").alias("published_at"), F.col("d.meta.snapshot_id").alias("snapshot_id"),
        F.explode("d.product.periods").alias("p"),
    )
    begin, end = F.try_to_timestamp("p.begin_validity_time"), F.try_to_timestamp("p.end_validity_time")
    bad = (
        F.when(~F.coalesce(F.col("p.echeance").isin("J", "J1"), F.lit(False)), "unknown period")
        .when(begin.isNull() | end.isNull(), "period without validity")
        .when(end <= begin, "period without duration")
    )
    periods = head.withColumn("begin_at", begin).withColumn("end_at", end).withColumn("bad", bad)
    domains = periods.select("*", F.explode_outer(F.when(F.col("bad").isNull(), F.col("p.timelaps.domain_ids"))).alias("dom"))
    domains = domains.withColumn("bad", F.coalesce("bad", F.when(F.coalesce(F.col("dom.domain_id"), F.lit("")) == "", "domain without a name")))
    items = domains.select("*", F.explode_outer(F.when(F.col("bad").isNull(), F.col("dom.phenomenon_items"))).alias("item")).filter("bad is not null or item is not null")
    phenomenon, colour_id = F.col("item.phenomenon_id").try_cast("int"), F.col("item.phenomenon_max_color_id").try_cast("int")
    colour = parsing.colour_name(colour_id)
    reject = F.coalesce("bad", F.when(phenomenon.isNull() | colour_id.isNull(), "unreadable phenomenon").when(colour.isNull(), "unknown colour"))
    return items.select(
        "bulletin_domain", "published_at", "snapshot_id", F.col("p.echeance").alias("echeance"), F.col("dom.domain_id").alias("domain_id"), parsing.department_of_domain(F.col("dom.domain_id")).alias("x"),
        phenomenon.alias("phenomenon_id"), colour.alias("colour"), "begin_at", "end_at", reject.alias("reject"),
    ).select("*", "x.department", "x.is_coastal").drop("x")


def latest_bulletin(listing: DataFrame, tree: str = "tree", wanted: str = "CDP_CARTE_EXTERNE.json", lookback: int = 20) -> DataFrame:
    """(year, month, day, stamp) of the newest of the last `lookback` releases that holds the wanted file."""
    nested = listing.select(F.from_json(tree, "map<string,map<string,map<string,map<string,array<string>>>>>").alias("t"))
    y = nested.select(F.explode("t").alias("year", "m")).select("year", F.explode("m").alias("month", "d")).select("year", "month", F.explode("d").alias("day", "s"))
    flat = y.select("year", "month", "day", F.explode("s").alias("stamp", "files"))
    order = [F.desc(c) for c in ("year", "month", "day", "stamp")]
    return flat.orderBy(*order).limit(lookback).filter(F.array_contains("files", wanted)).orderBy(*order).limit(1).drop("files")


_FEATURE = "struct<features:array<struct<properties:struct<code:string,nom:string,codeDepartement:string,codesPostaux:array<string>,surface:double,centre:struct<coordinates:array<double>>>,geometry:struct<type:string,coordinates:string>>>>"


def parse_features(collections: DataFrame, body: str = "body") -> DataFrame:
    """Municipalities of GeoJSON feature collections, with `rejects`.

    Codes are validated, the department falls back on the first two characters, hectares
    become km² (null unless positive), a centre out of bounds is null, and rings are parsed
    to array<polygon<ring<struct<lon,lat>>>>.
    """
    f = collections.select(F.explode(F.from_json(body, _FEATURE)["features"]).alias("f")).select("f.*")
    p = F.col("properties")
    code = F.trim(p["code"])
    department = F.coalesce(F.when(F.trim(p["codeDepartement"]) != "", F.trim(p["codeDepartement"])), F.substring(code, 1, 2))
    lon, lat = F.get(p["centre"]["coordinates"], F.lit(0)), F.get(p["centre"]["coordinates"], F.lit(1))
    valid = lon.between(-180, 180) & lat.between(-90, 90)
    polygon = F.array(F.from_json(F.col("geometry.coordinates"), "array<array<array<double>>>"))
    multi = F.from_json(F.col("geometry.coordinates"), "array<array<array<array<double>>>>")
    rings = F.transform(
        F.when(F.col("geometry.type") == "Polygon", polygon).when(F.col("geometry.type") == "MultiPolygon", multi),
        lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat")))),
    )
    rejects = F.array_compact(
        F.array(
            F.when(~F.coalesce(code.rlike("^([0-9]{2}|2[AB])[0-9]{3}$"), F.lit(False)), "code"), F.when(F.coalesce(F.trim(p["nom"]), F.lit("")) == "", "name"),
            F.when(~F.coalesce(department.rlike("^([0-9]{2,3}|2[AB])$"), F.lit(False)), "department"), F.when(rings.isNull(), "geometry"),
        )
    )
    return f.select(
        code.alias("insee_code"), p["nom"].alias("name"), department.alias("department_code"), F.coalesce(p["codesPostaux"], F.array().cast("array<string>")).alias("postal_codes"),
        F.when(valid, lon).alias("longitude"), F.when(valid, lat).alias("latitude"), F.when(p["surface"] > 0, p["surface"] / 100).alias("area_km2"), rings.alias("polygons"), rejects.alias("rejects"),
    )
