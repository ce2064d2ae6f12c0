"""Upkeep of derived tables: stale snapshots, orphans, coverage, fallbacks, guards, staged loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.operators.spatial import point_in_polygon
from firegrid.sources.sinks import DETECTION_KEY, new_rows


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, half to even; 0 of nothing."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0)).otherwise(F.bround(100.0 * F.coalesce(part, F.lit(0)) / whole, 0)).cast("long")


def stale_snapshots(events: DataFrame, snapshots: DataFrame, now: Column, minutes: int | None = None) -> DataFrame:
    """Visible events to refresh: all, or those whose snapshot is missing or older than `minutes`."""
    visible = events.filter("freshness <> 'hidden'")
    if minutes is None:
        return visible.select("event_key", "last_detected_at")
    age = now.cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    joined = visible.join(snapshots.select("event_key", "generated_at"), "event_key", "left")
    return joined.filter(F.col("generated_at").isNull() | (F.col("generated_at") < age)).select("event_key", "last_detected_at")


def without_orphans(detections: DataFrame, members: DataFrame) -> DataFrame:
    """Detections that some event holds; the others are dropped when a corpus is replaced."""
    return detections.join(members.select("id", "acquired_at").distinct(), ["id", "acquired_at"], "left_semi")


def registry_coverage(static: DataFrame, candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: type-2 detections, candidate zones, retained sources, detections they cover, and percent to one place.

    candidates and kept hold detection_count, one row a zone.
    """
    total = static.agg(F.count("*").alias("detections"))
    zones = candidates.agg(F.count("*").alias("candidates"))
    held = kept.agg(F.count("*").alias("retained"), F.coalesce(F.sum("detection_count"), F.lit(0)).alias("covered"))
    # Three single rows.
    one = F.lit(1)
    joined = total.withColumn("_k", one).join(zones.withColumn("_k", one), "_k").join(held.withColumn("_k", one), "_k").drop("_k")
    return joined.withColumn("percent", F.when(F.col("detections") > 0, F.bround(100.0 * F.col("covered") / F.col("detections"), 1)).otherwise(0.0))


def assign_department(points: DataFrame, areas: DataFrame, nearest_code: str) -> DataFrame:
    """points with `department`: of the area that holds them, else the first two characters of the nearest municipality's code."""
    placed = point_in_polygon(points, areas)
    return placed.withColumn("department", F.coalesce("code", F.upper(F.substring(nearest_code, 1, 2)))).drop("code")


def attach_parents(units: DataFrame, parents: DataFrame) -> DataFrame:
    """units (…, region_code, parent_code) with parent_code filled from parents (code) where it is null."""
    known = parents.select(F.col("code").alias("region_code"), F.col("code").alias("_parent"))
    return units.join(known, "region_code", "left").withColumn("parent_code", F.coalesce("parent_code", "_parent")).drop("_parent")


def require_members(events: DataFrame, members: DataFrame, key: str = "event_key") -> DataFrame:
    """events as they are; computing them fails if an event has no member."""
    held = members.select(F.col(key), F.lit(True).alias("_held")).distinct()
    checked = events.join(held, key, "left")
    message = F.concat(F.lit("event without detections: "), F.col(key).cast("string"))
    return checked.filter(F.coalesce(F.col("_held"), F.raise_error(message).cast("boolean"))).drop("_held")


def require_rows(report: DataFrame, name: str = "stratum", number: str = "n", besides: tuple = ("overlap",)) -> DataFrame:
    """A report as it is; computing it fails if an entry other than `besides` counts nothing."""
    empty = (F.col(number) == 0) & ~F.col(name).isin(*besides)
    return report.withColumn(number, F.when(empty, F.raise_error(F.concat(F.lit("empty: "), F.col(name))).cast("long")).otherwise(F.col(number)))


def staged_load(staged: DataFrame, stored: DataFrame | None, key: list[str] = DETECTION_KEY) -> tuple[DataFrame, DataFrame]:
    """(rows to append, counters): a staged batch against what is stored, in one anti-join.

    Staged rows carry `rejects`. The counters are one row: staged, rejected, inserted, already_known.
    """
    ok = staged.filter("size(rejects) = 0").drop("rejects")
    fresh = new_rows(ok, stored, key)
    counted = staged.agg(F.count("*").alias("staged"), F.count_if(F.size("rejects") > 0).alias("rejected"))
    inserted = fresh.agg(F.count("*").alias("inserted"))
    one = F.lit(1)
    counters = counted.withColumn("_k", one).join(inserted.withColumn("_k", one), "_k").drop("_k")
    return fresh, counters.withColumn("already_known", F.col("staged") - F.col("rejected") - F.col("inserted"))
