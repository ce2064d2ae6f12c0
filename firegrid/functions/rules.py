"""Domain rules as Column expressions. `now` is always a parameter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ClusteringParams:
    """Parameters of the attachment rule; the defaults are the published ones."""

    version: str = "grouping-v1"
    base_radius_m: float = 2500.0
    growth_m_per_hour: float = 500.0
    max_radius_m: float = 12000.0
    attach_window_hours: float = 24.0
    min_score: float = 0.35

    def __post_init__(self):
        if not 0 < self.base_radius_m <= self.max_radius_m:
            raise ValueError("radii must satisfy 0 < base <= max")
        if self.attach_window_hours <= 0 or not 0 < self.min_score <= 1:
            raise ValueError("window must be positive and min_score in (0, 1]")


REFERENCE = ClusteringParams()


def half_up(x: Column, digits: int) -> Column:
    """Round half up on the double itself, the same in every engine."""
    return F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def spatial_window_m(hours: Column, params: ClusteringParams = REFERENCE) -> Column:
    """Tolerated distance after `hours` of silence; null for negative hours."""
    return F.when(hours >= 0, F.least(params.base_radius_m + params.growth_m_per_hour * hours, F.lit(params.max_radius_m)))


def attachment_score(distance_m: Column, hours: Column, params: ClusteringParams = REFERENCE) -> Column:
    window = spatial_window_m(hours, params)
    near = (distance_m <= window) & (hours <= params.attach_window_hours)
    return F.when(near, half_up((1.0 - distance_m / window) * (1.0 - hours / params.attach_window_hours), 6)).otherwise(0.0)


def confidence_score(detections: Column, sensors: Column, mean_confidence: Column, known: Column, span_hours: Column) -> Column:
    """Weighted confidence of an event, lowered by its share of known static sources."""
    total = (
        0.40 * F.coalesce(mean_confidence, F.lit(0.5))
        + 0.25 * F.least(detections / 6.0, F.lit(1.0))
        + 0.20 * F.when(sensors >= 2, 1.0).otherwise(0.0)
        + 0.15 * F.least(span_hours / 6.0, F.lit(1.0))
    )
    penalty = F.when(known > 0, 1.0 - 0.6 * F.least(known / detections, F.lit(1.0))).otherwise(1.0)
    return F.when(detections > 0, half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total * penalty)), 4)).otherwise(0.0)


def confidence_level(score: Column) -> Column:
    """Level of an event."""
    return F.when(score >= 0.70, "high").when(score >= 0.45, "medium").otherwise("low")


def detection_level(score: Column) -> Column:
    """Public level of one detection; its cut-offs differ from an event's."""
    return F.when(score.isNull(), "unknown").when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def event_freshness(first: Column, last: Column, now: Column, hidden: Column) -> Column:
    since_last, since_first = hours_between(now, last), hours_between(now, first)
    return (
        F.when(F.coalesce(hidden, F.lit(False)), "hidden")
        .when(since_last >= 7 * 24, "archived")
        .when(since_first < 3, "new")
        .when(since_last < 24, "recent")
        .otherwise("not_recent")
    )


def source_freshness(last_data: Column, now: Column, stale_s: Column, expected_s: Column, unavailable: Column, maintenance: Column) -> Column:
    age = hours_between(now, last_data) * 3600
    return (
        F.when(maintenance, "maintenance")
        .when(unavailable | last_data.isNull(), "unavailable")
        .when(age >= stale_s, "stale")
        .when(age >= expected_s, "delayed")
        .otherwise("fresh")
    )


def source_status(status: Column, finished: Column, data_at: Column, now: Column, stale_s: Column, expected_s: Column) -> Column:
    """State of a source as its status page shows it."""
    stopped = status.isin("disabled", "paused")
    age = hours_between(now, F.coalesce(data_at, finished)) * 3600
    return (
        F.when(stopped & finished.isNull(), "upcoming")
        .when(stopped, "maintenance")
        .when(finished.isNull(), "unavailable")
        .when(age >= stale_s, "stale")
        .when(age >= expected_s, "delayed")
        .otherwise("fresh")
    )


def in_service(state: Column) -> Column:
    return ~state.isin("upcoming", "maintenance")


def is_stale_detection(acquired: Column, now: Column, hours: float = 6) -> Column:
    return hours_between(now, acquired) > hours


def is_future(acquired: Column, now: Column, hours: float = 1) -> Column:
    """Acquisitions later than an hour from now go to quarantine."""
    return hours_between(acquired, now) > hours


def snapshot_is_stale(generated: Column, now: Column, freshness: Column, minutes: int = 60) -> Column:
    return freshness.isin("new", "recent") & (hours_between(now, generated) * 60 >= minutes)


def age_ms(data_at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), ((F.unix_micros(now.cast("timestamp")) - F.unix_micros(data_at.cast("timestamp"))) / 1000).cast("long"))


def age_text(ms: Column) -> Column:
    """A data age in French."""
    minutes = F.floor(ms / 60000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    with_rest = lambda n, unit, rest, small: F.when(rest == 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(F.concat(n.cast("string"), F.lit(unit + " "), rest.cast("string"), F.lit(small)))
    return (
        F.when(minutes < 1, "moins d'une minute")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .when(hours < 24, with_rest(hours, " h", minutes % 60, " min"))
        .otherwise(with_rest(days, " j", hours % 24, " h"))
    )


def age_bucket(hours: Column) -> Column:
    return F.when(hours < 3, "new").when(hours < 12, "recent").when(hours < 24, "notRecent").otherwise("archived")


def ramp(x: Column, stops: list[tuple[float, float]]) -> Column:
    """Piecewise linear interpolation, constant outside the stops."""
    out = F.lit(float(stops[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(stops, stops[1:], strict=False))):
        out = F.when(x < x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(out)
    return F.when(x <= stops[0][0], float(stops[0][1])).otherwise(out)


#: Fixed values of the map style.
MARKER_RADIUS = [(1, 5), (10, 9), (50, 14), (500, 20)]
DEPARTMENT_FILL = [(0, 0.0), (1, 0.16), (10, 0.34), (50, 0.5)]
#: (min zoom, max zoom, tier)
ZOOM_TIERS = [(0, 6, "departments"), (7, 9, "departments+events"), (10, 12, "events+municipalities+smoke"), (13, 22, "events+municipalities+smoke+detections")]


def zoom_tier(zoom: Column) -> Column:
    z = F.least(F.greatest(zoom, F.lit(0)), F.lit(22))
    out = F.lit(ZOOM_TIERS[-1][2])
    for _, high, tier in reversed(ZOOM_TIERS[:-1]):
        out = F.when(z <= high, tier).otherwise(out)
    return out


#: Verification levels in order, those a job may set, control statuses, roles.
VERIFICATION_RANK = {"satellite_detection": 0, "probable_event": 1, "publicly_reported": 2, "officially_confirmed": 3}
JOB_LEVELS = ("satellite_detection", "probable_event")
CONTROL_STATUSES = ("active", "contained", "controlled", "extinguished")
OFFICIAL_ROLES = ("data_admin", "super_admin")


def status_change(actor_type, actor_id, role, verification, new_verification, control, new_control, changes_control, source_id, status_at, reason) -> Column:
    """struct(allowed, violations, is_regression, requires_audit) of a requested status change.

    A null `new_verification` keeps the level; `changes_control` says whether the request
    names a control status (which may be null). source_id and status_at are the resulting
    ones.
    """
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    rank = F.create_map(*(F.lit(x) for kv in VERIFICATION_RANK.items() for x in kv))
    moved = F.coalesce(new_verification != verification, F.lit(False))
    recontrolled = changes_control & ~new_control.eqNullSafe(control)
    human_level = F.coalesce(~new_verification.isin(*JOB_LEVELS), F.lit(False))
    final_level = F.coalesce(new_verification, verification)
    final_control = F.when(changes_control, new_control).otherwise(control)
    official = recontrolled | (moved & human_level)
    admin, job = actor_type == "admin", actor_type == "job"
    attributed = (final_level == "officially_confirmed") | final_control.isNotNull()
    checks = [
        (new_verification.isNotNull() & ~new_verification.isin(*VERIFICATION_RANK), "UNKNOWN_VALUE"),
        (changes_control & new_control.isNotNull() & ~new_control.isin(*CONTROL_STATUSES), "UNKNOWN_VALUE"),
        (job & moved & human_level, "JOB_CANNOT_SET_VERIFICATION"),
        (job & recontrolled, "JOB_CANNOT_SET_OFFICIAL_STATUS"),
        (admin & official & (actor_id.isNull() | (actor_id == "")), "MISSING_ACTOR_IDENTITY"),
        (admin & official & ~F.coalesce(role.isin(*OFFICIAL_ROLES), F.lit(False)), "INSUFFICIENT_ROLE"),
        ((moved | recontrolled) & blank(reason), "MISSING_REASON"),
        (attributed & blank(source_id), "MISSING_OFFICIAL_SOURCE"),
        (attributed & blank(status_at), "MISSING_OFFICIAL_TIMESTAMP"),
        (final_control.isNotNull() & (final_level != "officially_confirmed"), "OFFICIAL_STATUS_REQUIRES_CONFIRMATION"),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.lit(code)) for c, code in checks)))
    return F.struct(
        (F.size(found) == 0).alias("allowed"), found.alias("violations"),
        F.coalesce(moved & (F.coalesce(F.try_element_at(rank, new_verification), F.lit(-1)) < F.coalesce(F.try_element_at(rank, verification), F.lit(-1))), F.lit(False)).alias("is_regression"),
        (moved | recontrolled).alias("requires_audit"),
    )


def contradicts_official(control: Column) -> Column:
    return F.coalesce(control.isin("extinguished", "controlled"), F.lit(False))
