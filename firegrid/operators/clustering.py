"""Deterministic attach-or-create clustering of detections into events, in parallel.

The rule is sequential: in order of (acquired_at, provider_key) a detection joins the event
with the best score, or founds one. Only scores of min_score or more decide, so an event can
only win a detection closer than `reach_m` to one of its members and no more than `reach_h`
after its last one. Space-time components that are closed under both bounds are therefore
independent, and the result is the same as over the whole table.

Components are dealt over tasks and read in order of time, so a task holds a batch of rows
and the events that are still open, never a component. Components of over LARGE_ROWS rows
are replayed in slices of time, round by round: a slice falls into components of its own,
and only the open events near it go with it (operators/event_state.py).
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from firegrid.functions.geo import chord_of, convex_hull, diameter, geodesic_pair_m, unit_vector
from firegrid.functions.rules import REFERENCE, ClusteringParams, confidence_level, confidence_score, half_up
from firegrid.operators.graph import components_of, shared_checkpoint

SLACK_M, SLACK_H = 1.0, 0.001
#: Inputs and groups up to this size are not cut further: one task handles them in seconds.
GROUP_ROWS = 50_000
#: Components beyond this are replayed in slices of about so many rows.
LARGE_ROWS = 2_000_000
#: Rows that a task of a sweep takes, counted once a set.
TASK_ROWS = 400_000
#: Half of a cube's 26 neighbours; the others are seen from the other side.
_HALF = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) > (0, 0, 0)]
#: A cube and its neighbours, itself first.
_ALL = sorted(((x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)), key=any)
_NONE: dict = {}


@lru_cache(maxsize=1024)
def reach(params: ClusteringParams) -> tuple[float, float]:
    """(metres, hours) beyond which no event can win a detection."""
    low, window = params.min_score - 1e-6, params.attach_window_hours
    hours = (1 - low) * window
    h = np.linspace(0, hours, 20001)
    radius = np.minimum(params.base_radius_m + params.growth_m_per_hour * h, params.max_radius_m) * (1 - low / (1 - h / window))
    step = hours / 20000
    # Between grid points the radius grows by no more than the window does.
    return float(radius.max() + params.growth_m_per_hour * step) + SLACK_M, float(hours) + SLACK_H


def closed_components(detections: DataFrame, reach_m: float, reach_h: float, rounds: int = 2) -> DataFrame:
    return closed_and_sizes(detections, reach_m, reach_h, rounds)[0]


def closed_and_sizes(detections: DataFrame, reach_m: float, reach_h: float, rounds: int = 2) -> tuple[DataFrame, DataFrame | None]:
    """(detections with `component`, (component, n) or None for one small group): groups that no attachment can cross.

    Cubes of the size of the reach on the unit sphere are joined with their neighbours; each
    component is then cut where it is silent for longer than the reach, and the pieces are
    joined again by cubes of their own. Any number of rounds is exact; more make smaller
    groups, and they end once all groups are small. A small input is one group. All this is
    told of cubes and stretches of time; the rows are read for them once, and once joined.
    """
    if detections.limit(GROUP_ROWS + 1).count() <= GROUP_ROWS:
        whole = detections.withColumn("component", F.lit(""))
        return whole, None if GROUP_ROWS <= LARGE_ROWS else whole.groupBy("component").agg(F.count("*").alias("n"))
    size, width = chord_of(reach_m), int(reach_h * 3.6e9)
    place, micros = unit_vector(F.col("longitude"), F.col("latitude")), F.unix_micros("acquired_at")
    cube, at = ["_x", "_y", "_z"], ["_x", "_y", "_z", "_bucket"]
    # A zone is cut where it is silent for longer than the reach. Within a bucket of that length it is not, so the
    # earliest and latest rows of its buckets tell.
    placed = detections.withColumns({c: F.floor(v / size) for c, v in zip(cube, place, strict=True)}).withColumn("_bucket", F.expr(f"floor(unix_micros(acquired_at) / {width})"))
    cells = shared_checkpoint(placed.groupBy(*at).agg(F.count("*").alias("rows"), F.min(micros).alias("low"), F.max(micros).alias("high")).withColumn("component", F.lit("")))
    for _ in range(rounds):
        cell = F.struct("component", *cube)
        own = shared_checkpoint(cells.select(cell.alias("node")).distinct())
        beside = lambda d: F.struct(F.col("node.component").alias("component"), *((F.col(f"node.{c}") + k).alias(c) for c, k in zip(cube, d, strict=True)))
        near = own.select(F.col("node").alias("u"), F.explode(F.array(*map(beside, _HALF))).alias("v"))
        links = near.join(own.select(F.col("node").alias("v")), "v").select("u", "v")
        named = components_of(links)
        zone = own.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("zone"))
        zoned = shared_checkpoint(cells.withColumn("node", cell).join(zone, "node").drop("node", "component"))
        spans = zoned.groupBy("zone", "_bucket").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        order = Window.partitionBy("zone").orderBy("_bucket")
        cut = spans.withColumn("_new", F.when(F.col("low") - F.lag("high").over(order) > reach_h * 3.6e9, 1).otherwise(0))
        pieces = cut.select("zone", "_bucket", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_piece"))
        name = F.sha2(F.concat_ws("|", "zone.component", "zone._x", "zone._y", "zone._z", "_piece"), 256)
        cells = shared_checkpoint(zoned.join(pieces, ["zone", "_bucket"]).withColumn("component", name).drop("zone", "_piece"))
        sizes = cells.groupBy("component").agg(F.sum("rows").alias("n"))
        if sizes.filter(F.col("n") > GROUP_ROWS).isEmpty():
            break
    named = placed.join(cells.select(*at, "component"), at, "left").drop(*at)
    return named.withColumn("component", F.when(F.col("component").isNull(), F.raise_error(F.lit("a detection has no coordinate or instant"))).otherwise(F.col("component"))), sizes


def founder_id(provider_key: str) -> str:
    return hashlib.sha256(f"event|{provider_key}".encode()).hexdigest()


#: Two ways of equal chord on the unit sphere differ by no more than this factor in metres (greatest over smallest radius of curvature).
_STRETCH = 1.0102
#: So many places are compared one by one, more of them as arrays; of more than so many the box is looked at first.
_FEW, _BOXED = 24, 4


class _Places:
    """The places of one event in one cube, without repeats: a list, and as arrays once there are many."""

    def __init__(self):
        self.seen: dict[tuple, None] = {}
        self.rows: list[tuple] = []  # unit vector, longitude, latitude
        self.xyz, self.filled = np.empty((0, 3)), 0
        self.low, self.high = [math.inf] * 3, [-math.inf] * 3

    def add(self, vector: tuple, lon: float, lat: float) -> bool:
        if (lon, lat) in self.seen:
            return False
        self.seen[lon, lat] = None
        self.rows.append((*vector, lon, lat))
        for k, c in enumerate(vector):
            if c < self.low[k]:
                self.low[k] = c
            if c > self.high[k]:
                self.high[k] = c
        return True

    def beyond(self, x: float, y: float, z: float, square: float) -> bool:
        """Whether the box around all places is further off than a squared chord."""
        (ax, ay, az), (bx, by, bz) = self.low, self.high
        dx = ax - x if x < ax else x - bx if x > bx else 0.0
        dy = ay - y if y < ay else y - by if y > by else 0.0
        dz = az - z if z < az else z - bz if z > bz else 0.0
        return dx * dx + dy * dy + dz * dz > square

    def squares(self, x: float, y: float, z: float) -> np.ndarray | list[float]:
        """Squared chords to all places."""
        n = len(self.rows)
        if n <= _FEW:
            return [(r[0] - x) ** 2 + (r[1] - y) ** 2 + (r[2] - z) ** 2 for r in self.rows]
        if n > len(self.xyz):
            self.xyz = np.vstack([self.xyz[: self.filled], np.empty((2 * n - self.filled, 3))])
        if self.filled < n:
            self.xyz[self.filled : n] = [r[:3] for r in self.rows[self.filled :]]
            self.filled = n
        apart = self.xyz[:n] - (x, y, z)
        return np.einsum("ij,ij->i", apart, apart)


class Replay:
    """The sequential rule over one stream of detections in order, holding the open events only.

    Places of members are kept once an event, in cubes of the reach's size on the unit sphere; `near` remembers the
    cubes around those that were asked for. A place that an event holds already is at no distance from it. Of the other
    places only those that may be the nearest by their chord are measured on the ellipsoid. Events that have been silent for longer than the reach can win nothing more; they are forgotten once
    they hold half of the places.
    """

    def __init__(self, params: ClusteringParams):
        self.params, (self.reach_m, reach_h) = params, reach(params)
        self.silence, self.size = int(reach_h * 3.6e9), chord_of(self.reach_m)
        self.limit = self.size * self.size
        self.ids: dict[int, str] = {}
        self.last: dict[int, int] = {}
        self.birth: dict[int, tuple] = {}  # instant and key of the founder: events are ordered by it where distances tie
        self.slot_of: dict[str, int] = {}
        self.cubes: dict[tuple, dict[int, _Places]] = {}  # the places in each, by the event's slot
        self.near: dict[tuple, list[dict[int, _Places]]] = {}
        self.places = self.next = self.checked = 0

    def know(self, event_id: str, lon: float, lat: float, micros: int, birth: tuple) -> None:
        """Add a member of an event; of the births that are given for an event the first counts."""
        vector = place_vector(lon, lat)
        self._add(event_id, lon, lat, micros, birth, vector, self._cube(vector))

    def _cube(self, vector: tuple) -> tuple:
        size, (x, y, z) = self.size, vector
        return math.floor(x / size), math.floor(y / size), math.floor(z / size)

    def _add(self, event_id: str, lon: float, lat: float, micros: int, birth: tuple, vector: tuple, at: tuple) -> None:
        slot = self.slot_of.get(event_id)
        if slot is None:
            slot = self.slot_of[event_id] = self.next
            self.next += 1
            self.ids[slot], self.last[slot], self.birth[slot] = event_id, micros, birth
        else:
            self.last[slot], self.birth[slot] = max(self.last[slot], micros), min(self.birth[slot], birth)
        cube = self.cubes.get(at)
        if cube is None:
            cube = self.cubes[at] = {}
            for di, dj, dk in _ALL:
                around = self.near.get((at[0] + di, at[1] + dj, at[2] + dk))
                if around is not None:
                    around.insert(len(around) if di or dj or dk else 0, cube)
        places = cube.get(slot)
        if places is None:
            places = cube[slot] = _Places()
        self.places += places.add(vector, lon, lat)

    def _around(self, at: tuple) -> list[dict[int, _Places]]:
        found = self.near.get(at)
        if found is None:
            i, j, k = at
            found = self.near[at] = [c for d in _ALL if (c := self.cubes.get((i + d[0], j + d[1], k + d[2]))) is not None]
        return found

    def _nearest(self, held: list[_Places], x: float, y: float, z: float, lon: float, lat: float, most: float) -> float:
        """Distance to the nearest of an event's places by cube, or infinity if all are beyond a squared chord."""
        found, place = [], (lon, lat)
        for places in held:
            if place in places.seen:
                return 0.0
            if len(places.rows) > _BOXED and places.beyond(x, y, z, most * (1 + 1e-9)):
                continue
            squares = places.squares(x, y, z)
            low = min(squares) if isinstance(squares, list) else float(squares.min())
            if low <= most:
                most = min(most, low * _STRETCH**2 + 1e-24)
                found.append((places, squares, low))
        d = math.inf
        for places, squares, low in found:
            if low <= most:
                for n in [n for n, q in enumerate(squares) if q <= most] if isinstance(squares, list) else (squares <= most).nonzero()[0].tolist():
                    d = min(d, geodesic_pair_m(lon, lat, *places.rows[n][3:]))
        return d

    def attach(self, lon: float, lat: float, micros: int, key: str, vector: tuple | None = None) -> tuple[str, float]:
        """(event, score) of the next detection, which may found the event.

        Events are asked in order of their last instants, as that alone bounds their scores, and no further than a place
        may lie that gives more than the best score so far.
        """
        x, y, z = vector = vector or place_vector(lon, lat)
        at, last, silence, params = self._cube(vector), self.last, self.silence, self.params
        held: dict[int, list[_Places]] = {}
        for cube in self._around(at):
            for slot, places in cube.items():
                if slot in held:
                    held[slot].append(places)
                elif 0 <= micros - last[slot] <= silence:
                    held[slot] = [places]
        best, score, closest = None, 0.0, math.inf
        for slot in held if len(held) < 2 else sorted(held, key=last.__getitem__, reverse=True):
            hours = (micros - last[slot]) / 3.6e9
            fresh, need = 1 - hours / params.attach_window_hours, max(score, params.min_score) - 1e-6
            if fresh < need:
                break
            radius = min(params.base_radius_m + params.growth_m_per_hour * hours, params.max_radius_m)
            within = chord_of(radius * (1 - need / fresh) + 0.001) if need > 0 else self.size
            d = self._nearest(held[slot], x, y, z, lon, lat, min(self.limit, within * within))
            won = round((1 - d / radius) * fresh, 6) if d <= radius and hours <= params.attach_window_hours else 0.0
            if won > score or won == score > 0 and (d, self.birth[slot]) < (closest, self.birth[best]):
                best, score, closest = slot, won, d
        if best is None or score < params.min_score:
            event, score = founder_id(key), 1.0
        else:
            event = self.ids[best]
        self._add(event, lon, lat, micros, (micros, key), vector, at)
        if self.places > 2 * self.checked + 10_000:
            self.forget(micros)
        return event, score

    def forget(self, micros: int) -> None:
        """Drop the events that nothing at `micros` or later can join."""
        closed = {s for s, at in self.last.items() if micros - at > self.silence}
        self.cubes = {c: left for c, x in self.cubes.items() if (left := {s: p for s, p in x.items() if s not in closed})}
        self.near = {}
        for s in closed:
            del self.slot_of[self.ids.pop(s)], self.last[s], self.birth[s]
        self.places = self.checked = sum(len(p.rows) for x in self.cubes.values() for p in x.values())


def place_vector(lon: float, lat: float) -> tuple[float, float, float]:
    """A place on the unit sphere."""
    lam, phi = math.radians(lon), math.radians(lat)
    across = math.cos(phi)
    return across * math.cos(lam), across * math.sin(lam), math.sin(phi)


def attach(lon, lat, micros, keys, owner_ids, params: ClusteringParams) -> tuple[list[str], list[float]]:
    """The rule over arrays sorted by (instant, key): the event and score of every row.

    owner_ids holds the event of members that are attached already, else None; members keep
    theirs with a score of NaN.
    """
    replay = Replay(params)
    rows = [*zip(np.asarray(lon).tolist(), np.asarray(lat).tolist(), np.asarray(micros).tolist(), keys, owner_ids, strict=True)]
    for x, y, at, key, known in rows:
        if known is not None:
            replay.know(known, x, y, at, (at, key))
    found = [(known, float("nan")) if known is not None else replay.attach(x, y, at, key) for x, y, at, key, known in rows]
    return [e for e, _ in found], [s for _, s in found]


_MEMBERS = "id string, provider_key string, acquired_at timestamp, longitude double, latitude double, event_id string, score double, is_new boolean, version string"


def _kernel(by_version: dict[str, ClusteringParams]):
    """Rows come by group: first its members, then the pending rows in order."""

    def run(batches):
        group, replay = None, None
        for batch in batches:
            names = ("version", "component", "provider_key", "micros", "longitude", "latitude", "event_id", "born", "founder")
            events, scores = [], []
            for version, component, key, micros, lon, lat, known, born, founder in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if group != (version, component):
                    group, replay = (version, component), Replay(by_version[version])
                if known is not None:
                    replay.know(known, lon, lat, micros, (born, founder))
                    events.append(known)
                    scores.append(float("nan"))
                else:
                    event, score = replay.attach(lon, lat, micros, key)
                    events.append(event)
                    scores.append(score)
            new = [x is None for x in batch.column("event_id").to_pylist()]
            plain = [batch.column(c) for c in ("id", "provider_key", "acquired_at", "longitude", "latitude")]
            yield pa.RecordBatch.from_arrays([*plain, pa.array(events, pa.string()), pa.array(scores, pa.float64()), pa.array(new, pa.bool_()), batch.column("version")], [c.split()[0] for c in _MEMBERS.split(", ")])

    return run


def attach_closed(closed: DataFrame, sets: list[ClusteringParams]) -> DataFrame:
    """The rule under every parameter set over rows with `component` (event_id is null for pending rows), read as a stream by component."""
    by_version = {p.version: p for p in sets}
    if len(by_version) < len(sets):
        raise ValueError("parameter set versions repeat")
    rows = closed.withColumn("version", F.explode(F.array(*(F.lit(p.version) for p in sets)))).withColumn("micros", F.unix_micros("acquired_at"))
    rows = rows.withColumn("born", F.unix_micros("founded"))
    order = ["version", "component", F.col("event_id").isNull(), "acquired_at", "provider_key", "id"]
    return rows.repartition("version", "component").sortWithinPartitions(*order).mapInArrow(_kernel(by_version), _MEMBERS)


def rows_of(pending: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Pending rows and members with the columns of the rule; event_id is null for pending rows.

    founded and founder, the instant and key of an event's first member, are a member's own where `members` has no such columns.
    """
    columns = ["id", "provider_key", F.col("acquired_at").cast("timestamp").alias("acquired_at"), "longitude", "latitude"]
    own = [F.col("acquired_at").cast("timestamp").alias("founded"), F.col("provider_key").alias("founder")]
    rows = pending.select(*columns, F.lit(None).cast("string").alias("event_id"), *own)
    if members is None:
        return rows
    return rows.unionByName(members.select(*columns, "event_id", *(["founded", "founder"] if "founder" in members.columns else own)))


def cluster(pending: DataFrame, members: DataFrame | None = None, params: ClusteringParams = REFERENCE) -> DataFrame:
    """Attach `pending` (id, provider_key, acquired_at, longitude, latitude) to the events of `members`.

    members has the same columns and event_id; only those within the reach in time of the
    pending rows need be given. Returns the members and the attached rows (is_new) with
    event_id and score. The result does not depend on partitioning; replaying chunks in
    order gives the events of one pass. Rows with a null coordinate or instant are no detections and are an error.
    """
    return sweep(pending, [params], members)


def sweep(pending: DataFrame, sets: list[ClusteringParams], members: DataFrame | None = None) -> DataFrame:
    """cluster() under many parameter sets in one job; `version` tells them apart."""
    from firegrid.operators.event_state import replay_slices

    bounds = [reach(p) for p in sets]
    closed, sizes = closed_and_sizes(rows_of(pending, members), max(b[0] for b in bounds), max(b[1] for b in bounds))
    large = None if sizes is None else shared_checkpoint(sizes.filter(F.col("n") > LARGE_ROWS).select("component"))
    if large is None or large.isEmpty():
        return attach_closed(closed, sets)
    sliced = [replay_slices(closed.join(large, "component", "left_semi"), p, LARGE_ROWS) for p in sets]
    out = attach_closed(closed.join(large, "component", "left_anti"), sets)
    for part in sliced:
        out = out.unionByName(part)
    return out


def event_aggregates(members: DataFrame, key: str = "event_key", known: str = "known_count_flag") -> DataFrame:
    """One row an event: counts, bounds, confidence, FRP range and median, centre, span, score and level."""
    base = members.groupBy(key).agg(
        F.count("*").alias("detection_count"), F.count_distinct("sensor").alias("sensor_count"), F.min("acquired_at").alias("first_detected_at"),
        F.max("acquired_at").alias("last_detected_at"), F.sum("confidence_pct").alias("_pct"), F.count("confidence_pct").alias("_n"),
        F.count_if(F.col(known)).alias("known_source_count"), F.min("frp_mw").alias("frp_min_mw"), F.expr("percentile(frp_mw, 0.5)").alias("frp_median_mw"),
        F.max("frp_mw").alias("frp_max_mw"), (F.sum("lon_e5") / (F.count("*") * 100000.0)).alias("longitude"), (F.sum("lat_e5") / (F.count("*") * 100000.0)).alias("latitude"),
        F.array_sort(F.collect_set("sensor")).alias("sensors"), F.array_sort(F.collect_set("satellite")).alias("satellites"),
    )
    span = (F.unix_micros("last_detected_at") - F.unix_micros("first_detected_at")) / F.lit(3.6e9)
    scored = base.withColumn("mean_confidence", F.when(F.col("_n") > 0, F.col("_pct") / (F.col("_n") * 100.0))).withColumn("span_hours", half_up(span, 3)).drop("_pct", "_n")
    scored = scored.withColumn(
        "confidence_score", confidence_score(F.col("detection_count"), F.col("sensor_count"), F.col("mean_confidence"), F.col("known_source_count"), F.col("span_hours"))
    )
    return scored.withColumn("confidence_level", confidence_level(F.col("confidence_score")))


class _Tally:
    """What is told of the open events of one parameter set."""

    def __init__(self, params: ClusteringParams):
        self.version, self.replay, self.events = params.version, Replay(params), {}
        self.checked = 0

    def take(self, place: tuple, micros: int, key: str, sensor: str | None, vector: tuple) -> None:
        event = self.events.get(own := self.replay.attach(*place, micros, key, vector)[0])
        if event is None:
            self.events[own] = [1, micros, micros, {sensor}, {place}, _HULL_PLACES]
            return
        event[0] += 1
        event[2] = micros
        event[3].add(sensor)
        event[4].add(place)
        if len(event[4]) >= event[5]:
            event[4] = {*map(tuple, convex_hull([*event[4]]).tolist())}
            event[5] = len(event[4]) + _HULL_PLACES

    def told(self, all_of_them: bool) -> list[tuple]:
        """Rows of all events, or, once some were forgotten, of those that are closed; they are dropped."""
        if not all_of_them and self.checked == self.replay.checked:
            return []
        self.checked, open_ = self.replay.checked, {} if all_of_them else self.replay.slot_of
        done = [(e, x) for e, x in self.events.items() if e not in open_]
        self.events = {e: x for e, x in self.events.items() if e in open_}
        hulls = [[*zip(*(x[4] if len(x[4]) < 3 else convex_hull([*x[4]]).tolist()), strict=True)] for _, x in done]
        return [(self.version, e, n, first, last, lon, lat, [*(sensors - {None})]) for (e, (n, first, last, sensors, *_)), (lon, lat) in zip(done, hulls, strict=True)]


_PARTS = "version string, event_id string, n long, first long, last long, lon array<double>, lat array<double>, sensors array<string>"
#: Places that an event gathers before they are reduced to their hull.
_HULL_PLACES = 4096


def _tally_kernel(sets: list[ClusteringParams]):
    """Rows come by group in order; a group without a version is read for all sets at once."""

    def run(batches):
        group, tallies = None, []
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.string())]
        part = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _PARTS.split(", ")])
        for batch in batches:
            done = []
            for version, component, key, micros, lon, lat, sensor in zip(*(batch.column(c).to_pylist() for c in ("version", "component", "provider_key", "micros", "longitude", "latitude", "sensor")), strict=True):
                if group != (version, component):
                    done += [row for t in tallies for row in t.told(True)]
                    group, tallies = (version, component), [_Tally(p) for p in sets if version is None or p.version == version]
                vector, place = place_vector(lon, lat), (lon, lat)
                for t in tallies:
                    t.take(place, micros, key, sensor, vector)
            done += [row for t in tallies for row in t.told(False)]
            if done:
                yield part(done)
        if done := [row for t in tallies for row in t.told(True)]:
            yield part(done)

    return run


def sweep_shapes(detections: DataFrame, sets: list[ClusteringParams]) -> DataFrame:
    """event_shapes() of sweep(detections, sets), detections with `sensor`, without its rows: events are told where they are found.

    The rows are shuffled once for all sets, as a group holds its events whole under each of them; groups of over
    GROUP_ROWS rows, and an input that is one group, are dealt by set too. Components of over LARGE_ROWS rows are
    replayed in slices, and their members shuffled.
    """
    from firegrid.operators.event_state import replay_slices

    if len({p.version for p in sets}) < len(sets):
        raise ValueError("parameter set versions repeat")
    bounds = [reach(p) for p in sets]
    if wrong := [p.version for p, b in zip(sets, bounds, strict=True) if not all(map(math.isfinite, b))]:
        raise ValueError(f"sets without a reach: {wrong}")  # told before any row is read
    rows = detections.select("id", "provider_key", F.col("acquired_at").cast("timestamp").alias("acquired_at"), "longitude", "latitude", "sensor")
    closed, sizes = closed_and_sizes(rows, max(b[0] for b in bounds), max(b[1] for b in bounds))
    each = F.array(*(F.lit(p.version) for p in sets))
    least, large = 2 * detections.sparkSession.sparkContext.defaultParallelism, None
    if sizes is None:
        dealt, tasks = closed.withColumn("version", F.explode(each)), least
    else:
        count, top = sizes.agg(F.sum("n"), F.max("n")).first()
        dealt, tasks = closed.withColumn("version", F.lit(None).cast("string")), max(least, count * len(sets) // TASK_ROWS)
        if top > (small := min(GROUP_ROWS, LARGE_ROWS)):  # there are few of them
            marked = closed.join(F.broadcast(shared_checkpoint(sizes.filter(F.col("n") > small))), "component", "left")
            large = marked.filter(F.col("n") > LARGE_ROWS) if top > LARGE_ROWS else None
            kept = marked if large is None else marked.filter(F.coalesce(F.col("n") <= LARGE_ROWS, F.lit(True)))
            dealt = kept.withColumn("version", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(None).cast("string"))).otherwise(each)))
    dealt = dealt.select("version", "component", F.unix_micros("acquired_at").alias("micros"), "provider_key", "id", "longitude", "latitude", "sensor")
    order = ["version", "component", "micros", "provider_key", "id"]
    parts = dealt.repartition(tasks, "version", "component").sortWithinPartitions(*order).mapInArrow(_tally_kernel(sets), _PARTS)
    parts = parts.withColumns({c: F.timestamp_micros(c) for c in ("first", "last")})
    if large is not None:
        whole = shared_checkpoint(rows_of(large.drop("n")).withColumn("component", F.lit("")))
        for p in sets:
            members = replay_slices(whole, p, LARGE_ROWS).select("id", "version", "event_id", "acquired_at", "longitude", "latitude")
            parts = parts.unionByName(_local_shapes(members.join(detections.select("id", "sensor"), "id")))
    return _merged_shapes(parts)


def event_shapes(members: DataFrame) -> DataFrame:
    """(version, event_id, n, first, last, diagonal_km): hulls are merged from the hulls of each batch's rows.

    Members with a `sensor` also give sensor_count, in the same pass. Every Arrow batch is reduced to one hull an event before anything is shuffled, so a large event never meets in one task whole.
    """

    return _merged_shapes(_local_shapes(members))


def _local_shapes(members: DataFrame) -> DataFrame:
    def local(batches):
        for pdf in batches:
            code, keys = pd.factorize(pd.MultiIndex.from_frame(pdf[["version", "event_id"]]))
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            places, at = pdf[["longitude", "latitude"]].to_numpy()[order], pdf["acquired_at"].to_numpy()[order]
            parts = np.split(places, starts[1:]) if len(pdf) else []
            hulls = [x if len(x) < 3 else convex_hull(x) for x in parts]
            yield pd.DataFrame({
                "version": [k[0] for k in keys], "event_id": [k[1] for k in keys], "n": [len(x) for x in parts], "first": np.minimum.reduceat(at, starts) if len(pdf) else at,
                "last": np.maximum.reduceat(at, starts) if len(pdf) else at, "lon": [h[:, 0].tolist() for h in hulls], "lat": [h[:, 1].tolist() for h in hulls],
                **({"sensors": [[*{*x} - {None}] for x in np.split(pdf["sensor"].to_numpy()[order], starts[1:])] if len(pdf) else []} if told else {}),
            })

    told = ["sensor"] if "sensor" in members.columns else []
    rows = members.select("version", "event_id", "acquired_at", "longitude", "latitude", *told)
    return rows.mapInPandas(local, "version string, event_id string, n long, first timestamp, last timestamp, lon array<double>, lat array<double>" + (", sensors array<string>" if told else ""))


def _merged_shapes(parts: DataFrame) -> DataFrame:
    told = "sensors" in parts.columns
    count = [F.size(F.array_distinct(F.flatten(F.collect_list("sensors")))).cast("long").alias("sensor_count")] if told else []

    def widest(lon: pd.Series, lat: pd.Series) -> pd.Series:
        return pd.Series([(diameter(convex_hull(np.column_stack([x, y]))) if len(x) > 2 else math.dist((x[0], y[0]), (x[-1], y[-1]))) * 111 for x, y in zip(lon, lat, strict=True)])

    diagonal = F.pandas_udf(widest, DoubleType())

    return parts.groupBy("version", "event_id").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.flatten(F.collect_list("lon")).alias("lon"), F.flatten(F.collect_list("lat")).alias("lat"), *count
    ).select("version", "event_id", "n", "first", "last", diagonal("lon", "lat").alias("diagonal_km"), *(["sensor_count"] if told else []))


def calibration_metrics(events: DataFrame) -> DataFrame:
    """One row a version from (version, n, sensor_count, span_hours, diagonal_km)."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = F.col("n")
    return events.groupBy("version").agg(
        F.count("*").alias("events"), zero(F.sum("n")).alias("detections"), F.count_if(n == 1).alias("singletons"),
        F.count_if(F.col("sensor_count") >= 2).alias("multi_sensor"), zero(F.max("n")).alias("largest"), zero(F.sum(F.when(n >= 5, n))).alias("in_events_of_5"),
        zero(half_up(F.max("diagonal_km"), 1)).alias("max_diagonal_km"), zero(half_up(F.percentile(F.when(n > 1, F.col("span_hours")), F.lit(0.5)), 1)).alias("median_span_h"),
    )


#: The calibration surface (fixed values).
RADII, WINDOWS, THRESHOLDS = (1000, 1500, 2000, 2500, 3000, 4000, 5000), (6, 12, 24, 48), (0.20, 0.35, 0.50, 0.65)


def crossed_grid() -> list[ClusteringParams]:
    return [ClusteringParams(f"calib-r{r}-w{w}-s{s:.2f}", r, 500, 12000, w, s) for r in RADII for w in WINDOWS for s in THRESHOLDS]


def axis_grid() -> list[ClusteringParams]:
    changes = [("reference", {}), ("rayon-1500", {"base_radius_m": 1500}), ("rayon-4000", {"base_radius_m": 4000}), ("croissance-250", {"growth_m_per_hour": 250}), ("croissance-1000", {"growth_m_per_hour": 1000}), ("fenetre-12h", {"attach_window_hours": 12}), ("seuil-0.20", {"min_score": 0.20}), ("seuil-0.50", {"min_score": 0.50})]
    return [ClusteringParams(version=f"calib-{name}", **change) for name, change in changes]


def partition_signature(members: DataFrame) -> DataFrame:
    """One row a version: a digest of the partition that ignores event ids and row order."""
    groups = members.groupBy("version", "event_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("provider_key")), ","), 256).alias("g"))
    part = lambda k: F.sum(F.conv(F.substring("g", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)"))
    return groups.groupBy("version").agg(F.count("*").alias("events"), F.substring(F.sha2(F.concat_ws("|", F.count("*"), part(0), part(1), part(2)), 256), 1, 16).alias("signature"))


def timeline_entries(events: DataFrame, now) -> DataFrame:
    """Two entries an event, with the keys that make their insertion idempotent."""
    entry = lambda kind, at, title: F.struct(F.lit(kind).alias("entry_type"), at.alias("occurred_at"), title.alias("title"), F.concat_ws(":", F.lit(kind), "event_key", F.date_format(at, "yyyyMMddHHmmss")).alias("deduplication_key"))
    count = F.concat(F.col("detection_count").cast("string"), F.lit(" observations"))
    rows = F.array(entry("first_detection", F.col("first_detected_at"), F.lit("Première observation")), entry("new_detection", F.col("last_detected_at"), count))
    return events.select("event_key", F.explode(rows).alias("e")).select("event_key", "e.*", now.alias("recorded_at"))
