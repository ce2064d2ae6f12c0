"""Areas that tile a territory: noded edges, dissolving level by level, simplification that keeps neighbours joined.

Edges are rows (x0, y0, x1, y1) with their area's inside on the left. They are first split
wherever a vertex of any area lies on them, so that two neighbours have the same edges in
opposite directions even at T-junctions. An outline is then what is left when opposite edges
cancel, which is a count; only a unit's own outline meets in one task, to be chained into rings.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.operators.graph import shared_checkpoint
from firegrid.operators.shapes import RING, douglas_peucker, rings_array

#: Degrees within which a vertex lies on an edge: a tenth of a millimetre.
ON_EDGE = 1e-9
_XY = ("x0", "y0", "x1", "y1")


def noded_edges(areas: DataFrame, unit: str) -> DataFrame:
    """(columns of `areas` but rings, x0, y0, x1, y1): every area's edges, split at all vertices that lie on them.

    `unit` names each area; rings are closed, the first outside and the others holes, in any direction. Edges of no
    length are dropped. Edges and vertices meet in cells of about twice an average edge.
    """
    keep = [c for c in areas.columns if c != "rings"]
    point = lambda r, k: F.element_at(r, k)
    rings = areas.select(*keep, F.posexplode("rings").alias("_ring", "_points")).filter("size(_points) >= 4")
    pairs = F.arrays_zip(F.slice("_points", 1, F.size("_points") - 1).alias("a"), F.slice("_points", 2, F.size("_points") - 1).alias("b"))
    turn = F.aggregate(pairs, F.lit(0.0), lambda s, e: s + (e["a"]["lon"] - point(F.col("_points"), 1)["lon"]) * (e["b"]["lat"] - point(F.col("_points"), 1)["lat"]) - (e["b"]["lon"] - point(F.col("_points"), 1)["lon"]) * (e["a"]["lat"] - point(F.col("_points"), 1)["lat"]))
    told = rings.withColumn("_pairs", pairs).withColumn("_left", (turn > 0) == (F.col("_ring") == 0))
    edges = told.select(*keep, "_ring", "_left", F.posexplode("_pairs").alias("_at", "e"))
    way = lambda a, b: F.when(F.col("_left"), F.col(a)).otherwise(F.col(b))
    edges = edges.select(*keep, "_ring", "_at", way("e.a.lon", "e.b.lon").alias("x0"), way("e.a.lat", "e.b.lat").alias("y0"), way("e.b.lon", "e.a.lon").alias("x1"), way("e.b.lat", "e.a.lat").alias("y1"))
    edges = shared_checkpoint(edges.filter("x0 <> x1 or y0 <> y1"))
    mean = edges.agg(F.avg(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))))).first()[0] or 1.0
    cell = lambda c: F.floor(c / F.lit(2 * mean))
    vertices = edges.select(F.col("x0").alias("vx"), F.col("y0").alias("vy")).distinct().withColumn("cx", cell(F.col("vx"))).withColumn("cy", cell(F.col("vy")))
    cells = lambda a, b: F.explode(F.sequence(cell(F.least(a, b) - ON_EDGE), cell(F.greatest(a, b) + ON_EDGE)))
    spread = edges.select(unit, "_ring", "_at", *_XY).withColumn("cx", cells("x0", "x1")).withColumn("cy", cells("y0", "y1"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    along = ((F.col("vx") - F.col("x0")) * dx + (F.col("vy") - F.col("y0")) * dy) / (dx * dx + dy * dy)
    across = F.abs((F.col("vx") - F.col("x0")) * dy - (F.col("vy") - F.col("y0")) * dx) / F.sqrt(dx * dx + dy * dy)
    met = spread.join(vertices, ["cx", "cy"]).filter((across <= ON_EDGE) & (along > 0) & (along < 1))
    met = met.filter("not (vx = x0 and vy = y0) and not (vx = x1 and vy = y1)")
    split = met.groupBy(unit, "_ring", "_at").agg(F.array_sort(F.collect_set(F.struct(along.alias("t"), "vx", "vy"))).alias("_met"))
    whole = edges.join(split, [unit, "_ring", "_at"], "left")
    place = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    inner = F.coalesce(F.transform("_met", lambda m: F.struct(m["vx"].alias("x"), m["vy"].alias("y"))), F.array().cast("array<struct<x:double,y:double>>"))
    line = whole.select(*keep, F.concat(F.array(place("x0", "y0")), inner, F.array(place("x1", "y1"))).alias("p"))
    steps = line.select(*keep, F.explode(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), F.slice("p", F.lit(2), F.size("p") - 1).alias("b"))).alias("e"))
    return steps.select(*keep, F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1"))


def outline(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, x0, y0, x1, y1): the edges of every key that no opposite edge of the key cancels."""
    a, b = F.struct("x0", "y0"), F.struct(F.col("x1").alias("x0"), F.col("y1").alias("y0"))
    net = edges.groupBy(*keys, F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(F.sum(F.when(a < b, 1).otherwise(-1)).alias("net")).filter("net <> 0")
    low, high = F.col("low"), F.col("high")
    forward = F.col("net") > 0
    pick = lambda x, y, k: F.when(forward, x.getField(k)).otherwise(y.getField(k))
    return net.select(*keys, *(pick(low, high, k).alias(n) for k, n in (("x0", "x0"), ("y0", "y0"))), *(pick(high, low, k).alias(n) for k, n in (("x0", "x1"), ("y0", "y1"))))


def _chained(x0, y0, x1, y1) -> list[np.ndarray]:
    """Closed rings of directed edges; where several go on, the one furthest to the left, so rings touch but do not cross."""
    follow: dict[tuple, list[tuple]] = {}
    for a, b, c, d in sorted(zip(x0, y0, x1, y1, strict=True)):
        follow.setdefault((a, b), []).append((c, d))
    rings = []
    while follow:
        start = min(follow)
        ring, at, came = [start], start, None
        while at in follow:
            ways = follow[at]
            turn = lambda w: math.atan2(came[0] * (w[1] - at[1]) - came[1] * (w[0] - at[0]), came[0] * (w[0] - at[0]) + came[1] * (w[1] - at[1])) if came else 0.0  # noqa: B023, E731
            step = max(ways, key=turn)
            ways.remove(step)
            if not ways:
                del follow[at]
            ring.append(step)
            came, at = (step[0] - at[0], step[1] - at[1]), step
            if at == start:
                break
        rings.append(np.array(ring))
    return rings


def _groups(batches, size: int):
    """(key, rows) of every group of batches that are sorted by their first `size` columns; a group may go on in the next batch."""
    group, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:size] != group:
                if rows:
                    yield group, rows
                group, rows = row[:size], []
            rows.append(row[size:])
    if rows:
        yield group, rows


def _in_parts(rows, size: int = 10_000):
    """Lists of about so many rows."""
    part = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield part
            part = []
    if part:
        yield part


def rings_of(edges: DataFrame, key: str) -> DataFrame:
    """(key, rings) of outlines: outer rings turn left, holes right. A key's outline is chained in one task, many keys one after another."""

    def chain(batches):
        kind = None

        def seen():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for part in _in_parts(_groups(seen(), 1)):
            yield pa.RecordBatch.from_arrays([pa.array([k for (k,), _ in part], kind), rings_array([_chained(*zip(*rows, strict=True)) for _, rows in part])], [key, "rings"])

    sorted_edges = edges.select(key, *_XY).repartition(key).sortWithinPartitions(key)
    return sorted_edges.mapInArrow(chain, f"{key} {dict(edges.dtypes)[key]}, rings array<{RING}>")


def planar_area(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, area) in square degrees, from the edges alone: holes count as less."""
    return edges.groupBy(*keys).agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("area"))


def dissolve_levels(areas: DataFrame, unit: str, keys: list[str]) -> dict[str, DataFrame]:
    """The outline edges of every level, from the units up: `keys` are columns of `areas`, each grouping the one before it.

    Edges are noded once; each level cancels what the level below has left, so the work shrinks on the way up.
    """
    levels, held = {}, shared_checkpoint(noded_edges(areas, unit))
    for k, key in enumerate(keys):
        held = shared_checkpoint(outline(held, *keys[k:]))
        levels[key] = held.select(key, *_XY)
    return levels


def simplify_coverage(areas: DataFrame, unit: str, tolerance: float) -> DataFrame:
    """(unit, rings): the areas with every shared arc simplified once, so neighbours keep the same vertices.

    Arcs run between nodes, the vertices where not exactly two edges meet; nodes stay. An arc lies between
    one pair of areas (or an area and the outside), so a task holds one common border. An arc that is a
    closed ring keeps its smallest vertex and the one furthest from it, and stays whole if it would fall flat.
    """
    name = F.col(unit).cast("string")
    edges = shared_checkpoint(noded_edges(areas.select(unit, "rings"), unit).select(name.alias("unit"), *_XY))
    a, b = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    forward = a < b
    sides = edges.groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(F.min(F.when(forward, F.col("unit"))).alias("left"), F.min(F.when(~forward, F.col("unit"))).alias("right"))
    sides = shared_checkpoint(sides)
    degree = sides.select(F.explode(F.array("low", "high")).alias("v")).groupBy("v").count()
    nodes = degree.filter("count <> 2").select("v")
    # Each border is written in one direction: with the smaller name on the left, the outside last.
    turned = F.col("left").isNull() | (F.col("right") < F.col("left"))
    way = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    border = sides.select(way("left", "right").alias("own"), way("right", "left").alias("other"), way("low", "high").alias("a"), way("high", "low").alias("b"))
    marked = border.join(nodes.select(F.col("v").alias("a"), F.lit(True).alias("a_node")), "a", "left").join(nodes.select(F.col("v").alias("b"), F.lit(True).alias("b_node")), "b", "left")
    flat = marked.select(
        "own", "other", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"),
        F.coalesce("a_node", F.lit(False)).alias("a_node"), F.coalesce("b_node", F.lit(False)).alias("b_node"),
    )

    def arcs(rows: list[tuple]) -> list[tuple]:
        if len(rows) == 1:
            return [rows[0][:4]]
        ahead = {r[:2]: [] for r in rows}
        node = set()
        for r in sorted(rows):
            ahead[r[:2]].append(r[2:4])
            node |= ({r[:2]} if r[4] else set()) | ({r[2:4]} if r[5] else set())
        out = []
        starts = [p for p in sorted(ahead) if p in node] + sorted(p for p in ahead if p not in node)
        for start in starts:
            while ahead.get(start):
                line = [start]
                while ahead.get(line[-1]) and (len(line) == 1 or (line[-1] not in node and line[-1] != start)):
                    line.append(ahead[line[-1]].pop())
                points = np.array(line)
                if line[0] == line[-1]:
                    far = int(((points - points[0]) ** 2).sum(axis=1).argmax())
                    kept = np.concatenate([douglas_peucker(points[: far + 1], tolerance), douglas_peucker(points[far:], tolerance)[1:]])
                    points = kept if len(kept) >= 4 else points
                else:
                    points = douglas_peucker(points, tolerance)
                out += [(*p, *q) for p, q in zip(points[:-1].tolist(), points[1:].tolist(), strict=True)]
        return out

    def kernel(batches):
        for part in _in_parts((*key, *edge) for key, rows in _groups(batches, 2) for edge in arcs(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.string(), *[pa.float64()] * 4), strict=True)], ["own", "other", *_XY])

    small = flat.repartition("own", "other").sortWithinPartitions("own", "other").mapInArrow(kernel, "own string, other string, x0 double, y0 double, x1 double, y1 double")
    small = shared_checkpoint(small)
    both = small.select(F.col("own").alias("unit"), *_XY).unionByName(
        small.filter("other is not null").select(F.col("other").alias("unit"), F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    )
    kind = dict(areas.dtypes)[unit]
    return rings_of(both, "unit").select(F.col("unit").cast(kind).alias(unit), "rings")
