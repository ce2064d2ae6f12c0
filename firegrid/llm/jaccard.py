"""Exact n-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

Documents are sets of word shingles; equal sets are one class. Sets are banded by size so
that a partner lies in the same band or the next. A tile is a band pair together with one
part of the shingle space: with d differences at most between partners and more than d
parts, partners agree in a part, so they meet in the tile of that part's content. Within a
tile the bit maps' Hamming distance bounds the overlap from above, and survivors get an
exact intersection of sorted arrays. Every set is compared with its tiles' pivots. Sets of
a tile that hang on different pivots are then compared by their bit maps, in blocks; what
these leave possible makes groups of candidates, and within these the sets are compared
exactly, in blocks too. A block gives a spanning forest of its pairs, never the pairs.

Links are counted within components. Sets that are near enough to their component's hub
are linked with each other by the triangle inequality, which is a sum over a histogram;
only the others are compared, in blocks, so no list of all pairs of a group is ever made.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firegrid.llm.common import Scratch, bound_arrow_batches, drop_rows, hot_keys, keep_rows, possible_ids, spread_join
from firegrid.llm.components import connected_components
from firegrid.llm.hashing import mix, shingle_hashes, word_hashes

#: Sets below this size are tiled by single shingles, larger ones by parts of the shingle space.
SMALL_SET = 32
#: Sets of one side of a block of a tile, and of a component; the latter carry their shingles, this many at most on average.
TILE_BLOCK, LINK_BLOCK, LINK_SHINGLES = 1024, 512, 1 << 19
#: Columns of the 0/1 matrices whose product is the overlaps of a block.
COLUMNS = 8192


@dataclass(frozen=True)
class Threshold:
    """Link if 100 * intersection >= percent * union, on sets of `words`-word shingles."""

    words: int
    percent: int

    def differences(self, total: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes sum up to `total`."""
        return (100 - self.percent) * total // (100 + self.percent)

    def band(self, size: int) -> int:
        return int(math.log(size) / math.log(100 / self.percent) + 1e-9)

    @lru_cache(maxsize=256)  # noqa: B019
    def top(self, band: int) -> int:
        """Largest size of a band."""
        high = int((100 / self.percent) ** (band + 1)) + 2
        while self.band(high) > band:
            high -= 1
        return high

    @lru_cache(maxsize=256)  # noqa: B019
    def parts(self, band: int) -> tuple[int, int, int]:
        """Largest difference in the band's tiles, number of parts, and empty parts that need no signature."""
        high = self.top(band)
        most = self.differences(high + min(high * 100 // self.percent, self.top(band + 1)))
        parts, spare = most + 1, 0
        for _ in range(20):
            empty = parts * math.exp(-high * self.percent / 100 / parts)
            if (need := math.ceil(empty + 3 * math.sqrt(empty))) <= spare:
                break
            spare = need
            parts = most + 1 + spare
        return most, parts, spare


def bitmap_words(size: int, threshold: Threshold) -> int:
    """64-bit words of a bit map: a power of two, over 8 bits for every possible difference.

    It depends on the band's parity-free size class only, so partners are folded to the
    smaller of their maps.
    """
    return 1 << max(0, (8 * threshold.differences(2 * size) // 64)).bit_length()


def bit_map(shingles: np.ndarray, words: int) -> np.ndarray:
    """Parity of the shingles that fall on each bit: a differing shingle flips one bit."""
    at = (mix(shingles) >> np.uint64(17)) % np.uint64(64 * words)
    odd = np.bincount(at.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The same map on fewer bits; sizes are powers of two, so halves are combined by exclusive or."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def signatures(shingles: np.ndarray, threshold: Threshold) -> np.ndarray:
    """The tiles of a set: 64-bit hashes of band pair, part and the part's content."""
    n, own = len(shingles), threshold.band(len(shingles))
    out = []
    for band in (own - 1, own):
        if band < 0:
            continue
        most, parts, spare = threshold.parts(band)
        salt = np.uint64((band * 0x9E3779B97F4A7C15 + 12345) & (2**64 - 1))
        if threshold.top(band) < SMALL_SET:
            # Prefix of a global (hash) order: partners share one of the first n - overlap + 1.
            overlap = -(-threshold.percent * n // 100)
            out.append(mix(np.sort(mix(shingles ^ salt))[: n - overlap + 1] + salt))
            continue
        part = ((shingles >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, values = part[order], mix(shingles[order] + salt)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sums = np.add.reduceat(values, first)
        out.append(mix(sums + mix(part[first].astype(np.uint64) + salt)))
        if parts - len(first) > spare:
            empty = np.setdiff1d(np.arange(parts), part[first]).astype(np.uint64)
            out.append(mix(mix(empty + salt) + np.uint64(77)))
    return np.unique(np.concatenate(out))


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(raw.lower()), words))


def _signed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def described_text(raw: bytes, threshold: Threshold) -> tuple[int, bytes | None, np.ndarray, bytes | None]:
    """Size and key of a text's set, its tiles, and its bit map."""
    s = shingle_set(raw, threshold.words)
    if not len(s):
        return 0, None, np.empty(0, np.int64), None
    key = _signed(np.array([mix(s).sum(), mix(s ^ np.uint64(0x5555555555555555)).sum(), len(s)], np.uint64))
    return len(s), key, signatures(s, threshold).view(np.int64), _signed(bit_map(s, bitmap_words(len(s), threshold)))


def _described(threshold: Threshold):
    """described_text() of every row; copies tend to come soon after each other."""

    def run(batches):
        known = lru_cache(maxsize=512)(lambda raw: described_text(raw, threshold))
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [known(raw or b"") if len(raw or b"") < 1 << 14 else described_text(raw, threshold) for raw in texts]
            size, key, tiles, bits = zip(*found, strict=True) if found else ((), (), (), ())
            offsets = np.zeros(len(tiles) + 1, np.int32)
            np.cumsum([len(t) for t in tiles], out=offsets[1:])
            flat = np.concatenate(tiles) if tiles else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(bits, pa.binary())],
                ["doc_id", "n", "key", "tiles", "bits"],
            )

    return run


def _arrays(threshold: Threshold):
    """The sorted shingles of every row."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_signed(shingle_set(x or b"", threshold.words)) for x in texts], pa.binary())], ["doc_id", "s"])

    return run


def _close(n1, n2, b1: bytes, b2: bytes, threshold: Threshold) -> bool:
    """Whether bit maps and sizes leave the link possible."""
    x, y = np.frombuffer(b1, np.uint64), np.frombuffer(b2, np.uint64)
    words = min(len(x), len(y))
    apart = int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum())
    return max(apart, abs(n1 - n2)) <= threshold.differences(n1 + n2)


def _both_ends(pairs: DataFrame, sets: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The pairs (u, v) with columns of both ends, numbered 1 and 2; an end of very many pairs is dealt over tasks."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("end")).groupBy("end").count()
    hot = hot_keys(ends, "end", pairs.count())
    for k, node in ((1, "u"), (2, "v")):
        side = sets.select(F.col("doc_id").alias(node), *(F.col(c).alias(f"{short}{k}") for c, short in columns.items()))
        pairs = spread_join(pairs, side, node, hot, "v" if node == "u" else "u")
    return pairs


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, threshold: Threshold, scratch: Scratch, name: str) -> DataFrame:
    """(u, v, apart) of the `pairs` that link: bit maps first, then the sorted arrays of the survivors."""

    def bounded(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n1", "n2", "b1", "b2")]
            yield batch.select(["u", "v"]).filter(pa.array([_close(*row, threshold) for row in zip(*columns, strict=True)], pa.bool_()))

    def exact(batches):
        for batch in batches:
            apart, keep = [], []
            for x, y in zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                apart.append(len(a) + len(b) - 2 * common)
                keep.append(100 * common >= threshold.percent * (len(a) + len(b) - common))
            found = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(apart, pa.int64())], ["u", "v", "apart"])
            yield found.filter(pa.array(keep, pa.bool_()))

    near = _both_ends(pairs, sets, {"n": "n", "bits": "b"}).select("u", "v", "n1", "n2", "b1", "b2")
    survivors = scratch.keep(f"{name}_survivors", near.mapInArrow(bounded, "u long, v long").distinct())
    ids = scratch.keep(f"{name}_ids", survivors.select(F.col("u").alias("doc_id")).union(survivors.select(F.col("v").alias("doc_id"))).distinct())
    own = scratch.keep(f"{name}_arrays", keep_rows(docs, ids).dropDuplicates(["doc_id"]).mapInArrow(_arrays(threshold), "doc_id long, s binary"))
    links = scratch.keep(name, _both_ends(survivors, own, {"s": "s"}).select("u", "v", "s1", "s2").mapInArrow(exact, "u long, v long, apart long"))
    scratch.drop(f"{name}_survivors", f"{name}_ids")
    return links


def _spanning(ids: np.ndarray, rows: np.ndarray, columns: np.ndarray, pairs) -> pa.Table:
    """(u, v): edges from the smallest id of each component to its other ids; pairs(k) gives the partners of rows[k] as places in columns."""
    root = np.arange(len(ids))
    for k, a in enumerate(rows):
        near = root[columns[pairs(k)]]
        if len(near) and (near != root[a]).any():
            merged = np.unique(np.append(near, root[a]))
            root[np.isin(root, merged)] = merged[0]
    order = np.lexsort((ids, root))
    first = np.r_[True, root[order][1:] != root[order][:-1]] if len(ids) else np.empty(0, bool)
    low = ids[order][first][np.cumsum(first) - 1]
    edge = low != ids[order]
    return pa.table({"u": low[edge], "v": ids[order][edge]})


def _maps(table: pa.Table) -> np.ndarray:
    """The bit maps of a block, folded to the shortest."""
    raw = [np.frombuffer(x, np.uint64) for x in table.column("bits").to_pylist()]
    words = min(len(x) for x in raw)
    return np.stack([fold(x, words) for x in raw])


def _possible(a: int, others: np.ndarray, n: np.ndarray, bits: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Which of `others` sizes and bit maps leave as partners of the set in place a."""
    most = (100 - threshold.percent) * (n[others] + n[a])
    out = np.abs(n[others] - n[a]) * (100 + threshold.percent) <= most
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count(bits[others[at]] ^ bits[a]).sum(axis=1, dtype=np.int64) * (100 + threshold.percent) <= most[at]
    return out


def _blocks(member: DataFrame, seed: int) -> DataFrame:
    """member (group, doc_id, parts, …) once for every pair of blocks (i, j) of its group that it is in; `own` is its block."""
    placed = member.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("parts")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    return spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "parts")


def _candidates(member: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """(u, v): edges whose components hold all pairs within a tile, of different labels, that the bit maps leave possible.

    member: tile, doc_id, label, parts. A tile's sets are dealt over `parts` blocks by a hash;
    each pair of blocks is a group of bounded size.
    """

    def compare(table: pa.Table) -> pa.Table:
        own, i, j, ids, label, n = (table.column(c).to_numpy() for c in ("own", "i", "j", "doc_id", "label", "n"))
        bits, left, right = _maps(table), np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])

        def pairs(k: int) -> np.ndarray:
            at = np.flatnonzero(label[right] != label[left[k]])
            return at[_possible(left[k], right[at], n, bits, threshold)]

        return _spanning(ids, left, right, pairs)

    spread = _blocks(member.join(sets.select("doc_id", "n", "bits"), "doc_id"), 21)
    return spread.groupBy("tile", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def _exact(member: DataFrame, threshold: Threshold) -> DataFrame:
    """(u, v): a spanning forest of the links within every pair of blocks of a group.

    member: group, doc_id, label, n, bits, s, parts. Sets of one label are linked already.
    """

    def compare(table: pa.Table) -> pa.Table:
        own, i, j, ids, label, n = (table.column(c).to_numpy() for c in ("own", "i", "j", "doc_id", "label", "n"))
        left, right = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
        asked = label[left][:, None] != label[right][None, :]
        linked = _linked(table, left, right, n, asked, threshold)
        return _spanning(ids, left, right, lambda k: np.flatnonzero(linked[k]))

    return _blocks(member, 23).groupBy("group", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def _linked(table: pa.Table, left: np.ndarray, right: np.ndarray, n: np.ndarray, asked: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Which of the asked pairs link: bit maps first, then exact overlaps of what they leave."""
    bits = _maps(table)
    for k, a in enumerate(left):
        b = np.flatnonzero(asked[k])
        asked[k, b] = _possible(a, right[b], n, bits, threshold)
    rows, columns = np.flatnonzero(asked.any(axis=1)), np.flatnonzero(asked.any(axis=0))
    out = np.zeros_like(asked)
    if len(rows):
        s = table.column("s")
        arrays = lambda at: [np.frombuffer(s[int(k)].as_py(), np.uint64) for k in at]
        common = _overlaps(arrays(left[rows]), arrays(right[columns]))
        total = n[left[rows]][:, None] + n[right[columns]][None, :]
        out[np.ix_(rows, columns)] = (100 * common >= threshold.percent * (total - common)) & asked[np.ix_(rows, columns)]
    return out


def _parts(count, shingles):
    """Blocks of a group: by its sets and by their shingles."""
    return F.greatest(F.ceil(count / LINK_BLOCK), F.ceil(F.coalesce(shingles, F.lit(0)) / LINK_SHINGLES)).cast("int")


def _links(tiled: DataFrame, sets: DataFrame, docs: DataFrame, threshold: Threshold, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(links, edges): the links (u, v, apart) of sets with their tiles' pivots, and (u, v) whose components are those of all links.

    A tile's pivot is its smallest id, so the many tiles of a group of near copies share one.
    """
    counts = tiled.groupBy("tile").agg(F.count("*").alias("members"), F.min("doc_id").alias("pivot"))
    busy = scratch.keep("busy", counts.filter("members > 1"))
    rows = busy.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    hot = hot_keys(busy, "tile", rows, "members")
    # A bit map tells most other tiles before anything is shuffled.
    maybe = possible_ids(tiled, busy, "tile").filter("possible").drop("possible")
    member = scratch.keep("member", spread_join(maybe, busy, "tile", hot, "doc_id").filter("doc_id <> pivot"))
    pairs = scratch.keep("pivot_pairs", member.select(F.col("pivot").alias("u"), F.col("doc_id").alias("v")).distinct())
    links = _verified(pairs, sets, docs, threshold, scratch, "pivot_links")
    # A set hangs on its smallest linked pivot, and with that on the pivot's own.
    hung = scratch.keep("hung", links.groupBy("v").agg(F.min("u").alias("u")))
    above = hung.select(F.col("v").alias("u"), F.col("u").alias("top"))
    labels = scratch.keep("labels", hung.join(above, "u", "left").select(F.col("v").alias("doc_id"), F.coalesce("top", "u").alias("label")))
    labelled = member.filter("members > 2").select("tile", "doc_id").join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    mixed = labelled.groupBy("tile").agg(F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    mixed = scratch.keep("mixed", mixed.select("tile", "members", F.ceil(F.col("members") / TILE_BLOCK).alias("parts")))
    rows = mixed.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    edges = links.select("u", "v")
    if rows:
        inside = spread_join(labelled, mixed.select("tile", "parts"), "tile", hot_keys(mixed, "tile", rows, "members"), "doc_id")
        near = connected_components(scratch.keep("candidates", _candidates(inside, sets, threshold)))
        near = scratch.keep("near", near.select(F.col("node").alias("doc_id"), F.col("component").alias("group")))
        own = scratch.keep("block_links_arrays", keep_rows(docs, near.select("doc_id")).dropDuplicates(["doc_id"]).mapInArrow(_arrays(threshold), "doc_id long, s binary"))
        named = near.join(sets, "doc_id").dropDuplicates(["doc_id"]).join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        sizes = named.groupBy("group").agg(F.count("*").alias("count"), F.sum("n").alias("shingles"))
        sizes = scratch.keep("sizes", sizes.select("group", "count", _parts(F.col("count"), F.col("shingles")).alias("parts")))
        placed = spread_join(named, sizes.select("group", "parts"), "group", hot_keys(sizes, "group", near.count()), "doc_id").join(own, "doc_id")
        edges = edges.union(scratch.keep("block_links", _exact(placed, threshold)))
    scratch.drop("busy", "member", "pivot_pairs", "hung", "labels", "mixed", "candidates", "near", "sizes")
    return links, edges


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted arrays, as products of 0/1 matrices over the shared values."""
    out = np.zeros((len(left), len(right)), np.int64)
    values = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for at in range(0, len(values), COLUMNS):
        part = values[at : at + COLUMNS]
        a, b = (np.stack([np.isin(part, x, assume_unique=True) for x in side]).astype(np.float32) for side in (left, right))
        out += (a @ b.T).astype(np.int64)
    return out


def _counted(node: DataFrame, arrays: DataFrame, threshold: Threshold) -> DataFrame:
    """(doc_id, links): documents that a set links with beyond those that the hub settles.

    node: component, doc_id, n, weight, bits, slack, fringe (whether it is a fringe set), f_parts, c_parts.
    Fringe blocks meet each other and the core blocks of their component; core blocks never meet.
    """
    block = F.pmod(F.xxhash64("doc_id", F.lit(22)), F.when(F.col("fringe"), F.col("f_parts")).otherwise(F.col("c_parts"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))
    with_fringe = F.transform(upto("f_parts"), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), F.lit(True).alias("inner")))
    with_core = F.when(F.col("c_parts") > 0, F.transform(upto("c_parts"), lambda k: F.struct(F.col("own").alias("i"), k.alias("j"), F.lit(False).alias("inner")))).otherwise(
        F.array().cast("array<struct<i:int,j:int,inner:boolean>>")
    )
    as_core = F.transform(upto("f_parts"), lambda k: F.struct(k.alias("i"), F.col("own").alias("j"), F.lit(False).alias("inner")))
    groups = F.when(F.col("fringe"), F.concat(with_fringe, with_core)).otherwise(as_core)
    spread = node.withColumn("own", block).join(arrays, "doc_id").withColumn("g", F.explode(groups)).select("component", "g.*", "own", "fringe", "doc_id", "n", "weight", "slack", "bits", "s")

    def count(table: pa.Table) -> pa.Table:
        own, i, j, fringe = (table.column(c).to_numpy() for c in ("own", "i", "j", "fringe"))
        ids, n, weight, slack = (table.column(c).to_numpy() for c in ("doc_id", "n", "weight", "slack"))
        inner = bool(table.column("inner")[0].as_py())
        left = np.flatnonzero(fringe & (own == i[0]))
        right = np.flatnonzero((fringe if inner else ~fringe) & (own == j[0]))
        if not len(left) or not len(right):
            return pa.table({"doc_id": np.empty(0, np.int64), "links": np.empty(0, np.int64)})
        asked = slack[left][:, None] + slack[right][None, :] > 0
        if inner and i[0] == j[0]:
            asked &= ~np.eye(len(left), dtype=bool)
        linked = _linked(table, left, right, n, asked, threshold)
        links, out = [linked @ weight[right]], [ids[left]]
        if not (inner and i[0] == j[0]):
            links.append(linked.T @ weight[left])
            out.append(ids[right])
        return pa.table({"doc_id": np.concatenate(out), "links": np.concatenate(links).astype(np.int64)})

    found = spread.groupBy("component", "inner", "i", "j").applyInArrow(count, "doc_id long, links long")
    return found.groupBy("doc_id").agg(F.sum("links").alias("links"))


def _link_counts(links: DataFrame, component: DataFrame, sets: DataFrame, arrays: DataFrame, threshold: Threshold, scratch: Scratch) -> DataFrame:
    """(doc_id, n_links): documents that each set of a component links with, its own copies left out.

    The hub of a component is the set with most of the given links, those with pivots.
    Let slack = (100 + percent) * distance to the hub - (100 - percent) * size. Two sets whose
    slacks sum up to 0 or less are linked by the triangle inequality, so each set's count of
    these is a running sum over its component's few slacks. Sets with a slack above 0, or
    without a link to the hub, are the fringe; only pairs with one of them are compared.
    """
    ends = links.select(F.col("u").alias("doc_id"), F.col("v").alias("far"), "apart").union(links.select(F.col("v").alias("doc_id"), F.col("u").alias("far"), "apart"))
    degree = ends.groupBy("doc_id").agg(F.count("*").alias("degree")).join(component, "doc_id")
    hubs = degree.groupBy("component").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("id"))).alias("h")).select((-F.col("h.id")).alias("far"))
    hubs = scratch.keep("hubs", hubs)
    # Distances to a hub: links whose far end is one.
    to_hub = keep_rows(ends, hubs, "far").groupBy("doc_id").agg(F.min("apart").alias("apart")).union(hubs.select("far", F.lit(0).cast("long")))
    own = component.join(sets, "doc_id").dropDuplicates(["doc_id"]).join(to_hub, "doc_id", "left")
    slack = (100 + threshold.percent) * F.col("apart") - (100 - threshold.percent) * F.col("n")
    far = 1 << 40
    node = scratch.keep("node", own.withColumn("slack", F.coalesce(slack, F.lit(far))).withColumn("fringe", F.col("slack") > 0).drop("apart"))
    grouped = node.filter(F.col("slack") < far).groupBy("component", "slack").agg(F.sum("weight").alias("w"))
    # One row for each distinct slack of a component, as its own entry and, negated, as a question.
    asked = grouped.select("component", F.col("slack").alias("at"), "w").union(grouped.select("component", -F.col("slack"), F.lit(0).cast("long")))
    upto = Window.partitionBy("component").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = scratch.keep("sums", asked.withColumn("settled", F.sum("w").over(upto)).groupBy("component", (-F.col("at")).alias("slack")).agg(F.max("settled").alias("settled")))
    rows = node.count()
    parts = node.groupBy("component").agg(
        F.count_if("fringe").alias("f"), F.count_if(~F.col("fringe")).alias("c"), F.sum(F.when(F.col("fringe"), F.col("n"))).alias("fn"), F.sum(F.when(~F.col("fringe"), F.col("n"))).alias("cn"), F.count("*").alias("count")
    )
    parts = parts.select("component", "count", "f", _parts(F.col("f"), F.col("fn")).alias("f_parts"), _parts(F.col("c"), F.col("cn")).alias("c_parts"))
    parts = scratch.keep("parts", parts)
    hot = hot_keys(parts, "component", rows)
    open_ = parts.filter("f > 0").select("component", "f_parts", "c_parts")
    compared = spread_join(node, open_, "component", hot, "doc_id")
    more = scratch.keep("more", _counted(compared, arrays, threshold))
    settled = node.select("doc_id", "component", "slack", "weight", "fringe").withColumn("at", F.struct("component", "slack"))
    sums = sums.select(F.struct("component", "slack").alias("at"), "settled")
    told = spread_join(settled, sums, "at", hot_keys(settled.groupBy("at").count(), "at", rows), "doc_id", "left")
    itself = F.when(F.col("fringe"), 0).otherwise(F.col("weight"))
    counted = told.join(more, "doc_id", "left").select("doc_id", (F.coalesce("settled", F.lit(0)) - itself + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = scratch.keep("link_counts", counted)
    scratch.drop("hubs", "node", "sums", "parts", "more")
    return out


def similar_groups(docs: DataFrame, threshold: Threshold, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of `docs`.

    component_id is the smallest doc_id that links lead to, the document itself included, and
    n_links the number of other rows that it links with directly (null unless count_links).
    Texts without words (null and empty too) have 0 shingles and no link. Repeated rows of
    one id get one row each. A null id, and an id that stands for different sets, names no
    single document: its rows have their own n_shingles, their own id as component_id, and
    no links. Other columns are ignored; an empty table gives an empty result.
    """
    bound_arrow_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    described = scratch.keep("described", texts.mapInArrow(_described(threshold), "doc_id long, n long, key binary, tiles array<long>, bits binary"))
    worded, others = described.filter("doc_id is not null and n > 0"), described.select("doc_id", "n").filter("doc_id is null or n = 0")
    held = worded.groupBy("doc_id").agg(F.min(F.xxhash64("key")).alias("low"), F.max(F.xxhash64("key")).alias("high"))
    unclear = scratch.keep("unclear", held.filter("low < high").select("doc_id"))
    if not unclear.isEmpty():
        others = others.unionByName(keep_rows(worded.select("doc_id", "n"), unclear))
        worded = drop_rows(worded, unclear)
    classes = scratch.keep("classes", worded.groupBy("key").agg(F.min("doc_id").alias("class"), F.count("*").alias("weight")))
    rows = classes.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    hot = hot_keys(classes, "key", rows, "weight")
    member = scratch.keep("members", spread_join(worded.select("doc_id", "n", "key"), classes, "key", hot, "doc_id").select("doc_id", "n", "class", "weight"))
    twins = scratch.keep("twins", member.filter("doc_id <> class").select("doc_id").distinct())
    # Repeated rows of one id and set agree in all columns, and are one set from the pairs on.
    first = scratch.keep("first", drop_rows(worded, twins))
    others = scratch.keep("others", others)
    scratch.drop("described", "unclear", "classes", "twins")
    sets = first.select("doc_id", "n", "bits")
    links, edges = _links(first.select("doc_id", F.explode("tiles").alias("tile")), sets, texts, threshold, scratch)
    component = scratch.keep("component", connected_components(edges).select(F.col("node").alias("doc_id"), "component"))
    found = component.select(F.col("doc_id").alias("class"), "component")
    if count_links:
        weighed = sets.join(member.filter("doc_id = class").select("doc_id", "weight").distinct(), "doc_id")
        arrays = scratch.read("pivot_links_arrays", "block_links_arrays").dropDuplicates(["doc_id"])
        counts = _link_counts(links, component, weighed, arrays, threshold, scratch)
        found = found.join(counts.withColumnRenamed("doc_id", "class"), "class")
    else:
        found = found.withColumn("n_links", F.lit(None).cast("long"))
    told = spread_join(member, found, "class", hot_keys(member.groupBy("class").count(), "class", rows), "doc_id", "left")
    n_links = F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1 if count_links else F.col("n_links")
    out = told.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class").alias("component_id"), n_links.alias("n_links"))
    alone = others.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0 if count_links else None).cast("long").alias("n_links"))
    scratch.drop("first", "pivot_links", "block_links", "pivot_links_arrays", "block_links_arrays")
    return out.unionByName(alone)


def keep_one_of_each(docs: DataFrame, threshold: Threshold) -> DataFrame:
    """`docs` with the smallest doc_id of every group, all its columns.

    Rows without an id, and rows whose id stands for different texts, stay.
    """
    groups = similar_groups(docs, threshold, count_links=False)
    scratch = Scratch(docs.sparkSession)
    return drop_rows(docs, scratch.keep("gone", groups.filter("doc_id <> component_id").select("doc_id").distinct()))
