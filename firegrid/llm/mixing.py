"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Every source's documents are shuffled into one stream of words and cut into blocks of
equal size. Slot i of the mix takes the van der Corput point of i; the point falls into a
source's part of the cumulated weights, and the slot's rank within its source names the
block it takes. Over a whole power of two of slots the points are a permutation, so each
source gets exactly its number of slots, spread evenly over the mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firegrid.llm.common import WORD, checkpoint, fresh, small

#: Slots of a mix; more sources than SLOTS / 256 raise it, and so do blocks of more than MAX_BLOCK words.
SLOTS = 1 << 18
MAX_BLOCK = 1 << 20
#: Words of a source that the mix takes at most, as a multiple of its words.
MAX_REPEATS = 3
_SEGMENT = 4096


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Add weight and target to (source, source_size, ...), one row a source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. The target is the water
    level times the weight, or MAX_REPEATS times the size where that is less; the level
    shares the words of all sources out exactly. The windows see a row for each source.
    """
    cap = F.col("source_size") * MAX_REPEATS
    named = sources.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")).withColumn(
        "weight", ((F.col("number") - 1) % 3 + 1).cast("long")
    )
    everything = Window.partitionBy()
    below = Window.orderBy((cap / F.col("weight")).asc(), "number").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(below), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    )
    levelled = named.withColumn("level", level)
    final = F.min(F.when(F.col("level") <= cap / F.col("weight"), F.struct((cap / F.col("weight")).alias("r"), "number", "level"))).over(everything)
    return levelled.withColumn("target", F.least(cap.cast("double"), F.coalesce(final["level"], F.lit(0.0)) * F.col("weight"))).drop("level")


@dataclass
class Mix:
    sizes: DataFrame  # doc_id, row, number, size
    sources: DataFrame  # source, number, weight, source_size, target, blocks, slots, before
    slots: DataFrame  # slot, number, rank, block, round
    pieces: DataFrame  # number, block, row, doc_id, start, words

    def taken(self) -> DataFrame:
        """slot, number, block, round, row, doc_id, start, words: the mix, piece by piece."""
        return self.slots.join(self.pieces, ["number", "block"])


def plan_mix(docs: DataFrame, slots: int = SLOTS) -> Mix:
    """The schedule and the blocks for all rows of `docs`.

    Null and empty texts have no words and are never taken. Repeated rows are separate
    documents; ties in the shuffle are broken by doc_id and row. An empty table gives an
    empty mix. Other columns are ignored.
    """
    rows = checkpoint(
        docs.select("doc_id", "source", word_count().alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"), F.monotonically_increasing_id().alias("row"))
    )
    sums = checkpoint(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    n_sources, total, n_docs = sums.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    slots = max(slots, 1 << (256 * n_sources - 1).bit_length() if n_sources else 1, 1 << max(0, total // MAX_BLOCK).bit_length())
    width = max(1, -(-total // slots))
    size, target = F.col("source_size"), F.col("target")
    blocks = F.when(size > 0, F.greatest(F.lit(1), F.expr(f"(source_size + {width // 2}) div {width}"))).otherwise(0).cast("long")
    wanted = F.when(size > 0, F.floor(target * F.col("blocks") / size + 0.5)).otherwise(0).cast("long")
    before = F.coalesce(F.sum("slots").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sources = checkpoint(targets(sums).withColumn("blocks", blocks).withColumn("slots", wanted).withColumn("before", before))
    n_slots = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]

    # Shuffled word streams: where each document starts, by sums over hash buckets, then within a bucket.
    shift = 16 - max(4, min(16, (n_docs // 64).bit_length()))
    numbered = rows.join(small(sources.select("source", "number", "source_size", "blocks"), n_sources), rows["source"].eqNullSafe(sources["source"])).select(
        "doc_id", "row", "number", "source_size", "blocks", "size", "h", F.expr(f"cast(conv(substr(h, 1, 4), 16, 10) as int) div {1 << shift}").alias("bucket")
    )
    by_bucket = numbered.groupBy("number", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select("number", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("number", "bucket").orderBy("h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.filter("size > 0").join(offsets, ["number", "bucket"]).withColumn("begin", F.col("offset") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    # Block j holds the words from j * S div blocks up to (j + 1) * S div blocks.
    block_of = lambda word: f"((({word}) + 1) * blocks - 1) div source_size"
    pieces = (
        placed.select("*", F.explode(F.expr(f"sequence({block_of('begin')}, {block_of('begin + size - 1')})")).alias("block"))
        .withColumn("low", F.greatest("begin", F.expr("(block * source_size) div blocks")))
        .withColumn("high", F.least(F.col("begin") + F.col("size"), F.expr("((block + 1) * source_size) div blocks")))
        .select("number", "block", "row", "doc_id", (F.col("low") - F.col("begin")).alias("start"), (F.col("high") - F.col("low")).alias("words"))
    )
    return Mix(rows.select("doc_id", "row", "source", "size"), sources, _schedule(docs, sources, n_slots), pieces)


def _schedule(docs: DataFrame, sources: DataFrame, n_slots: int) -> DataFrame:
    """slot, number, rank, block, round: van der Corput points mapped through the cumulated slots."""
    bits = max(1, (n_slots - 1).bit_length()) if n_slots else 1
    point = F.conv(F.reverse(F.lpad(F.conv(F.col("id").cast("string"), 10, 2), bits, "0")), 2, 10).cast("long")
    points = docs.sparkSession.range(1 << bits if n_slots else 0).select(F.col("id").alias("slot"), point.alias("point")).withColumn("part", F.expr(f"point div {_SEGMENT}"))
    # A source's part of the points in segments, so that the lookup is an equi-join.
    own = sources.filter("slots > 0").select("number", "blocks", "before", "slots").withColumn(
        "part", F.explode(F.expr(f"sequence(before div {_SEGMENT}, (before + slots - 1) div {_SEGMENT})"))
    )
    dealt = points.join(own, "part").filter("point >= before and point < before + slots").select("slot", "number", "blocks", F.expr(f"slot div {_SEGMENT}").alias("segment"))
    dealt = checkpoint(dealt)
    # Ranks within a source in two levels, so that a large source is not sorted by one task.
    sums = dealt.groupBy("number", "segment").count()
    ahead = Window.partitionBy("number").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("number", "segment", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("number", "segment").orderBy("slot")
    ranked = dealt.join(offsets, ["number", "segment"]).withColumn("rank", F.col("offset") + F.row_number().over(inner) - 1)
    return ranked.select("slot", "number", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.expr("rank div blocks").alias("round"))


def mix_report(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_slots, first_slot for every row of `docs`.

    n_slots counts the slots that take words of the row, and first_slot is the first of them
    in the order of the mix (null if there is none).
    """
    mix = plan_mix(docs, slots)
    taken = mix.taken().groupBy("row").agg(F.sum("words").alias("taken"), F.count("*").alias("n_slots"), F.min("slot").alias("first_slot"))
    n = mix.sources.count()
    return (
        mix.sizes.join(small(mix.sources.select(F.col("source").alias("name"), "source_size", "target"), n), F.col("source").eqNullSafe(F.col("name")))
        .join(taken, "row", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), "first_slot")
    )


def mixed_documents(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """`docs` in the order of the mix: each row as often as the rounded share of its words, with all its columns.

    A row is repeated round(taken / size) times, 3 at most, and left out at 0. Copy k stands
    where round k of its source takes the row's first words, so the sources are interleaved
    as the slots are; the result is sorted over its partitions. Rows without words or
    without a doc_id stay once, at the end. Repeated rows of one doc_id share the largest count.
    """
    mix = plan_mix(docs, slots)
    rounds = mix.taken().groupBy("row", "doc_id", "round").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    by_row = rounds.groupBy("row", "doc_id").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list("slot")).alias("slots"))  # at most MAX_REPEATS + 1
    share = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    counted = mix.sizes.filter("size > 0 and doc_id is not null").join(by_row.drop("doc_id"), "row", "left")
    counted = counted.select("doc_id", F.struct(F.coalesce(share, F.lit(0)).alias("times"), "slots").alias("p"))
    p, slot = fresh("_p", docs), fresh("_slot", docs)
    places = checkpoint(counted.groupBy("doc_id").agg(F.max("p").alias(p)))
    copies = F.when(F.col(p).isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.slice(f"{p}.slots", F.lit(1), F.col(f"{p}.times")))
    repeated = docs.join(places, "doc_id", "left").withColumn(slot, F.explode(copies))
    return repeated.repartitionByRange(F.col(slot).asc_nulls_last(), F.xxhash64("doc_id")).sortWithinPartitions(F.col(slot).asc_nulls_last(), "doc_id").select(*docs.columns)
