"""The recurring ingestion pass as a stream of micro-batches.

A file stream of provider rows is parsed, quarantined, stored once, classified, clustered
against the open events near them, and the touched events are aggregated and published. Every
table is written under its batch's number, so a replayed batch replaces what it wrote:
exactly-once by batch and by key. A pass reads the months of its own rows, the open events
and its batch's neighbours, never all history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from firegrid.functions.rules import REFERENCE, ClusteringParams, is_future
from firegrid.operators.event_state import advance, unexpired
from firegrid.operators.graph import shared_checkpoint
from firegrid.operators.spatial import classify_known
from firegrid.sources.providers import FIELDS, accepted, parse_rows, rejected
from firegrid.sources.sinks import exists, new_rows

RAW_SCHEMA = StructType([StructField(c, StringType()) for c in FIELDS])


@dataclass
class Pass:
    """Tables below `root`, each partitioned by batch.

    detections (and by month), rejects, quarantine; members: attached rows; open: the open
    events' places after the batch, and totals: their figures; waiting: rows that are younger than
    the latest by less than `lateness_h`, and progress: the instant up to which rows are attached;
    events: the new figures of the events that the batch touched. With a lateness, rows that
    arrive up to so much late are attached in the order of their instants, as in one pass over all.
    """

    spark: SparkSession
    root: str
    product: str
    sources: DataFrame | None = None
    params: ClusteringParams = REFERENCE
    now: str | None = None
    lateness_h: float = 0.0

    def table(self, name: str, before: int | None = None) -> DataFrame | None:
        """Rows of a table, without those of batch `before` and later."""
        path = f"{self.root}/{name}"
        if not exists(self.spark, path):
            return None
        stored = self.spark.read.option("basePath", path).parquet(path)
        return stored if before is None else stored.filter(F.col("batch") < before)

    def of_batch(self, name: str, batch: int) -> DataFrame | None:
        """The rows that one batch wrote: the only ones that are read."""
        path = f"{self.root}/{name}/batch={batch}"
        return self.spark.read.parquet(path) if exists(self.spark, path) else None

    def write(self, df: DataFrame, name: str, batch: int, *by: str) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{name}/batch={batch}")

    def known(self, rows: DataFrame, batch: int) -> DataFrame | None:
        """The stored detections of the months of `rows`; a detection's key holds its instant."""
        stored = self.table("detections", batch)
        months = [r.m for r in rows.select(F.date_format("acquired_at", "yyyy-MM").alias("m")).distinct().collect()]  # the months of one batch
        return None if stored is None else stored.filter(F.col("acq_month").isin(months))

    def run(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch."""
        parsed = parse_rows(rows, self.product)
        self.write(rejected(parsed), "rejects", batch)
        ok = accepted(parsed)
        now = F.lit(self.now).cast("timestamp") if self.now else F.current_timestamp()
        self.write(ok.filter(is_future(F.col("acquired_at"), now)), "quarantine", batch)
        due = shared_checkpoint(ok.filter(~is_future(F.col("acquired_at"), now)))
        fresh = new_rows(due, self.known(due, batch)).withColumn("id", F.col("provider_key"))
        fresh = classify_known(fresh, self.sources) if self.sources is not None else fresh.withColumn("known_source_key", F.lit(None).cast("string"))
        fresh = shared_checkpoint(fresh.withColumn("is_public", F.lit(True)))
        self.write(fresh.withColumn("acq_month", F.date_format("acquired_at", "yyyy-MM")), "detections", batch, "acq_month")
        self.attach(batch, fresh)

    def attach(self, batch: int, fresh: DataFrame | None) -> None:
        """Cluster the public detections off known sources among `fresh` and those that waited; without `fresh` all that wait."""
        queue = self.of_batch("waiting", batch - 1)
        if fresh is not None:
            free = fresh.filter(F.col("is_public") & F.col("known_source_key").isNull())
            queue = shared_checkpoint(free if queue is None else free.unionByName(queue))
        if queue is None:
            return
        earlier = self.of_batch("progress", batch - 1)
        until = [] if earlier is None else [earlier.first().until]
        seen = queue.agg(F.max(F.unix_micros("acquired_at"))).first()[0]
        if seen is not None:
            until.append(seen - (0 if fresh is None else int(self.lateness_h * 3.6e9)))
        upto = max(until, default=-(1 << 62))
        self.write(self.spark.range(1).select(F.lit(upto).alias("until")), "progress", batch)
        ripe = F.unix_micros("acquired_at") <= upto
        self.write(queue.filter(~ripe), "waiting", batch)
        pending, state, totals = queue.filter(ripe), self.of_batch("open", batch - 1), self.of_batch("totals", batch - 1)
        if pending.isEmpty():
            for name, df in (("open", state), ("totals", totals)):
                if df is not None:
                    self.write(df, name, batch)
            return
        attached, after = advance(state, pending, self.params)
        # Rows that come later than the lateness allows meet the events that are still open then.
        after = shared_checkpoint(unexpired(after, F.timestamp_micros(F.lit(upto)), self.params))
        self.write(after, "open", batch)
        self.write(attached.drop("is_new", "version"), "members", batch)
        self.snapshot(attached, pending, totals, after, batch)

    def snapshot(self, attached: DataFrame, pending: DataFrame, totals: DataFrame | None, state: DataFrame, batch: int) -> None:
        """Publish the new totals of the events that the batch touched, from their totals before and its rows; keep those of open events."""
        rows = attached.select("id", "event_id").join(pending.select("id", "acquired_at", "longitude", "latitude", "frp_mw", "sensor"), "id")
        both = rows.select(
            "event_id", F.lit(1).cast("long").alias("detection_count"), F.col("acquired_at").alias("first_detected_at"), F.col("acquired_at").alias("last_detected_at"), F.col("longitude").alias("lon_sum"),
            F.col("latitude").alias("lat_sum"), F.col("frp_mw").alias("frp_min_mw"), F.col("frp_mw").alias("frp_max_mw"), F.array("sensor").alias("sensors"), F.lit(True).alias("touched"),
        )
        if totals is not None:
            both = both.unionByName(totals.withColumn("touched", F.lit(False)))
        merged = shared_checkpoint(both.groupBy("event_id").agg(
            *(f(c).alias(c) for f, c in ((F.sum, "detection_count"), (F.min, "first_detected_at"), (F.max, "last_detected_at"), (F.sum, "lon_sum"), (F.sum, "lat_sum"), (F.min, "frp_min_mw"), (F.max, "frp_max_mw"))),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("sensors")))).alias("sensors"), F.max("touched").alias("touched"),
        ))
        self.write(merged.filter("touched").drop("touched"), "events", batch)
        self.write(merged.drop("touched").join(state.select("event_id").distinct(), "event_id", "left_semi"), "totals", batch)

    def flush(self, batch: int) -> None:
        """Attach the rows that still wait, as a batch without rows of its own."""
        self.attach(batch, None)


def latest_events(events: DataFrame) -> DataFrame:
    """The totals of every event after the last batch that touched it."""
    columns = [c for c in events.columns if c not in ("event_id", "batch")]
    last = events.groupBy("event_id").agg(F.max(F.struct("batch", *columns)).alias("e"))
    return last.select("event_id", *(F.col(f"e.{c}").alias(c) for c in columns))


def start(stage: Pass, landing: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Process all files that have landed, in batches, and stop."""
    stream = stage.spark.readStream.schema(RAW_SCHEMA).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(landing)
    return stream.writeStream.foreachBatch(stage.run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(detections: DataFrame, late: str = "24 hours") -> DataFrame:
    """Detections and mean radiative power by UTC day and sensor, for streams and tables."""
    return detections.withWatermark("acquired_at", late).groupBy(F.window("acquired_at", "1 day"), "sensor").agg(F.count("*").alias("n"), F.avg("frp_mw").alias("mean_frp"))


def first_seen(detections: DataFrame, late: str = "24 hours") -> DataFrame:
    """A stream without repeated keys, keeping state for `late` only."""
    return detections.withWatermark("acquired_at", late).dropDuplicatesWithinWatermark(["provider_key"])


def activity_sessions(detections: DataFrame, gap: str = "24 hours", late: str = "24 hours") -> DataFrame:
    """Sessions of activity by grid cell: a coarse view of a stream, not the clustering."""
    cell = [F.floor(F.col(c) / 0.1).alias(f"cell_{c}") for c in ("longitude", "latitude")]
    return detections.withWatermark("acquired_at", late).groupBy(F.session_window("acquired_at", gap), *cell).agg(F.count("*").alias("n"))
