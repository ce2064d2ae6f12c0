"""The recurring pass: capped takes from the queue, repeated passes, isolated products, totals."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(detections: DataFrame, members: DataFrame | None) -> DataFrame:
    """Public detections off known sources that no event holds."""
    free = detections.filter(F.col("is_public") & F.col("known_source_key").isNull())
    return free if members is None else free.join(members.select("id", "acquired_at"), ["id", "acquired_at"], "left_anti")


def take(queue: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of the queue by instant and key; without a limit all of them.

    Spark keeps `limit` rows a partition and merges those, so no more is ever sorted in one place.
    """
    return queue if limit is None else queue.orderBy("acquired_at", "provider_key").limit(limit)


def was_capped(fetched: int, limit: int | None) -> bool:
    """Whether a pass filled its cap, so that another one must follow."""
    return limit is not None and fetched >= limit


@dataclass
class Totals:
    """What the passes of a run have done together."""

    passes: int = 0
    processed: int = 0
    created: int = 0
    attached: int = 0
    touched: list[DataFrame] = field(default_factory=list)

    def add(self, out: DataFrame, before: DataFrame | None) -> None:
        """Count a pass from its attached rows (event_id, is_new) and the events there were before."""
        new = out.filter("is_new")
        events = new.select("event_id").distinct()
        founded = events if before is None else events.join(before.select("event_id").distinct(), "event_id", "left_anti")
        processed, created = new.count(), founded.count()
        self.passes, self.processed = self.passes + 1, self.processed + processed
        self.created, self.attached = self.created + created, self.attached + processed - created
        self.touched.append(events)

    def touched_events(self) -> DataFrame:
        out = self.touched[0]
        for events in self.touched[1:]:
            out = out.union(events)
        return out.distinct()


def run_passes(queue: Callable[[], DataFrame], step: Callable[[DataFrame], int], limit: int | None, most: int = 1000) -> tuple[int, bool]:
    """Run capped passes until the queue is empty: (passes, truncated).

    step() handles a pass and returns how many rows it took; `truncated` tells that the last
    pass was still capped when `most` passes had run.
    """
    passes, fetched = 0, 0
    while passes < most:
        fetched = step(take(queue(), limit))
        passes += 1
        if not was_capped(fetched, limit) or fetched == 0:
            return passes, False
    return passes, True


def run_products(products: Iterable[str], step: Callable[[str], int], isolated: tuple = (RuntimeError, ValueError, OSError)) -> list[tuple[str, int, str | None]]:
    """(product, rows, error) of every product; one product's failure leaves the others alone.

    Only when all fail does the run fail, so a provider that is quiet at night alarms nobody.
    """
    out = []
    for product in products:
        try:
            out.append((product, step(product), None))
        except isolated as e:
            out.append((product, 0, str(e)[:300]))
    if out and all(error is not None for _, _, error in out):
        raise RuntimeError("every product failed: " + "; ".join(f"{p}: {e}" for p, _, e in out))
    return out


def cumulative(runs: DataFrame, key: str, time: str, counter: str) -> DataFrame:
    """The ledger's rows with the running total of a counter for each source, pass by pass.

    A source has a row a pass, so a source's rows are few; ties in time are one pass.
    """
    upto = Window.partitionBy(key).orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.withColumn(f"total_{counter}", F.sum(counter).over(upto))


def latest(batch: DataFrame, time: str = "acquired_at") -> Column:
    """The most recent instant of a batch, null if it is empty."""
    return batch.agg(F.max(time)).first()[0]
