"""A Spark data source over the provider's area API: one partition for each product, box and window.

    spark.dataSource.register(AreaSource)
    spark.read.format("area").option("base", "https://host/api/area/csv").option("key", k)
         .option("products", "A,B").option("bbox", "-5,41,10,51").option("start", "2024-01-01").option("days", 12).load()

Rows hold the raw body, which is archived before it is parsed. A base of file: or a path reads
landed files of the same layout, which is how tests run without a network.
"""

from __future__ import annotations

import hashlib
import urllib.error
import urllib.request
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from firegrid.sources.providers import split_bbox

MAX_DAYS = 5


class QuotaError(RuntimeError):
    """The quota is used up; `retry_after` seconds should pass."""

    def __init__(self, retry_after: int | None):
        super().__init__("quota reached")
        self.retry_after = retry_after


class UnavailableError(RuntimeError):
    """The provider cannot be reached or does not answer with data."""


@dataclass
class Window(InputPartition):
    product: str
    box: tuple[float, float, float, float]
    start: str
    days: int

    def path(self) -> str:
        return f"{self.product}/{','.join(f'{x:g}' for x in self.box)}/{self.days}/{self.start}"


def fetch(base: str, key: str | None, window: Window, timeout: float = 120) -> str:
    """Body of one request. Errors never name the address, which holds the key."""
    if not 1 <= window.days <= MAX_DAYS:
        raise ValueError(f"days must be between 1 and {MAX_DAYS}")
    if not base.startswith("http"):
        try:
            with open(f"{base.removeprefix('file:')}/{window.path()}.csv", encoding="utf-8") as f:
                return f.read()
        except FileNotFoundError:
            return ""
    try:
        with urllib.request.urlopen(f"{base}/{key}/{window.path()}", timeout=timeout) as answer:
            return answer.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        if e.code == 429:
            wait = e.headers.get("Retry-After") or ""
            raise QuotaError(int(wait) if wait.isdigit() else None) from None
        raise UnavailableError(f"the provider answered {e.code}: {e.read(160).decode('utf-8', 'replace').strip()}") from None
    except OSError as e:
        raise UnavailableError(f"the provider cannot be reached: {type(e).__name__}") from None


class AreaReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        o = self.options
        box = [float(x) for x in o["bbox"].split(",")]
        days, first = int(o.get("days", "1")), date.fromisoformat(o["start"])
        windows = [(first + timedelta(days=k), min(MAX_DAYS, days - k)) for k in range(0, days, MAX_DAYS)]
        return [
            Window(product, tile, start.isoformat(), n)
            for product in o["products"].split(",")
            for tile in split_bbox(*box, float(o.get("span", "10")))
            for start, n in windows
        ]

    def read(self, partition: Window):
        body = fetch(self.options["base"], self.options.get("key"), partition)
        first = body.lstrip().split("\n", 1)[0].lower()
        if body and not ("latitude" in first and "longitude" in first):
            raise UnavailableError(f"not a table: {body.strip()[:120]!r}")
        yield partition.product, partition.path(), body, hashlib.sha256(body.encode()).hexdigest()


class AreaSource(DataSource):
    @classmethod
    def name(cls):
        return "area"

    def schema(self):
        return "product string, request string, body string, sha256 string"

    def reader(self, schema):
        return AreaReader(self.options)
