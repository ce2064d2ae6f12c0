"""Warning bulletins: where they come from, the idempotent store, and the levels that are shown."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.sources.area_api import UnavailableError
from firegrid.sources.sinks import exists, new_rows

BULLETIN_KEY = ["bulletin_domain", "published_at"]
LEVEL = ["domain_id", "department", "is_coastal", "echeance", "phenomenon_id", "colour", "begin_at", "end_at"]


@dataclass(frozen=True)
class Fetched:
    access: str  # live or archive
    url: str
    body: str


def _request(url: str, headers: dict[str, str], timeout: float = 60) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
        return answer.read().decode("utf-8")


def fetch_bulletin(live_url: str, archive_url: Callable[[], str], key: str | None, request=_request) -> Fetched:
    """The current bulletin: live with a key, else from the archive, which lags and is marked so.

    The key travels in a header and never in an address or an error. Without one the live
    path is not tried. A refused key (401, 403), a used-up quota (429) and any other answer
    are told apart.
    """
    key = (key or "").strip()
    url = live_url if key else archive_url()
    try:
        return Fetched("live" if key else "archive", url, request(url, {"apikey": key, "accept": "*/*"} if key else {}))
    except urllib.error.HTTPError as e:
        reason = {401: "the key was refused", 403: "the key was refused", 429: "the quota is used up"}.get(e.code if key else 0, "no bulletin")
        raise UnavailableError(f"{reason} (HTTP {e.code})") from None
    except OSError as e:
        raise UnavailableError(f"the source cannot be reached: {type(e).__name__}") from None


def bulletins_of(parsed: DataFrame) -> DataFrame:
    """One row a bulletin of parse_warnings() rows: its key, snapshot, accepted and rejected levels.

    A bulletin has a few rows, so counting before the shuffle saves nothing and would hold all bulletins of a task's files.
    """
    return parsed.repartition(*BULLETIN_KEY).groupBy(*BULLETIN_KEY).agg(
        F.min("snapshot_id").alias("snapshot_id"), F.count_if(F.col("reject").isNull()).alias("levels"), F.count_if(F.col("reject").isNotNull()).alias("rejects")
    )


def new_bulletins(parsed: DataFrame, stored: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(bulletins, levels) that are not stored yet; one bulletin for each domain and instant, and its usable levels once each."""
    fresh = new_rows(bulletins_of(parsed), stored, BULLETIN_KEY)
    levels = parsed.filter("reject is null").join(fresh.select(*BULLETIN_KEY), BULLETIN_KEY, "left_semi")
    return fresh, levels.select(*BULLETIN_KEY, *LEVEL).distinct()


def store_bulletins(parsed: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Append what is new below `root`; reruns add nothing. Returns the stored bulletins and levels.

    Levels are written before their bulletin, and without those of a run that stopped in
    between: a bulletin that is present has all its levels.
    """
    spark = parsed.sparkSession
    read = lambda name: spark.read.parquet(f"{root}/{name}") if exists(spark, f"{root}/{name}") else None
    bulletins, levels = new_bulletins(parsed, read("bulletins"))
    known = read("levels")
    if known is not None:
        levels = levels.join(known.select(*BULLETIN_KEY, "domain_id", "echeance", "phenomenon_id", "begin_at"), [*BULLETIN_KEY, "domain_id", "echeance", "phenomenon_id", "begin_at"], "left_anti")
    levels.write.mode("append").parquet(f"{root}/levels")
    bulletins.write.mode("append").parquet(f"{root}/bulletins")
    return read("bulletins"), read("levels")


def active_warnings(levels: DataFrame) -> DataFrame:
    """Levels that are shown: all but green ones."""
    return levels.filter(F.col("colour") != "vert")
