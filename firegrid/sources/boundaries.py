"""Administrative units: list scans with rejects, and a data source over the boundary API's three endpoints.

    spark.dataSource.register(BoundarySource)
    spark.read.format("boundaries").option("base", "https://host").option("departments", "06,83").load()

Rows hold (endpoint, body); bodies go to parse_regions, parse_departments and
providers.parse_features. A base that is a path reads landed files of the same names.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from firegrid.sources.area_api import UnavailableError

#: Codes as the provider writes them (fixed values).
REGION_CODE, DEPARTMENT_CODE = "^[0-9]{2}$", "^([0-9]{2}|2[AB])$"
#: Paths and queries of the three endpoints (fixed values).
REGIONS = "regions?fields=nom,code"
DEPARTMENTS = "departements?fields=nom,code,codeRegion&zone=metro"
MUNICIPALITIES = "departements/{}/communes?fields=nom,code,codeDepartement,codesPostaux,surface,centre&format=geojson&geometry=contour"


def _entries(bodies: DataFrame, body: str) -> DataFrame:
    """(place, code, nom, codeRegion) of every entry of JSON lists; entries that are no objects have nulls, other bodies none."""
    items = F.from_json(body, "array<string>")
    flat = bodies.select(F.posexplode(items).alias("place", "item"))
    entry = F.from_json("item", "struct<code:string,nom:string,codeRegion:string>")
    text = lambda name: F.trim(F.coalesce(entry[name], F.lit("")))
    return flat.select("place", text("code").alias("code"), text("nom").alias("name"), text("codeRegion").alias("region_code"))


def _matches(column: Column, pattern: str) -> Column:
    return F.coalesce(column.rlike(pattern), F.lit(False))


def parse_regions(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(place, code, name, reject): reject is null for usable entries."""
    e = _entries(bodies, body).drop("region_code")
    return e.withColumn("reject", F.when(~_matches(F.col("code"), REGION_CODE), "code").when(F.col("name") == "", "name"))


def parse_departments(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(place, code, name, region_code, reject); codes are upper-cased."""
    e = _entries(bodies, body).withColumn("code", F.upper("code"))
    bad = F.when(~_matches(F.col("code"), DEPARTMENT_CODE), "code").when(F.col("name") == "", "name").when(~_matches(F.col("region_code"), REGION_CODE), "region")
    return e.withColumn("reject", bad)


@dataclass
class Endpoint(InputPartition):
    name: str
    path: str


class BoundaryReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        codes = [c.strip() for c in self.options.get("departments", "").split(",") if c.strip()]
        wanted = self.options.get("lists", "regions,departments").split(",")
        lists = [Endpoint(n, p) for n, p in (("regions", REGIONS), ("departments", DEPARTMENTS)) if n in wanted]
        return [*lists, *(Endpoint("municipalities", MUNICIPALITIES.format(c)) for c in codes)]

    def read(self, partition: Endpoint):
        base = self.options["base"].rstrip("/")
        try:
            if base.startswith("http"):
                with urllib.request.urlopen(f"{base}/{partition.path}", timeout=120) as answer:
                    body = answer.read().decode("utf-8")
            else:
                with open(f"{base.removeprefix('file:')}/{partition.path.split('?')[0]}.json", encoding="utf-8") as f:
                    body = f.read()
        except urllib.error.HTTPError as e:
            raise UnavailableError(f"the provider answered {e.code}") from None
        except OSError as e:
            raise UnavailableError(f"the provider cannot be reached: {type(e).__name__}") from None
        yield partition.name, body


class BoundarySource(DataSource):
    @classmethod
    def name(cls):
        return "boundaries"

    def schema(self):
        return "endpoint string, body string"

    def reader(self, schema):
        return BoundaryReader(self.options)
