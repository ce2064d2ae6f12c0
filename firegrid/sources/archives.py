"""Zip and CSV archives of a folder: rows with their file, and provenance."""

from __future__ import annotations

import csv
import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.operators.corpus import corpus_label
from firegrid.sources.providers import FIELDS, read_csv

#: Rows of an archive member that leave the task at once.
BATCH_ROWS = 10_000
NAMES = ("acq_date", "acq_time", "latitude", "longitude", *(f for f in FIELDS if f not in ("acq_date", "acq_time", "latitude", "longitude")), "bright_t31", "bright_ti5")


def _binary(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def _members(batches):
    """The rows of all members `fire_*` of zip files, all fields as text; a member is read as a stream."""
    columns = ["source_file", *NAMES]
    for batch in batches:
        for content in batch.column("content").to_pylist():
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in sorted(n for n in z.namelist() if n.startswith("fire_")):
                    with z.open(name) as raw:
                        rows = []
                        for row in csv.DictReader(io.TextIOWrapper(raw, encoding="utf-8", newline="")):
                            rows.append({"source_file": name} | {c: row.get(c) for c in NAMES})
                            if len(rows) == BATCH_ROWS:
                                yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.string()) for c in columns]))
                                rows = []
                        yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.string()) for c in columns]))


def _listed(batches):
    for batch in batches:
        names, sizes, found = [], [], []
        for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in z.infolist():
                    if info.filename.startswith("fire_"):
                        names.append(name)
                        found.append(info.filename)
                        sizes.append(info.file_size)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string()), pa.array(sizes, pa.int64())], ["archive", "member", "bytes"])


def members(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, member, bytes) of the `fire_*` members of the folder's zip files."""
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return _binary(spark, folder, "*.zip").select(name, "content").mapInArrow(_listed, "archive string, member string, bytes long")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all `fire_*` files of a folder, zipped or not, with source_file and corpus.

    A loose file whose name is also a member of a zip file is left out. An empty folder fails.
    """
    schema = ", ".join(f"{c} string" for c in ("source_file", *NAMES))
    zipped = _binary(spark, folder, "*.zip").select("content").mapInArrow(_members, schema)
    loose = _binary(spark, folder, "fire_*.csv").select(F.element_at(F.split("path", "/"), -1).alias("name"))
    inside = members(spark, folder).select(F.col("member").alias("name")).distinct()
    if loose.isEmpty() and inside.isEmpty():
        raise ValueError(f"no fire_* file in {folder}, zipped or not")
    out = zipped
    if not loose.isEmpty():
        rows = read_csv(spark, f"{folder}/fire_*.csv")
        rows = rows.select("source_file", *(F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in NAMES))
        out = out.unionByName(rows.join(inside.select(F.col("name").alias("source_file")), "source_file", "left_anti"))
    return out.withColumn("corpus", corpus_label(F.col("source_file")))


def provenance(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256, members) of every zip and CSV file of a folder, by name."""
    listed = members(spark, folder).groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("member", "bytes"))).alias("members"))
    name = F.element_at(F.split("path", "/"), -1)
    files = _binary(spark, folder, "*.{zip,csv}").select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    files = files.filter(F.col("file").endswith(".zip") | F.col("file").startswith("fire_"))
    return files.join(listed, files.file == listed.archive, "left").drop("archive").orderBy("file")
