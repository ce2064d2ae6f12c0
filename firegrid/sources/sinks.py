"""Idempotent sinks over DataFrames: anti-join appends, upserts with actions, run ledger."""

from __future__ import annotations

import time
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

DETECTION_KEY = ["provider_key", "acquired_at"]


def new_rows(batch: DataFrame, existing: DataFrame | None, key: list[str] = DETECTION_KEY) -> DataFrame:
    """Rows of the batch whose key is not stored yet, once for each key."""
    first = Window.partitionBy(*key).orderBy(*(F.col(c).asc_nulls_last() for c in batch.columns if c not in key and dict(batch.dtypes)[c] in ("string", "double", "bigint", "int")), *key)
    once = batch.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return once if existing is None else once.join(existing.select(*key), key, "left_anti")


def append_detections(batch: DataFrame, path: str) -> DataFrame:
    """Append the new rows below `path`, partitioned by month; the stored table is returned.

    Reruns add nothing. The read is pruned to the months of the batch.
    """
    spark = batch.sparkSession
    month = F.date_format("acquired_at", "yyyy-MM")
    batch = batch.withColumn("acq_month", month)
    existing = None
    if exists(spark, path):
        stored = spark.read.parquet(path)
        existing = stored.join(batch.select("acq_month").distinct(), "acq_month", "left_semi")
    new_rows(batch, existing).write.mode("append").partitionBy("acq_month").parquet(path)
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def between_times(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of [start, end), with the predicate on the month partitions that Spark cannot infer."""
    return df.filter(
        (F.col("acq_month") >= F.lit(start[:7])) & (F.col("acq_month") <= F.lit(end[:7]))
        & (F.col("acquired_at") >= F.lit(start).cast("timestamp")) & (F.col("acquired_at") < F.lit(end).cast("timestamp"))
    )


def upsert(current: DataFrame, staged: DataFrame, key: str, keep: list[str] = ()) -> DataFrame:
    """Full outer merge: staged values win, except the columns `keep`, which stored rows never lose."""
    columns = [c for c in current.columns if c != key]
    a, b = current.alias("a"), staged.alias("b")
    merged = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    stored, fresh = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    pick = lambda c: F.when(fresh & ~(stored & F.lit(c in keep)), F.col(f"b.{c}") if c in staged.columns else F.col(f"a.{c}")).otherwise(F.col(f"a.{c}"))
    return merged.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(pick(c).alias(c) for c in columns), F.when(stored & fresh, "update").when(fresh, "insert").otherwise("keep").alias("action"))


def publish_validity(current: DataFrame, staged: DataFrame, key: str, today: str) -> DataFrame:
    """upsert() of validity-dated rows: absent current rows are retired (valid_to = today), returning ones revived.

    A row that became valid today cannot be retired today; its action is reject_retire.
    """
    merged = upsert(current, staged.withColumn("valid_to", F.lit(None).cast("date")), key, keep=["valid_from"])
    gone = (F.col("action") == "keep") & F.col("valid_to").isNull()
    can = F.coalesce(F.col("valid_from") < F.lit(today).cast("date"), F.lit(True))
    return merged.withColumn("action", F.when(gone & can, "retire").when(gone, "reject_retire").otherwise(F.col("action"))).withColumn(
        "valid_to", F.when(F.col("action") == "retire", F.lit(today).cast("date")).otherwise(F.col("valid_to"))
    )


@contextmanager
def import_run(spark: SparkSession, path: str, source: str, job: str):
    """A row in the run ledger: counters are filled in by the block, and any exit closes the run."""
    run = {"source_key": source, "job": job, "status": "success", "started_at": datetime.now(UTC), "records_read": 0, "records_rejected": 0, "error": None, "source_data_at": None}
    try:
        yield run
        if run["status"] == "success" and run["records_rejected"] > 0:
            run["status"] = "partial"
    except Exception as e:
        run["status"], run["error"] = "failed", str(e)[:500]
        raise
    finally:
        run["finished_at"] = datetime.now(UTC)
        schema = "source_key string, job string, status string, started_at timestamp, records_read long, records_rejected long, error string, source_data_at timestamp, finished_at timestamp"
        spark.createDataFrame([tuple(run[c.split()[0]] for c in schema.split(", "))], schema).coalesce(1).write.mode("append").parquet(path)


class Busy(RuntimeError):
    """Another run holds the lease."""


@contextmanager
def exclusive(spark: SparkSession, folder: str, owner: str, seconds: float, now=time.time):
    """Hold the lease of `folder` while the body runs; raises Busy where another owner's lease has not expired.

    Leases are numbered files, each with owner and expiry; the highest number counts. Taking one over, extending
    and giving it back all create the next number, which the file system does for one caller only,
    so two runs that see an expired lease cannot both get it. A file that is still empty counts as held.
    The yielded function extends the lease; it raises Busy if the lease was lost meanwhile.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(root)

    def newest() -> tuple[int, str, float]:
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        number = max((int(n.removeprefix("lease-")) for n in names if n.startswith("lease-")), default=0)
        if not number:
            return 0, "", 0.0
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(root, f"lease-{number}"))
        try:
            words = bytes(stream.readAllBytes()).decode().split("\n")
        finally:
            stream.close()
        return (number, words[0], float(words[1])) if len(words) == 3 else (number, "", float("inf"))

    def write(number: int, until: float) -> None:
        try:
            out = fs.create(jvm.org.apache.hadoop.fs.Path(root, f"lease-{number}"), False)
        except Exception as e:  # another caller has made this number
            raise Busy(f"lease {number} of {folder} is taken") from e
        out.write(f"{owner}\n{until}\n".encode())
        out.close()
        for old in range(max(1, number - 3), number - 1):
            fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"lease-{old}"), False)

    number, holder, until = newest()
    if until > now():
        raise Busy(f"{holder or 'another run'} holds {folder} until {until}")
    held = number + 1
    write(held, now() + seconds)

    def extend() -> None:
        nonlocal held
        if newest()[0] != held:
            raise Busy(f"the lease of {folder} was lost")
        held += 1
        write(held, now() + seconds)

    try:
        yield extend
    finally:
        if newest()[0] == held:
            write(held + 1, 0.0)


def calibration_guard(calibration_root: str, serving_root: str) -> None:
    """Refuse to calibrate into the served tables."""
    if calibration_root.rstrip("/") == serving_root.rstrip("/") or calibration_root.startswith(serving_root.rstrip("/") + "/"):
        raise ValueError("calibration output must lie outside the served tables")


SENSITIVE = ("key", "token", "secret", "password", "authorization")


def redact(df: DataFrame, sensitive: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """Mask what stands under a sensitive name at any depth: columns, fields of structs, keys of maps, also within arrays.

    A name is sensitive if it holds one of the words in any case. The walk follows the schema,
    so each value is rewritten by expressions alone; nulls stay null, and a masked value that is no
    string becomes null, as its type has no mask.
    """
    pattern = "(?i)(" + "|".join(sensitive) + ")"
    hit = lambda name: any(s in name.lower() for s in sensitive)

    def mask(kind: DataType, value: Column) -> Column:
        if isinstance(kind, StringType):
            return F.when(value.isNotNull(), "[redacted]")
        return F.lit(None).cast(kind)

    def held(kind: DataType) -> bool:
        """Whether a sensitive name can stand anywhere within the type."""
        if isinstance(kind, StructType):
            return any(hit(f.name) or held(f.dataType) for f in kind.fields)
        if isinstance(kind, ArrayType):
            return held(kind.elementType)
        return isinstance(kind, MapType) and (isinstance(kind.keyType, StringType) or held(kind.valueType))

    def clean(kind: DataType, value: Column) -> Column:
        if not held(kind):
            return value
        if isinstance(kind, StructType):
            fields = [(mask if hit(f.name) else clean)(f.dataType, value.getField(f.name)).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda x: clean(kind.elementType, x))
        inner = lambda k, v: clean(kind.valueType, v)
        if isinstance(kind.keyType, StringType):
            inner = lambda k, v: F.when(k.rlike(pattern), mask(kind.valueType, v)).otherwise(clean(kind.valueType, v))
        return F.transform_values(value, inner)

    return df.select(*((mask if hit(f.name) else clean)(f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields))
