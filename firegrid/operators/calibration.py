"""Measuring many parameter sets over one corpus, with a ledger that a later run resumes.

Sets are clustered together in jobs of a few, and each job's measures are committed once it has
ended, one row a set. A job that fails is split, so only the set that fails is without a
measure; it is recorded with its error. A run measures only the sets that the ledger lacks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.functions.rules import ClusteringParams
from firegrid.operators import clustering
from firegrid.sources.sinks import exists

#: The growth that the calibration surface keeps (fixed value), and the shape of its labels.
GROWTH = 500
_LABEL = re.compile(r"calib-r(\d+)-w(\d+)-s(\d\.\d{2})")
MEASURE = "version string, events long, detections long, singletons long, multi_sensor long, largest long, in_events_of_5 long, max_diagonal_km double, median_span_h double, failed string"


def finalists(labels: str) -> list[ClusteringParams]:
    """The sets of a comma-separated list of labels, as the crossed grid names them; `calib-reference` is the published set."""
    names = [x.strip() for x in labels.split(",") if x.strip()]
    if not names or len({*names}) < len(names):
        raise ValueError("labels are missing or repeat")
    out = []
    for name in names:
        found = _LABEL.fullmatch(name)
        if found is None and name != "calib-reference":
            raise ValueError(f"no label of a parameter set: {name}")
        out.append(ClusteringParams(name) if found is None else ClusteringParams(name, int(found[1]), GROWTH, 12000, int(found[2]), float(found[3])))
    return out


def label_parameters(label: Column) -> Column:
    """struct(radius, window_h, threshold) of a label of the crossed grid; null for any other text."""
    part = lambda k: F.regexp_extract(label, f"^{_LABEL.pattern}$", k)
    found = F.struct(part(1).cast("int").alias("radius"), part(2).cast("int").alias("window_h"), part(3).cast("double").alias("threshold"))
    return F.when(label.rlike(f"^{_LABEL.pattern}$"), found)


def measures(detections: DataFrame, sets: list[ClusteringParams]) -> DataFrame:
    """One row a set: the calibration metrics of its events over `detections` (id, provider_key, acquired_at, longitude, latitude, sensor)."""
    shapes = clustering.sweep_shapes(detections, sets)
    return clustering.calibration_metrics(shapes.withColumn("span_hours", (F.unix_micros("last") - F.unix_micros("first")) / F.lit(3.6e9)))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows: measures, and failures with their error in `failed`; a set may have failed before it was measured."""
    return spark.read.schema(MEASURE).parquet(path) if exists(spark, path) else spark.createDataFrame([], MEASURE)


def missing(spark: SparkSession, path: str, sets: list[ClusteringParams]) -> list[ClusteringParams]:
    """The sets without a measure, in order. A grid has some hundred sets, so their names are few."""
    done = {r.version for r in ledger(spark, path).filter("failed is null").select("version").distinct().collect()}
    return [p for p in sets if p.version not in done]


def resume_sweep(detections: DataFrame, sets: list[ClusteringParams], path: str, together: int = 16, measure=measures) -> list[str]:
    """Measure the sets that the ledger at `path` lacks, `together` in a job; returns the names of those that failed.

    A row that is committed stays, whatever stops the run later. Two sets of one name are an error, as
    one of them would never be measured.
    """
    spark = detections.sparkSession
    if len({p.version for p in sets}) < len(sets):
        raise ValueError("parameter set versions repeat")
    left = missing(spark, path, sets)
    jobs, failed = [left[k : k + together] for k in range(0, len(left), together)], []
    columns = [c.split()[0] for c in MEASURE.split(", ")]
    while jobs:
        job = jobs.pop(0)
        try:
            found = measure(detections, job).withColumn("failed", F.lit(None).cast("string"))
            # A set whose corpus is empty has no events and still counts as measured.
            named = spark.createDataFrame([(p.version,) for p in job], "version string").join(found, "version", "left")
            named.select(*(F.col(c).cast(t) for c, t in (x.split() for x in MEASURE.split(", ")))).coalesce(1).write.mode("append").parquet(path)
        except Exception as e:  # one set's failure must not cost the others their measure
            if len(job) > 1:
                jobs = [job[: len(job) // 2], job[len(job) // 2 :], *jobs]
                continue
            failed.append(job[0].version)
            row = dict.fromkeys(columns) | {"version": job[0].version, "failed": f"{type(e).__name__}: {e}"[:300]}
            spark.createDataFrame([tuple(row[c] for c in columns)], MEASURE).write.mode("append").parquet(path)
    return failed
