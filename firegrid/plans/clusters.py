"""Queries over the clustering: rows and figures that SQL cannot express."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from firegrid.operators import calibration, clustering
from firegrid.operators.graph import shared_folder
from firegrid.plans.registry import query
from firegrid.sources import fixtures as fx


def _public(spark, d):
    return fx.detections(spark, d).filter("is_public")


@query("x1_clusters")
def x1(spark, d):
    return clustering.cluster(_public(spark, d)).select("id", "event_id", F.round("score", 6).alias("score"))


@query("a24_partition_signature")
def a24(spark, d):
    return clustering.partition_signature(clustering.cluster(_public(spark, d)))


@query("x12_sweep")
def x12(spark, d):
    """The whole one-axis sweep; crossed_grid() is run the same way."""
    return calibration.measures(_public(spark, d), clustering.axis_grid())


@query("x12_resumed_sweep")
def x12_resumed(spark, d):
    """Two runs over one ledger: the first measures four sets of which one fails, the second only that one, mended."""
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    good, broken = calibration.finalists("calib-r2500-w24-s0.35,calib-r1000-w6-s0.65,calib-reference"), "calib-r5000-w48-s0.20"
    runs = []
    for number, last in enumerate((clustering.ClusteringParams(broken, attach_window_hours=float("nan")), *calibration.finalists(broken)), 1):
        before = calibration.ledger(spark, path).count()
        calibration.resume_sweep(_public(spark, d), [*good, last], path)
        runs.append((number, before))
    rows = calibration.ledger(spark, path).withColumn("status", F.when(F.col("failed").isNull(), "measured").otherwise("failed"))
    return rows.drop("failed").withColumn("ledger_rows_before_second_run", F.lit(runs[1][1]))
