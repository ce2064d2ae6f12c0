"""

public here, so the rows are drawn anew: fires that last some hours and drift, and single heat spots.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from firegrid.operators import clustering
from firegrid.sources.sinks import append_detections

SIZES = (932, 16_544, 337_757)


def generated(rows: int, seed: int = 1) -> pd.DataFrame:
    """Detections of `rows` rows: about one fire to 25 rows and as many single spots as a tenth of the rows, over 90 days for each 1000 rows up to 14 years."""
    rng = np.random.default_rng(seed)
    fires = max(1, rows // 25)
    days = min(14 * 365, 90 * max(1, rows / 1000))
    share = rng.pareto(1.2, fires) + 0.05
    of = rng.choice(fires, rows - rows // 10, p=share / share.sum())
    lon0, lat0, t0 = rng.uniform(4, 8, fires), rng.uniform(42.5, 45, fires), rng.uniform(0, days * 86400, fires)
    late = rng.exponential(3 * 3600, len(of))
    spots = rows // 10
    lon = np.concatenate([lon0[of] + rng.normal(0, 0.008, len(of)) + late / 3600 * 0.001, rng.uniform(4, 8, spots)])
    lat = np.concatenate([lat0[of] + rng.normal(0, 0.006, len(of)), rng.uniform(42.5, 45, spots)])
    at = np.concatenate([t0[of] + late, rng.uniform(0, days * 86400, spots)]).astype("int64")
    key = [f"k{i:07d}" for i in range(rows)]
    return pd.DataFrame({"id": key, "provider_key": key, "acquired_at": pd.to_datetime(1_300_000_000 + at, unit="s"), "longitude": lon, "latitude": lat})


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench-clustering").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for rows in map(int, sys.argv[1:] or SIZES):
        frame = spark.createDataFrame(generated(rows)).repartition(int(cpus)).cache()
        frame.count()
        figures = {}

        def timed(name, act, figures=figures):
            began = time.time()
            result = act()
            figures[name] = round(time.time() - began, 2)
            print(name, figures[name], file=sys.stderr, flush=True)
            return result

        events = timed("one_set_s", lambda: clustering.cluster(frame).agg(F.count_distinct("event_id")).first()[0])  # noqa: B023
        timed("one_axis_sweep_8_sets_s", lambda: clustering.sweep(frame, clustering.axis_grid()).count())  # noqa: B023
        if rows < 100_000:
            timed("crossed_sweep_112_sets_s", lambda: clustering.sweep(frame, clustering.crossed_grid()).count())  # noqa: B023
        path = os.path.join(tempfile.mkdtemp(prefix="bench-load-"), "detections")
        timed("load_s", lambda: append_detections(frame, path).count())  # noqa: B023
        out[str(rows)] = figures | {"events": events}
        print(rows, out[str(rows)], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "clustering and load on generated detections", "sizes": out}))
    spark.stop()


if __name__ == "__main__":
    main()
