"""Every query with an oracle against DuckDB on the smallest tables; the others run."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from firegrid.plans import registry  # noqa: E402

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        return round(float(v), 9) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted({*QUERIES} - {*ORACLES}))
def test_runs(spark, name):
    """Without SQL: tests of their operators compare their rows; here they run whole, twice alike."""
    first, again = (QUERIES[name](spark, DATA).toPandas() for _ in range(2))
    assert len(first) > 0 and rows(first) == rows(again)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_clusters_hold_every_public_detection_once(spark):
    """x1 against the rule applied in sequence over the whole table, and its signature."""
    import numpy as np

    from firegrid.functions.rules import REFERENCE
    from firegrid.operators import clustering
    from firegrid.sources import fixtures

    det = fixtures.detections(spark, DATA).filter("is_public").toPandas().sort_values(["acquired_at", "provider_key"], kind="stable", ignore_index=True)
    micros = det["acquired_at"].astype("datetime64[us]").astype("int64").to_numpy()
    events, scores = clustering.attach(det["longitude"].to_numpy(), det["latitude"].to_numpy(), micros, det["provider_key"].tolist(), [None] * len(det), REFERENCE)
    got = {r.id: (r.event_id, r.score) for r in QUERIES["x1_clusters"](spark, DATA).collect()}
    assert got == {i: (e, round(s, 6)) for i, e, s in zip(det["id"], events, np.round(scores, 6), strict=True)}
    assert QUERIES["a24_partition_signature"](spark, DATA).first().events == len({*events})


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_snapshots_hold_the_visible_events(spark, duck):
    """q13: one snapshot an event that is not hidden, and its payload's fields."""
    import json

    found = {r.event_key: json.loads(r.payload) for r in QUERIES["q13_snapshots"](spark, DATA).collect()}
    wanted = duck.execute(ORACLES["q14_snapshot_first"]).fetchall()
    assert {*found} == {k for k, _ in wanted} and all((v["detection_count"] > 1) == (dict(wanted)[k] == "snapshot") for k, v in found.items())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_every_detection_has_its_cell_component(spark):
    from firegrid.sources import fixtures

    cells = {(math.floor(r.longitude / 0.004), math.floor(r.latitude / 0.004)) for r in fixtures.detections(spark, DATA).select("longitude", "latitude").collect()}
    low, left = {}, set(cells)
    while left:
        todo, group = [left.pop()], []
        while todo:
            x, y = todo.pop()
            group.append((x, y))
            near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        low |= dict.fromkeys(group, min(group))
    got = {(r.cell_x, r.cell_y): r.z for r in QUERIES["x7_all_cell_components"](spark, DATA).collect()}
    assert got == {c: x * 1000000 + y for c, (x, y) in low.items()}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_every_detection_is_resolved(spark):
    from firegrid.sources import fixtures

    assert QUERIES["q9_resolve_municipality"](spark, DATA).count() == fixtures.detections(spark, DATA).count()


def test_keys_beyond_the_old_bounds_stay(spark, tmp_path):
    keys = [1, 499, 500, 84999, 85000, 89999, 90000, 250000]
    spark.createDataFrame([(k, k + 1, f"c{k}") for k in keys], "o_orderkey long, o_custkey long, c_name string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, f"c{k}") for k in keys], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    assert sorted(r.k for r in QUERIES["s9_all_warnings"](spark, str(tmp_path)).collect()) == keys
    got = {r.name: r.insee_code for r in QUERIES["s12_all_geojson"](spark, str(tmp_path)).collect()}
    assert got == {f"c{k}": f"{(10000 + k) % 100000:05d}" for k in keys}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_every_order_is_a_bulletin(spark, duck):
    """Row by row, as nulls in whole numbers have no place in test_oracle's frames."""
    sql = """WITH x AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders) SELECT k, lpad((c % 95)::VARCHAR, 2, '0') AS department, c % 2 = 1 AS is_coastal, (k % 9 + 1)::INT AS phenomenon_id, ['vert', 'jaune', 'orange', 'rouge'][(k % 4 + 1)::INT] AS colour FROM x WHERE k % 10 <> 0 AND k % 7 <> 0
  UNION ALL SELECT k, NULL, false, NULL, NULL FROM x WHERE k % 10 = 0 UNION ALL SELECT k, lpad((c % 95)::VARCHAR, 2, '0'), c % 2 = 1, (k % 9 + 1)::INT, NULL FROM x WHERE k % 10 <> 0 AND k % 7 = 0"""
    got = QUERIES["s9_all_warnings"](spark, DATA).select("k", "department", "is_coastal", "phenomenon_id", "colour").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(duck.execute(sql).fetchall(), key=repr)
    assert len(got) == len(duck.execute("select 1 from orders").fetchall())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_whole_corpus_is_ordered(spark):
    got = [r.position for r in QUERIES["o1_whole_order"](spark, DATA).collect()]
    assert got == list(range(1, QUERIES["x9_corpus_merge"](spark, DATA).count() + 1)) and len(got) > 100


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_slices_replay_to_the_same_partition(spark):
    assert [r.equals_one_pass for r in QUERIES["x6_replay_in_slices"](spark, DATA).collect()] == [True]
