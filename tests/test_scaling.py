"""Plans whose bytes on the driver, task memory or shuffles must not grow with the input."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from porespark.operators import analysis, graph, network
from porespark.plans import ordering


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that the loops of ``graph`` store."""
    seen, cut = [], graph.cut

    def noted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)
    monkeypatch.setattr(graph, "cut", noted)
    return seen


def _chain(spark):
    return spark.createDataFrame([(1, i, i + 1) for i in range(9)] + [(2, 5, 6)], "ms_id long, u long, v long")


def test_component_rounds_broadcast_nothing(spark, plans):
    rows = {(r.ms_id, r.node): r.component for r in graph.components(_chain(spark)).collect()}
    assert rows == {**{(1, i): 0 for i in range(10)}, (2, 5): 5, (2, 6): 5}
    assert plans and not any("Broadcast" in p for p in plans)


def test_boundary_filter_broadcasts_nothing(spark, plans):
    ends = spark.createDataFrame([(1, i, i == 0, i == 9) for i in range(10)] + [(1, 20, False, False)],
                                 "ms_id long, body_id long, is_inlet boolean, is_outlet boolean")
    links = _chain(spark).filter("ms_id = 1").select("ms_id", F.col("u").alias("i"), F.col("v").alias("j"))
    rows = {r.body_id: r.active for r in graph.boundary_connected(links, ends).collect()}
    assert rows == {**{i: True for i in range(10)}, 20: False}
    assert plans and not any("Broadcast" in p for p in plans)


def test_network_components_broadcast_nothing(spark, plans):
    flat = _chain(spark).select("ms_id", F.col("u").alias("i"), F.col("v").alias("j"))
    assert network.network_components(flat).select("component").distinct().count() == 2
    assert plans and not any("Broadcast" in p for p in plans)


def test_windows_get_tasks_by_rows(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 300).alias("g"), F.xxhash64("id").alias("v"), "id")
    orders = {"a": [F.col("v").asc(), F.col("id").asc()], "b": [F.col("v").desc(), F.col("id").asc()]}

    def run():
        placed = ordering.with_positions(df, ["g"], orders)
        placed = ordering.with_position(placed, ["g"], orders["a"], "c")
        placed = ordering.with_average_rank(placed, ["g"], "v", ["id"], "r")
        return ordering.with_running_sum(placed, ["g"], [F.col("id")], "id", "s")
    plain = sorted(map(tuple, run().collect()))
    quantiles = sorted(map(tuple, ordering.group_quantiles(df, ["g"], "v", {"m": 0.5}, ["id"]).collect()))
    monkeypatch.setattr(ordering, "TASK_ROWS", 100)
    assert run().rdd.getNumPartitions() == math.ceil(3000 / 100)
    assert sorted(map(tuple, run().collect())) == plain
    assert sorted(map(tuple, ordering.group_quantiles(df, ["g"], "v", {"m": 0.5}, ["id"]).collect())) == quantiles


@pytest.mark.parametrize("leaf", [1, 16])
def test_small_groups_are_compared_in_their_task(spark, monkeypatch, leaf):
    rng = np.random.default_rng(3)
    rows = [(g, 100 * g + i, *map(float, rng.integers(0, 4, 3))) for g in range(30) for i in range(int(rng.integers(1, 12)))]
    rows += [(40, 1, 0.0, 0.0, 0.0), (40, 2, -0.0, 0.0, 0.0), (41, 1, 1.0, 1.0, 1.0), (42, 1, None, 1.0, 1.0), (42, 2, None, 1.0, 1.0)]
    stored, cut = [], analysis.cut
    monkeypatch.setattr(analysis, "cut", lambda df: stored.append(1) or cut(df))
    df = spark.createDataFrame(rows, "g long, i long, a double, b double, c double")
    found = {(r.g, r.i): r.nn for r in analysis.nearest_neighbours(df, ["g"], "i", ["a", "b", "c"], leaf).collect()}
    want = {}
    for g, i, *p in rows:
        others = [math.dist(p, q) for h, j, *q in rows if h == g and j != i and None not in p + q]
        if others:
            want[g, i] = min(others)
    assert found == pytest.approx(want)
    if leaf == 16:
        assert len(stored) == 2  # the points and the list of larger groups


@pytest.mark.parametrize("points", [4, 50_000])
def test_draws_are_no_rows_of_a_broadcast(spark, monkeypatch, points):
    """What is broadcast has a row per sample at most, whatever the number of draws, and the choice stays the same."""
    df = spark.createDataFrame([(g, i) for g in range(30) for i in range(3 + g % 5)] + [(None, 1)], "ms_id long, throat_id long")
    sizes = df.groupBy("ms_id").agg(F.count(F.lit(1)).alias("n_total")).withColumn("n_pick", F.col("n_total") - 2)
    want = sorted((g, d, i) for g in range(30) for d in range(40)
                  for _, i in sorted((hashlib.md5(f"2:{d}:{g}:{i}".encode()).hexdigest(), i) for i in range(3 + g % 5))[:1 + g % 5])
    assert sorted(map(tuple, analysis.drawn_subsets(df, sizes, "throat_id", 40, 2).collect())) == want
    stored, cut = [], analysis.cut
    monkeypatch.setattr(analysis, "cut", lambda df: stored.append(df) or cut(df))
    monkeypatch.setattr(analysis, "FEW_ROWS", 20, raising=False)
    monkeypatch.setattr(analysis, "TASK_POINTS", points, raising=False)
    assert sorted(map(tuple, analysis.drawn_subsets(df, sizes, "throat_id", 40, 2).collect())) == want
    assert stored[0].count() == 30  # pending: a row per sample, not one per draw
    plan = stored[1]._jdf.queryExecution().executedPlan().toString()
    assert ("Broadcast" in plan) == (points == 4)  # only for samples of many points, which are few
