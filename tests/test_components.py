import random

import pytest
from pyspark.sql import functions as F

from symloom.operators import components, skew, walk


def brute(edges, nodes):
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("seed", range(2))
def test_components_and_layers_equal_mutual_reach(spark, seed):
    rng = random.Random(seed)
    n = 14
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([14, 20]))]
    want = brute(edges, range(n))
    df = spark.createDataFrame([*edges, edges[0], (None, 1), (2, None)], "src long, dst long")
    parts = components.components(df, spark.range(n).withColumnRenamed("id", "nid"))
    got = parts.collect()
    assert {r["node"]: r["component"] for r in got} == want and all(r["size"] == list(want.values()).count(r["component"]) for r in got) and len(got) == n
    layer = {r["component"]: r["layer"] for r in components.layers(df, parts).collect()}
    assert set(layer) == set(want.values()) and all(layer[want[a]] > layer[want[b]] for a, b in edges if want[a] != want[b])


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src long, dst long")
    parts = components.components(none)
    assert parts.count() == 0 and components.layers(none, parts).count() == 0


def test_many_goals_and_a_hub_in_parts(spark):
    """Over 200,000 goals are all met; the steps of a hub are split into parts of like size, the same ones each time."""
    n = 200_500
    text = F.lit(None).cast("string")
    steps = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("node"), F.col("id").alias("peer"), F.col("id").alias("edge"), F.lit(False).alias("spawns"), F.lit(False).alias("raises"), F.lit(2).alias("conf"), text.alias("condition"), text.alias("confidence"))
    seeds = spark.createDataFrame([(0, 0)], "root long, node long")
    goals = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("root"), F.col("id").alias("node"))
    assert walk.bfs(steps, seeds, None, goals).join(goals, ["root", "node"], "left_semi").count() == n
    assert walk.reached(steps, seeds, most=1).count() == n + 1
    roots = spark.range(1000).select(F.col("id").alias("root"), F.lit(0).cast("long").alias("node"))
    hot = skew.hot_keys(steps, ["node"])
    assert hot == [(0,)]
    few = steps.where("edge <= 640")
    salt = F.pmod(F.xxhash64(*few.columns), F.lit(skew.SALTS))
    parts = [r["count"] for r in few.groupBy(salt.alias("p")).count().collect()]
    assert max(parts) <= 3 * sorted(parts)[len(parts) // 2]
    assert skew.lookup_join(few, roots, ["node"], "inner", hot).count() == 640 * 1000
