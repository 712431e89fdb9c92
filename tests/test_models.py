"""Distances, clusters and anomaly scores against direct computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspectra.functions.draws import draw
from fleetspectra.operators.anomalies import anomaly_scores, expected_depth, grow_trees, score_anomalies
from fleetspectra.operators.clustering import cluster_spectra, quantile_vectors, seed_centers
from fleetspectra.operators.distances import fleet_distances, group_distances

SPECTRA = "vin string, sales_group string, interval_start double, interval_end double, `count` double"


def made(seed=1, vehicles=30, bins=12):
    """{vehicle: (group, counts per bin)} in three shapes; some bins and one whole vehicle are empty."""
    rng = np.random.default_rng(seed)
    out = {}
    for n in range(vehicles):
        counts = np.floor(40 * np.exp(-((np.arange(bins) - 2 - 4 * (n % 3)) ** 2) / 3) * rng.random(bins))
        out[f"v{n:02d}"] = ("AB"[n % 2], counts if n != 7 else counts * 0)
    return out


def rows_of(made_spectra, width=10.0):
    return [(v, g, i * width, (i + 1) * width, float(c)) for v, (g, counts) in made_spectra.items() for i, c in enumerate(counts)]


def test_distances_are_areas_between_cumulative_shares(frame):
    data = made()
    df = frame(SPECTRA, *rows_of(data)).repartition(5)
    up_to = {v: np.cumsum(c) / c.sum() for v, (_, c) in data.items() if c.sum()}
    mean = {g: np.mean([up_to[v] for v in up_to if data[v][0] == g], axis=0) for g in "AB"}
    got = {r.vin: (r.sales_group, r.distance) for r in fleet_distances(df, ["sales_group"]).collect()}
    assert got.keys() == up_to.keys()
    for v, (g, d) in got.items():
        assert g == data[v][0] and d == pytest.approx(10 * np.abs(up_to[v] - mean[g]).sum())
    [pair] = group_distances(df).collect()
    assert (pair.group_a, pair.group_b) == ("A", "B") and pair.distance == pytest.approx(10 * np.abs(mean["A"] - mean["B"]).sum())


def test_distance_moves_all_load_once(frame):
    rows = [(v, "g", i * 10.0, i * 10.0 + 10, float(i == at)) for v, at in (("a", 0), ("b", 4)) for i in range(5)]
    got = fleet_distances(frame(SPECTRA, *rows)).collect()
    assert [r.distance for r in got] == [20.0, 20.0]  # half of each vehicle's load, 40 units apart, is the fleet's
    assert fleet_distances(frame(SPECTRA, *rows).where("false")).collect() == []


def plain_vector(counts, levels, width=10.0):
    shares = np.cumsum(counts) / counts.sum()
    return [width * int(np.argmax(shares >= (j + 0.5) / levels)) + width / 2 for j in range(levels)]


def test_quantile_vectors(frame):
    data = made(3)
    got = {r.vin: r.q for r in quantile_vectors(frame(SPECTRA, *rows_of(data)), 8).collect()}
    assert got == {v: plain_vector(c, 8) for v, (_, c) in data.items() if c.sum()}


def plain_rounds(vectors, centers):
    """Assignments and medians until nothing moves."""
    while True:
        near = {v: min((np.abs(np.array(q) - c).mean(), k) for k, c in centers.items()) for v, q in vectors.items()}
        moved = {}
        for k, c in centers.items():
            members = sorted(v for v in near if near[v][1] == k)
            moved[k] = np.sort([vectors[v] for v in members], axis=0)[(len(members) - 1) // 2] if members else c
        if all((moved[k] == centers[k]).all() for k in centers):
            return near, moved
        centers = moved


def test_clusters_equal_plain_k_medians(frame):
    data = made(5, 40)
    df = frame(SPECTRA, *rows_of(data)).repartition(4)
    vectors = {v: plain_vector(c, 20) for v, (_, c) in data.items() if c.sum()}
    seeds = seed_centers(quantile_vectors(df), 3)
    start = {r.cluster: np.array(r.q) for r in seeds.collect()}
    assert sorted(start) == [1, 2, 3] and all(list(q) in vectors.values() for q in start.values())
    near, medians = plain_rounds(vectors, start)
    found = cluster_spectra(df, 3, columns=["sales_group"])
    assert {r.vin: (round(r.distance, 9), r.cluster) for r in found.vehicles.collect()} == {v: (round(d, 9), k) for v, (d, k) in near.items()}
    assert {r.cluster: r.q for r in found.centers.collect()} == {k: list(q) for k, q in medians.items()}
    assert sum(r.vehicles for r in found.centers.collect()) == len(vectors)
    assert {r.vin: r.sales_group for r in found.vehicles.collect()} == {v: data[v][0] for v in vectors}
    # The three shapes are the three clusters, and a second run is the same.
    assert len({(int(v[1:]) % 3, k) for v, (_, k) in near.items()}) == 3
    again = cluster_spectra(df.repartition(3), 3)
    assert sorted((r.vin, r.cluster) for r in again.vehicles.collect()) == sorted((v, k) for v, (_, k) in near.items())


def test_clusters_from_given_centers_and_few_vehicles(frame, spark):
    df = frame(SPECTRA, *rows_of(made(2, 6)))
    given = spark.createDataFrame([(1, [25.0] * 20), (9, [1e9] * 20)], "cluster int, q array<double>")
    found = cluster_spectra(df, 2, centers=given)
    assert {r.cluster for r in found.vehicles.collect()} == {1}
    assert {r.cluster: r.vehicles for r in found.centers.collect()}[9] == 0
    one = frame(SPECTRA, *rows_of(made(2, 1)))
    assert cluster_spectra(one, 4).centers.count() == 1  # no more clusters than different spectra


def plain_path(x, nodes, tree):
    at = 1
    while (of := nodes[tree, at])[0] is not None:
        at = 2 * at + (x[of[0]] is not None and x[of[0]] >= of[1])
    return of[3]


def test_anomaly_scores_by_walking_down_the_trees(spark):
    rng = random.Random(4)
    rows = [(f"v{n}", rng.uniform(40, 60), rng.uniform(8, 12), None if n % 20 == 3 else rng.random()) for n in range(300)]
    rows += [("odd1", 300.0, 60.0, 5.0), ("odd2", -100.0, -30.0, -5.0), ("nan", float("nan"), 10.0, float("inf"))]
    df = spark.createDataFrame(rows, "vin string, a double, b double, c double").repartition(5)
    columns = ["a", "b", "c"]
    nodes = grow_trees(df, columns, trees=60, sample=64)
    table = {(r.tree, r.node): (r.feature, r.split, r.n, r.path) for r in nodes.collect()}
    for (tree, node), (feature, _, n, _) in table.items():
        if feature is not None:
            assert table[tree, 2 * node][2] + table[tree, 2 * node + 1][2] == n
    got = {r.vin: r.anomaly_score for r in score_anomalies(df, nodes, columns).collect()}
    trees = sorted({t for t, n in table if n == 1 and table[t, 1][2] > 1})
    for vin, *x in rows:
        x = [None if v is None or not math.isfinite(v) else v for v in x]
        paths = [plain_path(x, table, t) / expected_depth(table[t, 1][2]) for t in trees]
        assert got[vin] == pytest.approx(2 ** -np.mean(paths), rel=1e-12)
    ranked = sorted((v for v in got if v != "nan"), key=got.get, reverse=True)
    assert set(ranked[:2]) == {"odd1", "odd2"}
    again = anomaly_scores(df.repartition(2), columns, trees=60, sample=64)
    assert {r.vin: r.anomaly_score for r in again.collect()} == got


def test_anomaly_scores_of_hardly_any_rows(spark):
    one = spark.createDataFrame([("a", 1.0)], "vin string, x double")
    assert [r.vin for r in anomaly_scores(one, ["x"], trees=3, sample=4).collect()] == ["a"]
    assert anomaly_scores(one.where("false"), ["x"], trees=3, sample=4).collect() == []


def test_draws_are_even_and_repeatable(spark):
    got = spark.range(4000).select(draw(F.col("id"), 7).alias("u"), draw(F.col("id"), 8).alias("w")).toPandas()
    assert 0 <= got.u.min() and got.u.max() < 1 and abs(got.u.mean() - 0.5) < 0.02 and abs(got.u.corr(got.w)) < 0.05
