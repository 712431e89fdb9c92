import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspectra.operators.comparison import (
    box_stats,
    radar_profile,
    stat_histogram,
    weighted_fleet_average,
)
from fleetspectra.operators.cohort import extract_signals
from fleetspectra.operators.fleet import fleet_average, fleet_before_after, vehicle_vs_fleet, weighted_mean
from fleetspectra.operators.outliers import (
    completeness_outliers,
    iqr_bounds,
    iqr_outliers,
    mileage_outliers,
    outlier_vins,
    removal_summary,
    removal_totals,
    remove_outliers,
    removed_vins,
    weight_matrix,
    weight_shares,
    zero_mass_outliers,
)
from fleetspectra.operators import quantiles
from fleetspectra.operators.quantiles import grouped_quantiles
from fleetspectra.operators.statistics import SignalNames, vehicle_stats

STATS = "vin string, sales_group int, distance_via_speed_km double, vehicle_speed_avg_driving_kmh double"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# --- quantiles ----------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_equal_the_exact_ones(spark, seed):
    rng = random.Random(seed)
    data = []
    for group, n in (("a", 1), ("b", 4), ("c", 101), ("d", 20000)):
        for _ in range(n):
            data.append((group, rng.choice([rng.gauss(0, 1), 0.5, 7.0, 1e12 * rng.random()])))
    data += [("a", None), ("b", float("nan")), ("only nulls", None)]
    df = spark.createDataFrame(data, "g string, x double")
    probs = {"p0": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "p99": 0.99, "p100": 1.0}
    got = grouped_quantiles(df, "x", probs, ["g"], accuracy=100)
    want = df.where("x IS NOT NULL AND NOT isnan(x)").groupBy("g").agg(
        *[
            F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY x)").alias(name)
            for name, p in probs.items()
        ]
    )
    assert rows_of(got) == rows_of(want)


def test_quantiles_without_groups(frame):
    df = frame("x double", *[(float(v),) for v in (4, 1, 3, 2)])
    assert rows_of(grouped_quantiles(df, "x", {"a": 0.25, "b": 0.75})) == [(1.0, 3.0)]
    assert rows_of(grouped_quantiles(df.limit(0), "x", {"a": 0.25})) == []


def test_quantiles_of_one_value_repeated(spark):
    df = spark.range(50000).select(
        F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 7).alias("x")
    )
    got = grouped_quantiles(df, "x", {"m": 0.5, "p": 0.001}, ["g"], accuracy=50).first()
    values = np.sort(df.toPandas().x.to_numpy())
    assert (got.m, got.p) == (values[24999], values[49])


def test_quantiles_put_no_group_in_one_task(frame, plan):
    df = frame("g string, x double", ("a", 1.0))
    text = plan(grouped_quantiles(df, "x", {"m": 0.5}, ["g"]))
    assert "Window" not in text and " percentile(" not in text


@pytest.mark.parametrize("edges", ["good", "first", "last", "same"])
def test_quantiles_do_not_depend_on_the_sketch(spark, monkeypatch, edges):
    """Many narrowings, null groups, ties, infinities; a sketch that proposes poor values only makes it slower."""
    rng = random.Random(11)
    data = [(rng.choice("ab") if i % 9 else None, rng.choice([float(rng.randint(0, 9)), rng.random(), -1e300])) for i in range(3000)]
    data += [("c", float(v)) for v in (1, 1, 2, 2)] + [("a", float("inf")), ("b", float("-inf"))]
    df = spark.createDataFrame(data, "g string, x double").repartition(4)
    poor = {"first": [0.0] * 11, "last": [1.0] * 11, "same": [0.5] * 11}
    if edges != "good":
        wrong = lambda parts: [F.percentile_approx("__x", poor[edges][: parts + 1], 10).alias("__edges")]
        monkeypatch.setattr(quantiles, "_sketch", wrong)
        df = df.limit(60)
    df = df.cache()
    probs = {"p0": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "p100": 1.0}
    got = grouped_quantiles(df, "x", probs, ["g"], accuracy=100 if edges == "good" else 20, finish=5)
    want = df.where("abs(x) < double('infinity')").groupBy("g").agg(
        *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY x)").alias(name) for name, p in probs.items()]
    )
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r)) for r in want.collect())
    df.unpersist()


# --- outliers -------------------------------------------------------------------


def test_mileage(frame):
    df = frame(
        STATS, ("A", 1, 499.99, 1.0), ("B", 1, 500.0, 1.0), ("C", 1, None, 1.0), ("D", 2, 501.0, 1.0)
    )
    kept, removed, summary = mileage_outliers(df, 500)
    assert [r.vin for r in kept.orderBy("vin").collect()] == ["B", "D"]
    assert rows_of(removed) == [("A", 1), ("C", 1)]
    assert rows_of(summary) == [(1, 3, 1), (2, 1, 1)]


def test_iqr(frame):
    df = frame(STATS, *[(f"v{x}", 1, 1.0, float(x)) for x in (1, 2, 3, 4, 100)], ("n", 1, 1.0, None))
    bounds = iqr_bounds(df, "vehicle_speed_avg_driving_kmh")
    assert rows_of(bounds) == [(1, 2.0, 4.0, -1.0, 7.0)]
    kept, removed, summary = iqr_outliers(df)
    assert rows_of(removed) == [("n", 1), ("v100", 1)]
    assert kept.columns == df.columns and kept.count() == 4
    assert rows_of(summary) == [(1, 6, 4)]


def test_fences_are_closed(frame):
    df = frame(STATS, *[(f"v{x}", 1, 1.0, float(x)) for x in (-1, 2, 2, 2, 3, 4, 4, 4, 7)])
    assert iqr_outliers(df).removed.count() == 0


def test_a_group_of_only_nulls_has_no_bounds_and_keeps_nobody(frame):
    df = frame(STATS, ("A", 1, 1.0, None))
    assert iqr_bounds(df, "vehicle_speed_avg_driving_kmh").count() == 0
    assert rows_of(iqr_outliers(df).removed) == [("A", 1)]


def test_outliers_are_a_bag(frame):
    a = frame("vin string, sales_group int", ("A", 1))
    assert rows_of(outlier_vins(a, a)) == [("A", 1), ("A", 1)]


def test_completeness(frame):
    df = frame("vin string, a double, b double", ("A", 1.0, None), ("A", 1.0, 1.0), ("B", 1.0, 1.0))
    assert rows_of(completeness_outliers(df, ["a", "b"], 0.6)) == [
        ("A", 2, 1.0, 0.5, True),
        ("B", 1, 1.0, 1.0, False),
    ]
    assert rows_of(completeness_outliers(df, ["b"], 0.5).select("vin", "incomplete")) == [
        ("A", False),
        ("B", False),
    ]


# --- removal ----------------------------------------------------------------------

COUNTS = "vin string, sales_group int, x1_interval string, x1_quantized double, `count` double"


@pytest.fixture
def flagged(frame):
    spectra = frame(
        COUNTS,
        *[(v, g, f"[{i},{i + 1})", float(i), 1.0) for v in "VW" for g in (1, 2) for i in (0, 1)],
    )
    return spectra, frame("vin string, sales_group int", ("V", 1), ("V", 1))


def test_scope_any(flagged):
    spectra, outliers = flagged
    assert {r.vin for r in remove_outliers(spectra, outliers).collect()} == {"W"}
    assert rows_of(removed_vins(spectra, outliers)) == [("V", 1), ("V", 2)]
    assert rows_of(removal_summary(spectra, outliers)) == [(1, 2, 1, 1), (2, 2, 1, 1)]


def test_scope_same_group(flagged):
    spectra, outliers = flagged
    left = remove_outliers(spectra, outliers, "same_group").select("vin", "sales_group").distinct()
    assert rows_of(left) == [("V", 2), ("W", 1), ("W", 2)]
    assert rows_of(removed_vins(spectra, outliers, "same_group")) == [("V", 1)]
    summary = removal_summary(spectra, outliers, "same_group")
    assert rows_of(summary) == [(1, 2, 1, 1), (2, 2, 2, 0)]
    assert rows_of(removal_totals(summary)) == [(4, 3, 1)]


def test_nothing_to_remove(flagged):
    spectra, outliers = flagged
    assert remove_outliers(spectra, outliers.limit(0)).count() == spectra.count()
    assert rows_of(removal_summary(spectra, outliers.limit(0))) == [(1, 2, 2, 0), (2, 2, 2, 0)]
    with pytest.raises(ValueError):
        remove_outliers(spectra, outliers, "some")


# --- zero mass ----------------------------------------------------------------------


def weights(vin, group, *pairs):
    return [(vin, group, f"[{lo},{lo + 1000})", float(lo), c) for lo, c in pairs]


def test_zero_mass_orders_one_row_per_vehicle_and_group(frame, plan):
    df = frame(COUNTS, *weights("A", 1, (20000, 5.0)), *weights("A", 2, (20000, -5.0)), *weights(None, None, (11000, 5.0)), *weights("B", 1, (20000, 1.0)))
    got = zero_mass_outliers(df.withColumn("x1_upper", F.col("x1_quantized") + 1000))
    assert {tuple(r) for r in got.collect()} == {("A", 1), ("A", 2), (None, None)}
    assert "ObjectHashAggregate" not in plan(got) and "SortAggregate" not in plan(got)


def test_zero_mass(frame):
    df = frame(
        COUNTS,
        *weights("below", 1, (11000, 5.0)),
        *weights("last", 1, (49000, 5.0)),
        *weights("first", 1, (12000, 5.0)),
        *weights("above", 1, (50000, 5.0)),
        *weights("zero", 1, (20000, 0.0)),
        *weights("null", 1, (20000, None)),
        *weights("two groups", 1, (11000, 5.0)),
        *weights("two groups", 2, (20000, 5.0)),
        *weights("both", 1, (11000, 5.0)),
        *weights("both", 2, (60000, 5.0)),
        *weights("no group", None, (11000, 5.0)),
    ).withColumn("x1_upper", F.col("x1_quantized") + 1000)
    found = zero_mass_outliers(df)
    assert rows_of(found.where("vin <> 'no group'")) == [
        ("above", 1),
        ("below", 1),
        ("both", 1),
        ("both", 2),
        ("null", 1),
        ("zero", 1),
    ]
    assert rows_of(found.where("vin = 'no group'")) == [("no group", None)]
    matrix = weight_matrix(df).orderBy("vin")
    assert matrix.columns[:2] == ["vin", "bin_12500"] and matrix.columns[-1] == "bin_49500"
    assert len(matrix.columns) == 39
    sums = {r.vin: sum(r[1:]) for r in matrix.collect()}
    shares = weight_shares(matrix).orderBy("vin").collect()
    assert [(r.vin, sum(r[1:])) for r in shares] == [("first", 1.0), ("last", 1.0), ("two groups", 1.0)]
    assert {v for v, s in sums.items() if s == 0} == {"above", "below", "both", "no group", "null", "zero"}


# --- fleets -----------------------------------------------------------------------------

SHARES = "vin string, sales_group int, interval_start double, `count` double"


@pytest.fixture
def fleet(frame):
    return frame(
        SHARES,
        ("A", 1, 0.0, 4.0),
        ("A", 1, 1.0, 0.0),
        ("B", 1, 0.0, 3.0),
        ("B", 1, 1.0, 3.0),
        ("C", 1, 0.0, 0.0),
        ("C", 1, 1.0, 0.0),
    )


def test_fleet_average_leaves_empty_vehicles_out(fleet):
    assert rows_of(fleet_average(fleet)) == [(0.0, 0.75), (1.0, 0.25)]
    assert rows_of(fleet_average(fleet, ["sales_group"])) == [(1, 0.0, 0.75), (1, 1.0, 0.25)]


def test_vehicle_next_to_fleet(fleet):
    got = vehicle_vs_fleet(fleet).select("vin", "x_bin", "norm_count", "avg_norm_count")
    assert rows_of(got.where("vin = 'B'")) == [("B", 0.0, 0.5, 0.75), ("B", 1.0, 0.5, 0.25)]
    assert got.count() == 6


def test_before_and_after(fleet, frame):
    out = frame("vin string", ("B",))
    assert rows_of(fleet_before_after(fleet, out)) == [(0.0, 0.75, 1.0), (1.0, 0.25, 0.0)]
    everyone = frame("vin string", ("A",), ("B",))
    assert rows_of(fleet_before_after(fleet, everyone)) == [(0.0, 0.75, None), (1.0, 0.25, None)]


def test_weighted_average_and_radar(frame):
    df = frame(
        "sales_group int, km double, fuel double, same double",
        (1, 1.0, 10.0, 5.0),
        (1, 3.0, 20.0, 5.0),
        (1, 9.0, None, 5.0),
        (2, 2.0, 27.5, 5.0),
        (3, 2.0, 37.5, 5.0),
        (4, None, 1.0, 5.0),
    )
    averages = weighted_fleet_average(df, ["fuel", "same"], "km")
    assert [r.fuel for r in averages.orderBy("sales_group").collect()] == [17.5, 27.5, 37.5, None]
    radar = radar_profile(averages.where("sales_group < 4"), ["fuel", "same"])
    got = {(r.sales_group, r.parameter): r.scaled for r in radar.collect()}
    assert [got[g, "fuel"] for g in (1, 2, 3)] == [0.0, 0.5, 1.0]
    assert got[1, "same"] is None


def test_box(frame):
    df = frame(STATS, *[(f"v{x}", 1, 1.0, float(x)) for x in (1, 2, 3, 4, 100)], ("n", 1, 1.0, None))
    got = box_stats(df, "vehicle_speed_avg_driving_kmh").first()
    assert tuple(got) == (1, 5, 2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(1)
    series = {"a": rng.normal(50, 10, 500), "b": rng.uniform(0, 1, 7), "c": np.array([3.0, 3.0])}
    rows = [(name, float(v)) for name, values in series.items() for v in values]
    df = spark.createDataFrame([*rows, ("a", None)], "s string, x double")
    got = stat_histogram(df, "x", "s", 30).collect()
    for name, values in series.items():
        counts, edges = np.histogram(values, bins=30)
        mine = sorted((r.bin, r.vehicles, r.bin_lo) for r in got if r.s == name)
        assert [m[1] for m in mine] == counts.tolist()
        assert [m[2] for m in mine] == pytest.approx(edges[:-1].tolist())


# --- statistics -----------------------------------------------------------------------


def test_statistics(frame):
    df = frame(
        "vin string, v double, flow double, w double, g double",
        ("A", 72.0, 10.0, 20000.0, -2.0),
        ("A", 36.0, 20.0, 40000.0, 4.0),
        ("A", 0.0, None, 40000.0, 9.0),
        ("A", 200.0, 6.0, None, 9.0),
        ("B", None, None, None, None),
    )
    names = SignalNames("v", "flow", "w", "g")
    rows = {r.vin: r for r in vehicle_stats(df, names, sample_s=100, density=0.5).collect()}
    a, b = rows["A"], rows["B"]
    assert a.distance_via_speed_km == 3.0
    assert a.vehicle_speed_avg_driving_kmh == 54.0 and a.vehicle_speed_avg_kmh == 36.0
    assert a.vehicle_speed_max_kmh == 72.0
    assert (a.fuel_kg, a.fuel_l) == pytest.approx((1.0, 2.0))
    assert a.fuel_l_per_100km == pytest.approx(200 / 3)
    assert a.weight_distance_based_kg == pytest.approx(80000 / 3)
    assert (a.weight_avg_kg, a.weight_min_kg) == pytest.approx((100000 / 3, 20000))
    assert a.weight_max_kg == 40000
    assert (a.road_gradient_avg, a.road_gradient_abs_avg) == (1.0, 3.0)
    assert a.road_gradient_stddev == pytest.approx(18**0.5)
    assert b.operating_time_h > 0 and b.driving_time_h == 0
    assert all(v is None for name, v in b.asDict().items() if name not in ("vin", "operating_time_h", "driving_time_h"))


def test_statistics_of_chosen_signals(frame):
    df = frame("vin string, v double", ("A", 36.0))
    got = vehicle_stats(df, SignalNames("v", None, None, None))
    assert got.columns == [
        "vin",
        "distance_via_speed_km",
        "vehicle_speed_avg_driving_kmh",
        "vehicle_speed_avg_kmh",
        "vehicle_speed_max_kmh",
        "operating_time_h",
        "driving_time_h",
    ]


def test_statistics_far_from_zero_and_with_infinities(frame):
    rows = [("A", 1.0, 1e9 + i) for i in range(3)] + [("A", float("inf"), 0.0), ("A", 1.0, float("-inf")), ("B", 1.0, 7.0)]
    got = vehicle_stats(frame("vin string, v double, g double", *rows), SignalNames("v", None, None, "g"), sample_s=3600).orderBy("vin").collect()
    assert (got[0].road_gradient_stddev, got[0].distance_via_speed_km, got[0].vehicle_speed_max_kmh) == (1.0, 4.0, 1.0)
    assert got[0].road_gradient_avg == 1e9 + 1 and got[1].road_gradient_stddev is None


def test_a_missing_group_is_a_group(frame):
    stats = frame(
        "vin string, sales_group int, x double", *[(f"v{i}", None, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])]
    )
    split = iqr_outliers(stats, "x")
    assert {r.vin for r in split.removed.collect()} == {"v4"}
    assert split.kept.count() == 4


def test_weighted_mean_leaves_nan_out(frame):
    df = frame("x double, w double", (float("nan"), 1.0), (10.0, 1.0), (5.0, float("nan")))
    assert df.agg(weighted_mean(F.col("x"), F.col("w"))).first()[0] == 10.0


def test_a_period_may_have_one_end(frame):
    rows = frame("vin string, timestamp string", ("A", "2024-01-01 00:00:00"), ("A", "2024-07-01 00:00:00"))
    vins = frame("vin string", ("A",))
    assert extract_signals(rows, vins, start="2024-06-01 00:00:00").count() == 1
    assert extract_signals(rows, vins, end="2024-06-01 00:00:00").count() == 1
    assert extract_signals(rows, vins).count() == 2


def test_mean_shares_of_spectra_with_missing_bins_add_up_to_one(frame):
    spectra = frame(
        "vin string, sales_group int, interval_start double, count double",
        ("A", 1, 0.0, 3.0), ("A", 1, 1.0, 1.0), ("B", 1, 1.0, 2.0), ("C", None, 5.0, 7.0), ("D", 1, 0.0, 0.0),
    )
    flags = frame("vin string", ("B",))
    average = fleet_average(spectra, ["sales_group"])
    both = fleet_before_after(spectra, flags, ["sales_group"])
    lines = vehicle_vs_fleet(spectra, ["sales_group"]).select("sales_group", "x_bin", "avg_norm_count").distinct()
    for df, column in ((average, "avg_norm_count"), (both, "avg_before"), (both, "avg_after"), (lines.dropna(subset=["avg_norm_count"]), "avg_norm_count")):
        sums = [r[0] for r in df.groupBy("sales_group").agg(F.sum(column)).select(f"sum({column})").collect()]
        assert sums == [1.0, 1.0]
