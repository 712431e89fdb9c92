import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetspectra.operators import signals as sig
from fleetspectra.operators.grid import (
    complete_spectra,
    grid_bounds,
    normalize_spectra,
    sort_spectra,
    total_distance,
    upper_edge_quantile,
)
from fleetspectra.operators.spectra import (
    inspect_vehicle,
    one_spectrum,
    rebin_spectra,
    spectra,
    stack_spectra,
)
from fleetspectra.operators.translation import (
    name_signals,
    one_per,
    spectra_metadata,
    translate_spectra,
)
from fleetspectra.spec import Axis, SpectrumSpec, engine_spec, vehicle_specs
from registry.queries import QUERIES
from registry.views import COLUMNS

SF = "/root/testdata/sf0.01"
SIGNALS = "vin string, timestamp timestamp, `20` double, `5589` double, `209_abs` double, `distance_via_speed_km` double"
T = dt.datetime(2024, 6, 1)
SPECS = vehicle_specs("20", "5589", "209_abs")


def items(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        F.col("l_suppkey").alias("vin"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_quantity").alias("20"),
        F.col("l_extendedprice").alias("5589"),
        (F.col("l_discount") * 100).alias("209_abs"),
        (F.col("l_extendedprice") / 20).alias("11"),
        ((F.col("l_quantity") - 25) * 120).alias("4"),
    )
    return sig.add_distance(df, "20")


def test_speed_filter_and_axis(frame):
    rows = [("A", T, v, 1.0, 1.0, 1.0) for v in (0.0, 159.5, 160.0, 200.0, 200.1, -1.0)]
    got = spectra(frame(SIGNALS, *rows), SPECS[:1], ["time"]).collect()
    assert {r.x1_interval: r["count"] for r in got} == {"[0,1)": 1, "[159,160)": 1}
    assert SPECS[0].description == "`20` >= 0 AND `20` <= 200"


def test_ids_follow_the_list_even_when_a_spectrum_is_skipped(frame):
    df = frame(SIGNALS, ("A", T, 10.0, 5000.0, 1.0, 1.0)).drop("5589")
    with pytest.warns(UserWarning, match="GroCmbVehWeight"):
        got = spectra(df, SPECS).collect()
    assert sorted(r.ls_config_id for r in got) == [1, 2, 5, 6]
    assert {r.x1_signal_id for r in got} == {"20", "209"}


def test_no_usable_spectrum_is_an_error(frame):
    df = frame("vin string, timestamp timestamp, distance_via_speed_km double", ("A", T, 1.0))
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        spectra(df, SPECS)


def test_unknown_weight_is_an_error(frame):
    with pytest.raises(ValueError, match="weights"):
        spectra(frame(SIGNALS, ("A", T, 1.0, 1.0, 1.0, 1.0)), SPECS, ["fuel"])


def test_fused_equals_one_by_one(spark):
    df = items(spark)
    fused = spectra(df, [*SPECS, engine_spec("11", "4", "20")])
    for i, spec in enumerate([*SPECS, engine_spec("11", "4", "20")]):
        alone = spectra(df, [spec])
        mine = fused.where(F.col("ls_config_id").isin(2 * i + 1, 2 * i + 2))
        mine = mine.withColumn("ls_config_id", F.col("ls_config_id") - 2 * i).select(*alone.columns)
        assert mine.count() == alone.count() > 0
        assert mine.exceptAll(alone).isEmpty()


def test_counts_add_up_to_the_rows_on_the_axis(spark):
    df = items(spark)
    got = spectra(df, [SPECS[1]]).groupBy("ls_config_id").agg(F.sum("count")).collect()
    on_axis = df.where("`20` > 0 AND `5589` >= 0 AND `5589` < 100000")
    rows, km = on_axis.agg(F.count("timestamp"), F.sum("distance_via_speed_km")).first()
    sums = dict(tuple(r) for r in got)
    assert sums[1] == rows
    assert sums[2] == pytest.approx(km, rel=1e-6)


def test_marginal_of_two_axes_is_the_spectrum_of_one(spark):
    df = items(spark).where("`4` < 3000 AND `11` < 5000")
    engine = engine_spec("11", "4", "20")
    one = SpectrumSpec("rpm", engine.axes[:1], engine.filters)
    marginal = (
        spectra(df, [engine], ["time"])
        .groupBy("vin", "x1_interval")
        .agg(F.sum("count").alias("count"))
    )
    alone = spectra(df, [one], ["time"]).select("vin", "x1_interval", "count")
    assert marginal.exceptAll(alone).isEmpty() and alone.exceptAll(marginal).isEmpty()


def test_rebin_equals_direct_binning(spark):
    df = items(spark)
    wide = SpectrumSpec("w", (Axis("5589", 0, 100000, 4000),), SPECS[1].filters)
    direct = spectra(df, [wide], ["time"]).select("vin", "x1_interval", "count")
    merged = rebin_spectra(spectra(df, [SPECS[1]], ["time"]), 4, 0, 1000)
    merged = merged.select("vin", "x1_interval", "count")
    assert merged.exceptAll(direct).isEmpty() and direct.exceptAll(merged).isEmpty()


def test_one_scan_and_one_shuffle_for_all_spectra(spark, plan):
    text = plan(spectra(items(spark), SPECS))
    assert text.count("Scan parquet") == 1 and text.count("Exchange") == 1
    assert "Python" not in text


def test_filter_and_columns_reach_the_scan(spark, plan):
    text = plan(spectra(items(spark), [SPECS[1]], ["time"]))
    assert "GreaterThan(l_quantity,0.0)" in text and "LessThan(l_extendedprice" in text
    assert "l_discount" not in text


def test_inspect_and_stack(frame):
    rows = [("A", T, v, 1.0, 1.0, 2.0) for v in (1.0, 3.0)] + [("B", T, 1.0, 1.0, 1.0, 2.0)]
    df = spectra(frame(SIGNALS, *rows), SPECS[:1])
    assert [r.x1_interval for r in inspect_vehicle(df, "A", 2).collect()] == ["[3,4)", "[1,2)"]
    counts = one_spectrum(df, 1).withColumn("count", F.col("count").cast("bigint"))
    both = stack_spectra([counts, one_spectrum(df, 2)])
    assert dict(both.dtypes)["count"] == "double" and both.count() == 6


# --- grid -------------------------------------------------------------------

SPECTRUM = "vin string, x1_quantized double, x1_upper double, x1_interval string, tag string, `count` double"


def bins(vin, *pairs, width=1.0):
    return [
        (vin, float(lo), lo + width, f"[{lo:g},{lo + width:g})", "t", float(c)) for lo, c in pairs
    ]


def test_complete_fills_and_cuts(frame):
    df = frame(SPECTRUM, *bins("A", (1, 4), (7, 9)), *bins("B", (0, 1)))
    got = complete_spectra(df, 0, 3, 1).orderBy("vin", "interval_start").collect()
    assert [(r.vin, r.x1_interval, r["count"], r.tag) for r in got] == [
        ("A", "[0,1)", 0.0, None),
        ("A", "[1,2)", 4.0, "t"),
        ("A", "[2,3)", 0.0, None),
        ("B", "[0,1)", 1.0, "t"),
        ("B", "[1,2)", 0.0, None),
        ("B", "[2,3)", 0.0, None),
    ]
    assert [r.interval_end for r in got[:3]] == [1.0, 2.0, 3.0]


def test_complete_to_limits_of_the_data(frame):
    df = frame(SPECTRUM, *bins("A", (2, 4), (5, 1)), *bins("B", (3, 1)))
    got = complete_spectra(df, "min", "max", 1).groupBy("vin").agg(
        F.min("interval_start"), F.max("interval_end"), F.count("*"), F.sum("count")
    )
    assert sorted(tuple(r) for r in got.collect()) == [
        ("A", 2.0, 6.0, 4, 5.0),
        ("B", 2.0, 6.0, 4, 1.0),
    ]
    assert complete_spectra(df, "min", ("p", 0.5), 1).count() == 4


def test_complete_with_limits_per_group(frame):
    df = frame(SPECTRUM, *bins("A", (2, 4), (5, 1)), *bins("B", (3, 1)))
    df = df.withColumn("sales_group", F.ascii("vin"))
    got = complete_spectra(df, "min", "max", 1, by=["sales_group"])
    assert {r.vin: r["n"] for r in got.groupBy("vin").agg(F.count("*").alias("n")).collect()} == {
        "A": 4,
        "B": 1,
    }


def test_complete_keeps_counted_rows_above_the_limit(frame):
    df = frame(SPECTRUM, *bins("A", (2, 4), (3, 1), (9, 7), (9, 2)), *bins("B", (2, 1), (3.5, 6)), ("B", None, None, None, "t", 1.0))
    df = df.withColumn("sales_group", F.lit(1))
    for lo in ("min", 2):
        got = complete_spectra(df, lo, ("p", 0.4), 1, by=["sales_group"], keep_above=True)
        assert sorted((r.vin, r.x1_interval, r.interval_start, r.interval_end, r["count"], r.tag) for r in got.collect()) == [
            ("A", "[2,3)", 2.0, 3.0, 4.0, "t"),
            ("A", "[3,4)", 3.0, 4.0, 1.0, "t"),
            ("A", "[9,10)", 9.0, 10.0, 2.0, "t"),
            ("A", "[9,10)", 9.0, 10.0, 7.0, "t"),
            ("B", "[2,3)", 2.0, 3.0, 1.0, "t"),
            ("B", "[3,4)", 3.0, 4.0, 0.0, None),
        ]
        # The stray edge lies inside the grid, so it vanishes as before; above the limit any edge stays.
    far = complete_spectra(df, "min", 3, 1, by=["sales_group"], keep_above=True).where("vin = 'B'")
    assert sorted((r.interval_start, r.interval_end, r["count"]) for r in far.collect()) == [(2.0, 3.0, 1.0), (3.5, 4.5, 6.0)]


def test_completing_to_p99_loses_no_counted_bin(spark, frame, tmp_path):
    places = [(v, p) for v, some in {1: range(10), 2: range(10), 3: range(10, 95), 4: [99]}.items() for p in some]
    rows = [(1, 1, v, n, 36.0, p * 1000.0 + 500, 0.0, 0.0, "N", "O", dt.datetime(2024, 1, 1)) for n, (v, p) in enumerate(places)]
    frame(COLUMNS["lineitem"], *rows).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["complete_to_p99_by_group"](spark, str(tmp_path))
    assert sorted((r.vin, int(r.interval_start) // 1000) for r in got.where("count > 0").collect()) == places
    # 106 bins were counted: the 105th, [94000,95000), is the grid's last, and only vehicle 4 has one above it.
    sizes = {r.vin: (r["n"], r["hi"]) for r in got.groupBy("vin").agg(F.count("*").alias("n"), F.max("interval_end").alias("hi")).collect()}
    assert sizes == {1: (95, 95000.0), 2: (95, 95000.0), 3: (95, 95000.0), 4: (96, 100000.0)}


def test_vehicles_of_one_group_are_dealt_over_tasks(frame, setting):
    setting("spark.sql.adaptive.enabled", "false")
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    df = frame(SPECTRUM, *[row for n in range(40) for row in bins(f"V{n}", (1, 4), (4, 1))]).withColumn("sales_group", F.lit(1))
    got = complete_spectra(df, "min", "max", 1, by=["sales_group"]).withColumn("task", F.spark_partition_id())
    assert got.count() == 160 and got.select("task").distinct().count() > 1


def test_complete_orders_only_counted_rows(frame, plan):
    text = plan(complete_spectra(frame(SPECTRUM, *bins("A", (1, 4))), 0, 5, 1))
    assert text.index("Generate explode") < min(text.index("Window"), text.index("Sort"))  # the root of a plan comes first


def test_complete_with_repeated_and_stray_bins(frame):
    df = frame(SPECTRUM, *bins("A", (1, 4), (1, 2), (9, 5)), *bins(None, (0.5, 3)))
    got = sorted((r.vin or "", r.interval_start, r["count"]) for r in complete_spectra(df, 0, 3, 1).collect())
    assert got == [("", 0.0, 0.0), ("", 1.0, 0.0), ("", 2.0, 0.0), ("A", 0.0, 0.0), ("A", 1.0, 2.0), ("A", 1.0, 4.0), ("A", 2.0, 0.0)]


def test_complete_without_room_is_empty(frame):
    df = frame(SPECTRUM, *bins("A", (2, 4)))
    assert complete_spectra(df, 3, 3, 1).count() == 0
    assert complete_spectra(df, "min", 1, 1).count() == 0
    empty = df.limit(0)
    assert complete_spectra(empty, "min", "max", 1).count() == 0


def test_complete_with_fractional_bins(frame):
    df = frame(SPECTRUM, *bins("A", (0.1, 4), (0.3, 1), width=0.1))
    got = complete_spectra(df, 0.1, 0.5, 0.1).orderBy("interval_start").collect()
    assert [(r.x1_interval, r["count"]) for r in got] == [
        ("[0.1,0.2)", 4.0),
        ("[0.2,0.3)", 0.0),
        ("[0.3,0.4)", 1.0),
        ("[0.4,0.5)", 0.0),
    ]


def test_complete_crosses_nothing(frame, plan):
    df = frame(SPECTRUM, *bins("A", (1, 4)))
    assert "Cartesian" not in plan(complete_spectra(df, "min", "max", 1))
    assert "NestedLoop" not in plan(complete_spectra(df, "min", "max", 1))


def test_shares_and_totals(frame):
    df = frame(SPECTRUM, *bins("A", (0, 0), (1, 4), (2, 0)), *bins("B", (0, 0), (1, 0)))
    got = normalize_spectra(df).orderBy("vin", "x1_quantized").collect()
    assert [r.normalized_count for r in got] == [0.0, 1.0, 0.0, None, None]
    totals = {r.vin: r.total_distance for r in total_distance(df).collect()}
    assert totals == {"A": 4.0, "B": 0.0}


def test_bounds_and_edges(frame):
    df = frame(SPECTRUM, *bins("A", *[(i, 1) for i in range(100)]))
    assert tuple(grid_bounds(df).first()) == (0.0, 100.0)
    assert upper_edge_quantile(df, 0.99).first()[0] == 99.0
    assert [r.x1_quantized for r in sort_spectra(df, start="x1_quantized").take(3)] == [0, 1, 2]


# --- translation --------------------------------------------------------------

MAPPING = "signal_id string, signal_name string, can_signal_name string, type string, unit string"
STATES = "vehicle_net_type int, signal_id string, value double, text string"


@pytest.fixture
def lookups(frame):
    mapping = frame(
        MAPPING,
        ("209", "RoadGrad", None, "float", "%"),
        ("6022", "Gear", "Gear_Cval", "enum", "No unit"),
        ("20", "Speed", "Spd", "int", "km/h"),
        ("not a number", "x", None, "int", "No unit"),
    )
    states = frame(
        STATES, (1026, "6022", 1.0, "first"), (1000, "6022", 2.0, "other network"),
        (1026, "6022", None, "unknown"),
    )
    return mapping, states


def test_texts(frame, lookups):
    df = frame(
        "x1_signal_id string, x1_quantized double, x1_interval string",
        ("6022", 1.0, "[1,2)"),
        ("6022", 3.0, "[3,4)"),
        ("20", 3.0, "[3,4)"),
        ("77", 3.0, "[3,4)"),
    )
    got = translate_spectra(df, *lookups).collect()
    assert {(r.x1_signal_id, r.x1_quantized): r.x1_value_to_text for r in got} == {
        ("6022", 1.0): "first",
        ("6022", 3.0): "3",
        ("20", 3.0): "[3,4)",
        ("77", 3.0): "[3,4)",
    }


def test_two_axes_get_two_texts(frame, lookups):
    df = frame(
        "x1_signal_id string, x1_quantized double, x1_interval string,"
        " x2_signal_id string, x2_quantized double, x2_interval string",
        ("6022", 1.0, "[1,2)", "20", 5.0, "[5,6)"),
    )
    row = translate_spectra(df, *lookups).first()
    assert (row.x1_value_to_text, row.x2_value_to_text) == ("first", "[5,6)")


def test_doubled_lookup_rows_do_not_double_counts(frame, lookups):
    mapping, states = lookups
    df = frame("x1_signal_id string, x1_quantized double, x1_interval string", ("6022", 1.0, "[1,2)"))
    assert translate_spectra(df, mapping.union(mapping), states.union(states)).count() == 1
    assert one_per(mapping.union(mapping), ["signal_id"]).count() == mapping.count()


def test_names(spark, lookups):
    specs = [
        SpectrumSpec("g", (Axis("209_abs", 0, 1, 1),), ("`20` > 0", "`20` < 5"), "tag"),
        engine_spec("6022", "20_cleaned", "20"),
    ]
    got = name_signals(spectra_metadata(spark, specs), lookups[0]).orderBy("ls_config_id").collect()
    assert [r.ls_config_id for r in got] == [1, 2, 3, 4]
    assert [r.x1_signal for r in got] == ["RoadGrad_abs"] * 2 + ["Gear_Cval"] * 2
    assert [r.x2_signal for r in got] == [None] * 2 + ["Spd_cleaned"] * 2
    assert got[0].description == "`20` > 0 AND `20` < 5" and got[1].count_type == "distance"
