"""Bucketed tables, merged sketches, interpolation, and averages over two axes."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from fleetspectra.operators.cohort import merge_sketches, sketched_count, vehicle_sketches
from fleetspectra.operators.fleet import complete_cells, fleet_average, fleet_average_cells, sort_averages
from fleetspectra.operators.grid import complete_spectra, normalize_spectra
from fleetspectra.operators.outliers import remove_outliers
from fleetspectra.operators.signals import interpolate_signals
from fleetspectra.sources.tables import read_table, save_bucketed
from fleetspectra.spec import CleanRule

START = dt.datetime(2024, 6, 1)
SPECTRUM = "vin string, x1_signal_id string, x1_quantized double, x1_upper double, x1_interval string, `count` double"


def spectrum(vehicles=20, bins=6):
    return [(f"v{n}", "s", float(b), b + 1.0, f"[{b},{b + 1})", float(n + b)) for n in range(vehicles) for b in range(bins) if (n + b) % 3]


def test_a_bucketed_table_needs_no_shuffle_by_vehicle(spark, frame, plan, setting, tmp_path):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    name = f"t_{uuid.uuid4().hex}"
    rows = frame(SPECTRUM, *spectrum())
    save_bucketed(rows, name, 8, sort_by=["x1_quantized"], path=f"{tmp_path}/{name}")
    stored = read_table(spark, name)
    full = normalize_spectra(complete_spectra(stored, 0, 6, 1))
    assert "Exchange" not in plan(full)
    want = normalize_spectra(complete_spectra(rows, 0, 6, 1))
    assert sorted(map(str, full.collect())) == sorted(map(str, want.collect()))
    out = remove_outliers(stored, frame("vin string", ("v3",), ("v4",)))
    text = plan(out)
    # Below the join, the stored side sorts at most; only the list of outliers is shuffled.
    left, right = text.split("SortMergeJoin")[1].split("\n   :-")[-1].split("\n   +-")
    assert "FileScan" in left and "Exchange" not in left and "Exchange" in right and "FileScan" not in right
    assert {r.vin for r in out.collect()} == {f"v{n}" for n in range(20)} - {"v3", "v4"}
    totals = stored.groupBy("vin").agg(F.sum("count"))
    assert "Exchange" not in plan(totals)
    spark.sql(f"DROP TABLE {name}")


def test_sketches_of_months_add_up_to_the_year(spark):
    rows = spark.range(60000).select((F.col("id") % 7000).alias("vin"), (F.col("id") % 11).alias("month"), (F.col("id") % 2).alias("g"))
    rows = rows.unionByName(rows.select(F.lit(None).cast("bigint").alias("vin"), "month", "g").limit(5))
    months = vehicle_sketches(rows, ["g", "month"])
    year = vehicle_sketches(rows, ["g"])
    merged = merge_sketches(months, ["g"])
    assert sorted(map(str, merged.select("g", "bucket", F.hex("bitmap")).collect())) == sorted(map(str, year.select("g", "bucket", F.hex("bitmap")).collect()))
    got = {r.g: r.vehicles for r in sketched_count(months, ["g"]).collect()}
    assert all(abs(got[g] - 3500) <= 10 for g in (0, 1))
    numbered = vehicle_sketches(rows, ["g", "month"], number=F.col("vin"))
    assert {r.g: r.vehicles for r in sketched_count(numbered, ["g"], exact=True).collect()} == {0: 3500, 1: 3500}
    crowded = vehicle_sketches(rows, ["g"], bits=12)  # nearly as many vehicles as places
    assert all(abs(r.vehicles - 3500) < 350 for r in sketched_count(crowded, ["g"], bits=12).collect())


@pytest.mark.parametrize("slice_s", [None, 7, 100])
def test_interpolation_across_slices(frame, slice_s):
    rng = random.Random(slice_s or 1)
    rows, clock = [], dict.fromkeys("AB", 0.0)
    for i in range(300):
        vin = rng.choice("AB")
        clock[vin] += rng.choice([0.5, 1, 5, 30])
        rows.append((vin, START + dt.timedelta(seconds=clock[vin]), rng.choice([None, -1.0, 0.0, float(i), float("nan")]), i))
    rows += [(None, START, 5.0, 900), ("A", None, 5.0, 901), ("A", None, None, 902), (None, START, -1.0, 903)]
    df = frame("vin string, timestamp timestamp, x double, id int", *rows)
    got = {r.id: r.x_cleaned for r in interpolate_signals(df, [CleanRule("x", "x > 0", 20)], drop=False, slice_s=slice_s).collect()}
    assert len(got) == len(rows)
    good = lambda x: x is not None and x > 0
    for vin, ts, x, i in rows:
        want = x if good(x) else None
        if want is None and vin and ts:
            mine = [(t, v) for w, t, v, _ in rows if w == vin and t is not None and good(v)]
            before, after = max((m for m in mine if m[0] < ts), default=None), min((m for m in mine if m[0] > ts), default=None)
            if before and after and (ts - before[0]).total_seconds() <= 20 and (after[0] - ts).total_seconds() <= 20:
                want = before[1] + (after[1] - before[1]) * ((ts - before[0]) / (after[0] - before[0]))
        assert got[i] == (pytest.approx(want) if want is not None else None), i
    filled = interpolate_signals(df, [CleanRule("x", "x > 0", 20, fill=-7)], slice_s=slice_s)
    assert filled.count() == len(rows) and filled.where("x_cleaned = -7").count() == sum(v is None for v in got.values())
    assert interpolate_signals(df, [CleanRule("x", "x > 0", 20)], slice_s=slice_s).count() == sum(v is not None for v in got.values())


def test_average_cells_count_missing_cells_as_nothing(frame):
    rows = [("a", "g", 0.0, 0.0, 1.0), ("a", "g", 1.0, 2.0, 3.0), ("b", "g", 0.0, 0.0, 5.0), ("z", "g", 0.0, 0.0, 0.0), ("c", None, 4.0, 4.0, 2.0)]
    df = frame("vin string, sales_group string, x1_quantized double, x2_quantized double, `count` double", *rows)
    got = fleet_average_cells(df, ["sales_group"])
    assert {(r.sales_group, r.x1_quantized, r.x2_quantized): r.avg_norm_count for r in got.collect()} == {
        ("g", 0.0, 0.0): 0.625, ("g", 1.0, 2.0): 0.375, (None, 4.0, 4.0): 1.0
    }
    assert sum(r.avg_norm_count for r in fleet_average_cells(df).collect()) == pytest.approx(1)
    full = complete_cells(got, {"x1_quantized": (0, 2, 1), "x2_quantized": (0, 3, 1)}, ["sales_group"]).collect()
    assert len(full) == 2 * 6 and sum(r.avg_norm_count for r in full) == 1.0  # the cell at 4, 4 lies off the grid
    assert complete_cells(got.where("sales_group = 'g'").drop("sales_group"), {"x1_quantized": (0, 2, 1), "x2_quantized": (0, 3, 1)}).count() == 6


def test_averages_in_order(frame):
    rows = [(v, "g", x, float(x + 1)) for v in "ab" for x in (30.0, 10.0, 20.0)]
    df = frame("vin string, sales_group string, interval_start double, `count` double", *rows)
    got = sort_averages(fleet_average(df, ["sales_group"]), ["sales_group"]).collect()
    assert [(r.x_bin, r.position) for r in got] == [(10.0, 1), (20.0, 2), (30.0, 3)]


def test_several_spectra_on_grids_of_their_own(frame):
    rows = [(c, "v", "s", x, x + 1, "", 1.0) for c, x in ((2, 0.0), (2, 3.0), (4, 7.0), (4, 8.0))]
    df = frame("ls_config_id int, " + SPECTRUM, *rows)
    got = complete_spectra(df, "min", "max", 1).collect()
    assert sorted((r.ls_config_id, r.interval_start, r["count"]) for r in got) == [
        (2, 0.0, 1.0), (2, 1.0, 0.0), (2, 2.0, 0.0), (2, 3.0, 1.0), (4, 7.0, 1.0), (4, 8.0, 1.0)
    ]
