import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.operators import signals as sig
from fleetspectra.operators.ordering import clean_with_previous, with_previous
from fleetspectra.spec import CleanRule

START = dt.datetime(2024, 6, 1)
SCHEMA = "vin string, timestamp timestamp, x double, gear int, id int"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def drive(seed, rows=400, vins="ABC"):
    """Random rows: gaps from parts of a second to hours, missing values."""
    rng = random.Random(seed)
    clock = dict.fromkeys(vins, 0.0)
    out = []
    for i in range(rows):
        vin = rng.choice(vins[0] * 3 + vins)
        clock[vin] += rng.choice([0.25, 1, 7, 60, 3599, 3600, 9000])
        x = rng.choice([None, -1.0, 0.0, 1.0, 2.0, 3.0])
        out.append((vin, at(clock[vin]), x, rng.choice([None, 0, 1, 2]), i))
    rng.shuffle(out)
    return out


def by_vin(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("slice_s", [1, 60, 3600, 10**9])
def test_previous_row_across_slices(frame, slice_s):
    rows = drive(slice_s)
    got = with_previous(
        frame(SCHEMA, *rows), {"p": "gear", "q": "timestamp"}, {"p": 9}, slice_s=slice_s
    )
    want = {}
    for group in by_vin(rows).values():
        for before, row in zip([None, *group], group):
            want[row[4]] = (before[3], before[1]) if before else (9, None)
    assert {r.id: (r.p, r.q) for r in got.collect()} == want


def test_previous_keeps_rows_without_vehicle_or_time(frame):
    rows = [("A", None, 1.0, 1, 0), ("A", None, 1.0, 2, 1), ("A", at(0), 1.0, 3, 2)]
    rows += [(None, at(0), 1.0, 4, 3), (None, at(1), 1.0, 5, 4), ("A", at(1), 1.0, 6, 5)]
    got = with_previous(frame(SCHEMA, *rows), {"p": "gear"}, {"p": 0}).collect()
    assert {r.id: r.p for r in got} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 3}


def test_ties_are_ordered_by_the_tie_columns(frame):
    rows = [("A", at(0), 1.0, i, i) for i in (3, 1, 2, 0)]
    got = with_previous(frame(SCHEMA, *rows), {"p": "id"}, {"p": -1}, tie=["id"]).collect()
    assert {r.id: r.p for r in got} == {0: -1, 1: 0, 2: 1, 3: 2}


def test_same_as_a_plain_window(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(
        F.col("user_id").alias("vin"), F.col("ts").alias("timestamp"), "event_id", "event_type"
    )
    w = W.partitionBy("vin").orderBy("timestamp", "event_id")
    want = events.withColumn("p", F.lag("event_type").over(w))
    got = with_previous(events, {"p": "event_type"}, tie=["event_id"])
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def ran(df, plan):
    """The plan as it ran: without the parts that were taken from another one's shuffle."""
    df.collect()
    text = plan(df)
    return text[: text.index("Initial Plan")] if "Initial Plan" in text else text


@pytest.mark.parametrize("clean", [False, True])
def test_one_scan_and_one_shuffle_of_the_rows(spark, frame, plan, tmp_path, clean):
    frame(SCHEMA, *drive(1)).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/rows")
    if clean:
        out = clean_with_previous(rows, [CleanRule("x", "x > 0", 60)], {"p": "gear"}, tie=["id"])
    else:
        out = with_previous(rows, {"p": "gear"}, tie=["id"])
    text = ran(out, plan)
    assert text.count("FileScan") == text.count("ReusedExchange") == 1
    # Two more shuffles, of one row per vehicle and slice each.
    assert text.count("Exchange hashpartitioning") - text.count("ReusedExchange") <= 4 and "ShuffledHashJoin" not in text


@pytest.mark.parametrize("slice_s", [7, 3600, 10**9])
@pytest.mark.parametrize("drop", [True, False])
def test_clean_with_previous_is_one_after_the_other(frame, slice_s, drop):
    rules = [CleanRule("x", "x > 0", 30), CleanRule("gear", "gear > 0", 1, fill=7)]
    df = frame(SCHEMA, *drive(slice_s), ("A", None, 1.0, 1, 900), (None, at(3), 1.0, 2, 901), ("B", at(5), float("nan"), 0, 902))
    new, defaults = {"p": "gear", "q": "timestamp"}, {"p": 9}
    got = clean_with_previous(df, rules, new, defaults, drop, tie=["id"], slice_s=slice_s)
    want = with_previous(sig.clean_signals(df, rules, drop, tie=["id"]), new, defaults, tie=["id"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize(("limit_s", "slice_s"), [(10, 20), (10, 3), (3600, 3600), (7200, 900)])
def test_hold_last_valid(frame, limit_s, slice_s):
    rows = drive(limit_s + slice_s)
    rules = [CleanRule("x", "x > 0", limit_s), CleanRule("gear", "gear > 0", 1, fill=7)]
    got = sig.clean_signals(frame(SCHEMA, *rows), rules, drop=False, slice_s=slice_s).collect()

    def held(group, i, k, limit):
        for row in reversed(group[: i + 1]):
            if (group[i][1] - row[1]).total_seconds() > limit:
                return None
            if row[k] is not None and row[k] > 0:
                return row[k]

    want = {}
    for group in by_vin(rows).values():
        for i, row in enumerate(group):
            gear = held(group, i, 3, 1)
            want[row[4]] = (held(group, i, 2, limit_s), 7 if gear is None else gear)
    assert len(got) == len(rows)
    assert {r.id: (r.x_cleaned, r.gear_cleaned) for r in got} == want


def test_hold_then_drop(frame):
    rows = [("A", at(s), x, 1, i) for i, (s, x) in enumerate([(0, 5.0), (8, 0.0), (19, 0.0)])]
    got = sig.clean_signals(frame(SCHEMA, *rows), [CleanRule("x", "x > 0", 10)]).collect()
    assert {r.id: r.x_cleaned for r in got} == {0: 5.0, 1: 5.0}


def test_hold_without_limit_only_masks(frame, plan):
    rows = [("A", at(0), 5.0, 1, 0), ("A", at(1), 0.0, 1, 1), (None, None, 2.0, 1, 2)]
    df = sig.clean_signals(frame(SCHEMA, *rows), [CleanRule("x", "x > 0", 0)], drop=False)
    assert {r.id: r.x_cleaned for r in df.collect()} == {0: 5.0, 1: None, 2: 2.0}
    assert "Exchange" not in plan(df)


def test_hold_keeps_rows_without_vehicle_or_time(frame):
    rows = [("A", None, 5.0, 1, 0), ("A", None, 0.0, 1, 1), ("A", at(0), 0.0, 1, 2)]
    rows += [(None, at(0), 5.0, 1, 3), (None, at(1), 0.0, 1, 4)]
    got = sig.clean_signals(frame(SCHEMA, *rows), [CleanRule("x", "x > 0", 10)], drop=False)
    want = {0: 5.0, 1: None, 2: None, 3: 5.0, 4: None}
    assert {r.id: r.x_cleaned for r in got.collect()} == want


def test_gear_shift(frame):
    rows = [("A", at(i), 1.0, g, i) for i, g in enumerate([3, 3, 4, None, 0])]
    got = sig.add_gear_shift(frame(SCHEMA, *rows), "gear").orderBy("id").collect()
    assert [r.gear_shift_event for r in got] == [1, 0, 1, 0, 0]
    assert [r.gear_from for r in got] == [0, 0, 3, 0, 0]
    assert [r.gear_to for r in got] == [3, 0, 4, 0, 0]


def test_time_since_last_floors_both_ends(frame):
    rows = [("A", at(0.7), 1.0, 1, 0), ("A", at(60.2), 1.0, 1, 1)]
    got = sig.add_time_since_last(frame(SCHEMA, *rows)).orderBy("id").collect()
    assert [r.diff_time_to_last_timestamp_vin_min for r in got] == [None, 1.0]


def test_distance_by_gap_is_capped(frame):
    rows = [("A", at(s), 36.0, 1, i) for i, s in enumerate([0, 10, 1000])]
    got = sig.add_distance_by_gap(frame(SCHEMA, *rows), "x", 100).orderBy("id").collect()
    assert [r.distance_via_speed_km for r in got] == [None, 0.1, 1.0]


def test_derived_columns(frame):
    df = frame(SCHEMA, ("A", at(0), 200.0, 1, 0), ("A", at(1), 36.0, 1, 1), ("A", at(2), None, 1, 2))
    out = sig.add_distance(df, "x")
    out = sig.add_driving_flag(sig.add_year_month(sig.add_odometer_km(out, "x")), "x")
    out = sig.add_torque_share(sig.add_abs(out, "x"), "x")
    out = sig.copy_signal(out, "x", "x_cleaned").orderBy("id").collect()
    assert [r.distance_via_speed_km for r in out] == [None, 0.01, None]
    assert [r.driving for r in out] == [False, True, False]
    assert [r.year_month for r in out] == [202406] * 3
    assert [r.odometer_km for r in out] == [0.2, 0.036, None]
    assert [r.engine_torque_percentage for r in out] == [0.08, 0.0144, 0.0]


def test_columns_in_order_may_use_each_other(frame):
    df = frame(SCHEMA, ("A", at(0), 2.0, 1, 0))
    out = sig.with_columns_in_order(df, {"a": F.col("x") * 2, "b": F.col("a") + 1})
    assert tuple(out.select("a", "b").first()) == (4.0, 5.0)
