import datetime as dt
import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fleetspectra.operators.cohort import (
    cohort_combinations,
    extract_signals,
    in_period,
    sample_vehicles,
    select_cohort,
    vehicle_count,
    vehicle_count_approx,
)
from fleetspectra.plans import chains
from fleetspectra.sources import tables
from fleetspectra.spec import engine_spec, vehicle_specs
from fleetspectra.streaming.live import start_spectra

T = dt.datetime(2024, 6, 1)
SF = "/root/testdata/sf0.01"


# --- cohort -------------------------------------------------------------------


@pytest.fixture
def vehicles(frame):
    return frame(
        "vin string, model int, engine string",
        ("A", 1, "x M3B y"),
        ("B", 1, "M3C"),
        ("C", 2, "M3B"),
        ("D", 1, None),
    )


def test_cohort(vehicles):
    got = select_cohort(vehicles, {"engine": "M3B"}, {"model": 1}, ["vin"])
    assert [tuple(r) for r in got.collect()] == [("A",)]
    assert select_cohort(vehicles).count() == 4


def test_combinations_come_most_frequent_first(vehicles):
    got = [tuple(r) for r in cohort_combinations(vehicles, ["model"]).collect()]
    assert got == [(1, 3), (2, 1)]


def test_sample_is_the_same_each_time(spark):
    vehicles = spark.range(1000).select(F.col("id").alias("vin"))
    first = {r.vin for r in sample_vehicles(vehicles, 50).collect()}
    again = {r.vin for r in sample_vehicles(vehicles.repartition(7), 50).collect()}
    other = {r.vin for r in sample_vehicles(vehicles, 50, seed=1).collect()}
    assert first == again != other and len(first) == 50


def test_extract_keeps_rows_once_and_the_period_half_open(frame):
    signals = frame(
        "vin string, timestamp timestamp",
        *[(v, T + dt.timedelta(days=d)) for v in "AB" for d in (-1, 0, 1, 2)],
        ("A", None),
    )
    chosen = frame("vin string", ("A",), ("A",))
    got = extract_signals(signals, chosen, "2024-06-01 00:00:00", "2024-06-03 00:00:00")
    assert sorted((r.vin, r.timestamp.day) for r in got.collect()) == [("A", 1), ("A", 2)]
    assert extract_signals(signals, chosen).count() == 5


def test_period_on_text_times(frame):
    df = frame("vin string, timestamp string", ("A", "2024-06-01 00:00:00"), ("A", "2024-07-01 00:00:00"))
    assert in_period(df, "2024-06-01 00:00:00", "2024-07-01 00:00:00").count() == 1


def test_period_reaches_the_scan(spark, plan):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    text = plan(in_period(orders, "1996-01-01 00:00:00", "1997-01-01 00:00:00", "o_orderdate"))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text


def test_hot_vehicle_is_split_when_the_list_is_too_long_to_broadcast(spark, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "100KB")
    setting("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100KB")
    signals = spark.range(400_000).select(
        F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id")).alias("vin"),
        F.xxhash64("id").alias("x"),
    )
    got = extract_signals(signals, spark.range(0, 400_000, 2).withColumnRenamed("id", "vin"))
    rows = got.collect()
    assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == signals.where("vin % 2 = 0").count()


def test_counts(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("user_id", "vin")
    exact = vehicle_count(events).first()
    assert (exact.rows, exact.vehicles) == (10000, 150)
    assert vehicle_count_approx(events).first().vehicles == pytest.approx(150, rel=0.1)


# --- tables --------------------------------------------------------------------


def test_family_of_groups(frame, spark):
    a, b = frame("vin string, x int", ("A", 1)), frame("x int, vin string", (2, "B"))
    got = tables.read_group_family(spark, {1: a, 2: b})
    assert sorted((r.vin, r.x, r.sales_group) for r in got.collect()) == [("A", 1, 1), ("B", 2, 2)]
    empty = tables.read_group_family(spark, {}, schema="vin string, sales_group int")
    assert empty.columns == ["vin", "sales_group"] and empty.isEmpty()
    with pytest.raises(ValueError):
        tables.read_group_family(spark, {})


def test_family_from_paths_and_names(spark, tmp_path, frame):
    frame("vin string", ("A",)).write.parquet(f"{tmp_path}/one")
    tables.save_table(frame("vin string", ("B",)), "family_two", path=f"{tmp_path}/two")
    got = tables.read_group_family(spark, {1: f"{tmp_path}/one", 2: "family_two"})
    assert sorted(tuple(r) for r in got.collect()) == [("A", 1), ("B", 2)]
    spark.sql("DROP TABLE family_two")


def test_save_replaces(spark, tmp_path, frame):
    for value in (1, 2):
        df = frame("vin string, sales_group int", ("A", value))
        tables.save_table(df, "replaced", path=f"{tmp_path}/t", partition_by=["sales_group"])
    assert [r.sales_group for r in tables.read_table(spark, "replaced").collect()] == [2]
    spark.sql("DROP TABLE replaced")


def test_layout_splits_a_hot_vehicle(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("vin"),
        F.timestamp_seconds(F.col("id")).alias("timestamp"),
    )
    laid = tables.layout_signals(df, 12).withColumn("p", F.spark_partition_id())
    sizes = [r["count"] for r in laid.groupBy("p").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 3 * min(sizes)
    in_order = laid.mapInPandas(
        lambda parts: (
            p.assign(ok=p[["vin", "timestamp"]].apply(tuple, axis=1).is_monotonic_increasing)[["ok"]]
            for p in parts
        ),
        "ok boolean",
    )
    assert in_order.where("NOT ok").isEmpty()


@pytest.mark.parametrize(("named", "master"), [("/shared/", "yarn"), (None, "local[2]"), (None, "yarn")])
def test_shared_folder_is_the_named_one(named, master):
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: named),
        sparkContext=SimpleNamespace(master=master),
    )
    if named:
        assert tables.shared_folder(session) == "/shared"
    elif master.startswith("local"):
        assert tables.shared_folder(session) == tables.shared_folder(session) != "/shared"
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.shared_folder(session)


def test_stored_step_reads_back_from_the_shared_folder(spark, frame):
    df = frame("vin string, x double", ("A", 1.0))
    back = tables.stored(df, "test")
    assert back.schema == df.schema and back.collect() == df.collect()
    assert back.inputFiles()[0].split("://")[-1].lstrip("/").startswith(
        tables.shared_folder(spark).split("://")[-1].lstrip("/")
    )


# --- chains ----------------------------------------------------------------------

RAW = "vin string, timestamp timestamp, `20` double, `11` double, `87` double, `209` double, `5589` double, `4` double"


def raw(frame, seconds=200):
    rows = [
        (vin, T + dt.timedelta(seconds=s), 36.0, 1000.0 * (s % 50 != 0), 5.0, -1.5, w, 500.0)
        for vin, w in (("A", 20000.0), ("B", 40500.0))
        for s in range(seconds)
    ]
    return frame(RAW, *rows)


def test_raw_signals_to_average(frame):
    ready = chains.prepare_signals(raw(frame), time_since_last=True)
    assert {"11_cleaned", "87_cleaned", "20_cleaned", "209_abs", "engine_power_kw", "year_month",
            "diff_time_to_last_timestamp_vin_min"} <= set(ready.columns)
    # Only the very first reading of a vehicle has no good one before it.
    assert ready.count() == 398
    specs = vehicle_specs("20_cleaned", "5589", "209_abs")
    counted = chains.distance_spectra(ready, specs)
    assert sorted({r.ls_config_id for r in counted.collect()}) == [2, 4, 6]
    full = chains.complete_config(counted, 4, chains.WEIGHT_GRID)
    assert full.count() == 2 * 35
    assert full.agg(F.sum("count")).first()[0] == pytest.approx(3.98)
    engine = chains.distance_spectra(ready, [engine_spec("11_cleaned", "4", "20_cleaned")])
    assert {(r.x1_interval, r.x2_interval) for r in engine.collect()} == {("[1000,1050)", "[500,550)")}
    assert {(r.x1_signal_id, r.x2_signal_id) for r in engine.collect()} == {("11", "4")}


def test_average_of_signals(frame):
    ready = chains.prepare_signals(raw(frame)).withColumn("sales_group", F.lit(1))
    spec = vehicle_specs("20_cleaned", "5589", "209_abs")[1]
    got = chains.fleet_average_of_signals(ready, spec, chains.WEIGHT_GRID)
    shares = {r.x_bin: r.avg_norm_count for r in got.collect()}
    assert shares[20000.0] == shares[40000.0] == 0.5 and sum(shares.values()) == 1.0


def test_statistics_to_clean_spectra(frame):
    signals = raw(frame).withColumn("sales_group", F.lit(1)).withColumnRenamed("20", "20_agg_avg_300")
    stats = chains.signals_to_stats(signals)
    report = chains.stats_to_outliers(stats, min_km=1.99)
    assert report.outliers.isEmpty() and report.kept.count() == 2
    report = chains.stats_to_outliers(stats, min_km=2.01)
    assert sorted(r.vin for r in report.outliers.collect()) == ["A", "B"]
    spectra = frame("vin string, sales_group int, `count` double", ("A", 1, 1.0), ("Z", 1, 1.0))
    clean = chains.combine_clean_spectra(spectra, report.outliers)
    assert [r.vin for r in clean.spectra.collect()] == ["Z"]
    assert [tuple(r) for r in clean.summary.collect()] == [(1, 2, 1, 1)]
    assert [tuple(r) for r in clean.removed.collect()] == [("A", 1)]
    assert tuple(clean.totals.first()) == (2, 1, 1)


def test_spectra_of_a_stream(spark, tmp_path, frame):
    schema = "vin string, timestamp timestamp, `20` double, `5589` double, `209_abs` double, distance_via_speed_km double"
    for part in range(2):
        rows = [(v, T, 10.0, 5000.0, 1.0, 0.5) for v in "AB"]
        frame(schema, *rows).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    name = f"live_{uuid.uuid4().hex}"
    query = start_spectra(stream, vehicle_specs("20", "5589", "209_abs"), name, "memory", mode="complete")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.table(name).where("vin = 'A' AND ls_config_id = 4").collect()
    assert [(r.x1_interval, r["count"]) for r in rows] == [("[5000,6000)", 1.0)]
