"""One query per operator, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import fleetspectra as fs
from fleetspectra.functions.binning import bin_center, interval_end, interval_start
from fleetspectra.functions.names import signal_id, signal_suffix
from fleetspectra.operators import signals as sig
from fleetspectra.plans import chains
from fleetspectra.sources.tables import shared_folder
from registry import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters under which every branch has rows in the test data.
USER_MIN_KM = 2500
USER_LIMIT_S = 21600
ORDER_MIN_KM = 20
GROUP_K = 0.5
CLUSTERS = 4
ANOMALY_COLUMNS = [
    "distance_via_speed_km", "vehicle_speed_avg_driving_kmh", "fuel_l_per_100km", "weight_avg_kg", "road_gradient_abs_avg"
]
PERIOD = ("1996-01-01 00:00:00", "1998-01-01 00:00:00")

SPECS = fs.vehicle_specs("speed", "weight", "gradient_abs")
SPEED, WEIGHT, GRADIENT = SPECS
ENGINE = fs.engine_spec("rpm", "torque", "speed")
GEAR = fs.SpectrumSpec("Gear", (fs.Axis("gear", 0, 16, 1),), (), "Gearbox")
USER_SPEED = fs.SpectrumSpec(
    "Speed of users", (fs.Axis("speed", 0, 160, 1),), ("speed >= 0", "speed <= 200"), "Users"
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- tables -----------------------------------------------------------------


@query
def read_group_family(spark, sf):
    def part(name, key, nation, balance):
        return views.table(spark, sf, name).select(
            F.col(key).alias("vin"), F.col(nation).alias("nation"), F.col(balance).alias("balance")
        )

    return fs.read_group_family(
        spark,
        {
            1: part("customer", "c_custkey", "c_nationkey", "c_acctbal"),
            2: part("supplier", "s_suppkey", "s_nationkey", "s_acctbal"),
        },
    )


@query
def read_group_family_empty(spark, sf):
    """A family without tables, then the first group's rows."""
    none = fs.read_group_family(
        spark, {}, schema="vin bigint, nation int, balance double, sales_group int"
    )
    customers = views.table(spark, sf, "customer").selectExpr(
        "c_custkey AS vin", "c_nationkey AS nation", "c_acctbal AS balance", "1 AS sales_group"
    )
    return none.unionByName(customers)


@query
def save_and_reload(spark, sf):
    name = f"signal_extract_{uuid.uuid4().hex}"
    rows = views.supplier_signals(spark, sf).select("vin", "timestamp", "speed", "weight")
    path = f"{shared_folder(spark)}/{name}"
    fs.save_signals(rows, name, path=path)
    return fs.read_table(spark, name)


# --- cohort -----------------------------------------------------------------


def _cohort(spark, sf):
    return fs.select_cohort(
        views.table(spark, sf, "part"),
        contains={"p_brand": "Brand#1", "p_name": "red", "p_type": "O"},
        columns=["p_partkey", "p_brand", "p_type", "p_size"],
    )


@query
def cohort_filter(spark, sf):
    return fs.select_cohort(
        views.table(spark, sf, "part"),
        contains={"p_brand": "Brand#1", "p_name": "e"},
        equals={"p_type": "ECONOMY"},
        columns=["p_partkey", "p_brand", "p_type", "p_size"],
    )


@query
def cohort_combinations(spark, sf):
    vehicles = fs.select_cohort(views.table(spark, sf, "part"), contains={"p_name": "red"})
    return fs.cohort_combinations(vehicles, ["p_brand", "p_type", "p_size"], "p_partkey")


@query
def cohort_signals(spark, sf):
    signals = views.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    rows = fs.extract_signals(
        signals, _cohort(spark, sf), *PERIOD, key="p_partkey", order="l_shipdate"
    )
    return rows.select("l_orderkey", "l_linenumber", "p_partkey", "l_shipdate", "l_quantity")


@query
def sample_vehicles(spark, sf):
    vehicles = views.table(spark, sf, "customer")
    return fs.sample_vehicles(vehicles, 247, 42, "c_custkey").select("c_custkey", "c_mktsegment")


@query
def time_window_filter(spark, sf):
    orders = views.table(spark, sf, "orders")
    return fs.in_period(orders, *PERIOD, order="o_orderdate").select(
        "o_orderkey", "o_custkey", "o_orderdate"
    )


@query
def vehicle_count(spark, sf):
    return fs.vehicle_count(views.user_signals(spark, sf), ["event_type"])


@query
def vehicle_count_approx(spark, sf):
    """The exact number per group, and whether the estimate is within three deviations."""
    rows, rsd = views.supplier_signals(spark, sf), 0.02
    exact = fs.vehicle_count(rows, ["sales_group"]).select("sales_group", "vehicles")
    estimate = fs.vehicle_count_approx(rows, ["sales_group"], rsd=rsd)
    both = exact.join(estimate.withColumnRenamed("vehicles", "estimate"), "sales_group")
    near = F.abs(F.col("estimate") - F.col("vehicles")) <= 3 * rsd * F.col("vehicles")
    return both.select("sales_group", "vehicles", near.alias("estimate_near"))


# --- signals ----------------------------------------------------------------


@query
def clean_signals(spark, sf):
    rules = [
        fs.CleanRule("speed", "speed > 5", USER_LIMIT_S),
        fs.CleanRule("gear", "gear <> 2", 0, fill=0),
    ]
    rows = fs.clean_signals(views.user_signals(spark, sf), rules, tie=["event_id"])
    return rows.select("vin", "event_id", "speed", "speed_cleaned", "gear_cleaned")


@query
def derived_columns(spark, sf):
    rows = views.driven_signals(spark, sf)
    rows = sig.add_engine_power(rows, "torque", "rpm")
    rows = sig.add_year_month(rows)
    rows = sig.add_odometer_km(rows, "weight")
    rows = sig.add_torque_share(rows, "torque")
    rows = sig.add_driving_flag(rows, "speed")
    rows = sig.with_columns_in_order(
        rows,
        {"moving": F.col("speed") > 25, "moving_kw": F.when(F.col("moving"), F.col("engine_power_kw"))},
    )
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "vin",
        "distance_via_speed_km",
        "engine_power_kw",
        "gradient_abs",
        "year_month",
        "odometer_km",
        "engine_torque_percentage",
        "driving",
        "moving_kw",
    )


@query
def gear_shift_events(spark, sf):
    rows = fs.add_gear_shift(views.user_signals(spark, sf), "gear", tie=["event_id"])
    return rows.select(
        "vin", "event_id", "gear", "gear_lag", "gear_shift_event", "gear_from", "gear_to"
    )


@query
def time_since_last(spark, sf):
    rows = fs.add_time_since_last(views.user_signals(spark, sf), tie=["event_id"])
    return rows.select("vin", "event_id", "diff_time_to_last_timestamp_vin_min")


@query
def distance_by_gap(spark, sf):
    rows = sig.add_distance_by_gap(
        views.user_signals(spark, sf), "speed", max_gap_s=USER_LIMIT_S, tie=["event_id"]
    )
    return rows.select("vin", "event_id", "distance_via_speed_km")


@query
def prepare_signals(spark, sf):
    """The whole preparation: clean two signals, drop, derive, time since the last row."""
    raw = views.user_signals(spark, sf).selectExpr(
        "vin",
        "timestamp",
        "event_id",
        "speed AS `20`",
        "IF(gear <> 2, speed * 10D, 0D) AS `11`",
        "speed / 10D AS `87`",
        "speed - 50D AS `209`",
        "gear * 100D AS `4`",
    )
    rows = chains.prepare_signals(raw, limit_s=USER_LIMIT_S, time_since_last=True)
    return rows.selectExpr(
        "vin",
        "event_id",
        "`11_cleaned` AS rpm_cleaned",
        "`87_cleaned` AS fuel_cleaned",
        "`20_cleaned` AS speed_cleaned",
        "`209_abs` AS gradient_abs",
        "distance_via_speed_km",
        "engine_power_kw",
        "year_month",
        "diff_time_to_last_timestamp_vin_min",
    )


# --- spectra ----------------------------------------------------------------


def _spectra(spark, sf, specs, weights=("time", "distance"), group_by=("vin",)):
    return fs.spectra(views.driven_signals(spark, sf), specs, weights, group_by=group_by)


@query
def spectra_1d_time(spark, sf):
    return _spectra(spark, sf, [WEIGHT], ["time"])


@query
def spectra_1d_distance(spark, sf):
    return _spectra(spark, sf, [WEIGHT], ["distance"])


@query
def spectra_2d_time(spark, sf):
    return _spectra(spark, sf, [ENGINE], ["time"])


@query
def spectra_2d_distance(spark, sf):
    return _spectra(spark, sf, [ENGINE], ["distance"])


@query
def spectra_all_configs(spark, sf):
    return _spectra(spark, sf, SPECS)


@query
def spectra_user_speed(spark, sf):
    rows = sig.add_distance(views.user_signals(spark, sf), "speed", sample_s=3600)
    return fs.spectra(rows, [USER_SPEED], ["time", "distance"])


@query
def spectra_clipped(spark, sf):
    rows = sig.add_distance(views.user_signals(spark, sf), "speed", sample_s=3600)
    spec = fs.SpectrumSpec("Clipped", (fs.Axis("speed", 5, 100, 2.5),), (), "", "clip")
    return fs.spectra(rows, [spec], ["time", "distance"])


@query
def spectra_inspect(spark, sf):
    return fs.one_spectrum(_spectra(spark, sf, SPECS), 4)


@query
def inspect_vehicle(spark, sf):
    """One vehicle's spectrum, the highest bin first."""
    return fs.inspect_vehicle(_spectra(spark, sf, SPECS), 1, 4)


@query
def stack_spectra(spark, sf):
    """Counts of time as whole numbers under distances."""
    time = _spectra(spark, sf, [WEIGHT], ["time"])
    time = time.withColumn("count", F.col("count").cast("bigint"))
    return fs.stack_spectra([time, _spectra(spark, sf, [WEIGHT], ["distance"])])


@query
def translate_spectra(spark, sf):
    rows = sig.add_distance(views.user_signals(spark, sf), "speed", sample_s=3600)
    counted = fs.spectra(rows, [GEAR, USER_SPEED], ["time"])
    mapping, states = views.signal_mapping(spark), views.state_mapping(spark, sf)
    return fs.translate_spectra(counted, mapping, states, net_type=1026)


@query
def translate_two_axes(spark, sf):
    rows = sig.add_distance(views.user_signals(spark, sf), "speed", sample_s=3600)
    wide = fs.Axis("speed", 0, 160, 20)
    spec = fs.SpectrumSpec("Gear by speed", (GEAR.axes[0], wide), ("speed > 0",), "Gearbox")
    mapping, states = views.signal_mapping(spark), views.state_mapping(spark, sf)
    return fs.translate_spectra(fs.spectra(rows, [spec]), mapping, states, net_type=1026)


@query
def spectra_metadata(spark, sf):
    metadata = fs.name_signals(fs.spectra_metadata(spark, SPECS), views.signal_mapping(spark))
    counted = _spectra(spark, sf, SPECS).groupBy("ls_config_id")
    totals = counted.agg(
        F.count(F.lit(1)).alias("bins"), F.count_distinct("vin").alias("vehicles")
    )
    return metadata.join(totals, "ls_config_id").select(
        "ls_config_id",
        "title",
        "tag",
        "count_type",
        "description",
        "x1_signal_in_config",
        "x1_signal_id",
        "x1_signal_suffix",
        "x1_signal",
        "x1_unit",
        "bins",
        "vehicles",
    )


@query
def spectra_metadata_two_axes(spark, sf):
    """Metadata of a spectrum over two signals, one of them derived."""
    rows = views.driven_signals(spark, sf).withColumnsRenamed(
        {"speed": "20", "gradient_abs": "209_abs"}
    )
    axes = (fs.Axis("20", 0, 160, 20), fs.Axis("209_abs", 0, 25, 1))
    specs = [fs.SpectrumSpec("Speed by gradient", axes, ("`20` > 0",), "Entire vehicle")]
    mapping = spark.createDataFrame(
        [("20", "VehSpd", "VehSpd_Cval", "float", "km/h"), ("209", "RoadGrad", None, "float", "%")],
        "signal_id string, signal_name string, can_signal_name string, type string, unit string",
    )
    metadata = fs.name_signals(fs.spectra_metadata(spark, specs), mapping)
    totals = fs.spectra(rows, specs).groupBy("ls_config_id").agg(
        F.count(F.lit(1)).alias("bins"), F.count_distinct("vin").alias("vehicles")
    )
    return metadata.join(totals, "ls_config_id").select(
        "ls_config_id",
        "title",
        "count_type",
        "description",
        *[f"x{n}_{c}" for n in (1, 2) for c in ("signal_in_config", "signal_id", "signal_suffix", "signal", "unit")],
        "bins",
        "vehicles",
    )


@query
def signal_id_parts(spark, sf):
    part = views.table(spark, sf, "part")
    names = part.select(
        "p_partkey",
        F.explode(
            F.array(
                F.concat_ws("_", "p_size", "p_type"), F.col("p_size").cast("string"), "p_brand"
            )
        ).alias("name"),
    )
    return names.select(
        "p_partkey", "name", signal_id(F.col("name")).alias("signal_id"),
        signal_suffix(F.col("name")).alias("signal_suffix"),
    )


@query
def interval_edges(spark, sf):
    labels = _spectra(spark, sf, [ENGINE], ["time"]).select("vin", "x1_interval", "x2_interval")
    label = F.col("x2_interval")
    return labels.select(
        "*",
        interval_start(label).alias("lo"),
        interval_end(label).alias("hi"),
        interval_start(label, signed=False).alias("lo_unsigned"),
        bin_center(label).alias("center"),
    )


# --- grid -------------------------------------------------------------------


def _stored_spectra(spark, sf, spec, group_by=("vin",)):
    """A spectrum that is read several times, as its stored table."""
    counted = _spectra(spark, sf, [spec], ["distance"], group_by).drop("ls_config_id")
    return fs.stored(counted, "spectrum")


def _complete(spark, sf, spec, rule):
    return fs.complete_spectra(_stored_spectra(spark, sf, spec), rule.lo, rule.hi, rule.width)


@query
def grid_bounds(spark, sf):
    return fs.grid_bounds(_spectra(spark, sf, SPECS), ["ls_config_id"])


@query
def upper_edge_p99(spark, sf):
    return fs.upper_edge_quantile(_spectra(spark, sf, SPECS), 0.99, ["ls_config_id"])


@query
def complete_speed(spark, sf):
    return _complete(spark, sf, SPEED, chains.SPEED_GRID)


@query
def complete_spectra(spark, sf):
    return _complete(spark, sf, WEIGHT, chains.WEIGHT_GRID)


@query
def complete_gradient(spark, sf):
    return _complete(spark, sf, GRADIENT, chains.GRADIENT_GRID)


@query
def complete_to_p99_by_group(spark, sf):
    rows = _stored_spectra(spark, sf, WEIGHT, ("sales_group", "vin"))
    return fs.complete_spectra(rows, "min", ("p", 0.99), 1000, by=["sales_group"], keep_above=True)


@query
def total_distance(spark, sf):
    return fs.total_distance(_spectra(spark, sf, [WEIGHT], ["distance"]))


@query
def normalize_spectra(spark, sf):
    full = fs.complete_spectra(_spectra(spark, sf, [WEIGHT], ["distance"]), 0, 55000, 1000)
    return fs.normalize_spectra(full).select("vin", "x1_interval", "normalized_count")


@query
def rebin_spectra(spark, sf):
    return fs.rebin_spectra(_spectra(spark, sf, [WEIGHT], ["distance"]), 4, 0, 1000)


# --- statistics and outliers --------------------------------------------------

NAMES = fs.SignalNames("speed", "fuel_flow", "weight", "gradient")
USER_NAMES = fs.SignalNames("speed", None, None, None)


@query
def vehicle_stats(spark, sf):
    out = fs.vehicle_stats(views.supplier_signals(spark, sf), NAMES, ["vin", "sales_group"])
    return out.withColumn("road_gradient_stddev", F.round("road_gradient_stddev", 6))


def _user_stats(spark, sf, store=True):
    """Statistics per user, one row an hour, with the user's group; stored where they are read again."""
    stats = fs.vehicle_stats(
        views.user_signals(spark, sf), USER_NAMES, ["vin"], sample_s=3600, sna=None
    )
    stats = stats.join(views.user_groups(spark, sf), "vin")
    return fs.stored(stats, "stats") if store else stats


@query
def min_mileage_filter(spark, sf):
    return fs.mileage_outliers(_user_stats(spark, sf, store=False), USER_MIN_KM).kept


@query
def mileage_summary(spark, sf):
    return fs.mileage_outliers(_user_stats(spark, sf, store=False), USER_MIN_KM).summary


@query
def removed_vins_bag(spark, sf):
    return fs.mileage_outliers(_user_stats(spark, sf, store=False), USER_MIN_KM).removed


@query
def iqr_bounds(spark, sf):
    kept = fs.mileage_outliers(_user_stats(spark, sf), USER_MIN_KM).kept
    return fs.iqr_bounds(kept, "vehicle_speed_avg_driving_kmh")


@query
def iqr_filter(spark, sf):
    kept = fs.mileage_outliers(_user_stats(spark, sf), USER_MIN_KM).kept
    return fs.iqr_outliers(kept).kept


def _user_report(spark, sf):
    return chains.stats_to_outliers(_user_stats(spark, sf), USER_MIN_KM, store=False)


@query
def iqr_summary(spark, sf):
    return _user_report(spark, sf).speed_summary


@query
def outlier_vins(spark, sf):
    return _user_report(spark, sf).outliers


@query
def completeness_outliers(spark, sf):
    rows = views.user_signals(spark, sf).select(
        "vin",
        F.when(F.col("event_type") != "error", F.col("speed")).alias("rpm"),
        F.when(F.col("speed") < 100, F.col("speed")).alias("fuel"),
    )
    return fs.completeness_outliers(rows, ["rpm", "fuel"], 0.8)


def _grouped(spark, sf, store=False):
    """Weight spectra (stored where they are read again) and outliers of vehicles that are in several groups."""
    spectra = _spectra(spark, sf, [WEIGHT], ["distance"], ("sales_group", "vin")).drop("ls_config_id")
    spectra = fs.stored(spectra, "spectrum") if store else spectra
    stats = fs.vehicle_stats(views.supplier_signals(spark, sf), NAMES, ["sales_group", "vin"])
    found = fs.iqr_outliers(fs.stored(stats, "stats"), k=GROUP_K).removed
    # Stored, the list has a known size and the spectra need no shuffle to lose it.
    return spectra, fs.stored(found, "outliers")


@query
def remove_outliers(spark, sf):
    return chains.combine_clean_spectra(*_grouped(spark, sf)).spectra


@query
def remove_outliers_same_group(spark, sf):
    return fs.remove_outliers(*_grouped(spark, sf), scope="same_group")


@query
def removed_vins_set(spark, sf):
    return chains.combine_clean_spectra(*_grouped(spark, sf)).removed


@query
def removal_summary(spark, sf):
    return fs.removal_summary(*_grouped(spark, sf), scope="same_group")


@query
def removal_totals(spark, sf):
    return chains.combine_clean_spectra(*_grouped(spark, sf), scope="same_group").totals


def _order_spectra(spark, sf):
    spec = fs.SpectrumSpec("Order weight", (fs.Axis("weight", 0, 100000, 1000),))
    rows = views.order_signals(spark, sf)
    return fs.spectra(rows, [spec], ["distance"], group_by=("vin", "sales_group"))


@query
def weight_matrix(spark, sf):
    return fs.weight_matrix(_order_spectra(spark, sf))


@query
def weight_shares(spark, sf):
    return fs.weight_shares(fs.weight_matrix(_order_spectra(spark, sf)))


@query
def zero_mass_outliers(spark, sf):
    return fs.zero_mass_outliers(_order_spectra(spark, sf))


@query
def clean_chain_zero_mass(spark, sf):
    """Spectra on their common grid, without vehicles of little mileage, then the ones that carry no weight."""
    spectra = fs.stored(_order_spectra(spark, sf).drop("ls_config_id"), "spectrum")
    totals = fs.total_distance(spectra, ["sales_group", "vin"])
    found = fs.mileage_outliers(totals, ORDER_MIN_KM, "total_distance").removed
    full = fs.complete_spectra(spectra, *chains.WEIGHT_GRID, by=["sales_group"])
    clean = chains.combine_clean_spectra(full, fs.stored(found, "outliers")).spectra
    return fs.zero_mass_outliers(clean, edges=("interval_start", "interval_end"))


# --- fleets -----------------------------------------------------------------


def _regional(spark, sf, spec=WEIGHT):
    """A stored spectrum on its common grid, with each vehicle's region."""
    counted = _spectra(spark, sf, [spec], ["distance"])
    full = fs.complete_spectra(counted, 0, 55000, 1000)
    full = full.select("vin", "x1_interval", "interval_start", "count")
    return fs.stored(full.join(views.supplier_regions(spark, sf), "vin"), "complete")


@query
def fleet_average(spark, sf):
    return fs.fleet_average(_regional(spark, sf))


@query
def fleet_average_by_group(spark, sf):
    return chains.fleet_average_of_signals(
        views.driven_signals(spark, sf), WEIGHT, chains.GridRule(0, 55000, 1000)
    )


@query
def vehicle_vs_fleet(spark, sf):
    return fs.vehicle_vs_fleet(_regional(spark, sf), ["sales_group"])


@query
def fleet_before_after(spark, sf):
    spectra, found = _grouped(spark, sf, store=True)
    return fs.fleet_before_after(
        spectra, found, ["sales_group"], "x1_quantized", on=["vin", "sales_group"]
    )


def _regional_stats(spark, sf):
    stats = fs.vehicle_stats(views.supplier_signals(spark, sf), NAMES, ["vin"])
    return stats.join(views.supplier_regions(spark, sf), "vin")


PARAMETERS = ["fuel_l_per_100km", "weight_avg_kg", "vehicle_speed_avg_driving_kmh"]


@query
def weighted_fleet_average(spark, sf):
    return fs.weighted_fleet_average(
        _regional_stats(spark, sf), PARAMETERS, "distance_via_speed_km"
    )


@query
def weighted_fleet_average_time(spark, sf):
    return fs.weighted_fleet_average(_regional_stats(spark, sf), PARAMETERS, "operating_time_h")


@query
def radar_profile(spark, sf):
    averages = fs.weighted_fleet_average(
        _regional_stats(spark, sf), PARAMETERS, "distance_via_speed_km"
    )
    return fs.radar_profile(fs.stored(averages, "averages"), PARAMETERS)


@query
def box_stats(spark, sf):
    return fs.box_stats(_user_stats(spark, sf), "vehicle_speed_avg_driving_kmh", k=1.0)


@query
def box_fuel_by_customer(spark, sf):
    stats = fs.vehicle_stats(views.supplier_signals(spark, sf), NAMES, ["vin"])
    stats = stats.select("vin", "fuel_l_per_100km").join(views.supplier_customers(spark, sf), "vin")
    return fs.box_stats(fs.stored(stats, "stats"), "fuel_l_per_100km", ["customer"], k=1.0)


@query
def stat_histogram(spark, sf):
    stats = _user_stats(spark, sf)
    kept = fs.iqr_outliers(stats, k=GROUP_K).kept
    column = "vehicle_speed_avg_driving_kmh"
    both = fs.read_group_family(
        spark, {"before": stats.select(column), "after": kept.select(column)}, "stage"
    )
    return fs.stat_histogram(both, column, "stage")


@query
def value_quantiles(spark, sf):
    """Quantiles of all raw readings per kind of event."""
    return fs.grouped_quantiles(
        views.user_signals(spark, sf), "speed", {"p01": 0.01, "p50": 0.5, "p99": 0.99}, ["event_type"]
    )


# --- distances, clusters, anomalies ---------------------------------------------


def _rounded(df, column):
    return df.withColumn(column, F.round(column, 6))


@query
def spectra_distance(spark, sf):
    """Each vehicle's Wasserstein distance from the mean spectrum of its region."""
    return _rounded(fs.fleet_distances(_regional_grid(spark, sf), ["sales_group"]), "distance")


@query
def spectra_distance_groups(spark, sf):
    return _rounded(fs.group_distances(_regional_grid(spark, sf), "sales_group"), "distance")


def _regional_grid(spark, sf):
    """Weight spectra on their common grid, with each vehicle's region."""
    full = fs.complete_spectra(_spectra(spark, sf, [WEIGHT], ["distance"]), 0, 55000, 1000)
    full = full.select("vin", "interval_start", "interval_end", "count")
    return fs.stored(full.join(views.supplier_regions(spark, sf), "vin"), "complete")


def _clusters(spark, sf):
    full = fs.complete_spectra(_spectra(spark, sf, [WEIGHT], ["distance"]), 0, 100000, 1000)
    full = full.select("vin", "interval_start", "interval_end", "count")
    return fs.cluster_spectra(full, CLUSTERS, levels=20, max_rounds=12)


@query
def cluster_spectra(spark, sf):
    return _rounded(_clusters(spark, sf).vehicles, "distance")


@query
def cluster_medians(spark, sf):
    centers = _clusters(spark, sf).centers
    return centers.select("cluster", F.posexplode("q").alias("level", "median"), "vehicles")


@query
def anomaly_scores(spark, sf):
    stats = fs.stored(fs.vehicle_stats(views.supplier_signals(spark, sf), NAMES, ["vin"]), "stats")
    scored = fs.anomaly_scores(stats, ANOMALY_COLUMNS, trees=25, sample=32)
    return scored.select("vin", F.round("anomaly_score", 9).alias("anomaly_score"))


# --- streams ------------------------------------------------------------------

ARRIVALS, LATE_S = 6, 1800


def _arriving(spark, sf):
    """The users' signals as a stream of files: up to half an hour late, and one row far ahead at the end."""
    rows = views.user_signals(spark, sf)
    arrival = F.unix_seconds("timestamp") + F.pmod(F.xxhash64("event_id"), F.lit(LATE_S))
    ends = rows.agg(F.min(arrival).alias("lo"), F.max(arrival).alias("hi")).head()
    span = max(1, -(-(ends["hi"] + 1 - ends["lo"]) // ARRIVALS))
    folder = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    for n in range(ARRIVALS):
        # One file each, so that the number of micro-batches does not grow with the table's files.
        rows.where(F.floor((arrival - ends["lo"]) / span) == n).repartition(1).write.mode("append").parquet(folder)
    last = {"vin": F.lit(-1), "timestamp": F.timestamp_seconds(F.lit(ends["hi"] + 10 * span)), "event_id": F.lit(-1)}
    spark.range(1).select(*[last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    # The files of one stretch of arrivals may come in any order.
    return stream, f"{span + LATE_S} seconds"


def _run_stream(spark, rows, keys=(), mode="append"):
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table = fs.BatchTable(spark, f"{folder}/table", keys, snapshot_every=3)
    fs.start_table(rows, table, f"stream_{uuid.uuid4().hex}", mode, once=True, checkpoint=f"{folder}/checkpoint").awaitTermination()
    return table.read().where("vin <> -1")


@query
def stream_clean_signals(spark, sf):
    """Cleaning and the previous row over late rows in micro-batches."""
    stream, delay = _arriving(spark, sf)
    rules = [fs.CleanRule("speed", "speed > 5", USER_LIMIT_S), fs.CleanRule("gear", "gear <> 2", 0, fill=0)]
    before = {"event_before": "event_id", "time_before": "timestamp"}
    cleaned = fs.clean_stream(stream, rules, before, {"event_before": -1}, tie=["event_id"], delay=delay)
    found = _run_stream(spark, cleaned)
    time_before = F.col("time_before").cast("timestamp_ntz").alias("time_before")
    return found.select("vin", "event_id", "speed", "speed_cleaned", "gear_cleaned", "event_before", time_before)


@query
def stream_spectra(spark, sf):
    """A spectrum that grows batch by batch, each changed bin put in the place of its last value."""
    stream, _ = _arriving(spark, sf)
    counted = fs.spectra(stream, [USER_SPEED], ["time"])
    return _run_stream(spark, counted, ["ls_config_id", "vin", "x1_quantized"], "update")


# --- storage, sketches, interpolation, two axes -----------------------------------


@query
def save_and_reload_orc(spark, sf):
    """A table in another format than the default one."""
    name = f"signal_extract_{uuid.uuid4().hex}"
    rows = views.supplier_signals(spark, sf).select("vin", "timestamp", "speed", "weight")
    fs.save_signals(rows, name, fmt="orc", path=f"{shared_folder(spark)}/{name}")
    return fs.read_table(spark, name)


@query
def bucketed_spectra(spark, sf):
    """Completing and normalising a stored table that is dealt by vehicle, without another shuffle."""
    name = f"spectra_{uuid.uuid4().hex}"
    counted = _spectra(spark, sf, [WEIGHT], ["distance"]).drop("ls_config_id")
    fs.save_bucketed(counted, name, 8, sort_by=["x1_quantized"], path=f"{shared_folder(spark)}/{name}")
    full = fs.complete_spectra(fs.read_table(spark, name), 0, 55000, 1000)
    return fs.normalize_spectra(full).select("vin", "x1_interval", "normalized_count")


@query
def vehicle_count_merged(spark, sf):
    """Vehicles per kind of event from sketches of months: as from one sketch, and near the exact number."""
    rows = sig.add_year_month(views.user_signals(spark, sf)).select("event_type", "year_month", "vin")
    months = fs.stored(fs.vehicle_sketches(rows, ["event_type", "year_month"]), "sketches")
    merged = fs.sketched_count(months, ["event_type"]).withColumnRenamed("vehicles", "merged")
    direct = fs.sketched_count(fs.vehicle_sketches(rows, ["event_type"]), ["event_type"]).withColumnRenamed("vehicles", "direct")
    both = fs.vehicle_count(rows, ["event_type"]).join(merged, "event_type").join(direct, "event_type")
    near = F.abs(F.col("merged") - F.col("vehicles")) <= 3 + F.col("vehicles") / F.lit(1000.0)
    return both.select("event_type", "vehicles", (F.col("merged") == F.col("direct")).alias("merged_is_direct"), near.alias("estimate_near"))


@query
def interpolate_signals(spark, sf):
    rows = fs.interpolate_signals(
        views.user_signals(spark, sf), [fs.CleanRule("speed", "speed > 5", USER_LIMIT_S)], tie=["event_id"]
    )
    return rows.select("vin", "event_id", "speed", "speed_cleaned")


@query
def sorted_fleet_average(spark, sf):
    averages = fs.fleet_average(_regional(spark, sf), ["sales_group"])
    return fs.sort_averages(averages, ["sales_group"])


@query
def complete_two_spectra(spark, sf):
    """Two spectra in one table, each on its own grid."""
    both = _spectra(spark, sf, [SPEED, GRADIENT], ["distance"])
    full = fs.complete_spectra(fs.stored(both, "spectra"), "min", "max", 1)
    return full.select("ls_config_id", "vin", "x1_interval", "interval_start", "count")


def _regional_cells(spark, sf):
    cells = _spectra(spark, sf, [ENGINE], ["distance"]).select("vin", "x1_quantized", "x2_quantized", "count")
    return fs.fleet_average_cells(cells.join(views.supplier_regions(spark, sf), "vin"), ["sales_group"])


@query
def fleet_average_cells(spark, sf):
    return _regional_cells(spark, sf)


@query
def complete_engine_cells(spark, sf):
    """The averages of all cells of the engine map, empty ones included."""
    axes = {f"x{n}_quantized": (a.start, a.stop, a.width) for n, a in enumerate(ENGINE.axes, 1)}
    return fs.complete_cells(fs.stored(_regional_cells(spark, sf), "cells"), axes, ["sales_group"])
