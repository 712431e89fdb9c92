"""Test tables as signals, vehicles and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which event stands for which gear.
GEARS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}

# The columns of the test tables, so that Spark need not open
# the files to plan a query.
COLUMNS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf}/{name}.parquet")


def user_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Events as signals in time order: vehicle = user, speed = value."""
    cases = " ".join(f"WHEN '{event}' THEN {number}" for event, number in GEARS.items())
    gear = F.expr(f"CASE event_type {cases} END")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("vin"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("speed"),
        gear.alias("gear"),
        "event_type",
        "event_id",
    )


def supplier_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as dense signals: vehicle = supplier, one row per second."""
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("vin"),
        F.col("l_shipdate").alias("timestamp"),
        quantity.alias("speed"),
        price.alias("weight"),
        (price / F.lit(20.0)).alias("rpm"),
        ((quantity - F.lit(25.0)) * F.lit(120.0)).alias("torque"),
        ((F.col("l_discount") - F.lit(0.05)) * F.lit(100.0)).alias("gradient"),
        (F.col("l_tax") * F.lit(500.0)).alias("fuel_flow"),
        F.col("l_returnflag").alias("sales_group"),
        "l_orderkey",
        "l_linenumber",
    )


def driven_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier signals with distance and absolute gradient."""
    from fleetspectra.operators.signals import add_abs, add_distance

    return add_abs(add_distance(supplier_signals(spark, sf), "speed"), "gradient")


def order_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with the order as vehicle; an order may be in two groups."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("vin"),
        F.col("l_linestatus").alias("sales_group"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_extendedprice").alias("weight"),
        F.col("l_quantity").alias("distance_via_speed_km"),
    )


def user_groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("vin"), F.col("c_mktsegment").alias("sales_group")
    )


def supplier_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The region of each supplier as its group."""
    supplier = table(spark, sf, "supplier")
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(F.col("s_suppkey").alias("vin"), F.col("r_name").alias("sales_group"))
    )


def supplier_customers(spark: SparkSession, sf: str) -> DataFrame:
    """The nation of each supplier as the customer who runs it."""
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("vin"), F.col("n_name").alias("customer")
    )


def signal_mapping(spark: SparkSession) -> DataFrame:
    """Lookup of signals; a dictionary, the same at every scale."""
    return spark.createDataFrame(
        [
            ("gear", "Gear", None, "enum", "No unit"),
            ("speed", "VehSpd", "VehSpd_Cval", "float", "km/h"),
            ("weight", "Weight", None, "float", "kg"),
            ("gradient_abs", "RoadGrad", "RoadGrad_Cval", "float", "%"),
        ],
        "signal_id string, signal_name string, can_signal_name string, type string, unit string",
    )


def state_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as texts of gears; the region tells the vehicle network."""
    return table(spark, sf, "nation").select(
        (F.col("n_regionkey") + 1024).alias("vehicle_net_type"),
        F.lit("gear").alias("signal_id"),
        F.col("n_nationkey").cast("double").alias("value"),
        F.col("n_name").alias("text"),
    )
