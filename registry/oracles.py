"""The same results in plain SQL, for a comparison on the test tables."""

from __future__ import annotations

import math

USER_MIN_KM = 2500
USER_LIMIT_S = 21600
ORDER_MIN_KM = 20
GROUP_K = 0.5
PERIOD = ("1996-01-01 00:00:00", "1998-01-01 00:00:00")


def total(x: str, over: str = "") -> str:
    """Sum of the limbs of 20 bits of doubles, each sum a whole number without a cap."""
    rest, sums = f"(CAST({x} AS DOUBLE) / CAST(1048576 AS DOUBLE))", []
    for _ in range(5):
        limb = f"round_even({rest}, 0)"
        sums.append(f"CAST(sum(CAST({limb} AS HUGEINT)){over} AS DOUBLE)")
        rest = f"(({rest} - {limb}) * CAST(1048576 AS DOUBLE))"
    fraction = "CAST(0 AS DOUBLE)"
    for part in sums[:1:-1]:
        fraction = f"(({fraction} + {part}) / CAST(1048576 AS DOUBLE))"
    return f"(({sums[0]} * CAST(1048576 AS DOUBLE) + {sums[1]}) + {fraction})"


def mean(x: str) -> str:
    return f"({total(x)} / nullif(count({x}), 0))"


def label(lo: str, hi: str) -> str:
    def edge(x):
        return (
            f"CASE WHEN ({x}) = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST(CAST({x} AS DOUBLE) AS VARCHAR) END"
        )

    return f"('[' || {edge(lo)} || ',' || {edge(hi)} || ')')"


USERS = """
u AS (
  SELECT user_id AS vin, ts, value AS speed, event_id, event_type,
         CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
                         WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END AS gear
  FROM events)"""

ITEMS = """
s AS (
  SELECT l_suppkey AS vin, l_shipdate AS ts, l_quantity AS speed, l_extendedprice AS weight,
         l_extendedprice / 20.0 AS rpm, (l_quantity - 25.0) * 120.0 AS torque,
         (l_discount - CAST(0.05 AS DOUBLE)) * 100.0 AS gradient,
         abs((l_discount - CAST(0.05 AS DOUBLE)) * 100.0) AS gradient_abs,
         l_tax * 500.0 AS fuel_flow, l_returnflag AS sales_group, l_orderkey, l_linenumber,
         CASE WHEN l_quantity <> 200 THEN l_quantity * 1.0 / 3600.0 END AS km
  FROM lineitem)"""

REGIONS = """
g AS (
  SELECT s_suppkey AS vin, r_name AS sales_group
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


# --- spectra ----------------------------------------------------------------


class Ax:
    def __init__(self, signal, start, stop, width):
        self.signal, self.start, self.stop, self.width = signal, start, stop, width

    @property
    def inside(self):
        return f"{self.signal} >= {self.start} AND {self.signal} < {self.stop}"

    @property
    def lo(self):
        return (
            f"CAST({self.start} + floor(({self.signal} - {self.start}) / {self.width}.0)"
            f" * {self.width} AS DOUBLE)"
        )


SPEED = Ax("speed", 0, 160, 1)
WEIGHT = Ax("weight", 0, 100000, 1000)
GRADIENT = Ax("gradient_abs", 0, 25, 1)
RPM, TORQUE = Ax("rpm", 0, 5000, 50), Ax("torque", -3000, 3000, 50)


def spectrum(config, axes, where, count, source="s", group=("vin",)):
    """One spectrum as a SELECT, in the columns of the spectra table."""
    cols = []
    for n, ax in enumerate(axes, 1):
        hi = f"(x{n}_quantized + {ax.width})"
        cols += [
            f"'{ax.signal}' AS x{n}_signal_id",
            f"x{n}_quantized",
            f"{hi} AS x{n}_upper",
            f"{label(f'x{n}_quantized', hi)} AS x{n}_interval",
        ]
    keys = ", ".join(f"{ax.lo} AS x{n}_quantized" for n, ax in enumerate(axes, 1))
    test = " AND ".join([where] + [ax.inside for ax in axes])
    grouping = ", ".join(str(i + 1) for i in range(len(group) + len(axes)))
    return f"""
  SELECT CAST({config} AS INTEGER) AS ls_config_id, {', '.join(group)}, {', '.join(cols)}, count
  FROM (SELECT {', '.join(group)}, {keys}, {count} AS count FROM {source} WHERE {test}
        GROUP BY {grouping})"""


TIME, DIST = "CAST(count(ts) AS DOUBLE)", total("km")
RANGE, DRIVE = "speed >= 0 AND speed <= 200", "speed > 0"
ALL_SPECTRA = " UNION ALL ".join(
    [
        spectrum(1, [SPEED], RANGE, TIME),
        spectrum(2, [SPEED], RANGE, DIST),
        spectrum(3, [WEIGHT], DRIVE, TIME),
        spectrum(4, [WEIGHT], DRIVE, DIST),
        spectrum(5, [GRADIENT], DRIVE, TIME),
        spectrum(6, [GRADIENT], DRIVE, DIST),
    ]
)
WEIGHT_DIST = spectrum(2, [WEIGHT], DRIVE, DIST)
GROUPED_WEIGHT = spectrum(2, [WEIGHT], DRIVE, DIST, group=("sales_group", "vin"))
USER_KM = "CASE WHEN speed <> 200 THEN speed * 3600.0 / 3600.0 END"


def user_spectrum(config, count):
    return spectrum(config, [SPEED], RANGE, count, source="u")


def complete(spec, lo, hi, width, by=()):
    """Spectrum ``spec`` on the grid between two scalar expressions over it."""
    keys = [*by, "vin"]
    bounds = f"SELECT DISTINCT {''.join(b + ', ' for b in by)}{lo} AS lo, {hi} AS hi FROM x"
    bounds += f" GROUP BY {', '.join(by)}" if by else ""
    on = " AND ".join(f"v.{b} = b.{b}" for b in by) or "TRUE"
    return f"""
x AS ({spec}),
b AS ({bounds}),
grid AS (
  SELECT {', '.join('v.' + k for k in keys)}, CAST(b.lo + i * {width} AS DOUBLE) AS a
  FROM (SELECT DISTINCT {', '.join(keys)} FROM x) v JOIN b ON {on},
       range(0, 200) r(i) WHERE b.lo + i * {width} < b.hi),
c AS (
  SELECT {', '.join('grid.' + k for k in keys)}, {label('a', f'(a + {width})')} AS x1_interval,
         a AS interval_start, a + {width} AS interval_end, x1_signal_id,
         coalesce(count, 0.0) AS count
  FROM grid LEFT JOIN x ON {' AND '.join(f'grid.{k} = x.{k}' for k in keys)}
                       AND x.x1_quantized = grid.a)"""


def shares(source, bin_col, keys):
    part = f" OVER (PARTITION BY {', '.join(keys)})"
    return f"""
n AS (
  SELECT {', '.join(keys)}, {bin_col} AS x_bin,
         count / nullif({total('count', over=part)}, 0) AS norm_count
  FROM {source})"""


# --- statistics -------------------------------------------------------------

USER_STATS = f"""
t AS (
  SELECT vin, {total('speed * 3600.0 / 3600.0')} AS distance_via_speed_km,
         {mean('CASE WHEN speed > 0 THEN speed END')} AS vehicle_speed_avg_driving_kmh,
         {mean('speed')} AS vehicle_speed_avg_kmh, max(speed) AS vehicle_speed_max_kmh,
         CAST(count(*) AS DOUBLE) AS operating_time_h,
         CAST(count(CASE WHEN speed > 0 THEN 1 END) AS DOUBLE) AS driving_time_h
  FROM u GROUP BY vin),
st AS (SELECT t.*, c_mktsegment AS sales_group FROM t JOIN customer ON c_custkey = t.vin),
kept AS (SELECT * FROM st WHERE distance_via_speed_km >= {USER_MIN_KM}),
lost AS (SELECT vin, sales_group FROM st WHERE NOT coalesce(distance_via_speed_km >= {USER_MIN_KM}, FALSE))"""


def fences(source, k, column="vehicle_speed_avg_driving_kmh"):
    return f"""
q AS (
  SELECT sales_group, quantile_disc({column}, 0.25) AS q1, quantile_disc({column}, 0.75) AS q3
  FROM {source} GROUP BY sales_group),
f AS (
  SELECT *, q1 - CAST({k} AS DOUBLE) * (q3 - q1) AS lower_bound,
            q3 + CAST({k} AS DOUBLE) * (q3 - q1) AS upper_bound FROM q)"""


INSIDE = "vehicle_speed_avg_driving_kmh BETWEEN lower_bound AND upper_bound"


def vehicle_stats(group):
    slope = "CASE WHEN speed > 0 THEN gradient END"
    both = "weight IS NOT NULL AND km IS NOT NULL"
    keys = ", ".join(group)
    return f"""
  SELECT *, fuel_kg / 0.84 AS fuel_l,
         (fuel_kg / 0.84) / nullif(distance_via_speed_km, 0) * 100.0 AS fuel_l_per_100km
  FROM (
    SELECT {keys}, {total('km')} AS distance_via_speed_km,
      {mean('CASE WHEN speed > 0 THEN speed END')} AS vehicle_speed_avg_driving_kmh,
      {mean('speed')} AS vehicle_speed_avg_kmh, max(speed) AS vehicle_speed_max_kmh,
      CAST(count(*) AS DOUBLE) / CAST(3600 AS DOUBLE) AS operating_time_h,
      CAST(count(CASE WHEN speed > 0 THEN 1 END) AS DOUBLE) / CAST(3600 AS DOUBLE) AS driving_time_h,
      {total('fuel_flow * 1.0 / 3600.0')} AS fuel_kg,
      {total(f'CASE WHEN {both} THEN weight * km END')}
        / nullif({total(f'CASE WHEN {both} THEN km END')}, 0) AS weight_distance_based_kg,
      {mean('weight')} AS weight_avg_kg, min(weight) AS weight_min_kg,
      max(weight) AS weight_max_kg, {mean(slope)} AS road_gradient_avg,
      {mean(f'abs({slope})')} AS road_gradient_abs_avg,
      round(stddev_samp({slope}), 6) AS road_gradient_stddev
    FROM s GROUP BY {keys})"""


GROUPED = f"""{ITEMS},
x AS ({GROUPED_WEIGHT}),
st AS ({vehicle_stats(['sales_group', 'vin'])}),{fences('st', GROUP_K)},
o AS (SELECT vin, sales_group FROM st JOIN f USING (sales_group) WHERE NOT coalesce({INSIDE}, FALSE))"""

X = ("sales_group, vin, x1_signal_id, x1_quantized, x1_upper, x1_interval, count").split(", ")
X_COLS = ", ".join("x." + c for c in X)

ORDER_ROWS = """
w AS (
  SELECT l_orderkey AS vin, l_linestatus AS sales_group, l_extendedprice AS weight,
         l_quantity AS km FROM lineitem)"""

ORDERS = f"""{ORDER_ROWS},
x AS ({spectrum(2, [WEIGHT], 'TRUE', DIST, source='w', group=('vin', 'sales_group'))})"""

PARAMETERS = ["fuel_l_per_100km", "weight_avg_kg", "vehicle_speed_avg_driving_kmh"]


def weighted(value, weight):
    both = f"{value} IS NOT NULL AND {weight} IS NOT NULL"
    return (
        f"{total(f'CASE WHEN {both} THEN {value} * {weight} END')}"
        f" / nullif({total(f'CASE WHEN {both} THEN {weight} END')}, 0)"
    )


REGIONAL_STATS = f"""{ITEMS},{REGIONS},
st AS (SELECT v.*, g.sales_group FROM ({vehicle_stats(['vin'])}) v JOIN g USING (vin)),
r AS (SELECT sales_group, {', '.join(
    f'{weighted(p, "distance_via_speed_km")} AS {p}' for p in PARAMETERS)}
      FROM st GROUP BY sales_group)"""

REGIONAL = f"""{ITEMS},{REGIONS},{complete(WEIGHT_DIST, '0', '55000', 1000)},
cg AS (SELECT c.*, g.sales_group FROM c JOIN g USING (vin))"""

CENTERS = [12500 + 1000 * i for i in range(38)]


def sql() -> dict[str, str]:
    out: dict[str, str] = {}

    out["read_group_family"] = """
SELECT c_custkey AS vin, c_nationkey AS nation, c_acctbal AS balance, 1 AS sales_group FROM customer
UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, 2 FROM supplier"""
    out["read_group_family_empty"] = """
SELECT c_custkey AS vin, c_nationkey AS nation, c_acctbal AS balance, 1 AS sales_group FROM customer"""
    out["save_and_reload"] = f"WITH {ITEMS} SELECT vin, ts AS timestamp, speed, weight FROM s"

    out["cohort_filter"] = """
SELECT p_partkey, p_brand, p_type, p_size FROM part
WHERE contains(p_brand, 'Brand#1') AND contains(p_name, 'e') AND p_type = 'ECONOMY'"""
    out["cohort_combinations"] = """
SELECT p_brand, p_type, p_size, count(p_partkey) AS truck_count FROM part
WHERE contains(p_name, 'red') GROUP BY 1, 2, 3"""
    period = " AND ".join(
        ["{c} >= TIMESTAMP '%s'" % PERIOD[0], "{c} < TIMESTAMP '%s'" % PERIOD[1]]
    )
    out["cohort_signals"] = f"""
SELECT l_orderkey, l_linenumber, l_partkey AS p_partkey, l_shipdate, l_quantity FROM lineitem
WHERE {period.format(c='l_shipdate')} AND l_partkey IN (
  SELECT p_partkey FROM part WHERE contains(p_brand, 'Brand#1') AND contains(p_name, 'red')
  AND contains(p_type, 'O'))"""
    out["sample_vehicles"] = """
SELECT c_custkey, c_mktsegment FROM customer
ORDER BY md5(CAST(c_custkey AS VARCHAR) || '42'), c_custkey LIMIT 247"""
    out["time_window_filter"] = f"""
SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE {period.format(c='o_orderdate')}"""
    out["vehicle_count"] = """
SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS vehicles FROM events GROUP BY 1"""

    out["vehicle_count_approx"] = """
SELECT l_returnflag AS sales_group, count(DISTINCT l_suppkey) AS vehicles, TRUE AS estimate_near
FROM lineitem GROUP BY 1"""

    out["clean_signals"] = f"""
WITH {USERS}
SELECT vin, event_id, speed, speed_cleaned, CASE WHEN gear <> 2 THEN gear ELSE 0 END AS gear_cleaned
FROM (
  SELECT *, coalesce(CASE WHEN speed > 5 THEN speed END,
    last_value(CASE WHEN speed > 5 THEN speed END IGNORE NULLS) OVER (
      PARTITION BY vin ORDER BY ts
      RANGE BETWEEN INTERVAL {USER_LIMIT_S} SECONDS PRECEDING AND CURRENT ROW)) AS speed_cleaned
  FROM u)
WHERE speed_cleaned IS NOT NULL"""
    power = f"torque * rpm * {2 * math.pi / 60000:.17e}"
    out["derived_columns"] = f"""
WITH {ITEMS}
SELECT l_orderkey, l_linenumber, vin, km AS distance_via_speed_km, {power} AS engine_power_kw,
  gradient_abs, CAST(year(ts) * 100 + month(ts) AS INTEGER) AS year_month,
  weight / 1000.0 AS odometer_km,
  CASE WHEN torque > 0 THEN torque / 2500.0 ELSE 0.0 END AS engine_torque_percentage,
  coalesce(speed <> 200 AND speed > 0, FALSE) AS driving,
  CASE WHEN speed > 25 THEN {power} END AS moving_kw
FROM s"""
    out["gear_shift_events"] = f"""
WITH {USERS},
l AS (SELECT *, lag(gear, 1, 0) OVER (PARTITION BY vin ORDER BY ts, event_id) AS gear_lag FROM u)
SELECT vin, event_id, gear, gear_lag,
  CASE WHEN gear <> gear_lag THEN 1 ELSE 0 END AS gear_shift_event,
  CASE WHEN gear <> gear_lag THEN gear_lag ELSE 0 END AS gear_from,
  CASE WHEN gear <> gear_lag THEN gear ELSE 0 END AS gear_to
FROM l"""
    sec = "CAST(floor(epoch({0})) AS BIGINT)"
    lagged = f"""
WITH {USERS},
l AS (SELECT *, lag(ts) OVER (PARTITION BY vin ORDER BY ts, event_id) AS before FROM u)"""
    out["time_since_last"] = f"""{lagged}
SELECT vin, event_id, CAST({sec.format('ts')} - {sec.format('before')} AS DOUBLE) / 60.0
  AS diff_time_to_last_timestamp_vin_min FROM l"""
    out["distance_by_gap"] = f"""{lagged}
SELECT vin, event_id, CASE WHEN before IS NOT NULL AND speed <> 200 THEN
  speed * least((epoch_us(ts) - epoch_us(before)) / 1e6, {USER_LIMIT_S}.0) / 3600.0 END
  AS distance_via_speed_km FROM l"""

    out["prepare_signals"] = f"""
WITH {USERS},
p AS (SELECT *, CASE WHEN gear <> 2 THEN speed * 10.0 ELSE 0.0 END AS rpm FROM u),
c AS (
  SELECT *, coalesce(CASE WHEN rpm > 0 THEN rpm END,
    last_value(CASE WHEN rpm > 0 THEN rpm END IGNORE NULLS) OVER (
      PARTITION BY vin ORDER BY ts
      RANGE BETWEEN INTERVAL {USER_LIMIT_S} SECONDS PRECEDING AND CURRENT ROW)) AS rpm_cleaned
  FROM p),
d AS (SELECT *, lag(ts) OVER (PARTITION BY vin ORDER BY ts) AS before FROM c
      WHERE rpm_cleaned IS NOT NULL AND speed > 0)
SELECT vin, event_id, rpm_cleaned, speed / 10.0 AS fuel_cleaned, speed AS speed_cleaned,
  abs(speed - 50.0) AS gradient_abs,
  CASE WHEN speed <> 200 THEN speed * 1.0 / 3600.0 END AS distance_via_speed_km,
  (gear * 100.0) * rpm * {2 * math.pi / 60000:.17e} AS engine_power_kw,
  CAST(year(ts) * 100 + month(ts) AS INTEGER) AS year_month,
  CAST({sec.format('ts')} - {sec.format('before')} AS DOUBLE) / 60.0
    AS diff_time_to_last_timestamp_vin_min
FROM d"""

    def over_items(body):
        return f"WITH {ITEMS} SELECT * FROM ({body})"

    out["spectra_1d_time"] = over_items(spectrum(1, [WEIGHT], DRIVE, TIME))
    out["spectra_1d_distance"] = over_items(WEIGHT_DIST)
    out["spectra_2d_time"] = over_items(spectrum(1, [RPM, TORQUE], DRIVE, TIME))
    out["spectra_2d_distance"] = over_items(spectrum(2, [RPM, TORQUE], DRIVE, DIST))
    out["spectra_all_configs"] = over_items(ALL_SPECTRA)
    out["spectra_user_speed"] = f"""
WITH {USERS} SELECT * FROM ({user_spectrum(1, TIME)} UNION ALL {user_spectrum(2, total(USER_KM))})"""
    clipped = "least(greatest(floor((speed - 5.0) / 2.5), 0), 37)"
    out["spectra_clipped"] = f"""
WITH {USERS},
k AS (SELECT vin, CAST(5 + {clipped} * 2.5 AS DOUBLE) AS lo, count(ts) AS t, {total(USER_KM)} AS d
      FROM u WHERE speed IS NOT NULL GROUP BY 1, 2)
SELECT CAST(c AS INTEGER) AS ls_config_id, vin, 'speed' AS x1_signal_id, lo AS x1_quantized,
  lo + 2.5 AS x1_upper, {label('lo', '(lo + 2.5)')} AS x1_interval,
  CASE WHEN c = 1 THEN CAST(t AS DOUBLE) ELSE d END AS count
FROM k, (VALUES (1), (2)) w(c)"""
    out["spectra_inspect"] = over_items(spectrum(4, [WEIGHT], DRIVE, DIST))
    out["inspect_vehicle"] = out["spectra_inspect"] + " WHERE vin = 1"
    out["stack_spectra"] = over_items(f"{spectrum(1, [WEIGHT], DRIVE, TIME)} UNION ALL {spectrum(2, [WEIGHT], DRIVE, DIST)}")
    gear = Ax("gear", 0, 16, 1)
    out["translate_spectra"] = f"""
WITH {USERS},
x AS ({spectrum(1, [gear], 'TRUE', TIME, source='u')} UNION ALL {user_spectrum(3, TIME)}),
m AS (SELECT n_nationkey AS value, n_name AS text FROM nation WHERE n_regionkey + 1024 = 1026)
SELECT x.*, CASE WHEN x1_signal_id = 'gear'
  THEN coalesce(text, CAST(CAST(x1_quantized AS BIGINT) AS VARCHAR)) ELSE x1_interval END
  AS x1_value_to_text
FROM x LEFT JOIN m ON x1_signal_id = 'gear' AND x1_quantized = value"""
    wide = Ax("speed", 0, 160, 20)
    two = " UNION ALL ".join(
        spectrum(config, [gear, wide], "speed > 0", count, source="u")
        for config, count in [(1, TIME), (2, total(USER_KM))]
    )
    out["translate_two_axes"] = f"""
WITH {USERS},
x AS ({two}),
m AS (SELECT n_nationkey AS value, n_name AS text FROM nation WHERE n_regionkey + 1024 = 1026)
SELECT x.*, coalesce(text, CAST(CAST(x1_quantized AS BIGINT) AS VARCHAR)) AS x1_value_to_text,
  x2_interval AS x2_value_to_text
FROM x LEFT JOIN m ON x1_quantized = value"""
    meta = []
    for i, (name, signal, description, named, unit) in enumerate(
        [
            ("VehSpd - high resolution", "speed", "`speed` >= 0 AND `speed` <= 200", "VehSpd_Cval", "km/h"),
            ("GroCmbVehWeight", "weight", "`speed` > 0", "Weight", "kg"),
            ("Road_gradient_absolute_value", "gradient_abs", "`speed` > 0", "RoadGrad_Cval", "%"),
        ]
    ):
        for j, weight in enumerate(["time", "distance"]):
            meta.append(
                f"({2 * i + j + 1}, '{name}', 'Entire vehicle', '{weight}', '{description}', "
                f"'{signal}', '{signal}', CAST(NULL AS VARCHAR), '{named}', '{unit}')"
            )
    out["spectra_metadata"] = f"""
WITH {ITEMS}, x AS ({ALL_SPECTRA}),
m(ls_config_id, title, tag, count_type, description, x1_signal_in_config, x1_signal_id,
  x1_signal_suffix, x1_signal, x1_unit) AS (VALUES {', '.join(meta)})
SELECT m.*, bins, vehicles FROM m JOIN (
  SELECT ls_config_id, count(*) AS bins, count(DISTINCT vin) AS vehicles FROM x GROUP BY 1)
USING (ls_config_id)"""
    two_axes = [Ax("speed", 0, 160, 20), GRADIENT]
    out["spectra_metadata_two_axes"] = f"""
WITH {ITEMS}, x AS ({spectrum(1, two_axes, DRIVE, TIME)} UNION ALL {spectrum(2, two_axes, DRIVE, DIST)}),
m(ls_config_id, count_type) AS (VALUES (1, 'time'), (2, 'distance'))
SELECT ls_config_id, 'Speed by gradient' AS title, count_type, '`20` > 0' AS description,
  '20' AS x1_signal_in_config, '20' AS x1_signal_id, CAST(NULL AS VARCHAR) AS x1_signal_suffix,
  'VehSpd_Cval' AS x1_signal, 'km/h' AS x1_unit, '209_abs' AS x2_signal_in_config,
  '209' AS x2_signal_id, 'abs' AS x2_signal_suffix, 'RoadGrad_abs' AS x2_signal, '%' AS x2_unit,
  bins, vehicles
FROM m JOIN (SELECT ls_config_id, count(*) AS bins, count(DISTINCT vin) AS vehicles FROM x GROUP BY 1)
USING (ls_config_id)"""
    out["signal_id_parts"] = """
WITH n AS (
  SELECT p_partkey, CAST(p_size AS VARCHAR) || '_' || p_type AS name FROM part
  UNION ALL SELECT p_partkey, CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT p_partkey, p_brand FROM part)
SELECT p_partkey, name,
  CASE WHEN regexp_matches(name, '^[0-9]+(_|$)') THEN regexp_extract(name, '^[0-9]+') ELSE name END
    AS signal_id,
  CASE WHEN regexp_matches(name, '^[0-9]+_') THEN regexp_replace(name, '^[0-9]+_', '') END
    AS signal_suffix
FROM n"""
    out["interval_edges"] = f"""
WITH {ITEMS}, x AS ({spectrum(1, [RPM, TORQUE], DRIVE, TIME)})
SELECT vin, x1_interval, x2_interval, x2_quantized AS lo, x2_upper AS hi,
  CASE WHEN x2_quantized >= 0 THEN x2_quantized END AS lo_unsigned,
  (x2_quantized + x2_upper) / 2.0 AS center FROM x"""

    out["grid_bounds"] = f"""
WITH {ITEMS}, x AS ({ALL_SPECTRA})
SELECT ls_config_id, min(x1_quantized) AS grid_lo, max(x1_upper) AS grid_hi FROM x GROUP BY 1"""
    out["upper_edge_p99"] = f"""
WITH {ITEMS}, x AS ({ALL_SPECTRA})
SELECT ls_config_id, quantile_disc(x1_upper, 0.99) AS upper_edge FROM x GROUP BY 1"""
    lo, hi = "min(x1_quantized)", "max(x1_upper)"
    for name, ax, where, limits, width in [
        ("complete_speed", SPEED, RANGE, ("0", hi), 1),
        ("complete_spectra", WEIGHT, DRIVE, (lo, "55000"), 1000),
        ("complete_gradient", GRADIENT, DRIVE, (lo, "10"), 1),
    ]:
        spec = spectrum(2, [ax], where, DIST)
        out[name] = f"WITH {ITEMS},{complete(spec, *limits, width)} SELECT * FROM c"
    out["complete_to_p99_by_group"] = (
        f"WITH {ITEMS},"
        f"{complete(GROUPED_WEIGHT, lo, 'quantile_disc(x1_upper, 0.99)', 1000, ['sales_group'])}"
        " SELECT * FROM c UNION ALL"
        " SELECT sales_group, vin, x1_interval, x1_quantized, x1_upper, x1_signal_id, count"
        " FROM x JOIN b USING (sales_group) WHERE x1_quantized >= hi"
    )
    out["total_distance"] = f"""
WITH {ITEMS}, x AS ({WEIGHT_DIST})
SELECT vin, {total('count')} AS total_distance FROM x GROUP BY vin"""
    out["normalize_spectra"] = f"""
WITH {ITEMS},{complete(WEIGHT_DIST, '0', '55000', 1000)}
SELECT vin, x1_interval, count / nullif({total('count', over=' OVER (PARTITION BY vin)')}, 0)
  AS normalized_count FROM c"""
    out["rebin_spectra"] = f"""
WITH {ITEMS},
x AS ({WEIGHT_DIST}),
k AS (SELECT vin, floor(x1_quantized / 4000.0) * 4000 AS lo, {total('count')} AS count
      FROM x GROUP BY 1, 2)
SELECT vin, lo AS x1_quantized, lo + 4000 AS x1_upper, {label('lo', '(lo + 4000)')} AS x1_interval,
  count FROM k"""

    out["vehicle_stats"] = f"WITH {ITEMS} {vehicle_stats(['vin', 'sales_group'])}"
    users = f"WITH {USERS},{USER_STATS}"
    out["min_mileage_filter"] = f"{users} SELECT * FROM kept"
    out["removed_vins_bag"] = f"{users} SELECT vin, sales_group FROM lost"
    out["mileage_summary"] = f"""{users}
SELECT sales_group, count(*) AS vins_before,
  count(CASE WHEN distance_via_speed_km >= {USER_MIN_KM} THEN 1 END) AS vins_after
FROM st GROUP BY 1"""
    fenced = f"{users},{fences('kept', 1.5)}"
    out["iqr_bounds"] = f"{fenced} SELECT * FROM f"
    out["iqr_filter"] = (
        f"{fenced} SELECT kept.* FROM kept JOIN f USING (sales_group) WHERE {INSIDE}"
    )
    out["iqr_summary"] = f"""{fenced}
SELECT sales_group, count(*) AS vins_before, count(CASE WHEN {INSIDE} THEN 1 END) AS vins_after
FROM kept JOIN f USING (sales_group) GROUP BY 1"""
    out["outlier_vins"] = f"""{fenced}
SELECT vin, sales_group FROM lost UNION ALL
SELECT vin, sales_group FROM kept JOIN f USING (sales_group) WHERE NOT coalesce({INSIDE}, FALSE)"""
    out["completeness_outliers"] = """
SELECT *, least(rpm_share, fuel_share) < 0.8 AS incomplete FROM (
  SELECT user_id AS vin, count(*) AS rows,
    CAST(count(CASE WHEN event_type <> 'error' THEN value END) AS DOUBLE) / count(*) AS rpm_share,
    CAST(count(CASE WHEN value < 100 THEN value END) AS DOUBLE) / count(*) AS fuel_share
  FROM events GROUP BY 1)"""

    grouped = f"WITH {GROUPED}"
    out["remove_outliers"] = (
        f"{grouped} SELECT {X_COLS} FROM x WHERE vin NOT IN (SELECT vin FROM o)"
    )
    out["remove_outliers_same_group"] = (
        f"{grouped} SELECT {X_COLS} FROM x ANTI JOIN o USING (vin, sales_group)"
    )
    out["removed_vins_set"] = (
        f"{grouped} SELECT DISTINCT vin, sales_group FROM x WHERE vin IN (SELECT vin FROM o)"
    )
    summary = """
SELECT v.sales_group, count(*) AS vins_before,
  count(CASE WHEN o.vin IS NULL THEN 1 END) AS vins_after, count(o.vin) AS vins_removed
FROM (SELECT DISTINCT vin, sales_group FROM x) v
LEFT JOIN (SELECT DISTINCT vin, sales_group FROM o) o USING (vin, sales_group) GROUP BY 1"""
    out["removal_summary"] = f"{grouped} {summary}"
    out["removal_totals"] = f"""{grouped}
SELECT CAST(sum(vins_before) AS BIGINT) AS total_before,
  CAST(sum(vins_after) AS BIGINT) AS total_after,
  CAST(sum(vins_removed) AS BIGINT) AS total_removed FROM ({summary})"""
    cells = ", ".join(
        f"coalesce({total(f'CASE WHEN x1_quantized = {c - 500} THEN count END')}, 0.0) AS bin_{c}"
        for c in CENTERS
    )
    out["weight_matrix"] = f"WITH {ORDERS} SELECT vin, {cells} FROM x GROUP BY vin"
    mass = " + ".join(f"bin_{c}" for c in CENTERS)
    parts = ", ".join(f"bin_{c} / mass AS bin_{c}" for c in CENTERS)
    out["weight_shares"] = f"""
WITH {ORDERS}, m AS (SELECT vin, {cells} FROM x GROUP BY vin)
SELECT vin, {parts} FROM (SELECT *, {mass} AS mass FROM m) WHERE mass <> 0"""
    out["zero_mass_outliers"] = f"""
WITH {ORDERS},
z AS (SELECT vin FROM x GROUP BY vin HAVING coalesce(sum(
        CASE WHEN x1_quantized >= 12000 AND x1_quantized < 50000 THEN count END), 0) = 0)
SELECT DISTINCT vin, sales_group FROM x WHERE vin IN (SELECT vin FROM z)"""

    order_spec = spectrum(2, [WEIGHT], "TRUE", DIST, source="w", group=("vin", "sales_group"))
    out["clean_chain_zero_mass"] = f"""
WITH {ORDER_ROWS},{complete(order_spec, lo, '55000', 1000, ['sales_group'])},
o AS (SELECT vin FROM x GROUP BY vin, sales_group HAVING sum(count) < {ORDER_MIN_KM}),
k AS (SELECT * FROM c WHERE vin NOT IN (SELECT vin FROM o)),
z AS (SELECT vin FROM k GROUP BY vin HAVING sum(
        CASE WHEN interval_start >= 12000 AND interval_start < 50000 THEN count ELSE 0 END) = 0)
SELECT DISTINCT vin, sales_group FROM k WHERE vin IN (SELECT vin FROM z)"""

    mean_share = mean("norm_count")
    out["fleet_average"] = f"""
WITH {REGIONAL},{shares('cg', 'interval_start', ['vin'])}
SELECT x_bin, {mean_share} AS avg_norm_count FROM n GROUP BY 1"""
    out["fleet_average_by_group"] = f"""
WITH {ITEMS},{complete(GROUPED_WEIGHT, '0', '55000', 1000, ['sales_group'])},
{shares('c', 'interval_start', ['sales_group', 'vin'])}
SELECT sales_group, x_bin, {mean_share} AS avg_norm_count FROM n GROUP BY 1, 2"""
    out["vehicle_vs_fleet"] = f"""
WITH {REGIONAL},{shares('cg', 'interval_start', ['sales_group', 'vin'])},
a AS (SELECT sales_group, x_bin, {mean_share} AS avg_norm_count FROM n GROUP BY 1, 2)
SELECT sales_group, x_bin, vin, norm_count, avg_norm_count FROM n JOIN a USING (sales_group, x_bin)"""
    out["fleet_before_after"] = f"""
WITH {GROUPED},{shares('x', 'x1_quantized', ['sales_group', 'vin'])},
p AS (SELECT n.*, d.vin AS out_vin FROM n LEFT JOIN (SELECT DISTINCT vin, sales_group FROM o) d
      USING (vin, sales_group)),
v AS (SELECT sales_group, count(DISTINCT vin) AS v_before,
        count(DISTINCT CASE WHEN out_vin IS NULL THEN vin END) AS v_after
      FROM p WHERE norm_count IS NOT NULL GROUP BY 1)
SELECT sales_group, x_bin, {total('norm_count')} / any_value(v_before) AS avg_before,
  {total('CASE WHEN out_vin IS NULL THEN norm_count END')} / any_value(nullif(v_after, 0)) AS avg_after
FROM p JOIN v USING (sales_group) GROUP BY 1, 2"""
    out["weighted_fleet_average"] = f"WITH {REGIONAL_STATS} SELECT * FROM r"
    by_time = ", ".join(f"{weighted(p, 'operating_time_h')} AS {p}" for p in PARAMETERS)
    out["weighted_fleet_average_time"] = (
        f"WITH {REGIONAL_STATS} SELECT sales_group, {by_time} FROM st GROUP BY sales_group"
    )
    long = " UNION ALL ".join(
        f"SELECT sales_group, '{p}' AS parameter, {p} AS value FROM r" for p in PARAMETERS
    )
    out["radar_profile"] = f"""
WITH {REGIONAL_STATS}, l AS ({long})
SELECT sales_group, parameter, value,
  (value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) AS scaled
FROM l WINDOW w AS (PARTITION BY parameter)"""
    speed = "vehicle_speed_avg_driving_kmh"
    inside = f"{speed} BETWEEN q1 - (q3 - q1) AND q3 + (q3 - q1)"
    out["box_stats"] = f"""{users},
q AS (SELECT sales_group, quantile_disc({speed}, 0.25) AS q1, quantile_disc({speed}, 0.5) AS median,
        quantile_disc({speed}, 0.75) AS q3 FROM st GROUP BY 1)
SELECT sales_group, count({speed}) AS vehicles, any_value(q1) AS q1, any_value(median) AS median,
  any_value(q3) AS q3, min(CASE WHEN {inside} THEN {speed} END) AS whisker_lo,
  max(CASE WHEN {inside} THEN {speed} END) AS whisker_hi,
  count(CASE WHEN NOT ({inside}) THEN 1 END) AS outliers
FROM st JOIN q USING (sales_group) GROUP BY 1"""
    fuel = "fuel_l_per_100km"
    inside = f"{fuel} BETWEEN q1 - (q3 - q1) AND q3 + (q3 - q1)"
    out["box_fuel_by_customer"] = f"""
WITH {ITEMS},
st AS (SELECT v.*, n_name AS customer FROM ({vehicle_stats(['vin'])}) v
       JOIN supplier ON s_suppkey = v.vin JOIN nation ON s_nationkey = n_nationkey),
q AS (SELECT customer, quantile_disc({fuel}, 0.25) AS q1, quantile_disc({fuel}, 0.5) AS median,
        quantile_disc({fuel}, 0.75) AS q3 FROM st GROUP BY 1)
SELECT customer, count({fuel}) AS vehicles, any_value(q1) AS q1, any_value(median) AS median,
  any_value(q3) AS q3, min(CASE WHEN {inside} THEN {fuel} END) AS whisker_lo,
  max(CASE WHEN {inside} THEN {fuel} END) AS whisker_hi,
  count(CASE WHEN NOT ({inside}) THEN 1 END) AS outliers
FROM st JOIN q USING (customer) GROUP BY 1"""
    out["stat_histogram"] = f"""{users},{fences('st', GROUP_K)},
h AS (SELECT 'before' AS stage, {speed} AS v FROM st UNION ALL
      SELECT 'after', {speed} FROM st JOIN f USING (sales_group) WHERE {INSIDE}),
m AS (SELECT stage, min(v) AS lo, max(v) AS hi FROM h GROUP BY 1),
k AS (SELECT stage, least(floor((v - lo) / ((hi - lo) / 30)), 29) AS bin, count(*) AS n
      FROM h JOIN m USING (stage) GROUP BY 1, 2)
SELECT m.stage, CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / 30) AS bin_lo,
  lo + (i + 1) * ((hi - lo) / 30) AS bin_hi, coalesce(n, 0) AS vehicles
FROM m CROSS JOIN range(0, 30) r(i) LEFT JOIN k ON k.stage = m.stage AND k.bin = i"""
    out["value_quantiles"] = """
SELECT event_type, quantile_disc(value, 0.01) AS p01, quantile_disc(value, 0.5) AS p50,
  quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1"""
    from registry import model_oracles

    return {**out, **model_oracles.sql(out)}
