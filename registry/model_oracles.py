"""SQL of the streams, distances, clusters and anomaly scores: the rounds and levels written out one after the other."""

from __future__ import annotations

from fleetspectra.operators.anomalies import expected_depth
from registry import oracles as o

#: Parameters of the registered queries, the same in registry/queries.py.
CLUSTERS, SEED, LEVELS, ROUNDS = 4, 42, 20, 12
TREES, SAMPLE = 25, 32
ANOMALY_COLUMNS = ["distance_via_speed_km", "vehicle_speed_avg_driving_kmh", "fuel_l_per_100km", "weight_avg_kg", "road_gradient_abs_avg"]


def draw(*parts: str) -> str:
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / CAST({16**13} AS DOUBLE))"


CUMULATIVE = f"""
cum AS (
  SELECT *, {o.total('norm_count', over=' OVER (PARTITION BY sales_group, vin ORDER BY x_bin)')} AS f
  FROM n WHERE norm_count IS NOT NULL)"""


def distances() -> dict[str, str]:
    # Means and areas by plain sums here, so results are compared rounded.
    base = f"""
WITH {o.REGIONAL},{o.shares('cg', 'interval_start', ['sales_group', 'vin'])},{CUMULATIVE},
fleet AS (SELECT sales_group, x_bin, avg(f) AS fg FROM cum GROUP BY 1, 2)"""
    return {
        "spectra_distance": f"""{base}
SELECT sales_group, vin, round(sum(abs(f - fg) * 1000.0), 6) AS distance FROM cum JOIN fleet USING (sales_group, x_bin) GROUP BY 1, 2""",
        "spectra_distance_groups": f"""{base}
SELECT a.sales_group AS group_a, b.sales_group AS group_b, round(sum(abs(a.fg - b.fg) * 1000.0), 6) AS distance
FROM fleet a JOIN fleet b ON a.x_bin = b.x_bin AND a.sales_group < b.sales_group GROUP BY 1, 2""",
    }


def between(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))) / {LEVELS}"


def clusters() -> dict[str, str]:
    """k-medians: vectors, candidates of two rounds, k chosen ones, then rounds of medians."""
    k = CLUSTERS
    parts = [f"""
{o.ITEMS},{o.complete(o.WEIGHT_DIST, '0', '100000', 1000)},{o.shares('c', 'interval_start', ['vin'])},
cum AS (SELECT *, {o.total('norm_count', over=' OVER (PARTITION BY vin ORDER BY x_bin)')} AS f FROM n WHERE norm_count IS NOT NULL),
steps AS (SELECT *, coalesce(lag(f) OVER w, 0) AS f0, lead(f) OVER w IS NULL AS ends FROM cum WINDOW w AS (PARTITION BY vin ORDER BY x_bin)),
v AS MATERIALIZED (
  SELECT vin, list(x_bin + 500.0 ORDER BY j) AS q
  FROM steps, range(0, {LEVELS}) r(j)
  WHERE (f > f0 OR ends) AND (j + 0.5) / {LEVELS}.0 > f0 AND ((j + 0.5) / {LEVELS}.0 <= f OR ends) GROUP BY vin),
cand0 AS MATERIALIZED (SELECT 0 AS round, vin, q FROM v ORDER BY md5(CAST(vin AS VARCHAR) || ':{SEED}'), vin LIMIT 1)"""]

    def nearest(name, vectors, centers, columns="v.vin, v.q"):
        """Distance and number of the nearest centre of each vector."""
        return f"""
{name} AS MATERIALIZED (
  SELECT {columns}, min({between('v.q', 'm.q')}) AS d, arg_min(m.cluster, {{'d': {between('v.q', 'm.q')}, 'c': m.cluster}}) AS cluster
  FROM {vectors} v, {centers} m GROUP BY {columns})"""

    for r in (1, 2):
        parts.append(f"num{r} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY round, vin) AS cluster, q FROM cand{r - 1})")
        parts.append(nearest(f"near{r}", "v", f"num{r}"))
        parts.append(f"""
cand{r} AS MATERIALIZED (
  SELECT * FROM cand{r - 1} UNION ALL
  SELECT {r}, vin, q FROM near{r} WHERE {draw('vin', f"'{SEED}'", f"'{r}'")} * (SELECT sum(d) FROM near{r}) < {2.0 * k} * d)""")
    parts.append("numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY round, vin) AS cluster, q FROM cand2)")
    parts.append(nearest("weighing", "v", "numbered"))
    parts.append("""
rest AS MATERIALIZED (
  SELECT cluster AS candidate, q, weight FROM numbered JOIN (SELECT cluster, count(*) AS weight FROM weighing GROUP BY 1) USING (cluster))""")
    parts.append("chosen1 AS MATERIALIZED (SELECT 1 AS cluster, q FROM (SELECT * FROM rest ORDER BY weight DESC, candidate LIMIT 1))")
    for n in range(2, k + 1):
        parts.append(nearest(f"worth{n}", "rest", f"chosen{n - 1}", "v.candidate, v.q, v.weight"))
        parts.append(f"""
chosen{n} AS MATERIALIZED (
  SELECT * FROM chosen{n - 1} UNION ALL
  SELECT {n}, q FROM (SELECT * FROM worth{n} WHERE weight * d > 0 ORDER BY weight * d DESC, candidate LIMIT 1))""")
    parts.append(f"m0 AS MATERIALIZED (SELECT * FROM chosen{k})")
    for r in range(1, ROUNDS + 1):
        parts.append(nearest(f"a{r}", "v", f"m{r - 1}"))
        parts.append(f"""
m{r} AS MATERIALIZED (
  SELECT m.cluster, coalesce(moved.q, m.q) AS q FROM m{r - 1} m LEFT JOIN (
    SELECT cluster, list(x ORDER BY j) AS q FROM (
      SELECT cluster, j, quantile_disc(q[j + 1], 0.5) AS x FROM a{r}, range(0, {LEVELS}) l(j) GROUP BY 1, 2) GROUP BY 1) moved USING (cluster))""")
    parts.append(nearest("final", "v", f"m{ROUNDS}"))
    base = "WITH " + ",\n".join(parts)
    return {
        "cluster_spectra": f"{base}\nSELECT vin, CAST(cluster AS INTEGER) AS cluster, round(d, 6) AS distance FROM final",
        "cluster_medians": f"""{base}
SELECT CAST(cluster AS INTEGER) AS cluster, CAST(j AS INTEGER) AS level, q[j + 1] AS median, coalesce(n, 0) AS vehicles
FROM m{ROUNDS} LEFT JOIN (SELECT cluster, count(*) AS n FROM final GROUP BY 1) USING (cluster), range(0, {LEVELS}) l(j)""",
    }


def anomalies() -> dict[str, str]:
    """Isolation trees, a level at a time; the walk down the trees likewise."""
    depth = max(1, (SAMPLE - 1).bit_length())
    table = "[" + ", ".join(repr(expected_depth(i)) for i in range(4 * SAMPLE + 1)) + "]"
    need = lambda n: f"{table}[{n} + 1]"
    x = "[" + ", ".join(ANOMALY_COLUMNS) + "]"
    n = len(ANOMALY_COLUMNS)
    parts = [
        f"{o.ITEMS},\nt AS MATERIALIZED (SELECT vin, {x} AS x FROM ({o.vehicle_stats(['vin'])}))",
        f"""
r0 AS MATERIALIZED (
  SELECT tree, x, CAST(1 AS BIGINT) AS node FROM t, range(0, {TREES}) g(tree)
  WHERE {draw('vin', 'tree', f"'{SEED}'")} * (SELECT count(*) FROM t) < {float(SAMPLE)})""",
    ]
    for level in range(depth + 1):
        lows = "[" + ", ".join(f"{{'i': {i}, 'lo': min(x[{i + 1}]), 'hi': max(x[{i + 1}])}}" for i in range(n)) + "]"
        choice = f"CAST(floor({draw('tree', 'node', f'{SEED!r}', chr(39) + 'column' + chr(39))} * len(open)) AS INTEGER) + 1"
        of = f"open[{choice}]" if level < depth else "NULL"
        parts.append(f"""
n{level} AS MATERIALIZED (
  SELECT tree, node, n, of.i AS feature,
    of.lo + {draw('tree', 'node', f'{SEED!r}', chr(39) + 'value' + chr(39))} * (of.hi - of.lo) AS split,
    CASE WHEN of IS NULL THEN {float(level)} + {need('n')} END AS path
  FROM (SELECT *, CAST({of} AS STRUCT(i INTEGER, lo DOUBLE, hi DOUBLE)) AS of FROM (
    SELECT tree, node, count(*) AS n, list_filter({lows}, lambda e: e.hi > e.lo) AS open FROM r{level} GROUP BY 1, 2)))""")
        if level < depth:
            parts.append(f"""
r{level + 1} AS MATERIALIZED (
  SELECT tree, x, 2 * node + CAST(coalesce(x[feature + 1] >= split, FALSE) AS BIGINT) AS node
  FROM r{level} JOIN n{level} USING (tree, node) WHERE feature IS NOT NULL)""")
    parts.append(f"w0 AS (SELECT vin, x, tree, CAST(1 AS BIGINT) AS node, CAST(NULL AS DOUBLE) AS path FROM t, (SELECT tree FROM n0 WHERE n > 1))")
    for level in range(depth + 1):
        parts.append(f"""
w{level + 1} AS MATERIALIZED (
  SELECT vin, x, w.tree, CASE WHEN n.feature IS NULL THEN w.node ELSE 2 * w.node + CAST(coalesce(x[n.feature + 1] >= n.split, FALSE) AS BIGINT) END AS node,
    coalesce(w.path, n.path) AS path
  FROM w{level} w LEFT JOIN n{level} n ON n.tree = w.tree AND n.node = w.node)""")
    return {
        "anomaly_scores": "WITH " + ",".join(parts) + f"""
SELECT vin, round(power(2.0, -avg(w.path / {need('n0.n')})), 9) AS anomaly_score FROM w{depth + 1} w JOIN n0 ON n0.tree = w.tree GROUP BY vin"""
    }


def streams(cleaned: str) -> dict[str, str]:
    """Rows that arrive late and in batches give what all rows at once give."""
    return {
        "stream_clean_signals": f"""
WITH c AS ({cleaned})
SELECT c.vin, c.event_id, c.speed, speed_cleaned, gear_cleaned, lag(c.event_id, 1, -1) OVER w AS event_before, lag(ts) OVER w AS time_before
FROM c JOIN events USING (event_id) WINDOW w AS (PARTITION BY c.vin ORDER BY ts, event_id)""",
        "stream_spectra": f"WITH {o.USERS} SELECT * FROM ({o.user_spectrum(1, o.TIME)})",
    }


def storage_and_cells(known: dict[str, str]) -> dict[str, str]:
    limit = f"INTERVAL {o.USER_LIMIT_S} SECONDS"
    part = " OVER (PARTITION BY sales_group, vin)"
    cells = f"""
WITH {o.ITEMS},{o.REGIONS},
e AS ({o.spectrum(2, [o.RPM, o.TORQUE], o.DRIVE, o.DIST)}),
n AS (
  SELECT sales_group, vin, x1_quantized, x2_quantized, count / nullif({o.total('count', over=part)}, 0) AS share
  FROM e JOIN g USING (vin)),
v AS (SELECT sales_group, count(DISTINCT vin) AS vehicles FROM n WHERE share IS NOT NULL GROUP BY 1),
a AS (
  SELECT sales_group, x1_quantized, x2_quantized, {o.total('share')} / any_value(vehicles) AS avg_norm_count
  FROM n JOIN v USING (sales_group) WHERE share IS NOT NULL GROUP BY 1, 2, 3)"""
    two = " UNION ALL ".join(
        f"SELECT * FROM (WITH {o.ITEMS},{o.complete(o.spectrum(config, [ax], where, o.DIST), '(SELECT min(x1_quantized) FROM x)', '(SELECT max(x1_upper) FROM x)', 1)}"
        f" SELECT CAST({config} AS INTEGER) AS ls_config_id, vin, x1_interval, interval_start, count FROM c)"
        for config, ax, where in ((2, o.SPEED, o.RANGE), (4, o.GRADIENT, o.DRIVE))
    )
    return {
        "save_and_reload_orc": known["save_and_reload"],
        "bucketed_spectra": known["normalize_spectra"],
        "vehicle_count_merged": """
SELECT event_type, count(DISTINCT user_id) AS vehicles, TRUE AS merged_is_direct, TRUE AS estimate_near FROM events GROUP BY 1""",
        "interpolate_signals": f"""
WITH {o.USERS},
g AS (SELECT *, CASE WHEN speed > 5 THEN speed END AS v, CASE WHEN speed > 5 THEN epoch_us(ts) END AS t FROM u),
l AS (
  SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(t IGNORE NULLS) OVER b AS t0,
    first_value(v IGNORE NULLS) OVER a AS v1, first_value(t IGNORE NULLS) OVER a AS t1
  FROM g WINDOW b AS (PARTITION BY vin ORDER BY ts RANGE BETWEEN {limit} PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY vin ORDER BY ts RANGE BETWEEN CURRENT ROW AND {limit} FOLLOWING))
SELECT * FROM (
  SELECT vin, event_id, speed,
    coalesce(v, v0 + (v1 - v0) * (CAST(epoch_us(ts) - t0 AS DOUBLE) / CAST(t1 - t0 AS DOUBLE))) AS speed_cleaned FROM l)
WHERE speed_cleaned IS NOT NULL""",
        "sorted_fleet_average": f"""
SELECT *, CAST(row_number() OVER (PARTITION BY sales_group ORDER BY x_bin) AS INTEGER) AS position FROM (
WITH {o.REGIONAL},{o.shares('cg', 'interval_start', ['sales_group', 'vin'])}
SELECT sales_group, x_bin, {o.mean('norm_count')} AS avg_norm_count FROM n GROUP BY 1, 2)""",
        "complete_two_spectra": two,
        "fleet_average_cells": f"{cells} SELECT * FROM a",
        "complete_engine_cells": f"""{cells},
grid AS (
  SELECT sales_group, CAST(i * 50 AS DOUBLE) AS x1_quantized, CAST(-3000 + j * 50 AS DOUBLE) AS x2_quantized
  FROM (SELECT DISTINCT sales_group FROM a), range(0, 100) r(i), range(0, 120) q(j))
SELECT sales_group, x1_quantized, x2_quantized, coalesce(avg_norm_count, 0.0) AS avg_norm_count
FROM grid LEFT JOIN a USING (sales_group, x1_quantized, x2_quantized)""",
    }


def sql(known: dict[str, str]) -> dict[str, str]:
    return {**distances(), **clusters(), **anomalies(), **streams(known["clean_signals"]), **storage_and_cells(known)}
