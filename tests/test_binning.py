import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetspectra.functions.binning import bin_center, bin_number, interval_end, interval_label, interval_start
from fleetspectra.functions.names import signal_id, signal_suffix, split_signal
from fleetspectra.functions.numeric import exact_avg, exact_sum
from fleetspectra.operators.spectra import spectra
from fleetspectra.spec import Axis, SpectrumSpec


def labels(frame, values, axis, **options):
    df = frame("vin string, x double, timestamp int", *[("A", v, i) for i, v in enumerate(values)])
    spec = SpectrumSpec("t", (axis,), **options)
    rows = spectra(df, [spec], ["time"]).collect()
    return {r.x1_interval: r["count"] for r in rows}


def test_edges_of_whole_bins(frame):
    got = labels(frame, [-0.5, 0.0, 0.99, 1.0, 159.99, 160.0, None], Axis("x", 0, 160, 1))
    assert got == {"[0,1)": 2, "[1,2)": 1, "[159,160)": 1}


def test_negative_bins(frame):
    got = labels(frame, [-3000.0, -1.0, 0.0, 2999.0, 3000.0], Axis("x", -3000, 3000, 50))
    assert got == {"[-3000,-2950)": 1, "[-50,0)": 1, "[0,50)": 1, "[2950,3000)": 1}


def test_fractional_bins_do_not_slip(frame):
    got = labels(frame, [0.1, 0.2, 0.3, 0.7, 0.29], Axis("x", 0, 1, 0.1))
    assert got == {"[0.1,0.2)": 1, "[0.2,0.3)": 2, "[0.3,0.4)": 1, "[0.7,0.8)": 1}


def test_clip_and_null_bin(frame):
    axis = Axis("x", 0, 10, 5)
    values = [-1e300, 3.0, 10.0, 1e300, None, float("nan")]
    assert labels(frame, values, axis, out_of_range="clip") == {"[0,5)": 2, "[5,10)": 2}
    assert labels(frame, [3.0, None, 99.0], axis, keep_null=True) == {"[0,5)": 1, None: 1}


def test_just_below_the_end_stays_on_the_axis(frame):
    got = labels(frame, [math.nextafter(3000.0, 0)], Axis("x", -3000, 3000, 50))
    assert got == {"[2950,3000)": 1}


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.integers(-500, 500), min_size=1, max_size=40),
    st.integers(-20, 20),
    st.integers(1, 30),
    st.integers(1, 9),
)
def test_bins_match_plain_arithmetic(frame, values, start, bins, width):
    axis = Axis("x", start, start + bins * width, width)
    want = {}
    for v in values:
        if start <= v < start + bins * width:
            lo = start + (v - start) // width * width
            want[f"[{lo},{lo + width})"] = want.get(f"[{lo},{lo + width})", 0) + 1
    assert labels(frame, [float(v) for v in values], axis) == want


def test_bad_axes_are_refused():
    with pytest.raises(ValueError):
        Axis("x", 0, 10, 0)
    with pytest.raises(ValueError):
        Axis("x", 10, 10, 1)
    with pytest.raises(ValueError):
        SpectrumSpec("t", ())
    with pytest.raises(ValueError):
        SpectrumSpec("t", (Axis("x", 0, 1, 1),), out_of_range="other")


def test_edges_read_back(frame):
    df = frame("l string", ("[0,1)",), ("[-50,0)",), ("[0.5,1)",), ("none",), (None,))
    label = F.col("l")
    rows = df.select(
        interval_start(label), interval_end(label), interval_start(label, False), bin_center(label)
    ).collect()
    assert [tuple(r) for r in rows] == [
        (0.0, 1.0, 0.0, 0.5),
        (-50.0, 0.0, None, -25.0),
        (0.5, 1.0, 0.5, 0.75),
        (None, None, None, None),
        (None, None, None, None),
    ]


def test_label_of_null_edges(frame):
    df = frame("a double, b double", (1.0, 2.0), (None, 2.0), (0.25, 0.5))
    got = [r[0] for r in df.select(interval_label("a", "b")).collect()]
    assert got == ["[1,2)", None, "[0.25,0.5)"]


@pytest.mark.parametrize(
    ("name", "strip", "parts"),
    [
        ("209_abs", None, ("209", "abs")),
        ("209", None, ("209", None)),
        ("20_cleaned", "_cleaned", ("20", None)),
        ("20_cleaned", None, ("20", "cleaned")),
        ("20_agg_avg_300", None, ("20", "agg_avg_300")),
        ("speed_abs", None, ("speed_abs", None)),
        ("209_", None, ("209", "")),
    ],
)
def test_signal_names(frame, name, strip, parts):
    assert split_signal(name, strip) == parts
    if strip is None:
        df = frame("n string", (name,))
        row = df.select(signal_id(F.col("n")), signal_suffix(F.col("n"))).first()
        assert tuple(row) == parts


def test_sums_do_not_depend_on_order(frame):
    values = [0.1, 1e6, 0.2, -1e6, 0.3, None, float("nan")]
    for order in (values, values[::-1]):
        row = frame("x double", *[(v,) for v in order]).agg(
            exact_sum(F.col("x")), exact_avg(F.col("x"))
        ).first()
        assert tuple(row) == (0.6, 0.12)


def test_large_and_small_sums(spark, setting):
    for ansi in ("true", "false"):
        setting("spark.sql.ansi.enabled", ansi)
        for n, value in ((21_000, 40_000.0 * 120_000.0), (2_100_000, 40_000.0 * 120_000.0), (1_000, 4e-13)):
            got = spark.range(n).agg(exact_sum(F.lit(value) + F.col("id") * 0)).first()[0]
            assert got == pytest.approx(n * value, rel=1e-5 if value < 1 else 1e-15)


def test_readings_on_a_fractional_axis_are_not_rounded(frame):
    axis = Axis("x", 0.0, 1.0, 0.1)
    values = [0.2999999999999, 0.3, 0.7, 0.1 + 0.2, 0.9999999999999999]
    got = [r[0] for r in frame("x double", *[(v,) for v in values]).selectExpr(bin_number(axis)).collect()]
    assert got == [2, 3, 7, 3, 9]
