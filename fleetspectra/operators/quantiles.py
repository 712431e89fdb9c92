"""Exact quantiles per group, also when one group holds most of the rows.

Spark's exact percentile keeps all values of a group in one task. Here the interval that holds a quantile is narrowed
over several passes, each of which only adds up counts: a small sketch proposes two values of the data, the rows are
counted below, at, between and above them, and the counts say where the quantile is. Once an interval holds few rows,
they are put in order. The sketch only decides how fast it goes, not what comes out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspectra.functions.joins import join_groups
from fleetspectra.functions.numeric import known
from fleetspectra.sources.tables import stored

#: A sketch's rank error is a part ``1 / ACCURACY`` of its rows; it cuts them into a tenth as many parts.
ACCURACY = 640
#: An interval of at most so many rows is put in order.
FINISH = 1024


def grouped_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
    finish: int = FINISH,
) -> DataFrame:
    """One row per group with a column per entry of ``probs``.

    The result is a value of the data: the smallest one with at least the share ``p`` of the values at or below it.
    Nulls, NaN and infinities are ignored; rows without a group are a group of their own.

    The passes run when this is called. Two of them make an interval about ``accuracy / 10`` times smaller, whatever the values are and however often they repeat:
    the two proposed values themselves are counted apart. From the second narrowing on, the passes read a stored table
    of the rows that are still inside. A task hands on a sketch of some hundred values per group, four counts per
    group and quantile, or at the end the at most ``finish`` values of an interval; no group is ordered in one task.
    """
    keys, parts = list(by) or ["__all"], max(2, accuracy // 10)
    rows = df.select(*([F.col(c) for c in by] or [F.lit(1).alias("__all")]), known(F.col(f"`{value}`")).alias("__x"))
    rows = rows.where(F.col("__x").isNotNull())
    names = F.array(*[F.struct(F.lit(n).alias("__name"), F.lit(float(p)).alias("__p")) for n, p in probs.items()])
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *_sketch(parts))
    rank = F.greatest(F.ceil(F.col("__n") * F.col("__q.__p")), F.lit(1)).cast("bigint")
    # An interval is open: its ends are values that were counted, or null where nothing was yet.
    intervals = total.select("*", F.explode(names).alias("__q")).select(
        *keys, F.col("__q.__name").alias("__name"), rank.alias("__rank"), F.lit(0).cast("bigint").alias("__below"), "__n",
        F.lit(None).cast("double").alias("__lo"), F.lit(None).cast("double").alias("__hi"), F.lit(None).cast("double").alias("__found"), "__edges",
    )
    intervals, named = stored(intervals, "intervals"), False
    while _widest(intervals) > finish:
        if "__edges" not in intervals.columns:
            rows, named = stored(_inside(rows, intervals, keys, named), "inside"), True
            sketch = rows.groupBy(*keys, "__name").agg(*_sketch(parts))
            intervals = join_groups(intervals, sketch, [*keys, "__name"], "left")
        intervals = stored(_narrowed(rows, intervals, keys, named, parts, finish), "intervals")
    rest = _inside(rows, intervals, keys, named).groupBy(*keys, "__name").agg(F.array_sort(F.collect_list("__x")).alias("__values"))
    done = join_groups(intervals, rest, [*keys, "__name"], "left")
    found = F.coalesce("__found", F.get("__values", (F.col("__rank") - F.col("__below") - 1).cast("int")))
    return done.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == n, found)).alias(n) for n in probs]).select(*by, *probs)


def _sketch(parts: int) -> list[Column]:
    shares = [i / parts for i in range(parts + 1)]
    return [F.percentile_approx("__x", shares, 10 * parts).alias("__edges")]


def _widest(intervals: DataFrame) -> int:
    return intervals.where("__found is null").agg(F.max("__n")).head()[0] or 0


def _inside(rows: DataFrame, intervals: DataFrame, keys: Sequence[str], named: bool) -> DataFrame:
    """The rows in the open intervals of quantiles that are not found yet."""
    wanted = intervals.where("__found is null").select(*keys, "__name", "__lo", "__hi")
    joined = join_groups(rows, wanted, [*keys, "__name"] if named else keys)
    above = F.col("__lo").isNull() | (F.col("__x") > F.col("__lo"))
    below = F.col("__hi").isNull() | (F.col("__x") < F.col("__hi"))
    return joined.where(above & below).select(*keys, "__name", "__x")


def _narrowed(rows: DataFrame, intervals: DataFrame, keys: Sequence[str], named: bool, parts: int, finish: int) -> DataFrame:
    """Each interval narrowed to one side of, to, or between the two values that its sketch proposes."""
    place = (F.col("__rank") - F.col("__below")) / F.col("__n") * F.lit(float(parts))
    edge = lambda at: F.get("__edges", F.least(F.greatest(at, F.lit(0)), F.lit(parts)).cast("int"))
    small = F.col("__n") <= finish
    asked = intervals.withColumns(
        {
            "__a": F.when(F.col("__found").isNull() & ~small, edge(F.floor(place - 0.2))),
            "__b": F.when(F.col("__found").isNull() & ~small, edge(F.ceil(place + 0.2))),
        }
    ).drop("__edges")
    on = [*keys, "__name"]
    x, a, b = F.col("__x"), F.col("__a"), F.col("__b")
    pairs = asked.where("__a is not null").select(*on, "__lo", "__hi", "__a", "__b")
    joined = join_groups(rows, pairs, on if named else keys)
    joined = joined.where((F.col("__lo").isNull() | (x > F.col("__lo"))) & (F.col("__hi").isNull() | (x < F.col("__hi"))))
    counts = joined.groupBy(*on).agg(
        F.count(F.when(x < a, 1)).alias("__c0"), F.count(F.when(x == a, 1)).alias("__c1"),
        F.count(F.when((x > a) & (x < b), 1)).alias("__c2"), F.count(F.when((x == b) & (b > a), 1)).alias("__c3"),
    )
    both = join_groups(asked, counts, on, "left")
    want = F.col("__rank") - F.col("__below")
    c = [F.col(f"__c{i}") for i in range(4)]
    upto = [c[0], c[0] + c[1], c[0] + c[1] + c[2], c[0] + c[1] + c[2] + c[3]]
    asks = F.col("__a").isNotNull()

    def case(unasked: Column, below: Column, at_a: Column, between: Column, at_b: Column, above: Column) -> Column:
        return (
            F.when(~asks, unasked).when(want <= upto[0], below).when(want <= upto[1], at_a).when(want <= upto[2], between)
            .when(want <= upto[3], at_b).otherwise(above)
        )

    lo, hi, n, none = F.col("__lo"), F.col("__hi"), F.col("__n"), F.lit(None).cast("double")
    before = F.col("__below")
    return both.select(
        *on, "__rank",
        case(before, before, before, before + upto[1], before, before + upto[3]).alias("__below"),
        case(n, c[0], n, c[2], n, n - upto[3]).alias("__n"),
        case(lo, lo, lo, a, lo, b).alias("__lo"), case(hi, a, hi, b, hi, hi).alias("__hi"),
        case(F.col("__found"), none, a, none, b, none).alias("__found"),
    )
