"""Groups of vehicles with similar spectra: k-medians of their quantiles.

On one axis the Wasserstein distance of two spectra is the mean distance of their quantiles. So a vehicle becomes the
vector of its quantiles at even levels, the distance of two vectors is the mean of the absolute differences, and the
best centre of a cluster is the median at each level. Vehicles stay distributed: a round reads them once and adds up
how many members have which quantile; only centres (clusters times levels) go from round to round, as stored tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.functions.draws import draw
from fleetspectra.operators.distances import cumulative_shares
from fleetspectra.sources.tables import stored

LEVELS = 20


class Clusters(NamedTuple):
    """``vehicles``: key, cluster, distance. ``centers``: cluster, q (median per level), vehicles. ``rounds`` it took."""

    vehicles: DataFrame
    centers: DataFrame
    rounds: int


def quantile_vectors(
    spectra_df: DataFrame,
    levels: int = LEVELS,
    key: str = "vin",
    start: str = "interval_start",
    upper: str = "interval_end",
) -> DataFrame:
    """``q`` per vehicle: the centres of the bins in which its load reaches the shares (j + 1/2) / levels.

    Needs spectra on their common grid; vehicles without a total are left out.
    """
    cumulative = cumulative_shares(spectra_df, (), key, start, upper)
    before = F.coalesce(F.lag("up_to").over(W.partitionBy(key).orderBy("bin_lo")), F.lit(0.0))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    share = (F.col("__j") + F.lit(0.5)) / F.lit(float(levels))
    last = F.lead("up_to").over(W.partitionBy(key).orderBy("bin_lo")).isNull()
    rows = cumulative.select(
        key, ((F.col("bin_lo") + F.col("bin_hi")) / F.lit(2.0)).alias("__x"), before.alias("__before"), F.col("up_to").alias("__up_to"), last.alias("__last")
    )
    rows = rows.where((F.col("__up_to") > F.col("__before")) | F.col("__last")).select("*", level.alias("__j"))
    # The last bin takes levels that rounding keeps the total from reaching.
    rows = rows.where((share > F.col("__before")) & ((share <= F.col("__up_to")) | F.col("__last")))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__j", "__x"))), lambda s: s["__x"]).alias("q"))


def distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two vectors."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(a)


def _nearest(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """``vectors`` with ``__near``: distance and number of the nearest centre, the first of equally near ones.

    All centres reach the rows as one value of a subquery; they are a bounded number of vectors.
    """
    all_centers = centers.agg(F.array_sort(F.collect_list(F.struct("cluster", "q")))).scalar()
    near = F.array_min(F.transform(F.col("__all"), lambda c: F.struct(distance(F.col("q"), c["q"]).alias("d"), c["cluster"].alias("cluster"))))
    return vectors.withColumn("__all", all_centers).withColumn("__near", near).drop("__all")


def seed_centers(vectors: DataFrame, k: int, seed: int = 42, rounds: int = 2, key: str = "vin") -> DataFrame:
    """``cluster, q`` of up to ``k`` first centres (fewer if there are fewer different vectors).

    Drawn in parallel: in each round every vehicle draws by a hash, and is a candidate with a probability of 2k times
    its part of all distances to the nearest candidate. Then, of the candidates (some 2k a round), the one that most
    vehicles are nearest to, and after it always the one with the greatest product of that number and the distance
    to the centres chosen so far.
    """
    first = vectors.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(1)
    found = stored(first.select(F.lit(0).alias("__round"), F.col(key).alias("__key"), "q"), "candidates")
    number = lambda rows: rows.select(F.row_number().over(W.orderBy("__round", "__key")).alias("cluster"), "q")
    for r in range(1, rounds + 1):
        near = _nearest(vectors, number(found))
        total = near.agg(F.sum("__near.d")).scalar()
        drawn = near.withColumn("__total", total).where(
            draw(F.col(key), seed, r) * F.col("__total") < F.lit(2.0 * k) * F.col("__near.d")
        )
        found = stored(found.unionByName(drawn.select(F.lit(r).alias("__round"), F.col(key).alias("__key"), "q")), "candidates")
    found = stored(number(found), "candidates")
    weights = _nearest(vectors, found).groupBy(F.col("__near.cluster").alias("cluster")).agg(F.count(F.lit(1)).alias("weight"))
    rest = stored(found.join(weights, "cluster"), "candidates")
    chosen = rest.orderBy(F.desc("weight"), "cluster").limit(1).select(F.lit(1).alias("cluster"), "q")
    for n in range(2, k + 1):
        chosen = stored(chosen, "chosen")
        worth = _nearest(rest.withColumnRenamed("cluster", "__candidate"), chosen).withColumn("__worth", F.col("weight") * F.col("__near.d"))
        best = worth.where("__worth > 0").orderBy(F.desc("__worth"), "__candidate").limit(1)
        chosen = chosen.unionByName(best.select(F.lit(n).alias("cluster"), "q"))
    return stored(chosen, "chosen")


def _medians(near: DataFrame, centers: DataFrame) -> DataFrame:
    """The lower median of the members at each level; a centre without members stays where it is.

    What is shuffled is how many members of a cluster have which quantile: at most clusters x levels x bins a task.
    """
    values = near.select(F.col("__near.cluster").alias("cluster"), F.posexplode("q").alias("j", "x"))
    counts = values.groupBy("cluster", "j", "x").agg(F.count(F.lit(1)).alias("n"))
    lists = counts.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("x", "n"))).alias("xs"))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("x"))
    half = F.col("n")

    def further(s: Column, v: Column) -> Column:
        here = F.when(s["x"].isNull() & (2 * (s["seen"] + v["n"]) >= half), v["x"]).otherwise(s["x"])
        return F.struct((s["seen"] + v["n"]).alias("seen"), here.alias("x"))

    median = lists.select("cluster", "j", "n", F.aggregate("xs", start, further)["x"].alias("x"))
    moved = median.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("__q"), F.max("n").alias("vehicles")
    )
    return centers.select("cluster", "q").join(moved, "cluster", "left").select(
        "cluster", F.coalesce("__q", "q").alias("q"), F.coalesce("vehicles", F.lit(0)).alias("vehicles")
    )


def cluster_spectra(
    spectra_df: DataFrame,
    k: int,
    seed: int = 42,
    levels: int = LEVELS,
    max_rounds: int = 20,
    key: str = "vin",
    start: str = "interval_start",
    upper: str = "interval_end",
    centers: DataFrame | None = None,
    columns: Sequence[str] = (),
) -> Clusters:
    """``k`` clusters of vehicles by the Wasserstein distance of their spectra.

    Rounds go on until no centre moves, ``max_rounds`` at most. Centres given (``cluster, q``) take the place of
    drawn ones. The vehicles' vectors are stored once and read once a round; a centre that no vehicle is nearest to
    stays. ``columns`` of the spectra that are constant per vehicle may be carried to the result.
    """
    rest = spectra_df.groupBy(key).agg(*[F.first(c).alias(c) for c in columns]) if columns else None
    vectors = stored(quantile_vectors(spectra_df, levels, key, start, upper), "vectors")
    now = centers.select("cluster", "q") if centers is not None else seed_centers(vectors, k, seed, key=key)
    rounds = 0
    while rounds < max_rounds:
        moved = stored(_medians(_nearest(vectors, now), now), "centers")
        rounds += 1
        same = moved.select("cluster", "q").exceptAll(now.select("cluster", "q")).isEmpty()
        now = moved
        if same:
            break
    near = _nearest(vectors, now)
    out = near.select(key, F.col("__near.cluster").alias("cluster"), F.col("__near.d").alias("distance"))
    if rest is not None:
        out = out.join(rest, key)
    counted = _medians(near, now).select("cluster", "vehicles")
    return Clusters(out, now.select("cluster", "q").join(counted, "cluster"), rounds)
