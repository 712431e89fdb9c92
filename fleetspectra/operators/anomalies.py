"""Vehicles unlike the others, without labels: isolation trees over their statistics.

A tree is grown on a few vehicles drawn by a hash; at each node a hash picks a column and a value between its extremes.
Odd vehicles are alone after few splits. Trees are grown level by level with grouped aggregations, all trees at once,
and kept as a table of nodes, whose size depends on the parameters only. Scoring walks down the trees by native
expressions, one pass over the vehicles and no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspectra.functions.draws import draw
from fleetspectra.functions.numeric import known
from fleetspectra.sources.tables import stored

TREES, SAMPLE = 50, 64


def expected_depth(n: int) -> float:
    """Mean depth at which a value is found in a random search tree of ``n`` values."""
    return 0.0 if n < 2 else 2.0 * sum(1.0 / i for i in range(1, n)) - 2.0 * (n - 1) / n


def _expected(n: Column, up_to: int) -> Column:
    """``expected_depth`` of a column, from a table of its first values; beyond them its limit formula."""
    table = F.array(*[F.lit(expected_depth(i)) for i in range(up_to + 1)])
    beyond = F.lit(2.0) * (F.log(n - 1) + F.lit(0.5772156649015329)) - F.lit(2.0) * (n - 1) / n
    return F.when(n <= up_to, F.get(table, n.cast("int"))).otherwise(beyond)


def grow_trees(
    rows: DataFrame, columns: Sequence[str], key: str = "vin", trees: int = TREES, sample: int = SAMPLE, seed: int = 42
) -> DataFrame:
    """A stored table of nodes: ``tree, node, feature, split, n, path``.

    Node 1 is the root, 2m and 2m + 1 are the children of m; those below ``split`` in column number ``feature`` go to
    2m, as do rows without a value. Leaves have no feature; ``path`` is a leaf's depth plus what its ``n`` rows would
    still need. A vehicle is in a tree with probability ``sample`` / vehicles, so a tree has about ``sample`` rows;
    depth ends at log2 of the sample, rounded up. NaN counts as missing.
    """
    depth = max(1, math.ceil(math.log2(sample)))
    all_rows = rows.count()
    x = F.array(*[known(F.col(f"`{c}`")) for c in columns])
    drawn = rows.select(F.col(key).alias("key"), x.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    drawn = drawn.where(draw(F.col("key"), F.col("tree"), seed) * F.lit(float(all_rows)) < F.lit(float(sample)))
    here = stored(drawn.select("tree", "x", F.lit(1).cast("bigint").alias("node")), "tree-rows")
    nodes = None
    for level in range(depth + 1):
        extremes = F.array(
            *[F.struct(F.lit(i).alias("i"), F.min(F.col("x")[i]).alias("lo"), F.max(F.col("x")[i]).alias("hi")) for i in range(len(columns))]
        )
        found = here.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), F.filter(extremes, lambda e: e["hi"] > e["lo"]).alias("open"))
        choice = F.floor(draw(F.col("tree"), F.col("node"), seed, "column") * F.size("open")).cast("int")
        found = found.withColumn("of", F.get("open", choice) if level < depth else F.lit(None).cast("struct<i:int,lo:double,hi:double>"))
        at = F.col("of.lo") + draw(F.col("tree"), F.col("node"), seed, "value") * (F.col("of.hi") - F.col("of.lo"))
        found = found.select(
            "tree", "node", F.col("of.i").alias("feature"), F.when(F.col("of").isNotNull(), at).alias("split"), "n",
            F.when(F.col("of").isNull(), F.lit(float(level)) + _expected(F.col("n"), 4 * sample)).alias("path"),
        )
        nodes = stored(found if nodes is None else nodes.unionByName(found), "nodes")
        inner = nodes.where("feature is not null").select("tree", "node", "feature", "split")
        if level < depth:
            right = F.coalesce(F.get("x", F.col("feature")) >= F.col("split"), F.lit(False)).cast("bigint")
            here = stored(here.join(inner, ["tree", "node"]).select("tree", "x", (2 * F.col("node") + right).alias("node")), "tree-rows")
    return nodes


def score_anomalies(
    rows: DataFrame, nodes: DataFrame, columns: Sequence[str], output: str = "anomaly_score"
) -> DataFrame:
    """``rows`` with a score from 0 to 1: near 1 for vehicles that are soon alone, about a half or less for the rest; null without trees of
    two rows or more.

    The forest (trees x 2 x sample nodes at most) reaches the rows as one value of a subquery.
    """
    size = F.max(F.when(F.col("node") == 1, F.col("n")))
    node = F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "split", "path").alias("of"))))
    packed = nodes.groupBy("tree").agg(size.alias("n"), node.alias("nodes"))
    levels = int(nodes.agg(F.max("node")).head()[0] or 1).bit_length()
    forest = packed.agg(F.array_sort(F.collect_list(F.struct("tree", "n"))).alias("sizes"), F.map_from_entries(F.collect_list(F.struct("tree", "nodes"))).alias("trees"))
    forest = forest.select(F.struct("sizes", "trees")).scalar()
    x = F.array(*[known(F.col(f"`{c}`")) for c in columns])

    def path(tree: Column) -> Column:
        def down(at: Column, _: Column) -> Column:
            of = tree[at]
            right = F.coalesce(F.get(F.col("__x"), of["feature"]) >= of["split"], F.lit(False)).cast("bigint")
            return F.when(of["feature"].isNull(), at).otherwise(2 * at + right)

        leaf = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(1).cast("bigint"), down)
        return tree[leaf]["path"]

    grown = F.filter(F.col("__forest.sizes"), lambda s: s["n"] > 1)
    each = F.transform(grown, lambda s: path(F.col("__forest.trees")[s["tree"]]) / _expected(s["n"], 4 * SAMPLE))
    mean = F.try_divide(F.aggregate(each, F.lit(0.0), lambda a, b: a + b), F.size(each))
    scored = rows.withColumn("__x", x).withColumn("__forest", forest)
    return scored.withColumn(output, F.pow(F.lit(2.0), -mean)).drop("__x", "__forest")


def anomaly_scores(
    rows: DataFrame, columns: Sequence[str], key: str = "vin", trees: int = TREES, sample: int = SAMPLE, seed: int = 42,
    output: str = "anomaly_score",
) -> DataFrame:
    """Grow trees on a stored table of vehicles and score all of them."""
    return score_anomalies(rows, grow_trees(rows, columns, key, trees, sample, seed), columns, output)
