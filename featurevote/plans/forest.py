"""Forests as tables of nodes: read from a saved model, applied to rows, and read for importances.

A forest is applied by walking all its trees down one level at a time, in one expression over arrays
that are part of the plan, as a model is part of a closure. No shuffle, no Python and no model class is
needed, and the rows agree with the fitted model's own to the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NODE_COLUMNS = ("tree", "node", "feature", "threshold", "left", "right", "stats", "n", "gain", "weight")
LEAF = -1


class UnsupportedSplit(ValueError):
    """A node splits by categories; feature tables hold numbers only, so such a forest is not for them."""


def read_forest(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a saved forest, one row each, see NODE_COLUMNS.

    ``stats`` holds the training weight of each class at the node, ``n`` its training rows, ``gain`` the
    impurity won by its split. Leaves have feature, left and right of -1 and no threshold.
    """
    data = spark.read.parquet(f"{path}/data")
    # These columns have no names in every release; their order is the same.
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weight").drop("metadata")
    split = F.col("nodeData.split")
    leaf = F.col("nodeData.leftChild") < 0
    return data.join(weights, "treeID").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.when(leaf, LEAF).otherwise(split["featureIndex"]).alias("feature"),
        F.when(~leaf & (split["numCategories"] < 0), F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.impurityStats").alias("stats"),
        F.col("nodeData.rawCount").alias("n"),
        F.col("nodeData.gain").alias("gain"),
        "weight",
    )


@dataclass(frozen=True)
class Forest:
    """All trees in flat lists; a leaf is its own child, so a walk may go on below it."""

    roots: list[int]
    depth: int
    features: list[int]
    thresholds: list[float]
    left: list[int]
    right: list[int]
    shares: list[list[float]]  # for each class, what a node adds to its votes

    @property
    def classes(self) -> int:
        return len(self.shares)


def forest_of(nodes: DataFrame) -> Forest:
    """Brings a node table to the driver: as much as the model itself, whatever the data's size."""
    rows = nodes.select(*NODE_COLUMNS).orderBy("tree", "node").collect()
    if not rows:
        raise ValueError("a forest needs nodes")
    if any(r["feature"] != LEAF and r["threshold"] is None for r in rows):
        raise UnsupportedSplit("the forest splits by categories")
    place = {(r["tree"], r["node"]): i for i, r in enumerate(rows)}
    children = {place[r["tree"], c] for r in rows if r["feature"] != LEAF for c in (r["left"], r["right"])}

    def child(i: int, row, side: str) -> int:
        return i if row["feature"] == LEAF else place[row["tree"], row[side]]

    left = [child(i, r, "left") for i, r in enumerate(rows)]
    right = [child(i, r, "right") for i, r in enumerate(rows)]
    roots = [i for i in range(len(rows)) if i not in children]
    levels, at = 0, roots
    while at := [c for i in at if rows[i]["feature"] != LEAF for c in (left[i], right[i])]:
        levels += 1
    votes = []
    for r in rows:
        total = sum(r["stats"])
        votes.append([s / total * r["weight"] if total else 0.0 for s in r["stats"]])
    return Forest(
        roots,
        levels,
        [max(0, r["feature"]) for r in rows],
        [0.0 if r["threshold"] is None else r["threshold"] for r in rows],
        left,
        right,
        [list(column) for column in zip(*votes)],
    )


def _constant(values: Sequence, kind: str) -> Column:
    """An array that the optimizer turns into one literal; every number keeps its exact value."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _walk(features: Column, forest: Forest, whole_paths: bool) -> Column:
    """Places in the forest's lists: the leaf that each tree ends in, or all nodes on the way to them."""
    of, cut = _constant(forest.features, "int"), _constant(forest.thresholds, "double")
    left, right = _constant(forest.left, "int"), _constant(forest.right, "int")

    def walked(x: Column) -> Column:
        at = _constant(forest.roots, "int")
        levels = [at]
        for _ in range(forest.depth):
            at = F.transform(
                at, lambda n: F.when(F.get(x, F.get(of, n)) <= F.get(cut, n), F.get(left, n)).otherwise(F.get(right, n))
            )
            levels.append(at)
        return F.array_distinct(F.concat(*levels)) if whole_paths else at

    # Inside a lambda the features are converted once for a row, not once for every comparison.
    return F.get(F.transform(F.array(features.cast("array<double>")), walked), F.lit(0))


def forest_votes(features: Column, forest: Forest) -> Column:
    """For each class, the sum over all trees of the class's share in the leaf, in order of the trees."""
    shares = [_constant(s, "double") for s in forest.shares]

    def adding(share: Column):
        return lambda total, n: total + F.get(share, n)

    def summed(at: Column) -> Column:
        return F.array(*[F.aggregate(at, F.lit(0.0), adding(s)) for s in shares])

    return F.get(F.transform(F.array(_walk(features, forest, False)), summed), F.lit(0))


def score_forest(rows: DataFrame, nodes: DataFrame | Forest, features: str = "features") -> DataFrame:
    """Add ``probability``, ``prediction`` and ``score`` = P(class 1) from a table of nodes.

    The first of equally probable classes is predicted. Values that are not a number go right, as in
    the fitted model.
    """
    forest = nodes if isinstance(nodes, Forest) else forest_of(nodes)
    voted = rows.withColumn("_votes", forest_votes(F.col(features), forest))
    total = F.aggregate("_votes", F.lit(0.0), lambda s, v: s + v)
    share = F.when(F.col("_total") != 0, F.transform("_votes", lambda v: v / F.col("_total"))).otherwise(F.col("_votes"))
    scored = voted.withColumn("_total", total).withColumn("probability", share)
    first_best = F.array_position("probability", F.array_max("probability")) - 1
    scored = scored.withColumn("prediction", first_best.cast("double"))
    return scored.withColumn("score", F.get("probability", F.lit(1))).drop("_votes", "_total")


def recount(
    rows: DataFrame, nodes: DataFrame, features: str = "features", label: str = "label"
) -> DataFrame:
    """The node table with ``stats``, ``n`` and ``gain`` measured on ``rows`` in place of the training rows.

    Every row counts at all nodes that it passes; ``gain`` is the Gini impurity of a node less that of its
    children, weighted by their rows. Nodes that no row reaches have zeros. Rows meet the nodes in one
    scan and are reduced to a count for each node and class before the only shuffle of data.
    """
    forest = forest_of(nodes)
    passed = F.explode(_walk(F.col(features), forest, True)).alias("_place")
    is_class = [F.count_if(F.col(label) == c).cast("double") for c in range(forest.classes)]
    counts = rows.select(label, passed).groupBy("_place").agg(F.array(*is_class).alias("_stats"))
    order = W.partitionBy().orderBy("tree", "node")  # as many rows as the model has nodes
    placed = nodes.withColumn("_place", F.row_number().over(order) - 1).join(counts, "_place", "left")
    zeros = F.array_repeat(F.lit(0.0), forest.classes)
    placed = placed.withColumn("stats", F.coalesce("_stats", zeros)).drop("_stats", "_place")

    n = F.aggregate("stats", F.lit(0.0), lambda s, v: s + v)
    impurity = F.lit(1.0) - F.aggregate("stats", F.lit(0.0), lambda s, v: s + v * v) / (F.col("_n") * F.col("_n"))
    placed = placed.withColumn("_n", n)
    placed = placed.withColumn("_impurity", F.when(F.col("_n") > 0, impurity).otherwise(0.0))
    child = placed.select(F.col("tree").alias("_tree"), F.col("node").alias("_child"), (F.col("_n") * F.col("_impurity")).alias("_held"))
    of_node = (F.col("tree") == F.col("_tree")) & F.col("_child").isin(F.col("left"), F.col("right"))
    held = nodes.select("tree", "node", "left", "right").join(child, of_node).groupBy("tree", "node").agg(F.sum("_held").alias("_below"))
    gain = F.col("_impurity") - F.col("_below") / F.col("_n")
    measured = placed.join(held, ["tree", "node"], "left")
    return measured.withColumns(
        {
            "n": F.col("_n").cast("bigint"),
            "gain": F.when(F.col("_n") <= 0, 0.0).otherwise(F.when(F.col("feature") == LEAF, -1.0).otherwise(gain)),
        }
    ).select(*NODE_COLUMNS)


def node_importances(nodes: DataFrame, n_features: int | None = None) -> DataFrame:
    """(feature, importance) from the nodes alone: gains weighted by training rows, each tree's sum
    brought to 1, then the sum over all trees. ``n_features`` adds those that no node splits by, with 0.
    """
    splits = nodes.where(F.col("feature") != LEAF)
    gained = splits.groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("n")).alias("won"))
    of_tree = F.sum("won").over(W.partitionBy("tree"))
    shares = gained.withColumn("share", F.when(of_tree > 0, F.col("won") / of_tree).otherwise(0.0))
    if n_features is not None:
        none = nodes.sparkSession.range(n_features).select(F.col("id").cast("int").alias("feature"), F.lit(0.0).alias("share"))
        shares = shares.select("feature", "share").union(none)
    summed = shares.groupBy("feature").agg(F.sum("share").alias("raw"))
    # One row for each feature.
    total = F.sum("raw").over(W.partitionBy())
    return summed.select("feature", F.when(total > 0, F.col("raw") / total).otherwise(0.0).alias("importance"))
