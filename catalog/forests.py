"""Forests as tables of nodes: applied, compared with the fitted model, and measured."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog import stand_ins as S
from catalog.models import _rows
from catalog.registry import query
from featurevote.operators import explore, sinks
from featurevote.plans import forest, train
from featurevote.plans.score import score
from featurevote.sources.models import load_model

TREES, LAST_LEVEL = 7, 32


def _is_leaf(tree: int, node: int) -> bool:
    return node >= LAST_LEVEL or (node > 1 and (7 * node + 5 * tree) % 4 == 0)


def fixed_nodes(spark):
    """Seven uneven trees that follow from a rule, nodes numbered 2n and 2n + 1 below n."""
    rows = []
    for tree in range(TREES):
        todo = [1]
        while todo:
            node = todo.pop()
            leaf = _is_leaf(tree, node)
            no = 1.0 + (5 * node + tree) % 7  # of 8, so that sums of shares are exact
            split = (-1, None, -1, -1) if leaf else ((37 * node + 13 * tree) % S.WIDTH, ((7 * node + 3 * tree) % 11 - 5) / 50, 2 * node, 2 * node + 1)
            rows.append((tree, node, *split, [no, 8 - no], 1, 0.0, 1.0))
            todo += [] if leaf else [2 * node, 2 * node + 1]
    schema = (
        "tree int, node int, feature int, threshold double, left int, right int, "
        "stats array<double>, n bigint, gain double, weight double"
    )
    return spark.createDataFrame(rows, schema)


WALK = f"""WITH RECURSIVE {S.FEATURE_ROWS}, walk AS (
  SELECT vec_id, label, embedding, tree::INTEGER AS tree, 1 AS node FROM feature_rows, range({TREES}) AS t(tree)
  UNION ALL
  SELECT vec_id, label, embedding, tree,
         CASE WHEN embedding[(37 * node + 13 * tree) % {S.WIDTH} + 1] <= (((7 * node + 3 * tree) % 11 - 5) / 50.0)::DOUBLE
              THEN 2 * node ELSE 2 * node + 1 END AS node
  FROM walk WHERE NOT (node >= {LAST_LEVEL} OR (node > 1 AND (7 * node + 5 * tree) % 4 = 0))),
visits AS (SELECT *, node >= {LAST_LEVEL} OR (node > 1 AND (7 * node + 5 * tree) % 4 = 0) AS leaf FROM walk)"""


@query(f"""{WALK}, votes AS (
  SELECT vec_id, label, sum(1 + (5 * node + tree) % 7)::DOUBLE AS no, sum(7 - (5 * node + tree) % 7)::DOUBLE AS yes
  FROM visits WHERE leaf GROUP BY vec_id, label)
SELECT vec_id, label, CASE WHEN yes > no THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction,
       round(yes / (yes + no), 6) AS score FROM votes""")
def forest_scores(spark, sf_dir):
    """All vectors scored by a table of nodes, in one expression."""
    scored = forest.score_forest(S.feature_rows(spark, sf_dir), fixed_nodes(spark), "embedding")
    return scored.select("vec_id", "label", "prediction", F.round("score", 6).alias("score"))


@query(f"""{S.STORE} SELECT vec_id, label, true AS loaded_agrees, true AS nodes_agree
FROM laid_out WHERE split = 'test'""")
def saved_forest_scores(spark, sf_dir):
    """A forest over all training rows, saved; loaded again, and read as nodes: all three say the same."""
    path = sinks.shared_folder(spark)
    model = train.fit_all(_rows(spark, sf_dir, "train"), train.random_forest("small"))
    sinks.save_model(model, path)
    rows = _rows(spark, sf_dir, "test").withColumn("values", vector_to_array("features"))
    for name, known in (("fitted", model), ("loaded", load_model(path, "rf"))):
        scored = score(known, rows).withColumn(name, F.struct("probability", "prediction"))
        rows = scored.drop("probability", "prediction", "score")
    rows = forest.score_forest(rows, forest.read_forest(spark, path), "values")
    return rows.select(
        "vec_id",
        F.col("label").cast("int").alias("label"),
        (F.col("fitted") == F.col("loaded")).alias("loaded_agrees"),
        (F.col("fitted") == F.struct("probability", "prediction")).alias("nodes_agree"),
    )


RECOUNTED = f"""{WALK}, counted AS (
  SELECT tree, node, bool_or(leaf) AS leaf, count(*) AS n, count(*) FILTER (label = 1) AS yes FROM visits GROUP BY tree, node),
held AS (SELECT *, n * (1 - ((yes * yes + (n - yes) * (n - yes))::DOUBLE / (n * n))) AS impurity FROM counted),
gains AS (
  SELECT p.tree, (37 * p.node + 13 * p.tree) % {S.WIDTH} AS feature, p.impurity - coalesce(sum(c.impurity), 0) AS won
  FROM held p LEFT JOIN held c ON c.tree = p.tree AND c.node IN (2 * p.node, 2 * p.node + 1)
  WHERE NOT p.leaf GROUP BY p.tree, p.node, p.impurity),
shares AS (
  SELECT tree, feature, sum(won) / sum(sum(won)) OVER (PARTITION BY tree) AS share FROM gains GROUP BY tree, feature),
importances AS (
  SELECT position::INTEGER AS position, coalesce(sum(share), 0) / {TREES} AS importance
  FROM range({S.WIDTH}) AS p(position) LEFT JOIN shares ON feature = position GROUP BY position)"""


def _measured(spark, sf_dir):
    nodes = forest.recount(S.feature_rows(spark, sf_dir), fixed_nodes(spark), "embedding")
    return forest.node_importances(nodes, S.WIDTH).withColumnRenamed("feature", "position")


@query(f"""{RECOUNTED} SELECT position, round(importance, 6) AS importance FROM importances""")
def measured_importances(spark, sf_dir):
    """What each feature is worth to a forest on given rows, from counts at its nodes."""
    return _measured(spark, sf_dir).withColumn("importance", F.round("importance", 6))


@query(f"""{RECOUNTED} SELECT position, round(importance, 6) AS importance FROM importances
ORDER BY round(importance, 6) DESC, position LIMIT 10""")
def top_measured_importances(spark, sf_dir):
    return explore.top_importances(measured_importances(spark, sf_dir))
