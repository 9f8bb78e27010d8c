"""What the driver's tables stand for, as Spark tables and as SQL common table expressions.

embeddings  feature vectors, label >= 5 as the positive class, five fixed linear voters
documents   one raster per row: the text's UTF-8 bytes, three interleaved channels
pages       files with a class segment in their path (the language in the URL)
orders      one row per key with votes from five rules, each in a table of its own
lineitem    a large scored table with about as many different scores as rows
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import table
from featurevote.functions.vectors import linear_score
from featurevote.operators.batches import with_batch, with_split
from featurevote.operators.sinks import FEATURE_LAYOUT, shared_folder, write_table
from featurevote.operators.votes import majority_vote
from featurevote.plans.score import score_linear

WIDTH = 64
MODELS = (1, 2, 3, 4, 5)
MORE_MODELS = (6, 7, 8, 9, 10)
PATH_LABELS = {"en": 1, "es": 0}
PATH_PATTERN = "/(en|es)/"
WEIGHTS = {
    m: [((37 * i + 13 * m) % 11 - 5) / 10 for i in range(WIDTH)] for m in MODELS + MORE_MODELS
}


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, embedding, label 0/1)."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("label")
    )


def votes(spark: SparkSession, sf_dir: str, models=MODELS) -> DataFrame:
    """(vec_id, label, pred_k...)."""
    scored = score_linear(feature_rows(spark, sf_dir), {m: WEIGHTS[m] for m in models}, "embedding")
    return scored.drop("embedding")


def voted(spark: SparkSession, sf_dir: str, models=MODELS) -> DataFrame:
    return majority_vote(votes(spark, sf_dir, models), list(models))


def predictions(spark: SparkSession, sf_dir: str, model: int = 1) -> DataFrame:
    """(vec_id, label, score, prediction) of one fixed linear model."""
    score = linear_score(F.col("embedding"), WEIGHTS[model])
    return feature_rows(spark, sf_dir).select(
        "vec_id", "label", score.alias("score"), (score > 0).cast("double").alias("prediction")
    )


def model_predictions(spark: SparkSession, sf_dir: str, models=MODELS) -> DataFrame:
    """(vec_id, label, model, score, prediction), one row per model and vector, in one scan."""
    cells = F.array(
        *[
            F.struct(
                F.lit(f"model_{m}").alias("model"),
                linear_score(F.col("embedding"), WEIGHTS[m]).alias("score"),
            )
            for m in models
        ]
    )
    return feature_rows(spark, sf_dir).select("vec_id", "label", F.inline(cells)).withColumn(
        "prediction", (F.col("score") > 0).cast("double")
    )


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, features, label, split, batch): the columns of a feature table."""
    rows = feature_rows(spark, sf_dir).withColumnRenamed("embedding", "features")
    return with_batch(with_split(rows, "vec_id"), "vec_id")


_STORES: dict[tuple[str, str], str] = {}


def feature_store(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the feature table, written once per application and input."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _STORES:
        path = shared_folder(spark)
        write_table(laid_out(spark, sf_dir), path, FEATURE_LAYOUT)
        _STORES[place] = path
    return _STORES[place]


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): the whole text as bytes."""
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", F.col("text").cast("binary").alias("content"))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, score, prediction): document length judged against the quality label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    lengths = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = labels.join(lengths, on="doc_id")
    score = F.col("n_chars").cast("double")
    return joined.select(
        "doc_id", "label", score.alias("score"), (score > 1500).cast("int").alias("prediction")
    )


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, score): returned lines scored by their net price."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"),
    )


def order_votes(spark: SparkSession, sf_dir: str) -> list[tuple[int, DataFrame]]:
    """One vote table per rule on orders; the third rule abstains on pending orders."""
    orders = table(spark, sf_dir, "orders")
    label = (F.col("o_orderstatus") == "F").cast("int").alias("label")
    rules = {
        1: F.col("o_totalprice") > 200000,
        2: F.col("o_orderpriority") < "3",
        3: F.month("o_orderdate") <= 6,
        4: F.col("o_custkey") % 2 == 0,
        5: F.year("o_orderdate") < 1998,
    }
    tables = []
    for m, rule in rules.items():
        rows = orders.where(F.col("o_orderstatus") != "P") if m == 3 else orders
        tables.append((m, rows.select("o_orderkey", label, rule.cast("double").alias("prediction"))))
    return tables


# --- the same in SQL -------------------------------------------------------------------------

FEATURE_ROWS = """feature_rows AS (
  SELECT vec_id, embedding::DOUBLE[] AS embedding, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label
  FROM embeddings)"""


def sql_score(model: int) -> str:
    return (
        f"list_dot_product(embedding, list_transform(range({WIDTH}), "
        f"lambda i: (((37 * i + 13 * {model}) % 11 - 5) / 10)::DOUBLE))"
    )


def sql_votes(models=MODELS, name: str = "votes") -> str:
    cells = ", ".join(
        f"CASE WHEN {sql_score(m)} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pred_{m}" for m in models
    )
    return f"{name} AS (SELECT vec_id, label, {cells} FROM feature_rows)"


def sql_voted(models=MODELS, source: str = "votes", name: str = "voted") -> str:
    total = " + ".join(f"pred_{m}" for m in models)
    return (
        f"{name} AS (SELECT *, round(({total}) / {len(models)}.0) AS ensemble_prediction, "
        f"({total}) / {len(models)}.0 AS vote_share FROM {source})"
    )


def sql_model_predictions(models=MODELS) -> str:
    parts = " UNION ALL ".join(
        f"SELECT vec_id, label, 'model_{m}' AS model, {sql_score(m)} AS score FROM feature_rows"
        for m in models
    )
    return (
        f"raw_scores AS ({parts}), model_predictions AS (SELECT *, "
        "CASE WHEN score > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM raw_scores)"
    )


def sql_hash(key: str) -> str:
    return f"('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8))::BIGINT"


LAID_OUT = f"""laid_out AS (
  SELECT vec_id, embedding AS features, label,
         CASE WHEN {sql_hash("'split-' || vec_id")} % 6 + 1 <= 1 THEN 'test' ELSE 'train' END AS split,
         ({sql_hash("vec_id")} % 5 + 1)::INTEGER AS batch
  FROM feature_rows)"""

VOTES = f"WITH {FEATURE_ROWS}, {sql_votes()}"
VOTED = f"{VOTES}, {sql_voted()}"
PREDICTIONS = f"""WITH {FEATURE_ROWS}, predictions AS (
  SELECT vec_id, label, {sql_score(1)} AS score,
         CASE WHEN {sql_score(1)} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
  FROM feature_rows)"""
MODEL_PREDICTIONS = f"WITH {FEATURE_ROWS}, {sql_model_predictions()}"
STORE = f"WITH {FEATURE_ROWS}, {LAID_OUT}"

# One row per byte of every whole text; channel = byte position mod 3.
BYTES = """WITH hexes AS (
  SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS pairs FROM documents),
bytes AS (
  SELECT doc_id, ('0x' || pair)::INTEGER AS v, pos - 1 AS pos, (pos - 1) % 3 AS channel
  FROM (SELECT doc_id, unnest(pairs) AS pair, generate_subscripts(pairs, 1) AS pos FROM hexes))"""

SCORED_DOCUMENTS = """scored_documents AS (
  SELECT l.doc_id, l.quality AS label, d.n_chars::DOUBLE AS score,
         CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS prediction
  FROM labels l JOIN documents d USING (doc_id))"""

ORDER_VOTES = """o AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders),
v1 AS (SELECT o_orderkey, label, (o_totalprice > 200000)::INT::DOUBLE AS pred_1 FROM o),
v2 AS (SELECT o_orderkey, label, (o_orderpriority < '3')::INT::DOUBLE AS pred_2 FROM o),
v3 AS (SELECT o_orderkey, label, (month(o_orderdate) <= 6)::INT::DOUBLE AS pred_3 FROM o
       WHERE o_orderstatus <> 'P'),
v4 AS (SELECT o_orderkey, label, (o_custkey % 2 = 0)::INT::DOUBLE AS pred_4 FROM o),
v5 AS (SELECT o_orderkey, label, (year(o_orderdate) < 1998)::INT::DOUBLE AS pred_5 FROM o),
aligned AS (
  SELECT o_orderkey, v1.label, pred_1, pred_2, pred_3, pred_4, pred_5
  FROM v1 JOIN v2 USING (o_orderkey) JOIN v3 USING (o_orderkey)
  JOIN v4 USING (o_orderkey) JOIN v5 USING (o_orderkey))"""


def sql_metrics(source: str, label: str, prediction: str, by: str = "") -> str:
    """CTEs ``class_metrics`` and ``metrics`` of a prediction table, grouped by ``by``."""
    b = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""sides AS (
  SELECT {b}{label}::DOUBLE AS class, 1 AS support, 0 AS predicted,
         CASE WHEN {label} = {prediction} THEN 1 ELSE 0 END AS hits FROM {source}
  UNION ALL
  SELECT {b}{prediction}::DOUBLE, 0, 1, 0 FROM {source}),
class_metrics AS (
  SELECT {b}class, sum(support)::DOUBLE AS support, sum(predicted)::DOUBLE AS predicted,
         sum(hits)::DOUBLE AS hits FROM sides GROUP BY {b}class),
metrics AS (
  SELECT {b}sum(support)::BIGINT AS n_rows, sum(hits) / sum(support) AS accuracy,
         sum(support * CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END) / sum(support) AS "precision",
         sum(support * CASE WHEN support > 0 THEN hits / support ELSE 0 END) / sum(support) AS recall,
         sum(support * 2 * hits / (predicted + support)) / sum(support) AS f1_score,
         avg(CASE WHEN support > 0 THEN hits / support END) AS hard_auc
  FROM class_metrics {group})"""


def sql_auc(source: str, score: str, label: str, by: str = "") -> str:
    """CTE ``auc``: rank-sum form of the area under the ROC curve, ties at their mean rank."""
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""ranks AS (
  SELECT {b}{label} AS y, rank() OVER ({part} ORDER BY {score})
         + (count(*) OVER (PARTITION BY {b}{score}) - 1) / 2.0::DOUBLE AS r FROM {source}),
auc AS (
  SELECT {b}(sum(CASE WHEN y = 1 THEN r ELSE 0 END)
          - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * sum(1 - y)) AS auc_roc
  FROM ranks {group})"""
