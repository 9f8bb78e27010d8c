"""Fitting, scoring and judging MLlib models. Fits are iterative, so most have no SQL twin."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog import stand_ins as S
from catalog.registry import query, table
from featurevote.functions.vectors import linear_score, logistic
from featurevote.operators import explore, sinks
from featurevote.operators.batches import with_split
from featurevote.operators.prepare import valid_rows
from featurevote.plans import ensemble, runs, train
from featurevote.plans.evaluate import evaluate
from featurevote.plans.infer import byte_rows, predict, predict_bytes
from featurevote.plans.score import score
from featurevote.sources.models import load_model
from featurevote.sources.tables import read_batches


def _rows(spark, sf_dir, split, max_batch=None):
    """Training or test rows of the written feature table, pruned to what is asked for."""
    stored = read_batches(spark, S.feature_store(spark, sf_dir), split=split, max_batch=max_batch)
    return train.training_rows(stored, keep=["vec_id", "batch"])


@query()
def fit_logistic_regression(spark, sf_dir):
    """Coefficients of one model over all training rows."""
    model = train.fit_all(_rows(spark, sf_dir, "train"), train.logistic_regression("quick"))
    weights = [(i, float(w)) for i, w in enumerate([model.intercept, *model.coefficients])]
    return spark.createDataFrame(weights, "position int, weight double")


_PENALTY = 0.1


@query("""SELECT position, 0.0::DOUBLE AS gradient FROM (
  SELECT DISTINCT generate_subscripts(embedding, 1)::INTEGER AS position FROM embeddings
  UNION ALL SELECT 0)""")
def logistic_regression_optimum(spark, sf_dir):
    """Gradient of the penalized loss at the fitted weights; position 0 is the intercept.

    It vanishes at the optimum and nowhere else, whatever solver found it.
    """
    rows = _rows(spark, sf_dir, "train")
    estimator = train.logistic_regression(
        "quick", regParam=_PENALTY, standardization=False, tol=1e-10, maxIter=300
    )
    model = train.fit_all(rows, estimator)
    array = vector_to_array("features")
    residual = logistic(linear_score(array, list(model.coefficients), model.intercept)) - F.col("label")
    cells = rows.select(
        residual.alias("residual"), F.posexplode(F.concat(F.array(F.lit(1.0)), array)).alias("position", "x")
    )
    penalties = F.array(F.lit(0.0), *[F.lit(_PENALTY * float(w)) for w in model.coefficients])
    slopes = cells.groupBy("position").agg(F.avg(F.col("residual") * F.col("x")).alias("slope"))
    gradient = F.abs(F.col("slope") + F.get(penalties, F.col("position")))
    return slopes.select("position", F.round(gradient, 4).alias("gradient"))


@query()
def fit_random_forest(spark, sf_dir):
    """Test rows scored by a forest over all training rows."""
    model = train.fit_all(_rows(spark, sf_dir, "train"), train.random_forest("small"))
    scored = score(model, _rows(spark, sf_dir, "test"))
    return scored.select("vec_id", "label", "prediction", F.round("score", 6).alias("score"))


@query()
def feature_importances(spark, sf_dir):
    model = train.fit_all(_rows(spark, sf_dir, "train"), train.random_forest("small"))
    return explore.feature_importances(spark, model)


@query()
def top_importances(spark, sf_dir):
    return explore.top_importances(feature_importances(spark, sf_dir))


def _per_batch(spark, sf_dir, estimator):
    models = train.fit_per_batch(_rows(spark, sf_dir, "train"), estimator, parallelism=5)
    return ensemble.ensemble_votes(models, _rows(spark, sf_dir, "test"), ["vec_id", "label"])


@query()
def batch_ensemble_logistic(spark, sf_dir):
    """One logistic regression per mixed batch, voting on the test rows."""
    return _per_batch(spark, sf_dir, train.logistic_regression("mixed_batches"))


@query()
def batch_ensemble_forest(spark, sf_dir):
    return _per_batch(spark, sf_dir, train.random_forest("single_class_batches"))


@query()
def batch_ensemble_metrics(spark, sf_dir):
    voted = batch_ensemble_logistic(spark, sf_dir)
    return ensemble.ensemble_report(voted, facts={"training_batches": 5})


@query(f"{S.STORE} SELECT vec_id, label, 0.5::DOUBLE AS vote_share, 1.0::DOUBLE AS ensemble_prediction "
       "FROM laid_out WHERE split = 'test'")
def single_class_ensemble(spark, sf_dir):
    """Ten batches of one class each: every model knows one answer, five against five is a tie."""
    rows = _rows(spark, sf_dir, "train")
    rows = rows.withColumn("batch", F.col("batch") + 5 * F.col("label").cast("int"))
    estimator = train.logistic_regression("single_class_batches")
    models = train.fit_per_batch(rows, estimator, single_class="fit", parallelism=5)
    test = _rows(spark, sf_dir, "test").withColumn("label", F.col("label").cast("int"))
    voted = ensemble.ensemble_votes(models, test, ["vec_id", "label"])
    return voted.select("vec_id", "label", "vote_share", "ensemble_prediction")


@query()
def fit_small_preset(spark, sf_dir):
    """Fit on the first batch only and score the test rows."""
    rows = _rows(spark, sf_dir, "train", max_batch=1)
    model = train.fit_all(rows, train.logistic_regression("small"))
    return score(model, _rows(spark, sf_dir, "test")).select("vec_id", "label", "prediction")


@query()
def cross_validation(spark, sf_dir):
    grid = (0.01, 0.1)
    validated = train.cross_validate(_rows(spark, sf_dir, "train"), "vec_id", reg_params=grid)
    return train.grid_scores(spark, validated, grid)


@query()
def evaluate_model(spark, sf_dir):
    """Score, write predictions, take all metrics from what was written."""
    model = train.fit_all(_rows(spark, sf_dir, "train"), train.logistic_regression("small"))
    predictions, metrics = sinks.shared_folder(spark), sinks.shared_folder(spark)
    return evaluate(model, _rows(spark, sf_dir, "test"), predictions, metrics, key="vec_id")


@query()
def batch_inference(spark, sf_dir):
    """Saved model, loaded again, applied to the stored features; predictions written and read."""
    path, output = sinks.shared_folder(spark), sinks.shared_folder(spark)
    model = train.fit_all(_rows(spark, sf_dir, "train"), train.logistic_regression("small"))
    sinks.save_model(model, path)
    stored = read_batches(spark, S.feature_store(spark, sf_dir), split="test")
    scored = predict(stored.select("vec_id", "label", "features"), load_model(path, "lr"))
    columns = ("vec_id", "label", "prediction", "probability")
    sinks.save_predictions(scored, output, columns)
    return spark.read.parquet(output)


@query()
def training_run(spark, sf_dir):
    """Both models of a preset on all batches: metrics by model, from the written predictions."""
    store = S.feature_store(spark, sf_dir)
    return runs.train_on_all(spark, store, sinks.shared_folder(spark), "small", key="vec_id")


@query()
def ensemble_run(spark, sf_dir):
    """One model per batch, votes and metrics written; the metric table."""
    store, output = S.feature_store(spark, sf_dir), sinks.shared_folder(spark)
    return runs.train_ensemble(spark, store, output, "lr", key="vec_id", parallelism=5)["metrics"]


def _plain_raster(content: bytes) -> np.ndarray:
    """Decoder of the files below: a mark, then blue, green and red in turn; RGB in one row."""
    if not content.startswith(b"RAW1"):
        raise ValueError("not such a file")
    pixels = np.frombuffer(content, dtype=np.uint8)[4:]
    return pixels[: len(pixels) // 3 * 3].reshape(1, -1, 3)[:, :, ::-1]


def _raw_files(spark, sf_dir):
    """(doc_id, label, split, content): whole texts as digits and letters of their bytes, which are large for one
    class and small for the other; every tenth file is broken."""
    documents = table(spark, sf_dir, "documents")
    digits, label = F.concat(F.hex(F.col("text")), F.lit("ABCDEF")), (F.col("doc_id") % 2).cast("int")
    body = F.when(label == 1, digits).otherwise(F.lower(digits))
    mark = F.when(F.col("doc_id") % 10 == 9, F.lit("RAW?")).otherwise(F.lit("RAW1"))
    rows = documents.select("doc_id", label.alias("label"), F.concat(mark, body).cast("binary").alias("content"))
    return with_split(rows, "doc_id")


@query(f"""SELECT doc_id, (doc_id % 2)::INTEGER AS label, doc_id % 10 <> 9 AS is_valid,
       CASE WHEN doc_id % 10 <> 9 THEN (doc_id % 2)::DOUBLE END AS prediction
FROM documents WHERE {S.sql_hash("'split-' || doc_id")} % 6 + 1 <= 1""")
def inference_from_bytes(spark, sf_dir):
    """From a table of encoded files to predictions: decoded, turned into features, fitted, saved, loaded,
    scored, written. The classes can be told apart, so every readable file gets its own class."""
    table_path, model_path, output = (sinks.shared_folder(spark) for _ in range(3))
    sinks.write_table(_raw_files(spark, sf_dir), table_path, ("split",))
    stored = spark.read.parquet(table_path)
    fit = valid_rows(byte_rows(stored.where("split = 'train'"), _plain_raster, resample=None))
    model = train.fit_all(train.training_rows(fit), train.logistic_regression("small"))
    sinks.save_model(model, model_path)
    test = stored.where("split = 'test'")
    found = predict_bytes(test, output, model_path, "lr", ["doc_id", "label"], _plain_raster, resample=None)
    return found.select("doc_id", "label", "is_valid", "prediction")


@query(f"""{S.STORE} SELECT kind, count(*) AS n_rows, 5::BIGINT AS n_voters, true AS votes_agree, true AS metrics_agree,
       true AS best_is_best FROM laid_out, (SELECT unnest(['lr', 'rf']) AS kind) WHERE split = 'test' GROUP BY kind""")
def compare_fitted_ensembles(spark, sf_dir):
    """Two ensembles fitted per batch, of regressions and of forests, saved and compared; what they report is
    taken again from the saved votes by plain counts."""
    store = S.feature_store(spark, sf_dir)
    voted = {}
    for kind, preset in (("lr", "mixed_batches"), ("rf", "single_class_batches")):
        output = sinks.shared_folder(spark)
        voted[kind] = runs.train_ensemble(spark, store, output, kind, preset, key="vec_id", parallelism=5)["votes"]
    metrics, best = ensemble.compare_ensembles(voted, ("rf", "lr"))
    names = [f"pred_{b}" for b in range(1, 6)]
    parts = []
    for kind, votes in voted.items():
        share = sum(F.col(n) for n in names) / 5
        own = F.when(share >= 0.5, 1.0).otherwise(0.0)
        hit, said, is_true = (c.cast("double") for c in (own == F.col("label"), own, F.col("label")))
        parts.append(
            votes.agg(
                F.count("*").alias("n_rows"),
                F.lit(len([c for c in votes.columns if c.startswith("pred_")])).cast("bigint").alias("n_voters"),
                F.bool_and((own == F.col("ensemble_prediction")) & (F.abs(share - F.col("vote_share")) < 1e-12)).alias("votes_agree"),
                F.avg(hit).alias("own_accuracy"),
                F.try_divide(F.sum(said * is_true), F.sum(is_true)).alias("own_recall"),
                F.try_divide(F.sum((1 - said) * (1 - is_true)), F.sum(1 - is_true)).alias("own_other"),
            ).withColumn("model", F.lit(kind))
        )
    both = parts[0].unionByName(parts[1]).join(metrics.drop("n_rows"), "model")
    winner = best.first()
    agrees = (F.abs(F.col("own_accuracy") - F.col("accuracy")) < 1e-9) & (
        F.abs((F.col("own_recall") + F.col("own_other")) / 2 - F.col("auc_roc")) < 1e-9
    )
    is_best = (F.col("accuracy") < winner["best_accuracy"]) | (
        (F.col("accuracy") == winner["best_accuracy"]) & ((F.col("model") == winner["best_model"]) | (F.col("model") == "lr"))
    )
    return both.select(
        F.col("model").alias("kind"), "n_rows", "n_voters", "votes_agree", agrees.alias("metrics_agree"), is_best.alias("best_is_best")
    )


@query(f"""{S.STORE} SELECT count(*) AS n_rows, true AS accuracy_agrees, true AS recall_agrees, true AS auc_is_a_share
FROM laid_out WHERE split = 'test'""")
def evaluated_metrics_agree(spark, sf_dir):
    """What an evaluation saves, against plain counts over the predictions that it saved."""
    model = train.fit_all(_rows(spark, sf_dir, "train"), train.logistic_regression("small"))
    predictions, metrics = sinks.shared_folder(spark), sinks.shared_folder(spark)
    evaluate(model, _rows(spark, sf_dir, "test"), predictions, metrics, key="vec_id")
    saved = spark.read.parquet(metrics).first()
    rows = spark.read.parquet(predictions)
    hit = (F.col("label") == F.col("prediction")).cast("double")
    told = rows.agg(F.count("*").alias("n_rows"), F.avg(hit).alias("accuracy"))
    return told.select(
        "n_rows",
        (F.abs(F.col("accuracy") - saved["accuracy"]) < 1e-9).alias("accuracy_agrees"),
        # Weighted by the classes' rows, recall is the share of hits.
        (F.abs(F.col("accuracy") - saved["recall"]) < 1e-9).alias("recall_agrees"),
        F.lit(0 < saved["auc"] < 1).alias("auc_is_a_share"),
    )
