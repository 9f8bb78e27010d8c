"""Many fits in one scan for each step, checked by the gradient at what they found."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import stand_ins as S
from catalog.registry import query
from featurevote.functions.labels import stable_batch
from featurevote.functions.vectors import linear_score, logistic
from featurevote.plans import grouped
from featurevote.sources.tables import read_batches

REGS = (0.01, 0.1)
FOLDS = 3


def _gradients(rows, fits, part):
    """(model, reg_param, n_rows, position, gradient), taken from the rows by column expressions alone."""
    cells = [
        F.when(
            F.col(part).isin(list(f.model.parts)),
            F.struct(
                F.lit(f.model.name).alias("model"),
                (logistic(linear_score(F.col("features"), f.coefficients, f.intercept)) - F.col("label")).alias("residual"),
            ),
        )
        for f in fits
    ]
    values = F.concat(F.array(F.lit(1.0)), F.col("features").cast("array<double>"))
    told = rows.select(values.alias("x"), F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))
    told = told.select("model", "residual", F.posexplode("x").alias("position", "x"))
    slopes = told.groupBy("model", "position").agg(
        F.avg(F.col("residual") * F.col("x")).alias("slope"), F.count("*").alias("seen")
    )
    weights = grouped.weight_rows(rows.sparkSession, fits).join(slopes, ["model", "position"])
    pull = F.when(F.col("position") > 0, F.col("reg_param") * F.col("weight")).otherwise(0.0)
    return weights.select("model", "reg_param", "seen", "position", F.round(F.abs(F.col("slope") + pull), 7).alias("gradient"))


POSITIONS = f"positions AS (SELECT unnest(range({S.WIDTH + 1}))::INTEGER AS position), " \
    f"regs AS (SELECT unnest([{', '.join(map(str, REGS))}])::DOUBLE AS reg_param)"


@query(f"""{S.STORE}, {POSITIONS}, parts AS (
  SELECT batch, count(*) AS n_rows FROM laid_out WHERE split = 'train' GROUP BY batch)
SELECT batch, reg_param, n_rows, position, 0.0::DOUBLE AS gradient FROM parts, regs, positions""")
def batch_grid_optimum(spark, sf_dir):
    """Five batches times two penalties fitted together: rows learned from, and a gradient of zero."""
    rows = read_batches(spark, S.feature_store(spark, sf_dir), split="train")
    fits = grouped.fit_grid(rows, grouped.batch_models(range(1, 6), REGS), "batch", standardize=False)
    found = _gradients(rows, fits, "batch")
    batch = F.regexp_extract("model", "^batch_([0-9]+)", 1).cast("int")
    return found.select(batch.alias("batch"), "reg_param", F.col("seen").alias("n_rows"), "position", "gradient")


@query(f"""{S.STORE}, {POSITIONS}, folds AS (
  SELECT ({S.sql_hash('vec_id')} % {FOLDS})::INTEGER AS fold, count(*) AS n FROM laid_out WHERE split = 'train' GROUP BY 1)
SELECT fold, reg_param, ((SELECT sum(n) FROM folds) - n)::BIGINT AS n_rows, position, 0.0::DOUBLE AS gradient
FROM folds, regs, positions""")
def fold_grid_optimum(spark, sf_dir):
    """Three folds times two penalties fitted together, each on the rows of the other folds."""
    stored = read_batches(spark, S.feature_store(spark, sf_dir), split="train")
    rows = stored.withColumn("fold", stable_batch(F.col("vec_id"), FOLDS, first=0))
    fits = grouped.fit_grid(rows, grouped.fold_models(FOLDS, REGS), "fold", standardize=False)
    found = _gradients(rows, fits, "fold")
    fold = F.regexp_extract("model", "^fold_([0-9]+)", 1).cast("int")
    return found.select(fold.alias("fold"), "reg_param", F.col("seen").alias("n_rows"), "position", "gradient")


@query()
def cross_validation_grid(spark, sf_dir):
    """Mean AUC on the fold left out, for each penalty; all fits and all rankings together."""
    rows = read_batches(spark, S.feature_store(spark, sf_dir), split="train")
    return grouped.cross_validate_grid(rows, "vec_id", REGS, FOLDS)
