"""Feature extraction and feature exploration."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from catalog import stand_ins as S
from catalog.registry import query, table
from featurevote import values
from featurevote.functions import vectors as V
from featurevote.operators import explore, features
from featurevote.plans.infer import embed_table

N_PROJECTED = 8


@query(f"""{S.BYTES} SELECT doc_id, channel::INTEGER AS channel, v AS bin, count(*) AS n
FROM bytes GROUP BY doc_id, channel, v""")
def channel_histogram(spark, sf_dir):
    rows = S.rasters(spark, sf_dir)
    counted = rows.select("doc_id", features.byte_counts(F.col("content"), 3).alias("counts"))
    return features.histogram_rows(counted, "counts", "doc_id")


@query(f"""{S.BYTES} SELECT doc_id, channel::INTEGER AS channel, round(avg(v), 6) AS mean,
       round(stddev_pop(v), 6) AS std, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max
FROM bytes GROUP BY doc_id, channel""")
def channel_statistics(spark, sf_dir):
    """Texts of one or two bytes have no third channel, so no row for it."""
    described = S.rasters(spark, sf_dir).select(
        "doc_id",
        F.length("content").alias("n_bytes"),
        features.byte_statistics(F.col("content"), "per_channel").alias("s"),
    )
    names = features.CHANNEL_STATISTICS
    channels = [
        F.struct(
            F.lit(c).alias("channel"),
            *[F.round(F.col("s")[len(names) * c + i], 6).alias(n) for i, n in enumerate(names)],
        )
        for c in range(3)
    ]
    rows = described.select("doc_id", "n_bytes", F.inline(F.array(*channels)))
    return rows.where("channel < n_bytes").drop("n_bytes")


@query(f"""{S.BYTES} SELECT doc_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
       min(v)::DOUBLE AS min, max(v)::DOUBLE AS max, median(v)::DOUBLE AS median,
       quantile_cont(v, 0.25)::DOUBLE AS p25, quantile_cont(v, 0.75)::DOUBLE AS p75,
       round(var_pop(v), 6) AS var, (max(v) - min(v))::DOUBLE AS range, sum(v)::DOUBLE AS sum,
       count(*)::DOUBLE AS len, count(*) FILTER (v <> 0)::DOUBLE AS nonzero
FROM bytes GROUP BY doc_id""")
def global_statistics(spark, sf_dir):
    described = S.rasters(spark, sf_dir).select(
        "doc_id", features.byte_statistics(F.col("content"), "global").alias("s")
    )
    return described.select(
        "doc_id",
        *[F.round(F.col("s")[i], 6).alias(n) for i, n in enumerate(features.GLOBAL_STATISTICS)],
    )


@query(f"""{S.BYTES}, stats AS (
  SELECT doc_id, channel, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS low, max(v) AS high
  FROM bytes GROUP BY doc_id, channel)
SELECT doc_id, true AS is_valid, 2048 AS width, count(*)::DOUBLE AS histogram_sum,
       round(sum(mean * (channel + 1)), 6) AS means, round(sum(std * (channel + 1)), 6) AS stds,
       sum(low * (channel + 1))::DOUBLE AS lows, sum(high * (channel + 1))::DOUBLE AS highs,
       0.0::DOUBLE AS tail
FROM stats GROUP BY doc_id""")
def extract_features(spark, sf_dir):
    """The whole vector of every text, checked by its parts."""
    rows = features.byte_features(S.rasters(spark, sf_dir))
    vector, first = F.col("features"), 3 * values.HISTOGRAM_BINS

    def weighted(statistic: int):
        return sum((c + 1) * vector[first + 4 * c + statistic] for c in range(3))

    def total(start: int, length: int):
        return F.aggregate(F.slice(vector, start + 1, length), F.lit(0.0), lambda s, x: s + x)

    tail = first + 12
    return rows.select(
        "doc_id",
        "is_valid",
        F.size(vector).alias("width"),
        F.round(total(0, first), 6).alias("histogram_sum"),
        F.round(weighted(0), 6).alias("means"),
        F.round(weighted(1), 6).alias("stds"),
        weighted(2).alias("lows"),
        weighted(3).alias("highs"),
        total(tail, values.FEATURE_WIDTH - tail).alias("tail"),
    )


@query(f"""{S.BYTES}, widths AS (SELECT doc_id, count(*) AS w FROM bytes GROUP BY doc_id),
sampled AS (
  SELECT doc_id, floor((j + 0.5::DOUBLE) * w / 224)::BIGINT AS pos
  FROM widths, (SELECT unnest(range(224)) AS j))
SELECT doc_id, true AS is_valid, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
       min(v)::DOUBLE AS min, max(v)::DOUBLE AS max, count(*) * 224.0::DOUBLE * 3 AS len
FROM sampled JOIN bytes USING (doc_id, pos) GROUP BY doc_id""")
def image_features(spark, sf_dir):
    """Texts as one-row grey images, brought to 224 x 224 by nearest pixel."""
    content = F.col("content")
    image = F.struct(
        F.lit(1).alias("height"),
        F.length(content).alias("width"),
        F.lit(1).alias("nChannels"),
        content.alias("data"),
    )
    images = S.rasters(spark, sf_dir).select("doc_id", image.alias("image"))
    rows = features.image_features(images, layout="global", resample="nearest")
    first = 3 * values.HISTOGRAM_BINS
    wanted = {n: first + features.GLOBAL_STATISTICS.index(n) for n in ("mean", "std", "min", "max", "len")}
    return rows.select(
        "doc_id", "is_valid", *[F.round(F.col("features")[i], 6).alias(n) for n, i in wanted.items()]
    )


@query("""SELECT vec_id, 2048 AS width, round(list_sum(embedding::DOUBLE[]), 6) AS total, 0.0::DOUBLE AS tail,
       32 AS cut_width, round(list_sum(embedding[1:32]::DOUBLE[]), 6) AS cut_total
FROM embeddings""")
def pad_to_width(spark, sf_dir):
    padded = V.pad_to_width(F.col("embedding"))
    cut = V.pad_to_width(F.col("embedding"), 32)

    def total(array):
        return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)

    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.size(padded).alias("width"),
        F.round(total(padded), 6).alias("total"),
        total(F.slice(padded, S.WIDTH + 1, values.FEATURE_WIDTH)).alias("tail"),
        F.size(cut).alias("cut_width"),
        F.round(total(cut), 6).alias("cut_total"),
    )


@query("""SELECT doc_id, embedding IS NOT NULL AS is_valid, 64 AS width,
       coalesce(round(list_sum(embedding::DOUBLE[]), 6), 0.0) AS total
FROM documents LEFT JOIN embeddings ON doc_id = vec_id""")
def zero_vector_for_missing(spark, sf_dir):
    """Documents without a vector keep their row, with zeros and a flag."""
    documents = table(spark, sf_dir, "documents").select("doc_id")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    filled = V.or_zero_vector(F.col("embedding"), S.WIDTH)
    return documents.join(vectors, on="doc_id", how="left").select(
        "doc_id",
        F.col("embedding").isNotNull().alias("is_valid"),
        F.size(filled).alias("width"),
        F.round(F.aggregate(filled, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


@query(f"""{S.BYTES} SELECT doc_id,
       round((avg(v) FILTER (channel = 0) / 255 - 0.485) / 0.229, 6) AS red,
       round((avg(v) FILTER (channel = 1) / 255 - 0.456) / 0.224, 6) AS green,
       round((avg(v) FILTER (channel = 2) / 255 - 0.406) / 0.225, 6) AS blue
FROM bytes GROUP BY doc_id""")
def standardized_channels(spark, sf_dir):
    described = S.rasters(spark, sf_dir).select(
        "doc_id",
        F.length("content").alias("n_bytes"),
        features.byte_statistics(F.col("content"), "per_channel").alias("s"),
    )
    names = ("red", "green", "blue")
    means = described.select(
        "doc_id",
        *[F.when(F.col("n_bytes") > c, F.col("s")[4 * c]).alias(n) for c, n in enumerate(names)],
    )
    rows = features.standardized_channels(means, names)
    return rows.select("doc_id", *[F.round(n, 6).alias(n) for n in names])


@query("""SELECT vec_id, 64 AS width, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def vector_roundtrip(spark, sf_dir):
    """Arrays to ML vectors and back."""
    vector = array_to_vector(V.as_doubles(F.col("embedding")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vector.alias("vector"))
    back = vector_to_array("vector")
    return rows.select(
        "vec_id",
        F.size(back).alias("width"),
        F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


@query(f"""WITH {S.FEATURE_ROWS} """ + " UNION ALL ".join(
    f"SELECT vec_id, {c} AS dimension, round({S.sql_score(c + 1)}, 6) AS value FROM feature_rows"
    for c in range(N_PROJECTED)))
def embed_with_model(spark, sf_dir):
    """Vectors through a batch model that every task loads once."""

    width, outputs = S.WIDTH, N_PROJECTED

    def make_model():
        i, m = np.arange(width)[:, None], np.arange(1, outputs + 1)[None, :]
        matrix = ((37 * i + 13 * m) % 11 - 5) / 10
        return lambda batch: batch @ matrix

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    embedded = embed_table(rows, make_model, "embedding", S.WIDTH, output="projected")
    return embedded.select("vec_id", F.posexplode_outer("projected").alias("dimension", "value")).withColumn(
        "value", F.round("value", 6)
    )


POSITIONS = """WITH positions AS (
  SELECT generate_subscripts(embedding, 1)::INTEGER - 1 AS position, unnest(embedding)::DOUBLE AS value
  FROM embeddings)"""


@query(f"""{POSITIONS} SELECT position::INTEGER AS position, count(*) AS n, round(avg(value), 6) AS mean,
       round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
       count(*) FILTER (value <> 0) AS nonzero
FROM positions GROUP BY position""")
def feature_statistics(spark, sf_dir):
    described = explore.feature_statistics(table(spark, sf_dir, "embeddings"), "embedding")
    return described.withColumns({c: F.round(c, 6) for c in ("mean", "std", "min", "max")})


@query(f"""{POSITIONS} SELECT position::INTEGER AS position,
       greatest(0, least(floor((value - -0.3) / ((0.3 - -0.3) / 12)) + 1, 13))::INTEGER AS bin, count(*) AS n
FROM positions GROUP BY ALL""")
def feature_distribution(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return explore.feature_distribution(rows, -0.3, 0.3, 12, "embedding")


@query(f"""{POSITIONS} SELECT position::INTEGER AS position, round(quantile_disc(value, 0.25), 6) AS p25,
       round(quantile_disc(value, 0.5), 6) AS median, round(quantile_disc(value, 0.75), 6) AS p75
FROM positions GROUP BY position""")
def feature_quartiles(spark, sf_dir):
    rows = explore.feature_quantiles(table(spark, sf_dir, "embeddings"), features="embedding")
    names = ("p25", "median", "p75")
    return rows.select("position", *[F.round(F.col("quantiles")[i], 6).alias(n) for i, n in enumerate(names)])


@query(f"""{POSITIONS} SELECT (64 * copy + position)::INTEGER AS position,
       round(quantile_disc(value * (copy - 15), 0.1), 6) AS p10, round(quantile_disc(value * (copy - 15), 0.5), 6) AS median,
       round(quantile_disc(value * (copy - 15), 0.9), 6) AS p90
FROM positions, range(32) AS c(copy) GROUP BY 1""")
def wide_quantiles(spark, sf_dir):
    """Quantiles of vectors of the full width, made of 32 multiples of the stored ones."""
    places = F.sequence(F.lit(0), F.lit(values.FEATURE_WIDTH - 1))
    wide = F.transform(
        places,
        lambda i: F.get("embedding", i % S.WIDTH).cast("double") * (F.floor(i / S.WIDTH) - 15),
    )
    rows = table(spark, sf_dir, "embeddings").select(wide.alias("features"))
    found = explore.feature_quantiles(rows, (0.1, 0.5, 0.9))
    names = ("p10", "median", "p90")
    return found.select("position", *[F.round(F.col("quantiles")[i], 6).alias(n) for i, n in enumerate(names)])


@query()
def feature_quantiles(spark, sf_dir):
    return explore.feature_quantiles(table(spark, sf_dir, "embeddings"), features="embedding")


@query()
def principal_components(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return explore.principal_components(rows, 3, "embedding")[1].select("vec_id", "components")


@query("""SELECT vec_id, 64 AS n_components,
       round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS squared_length
FROM embeddings""")
def principal_rotation(spark, sf_dir):
    """All principal components together are a rotation, so lengths stay."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    turned = explore.principal_components(rows, S.WIDTH, "embedding")[1]
    squares = F.aggregate("components", F.lit(0.0), lambda total, x: total + x * x)
    return turned.select(
        "vec_id", F.size("components").alias("n_components"), F.round(squares, 6).alias("squared_length")
    )
