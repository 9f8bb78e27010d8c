"""Encoded images, checked and measured by their bytes. Documents give the files: a PNG or JPEG with the
text as its body, sound or damaged in one way or another, or the bare text."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import stand_ins as S
from catalog.registry import query, table
from featurevote import values
from featurevote.operators import explore, features, prepare

FILES = """files AS (
  SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'REAL' WHEN doc_id % 4 = 2 THEN 'FAKE' ELSE '' END AS label,
         CASE doc_id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'png' WHEN 5 THEN 'png' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'jpeg' END AS format,
         CASE WHEN doc_id % 6 <> 4 THEN (doc_id % 50)::INTEGER END AS height,
         CASE WHEN doc_id % 6 <> 4 THEN (n_chars % 65536)::INTEGER END AS width,
         doc_id % 6 IN (0, 2) AND doc_id % 50 > 0 AND n_chars % 65536 > 0 AS is_valid
  FROM documents)"""


def _bytes(number, length: int):
    return F.unhex(F.lpad(F.hex(number), 2 * length, "0"))


def _fixed(text: str):
    return F.unhex(F.lit(text))


def image_files(spark, sf_dir):
    """(doc_id, path, content). By doc_id % 6: sound PNG, wrong checksum, sound JPEG, JPEG without its end, no
    image, PNG without its end."""
    documents = table(spark, sf_dir, "documents")
    kind, height, width = F.col("doc_id") % 6, F.col("doc_id") % 50, F.col("n_chars") % 65536
    text = F.col("text").cast("binary")
    header = F.concat(_fixed("49484452"), _bytes(width, 4), _bytes(height, 4), _fixed("0802000000"))
    checksum = (F.crc32(header) + F.when(kind == 1, 1).otherwise(0)) % (1 << 32)
    png = F.concat(_fixed("89504E470D0A1A0A0000000D"), header, _bytes(checksum, 4), text)
    note = F.md5(text).cast("binary")
    frame = F.concat(_fixed("FFC0001108"), _bytes(height, 2), _bytes(width, 2), _fixed("03" + 9 * "01"))
    jpeg = F.concat(_fixed("FFD8FFE00010" + 14 * "00" + "FFFE0022"), note, frame, text)
    content = (
        F.when(kind.isin(0, 1), F.concat(png, _fixed("0000000049454E44AE426082")))
        .when(kind == 5, png)
        .when(kind == 2, F.concat(jpeg, _fixed("FFD9")))
        .when(kind == 3, jpeg)
        .otherwise(text)
    )
    part = F.when(F.col("doc_id") % 4 < 2, "/REAL/").when(F.col("doc_id") % 4 == 2, "/FAKE/").otherwise("/other/")
    return documents.select("doc_id", F.concat(F.lit("/raw"), part, "doc_id").alias("path"), content.alias("content"))


@query(f"WITH {FILES} SELECT doc_id, format, height, width, is_valid FROM files")
def image_headers(spark, sf_dir):
    """Format, size and validity of every file, both outcomes."""
    return prepare.with_header(image_files(spark, sf_dir)).select("doc_id", "format", "height", "width", "is_valid")


@query(f"WITH {FILES} SELECT doc_id, label, height, width FROM files WHERE is_valid")
def prepare_files(spark, sf_dir):
    """Labeled and valid files only."""
    return prepare.prepare_files(image_files(spark, sf_dir)).select("doc_id", "label", "height", "width")


@query(f"WITH {FILES} SELECT is_valid, height, width, count(*) AS n_images FROM files GROUP BY ALL")
def image_dimensions(spark, sf_dir):
    """Images by size, valid and others apart."""
    return explore.image_dimensions(prepare.with_header(image_files(spark, sf_dir)), ["is_valid"], image=None)


# Texts as one row of blue, green and red bytes; every seventh claims a second row that is not there.
COLOURS = f"""{S.BYTES}, sizes AS (SELECT doc_id, count(*) // 3 AS w, doc_id % 7 <> 0 AND count(*) >= 3 AS is_valid FROM bytes GROUP BY doc_id),
sound AS (SELECT doc_id, w FROM sizes WHERE is_valid)"""
TOLD = """SELECT doc_id, is_valid, channel::INTEGER AS channel, coalesce(round(avg(level), 6), 0.0) AS mean,
       coalesce(round(stddev_pop(level), 6), 0.0) AS std, coalesce(min(level), 0)::DOUBLE AS min, coalesce(max(level), 0)::DOUBLE AS max
FROM (SELECT doc_id, is_valid, channel FROM sizes, range(3) AS c(channel)) LEFT JOIN pixels USING (doc_id, channel) GROUP BY ALL"""


def _colours(spark, sf_dir, resample):
    """(doc_id, is_valid, channel, mean, std, min, max) from the features of the texts as colour images."""
    content = F.col("text").cast("binary")
    width = F.floor(F.octet_length(content) / 3).cast("int")
    image = F.struct(
        F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1).alias("height"),
        width.alias("width"),
        F.lit(3).alias("nChannels"),
        F.substring(content, F.lit(1), 3 * width).alias("data"),
    )
    documents = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", image.alias("image"))
    rows = features.image_features(documents, resample=resample)
    first = 3 * values.HISTOGRAM_BINS
    cells = [
        F.struct(
            F.lit(c).alias("channel"),
            *[F.round(F.col("features")[first + 4 * c + i], 6).alias(n) for i, n in enumerate(features.CHANNEL_STATISTICS)],
        )
        for c in range(3)
    ]
    return rows.select("doc_id", "is_valid", F.inline(F.array(*cells)))


@query(f"""{COLOURS}, pixels AS (
  SELECT doc_id, 2 - pos % 3 AS channel, v AS level FROM bytes JOIN sound USING (doc_id) WHERE pos < 3 * w)
{TOLD}""")
def colour_features(spark, sf_dir):
    """Colour images at their own size, readable and not."""
    return _colours(spark, sf_dir, None)


@query(f"""{COLOURS}, taken AS (
  SELECT doc_id, floor((j + 0.5::DOUBLE) * w / 224)::BIGINT AS x, channel FROM sound, range(224) AS t(j), range(3) AS c(channel)),
pixels AS (
  SELECT t.doc_id, t.channel, v AS level FROM taken t JOIN bytes b ON b.doc_id = t.doc_id AND b.pos = 3 * x + 2 - t.channel)
{TOLD}""")
def colour_features_nearest(spark, sf_dir):
    """Colour images brought to 224 x 224 by nearest pixel."""
    return _colours(spark, sf_dir, "nearest")


@query(f"""{COLOURS}, places AS (
  SELECT doc_id, w, j, (j + 0.5::DOUBLE) * w / 224 AS centre, greatest(w / 224.0::DOUBLE, 1) AS stretch FROM sound, range(224) AS t(j)),
near AS (
  SELECT doc_id, j, x, abs((x + 0.5 - centre) / stretch) AS t
  FROM (SELECT *, unnest(range(greatest(0, floor(centre - 2 * stretch) - 1)::BIGINT, least(w, ceil(centre + 2 * stretch) + 1)::BIGINT)) AS x
        FROM places)),
weights AS (
  SELECT doc_id, j, x, CASE WHEN t < 1 THEN 1.5 * t * t * t - 2.5 * t * t + 1
         WHEN t < 2 THEN -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2 ELSE 0 END AS weight FROM near),
pixels AS (
  SELECT n.doc_id, 2 - pos % 3 AS channel, j,
         least(255, greatest(0, floor(sum(weight * v) / sum(weight) + 0.5 + 1e-9))) AS level
  FROM weights n JOIN bytes b ON b.doc_id = n.doc_id AND b.pos // 3 = n.x GROUP BY n.doc_id, 2 - pos % 3, j)
{TOLD}""")
def colour_features_cubic(spark, sf_dir):
    """Colour images brought to 224 x 224 by cubic convolution."""
    return _colours(spark, sf_dir, "cubic")
