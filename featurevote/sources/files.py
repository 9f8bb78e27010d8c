"""Scans of raw files: bytes with metadata, or decoded images."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


TRIAL_FILES = 10_000


def read_files(
    spark: SparkSession,
    path: str | list[str],
    name_glob: str | None = None,
    recursive: bool = False,
) -> DataFrame:
    """One row per file: path, modificationTime, length, content.

    ``path`` may itself hold glob signs. Spark's scans pass over empty files. Counting or grouping by path never opens the files:
    ``content`` is read only when a later step selects it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.load(path)


def read_readable_files(
    spark: SparkSession,
    path: str | list[str],
    name_glob: str | None = None,
    recursive: bool = False,
    max_bytes: int | None = None,
) -> DataFrame:
    """:func:`read_files` without the files that cannot be read: those that fail while being read, that
    vanish after the listing, or are longer than ``max_bytes`` (by default the most that Spark takes as one
    value). The latter are never opened. :func:`file_status` tells which files those are.

    Spark packs files into tasks by their lengths, so tasks read about the same number of bytes.
    """
    limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    limit = limit if max_bytes is None else min(limit, max_bytes)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.load(path).where(F.col("length") <= limit)


def file_status(listed: DataFrame, stored: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(path, length, bytes, error) for every listed file; ``bytes`` are those that ``stored`` has of it.

    ``listed`` needs path and length, so metadata is enough; ``stored`` needs path and the column
    ``stored`` with the number of bytes, as :func:`featurevote.operators.sinks.ingest_files` writes it.
    ``error`` is missing for whole files, else ``too long``, ``unreadable`` or ``cut short``.
    """
    found = stored.groupBy(F.col("path").alias("_path")).agg(F.max("stored").cast("bigint").alias("bytes"))
    limit = int(listed.sparkSession.conf.get("spark.sql.sources.binaryFile.maxLength"))
    limit = limit if max_bytes is None else min(limit, max_bytes)
    rows = listed.select("path", "length").join(found, F.col("path") == F.col("_path"), "left")
    error = (
        F.when(F.col("length") > limit, "too long")
        .when(F.col("bytes").isNull(), "unreadable")
        .when(F.col("bytes") != F.col("length"), "cut short")
    )
    return rows.select("path", "length", "bytes", error.alias("error"))


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def below_root(path: Column, root: str | list[str]) -> Column:
    """The part of a scanned path below ``root``, with a slash in front; the whole path where the root
    is relative. Glob signs in the root stand for one folder each, as they do in a scan."""
    roots = [re.sub(_SCHEME, "", r) for r in ([root] if isinstance(root, str) else root)]
    depth = min((len([s for s in r.split("/") if s]) if r.startswith("/") else 0) for r in roots)
    parts = F.split(F.regexp_replace(path, _SCHEME, ""), "/")
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, depth + 2, F.size(parts)), "/"))


def tag_below(path: Column, root: str | list[str], pattern: str) -> Column:
    """First group of ``pattern`` in the path below the root; where it does not occur there, its last
    occurrence in the root itself, as when only the folder of one split is scanned; else ``''``."""
    own = F.regexp_extract(below_root(path, root), pattern, 1)
    if not isinstance(root, str):
        return own
    named = [m.group(1) for m in re.finditer(f"(?={pattern})", root.rstrip("/") + "/")]
    return F.when(own == "", F.lit(named[-1])).otherwise(own) if named else own


def read_first_files(
    spark: SparkSession, path: str | list[str], n: int, readable: bool = False, max_bytes: int | None = None, **options
) -> DataFrame:
    """The first ``n`` files in path order, for trial runs; ``readable`` leaves out those that cannot be
    read, as :func:`read_readable_files` does.

    The paths are picked from the listing alone, so only the ``n`` files are ever opened. They pass
    through the driver, so ``n`` is for a look at some files; it may not be above TRIAL_FILES.
    """
    if n > TRIAL_FILES:
        raise ValueError(f"a trial run takes {TRIAL_FILES} files at most; scan a folder instead")
    listed = read_files(spark, path, **options)
    paths = [r["path"] for r in listed.select("path").orderBy("path").limit(n).collect()]
    if not paths:
        return listed.limit(0)
    plain = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]
    return read_readable_files(spark, plain, max_bytes=max_bytes) if readable else read_files(spark, plain)


def read_images(
    spark: SparkSession,
    path: str | list[str],
    name_glob: str | None = None,
    recursive: bool = True,
) -> DataFrame:
    """One row per file: path and the decoded ``image`` struct (height, width, data, ...).

    Files that cannot be decoded keep their row, with height and width of -1. ``path`` is
    spelled as by :func:`read_files` (the image source escapes it), so both scans agree on it.
    """
    reader = (
        spark.read.format("image")
        .option("dropInvalid", "false")
        .option("recursiveFileLookup", str(recursive).lower())
    )
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    origin = F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B"))
    plain = F.regexp_replace(F.url_decode(origin), "^file:///", "file:/")
    return reader.load(path).select(plain.alias("path"), "image")
