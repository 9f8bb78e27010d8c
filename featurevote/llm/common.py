"""What several of the text operators need: shared folders, table writes, per-text Python work."""

from __future__ import annotations

import functools
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SLICE_BYTES = 8 << 20
# Fixed value: the splitting pattern of byte-level vocabularies.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A space before something visible. White space beyond ASCII is left to the tokenizer's pattern.
SOFT_CUT = re.compile(r" (?=[!-~])")
HARD_SPACE = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() or c < " " or c == "\x7f")


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that all executors share. Only a local session, whose executors
    are the driver itself, may leave it unset and gets one temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and not again if executors are lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text) -> F.Column:
    """Identifies a text beside its document id, as ids may repeat or be missing."""
    return F.xxhash64(text)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE_BYTES of text each, so that what is built from them stays small."""
    start, held = 0, 0
    for row, size in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        held += size or 0
        if held >= SLICE_BYTES:
            yield batch.slice(start, row + 1 - start)
            start, held = row + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    fields: list[StructField],
    start: Callable[[], Callable[[list], list[pa.Array]]],
) -> DataFrame:
    """Rows of id and computed fields, one per document, without a shuffle.

    `start` runs once in each task and returns a function from a list of texts (None for a missing
    one) to one Arrow array per field. Other columns of the input are left behind.
    """
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *fields])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in slices(batch, 1):
                arrays = work(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=names)

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, schema)


def packed_lists(rows: list[bytes]) -> pa.ListArray:
    """A list array from packed 32-bit integers."""
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))


def space_cuts(text: str) -> list[str]:
    """The text cut at spaces that have something visible behind them; all but the first cut lack
    that space. Byte-level patterns begin a new piece at each such space, so cuts can be encoded apart."""
    cuts = text.split(" ")
    if "" in cuts or not HARD_SPACE.isdisjoint(map(itemgetter(0), cuts)):
        return SOFT_CUT.split(text)
    return cuts


# Characters of the Basic Multilingual Plane that are assigned: libraries with younger tables may take others
# for letters.
KNOWN = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) not in ("Cn", "Cs"))


def _ranges(kind: str, characters: str) -> str:
    """The characters that match `kind`, as ranges within a class of the standard library."""
    points = np.array([ord(c) for c in regex.findall(kind, characters)])
    runs = np.split(points, 1 + np.flatnonzero(np.diff(points) > 1))
    return "".join(f"\\u{run[0]:04x}-\\u{run[-1]:04x}" for run in runs)


@functools.cache
def _known_pattern() -> tuple[re.Pattern, re.Pattern]:
    """The splitting pattern for texts of known characters, with its classes spelt out for the standard
    library, which matches them in half the time; and what finds any other character."""
    letter, number, space = (_ranges(kind, KNOWN) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    other = f"[^{space}{letter}{number}]"
    # Words first and without an optional space, as they are the most.
    words, marks = f" [{letter}]+|[{letter}]+", f"'(?:[stmd]|re|ve|ll)|{other}+| {other}+"
    pieces = f"{words}|{marks}| ?[{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(pieces), re.compile(f"[^{_ranges('(?s:.)', KNOWN)}]")


@functools.cache
def _any_pattern() -> regex.Pattern:
    return regex.compile(BYTE_LEVEL_PATTERN)


def has_only_known(text: str) -> bool:
    return text.isascii() or not _known_pattern()[1].search(text)


def byte_level_pieces(text: str) -> list[str]:
    """What the pattern of byte-level vocabularies cuts a text into. Each piece is encoded apart, and gives
    the same ids wherever it stands."""
    pattern = _known_pattern()[0] if has_only_known(text) else _any_pattern()
    return pattern.findall(text)
