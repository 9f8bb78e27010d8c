"""Token ids in ORC files, in ascending order of document id.

Each row holds one document: its id, its number in a file's order, and its token ids with an end
token. ORC gives integer run-length encoding of ids and lengths, stripes that tasks read apart, row
indexes (minimum and maximum of the document id for every 10,000 rows) and a Bloom filter on the
document id, so that a lookup by id skips stripes and row groups by metadata.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from featurevote.llm.bpe import byte_characters
from featurevote.llm.common import KNOWN, byte_level_pieces, has_only_known, map_texts, packed_lists, space_cuts, text_key

STRIPE_BYTES = 64 << 20
# Bytes that a worker keeps at most of cuts it has met; cuts longer than LONG are not kept.
MEMO_BYTES = 256 << 20
ENTRY_BYTES = 200
LONG = 64
# Every known character beside its neighbours, after what the pattern treats apart.
SAMPLE = "a's't're've'm'll'd'S 's 'x 12345 a1 .a  b \n c\n\n\td\r\n e" + KNOWN


class PieceMemo(dict):
    """The ids of pieces by the pieces; what is not there is asked for as it is looked up."""

    def __init__(self, ask: Callable[[str], bytes]):
        super().__init__()
        self.ask, self.held = ask, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.ask(piece)
        self.keep(piece, ids)
        return ids

    def keep(self, piece: str, ids: bytes) -> None:
        if len(piece) > LONG:
            return
        if self.held >= MEMO_BYTES:
            self.clear()
            self.held = 0
        self[piece] = ids
        self.held += len(piece) + len(ids) + ENTRY_BYTES


class LibraryEncoder:
    """Ids by the tokenizers library, asked only for cuts of a text that it has not encoded yet.

    Cuts are the pieces that the library's model encodes apart, if the library splits a sample of all known characters
    just as :func:`byte_level_pieces` does; else, and in texts with added tokens or other characters, they begin at
    spaces that have something visible behind them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = {i: len(t.content.encode()) for i, t in self.library.get_added_tokens_decoder().items()}
        # A byte-level token has one character for each of its bytes.
        sizes = {i: len(t) for t, i in self.library.get_vocab().items()} | added
        self.n_bytes = np.zeros(1 + max(sizes), dtype=np.int64)
        self.n_bytes[list(sizes)] = list(sizes.values())
        self.cuts = PieceMemo(self.ask_piece)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.characters = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.space = self.characters[ord(" ")]
        self.by_pieces = self._splits_into_pieces()

    def _splits_into_pieces(self) -> bool:
        if self.library.normalizer is not None or self.library.pre_tokenizer is None:
            return False
        found = [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(SAMPLE)]
        return found == [self._written(p) for p in byte_level_pieces(SAMPLE)]

    def _written(self, piece: str) -> str:
        """A piece as the library's model takes it: a character for each byte."""
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", self.space)
        return piece.encode().decode("latin-1").translate(self.characters)

    def ask_piece(self, piece: str) -> bytes:
        """The ids of a piece, from the library's model."""
        return array("i", [t.id for t in self.model.tokenize(self._written(piece))]).tobytes()

    def ask(self, cuts: list[str]) -> list[bytes]:
        """The ids of each cut. The library gets all cuts as one text, which costs it much less than
        many short ones; every cut begins a piece, so none of its tokens reaches over a border."""
        if not cuts:
            return []
        ids = np.array(self.library.encode_batch_fast(["".join(cuts)], add_special_tokens=False)[0].ids, dtype=np.int32)
        reached = np.concatenate([[0], np.cumsum(self.n_bytes[ids])])
        ends = np.cumsum([len(c.encode()) for c in cuts])
        places = np.searchsorted(reached, ends)
        if not np.array_equal(reached[places], ends):
            raise ValueError("a token of this vocabulary reaches over the border of two pieces")
        raw, stops = ids.tobytes(), (4 * places).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]  # noqa: B905

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        memo = self.cuts
        if self.by_pieces and has_only_known(text) and not any(map(text.__contains__, self.added)):
            return b"".join(map(memo.__getitem__, byte_level_pieces(text)))
        first, *cuts = space_cuts(text)
        cuts = [" " + c for c in cuts]
        found = list(map(memo.get, cuts))
        if None in found:
            new = list({c for c, ids in zip(cuts, found, strict=True) if ids is None})
            fresh = dict(zip(new, self.ask(new), strict=True))
            found = [fresh[c] if ids is None else ids for c, ids in zip(cuts, found, strict=True)]
            for cut, ids in fresh.items():
                memo.keep(cut, ids)
        return b"".join([*self.ask([first]), *found])


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode whole texts, end each document with `end_id`, and write them in ascending id order.

    One shuffle of the texts by ranges of the id; rows of one id are spread by a hash of their text
    and a random number, so no id can fill a task. Missing ids come first. A missing or empty text
    has the end id only. Repeated rows are all written. Other columns are left behind.
    """

    def start():
        encoder = library_encoder(tokenizer)
        end = np.int32(end_id).tobytes()
        return lambda texts: [packed_lists([encoder.encode(t) + end for t in texts])]

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = slim.withColumn("tie", text_key("text")).withColumn("spread", F.rand(5))
    ranged = ranged.repartitionByRange(*order, F.col("spread")).sortWithinPartitions(*order)
    ids = StructField("ids", ArrayType(IntegerType(), False))
    encoded = map_texts(ranged.drop("spread"), "doc_id", "text", [ids], start)
    place = encoded.select(
        "doc_id",
        F.spark_partition_id().alias("file"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"),
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
    )
    (
        place.write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", 10_000)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, row, n_tokens, ids) of the files, in tasks by stripes; filters on doc_id are pushed down."""
    return spark.read.orc(path)


def describe_token_files(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): where each document's ids stand in the sequence of all.

    Running totals are taken within each file and lifted by the totals of the files before it; totals
    come from the column of sizes alone.
    """
    schema = StructType(
        [
            tokens.schema["doc_id"],
            StructField("file", IntegerType()),
            StructField("row", LongType()),
            StructField("n_tokens", LongType()),
            StructField("ids_crc32", LongType()),
        ]
    )

    def run(batches):
        for batch in batches:
            ids = batch.column(4)
            ends = np.asarray(ids.offsets).astype(np.int64)
            raw = memoryview(np.ascontiguousarray(np.asarray(ids.values), dtype="<u4")).cast("B")
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(crcs, pa.int64())], names=schema.names
            )

    sized = tokens.select("doc_id", "file", "row", "n_tokens", "ids").mapInArrow(run, schema)
    totals = tokens.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    # One row per file.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("file_start"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("in_file", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(totals, "file").select(
        "doc_id", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32"
    )
