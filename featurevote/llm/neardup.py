"""Near-duplicate groups from SetSketch registers, confirmed on full shingle sets.

A document is the set of its word shingles. Each shingle yields exponentially distributed values, one
for each register; a register keeps the smallest over the set, on a logarithmic scale with a small
base and a bounded range. Registers of a union are the larger of both, and equal registers of two
sets are about as likely as their Jaccard similarity, so bands of registers find candidates.

1. Documents with the same set form a class; only classes are compared.
2. Classes that agree in a whole band share a bucket. They are not compared pair by pair: first each
   is compared with one pivot of its bucket, in a few bands. What is then still apart although it shares
   a bucket is compared exactly, pack by pack: a class asks the packs in which its buckets lie, so that
   rows are made for classes and packs, not for pairs.
3. The joint likelihood of the registers rules out pairs far below the threshold; all others are
   confirmed by counting the intersection of the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField

from featurevote.llm.common import map_texts, text_key, written
from featurevote.llm.components import connected_components

REGISTERS = 256
ROUNDS = 6  # of the permutation of 256 registers
BAND_ROWS = 6  # 42 bands: of pairs at similarity 0.8 they miss about three in a million
BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 1
FIRST_BANDS = 16
BLOCK = 1024  # members compared at once
SIGMAS = 6.0  # how far below the threshold an estimate may be before a pair is ruled out

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8").lower().split() if text else []


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, one without words none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=_U)
    k = min(size, len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=_U, count=len(words))
    count = len(words) - k + 1
    total = np.full(count, k, dtype=_U)
    for j in range(k):
        total = _mix(total + hashes[j : j + count])
    return np.unique(total)


def _tables(shingles: np.ndarray) -> np.ndarray:
    """For each shingle and round a word that holds a random function of four bits, 16 nibbles."""
    return _mix((shingles ^ _U(0xA0761D6478BD642F))[:, None] + np.arange(ROUNDS, dtype=_U)[None, :] * _U(0xE7037ED1A0B428DB))


def _places(tables: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The registers of the j-th values: for each shingle a permutation of all registers, as a Feistel
    network on two halves of four bits."""
    low, high = (j & _U(15))[None, :], (j >> _U(4))[None, :]
    for k in range(ROUNDS):
        low, high = high ^ ((tables[:, k, None] >> (low << _U(2))) & _U(15)), low
    return (high << _U(4)) | low


def registers_of(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers. A shingle's values come in ascending order, each for another register, and
    stop as soon as no register can get smaller, so large sets need only a few values each."""
    lowest = np.full(REGISTERS, np.inf)
    alive, tables = shingles, _tables(shingles)
    reached = np.zeros(len(alive))
    done = 0
    while len(alive) and done < REGISTERS:
        levels = min(REGISTERS - done, max(1, 6 * REGISTERS // len(alive)))
        j = np.arange(done, done + levels, dtype=_U)
        draws = _mix(alive[:, None] + (j[None, :] + _U(1)) * _U(0x9E3779B97F4A7C15))
        gaps = -np.log(((draws >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
        gaps /= RATE * (REGISTERS - j.astype(np.float64))[None, :]
        values = reached[:, None] + np.cumsum(gaps, axis=1)
        np.minimum.at(lowest, _places(tables, j).ravel().astype(np.int64), values.ravel())
        done += levels
        going = values[:, -1] < lowest.max()
        alive, tables, reached = alive[going], tables[going], values[going, -1]
    with np.errstate(divide="ignore"):
        scaled = np.floor(1.0 - np.log(lowest) / math.log(BASE))
    return np.clip(scaled, 0, TOP).astype("<u2")


def band_keys(registers: np.ndarray) -> list[int]:
    """One 64-bit key for each band of registers, the band's number included."""
    raw, width = registers.tobytes(), 2 * BAND_ROWS
    bands = REGISTERS // BAND_ROWS
    return [xxhash.xxh3_64_intdigest(raw[b * width : (b + 1) * width], seed=b + 1) - (1 << 63) for b in range(bands)]


def joint_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of rows of registers, given the sizes of the sets."""
    more = (a > b).sum(axis=1)
    less = (a < b).sum(axis=1)
    same = REGISTERS - more - less
    u = n_a / (n_a + n_b)
    v = 1.0 - u

    def part(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j):
        p, q = part(u - v * j), part(v - u * j)
        tiny = 1e-300
        return more * np.log(p + tiny) + less * np.log(q + tiny) + same * np.log(np.maximum(1 - p - q, 0) + tiny)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(25):
        left, right = low + (high - low) / 3, high - (high - low) / 3
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def sketch(docs: DataFrame, shingle_words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, set_id, bands) of each document, without a shuffle."""

    def start():
        def work(texts):
            sets = [shingle_set(t, shingle_words) for t in texts]
            bands = [band_keys(registers_of(s)) if len(s) else [] for s in sets]
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string()),
                pa.array(bands, pa.list_(pa.int64())),
            ]

        return work

    fields = [
        StructField("n_shingles", LongType()),
        StructField("set_id", StringType()),
        StructField("bands", ArrayType(LongType())),
    ]
    return map_texts(docs, id_col, text_col, fields, start)


def full_sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """(cls, n_shingles, registers, shingles) of the classes (cls, text)."""

    def start():
        def work(texts):
            sets = [shingle_set(t, shingle_words) for t in texts]
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([registers_of(s).tobytes() for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
            ]

        return work

    fields = [
        StructField("n_shingles", LongType()),
        StructField("registers", BinaryType()),
        StructField("shingles", BinaryType()),
    ]
    return map_texts(texts, "cls", "text", fields, start)


def _least_estimate(percent: int) -> float:
    """Below this estimate a pair is far too unlikely to reach the threshold."""
    share = percent / 100
    return share - SIGMAS * math.sqrt(share * (1 - share) / REGISTERS)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets have 100 * intersection >= percent * union."""
    least = _least_estimate(percent)
    sized = pairs
    for side in "ab":
        own = sets.select(
            F.col("cls").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("registers").alias(f"r_{side}")
        )
        sized = sized.join(own, side)
    sized = sized.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in (4, 5))
                n_a, n_b = (np.asarray(batch.column(k), dtype=np.float64) for k in (2, 3))
                keep = pa.array(joint_similarity(a, b, n_a, n_b) >= least)
                yield batch.select([0, 1]).filter(keep)

    likely_pairs = sized.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(likely, "a long, b long")
    full = likely_pairs
    for side in "ab":
        full = full.join(sets.select(F.col("cls").alias(side), F.col("shingles").alias(f"s_{side}")), side)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(a.as_buffer(), b.as_buffer(), percent) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return written(full.select("a", "b", "s_a", "s_b").mapInArrow(exact, "a long, b long"))


def _similar(s_a: bytes, s_b: bytes, percent: int) -> bool:
    a, b = np.frombuffer(s_a, _U), np.frombuffer(s_b, _U)
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _packs(apart: DataFrame) -> DataFrame:
    """(cls, own, pack) of the classes in open buckets, about BLOCK of them in a pack. A class takes the
    name of the largest bucket around it, and classes of one name lie in few packs, so that a bucket,
    however many components it holds, meets few packs."""
    named = apart.groupBy("key").agg(F.count("*").alias("n")).select("key", F.struct("n", "key").alias("name"))
    around = apart.join(named, "key").groupBy("cls").agg(F.max("name").alias("name"))
    named = apart.join(around, "cls").groupBy("key").agg(F.max("name").alias("name"))
    around = written(apart.join(named, "key").groupBy("cls").agg(F.max("name.key").alias("name"), F.max("own").alias("own")))
    n_packs = max(int(apart.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-around.count() // BLOCK))
    parts = around.groupBy("name").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    pack = F.pmod(F.xxhash64("name", F.pmod(F.xxhash64("cls"), F.col("parts"))), F.lit(n_packs)).cast("int")
    return around.join(parts, "name").select("cls", "own", pack.alias("pack"))


def _confirm_rest(apart: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share buckets. Each class asks the packs that hold, in one
    of its buckets, a class of a larger component (on a tie, of a larger root); within a pack it is
    compared with all such classes, and gives at most one link to each component."""
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    own = F.struct(F.coalesce("size", F.lit(1)).alias("size"), "root").alias("own")
    apart = written(apart.join(sizes, "root", "left").select("key", "cls", own))
    packs = written(_packs(apart))
    met = apart.join(packs.select("cls", "pack"), "cls").groupBy("key", "pack").agg(F.max("own").alias("top"))
    asking = written(apart.join(met, "key").where("own < top").select("cls", "own", "pack").distinct())
    blocks = asking.groupBy("pack").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    payload = ["cls", "size", "root", "n_shingles", "registers", "shingles"]
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block")
    x = asking.join(blocks, "pack").select("pack", block, "cls", "own.size", "own.root").join(sets, "cls")
    x = x.select("pack", "block", *payload)
    y = packs.join(blocks, "pack").select("pack", "blocks", "cls", "own.size", "own.root").join(sets, "cls")
    y = y.select(
        F.col("pack").alias("y_pack"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y_block"),
        *[F.col(c).alias(f"y_{c}") for c in payload],
    )
    least = _least_estimate(percent)

    def compare(asked, held):
        import pandas as pd

        found = []
        if len(asked) and len(held):
            registers = np.frombuffer(b"".join(held["y_registers"]), "<u2").reshape(-1, REGISTERS)
            counts, sizes, roots = (held[f"y_{c}"].to_numpy() for c in ("n_shingles", "size", "root"))
            shingles, names = held["y_shingles"].tolist(), held["y_cls"].tolist()
            for cls, size, root, n, own, raw in zip(*(asked[c] for c in payload), strict=True):
                larger = (sizes > size) | ((sizes == size) & (roots > root))
                near = np.flatnonzero(larger & (100 * np.minimum(n, counts) >= percent * np.maximum(n, counts)))
                mine = np.frombuffer(own, "<u2")[None, :]
                # Equal registers alone estimate the similarity almost as well.
                near = near[(registers[near] == mine).mean(axis=1) >= least - 0.1]
                theirs = registers[near]
                n_theirs = counts[near].astype(np.float64)
                likely = joint_similarity(np.broadcast_to(mine, theirs.shape), theirs, np.full(len(near), float(n)), n_theirs)
                linked = set()
                for at in np.argsort(-likely, kind="stable"):
                    if likely[at] < least:
                        break
                    place = near[at]
                    if roots[place] not in linked and _similar(raw, shingles[place], percent):
                        linked.add(roots[place])
                        found.append((cls, names[place]))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    by_pack = x.groupBy("pack", "block").cogroup(y.groupBy("y_pack", "y_block"))
    return by_pack.applyInPandas(compare, "a long, b long")


def _open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, cls, root) of the buckets that still hold several components."""
    rooted = members.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select(
        "key", "cls", F.coalesce("root", "cls").alias("root")
    )
    rooted = written(rooted)
    spread = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return rooted.join(spread.select("key"), "key")


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id, kept, set_id) for every document.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; a component is
    what links reach, its id the smallest id in it, and `kept` marks the document with that id.
    A text with fewer words than a shingle is one shingle; one without words, or a missing one, has no
    shingle and is linked with nothing. Repeated ids get one row each. A missing id is never the
    smallest, unless a component has no other; its row is then kept. Other columns are left behind.

    Links below the band limit do not exist by construction: of pairs just at 0.8 similarity about
    three in a million share no band (measured on sets of 4 to 40 shingles; see README). Everything else
    is exact.
    """
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), text_key(text_col).alias("text_key")).alias("doc"), F.col(text_col).alias("text"))
    sketches = sketch(keyed, shingle_words, "doc", "text").withColumn("row", F.monotonically_increasing_id())
    sketches = written(sketches)
    # An empty set is a class of its own in each row.
    set_key = F.when(F.col("n_shingles") > 0, F.col("set_id")).otherwise(F.col("row").cast("string"))
    slim = sketches.select("doc", "row", "n_shingles", "set_id", set_key.alias("set_key"))
    classes = written(
        slim.groupBy("set_key").agg(
            F.min("row").alias("cls"), F.min("doc.id").alias("first_id"), F.min(F.struct("row", "doc")).alias("one")
        )
    )

    representatives = sketches.join(classes.select(F.col("cls").alias("row")), "row", "left_semi")
    banded = representatives.select(F.posexplode("bands").alias("band", "key"), F.col("row").alias("cls"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    members = written(banded.join(shared, "key").select("key", "band", "cls"))

    # Full sets only of the classes that share a bucket, each from one of its documents.
    wanted = classes.join(members.select("cls").distinct(), "cls").select("cls", F.col("one.doc").alias("doc"))
    sets = written(full_sets(keyed.join(wanted, "doc").select("cls", "text").dropDuplicates(["cls"]), shingle_words))

    some = members.where(F.col("band") < FIRST_BANDS)
    # Another pivot in every bucket, so that one odd class does not stand for many.
    drawn = F.min(F.struct(F.xxhash64("cls", "key").alias("draw"), "cls")).alias("pivot")
    pivots = some.groupBy("key").agg(drawn).select("key", F.col("pivot.cls").alias("pivot"))
    pairs = some.join(pivots, "key").select(F.greatest("cls", "pivot").alias("a"), F.least("cls", "pivot").alias("b"))
    links = _confirm(pairs.where("a <> b").distinct(), sets, percent)
    roots = written(connected_components(links))

    apart = _open_members(members, roots)
    last = _confirm_rest(apart, roots, sets, percent)
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = connected_components(stars.union(last))

    rooted = classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    rooted = rooted.select("set_key", "first_id", F.coalesce("root", "cls").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = rooted.join(first, "root").select("set_key", "component_id")
    return slim.join(found, "set_key").select(
        F.col("doc.id").alias(id_col),
        "n_shingles",
        "component_id",
        F.col("doc.id").eqNullSafe(F.col("component_id")).alias("kept"),
        "set_id",
    )
