"""A uniform random shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in source parts of known sizes. How many rows each part sends to each shard is drawn first:
the matrix of these counts has the distribution that a uniform permutation of all rows would give, and
its row and column sums are the part sizes and the exact shard sizes. Then each part is permuted on
its own and cut by its counts, the cuts are exchanged, and each shard is permuted again.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurevote.llm.common import written

BUCKET_ROWS = 50_000
# Fixed value: the bits below the partition in monotonically_increasing_id.
PLACE_BITS = 33


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` items, taken without return from `good` and `bad` ones, are good.

    Inverts the distribution outwards from its mode, so about as many steps as its spread.
    """
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    up = down = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - up
    above = below = mode
    while left >= 0 and (above < high or below > low):
        if above < high:
            up *= (good - above) * (draws - above) / ((above + 1) * (bad - draws + above + 1))
            above += 1
            if (left := left - up) < 0:
                return above
        if below > low:
            down *= below * (bad - draws + below) / ((good - below + 1) * (draws - below + 1))
            below -= 1
            if (left := left - down) < 0:
                return below
        if up < 1e-300 and down < 1e-300:
            break
    return mode


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts by part and shard with these sums, distributed as under a uniform permutation."""
    rng = random.Random(f"communication matrix {seed}")
    free = list(shards)
    matrix = []
    for rows in parts:
        counts, left, others = [], rows, sum(free)
        for shard, room in enumerate(free):
            others -= room
            drawn = hypergeometric(rng, room, others, left)
            counts.append(drawn)
            left -= drawn
            free[shard] -= drawn
        matrix.append(counts)
    return matrix


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows and columns, with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard).

    Shard sizes differ by one row at most; every assignment of rows to places is equally likely, up to
    the quality of the hash. The parts are the input's partitions: each is permuted as it is written to
    the shared folder with the places of its rows, and all else hangs on these places and the seed, so
    lost tasks give the same rows again. Equal rows, however many, are drawn each on its own and make no
    part larger. Missing values and empty texts are values like others; columns named `shard` or `slot`
    are replaced. An empty table gives an empty one.

    Whole rows are exchanged once, into the shards' buckets of about `bucket_rows` rows; the sizes of
    parts and buckets come from the places alone. The driver holds one count for each part and shard.
    """
    spark = df.sparkSession

    def drawn(step: int):
        return F.xxhash64(F.lit(seed), F.lit(step), "place")

    # The row as one value, so that no column name can clash.
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")])
    numbered = df.select(row.alias("row"), F.monotonically_increasing_id().alias("place"))
    permuted = numbered.sortWithinPartitions(drawn(1), "place")
    # A place is the partition's number above PLACE_BITS, and below it the row's place after the sort.
    held = written(permuted.select("row", F.monotonically_increasing_id().alias("place")))
    part = F.shiftright("place", PLACE_BITS).cast("int").alias("part")
    sizes = {r["part"]: r["rows"] for r in held.groupBy(part).agg(F.count("*").alias("rows")).collect()}
    rows, parts = sum(sizes.values()), sorted(sizes)
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // bucket_rows))
    shards = [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([sizes[p] for p in parts], shards, seed)
    ends = [(p, list(accumulate(counts))) for p, counts in zip(parts, matrix, strict=True)]
    # As a table its size is known, so whole rows need no exchange to meet it while it is small.
    cuts = written(spark.createDataFrame(ends, "part int, ends array<long>"))

    def sent(rows: DataFrame) -> DataFrame:
        """Each part cut by its counts; the buckets are those that the shards are permuted in."""
        at = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
        shard = F.size(F.filter("ends", lambda end: end <= at)).alias("shard")
        bucket = F.pmod(drawn(2), F.lit(n_buckets)).cast("int").alias("bucket")
        return rows.withColumn("part", part).join(cuts, "part").select(*rows.columns, shard, bucket)

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent(held.select("place")).groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    offsets = offsets.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    again = Window.partitionBy("shard", "bucket").orderBy("order", "place")
    placed = sent(held).withColumn("order", drawn(3)).withColumn("in_bucket", F.row_number().over(again) - 1)
    return placed.join(offsets, ["shard", "bucket"]).select(
        "row.*", "shard", (F.col("offset") + F.col("in_bucket")).alias("slot")
    )
