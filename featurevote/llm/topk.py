"""Exact top-k by inner product, with a ball tree per shard and branch and bound.

Vectors are dealt into shards of bounded size. Each shard holds a ball tree: nodes with a centre, a
radius and the rows below. No vector of a ball has a larger inner product with a query than
query . centre + |query| * radius, so a query visits nodes in the order of this bound and stops where
it falls below its k-th best score. That score is shared: every query is answered in its own shard
first, and all other shards start from the k-th score found there.
"""

from __future__ import annotations

import functools
import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurevote.llm.common import written

SHARD_ROWS = 4096
LEAF_ROWS = 64
# Just below 2^63, so that rounding of squared lengths cannot matter.
LARGEST_SCORE = 0.999 * 2**63


def integer_vector(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as long; missing for a vector that is missing, is empty or
    has a missing or non-finite component."""
    wide = vector.cast("array<double>")
    usable = F.forall(wide, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.when((F.size(wide) > 0) & usable, F.transform(wide, lambda x: F.floor(x * scale)))


class BallTree:
    """Rows (int64) in the order of the leaves; a node spans rows from `begin` to `end`."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray):
        order, begin, end, kids = np.arange(len(rows)), [0], [len(rows)], [-1]
        real = vectors.astype(np.float64)
        todo = [0]
        while todo:
            node = todo.pop()
            own = order[begin[node] : end[node]]
            if len(own) <= LEAF_ROWS:
                continue
            # Split at the median along the line between two far points.
            points = real[own]
            one = points[np.argmax(((points - points.mean(axis=0)) ** 2).sum(axis=1))]
            two = points[np.argmax(((points - one) ** 2).sum(axis=1))]
            along = np.argsort(points @ (two - one), kind="stable")
            order[begin[node] : end[node]] = own[along]
            middle = begin[node] + len(own) // 2
            kids[node] = len(begin)
            begin += [begin[node], middle]
            end += [middle, end[node]]
            kids += [-1, -1]
            todo += [kids[node], kids[node] + 1]
        self.rows, self.vectors = rows[order], vectors[order]
        self.begin, self.end, self.kids = np.array(begin), np.array(end), np.array(kids)
        real = real[order]
        self.centres = np.array([real[a:b].mean(axis=0) for a, b in zip(begin, end, strict=True)])
        self.radii = np.array(
            [np.sqrt(((real[a:b] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(begin, end, self.centres, strict=True)]
        )

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> BallTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as arrays:
            vars(tree).update({name: arrays[name] for name in arrays.files})
        return tree

    def search(self, query_rows, queries: np.ndarray, floors: np.ndarray, k: int) -> list[list[tuple[int, int, int]]]:
        """For each query its rows (score, place) with the k highest scores not below its floor, all
        ties of the last one included, and never its own row."""
        real = queries.astype(np.float64)
        lengths = np.sqrt((real**2).sum(axis=1))
        bounds = real @ self.centres.T + lengths[:, None] * self.radii[None, :]
        # Scores are integers. What rounding can take from a bound is far below this, as it is small beside
        # the lengths that went into the sum, also where its terms cancel out.
        reach = np.sqrt((self.centres**2).sum(axis=1)) + self.radii
        bounds += 0.5 + 1e-9 * lengths[:, None] * reach[None, :]
        found = []
        for own, query, bound, floor in zip(query_rows, queries, bounds.tolist(), floors.tolist(), strict=True):
            best: list[int] = []
            kept: list[tuple[int, int]] = []
            heap = [(-bound[0], 0)]
            while heap and -heap[0][0] >= floor:
                node = heapq.heappop(heap)[1]
                kid = int(self.kids[node])
                if kid >= 0:
                    heapq.heappush(heap, (-bound[kid], kid))
                    heapq.heappush(heap, (-bound[kid + 1], kid + 1))
                    continue
                a, b = self.begin[node], self.end[node]
                scores = self.vectors[a:b] @ query
                for at in np.flatnonzero(scores >= floor).tolist():
                    score = int(scores[at])
                    if self.rows[a + at] == own or score < floor:
                        continue
                    kept.append((score, int(a) + at))
                    heapq.heappush(best, score)
                    if len(best) > k:
                        heapq.heappop(best)
                    if len(best) == k:
                        floor = max(floor, best[0])
            found.append([x for x in kept if x[0] >= floor])
        return found


@functools.lru_cache(maxsize=2)
def _tree(raw: bytes) -> BallTree:
    return BallTree.unpack(raw)


def _pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array, dtype="<i8").tobytes()


def _unpack(raw: bytes, width: int = 1) -> np.ndarray:
    flat = np.frombuffer(raw, dtype="<i8")
    return flat.reshape(-1, width) if width > 1 else flat


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of every query row, ties to the smaller id.

    Scores are inner products of floor(scale * x). All rows but the query's own are candidates, so with
    repeated rows a query may find its copies, and repeated query ids give results each. Rows without
    an id, and vectors that are missing, empty or not finite, take no part; only vectors of one length
    are compared. With fewer candidates than k all are returned; an empty table gives no rows. Other
    columns are left behind. Raises ValueError if a vector is so long that scores need not fit a long:
    none is wrapped or rounded.

    Trees and query blocks are bounded by `shard_rows`; every block meets every shard once.
    """
    whole = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        integer_vector(F.col(vector_col), scale).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where("id IS NOT NULL AND v IS NOT NULL")
    whole = written(whole.withColumn("row", F.monotonically_increasing_id()))
    # No inner product, nor a part of its sum, is larger than the largest squared length.
    squared = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows, longest = whole.agg(F.count("*"), F.max(squared)).first()
    if longest is not None and longest >= LARGEST_SCORE:
        raise ValueError(f"inner products of up to {longest:.3g} do not fit a long: use a smaller scale than {scale}")
    n_shards = max(1, -(-rows // shard_rows))
    dealt = whole.withColumn("width", F.size("v")).withColumn(
        "shard", F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int")
    )

    def build(key, part):
        rows, ids = part["row"].to_numpy(np.int64), part["id"].to_numpy(np.int64)
        matrix = np.stack(part["v"].to_numpy()).astype(np.int64)
        tree = BallTree(rows, matrix)
        number = dict(zip(rows.tolist(), ids.tolist(), strict=True))
        asks = part["asks"].to_numpy(bool)
        import pandas as pd

        return pd.DataFrame(
            {
                "width": [key[0]],
                "shard": [key[1]],
                "tree": [tree.pack()],
                "tree_ids": [_pack(np.array([number[r] for r in tree.rows.tolist()]))],
                "query_rows": [_pack(rows[asks])],
                "query_ids": [_pack(ids[asks])],
                "queries": [_pack(matrix[asks])],
            }
        )

    blocks = written(
        dealt.groupBy("width", "shard").applyInPandas(
            build,
            "width int, shard int, tree binary, tree_ids binary, query_rows binary, query_ids binary, queries binary",
        )
    )

    def search(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asks = _unpack(row["query_rows"])
                if not len(asks):
                    continue
                queries = _unpack(row["queries"]).reshape(len(asks), row["width"])
                floors = np.full(len(asks), np.iinfo(np.int64).min) if first else _unpack(row["floors"])
                found = _tree(row["tree"]).search(asks.tolist(), queries, floors, k)
                ids = _unpack(row["tree_ids"])
                asked = _unpack(row["query_ids"]).tolist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_row": [q for q, hits in zip(asks.tolist(), found, strict=True) for _ in hits],
                        "query_id": [q for q, hits in zip(asked, found, strict=True) for _ in hits],
                        "vec_id": [int(ids[at]) for hits in found for _, at in hits],
                        "score": [score for hits in found for score, _ in hits],
                    },
                    schema=pa.schema([(c, pa.int64()) for c in ("query_row", "query_id", "vec_id", "score")]),
                )

    result = "query_row long, query_id long, vec_id long, score long"
    at_home = written(blocks.mapInArrow(lambda b: search(b, True), result))
    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    floors = (
        at_home.withColumn("rank", F.row_number().over(ranked)).where(f"rank = {k}").select("query_row", F.col("score").alias("floor"))
    )
    floors = floors.join(dealt.where("asks").select(F.col("row").alias("query_row"), "width", "shard"), "query_row", "right")
    floors = floors.groupBy("width", "shard").agg(F.map_from_entries(F.collect_list(F.struct("query_row", "floor"))).alias("known"))

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The known scores in the order of the block's queries."""
        lowest = np.iinfo(np.int64).min
        for batch in batches:
            for row in batch.to_pylist():
                known = dict(row.pop("known"))
                floors = [known.get(q) for q in _unpack(row["query_rows"]).tolist()]
                row["floors"] = _pack(np.array([lowest if f is None else f for f in floors], dtype=np.int64))
                yield pa.RecordBatch.from_pylist([row], schema=lifted)

    names = ["width", "home", "query_rows", "query_ids", "queries", "floors"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    lifted = pa.schema(list(zip(names, kinds, strict=True)))
    asking = blocks.drop("tree", "tree_ids").join(floors, ["width", "shard"]).withColumnRenamed("shard", "home")
    asking = asking.mapInArrow(
        lift, "width int, home int, query_rows binary, query_ids binary, queries binary, floors binary"
    )
    sent = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).where("shard <> home")
    elsewhere = sent.join(blocks.select("width", "shard", "tree", "tree_ids"), ["width", "shard"])
    away = elsewhere.mapInArrow(lambda b: search(b, False), result)
    return (
        at_home.union(away)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
