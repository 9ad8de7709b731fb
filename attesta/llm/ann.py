"""Approximate nearest neighbours by a permutation index (operator 7).

A vector is represented by the order of its ``depth`` nearest pivots. The index holds vectors in blocks, written
once: in a block every pivot has an inverted file, the places that the pivot has in the orders of the block's
vectors (``depth`` where it isn't among the nearest; with ``depth`` at half the pivots, a file of one byte a vector
is smaller than a list of postings). A query's own order opens its pivots' files only; what they add up to is the
footrule distance of the two orders (pivots missing on one side count as place ``depth``). The nearest tenth of a
block by footrule, all that tie with the last of them, and all within a small footrule radius however many they are
(so that a group of near-equal vectors isn't cut) are reranked by the exact inner product in double precision.
Per query the best of all blocks are merged.

Blocks of vectors and blocks of queries are rows, and a pair of blocks is one unit of work, so nothing depends on how
many vectors share a value or a pivot. Pivots are well-separated vectors of a bounded sample; all vectors are indexed.
Equal vectors of a block are one entry with the smallest ids that can matter.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows without an id, take no
part; vectors of another length than the query's have no inner product with it, so each length is searched by itself;
fewer candidates than ``k`` are all returned; ties go to the smaller id; rows that repeat an id are candidates each,
but never of a query with their own id; a query id that occurs in several rows is one query, the smallest of its
vectors; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship

K = 20
EVERY = 20
PIVOTS = 256
#: Vectors looked at for each pivot, and one less the cosine of directions that are the same.
SAMPLE, SAME = 16, 1e-9
#: 255 at most: places are bytes.
DEPTH = 128
#: Share of a block's entries that are reranked, and how many at least.
SHARE = 0.1
LEAST = 256
#: Entries within this share of the largest footrule distance are reranked, however many.
NEAR = 0.1
BLOCK = 4096
QUERY_BLOCK = 8192


def usable_vector(v: str) -> Column:
    """Whether a vector of doubles is neither null nor zero and holds finite components only."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(usable_vector("v"))


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """Well-separated vectors of a bounded sample, which a hash of ids and values draws without a shuffle.

    Each pivot is the one whose direction is farthest from those chosen, so a group of near-equal vectors,
    whatever its share of the rows, doesn't fill the orders.
    """
    drawn = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(SAMPLE * pivots).select("v").collect()
    if not drawn:
        return np.zeros((0, 0))
    x = np.array([r["v"] for r in drawn])
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    chosen, far = [0], 1 - unit @ unit[0]
    while len(chosen) < pivots and far.max() > SAME:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 1 - unit @ unit[chosen[-1]])
    return x[chosen]


def orders(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first. Nearness: inner product over the vector's length."""
    depth = min(depth, len(pivots))
    near = -(x @ pivots.T)
    return np.argsort(near, axis=1, kind="stable")[:, :depth].astype(np.int32)


def files(order: np.ndarray, n_pivots: int) -> np.ndarray:
    """The inverted file of each pivot: its place in the order of every vector, ``depth`` if it has none."""
    n, depth = order.shape
    out = np.full((n_pivots, n), depth, np.uint8)
    out[order.ravel(), np.repeat(np.arange(n), depth)] = np.tile(np.arange(depth, dtype=np.uint8), n)
    return out


INDEX = "ids binary, upto binary, x binary, files binary"


def _blocks(vectors: DataFrame, size: int, make, schema: str) -> DataFrame:
    """Rows of up to ``size`` vectors each, as make(ids, vectors) gives them, with a number b; written.

    Small partitions are put together first: blocks that aren't full would make more pairs of blocks.
    """
    ship(vectors.sparkSession)
    vectors = vectors.coalesce(-(-vectors.count() // size) or 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[np.ndarray] = []

        def full() -> pa.RecordBatch:
            out = make(np.array(ids, np.int64), np.array(rows))
            ids.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in out], names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            vecs = batch.column("v")
            width = len(vecs[0]) if batch.num_rows else 0
            for i, v in zip(batch.column("vec_id").to_pylist(), vecs.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), strict=True):
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    yield full()
        if ids:
            yield full()

    return materialize(vectors.mapInArrow(run, schema).withColumn("b", F.monotonically_increasing_id()))


def build_index(vectors: DataFrame, pivots: np.ndarray, depth: int = DEPTH, k: int = K) -> DataFrame:
    """The stored index of vectors of one length: blocks of distinct vectors, their ids (k + 1 smallest of each) and the pivots' files."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def make(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        by_id = np.argsort(ids, kind="stable")
        ids, x = ids[by_id], x[by_id]
        _, first, group = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        members = np.argsort(group, kind="stable")
        size = np.bincount(group)
        held = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size) <= k
        x = x[first]
        return ids[members][held], np.cumsum(np.minimum(size, k + 1)), x, files(orders(x, sent.value, depth), len(sent.value))

    return _blocks(vectors, BLOCK, make, INDEX)


class Segment:
    """A block of the index as arrays."""

    def __init__(self, ids: np.ndarray, upto: np.ndarray, x: np.ndarray, places: np.ndarray, depth: int) -> None:
        self.ids = np.split(ids, upto[:-1])
        self.x, self.places, self.depth = x.reshape(len(upto), -1), places.reshape(-1, len(upto)), depth
        self.rank = np.arange(depth, dtype=np.uint8)[:, None]
        least = depth * (depth - 1) // 2  # of equal orders
        self.near = least + NEAR * (depth * depth - least)

    def candidates(self, q: np.ndarray, want: int) -> np.ndarray:
        """The nearest ``want`` entries by footrule distance to the order ``q``, all that tie with the last, and all that are near."""
        n = len(self.x)
        if n <= want:
            return np.arange(n)
        # half of the footrule distance and a constant
        cost = np.maximum(self.places[q], self.rank).sum(axis=0, dtype=np.uint16)
        return np.flatnonzero(cost <= max(np.partition(cost, want - 1)[want - 1], self.near))

    def search(self, qid: int, qx: np.ndarray, qo: np.ndarray, k: int, share: float, least: int) -> list[tuple[int, int, float]]:
        found = self.candidates(qo, max(least, int(share * len(self.x))))
        scores = (self.x[found] * qx).sum(axis=1)
        keep = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1] if len(scores) > k + 1 else np.ones(len(scores), bool)
        rows = [(-float(s), int(i)) for c, s in zip(found[keep], scores[keep], strict=True) for i in self.ids[c] if i != qid]
        return [(qid, i, -s) for s, i in sorted(rows)[:k]]


RESULT = "query_id long, rank int, vec_id long, score double"


def _search_length(vectors: DataFrame, queries: DataFrame, k: int, pivots: int, depth: int, share: float, least: int) -> DataFrame:
    """query_id, vec_id, score: the best of each block, for vectors of one length."""
    centre = choose_pivots(vectors, pivots)
    depth, n_pivots = min(depth, len(centre)), len(centre)
    data = build_index(vectors, centre, depth, k)
    sent = vectors.sparkSession.sparkContext.broadcast(centre)
    asked = _blocks(queries, QUERY_BLOCK, lambda ids, x: (ids, x, orders(x, sent.value, depth)), "qids binary, qx binary, qo binary").withColumnRenamed("b", "qb")
    # Numbers of blocks only: a row for each pair of a block of vectors and a block of queries
    units = materialize(data.select("b").crossJoin(asked.select("qb")))
    work = units.join(data, "b").join(asked, "qb").repartition(max(1, min(units.count(), 10_000)), "b", "qb").select(*(c.split()[0] for c in INDEX.split(", ")), "qids", "qx", "qo")
    kinds = (np.int64, np.int64, np.float64, np.uint8, np.int64, np.float64, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, upto, x, places, qids, qx, qo = (np.frombuffer(c[i].as_buffer(), t) for c, t in zip(batch.columns, kinds, strict=True))
                segment = Segment(ids, upto, x, places.reshape(n_pivots, -1), depth)
                out = [r for q, v, w in zip(qids, qx.reshape(len(qids), -1), qo.reshape(len(qids), -1), strict=True) for r in segment.search(int(q), v, w, k, share, least)]
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return work.mapInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, depth: int = DEPTH, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query. Both inputs as usable() gives them."""
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = [r["n"] for r in vectors.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]
    if not lengths:
        return vectors.sparkSession.createDataFrame([], RESULT)
    of = lambda df, n: df.filter(F.size("v") == n) if len(lengths) > 1 else df
    found = reduce(DataFrame.unionByName, (_search_length(of(vectors, n), of(queries, n), k, pivots, depth, share, least) for n in lengths))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    vectors = usable(embeddings)
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
