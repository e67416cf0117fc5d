"""Exact nearest neighbours: ``base(id, vec)`` against ``queries(qid, q)``.

``engine="expr"`` joins the broadcast queries and lets codegen fold the distance; ``engine="arrow"``
multiplies Arrow blocks by the query matrix and keeps k rows of each query a partition. Queries are a
stated set: they are cut into blocks of a checked size, and every block meets all base rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.functions.distance import matrix, metric
from nearfold.operators.topk import balanced_shards, merge_top_k, top_k

#: Doubles of one block of queries, and scores that a task holds at once.
BLOCK_VALUES, SCORES = 8_000_000, 4_000_000


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the queries, in blocks of at most BLOCK_VALUES numbers; one block is on the driver at a time."""
    head = queries.select(F.size("q").alias("n")).first()
    if head is None:
        return
    rows, buffer, ids = max(1, BLOCK_VALUES // max(1, head["n"])), [], []
    for row in queries.select("qid", F.col("q").cast("array<double>").alias("q")).orderBy("qid").toLocalIterator():
        ids.append(row["qid"])
        buffer.append(row["q"])
        if len(ids) == rows:
            yield np.array(ids), _checked(buffer)
            buffer, ids = [], []
    if ids:
        yield np.array(ids), _checked(buffer)


def values_of(queries: DataFrame) -> int:
    """Numbers in all query vectors."""
    return int(queries.agg(F.coalesce(F.sum(F.size("q")), F.lit(0))).first()[0])


def by_blocks(queries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` of query sets that may be broadcast: of all queries, or block by block where they are more than one block."""
    if values_of(queries) <= BLOCK_VALUES:
        return search(queries)
    out = None
    for qids, q in query_blocks(queries):
        block = queries.sparkSession.createDataFrame(pa.table({"qid": pa.array(qids, pa.int64()), "q": pa.array(list(q), pa.list_(pa.float64()))}))
        out = search(block) if out is None else out.unionByName(search(block))
    return out


def _checked(rows: list) -> np.ndarray:
    if any(r is None or len(r) != len(rows[0]) or None in r for r in rows):
        raise ValueError("query vectors must have one length and no nulls")
    out = np.array(rows, np.float64)
    if not np.isfinite(out).all():
        raise ValueError("query vector with NaN or infinity")
    return out


def keep_nearest(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k least (dist, id), in order; ties at the k-th place are decided by id."""
    if len(dist) > k:
        edge = np.partition(dist, k - 1)[k - 1]
        rows = np.flatnonzero(dist <= edge)
    else:
        rows = np.arange(len(dist))
    return rows[np.lexsort((ids[rows], dist[rows]))[:k]]


def nearly_nearest(dist: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among the k nearest once rounding differences of a matrix product are taken away."""
    if len(dist) <= k:
        return np.arange(len(dist))
    edge = np.partition(dist, k - 1)[k - 1]
    return np.flatnonzero(dist <= edge + 1e-9 * (1 + abs(edge)))


def _scan(base: DataFrame, qids: np.ndarray, q: np.ndarray, k: int, name: str) -> DataFrame:
    """Each partition's k nearest of every query."""
    block, exact = metric(name).block, metric(name).rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in qids]
        step = max(1, SCORES // max(1, len(qids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x, ids = matrix(part.column("vec")), part.column("id").to_numpy()
                if x.shape[1] != q.shape[1]:
                    raise ValueError("base and query vectors differ in length")
                scores = block(x, q)
                for j in range(len(qids)):
                    rows = nearly_nearest(scores[:, j], k)
                    d, i = np.concatenate((best[j][0], exact(x[rows], q[j]))), np.concatenate((best[j][1], ids[rows]))
                    rows = keep_nearest(d, i, k)
                    best[j] = d[rows], i[rows]
        sizes = [len(d) for d, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, sizes)), pa.array(np.concatenate([i for _, i in best] or [np.zeros(0, np.int64)])), pa.array(np.concatenate([d for d, _ in best] or [np.zeros(0)]))], ["qid", "id", "dist"])

    return base.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "qid long, id long, dist double")


def pair_distances(base: DataFrame, queries: DataFrame, name: str = "ip") -> DataFrame:
    """``qid, id, dist`` (and base's other columns) of every query with every base row, as expressions.

    Only for a small stated query set: more than BLOCK_VALUES numbers of queries raise.
    """
    if values_of(queries) > BLOCK_VALUES:
        raise ValueError("too many queries for the expression engine; use engine='arrow'")
    pairs = base.join(F.broadcast(queries.select("qid", "q")), F.lit(True))
    return pairs.select("qid", *[c for c in base.columns if c != "vec"], metric(name).column(F.col("vec"), F.col("q")).cast("double").alias("dist"))


def flat_search(base: DataFrame, queries: DataFrame, k: int = 10, name: str = "ip", engine: str = "expr", where: Column | None = None) -> DataFrame:
    """``qid, rank, id, dist``: the exact k nearest, fewer if the base has fewer. ``where`` filters the base first."""
    if engine not in ("expr", "arrow"):
        raise ValueError("engine is 'expr' or 'arrow'")
    metric(name)
    base = base if where is None else base.where(where)
    if engine == "expr":
        return top_k(pair_distances(base.select("id", "vec"), queries, name), k)
    parts = [_scan(base, qids, q, k, name) for qids, q in query_blocks(queries)]
    if not parts:
        return base.sparkSession.createDataFrame([], "qid long, rank int, id long, dist double")
    return merge_top_k(parts, k)


def sharded_search(base: DataFrame, queries: DataFrame, shards: int = 4, k: int = 10, local_k: int | None = None, name: str = "ip") -> DataFrame:
    """Balanced shards, a local top-k in each, then one merge; equal to ``flat_search`` if ``local_k`` >= k."""
    placed = balanced_shards(base.select("id", "vec"), shards)
    local = top_k(pair_distances(placed, queries, name), local_k or k, "qid", "shard_id")
    return top_k(local.select("qid", "id", "dist"), k)


class FlatIndex:
    """Brute-force index over an immutable table: upsert, remove and search give new handles or results."""

    def __init__(self, base: DataFrame, name: str = "ip"):
        self.base, self.name = base.select("id", "vec"), name

    def upsert(self, rows: DataFrame) -> FlatIndex:
        rows = rows.select("id", "vec")
        return FlatIndex(self.base.join(rows.select("id"), "id", "left_anti").unionByName(rows), self.name)

    def remove(self, ids: DataFrame) -> FlatIndex:
        return FlatIndex(self.base.join(ids.select("id"), "id", "left_anti"), self.name)

    def search(self, queries: DataFrame, k: int = 10, where: Column | None = None, engine: str = "expr") -> DataFrame:
        return flat_search(self.base, queries, k, self.name, engine, where)

    def save(self, path: str) -> None:
        self.base.write.mode("errorifexists").parquet(f"{path}/vectors")

    @classmethod
    def load(cls, spark, path: str, name: str = "ip") -> FlatIndex:
        return cls(spark.read.parquet(f"{path}/vectors"), name)
