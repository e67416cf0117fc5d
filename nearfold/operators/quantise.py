"""Scalar and product quantisation: parameters, codes, approximate search, and exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions.distance import inner_product, ip_distance, l2_int_distance
from nearfold.operators import kmeans
from nearfold.operators.flat import BLOCK_VALUES, by_blocks, keep_nearest, query_blocks, values_of
from nearfold.operators.topk import merge_top_k, top_k

#: Candidates (query, id) that are broadcast at most.
PAIRS = 2_000_000


def sq_parameters(base: DataFrame) -> DataFrame:
    """``d, minv, scale``: range of each dimension over all rows, in 255 steps; a range below 1e-8 counts as 1."""
    flat = base.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.min("x").cast("double").alias("minv"), F.max("x").cast("double").alias("maxv"))
    span = F.col("maxv") - F.col("minv")
    return flat.select("d", "minv", (F.when(span < 1e-8, F.lit(1.0)).otherwise(span) / 255.0).alias("scale"))


@dataclass(frozen=True)
class ScalarQuantiser:
    """Parameters (two numbers a dimension, on the driver) and ``codes(id, codes)``."""

    low: tuple[float, ...]
    scale: tuple[float, ...]
    codes: DataFrame

    @classmethod
    def build(cls, base: DataFrame) -> ScalarQuantiser:
        rows = sorted(sq_parameters(base).collect(), key=lambda r: r["d"])
        low, scale = tuple(r["minv"] for r in rows), tuple(r["scale"] for r in rows)
        return cls(low, scale, base.select("id", encode_sq(F.col("vec"), low, scale).alias("codes")))

    def parameters(self) -> tuple:
        return _numbers(self.low), _numbers(self.scale)

    def encode_queries(self, queries: DataFrame) -> DataFrame:
        """``qid, q, qs, qm``: the query times scale, and its product with the minima, once a query."""
        low, scale = self.parameters()
        q = F.transform("q", lambda x: x.cast("double"))
        return queries.select("qid", "q", F.zip_with(q, scale, lambda x, s: x * s).alias("qs"), inner_product(F.col("q"), low).alias("qm"))

    def candidates(self, queries: DataFrame) -> DataFrame:
        """Distances of one block of queries to all rows."""
        pairs = self.codes.join(F.broadcast(self.encode_queries(queries).select("qid", "qs", "qm")), F.lit(True))
        return pairs.select("qid", "id", (F.lit(1.0) - (inner_product(F.col("codes"), F.col("qs")) + F.col("qm"))).alias("dist"))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return by_blocks(queries, lambda block: top_k(self.candidates(block), k))

    def search_twice(self, base: DataFrame, queries: DataFrame, k: int = 10, p: int = 100) -> DataFrame:
        return rerank(self.search(queries, max(p, k)), base, queries, k, max(p, k))

    def search_codes(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Exact integer L2 between the codes of queries and of rows."""

        def search(block: DataFrame) -> DataFrame:
            coded = block.select("qid", encode_sq(F.col("q"), self.low, self.scale).alias("qc"))
            pairs = self.codes.join(F.broadcast(coded), F.lit(True))
            return top_k(pairs.select("qid", "id", l2_int_distance(F.col("codes"), F.col("qc")).alias("dist")), k)

        return by_blocks(queries, search)


def _numbers(values: tuple[float, ...]):
    return F.array(*[F.lit(float(v)) for v in values])


def encode_sq(v, low: tuple[float, ...], scale: tuple[float, ...]):
    """One code from 0 to 255 for each dimension (values outside the range are clamped)."""
    steps = F.zip_with(F.zip_with(v, _numbers(low), lambda x, m: x.cast("double") - m), _numbers(scale), lambda x, s: F.floor(x / s + 0.5))
    return F.transform(steps, lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("smallint"))


def rerank(approximate: DataFrame, base: DataFrame, queries: DataFrame, k: int, most: int) -> DataFrame:
    """Exact top-k of approximate candidates, at most ``most`` a query: their vectors are fetched by id.

    Candidates are broadcast, so that the base is read and not shuffled, where their number is known to be
    at most PAIRS; beyond that Spark chooses the join.
    """
    rows = queries.count()
    wanted = approximate.select("qid", "id")
    if rows * most <= PAIRS:
        wanted = F.broadcast(wanted)
    vectors = queries.select("qid", "q")
    if values_of(queries) <= BLOCK_VALUES:
        vectors = F.broadcast(vectors)
    fetched = base.select("id", "vec").join(wanted, "id").join(vectors, "qid")
    return top_k(fetched.select("qid", "id", ip_distance(F.col("vec"), F.col("q")).alias("dist")), k)


@dataclass(frozen=True)
class ProductQuantiser:
    """Codebooks (spaces x words x size, on the driver) and ``codes(id, codes)``."""

    centroids: np.ndarray
    codes: DataFrame

    @classmethod
    def build(cls, base: DataFrame, spaces: int = 8, words: int = 256, iterations: int = 25, init: str = "stride", empty: str = "keep", keep: tuple[str, ...] = ("id",)) -> ProductQuantiser:
        centroids = kmeans.train(base, words, iterations, init, empty, spaces)
        return cls(centroids, kmeans.assign(base, centroids, keep))

    def codebook(self, spark) -> DataFrame:
        """``m, code, centroid``."""
        rows = [(m, c, v.tolist()) for m, book in enumerate(self.centroids) for c, v in enumerate(book)]
        return spark.createDataFrame(rows, "m int, code int, centroid array<double>")

    def codes_by_space(self) -> DataFrame:
        """``id, m, code``: one row for each code, the column-major form."""
        return self.codes.select("id", F.posexplode("codes").alias("m", "code"))

    def lookup_table(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's sub-vectors with all words: queries x spaces x words."""
        spaces, _, size = self.centroids.shape
        return np.einsum("qmd,mkd->qmk", q.reshape(len(q), spaces, size), self.centroids)

    def search(self, queries: DataFrame, k: int = 10, codes: DataFrame | None = None, within: tuple[str, ...] = ()) -> DataFrame:
        """The k nearest by table lookups. ``codes`` may be a part of the codes; with ``within`` columns, k for each of their values."""
        source = self.codes if codes is None else codes
        parts = [self._scan(source, qids, self.lookup_table(q), k, within) for qids, q in query_blocks(queries)]
        if not parts:
            return source.sparkSession.createDataFrame([], "qid long, rank int, id long, dist double")
        return merge_top_k(parts, k) if not within else top_k(_union(parts), k, "qid", *within)

    def _scan(self, source: DataFrame, qids: np.ndarray, table: np.ndarray, k: int, within: tuple[str, ...]) -> DataFrame:
        spaces = np.arange(table.shape[1])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes, ids = np.stack(batch.column("codes").to_numpy(zero_copy_only=False)), batch.column("id").to_numpy()
                groups = list(zip(*[batch.column(c).to_pylist() for c in within], strict=True)) if within else [()] * len(ids)
                rows_of: dict[tuple, list[int]] = {}
                for i, g in enumerate(groups):
                    rows_of.setdefault(g, []).append(i)
                for j, lut in enumerate(table):
                    dist = 1.0 - lut[spaces, codes].sum(axis=1)
                    for g, rows in rows_of.items():
                        d0, i0 = best.get((j, *g), (np.zeros(0), np.zeros(0, np.int64)))
                        d, i = np.concatenate((d0, dist[rows])), np.concatenate((i0, ids[rows]))
                        kept = keep_nearest(d, i, k)
                        best[(j, *g)] = d[kept], i[kept]
            cols = {"qid": [], "id": [], "dist": [], **{c: [] for c in within}}
            for (j, *g), (d, i) in best.items():
                cols["qid"] += [int(qids[j])] * len(d)
                cols["id"] += i.tolist()
                cols["dist"] += d.tolist()
                for c, v in zip(within, g, strict=True):
                    cols[c] += [v] * len(d)
            yield pa.RecordBatch.from_pydict(cols, pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("dist", pa.float64()), *[(c, pa.int32()) for c in within]]))

        schema = "qid long, id long, dist double" + "".join(f", `{c}` int" for c in within)
        return source.select("id", "codes", *within).mapInArrow(run, schema)

    def search_twice(self, base: DataFrame, queries: DataFrame, k: int = 10, p: int = 550) -> DataFrame:
        return rerank(self.search(queries, max(p, k)), base, queries, k, max(p, k))

    def search_parts(self, base: DataFrame, queries: DataFrame, parts: DataFrame, k: int = 10, local_p: int = 550) -> DataFrame:
        """Top ``local_p`` of each part of ``parts(id, shard_id)``, all of them re-ranked exactly."""
        placed = self.codes.join(parts.select("id", "shard_id"), "id")
        shards = parts.select("shard_id").distinct().count()
        return rerank(self.search(queries, max(local_p, k), placed, ("shard_id",)), base, queries, k, shards * max(local_p, k))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
