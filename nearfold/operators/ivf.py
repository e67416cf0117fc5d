"""Inverted-file search: rows are assigned to centroids; a query reads the lists of its nearest centroids."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nearfold.functions.distance import inner_product, ip_distance, subvector
from nearfold.operators import kmeans
from nearfold.operators.flat import by_blocks
from nearfold.operators.quantise import ProductQuantiser, rerank
from nearfold.operators.topk import top_k


@dataclass(frozen=True)
class IvfIndex:
    """Centroids (on the driver) and ``rows(id, vec, cid)``."""

    centroids: np.ndarray
    rows: DataFrame

    @classmethod
    def build(cls, base: DataFrame, nlist: int = 1024, iterations: int = 25, init: str = "stride", empty: str = "keep") -> IvfIndex:
        centroids = kmeans.train(base, nlist, iterations, init, empty)
        rows = kmeans.assign(base, centroids, ("id", "vec")).select("id", "vec", F.col("codes")[0].alias("cid"))
        return cls(centroids[0], rows)

    @property
    def nlist(self) -> int:
        return len(self.centroids)

    def centroid_table(self) -> DataFrame:
        spark = self.rows.sparkSession
        return spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(self.centroids)], "cid int, centroid array<double>")

    def assignments(self) -> DataFrame:
        return self.rows.select("id", "cid")

    def list_sizes(self) -> DataFrame:
        """``cid, len`` of all lists, empty ones too."""
        counts = self.rows.groupBy("cid").agg(F.count(F.lit(1)).alias("len"))
        return self.centroid_table().select("cid").join(counts, "cid", "left").select("cid", F.coalesce("len", F.lit(0)).cast("long").alias("len"))

    def list_stats(self) -> DataFrame:
        """One row: lists, non-empty ones, rows, mean length over all lists, largest and smallest, smallest non-empty."""
        n = F.col("len")
        return self.list_sizes().agg(
            F.count(F.lit(1)).alias("nlist"), F.count(F.when(n > 0, 1)).alias("non_empty"), F.sum(n).alias("total"), F.avg(n).alias("avg_len"),
            F.max(n).alias("max_len"), F.min(n).alias("min_len"), F.min(F.when(n > 0, n)).alias("min_non_empty"),
        )

    def csr(self) -> DataFrame:
        """``cid, offset, len, ids``: lists laid end to end. A list longer than a task's memory should stay in ``rows``."""
        sizes = self.list_sizes()
        before = F.sum("len").over(W.partitionBy(F.col("cid") >= 0).orderBy("cid").rowsBetween(W.unboundedPreceding, -1))
        lists = self.rows.groupBy("cid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        return sizes.select("cid", F.coalesce(before, F.lit(0)).cast("long").alias("offset"), "len").join(lists, "cid", "left").select("cid", "offset", "len", F.coalesce("ids", F.array().cast("array<long>")).alias("ids"))

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """``qid, q, cid``: each query's nprobe nearest lists (largest inner product, lowest number of equals)."""
        if not 1 <= nprobe <= self.nlist:
            raise ValueError(f"nprobe must be between 1 and {self.nlist}")
        pairs = queries.select("qid", "q").join(F.broadcast(self.centroid_table()), F.lit(True))
        order = W.partitionBy("qid").orderBy(F.desc(inner_product(F.col("centroid"), F.col("q"))), "cid")
        return pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= nprobe).select("qid", "q", "cid")

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 64) -> DataFrame:
        """The k nearest in the probed lists: an equi-join on the list, which Spark splits where a list is hot."""
        found = self.rows.join(self.probes(queries, nprobe), "cid")
        return top_k(found.select("qid", "id", ip_distance(F.col("vec"), F.col("q")).alias("dist")), k)

    def search_masked(self, queries: DataFrame, k: int = 10, nprobe: int = 64) -> DataFrame:
        """Same rows by the wasteful plan: every query against every row of all lists, masked. A baseline only."""

        def search(block: DataFrame) -> DataFrame:
            probes = self.probes(block, nprobe)
            pairs = self.rows.join(F.broadcast(block.select("qid", "q")), F.lit(True)).join(F.broadcast(probes.select("qid", "cid")), ["qid", "cid"], "left_semi")
            return top_k(pairs.select("qid", "id", ip_distance(F.col("vec"), F.col("q")).alias("dist")), k)

        return by_blocks(queries, search)

    def work_counters(self, queries: DataFrame, nprobe: int, batch: int) -> DataFrame:
        """One row for each mode: batches, refined groups, refined pairs, and skipped pairs of batched execution."""
        if batch < 1:
            raise ValueError("batch must be at least 1")
        numbered = queries.select("qid", F.floor(F.col("qid") / batch).cast("long").alias("b"))
        sizes = numbered.groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
        active = self.probes(queries, nprobe).join(numbered, "qid").groupBy("b", "cid").agg(F.count(F.lit(1)).alias("nq"))
        work = active.join(self.list_sizes(), "cid").where(F.col("len") > 0).join(sizes, "b")
        pairs = {"grouped": (F.col("nq") * F.col("len"), F.lit(0)), "wasteful": (F.col("nb") * F.col("len"), (F.col("nb") - F.col("nq")) * F.col("len"))}
        out = None
        for mode, (done, skipped) in pairs.items():
            row = work.agg(F.countDistinct("b").alias("batches"), F.count(F.lit(1)).alias("refine_groups"), F.sum(done).alias("refine_pairs"), F.sum(skipped).cast("long").alias("skipped_pairs"))
            row = row.select(F.lit(mode).alias("mode"), "*")
            out = row if out is None else out.unionByName(row)
        return out

    def upsert(self, rows: DataFrame) -> IvfIndex:
        """Insert or replace rows; the centroids stay."""
        kind = self.rows.schema["vec"].dataType
        rows = rows.select("id", F.col("vec").cast(kind).alias("vec"))
        placed = kmeans.assign(rows, self.centroids[None], ("id", "vec")).select("id", "vec", F.col("codes")[0].alias("cid"))
        return IvfIndex(self.centroids, self.remove(rows).rows.unionByName(placed))

    def remove(self, ids: DataFrame) -> IvfIndex:
        return IvfIndex(self.centroids, self.rows.join(ids.select("id"), "id", "left_anti").select("id", "vec", "cid"))

    def save(self, path: str) -> None:
        """Rows partitioned by list, so that probes prune files; centroids beside them."""
        self.centroid_table().write.mode("errorifexists").parquet(f"{path}/centroids")
        self.rows.write.mode("errorifexists").partitionBy("cid").parquet(f"{path}/rows")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["cid"])
        if not rows or [r["cid"] for r in rows] != list(range(len(rows))):
            raise ValueError("index is damaged: its centroids aren't complete")
        return cls(np.array([r["centroid"] for r in rows]), spark.read.parquet(f"{path}/rows").withColumn("cid", F.col("cid").cast("int")))


@dataclass(frozen=True)
class IvfPqIndex:
    """Inverted lists with product codes of the raw vectors: probe, look up, re-rank exactly."""

    ivf: IvfIndex
    pq: ProductQuantiser

    @classmethod
    def build(cls, base: DataFrame, nlist: int = 1024, spaces: int = 8, words: int = 256, iterations: int = 25, init: str = "stride", empty: str = "keep", pq_iterations: int | None = None) -> IvfPqIndex:
        ivf = IvfIndex.build(base, nlist, iterations, init, empty)
        return cls(ivf, ProductQuantiser.build(ivf.rows, spaces, words, pq_iterations or iterations, init, empty, ("id", "cid")))

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 64, p: int = 550) -> DataFrame:
        spark = self.ivf.rows.sparkSession
        centroids = self.pq.centroids
        spaces, _, size = centroids.shape
        book = spark.createDataFrame([(m, book.tolist()) for m, book in enumerate(centroids)], "m int, words array<array<double>>")
        table = queries.select("qid", "q").join(F.broadcast(book), F.lit(True)).select("qid", "m", F.transform("words", lambda w: inner_product(w, subvector(F.col("q"), F.col("m"), size))).alias("lut"))
        tables = table.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "lut"))), lambda x: x["lut"]).alias("luts"))
        probes = self.ivf.probes(queries, nprobe).select("qid", "cid").join(tables, "qid")
        found = self.pq.codes.join(probes, "cid")
        total = F.aggregate(F.zip_with("codes", "luts", lambda c, lut: F.get(lut, c)), F.lit(0.0), lambda s, x: s + x)
        near = top_k(found.select("qid", "id", (F.lit(1.0) - total).alias("dist")), max(p, k))
        return rerank(near, self.ivf.rows, queries, k, max(p, k))
