"""Ranking operators over candidates ``(qid, id, dist)``: ties always go to the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _nearest(*keys: str) -> W:
    return W.partitionBy(*keys).orderBy("dist", "id")


def top_k(candidates: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k nearest of each query with ``rank`` from 1. Spark limits each partition before the shuffle."""
    if k < 1:
        raise ValueError("k must be at least 1")
    by = keys or ("qid",)
    ranked = candidates.withColumn("rank", F.row_number().over(_nearest(*by))).where(F.col("rank") <= k)
    return ranked.select(*by, "rank", *[c for c in candidates.columns if c not in by])


def merge_top_k(parts: list[DataFrame], k: int) -> DataFrame:
    """One top-k of several partial results."""
    out = parts[0].drop("rank")
    for p in parts[1:]:
        out = out.unionByName(p.drop("rank"))
    return top_k(out, k)


def within(candidates: DataFrame, eps: float, most: int) -> DataFrame:
    """At most ``most`` neighbours of each query at distance ``eps`` or less, nearest first."""
    return top_k(candidates.where(F.col("dist") <= eps), most)


def document_prefix(candidates: DataFrame, documents: int, doc: str = "doc_id") -> DataFrame:
    """The longest distance-ordered prefix of each query that touches at most ``documents`` documents.

    It ends before the nearest row of the next document. So each document's nearest row is found first
    (one row a partition, query and document is shuffled), and only the rows of the prefix are sorted.
    """
    if documents < 1:
        raise ValueError("documents must be at least 1")
    nearest = candidates.groupBy("qid", doc).agg(F.min(F.struct("dist", "id")).alias("__at"))
    order = W.partitionBy("qid").orderBy("__at")
    edge = nearest.withColumn("__n", F.row_number().over(order)).where(F.col("__n") == documents + 1).select("qid", F.col("__at").alias("__edge"))
    # one row a query
    inside = candidates.join(edge, "qid", "left").where(F.col("__edge").isNull() | (F.struct("dist", "id") < F.col("__edge"))).drop("__edge")
    return inside.withColumn("rank", F.row_number().over(_nearest("qid")))


#: Place holders of missing neighbours in padded arrays (fixed values).
NO_ID, NO_DIST = -1, float("inf")


def padded(ranked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``qid, ids, dists``: arrays of exactly k neighbours of every query, nearest first, filled up with place holders."""
    own = ranked.where(F.col("rank") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "dist"))).alias("near"))
    full = queries.select("qid").join(own, "qid", "left")
    missing = F.lit(k) - F.coalesce(F.size("near"), F.lit(0))
    part = lambda c, fill: F.concat(F.coalesce(F.transform("near", lambda x: x[c]), F.array()), F.array_repeat(fill, missing))
    return full.select("qid", part("id", F.lit(NO_ID).cast("long")).alias("ids"), part("dist", F.lit(NO_DIST)).alias("dists"))


def unpadded(arrays: DataFrame) -> DataFrame:
    """``qid, rank, id, dist`` of padded arrays: place holders and distances that aren't finite are left out."""
    rows = arrays.select("qid", F.posexplode(F.arrays_zip("ids", "dists")).alias("at", "x")).select("qid", (F.col("at") + 1).alias("rank"), F.col("x.ids").alias("id"), F.col("x.dists").alias("dist"))
    return rows.where((F.col("id") != NO_ID) & ~F.isnan("dist") & (F.abs("dist") < NO_DIST))


def sorted_ids(ranked: DataFrame) -> DataFrame:
    """``qid, ids``: each query's neighbours as one array, nearest first."""
    pairs = F.array_sort(F.collect_list(F.struct("dist", "id")))
    return ranked.groupBy("qid").agg(F.transform(pairs, lambda p: p["id"]).alias("ids"))


def rounded(ranked: DataFrame, digits: int = 6) -> DataFrame:
    """Distances rounded for output, after ranking."""
    return ranked.withColumn("dist", F.round("dist", digits))


def balanced_shards(df: DataFrame, parts: int, order: str = "id") -> DataFrame:
    """Adds ``shard_id``: contiguous ranges by ``order`` whose sizes differ by one at most, larger ones first.

    Row numbers come from per-range counts, so no task sorts the whole table.
    """
    if parts < 1:
        raise ValueError("parts must be at least 1")
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = df.repartitionByRange(n, order).withColumn("__p", F.spark_partition_id())
    # the range partition of a row follows from its key: remember each one's key bounds
    counts = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("low")).orderBy("__p").collect()
    total = sum(r["c"] for r in counts)
    if not total:
        return df.withColumn("shard_id", F.lit(0))
    starts, at = [], 0
    for r in counts:
        starts.append((r["low"], at))
        at += r["c"]
    bounds = F.array(*[F.lit(low) for low, _ in starts])
    offsets = F.array(*[F.lit(s) for _, s in starts])
    bin_no = F.size(F.filter(bounds, lambda b: b <= F.col(order)))
    numbered = df.withColumn("__bin", bin_no).withColumn("__r", F.row_number().over(W.partitionBy("__bin").orderBy(order)) - 1 + F.element_at(offsets, F.col("__bin")))
    return numbered.withColumn("shard_id", shard_of(F.col("__r"), total, parts)).drop("__bin", "__r")


def shard_of(row: Column, total: int, parts: int) -> Column:
    """Shard of a 0-based row: the first ``total % parts`` shards hold one row more."""
    size, extra = divmod(total, parts)
    edge = extra * (size + 1)
    return F.when(row < edge, F.floor(row / (size + 1))).otherwise(extra + F.floor((row - edge) / max(1, size))).cast("int")


def shard_sizes(total: int, parts: int) -> list[tuple[int, int]]:
    """(count, displacement) of each balanced shard."""
    size, extra = divmod(total, parts)
    counts = [size + (i < extra) for i in range(parts)]
    return [(c, sum(counts[:i])) for i, c in enumerate(counts)]
