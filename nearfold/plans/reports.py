"""Benchmark-report analytics over typed report rows. A ``line`` column orders rows of one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Modes of the summary, in order (fixed values).
SUMMARY_MODES = ("seq", "pthread", "openmp", "ivf_pq", "ivf_pq_pthread", "hnsw", "hnsw_pthread")
#: Mode of one platform and its counterpart on the other, in order (fixed values).
PLATFORM_MODES = (
    ("ivf_pq", "ivf_pq"), ("ivf_pq_pthread", "thread_ivf_pq"), ("ivf_pq_openmp", "openmp_ivf_pq"),
    ("hnsw", "hnsw"), ("hnsw_pthread", "thread_hnsw"), ("hnsw_openmp", "openmp_hnsw"),
)
#: Speed-ups of the write-up: (slower, faster) (fixed values).
RATIOS = (("seq", "pthread"), ("seq", "openmp"), ("ivf_pq", "ivf_pq_pthread"), ("hnsw", "hnsw_pthread"))


def last_by_mode(rows: DataFrame) -> DataFrame:
    """Of rows with one mode the last line."""
    newest = W.partitionBy("mode").orderBy(F.desc("line"))
    return rows.withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r")


def selected_summary(rows: DataFrame) -> DataFrame:
    """``position, mode, threads, recall, latency_us, total_ms, speedup_vs_seq`` of the summary modes."""
    last = last_by_mode(rows)
    order = rows.sparkSession.createDataFrame(list(enumerate(SUMMARY_MODES)), "position int, mode string")
    seq = last.where("mode = 'seq'").select(F.col("total_us").alias("seq_us"))
    out = last.join(F.broadcast(order), "mode").join(F.broadcast(seq), F.lit(True))
    return out.select("position", "mode", "threads", "recall", "latency_us", (F.col("total_us") / 1000).alias("total_ms"), (F.col("seq_us") / F.col("total_us")).alias("speedup_vs_seq"))


def variant_summary(rows: DataFrame) -> DataFrame:
    """Means of each variant with its first label, and its place by falling latency."""
    out = rows.groupBy("variant").agg(F.min_by("label", "line").alias("label"), F.avg("recall").alias("avg_recall"), F.avg("latency_us").alias("avg_latency_us"))
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc("avg_latency_us"), "variant")))


def best_threads(rows: DataFrame) -> DataFrame:
    """Fastest run of each mode of a thread sweep (the first of equals), and the mode's number of rows."""
    best = F.min_by(F.struct("threads", "total_us"), F.struct("total_us", "line"))
    return rows.groupBy("mode").agg(best.alias("b"), F.count(F.lit(1)).alias("rows")).select("mode", "b.threads", "b.total_us", "rows")


def write_up_ratios(rows: DataFrame) -> DataFrame:
    """``slower, faster, ratio`` of total times."""
    last = last_by_mode(rows).select("mode", "total_us")
    pairs = rows.sparkSession.createDataFrame(list(RATIOS), "slower string, faster string")
    a, b = last.select(F.col("mode").alias("slower"), F.col("total_us").alias("a")), last.select(F.col("mode").alias("faster"), F.col("total_us").alias("b"))
    return F.broadcast(pairs).join(a, "slower").join(b, "faster").select("slower", "faster", (F.col("a") / F.col("b")).alias("ratio"))


def trade_off(rows: DataFrame, family: str) -> DataFrame:
    """One row for each parameter value of a family: the last line."""
    newest = W.partitionBy("param_value").orderBy(F.desc("line"))
    return rows.where(F.col("family") == family).withColumn("r", F.row_number().over(newest)).where("r = 1").select("family", "param_name", "param_value", "recall", "latency_us", "total_us")


def figure_series(rows: DataFrame, x: str, y: str, modes: tuple[str, ...]) -> DataFrame:
    """``mode, xs, ys``: points of each mode by rising x."""
    points = F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))
    return rows.where(F.col("mode").isin(*modes)).groupBy("mode").agg(F.transform(points, lambda p: p["x"]).alias("xs"), F.transform(points, lambda p: p["y"]).alias("ys"))


def cross_platform(arm: DataFrame, x86: DataFrame, threads: int | None = None, mapping: tuple[tuple[str, str], ...] = PLATFORM_MODES) -> DataFrame:
    """Counterpart runs side by side. With ``threads``, the first platform's first row with that many counts."""
    if threads is not None:
        first = W.partitionBy("mode").orderBy("line")
        arm = arm.where(F.col("threads") == threads).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    pairs = arm.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(mapping)], "position int, arm_mode string, x86_mode string")
    a = last_by_mode(arm).select(F.col("mode").alias("arm_mode"), F.col("threads").alias("arm_threads"), F.col("recall").alias("arm_recall"), (F.col("total_us") / 1000).alias("arm_total_ms"))
    b = last_by_mode(x86).select(F.col("mode").alias("x86_mode"), F.col("threads").alias("x86_threads"), F.col("avg_recall").alias("x86_recall"), (F.col("total_time_us") / 1000).alias("x86_total_ms"))
    return F.broadcast(pairs).join(a, "arm_mode").join(b, "x86_mode").select("position", "arm_mode", "arm_threads", "arm_recall", "arm_total_ms", "x86_mode", "x86_threads", "x86_recall", "x86_total_ms")
