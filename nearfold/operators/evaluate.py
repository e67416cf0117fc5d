"""Recall and summaries of search results."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(results: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """``qid, recall``: share of the first k true ids among the results; the denominator is k. Every query
    of the truth has a row."""
    want = truth.where(F.col("rank") <= k).select("qid", "id")
    hits = want.join(results.where(F.col("rank") <= k).select("qid", "id").distinct(), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    return want.select("qid").distinct().join(hits, "qid", "left").select("qid", (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("recall"))


def mean_recall(named: dict[str, DataFrame], truth: DataFrame, k: int = 10) -> DataFrame:
    """``method, avg_recall`` of several results."""
    out = None
    for name, results in named.items():
        row = recall(results, truth, k).agg(F.avg("recall").alias("avg_recall")).select(F.lit(name).alias("method"), "avg_recall")
        out = row if out is None else out.unionByName(row)
    return out


def summary(name: str, search: Callable[[], DataFrame], truth: DataFrame, k: int = 10) -> DataFrame:
    """One row: method, mean recall, mean microseconds a query, total microseconds (batch wall clock)."""
    began = time.perf_counter()
    rows = search().select("qid", "rank", "id").collect()  # k rows a query
    took = (time.perf_counter() - began) * 1e6
    spark = truth.sparkSession
    results = spark.createDataFrame(rows, "qid long, rank int, id long")
    each = recall(results, truth, k)
    return each.agg(F.avg("recall").alias("avg_recall"), F.count(F.lit(1)).alias("queries")).select(F.lit(name).alias("mode"), "avg_recall", (F.lit(took) / F.col("queries")).alias("avg_latency_us"), F.lit(took).alias("total_time_us"))


def sweep(grid: dict[str, list], search: Callable[..., DataFrame], truth: DataFrame, k: int = 10) -> DataFrame:
    """``summary`` rows over a grid of one parameter each: (parameter, value) pairs, in order."""
    out = None
    for name, values in grid.items():
        for value in values:
            row = summary(f"{name}={value}", lambda n=name, v=value: search(**{n: v}), truth, k).withColumn("param_name", F.lit(name)).withColumn("param_value", F.lit(int(value)))
            out = row if out is None else out.unionByName(row)
    return out
