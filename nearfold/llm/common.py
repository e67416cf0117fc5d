"""Session helpers of the text operators: shared scratch tables, sizes, and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nearfold.functions.scratch import discard, saved, shared_dir


def as_docs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the named columns, under fixed names, so that extra columns can't clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`") for c in more])


def text_volume(docs: DataFrame) -> tuple[int, int]:
    """Rows and UTF-8 bytes of ``docs``: one scan inside the JVM."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return int(n), int(size)


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs inside send at most so many rows at once to a Python worker: for rows that are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def prefix_sums(df: DataFrame, keys: list[str], order: str, values: dict[str, str], block: int, descending: bool = False) -> DataFrame:
    """Exclusive running sums of ``values`` (new name -> column) over the integer column ``order``, per ``keys``.

    Two levels: totals of blocks of ``block`` consecutive order values, running sums of those, then running
    sums inside each block. No task holds more than one block's rows or one row per block of a key.
    """
    blocks = df.withColumn("__b", F.floor(F.col(order) / F.lit(block)).cast("long"))
    by = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    totals = blocks.groupBy(*keys, "__b").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in values.items()])
    over = W.partitionBy(*[F.col(k) for k in keys], (F.col("__b") >= 0)).orderBy(by("__b"))
    totals = totals.select(*keys, "__b", *[before(over, f"__t_{n}").alias(f"__p_{n}") for n in values])
    inside = W.partitionBy(*keys, "__b").orderBy(by(order))
    own = blocks.select("*", *[before(inside, c).alias(f"__o_{n}") for n, c in values.items()])
    joined = own.join(totals, [*keys, "__b"])
    return joined.select(*df.columns, *[(F.col(f"__p_{n}") + F.col(f"__o_{n}")).alias(n) for n in values])


__all__ = ["as_docs", "discard", "prefix_sums", "rows_a_batch", "saved", "shared_dir", "shuffle_parts", "text_volume"]
