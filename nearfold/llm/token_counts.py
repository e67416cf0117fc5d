"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.arrowtext import text_slices
from nearfold.llm.common import as_docs, prefix_sums, saved
from nearfold.llm.tokens import encoder, vocabulary

VOCABULARY = "byte_bpe_50k.json"
#: Lengths per block of the two-level suffix sums.
BLOCK = 256


def token_lengths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of whole texts (no special tokens). Null and empty texts have 0 tokens; repeated
    rows stay; an empty table gives no rows."""
    path = vocabulary(VOCABULARY, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for rows, text in text_slices(batches, keep=True):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(encode.lengths_of(text))], ["doc_id", "n_tokens"])

    return as_docs(df, id_col, text_col).mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per distinct length (and ``keys``), with suffix sums:

    ``n_docs`` documents of this length; ``docs_longer``/``tokens_longer`` over strictly longer ones;
    ``total_docs``/``total_tokens`` of all; ``kept_tokens`` = tokens left when every document is truncated
    to this many; ``rank_from`` = documents that are shorter. Distinct lengths are at most the square root of twice all
    tokens, and the suffix sums are taken in blocks, so no task holds them all.
    """
    by = list(keys)
    hist = lengths.groupBy(*by, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("__tokens", F.col("n_docs") * F.col("n_tokens"))
    hist = saved(hist, "length-histogram")  # read three times below; the texts are encoded once
    out = prefix_sums(hist, by, "n_tokens", {"docs_longer": "n_docs", "tokens_longer": "__tokens"}, BLOCK, descending=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("n_docs", "total_docs"), ("__tokens", "total_tokens"))]
    if by:
        out = out.join(hist.groupBy(*by).agg(*sums), by)
    else:
        total = hist.agg(*sums).first()
        out = out.select("*", *[F.lit(total[n]).cast("long").alias(n) for n in ("total_docs", "total_tokens")])
    return out.select(
        *by, "n_tokens", "n_docs", "docs_longer", "tokens_longer", "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("kept_tokens"),
        (F.col("total_docs") - F.col("docs_longer") - F.col("n_docs")).alias("rank_from"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: documents, tokens left by a context limit, and documents that it cuts; from the histogram alone."""
    n, cut = F.col("n_docs"), F.col("n_tokens") > limit
    return histogram.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum(n * F.least(F.col("n_tokens"), F.lit(limit))), F.lit(0)).alias("kept_tokens"),
        F.coalesce(F.sum(F.when(cut, n).otherwise(0)), F.lit(0)).alias("cut_docs"),
    )


def length_quantiles(histogram: DataFrame, qs: tuple[float, ...]) -> DataFrame:
    """``q, n_tokens``: the smallest length with at least ``q`` of the documents at or below it (q in (0, 1])."""
    spark = histogram.sparkSession
    points = spark.createDataFrame([(float(q),) for q in qs], "q double")
    rank = F.greatest(F.lit(1.0), F.ceil(F.round(F.col("q") * F.col("total_docs"), 9)))
    at = (F.col("rank_from") < rank) & (rank <= F.col("rank_from") + F.col("n_docs"))
    return histogram.join(F.broadcast(points), at).select("q", "n_tokens")
