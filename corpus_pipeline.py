"""A training-data pipeline over ``documents``: language ID, exact dedup, near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm import exact_dedup, language_id, near_dedup, packing, suffix_dedup
from nearfold.llm.common import as_docs, saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is not too far from every learned language's centroids.

    Null texts and texts without a letter go. Repeated rows are judged one by one, null ids stay, an empty
    table (or one without labels) leaves an empty one; columns beyond those of documents are dropped.
    """
    own = as_docs(docs, "doc_id", "text", *COLUMNS[2:])
    model = language_id.fit(own, language_id.training_rows())
    return language_id.identify(own, model, COLUMNS[1:]).where(~F.col("rejected")).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id.

    Null counts as empty, so one empty text stays. A row goes only with its own text: rows of one id with
    other texts stay, rows that repeat an id and a text stay or go together, a null id goes where its text has an id.
    """
    docs = docs.select(*COLUMNS)
    verdicts = exact_dedup.exact_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("__sha"))
    return docs.join(verdicts, same, "left_anti")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest id.

    Documents without words stay. Where ids repeat or are null, rows are told apart by a number that
    ascends with the ids (null ids last), so that every row is judged by its own text.
    """
    docs = docs.select(*COLUMNS)
    count = docs.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    key = "doc_id"
    if count["rows"] != count["ids"]:
        key = "__row"
        docs = saved(docs.orderBy(F.asc_nulls_last("doc_id"), "text").withColumn(key, F.monotonically_increasing_id()), "numbered")
    gone = near_dedup.near_duplicates(docs, key).where(~F.col("kept")).select(F.col("doc_id").alias(key))
    return docs.join(gone, key, "left_anti").select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 50-byte strings that documents with smaller ids hold.

    Null texts stay null, a character that loses a byte goes whole, ``n_chars`` follows the text that is
    left. Rows of one id don't affect each other; a null id is above all others.
    """
    left = suffix_dedup.remove_repeats(docs, more=COLUMNS[2:], with_text=True)
    text = F.col("kept_text")
    return left.select("doc_id", text.alias("text"), "lang", "source", F.when(text.isNull(), F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in token windows; null and empty texts are an end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]

#: The stages learn models, tokenise and hash; SQL can't express them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
