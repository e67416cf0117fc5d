"""A stream of queries against a static index: every micro-batch is one batch search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Append ``batch_id, qid, rank, id, dist`` to the Parquet table at ``path``.

    Each micro-batch replaces its own ``batch_id`` folder, so a batch that is run again leaves one copy.
    """

    def one(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        if held.limit(1).count():
            search(held).write.mode("overwrite").parquet(f"{path}/batch_id={number}")
        held.unpersist()

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
