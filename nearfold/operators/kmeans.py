"""Inner-product k-means: a fixed number of rounds, assignment by the largest inner product.

Centroids (``spaces`` x k x size numbers, bounded by parameters) are on the driver; rows never are. Each
round, every partition emits one partial sum for each centroid and dimension, and Spark adds them up. Rounds
run over rows that the executors hold: all rows of a table, or of a large one a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions.distance import matrix
from nearfold.operators.topk import balanced_shards


#: Rows that centroids are fitted on at most: so many for each centroid, and never less than the second number.
ROWS_A_CENTROID, LEAST_ROWS = 1024, 1_000_000
#: Ids that the driver sorts to find seeds; more are numbered by Spark.
IDS = 8_000_000


def training_rows(base: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """``id, vec`` of all rows, or of about ``most`` rows, chosen by a hash of the id, where there are more."""
    rows = base.select("id", "vec")
    most = max(ROWS_A_CENTROID * k, LEAST_ROWS) if most is None else most
    total = rows.count()
    if total <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 40)) < int((1 << 40) * most / total))


def stride_rows(total: int, k: int) -> list[int]:
    """Row numbers of the seeds: c * total // k, at most the last."""
    return [min(c * total // k, total - 1) for c in range(k)]


def seeds(base: DataFrame, k: int, init: str = "stride", seed: int = 42) -> np.ndarray:
    """k distinct rows as seeds: at even strides by id, or at random by a seeded hash of the id."""
    total = base.count()
    if k < 1 or k > total:
        raise ValueError(f"k must be between 1 and the {total} rows")
    if init == "stride":
        # shards of equal size start at the strides of their balanced split; pick by exact row number
        rows = _rows_at(base, stride_rows(total, k), total)
    elif init == "random":
        rows = [r["vec"] for r in base.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).select("vec").collect()]
    else:
        raise ValueError("init is 'stride' or 'random'")
    return np.array(rows, np.float64)


def _rows_at(base: DataFrame, numbers: list[int], total: int) -> list:
    """Vectors of some rows by their place in the order of ids."""
    if total <= IDS:  # 8 bytes a row
        ids = base.select("id").toArrow().column("id")
        order = np.sort(ids.to_numpy()) if not ids.null_count else np.zeros(2)
        if (order[1:] != order[:-1]).all():
            wanted = [int(i) for i in order[numbers]]
            found = {r["id"]: r["vec"] for r in base.where(F.col("id").isin(wanted)).select("id", "vec").collect()}
            return [found[i] for i in wanted]
    placed = balanced_shards(base.select("id", "vec"), total_parts := min(total, 64))
    size, extra = divmod(total, total_parts)
    starts = [i * size + min(i, extra) for i in range(total_parts)]
    wanted = F.array(*[F.lit(n) for n in numbers])
    from pyspark.sql import Window as W

    within = F.row_number().over(W.partitionBy("shard_id").orderBy("id")) - 1
    row = within + F.element_at(F.array(*[F.lit(s) for s in starts]), F.col("shard_id") + 1)
    found = {r["row"]: r["vec"] for r in placed.withColumn("row", row).where(F.array_contains(wanted, F.col("row"))).select("row", "vec").collect()}
    return [found[n] for n in numbers]


def assign_block(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the centroid with the largest inner product; the lowest of equals."""
    return np.argmax(x @ centroids.T, axis=1)


def train(base: DataFrame, k: int, iterations: int = 25, init: str = "stride", empty: str = "keep", spaces: int = 1, most: int | None = None) -> np.ndarray:
    """Centroids of each sub-space (spaces x k x size) after ``iterations`` updates, fitted on ``training_rows``.

    ``empty`` says what becomes of a centroid without rows: it keeps its place, or turns to zero.
    """
    if empty not in ("keep", "zero"):
        raise ValueError("empty is 'keep' or 'zero'")
    rows = training_rows(base, k, most).persist()
    try:
        return _fitted(rows, k, iterations, init, empty, spaces)
    finally:
        rows.unpersist()


def _fitted(base: DataFrame, k: int, iterations: int, init: str, empty: str, spaces: int) -> np.ndarray:
    first = seeds(base, k, init)
    if first.shape[1] % spaces:
        raise ValueError(f"{first.shape[1]} dimensions don't divide into {spaces} sub-spaces")
    size = first.shape[1] // spaces
    centroids = first.reshape(k, spaces, size).transpose(1, 0, 2).copy()
    for _ in range(iterations):
        centroids = _update(base, centroids, empty)
    return centroids


def _update(base: DataFrame, centroids: np.ndarray, empty: str) -> np.ndarray:
    spaces, k, size = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((spaces, k, size)), np.zeros((spaces, k), np.int64)
        for batch in batches:
            x = matrix(batch.column("vec"))
            for m in range(spaces):
                part = x[:, m * size : (m + 1) * size]
                own = assign_block(part, centroids[m])
                count[m] += np.bincount(own, minlength=k)
                for d in range(size):
                    sums[m, :, d] += np.bincount(own, part[:, d], k)
        m, c = np.nonzero(count)
        slot = np.repeat(m * k + c, size)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.tile(np.arange(size), len(m))), pa.array(sums[m, c].ravel()), pa.array(np.repeat(count[m, c], size))], ["slot", "d", "s", "n"])

    rows = base.select("vec").mapInArrow(partial, "slot long, d long, s double, n long").groupBy("slot", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    out = centroids.copy() if empty == "keep" else np.zeros_like(centroids)
    for r in rows:  # at most spaces * k * size rows
        out[r["slot"] // k, r["slot"] % k, r["d"]] = r["s"] / r["n"]
    return out


def assign(base: DataFrame, centroids: np.ndarray, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``keep`` columns, and ``codes``: the centroid of each sub-space."""
    spaces, _, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec"))
            codes = np.stack([assign_block(x[:, m * size : (m + 1) * size], centroids[m]) for m in range(spaces)], axis=1) if len(x) else np.zeros((0, spaces), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * spaces), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], [*keep, "codes"])

    schema = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in keep)
    cols = list(dict.fromkeys([*keep, "vec"]))
    return base.select(*cols).mapInArrow(run, f"{schema}, codes array<int>")
