"""Exact dedup: a tree merge of sorted digest runs.

Every partition of the input sorts one run of digest entries. In each round, up to FAN_IN neighbouring
runs of a slice of the digests are merged into one, and the merged run is cut by further leading bits of
the digest, so runs keep their size while they meet in ceil(log FAN_IN of partitions) rounds and no run of
all digests ever lies in one task. An entry holds the full SHA-256, the text's length, the smallest and
largest identifier, and the counts of rows and of identifiers; only entries whose whole digests and lengths agree are joined, at every
level. A text that a third of the rows share is one entry of a run, so no round has a hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.arrowtext import raw_utf8, text_slices
from nearfold.llm.common import as_docs

#: Runs that one merge reads (a power of two: rounds are binomial in its exponent).
FAN_IN = 8
#: Entries of a run, about; the number of slices follows the table and the round.
SLICE_ENTRIES = 32_768
ENTRY = np.dtype([("digest", "<u8", 4), ("size", "<i8"), ("low", "<i8"), ("high", "<i8"), ("named", "<i8"), ("count", "<i8")])
_NO_LOW, _NO_HIGH = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    """Multiway merge of sorted runs; entries with the same whole digest and length become one."""
    run = runs[0] if len(runs) == 1 else np.concatenate(runs)
    if not len(run):
        return run
    run = run[np.argsort(run["digest"][:, 0], kind="stable")]
    same = run["digest"][1:, 0] == run["digest"][:-1, 0]
    if (same & (run["digest"][1:] != run["digest"][:-1]).any(axis=1)).any():  # first words alone agree
        d = run["digest"]
        run = run[np.lexsort((run["size"], d[:, 3], d[:, 2], d[:, 1], d[:, 0]))]
    verified = (run["digest"][1:] == run["digest"][:-1]).all(axis=1) & (run["size"][1:] == run["size"][:-1])
    first = np.flatnonzero(np.concatenate(([True], ~verified)))
    out = run[first].copy()
    out["low"] = np.minimum.reduceat(run["low"], first)
    out["high"] = np.maximum.reduceat(run["high"], first)
    for c in ("named", "count"):
        out[c] = np.add.reduceat(run[c], first)
    return out


def _sliced(run: np.ndarray, bits: int, node: int) -> pa.Table:
    """A sorted run cut by the digest's leading bits: slices are stretches of it."""
    where = (run["digest"][:, 0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(run), np.int64)
    used, at = np.unique(where, return_index=True)
    parts = np.split(run, at[1:])
    return pa.table({"slice": pa.array(used), "node": pa.array([node] * len(used), pa.int64()), "run": pa.array([p.tobytes() for p in parts], pa.binary())})


def _leaf(bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs = []
        for rows, text in text_slices(batches):
            body, off = raw_utf8(text)
            view = memoryview(np.ascontiguousarray(body)).cast("B") if len(body) else memoryview(b"")
            run = np.zeros(len(text), ENTRY)
            run["digest"] = np.frombuffer(b"".join([hashlib.sha256(view[a:b]).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]), ">u8").reshape(-1, 4)
            run["size"], run["count"] = np.diff(off), 1
            ids = rows.column("doc_id")
            run["low"] = pc.fill_null(ids, pa.scalar(_NO_LOW, pa.int64())).to_numpy()
            run["high"] = pc.fill_null(ids, pa.scalar(_NO_HIGH, pa.int64())).to_numpy()
            run["named"] = ids.is_valid().to_numpy(zero_copy_only=False)
            runs.append(merge_runs([run]))
        if runs:
            yield from _sliced(merge_runs(runs), bits, TaskContext.get().partitionId()).to_batches()

    return build


def _merge(bits: int):
    def merge(table: pa.Table) -> pa.Table:
        runs = [np.frombuffer(x.as_buffer(), ENTRY) for x in table.column("run")]
        return _sliced(merge_runs(runs), bits, table.column("node")[0].as_py())

    return merge


def slice_bits(rows: int, nodes: int) -> list[int]:
    """Leading bits that cut the leaves and each round's runs, for about SLICE_ENTRIES entries a run."""
    need = lambda entries: max(0, int(entries // SLICE_ENTRIES).bit_length())
    bits = [need(-(-rows // max(1, nodes)))]
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        bits.append(max(bits[-1], min(bits[-1] + FAN_IN.bit_length() - 1, need(-(-rows // nodes)))))
    return bits


def digest_runs(docs: DataFrame) -> DataFrame:
    """``slice, node, run``: one finished run for each non-empty slice of the digests."""
    seen = docs.select(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("last")).first()
    bits = slice_bits(seen["n"], (seen["last"] or 0) + 1)
    runs = docs.mapInArrow(_leaf(bits[0]), "slice long, node long, run binary")
    for k, more in enumerate(bits[1:], 2):
        # the last round takes whatever nodes are left
        node = F.shiftright("node", FAN_IN.bit_length() - 1) if k < len(bits) else F.lit(0).cast("long")
        runs = runs.withColumn("node", node).groupBy("slice", "node").applyInArrow(_merge(more), "slice long, node long, run binary")
    return runs


def copies(runs: DataFrame) -> DataFrame:
    """``text_sha256, low_id, high_id, group_size`` of texts that occur more than once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("run"):
                run = np.frombuffer(x.as_buffer(), ENTRY)
                run = run[run["count"] > 1]
                hexes = [d.tobytes().hex() for d in run["digest"].astype(">u8")]
                ids = [pa.array(run[k], mask=run["named"] == 0) for k in ("low", "high")]
                yield pa.RecordBatch.from_arrays([pa.array(hexes, pa.string()), *ids, pa.array(run["count"])], ["text_sha256", "low_id", "high_id", "group_size"])

    return runs.mapInArrow(rows, "text_sha256 string, low_id long, high_id long, group_size long")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest
    (or, with keep="smallest", the smallest) id stays. Rows that repeat an id and a text stay or go
    together. A null id is never chosen while its group has another. An empty table gives no rows.
    """
    docs = as_docs(df, id_col, text_col)
    groups = copies(digest_runs(docs)).select("text_sha256", F.col("high_id" if keep == "largest" else "low_id").alias("__keep"), F.col("group_size").alias("__size"))
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    joined = rows.join(groups, "text_sha256", "left")
    keep_id = F.coalesce("__keep", "doc_id")
    return joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("__size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")
