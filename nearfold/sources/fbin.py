"""Binary vector files: two unsigned 32-bit numbers (rows, columns), then the elements row by row, little endian.

``FbinSource`` reads byte ranges of one file in parallel, from local disks and the stores Arrow can open (s3,
gs, abfs and hdfs paths among them). ``read_vectors`` takes the bytes from Spark's own binary reader, so any store Spark can
read works, but a whole file (2 GB at most) is one row of one task.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {"float32": ("<f4", "float"), "int32": ("<i4", "int"), "uint8": ("<u1", "smallint")}
HEADER = "<II"
HEADER_BYTES = struct.calcsize(HEADER)


def parse_header(head: bytes, size: int, item: int) -> tuple[int, int]:
    """Rows and columns; an empty shape or a file of another length raises."""
    if len(head) < HEADER_BYTES:
        raise ValueError("vector file is shorter than its header")
    n, d = struct.unpack(HEADER, head[:HEADER_BYTES])
    if not n or not d:
        raise ValueError("vector file has no rows or no columns")
    if size < HEADER_BYTES + n * d * item:
        raise ValueError("vector file is cut off")
    return n, d


def vector_bytes(x: np.ndarray, kind: str = "float32") -> bytes:
    """File contents of a matrix."""
    return struct.pack(HEADER, *x.shape) + np.ascontiguousarray(x, KINDS[kind][0]).tobytes()


def _opened(path: str):
    """A file for random access, by its URI or local path."""
    from pyarrow.fs import FileSystem

    store, place = FileSystem.from_uri(path if ":" in path else os.path.abspath(path))
    return store.open_input_file(place)


class _Range(InputPartition):
    def __init__(self, start: int, stop: int, width: int):
        self.start, self.stop, self.width = start, stop, width


class _FbinReader(DataSourceReader):
    def __init__(self, options: dict[str, str], column: str):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.dtype, self.column = options["path"], KINDS[options.get("kind", "float32")][0], column
        self.limit, self.rows = int(options.get("limit", "0")), int(options.get("rowsperpartition", "100000"))

    def partitions(self) -> list[_Range]:
        item = np.dtype(self.dtype).itemsize
        with _opened(self.path) as f:
            n, d = parse_header(f.read(HEADER_BYTES), f.size(), item)
        n = min(n, self.limit) if self.limit else n
        return [_Range(a, min(n, a + self.rows), d) for a in range(0, n, self.rows)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        item = np.dtype(self.dtype).itemsize
        with _opened(self.path) as f:
            for a in range(partition.start, partition.stop, 8192):
                b = min(partition.stop, a + 8192)
                flat = np.frombuffer(f.read_at((b - a) * partition.width * item, HEADER_BYTES + a * partition.width * item), self.dtype)
                values = pa.array(flat.astype(np.int16) if self.dtype == "<u1" else flat)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * partition.width), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), lists], ["id", self.column])


class FbinSource(DataSource):
    """``spark.read.format("fbin").option("kind", ...).option("limit", n).load(path)`` -> ``id, vec``."""

    @classmethod
    def name(cls) -> str:
        return "fbin"

    def schema(self) -> str:
        return f"id long, vec array<{KINDS[self.options.get('kind', 'float32')][1]}>"

    def reader(self, schema) -> DataSourceReader:
        return _FbinReader(dict(self.options), "vec")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FbinSource)


def read_vectors(spark: SparkSession, path: str, kind: str = "float32", limit: int = 0) -> DataFrame:
    """``id, vec`` of one vector file in any store; ``limit`` keeps rows with a smaller number."""
    dtype, sql = KINDS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("content"):
                data = value.as_buffer().to_pybytes()
                n, d = parse_header(data, len(data), np.dtype(dtype).itemsize)
                m = min(n, limit) if limit else n
                for a in range(0, m, 8192):
                    b = min(m, a + 8192)
                    flat = np.frombuffer(data, dtype, (b - a) * d, HEADER_BYTES + a * d * np.dtype(dtype).itemsize)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * d), pa.array(flat.astype(np.int16) if dtype == "<u1" else flat))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), lists], ["id", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"id long, vec array<{sql}>")


def read_truth(spark: SparkSession, path: str, k: int = 10) -> DataFrame:
    """``qid, rank, id`` from an int32 matrix of neighbour ids; negative padding is dropped."""
    from pyspark.sql import functions as F

    rows = read_vectors(spark, path, "int32").select(F.col("id").alias("qid"), F.posexplode("vec").alias("at", "nn"))
    return rows.where((F.col("at") < k) & (F.col("nn") >= 0)).select("qid", (F.col("at") + 1).alias("rank"), F.col("nn").cast("long").alias("id"))
