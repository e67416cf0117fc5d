"""One index for each balanced shard: local top-k in every shard, then one merge."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.operators.graph import GraphIndex, IvfGraphIndex
from nearfold.operators.ivf import IvfIndex, IvfPqIndex
from nearfold.operators.topk import balanced_shards, merge_top_k


class Searchable(Protocol):
    """What every index handle offers."""

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame: ...


#: Index of a shard by mode, with the settings that shards usually take (fixed values).
MODES: dict[str, Callable[..., Searchable]] = {
    "ivf": partial(IvfIndex.build, nlist=128),
    "ivf_pq": partial(IvfPqIndex.build, nlist=128),
    "hnsw": partial(GraphIndex.build, shards=1),
    "ivf_hnsw": partial(IvfGraphIndex.build, nlist=16, iterations=2, m=12, ef_construction=80),
}
SETTINGS = {"ivf": {"nprobe": 32}, "ivf_pq": {"nprobe": 32, "p": 550}, "hnsw": {"ef": 64}, "ivf_hnsw": {"nprobe": 8, "ef": 64}}


@dataclass(frozen=True)
class ShardedIndex:
    """``parts`` are the shards' indexes; ``settings`` their search settings unless a search overrides them."""

    parts: tuple[Searchable, ...]
    settings: dict

    @classmethod
    def build(cls, base: DataFrame, shards: int, mode: str, **build) -> ShardedIndex:
        """``base(id, vec)`` in ``shards`` contiguous ranges of ids whose sizes differ by one at most; empty shards have no index."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {sorted(MODES)}")
        placed = balanced_shards(base.select("id", "vec"), shards).persist()  # read by every shard's training
        used = sorted(r["shard_id"] for r in placed.select("shard_id").distinct().collect())
        parts = [MODES[mode](placed.where(F.col("shard_id") == s).select("id", "vec"), **build) for s in used]
        return cls(tuple(parts), SETTINGS[mode])

    def search(self, queries: DataFrame, k: int = 10, local_k: int | None = None, **settings) -> DataFrame:
        """``qid, rank, id, dist``: the k nearest of all shards' ``local_k`` (k) nearest."""
        if not self.parts:
            return queries.sparkSession.createDataFrame([], "qid long, rank int, id long, dist double")
        return merge_top_k([part.search(queries, local_k or k, **self.settings | settings) for part in self.parts], k)
