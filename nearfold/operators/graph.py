"""Layered proximity graphs (HNSW): built shard by shard inside Arrow groups, searched by beams.

One row holds one node: ``shard_id, id, level, entry, deleted, vec, links`` (links by layer). A shard's
graph must fit a worker, so the number of shards follows the table unless it is given. Levels are a function
of the id alone, so a graph doesn't depend on how rows are partitioned.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nearfold.functions.distance import matrix
from nearfold.operators.flat import BLOCK_VALUES, values_of
from nearfold.operators.ivf import IvfIndex
from nearfold.operators.stops import Documents, StopCondition, WithinDistance
from nearfold.operators.topk import balanced_shards, document_prefix, top_k, within

#: Rows of a shard at most, where the number of shards isn't given.
SHARD_ROWS = 50_000
NODES = "shard_id int, id long, level int, entry boolean, deleted boolean, vec array<double>, links array<array<long>>"


def level_of(label: int, m: int) -> int:
    """Exponentially distributed level from a hash of the label."""
    h = (label + 0x9E3779B97F4A7C15) & (1 << 64) - 1
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = ((h ^ (h >> 30)) * factor) & (1 << 64) - 1
    h ^= h >> 31
    return int(-math.log((h + 0.5) / 2**64) / math.log(max(2, m)))


class Graph:
    """One shard's graph. Distances are 1 less the inner product; ties go to the earlier node."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, m: int = 16, ef_construction: int = 150):
        self.x, self.labels, self.m, self.ef = x, labels, m, max(ef_construction, m)
        self.levels = [level_of(int(i), m) for i in labels]
        self.links: list[list[list[int]]] = [[[] for _ in range(v + 1)] for v in self.levels]
        self.deleted = np.zeros(len(x), bool)
        self.entry = -1
        self.hops = self.distances = 0
        for node in range(len(x)):
            self._insert(node)
        self._connect()

    @classmethod
    def restore(cls, table: pa.Table) -> Graph:
        """From stored node rows."""
        g = cls.__new__(cls)
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        g.x, g.labels = matrix(table.column("vec")), table.column("id").to_numpy()
        g.levels, g.deleted = table.column("level").to_pylist(), table.column("deleted").to_numpy()
        place = {int(i): n for n, i in enumerate(g.labels)}
        g.links = [[[place[i] for i in layer] for layer in layers] for layers in table.column("links").to_pylist()]
        g.entry = table.column("entry").to_pylist().index(True) if table.num_rows else -1
        g.hops = g.distances = 0
        return g

    def _far(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        self.distances += len(nodes)
        return 1.0 - np.einsum("ij,j->i", self.x[nodes], q)  # equal vectors are at equal distance

    def _descend(self, q: np.ndarray, top: int, bottom: int, start: int) -> int:
        """Greedy walk from layer ``top`` down to above ``bottom``."""
        best, dist = start, float(self._far(q, [start])[0])
        for layer in range(top, bottom, -1):
            moved = True
            while moved:
                moved = False
                self.hops += 1
                near = self.links[best][layer]
                if near:
                    d = self._far(q, near)
                    i = int(np.argmin(d))
                    if d[i] < dist:
                        best, dist, moved = near[i], float(d[i]), True
        return best

    def _beam(self, q: np.ndarray, start: int, ef: int, layer: int, admitted: np.ndarray | None = None) -> list[tuple[float, int]]:
        """Up to ``ef`` nearest nodes, sorted; nodes that aren't admitted route but don't enter the result."""
        d = float(self._far(q, [start])[0])
        seen = np.zeros(len(self.x), bool)
        seen[start] = True
        open_, found = [(d, start)], []
        if admitted is None or admitted[start]:
            found.append((-d, -start))
        while open_:
            d, node = heapq.heappop(open_)
            if len(found) >= ef and d > -found[0][0]:
                break
            self.hops += 1
            fresh = [n for n in self.links[node][layer] if not seen[n]]
            if not fresh:
                continue
            seen[fresh] = True
            for dist, n in zip(self._far(q, fresh).tolist(), fresh, strict=True):
                if len(found) < ef or dist < -found[0][0]:
                    heapq.heappush(open_, (dist, n))
                    if admitted is None or admitted[n]:
                        heapq.heappush(found, (-dist, -n))
                        if len(found) > ef:
                            heapq.heappop(found)
        return sorted((-a, -b) for a, b in found)

    def _walk(self, q: np.ndarray, start: int, stop: StopCondition, admitted: np.ndarray | None) -> list[tuple[float, int]]:
        """Nodes of layer 0 that a stop condition gathers, sorted."""
        d = float(self._far(q, [start])[0])
        seen = np.zeros(len(self.x), bool)
        seen[start] = True
        open_, found = [(d, start)], []
        worst = lambda: -found[0][0] if found else math.inf
        if admitted is None or admitted[start]:
            found.append((-d, -start))
            stop.entered(start, d)
        while open_:
            d, node = heapq.heappop(open_)
            if stop.ends(d, worst()):
                break
            self.hops += 1
            fresh = [n for n in self.links[node][0] if not seen[n]]
            if not fresh:
                continue
            seen[fresh] = True
            for dist, n in zip(self._far(q, fresh).tolist(), fresh, strict=True):
                if not stop.takes(dist, worst()):
                    continue
                heapq.heappush(open_, (dist, n))
                if admitted is None or admitted[n]:
                    heapq.heappush(found, (-dist, -n))
                    stop.entered(n, dist)
                    while stop.overfull():
                        gone = heapq.heappop(found)
                        stop.left(-gone[1], -gone[0])
        return stop.result(sorted((-a, -b) for a, b in found))

    def _diverse(self, candidates: list[tuple[float, int]], most: int) -> list[int]:
        """Candidates that are nearer to the node than to every one kept before."""
        if len(candidates) < most:
            return [n for _, n in candidates]
        x = self.x[[n for _, n in candidates]]
        nearest = np.full(len(x), np.inf)  # distance to the nearest kept one
        kept: list[int] = []
        for i, (dist, n) in enumerate(candidates):
            if nearest[i] < dist:
                continue
            kept.append(n)
            if len(kept) == most:
                break
            np.minimum(nearest, 1.0 - np.einsum("ij,j->i", x, x[i]), out=nearest)
        return kept

    def _insert(self, node: int) -> None:
        level = self.levels[node]
        if self.entry < 0:
            self.entry = node
            return
        top = self.levels[self.entry]
        q = self.x[node]
        start = self._descend(q, top, min(level, top), self.entry)
        for layer in range(min(level, top), -1, -1):
            near = self._beam(q, start, self.ef, layer)
            self.links[node][layer] = self._diverse(near, self.m)
            room = 2 * self.m if layer == 0 else self.m
            for n in self.links[node][layer]:
                back = self.links[n][layer]
                if len(back) < room:
                    back.append(node)
                else:
                    pool = [*back, node]
                    self.links[n][layer] = self._diverse(sorted(zip(self._far(self.x[n], pool).tolist(), pool, strict=True)), room)
            start = near[0][1]
        if level > top:
            self.entry = node

    def _reached(self, links: list[list[int]], start: int, seen: np.ndarray) -> None:
        """Marks what ``links`` lead to from ``start``."""
        seen[start], open_ = True, [start]
        while open_:
            for n in links[open_.pop()]:
                if not seen[n]:
                    seen[n] = True
                    open_.append(n)

    def _connect(self) -> None:
        """On layer 0, makes every node lead to the entry and the entry to every node, so that a beam as wide as the
        shard finds all nodes from any start. The pruning of links alone cuts off clumps of near copies.

        A new link joins the nearest nodes that can take it. Nodes keep their room: where all nodes of a closed clump
        are full, one gives up its farthest link, and what that cuts off is linked again in the second pass.
        """
        n, room = len(self.x), 2 * self.m
        if not n:
            return
        out = [layers[0] for layers in self.links]
        into: list[list[int]] = [[] for _ in range(n)]
        for node, near in enumerate(out):
            for other in near:
                into[other].append(node)
        home = np.zeros(n, bool)
        self._reached(into, self.entry, home)
        while not home.all():
            lost = np.flatnonzero(~home).tolist()
            node = next((i for i in lost if len(out[i]) < room), lost[0])
            if len(out[node]) >= room:
                out[node].pop(int(np.argmax(self._far(self.x[node], out[node]))))
            out[node].append(self._nearest(node, np.flatnonzero(home)))
            self._reached(into, node, home)
        found = np.zeros(n, bool)
        self._reached(out, self.entry, found)
        free = np.array([len(near) < room for near in out])
        for node in range(n):
            if not found[node]:
                can = np.flatnonzero(found & free)
                other = self._nearest(node, can if len(can) else np.flatnonzero(found))  # a full node takes one more only where all are full
                out[other].append(node)
                free[other] = len(out[other]) < room
                self._reached(out, node, found)

    def _nearest(self, node: int, others: np.ndarray) -> int:
        return int(others[np.argmin(1.0 - self.x[others] @ self.x[node])])

    def search(self, q: np.ndarray, k: int, ef: int, admitted: np.ndarray | None = None, stop: StopCondition | None = None) -> list[tuple[float, int]]:
        """(distance, label) of the k nearest that are admitted and not deleted, or of what ``stop`` gathers."""
        if self.entry < 0:
            return []
        if self.deleted.any():
            admitted = ~self.deleted if admitted is None else admitted & ~self.deleted
        start = self._descend(q, self.levels[self.entry], 0, self.entry)
        found = self._beam(q, start, max(ef, k), 0, admitted)[:k] if stop is None else self._walk(q, start, stop, admitted)
        return [(d, int(self.labels[n])) for d, n in found]

    def rows(self, shard: int) -> pa.Table:
        n = len(self.x)
        links = [[[int(self.labels[i]) for i in layer] for layer in layers] for layers in self.links]
        return pa.table({
            "shard_id": pa.array([shard] * n, pa.int32()), "id": pa.array(self.labels, pa.int64()), "level": pa.array(self.levels, pa.int32()),
            "entry": pa.array([i == self.entry for i in range(n)], pa.bool_()), "deleted": pa.array(self.deleted),
            "vec": pa.array(list(self.x), pa.list_(pa.float64())), "links": pa.array(links, pa.list_(pa.list_(pa.int64()))),
        })


@dataclass(frozen=True)
class GraphIndex:
    """Immutable handle over the node rows. ``homes`` lists the shards, where that is known without building them."""

    nodes: DataFrame
    m: int = 16
    ef_construction: int = 150
    homes: DataFrame | None = None

    @classmethod
    def build(cls, base: DataFrame, m: int = 16, ef_construction: int = 150, shards: int | None = None) -> GraphIndex:
        """``base(id, vec)``; with a ``shard_id`` column its values are the shards, else there are as many as
        SHARD_ROWS asks for, or ``shards``."""
        if shards is None and "shard_id" not in base.columns:
            shards = max(1, -(-base.count() // SHARD_ROWS))
        placed = base if "shard_id" in base.columns else balanced_shards(base.select("id", "vec"), shards)
        return cls(_graphs(placed, m, ef_construction), m, ef_construction, placed.select(F.col("shard_id").cast("int").alias("shard_id")).distinct())

    def materialise(self) -> GraphIndex:
        """The same graph, computed once and held by the executors (rebuilt where one is lost)."""
        return replace(self, nodes=self.nodes.persist())

    def search(self, queries: DataFrame, k: int = 10, ef: int = 100, allowed: DataFrame | None = None, probes: DataFrame | None = None) -> DataFrame:
        """``qid, rank, id, dist``. ``allowed(id)`` limits results, not routes; ``probes(qid, q, shard_id)`` limits shards."""
        if k < 1:
            raise ValueError("k must be at least 1")
        return top_k(self._found(queries, k, ef, allowed, probes).select("qid", "id", "dist"), k)

    def work(self, queries: DataFrame, k: int = 10, ef: int = 100) -> DataFrame:
        """``qid, hops, distances``: expanded nodes and computed distances of each query's search, over all shards."""
        found = self._found(queries, k, ef, counters=True)
        return found.where(F.col("id").isNull()).groupBy("qid").agg(F.sum("hops").alias("hops"), F.sum("distances").alias("distances"))

    def search_within(self, queries: DataFrame, eps: float, most: int, least: int = 1, allowed: DataFrame | None = None) -> DataFrame:
        """``qid, rank, id, dist`` at distance ``eps`` or less: see ``WithinDistance``. Larger ``least`` finds more."""
        stop = WithinDistance(eps, least, most)
        return within(self._found(queries, 1, 1, allowed, stop=stop).select("qid", "id", "dist"), eps, most)

    def search_documents(self, queries: DataFrame, docs: DataFrame, documents: int, collect: int = 10) -> DataFrame:
        """``qid, rank, id, dist, doc_id`` of the nearest rows that touch at most ``documents`` documents of
        ``docs(id, doc_id)``: see ``Documents``. Rows without a document aren't found."""
        found = self._found(queries, 1, 1, docs.select("id"), stop=Documents(documents, collect), payload=docs.select("id", F.col("doc_id").cast("long").alias("payload")))
        return document_prefix(found.select("qid", "id", "dist", F.col("payload").alias("doc_id")), documents).select("qid", "rank", "id", "dist", "doc_id")

    def _found(self, queries: DataFrame, k: int, ef: int, allowed: DataFrame | None = None, probes: DataFrame | None = None, stop: StopCondition | None = None, payload: DataFrame | None = None, counters: bool = False) -> DataFrame:
        """``qid, id, dist, payload`` that each shard finds; with ``counters`` also a row of ``hops, distances`` for each shard and query."""
        nodes = self.nodes.withColumn("admitted", F.lit(True))
        if allowed is not None:
            nodes = self.nodes.join(allowed.select("id").distinct().withColumn("admitted", F.lit(True)), "id", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))
        if payload is not None:
            nodes = nodes.join(payload, "id", "left")
        else:
            nodes = nodes.withColumn("payload", F.lit(None).cast("long"))
        if probes is None:
            asked = queries.select("qid", "q")
            homes = self.nodes.select("shard_id").distinct() if self.homes is None else self.homes
            probes = homes.join(F.broadcast(asked) if values_of(queries) <= BLOCK_VALUES else asked, F.lit(True))

        paid = payload is not None

        def run(table: pa.Table, asked: pa.Table) -> pa.Table:
            found: list[tuple] = []
            if table.num_rows and asked.num_rows:
                table = table.take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable")))
                admitted = table.column("admitted").to_numpy()
                own = None if not paid else table.column("payload").fill_null(0).to_numpy()  # those without one aren't admitted
                graph = Graph.restore(table.drop_columns(["admitted", "payload"]))
                place = {int(i): n for n, i in enumerate(graph.labels)}
                for qid, q in zip(asked.column("qid").to_pylist(), matrix(asked.column("q")), strict=True):
                    graph.hops = graph.distances = 0
                    hits = graph.search(q, k, ef, None if admitted.all() else admitted, None if stop is None else stop.fresh(own))
                    found += [(qid, i, d, None if own is None else int(own[place[i]]), None, None) for d, i in hits]
                    if counters:
                        found.append((qid, None, None, None, graph.hops, graph.distances))
            cols = list(zip(*found, strict=True)) if found else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            return pa.table({n: pa.array(c, t) for n, c, t in zip(("qid", "id", "dist", "payload", "hops", "distances"), cols, kinds, strict=True)})

        nodes = nodes.select("shard_id", "id", "level", "entry", "deleted", "vec", "links", "admitted", "payload")
        probes = probes.select(F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q"), F.col("shard_id").cast("int").alias("shard_id"))
        return nodes.groupBy("shard_id").cogroup(probes.groupBy("shard_id")).applyInArrow(run, "qid long, id long, dist double, payload long, hops long, distances long")

    def edges(self) -> DataFrame:
        """``shard_id, src, layer, pos, dst``."""
        layers = self.nodes.select("shard_id", F.col("id").alias("src"), F.posexplode("links").alias("layer", "near"))
        return layers.select("shard_id", "src", "layer", F.posexplode("near").alias("pos", "dst"))

    def integrity(self) -> DataFrame:
        """One row: nodes, links, self links, repeated links, links to no node, least and largest in-degree on layer 0."""
        edges = self.edges()
        totals = edges.agg(F.count(F.lit(1)).alias("links"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("self_links"))
        distinct = edges.groupBy("src", "layer", "dst").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_links"))
        lost = edges.join(self.nodes.select("shard_id", F.col("id").alias("dst")), ["shard_id", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("dangling_links"))
        degree = self.nodes.select("id").join(edges.where("layer = 0").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
        degree = degree.agg(F.count(F.lit(1)).alias("nodes"), F.min("n").alias("min_in_degree"), F.max("n").alias("max_in_degree"))
        return degree.join(totals, F.lit(True)).join(distinct, F.lit(True)).join(lost, F.lit(True))

    def counts(self) -> DataFrame:
        """One row: stored elements and deleted ones."""
        return self.nodes.agg(F.count(F.lit(1)).alias("elements"), F.count(F.when(F.col("deleted"), 1)).alias("deleted"))

    def lookup(self, label: int) -> list[float]:
        """Vector of a live label; a deleted or unknown one raises."""
        row = self.nodes.where((F.col("id") == label) & ~F.col("deleted")).select("vec").first()
        if row is None:
            raise KeyError(label)
        return row["vec"]

    def serialized_size(self) -> int:
        """Bytes of the usual binary form (its sizes are fixed values): 96 of header; per node its layer-0 block (links, 4-byte numbers,
        8-byte label), 4 more, and a link block for each upper layer."""
        head = self.nodes.select(F.size("vec").alias("d")).first()
        if head is None:
            return 96
        block = (2 * self.m * 4 + 4) + 4 * head["d"] + 8
        row = self.nodes.agg(F.count(F.lit(1)).alias("n"), F.sum("level").alias("upper")).first()
        return 96 + row["n"] * (block + 4) + row["upper"] * (self.m * 4 + 4)

    def mark_deleted(self, ids: DataFrame, deleted: bool = True) -> GraphIndex:
        """Flag labels (or clear the flag); unknown labels and labels already in that state raise. The graph stays."""
        wanted = ids.select("id").distinct()
        found = wanted.join(self.nodes.select("id", "deleted"), "id", "left")
        if found.where(F.col("deleted").isNull() | (F.col("deleted") == deleted)).limit(1).count():
            raise ValueError("a label is unknown or already in that state")
        flags = wanted.withColumn("hit", F.lit(True))
        nodes = self.nodes.join(flags, "id", "left").withColumn("deleted", F.when(F.col("hit"), F.lit(deleted)).otherwise(F.col("deleted")))
        return replace(self, nodes=nodes.select(self.nodes.columns))

    def upsert(self, rows: DataFrame, replace_deleted: bool = False) -> GraphIndex:
        """Insert or replace labels; replaced ones are live again. Only shards that change are built anew. With
        ``replace_deleted`` each new label takes the place of a deleted one of its shard, which is forgotten."""
        rows = rows.select("id", "vec")
        shards = [r["shard_id"] for r in self.nodes.select("shard_id").distinct().collect()] or [0]
        home = self.nodes.select("id", F.col("shard_id").alias("home"))
        spread = F.element_at(F.array(*[F.lit(s) for s in sorted(shards)]), (F.pmod(F.xxhash64("id"), F.lit(len(shards))) + 1).cast("int"))
        placed = rows.join(home, "id", "left").select("id", F.col("vec").cast("array<double>").alias("vec"), F.coalesce("home", spread).cast("int").alias("shard_id"))
        touched = placed.select("shard_id").distinct()
        same = self.nodes.join(touched, "shard_id", "left_anti").select(self.nodes.columns)
        old = self.nodes.join(touched, "shard_id", "left_semi").join(rows.select("id"), "id", "left_anti")
        if replace_deleted:
            fresh = placed.join(home.select("id"), "id", "left_anti").groupBy("shard_id").agg(F.count(F.lit(1)).alias("fresh"))
            turn = F.row_number().over(W.partitionBy("shard_id", "deleted").orderBy("id"))
            old = old.withColumn("turn", turn).join(fresh, "shard_id", "left").where(~F.col("deleted") | (F.col("turn") > F.coalesce("fresh", F.lit(0)))).drop("turn", "fresh")
        built = _graphs(old.select("id", "vec", "shard_id").unionByName(placed), self.m, self.ef_construction)
        gone = old.where("deleted").select("id").withColumn("gone", F.lit(True))
        built = built.join(gone, "id", "left").withColumn("deleted", F.coalesce("gone", F.lit(False))).select(self.nodes.columns)
        return replace(self, nodes=same.unionByName(built), homes=None)

    def save(self, path: str) -> None:
        self.nodes.write.mode("errorifexists").parquet(f"{path}/nodes")

    @classmethod
    def load(cls, spark: SparkSession, path: str, m: int = 16, ef_construction: int = 150) -> GraphIndex:
        """A damaged index (a shard without exactly one entry, or dangling links) raises."""
        index = cls(spark.read.schema(NODES).parquet(f"{path}/nodes"), m, ef_construction)
        entries = index.nodes.groupBy("shard_id").agg(F.sum(F.col("entry").cast("int")).alias("n")).where("n != 1 or n is null").limit(1).count()
        if entries or index.integrity().first()["dangling_links"]:
            raise ValueError("index is damaged")
        return index


def _graphs(placed: DataFrame, m: int, ef_construction: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        graph = Graph(matrix(table.column("vec")), table.column("id").to_numpy(), m, ef_construction)
        return graph.rows(table.column("shard_id")[0].as_py())

    rows = placed.select(F.col("shard_id").cast("int").alias("shard_id"), F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    return rows.groupBy("shard_id").applyInArrow(run, NODES)


@dataclass(frozen=True)
class IvfGraphIndex:
    """One graph for each inverted list; a query searches the graphs of its probed lists."""

    ivf: IvfIndex
    graphs: GraphIndex

    @classmethod
    def build(cls, base: DataFrame, nlist: int = 64, iterations: int = 2, m: int = 12, ef_construction: int = 80) -> IvfGraphIndex:
        ivf = IvfIndex.build(base, nlist, iterations)
        return cls(ivf, GraphIndex.build(ivf.rows.withColumnRenamed("cid", "shard_id"), m, ef_construction))

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 8, ef: int = 64) -> DataFrame:
        return self.graphs.search(queries, k, ef, probes=self.ivf.probes(queries, nprobe).withColumnRenamed("cid", "shard_id"))
