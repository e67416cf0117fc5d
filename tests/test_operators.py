"""Identities and edge cases of the search operators on small vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.functions.distance import METRICS, checked, register_metric
from nearfold.operators import evaluate, flat, kmeans, quantise, topk
from nearfold.operators.graph import Graph, GraphIndex, IvfGraphIndex
from nearfold.operators.ivf import IvfIndex, IvfPqIndex
from nearfold.operators.sharded import ShardedIndex
from nearfold.operators.stops import Documents, WithinDistance


def vectors(spark, x, name="vec", key="id"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{key} long, {name} array<float>")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 8)).round(2)
    x[60:70] = x[10:20]  # equal vectors under other ids
    q = rng.normal(size=(6, 8)).round(2)
    return vectors(spark, x).persist(), vectors(spark, q, "q", "qid").persist(), x.astype(np.float32).astype(float), q.astype(np.float32).astype(float)


def rows(df):
    return sorted((r["qid"], r["rank"], r["id"]) for r in df.collect())


def exact(x, q, k, metric="ip"):
    out = []
    for j, v in enumerate(q):
        d = [float(1 - sum(a * b for a, b in zip(r, v))) if metric == "ip" else float(((r - v) ** 2).sum()) for r in x]
        out += [(j, n + 1, i) for n, (_, i) in enumerate(sorted((round(d, 9), i) for i, d in enumerate(d))[:k])]
    return sorted(out)


@pytest.mark.parametrize("engine", ["expr", "arrow"])
@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("k", [1, 10, 500])
def test_flat_with_ties(spark, data, engine, metric, k):
    b, q, x, y = data
    assert rows(flat.flat_search(b, q, k, metric, engine)) == exact(x, y, k, metric)


def test_kernel_tails(spark):
    rng = np.random.default_rng(1)
    for d in (1, 3, 17):
        x, y = rng.integers(-5, 5, (20, d)), rng.integers(-5, 5, (2, d))
        b, q = vectors(spark, x), vectors(spark, y, "q", "qid")
        for engine in ("expr", "arrow"):
            assert rows(flat.flat_search(b, q, 5, "ip", engine)) == exact(x, y, 5)


def test_empty_and_invalid(spark, data):
    b, q, _, _ = data
    for engine in ("expr", "arrow"):
        assert flat.flat_search(b.where("id < 0"), q, 3, engine=engine).count() == 0
        assert flat.flat_search(b, q.where("qid < 0"), 3, engine=engine).count() == 0
    for bad in (dict(k=0), dict(name="cosine"), dict(engine="gpu")):
        with pytest.raises(ValueError):
            flat.flat_search(b, q, **bad)
    broken = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 2.0])], "id long, vec array<float>")
    with pytest.raises(Exception, match="finite|NaN"):
        flat.flat_search(broken, spark.createDataFrame([(1, [1.0, 2.0])], "qid long, q array<float>"), 1, engine="arrow").collect()
    with pytest.raises(Exception, match="finite"):
        checked(broken, "vec", 2).collect()


def test_shards_and_merge(spark, data):
    b, q, x, y = data
    want = exact(x, y, 10)
    for n in (1, 3, 4):
        assert rows(flat.sharded_search(b, q, n, 10)) == want
    placed = topk.balanced_shards(b.select("id"), 7).groupBy("shard_id").agg(F.min("id").alias("a"), F.count("*").alias("n")).orderBy("shard_id").collect()
    assert [(r["n"], r["a"]) for r in placed] == topk.shard_sizes(120, 7)
    halves = [flat.flat_search(b.where(F.col("id") % 2 == i), q, 10) for i in (0, 1)]
    assert rows(topk.merge_top_k(halves, 10)) == want


def test_filter_range_and_documents(spark, data):
    b, q, x, y = data
    kept = [i for i in range(120) if i % 3 == 0]
    got = rows(flat.flat_search(b, q, 5, where=F.col("id") % 3 == 0))
    assert got == sorted((a, r, kept[i]) for a, r, i in exact(x[kept], y, 5))
    pairs = flat.pair_distances(b.withColumn("doc_id", F.col("id") % 4), q)
    assert topk.within(pairs, -100.0, 5).count() == 0
    prefix = topk.document_prefix(pairs, 2).groupBy("qid").agg(F.countDistinct("doc_id").alias("n")).collect()
    assert all(r["n"] == 2 for r in prefix)


def test_quantised(spark, data):
    b, q, x, y = data
    want = exact(x, y, 10)
    sq = quantise.ScalarQuantiser.build(b)
    assert rows(sq.search_twice(b, q, 10, 120)) == want
    flat_dim = vectors(spark, [[1.0, 2.0], [1.0, 3.0]])
    assert [r["scale"] for r in sorted(quantise.sq_parameters(flat_dim).collect(), key=lambda r: r["d"])] == [1 / 255, 1 / 255]
    pq = quantise.ProductQuantiser.build(b, 4, 16, 2)
    assert rows(pq.search_twice(b, q, 10, 120)) == want
    assert rows(pq.search_parts(b, q, topk.balanced_shards(b.select("id"), 3), 10, 40)) == want
    assert pq.codes_by_space().count() == 480 and pq.codebook(spark).count() == 64
    with pytest.raises(ValueError):
        quantise.ProductQuantiser.build(b, 3, 4, 1)
    recalls = [evaluate.recall(pq.search_twice(b, q, 10, p), flat.flat_search(b, q, 10)).agg(F.avg("recall")).first()[0] for p in (10, 30, 120)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0


def test_kmeans_policies(spark):
    x = np.array([[1, 0], [2, 0], [3, 0], [0, 0]], float)
    b = vectors(spark, x)
    assert kmeans.stride_rows(4, 2) == [0, 2]
    keep = kmeans.train(b, 2, 1, empty="keep")[0]
    zero = kmeans.train(b, 2, 1, empty="zero")[0]
    # the longer seed attracts all rows but the zero vector, which ties and takes the first
    assert np.allclose(keep, [[0, 0], [2, 0]]) and np.allclose(zero, keep)
    with pytest.raises(ValueError):
        kmeans.train(b, 5, 1)


def test_seeds_by_either_way(spark, data, monkeypatch):
    """Seeds at even strides are the same rows whether the driver or Spark numbers them; repeated ids take Spark's way."""
    b, _, x, _ = data
    one = kmeans.seeds(b, 7)
    monkeypatch.setattr(kmeans, "IDS", 0)
    assert (one == kmeans.seeds(b, 7)).all() and (one == x[kmeans.stride_rows(120, 7)]).all()
    monkeypatch.undo()
    assert len(kmeans.seeds(b.unionByName(b.limit(3)), 5)) == 5


def test_kmeans_sample_is_bounded(spark):
    """Beyond the bound a sample by id is fitted on; it doesn't depend on partitions, and all rows are assigned."""
    rng = np.random.default_rng(3)
    b = vectors(spark, rng.normal(size=(3000, 4)))
    some = kmeans.training_rows(b, 4, 500)
    assert 400 < some.count() < 600 and kmeans.training_rows(b, 4).count() == 3000
    one, two = (kmeans.train(d, 4, 2, most=500) for d in (b, b.repartition(7)))
    assert np.allclose(one, two) and np.allclose(one, kmeans.train(some, 4, 2))
    assert IvfIndex(one[0], kmeans.assign(b, one, ("id", "vec")).select("id", "vec", F.col("codes")[0].alias("cid"))).list_stats().first()["total"] == 3000


def test_ivf(spark, data):
    b, q, x, y = data
    index = IvfIndex.build(b, 8, 3)
    want = exact(x, y, 10)
    assert rows(index.search(q, 10, 8)) == want
    assert rows(index.search(q, 10, 3)) == rows(index.search_masked(q, 10, 3))
    assert index.list_stats().first()["total"] == 120
    csr = index.csr().orderBy("cid").collect()
    assert csr[-1]["offset"] + csr[-1]["len"] == 120
    recalls = [evaluate.recall(index.search(q, 10, n), flat.flat_search(b, q, 10)).agg(F.avg("recall")).first()[0] for n in (1, 4, 8)]
    assert recalls == sorted(recalls)
    with pytest.raises(ValueError):
        index.search(q, 10, 9)
    assert rows(IvfPqIndex.build(b, 8, 4, 16, 2).search(q, 10, 8, 120)) == want
    assert rows(IvfGraphIndex.build(b, 4).search(q, 10, 4, 200)) == want


def test_graph(spark, data, tmp_path):
    b, q, x, y = data
    index = GraphIndex.build(b, 8, 60).materialise()
    want = exact(x, y, 10)
    assert rows(index.search(q, 10, 200)) == want
    allowed = b.where("id % 2 = 0").select("id")
    assert rows(index.search(q, 5, 200, allowed)) == rows(flat.flat_search(b.where("id % 2 = 0"), q, 5))
    gone = b.where("id % 5 = 0").select("id")
    less = index.mark_deleted(gone)
    assert rows(less.search(q, 5, 200)) == rows(flat.flat_search(b.where("id % 5 <> 0"), q, 5))
    assert less.counts().first()["deleted"] == 24
    with pytest.raises(ValueError):
        less.mark_deleted(gone)
    with pytest.raises(KeyError):
        less.lookup(0)
    assert rows(less.mark_deleted(gone, False).search(q, 10, 200)) == want
    moved = b.where("id < 30").select((F.col("id") + 110).alias("id"), "vec")
    new = b.join(moved.select("id"), "id", "left_anti").unionByName(moved)
    assert rows(index.upsert(moved).search(q, 10, 300)) == rows(flat.flat_search(new, q, 10))
    index.save(str(tmp_path / "g"))
    assert rows(GraphIndex.load(spark, str(tmp_path / "g"), 8).search(q, 10, 200)) == want
    assert index.serialized_size() > 120 * 8 * 4


def test_sweep_and_size(spark, data):
    """A parameter grid gives one summary a value, in order; the binary size follows from levels and links."""
    b, q, x, y = data
    index = GraphIndex.build(b, 8, 60).materialise()
    truth = flat.flat_search(b, q, 10).persist()
    found = evaluate.sweep({"ef": [10, 40, 200]}, lambda ef: index.search(q, 10, ef), truth).collect()
    assert [(r["mode"], r["param_name"], r["param_value"]) for r in found] == [("ef=10", "ef", 10), ("ef=40", "ef", 40), ("ef=200", "ef", 200)]
    assert [r["avg_recall"] for r in found] == sorted(r["avg_recall"] for r in found) and found[-1]["avg_recall"] == 1.0
    assert all(r["avg_latency_us"] * 6 == pytest.approx(r["total_time_us"]) for r in found)
    levels = [r["level"] for r in index.nodes.select("level").collect()]
    assert index.serialized_size() == 96 + sum((2 * 8 * 4 + 4) + 8 * 4 + 8 + 4 + v * (8 * 4 + 4) for v in levels) and max(levels) > 0
    truth.unpersist()


def test_stop_conditions(spark, data):
    """Steered walks give the exact answers when they may go on, fewer rows when they stop early, and only admitted ones."""
    b, q, x, y = data
    index = GraphIndex.build(b, 8, 60).materialise()
    pairs = flat.pair_distances(b.withColumn("doc_id", F.col("id") % 7), q)
    near = rows(topk.within(pairs, -1.0, 120))
    assert rows(index.search_within(q, -1.0, 120, 120)) == near and near
    early = index.search_within(q, -1.0, 12, 1).collect()
    assert {(r["qid"], r["id"]) for r in early} <= {(a, i) for a, _, i in near} and max(r["rank"] for r in early) <= 12
    evens = b.where("id % 2 = 0").select("id")
    assert all(i % 2 == 0 for _, _, i in rows(index.search_within(q, -1.0, 12, 12, evens)))
    docs = b.select("id", (F.col("id") % 7).alias("doc_id"))
    assert rows(index.search_documents(q, docs, 2, 1000)) == rows(topk.document_prefix(pairs, 2))
    counted = index.search_documents(q, docs, 2, 3).groupBy("qid").agg(F.countDistinct("doc_id").alias("n")).collect()
    assert len(counted) == 6 and all(r["n"] == 2 for r in counted)
    work = index.work(q, 10, 20).collect()
    assert len(work) == 6 and all(0 < r["hops"] <= r["distances"] for r in work)
    for bad in (WithinDistance, Documents):
        with pytest.raises(ValueError):
            bad(0, 0, 0) if bad is WithinDistance else bad(0)


def test_replace_deleted(spark, data):
    """New labels take the place of deleted ones, which are forgotten; the others stay deleted."""
    b, q, x, y = data
    gone = b.where("id < 10").select("id")
    index = GraphIndex.build(b, 8, 60).mark_deleted(gone)
    fresh = b.where("id >= 20 and id < 24").select((F.col("id") + 500).alias("id"), "vec")
    new = index.upsert(fresh, replace_deleted=True)
    assert tuple(new.counts().first()) == (120, 6) and tuple(index.upsert(fresh).counts().first()) == (124, 10)
    live = b.where("id >= 10").unionByName(fresh)
    assert rows(new.search(q, 10, 300)) == rows(flat.flat_search(live, q, 10))


def test_damaged_graph_raises(spark, data, tmp_path):
    b, _, _, _ = data
    index = GraphIndex.build(b, 8, 60).materialise()
    index.nodes.where("id != 5").write.parquet(str(tmp_path / "lost" / "nodes"))
    index.nodes.withColumn("entry", F.lit(False)).write.parquet(str(tmp_path / "blind" / "nodes"))
    for name in ("lost", "blind"):
        with pytest.raises(ValueError, match="damaged"):
            GraphIndex.load(spark, str(tmp_path / name), 8)


@pytest.mark.parametrize("mode, build", [("ivf", {"nlist": 4}), ("ivf_pq", {"nlist": 4, "spaces": 4, "words": 8, "iterations": 2}), ("hnsw", {}), ("ivf_hnsw", {"nlist": 3})])
def test_sharded_modes(spark, data, mode, build):
    """An index for each shard: exact at full settings, and a part of the rows else."""
    b, q, x, y = data
    index = ShardedIndex.build(b, 3, mode, **build)
    assert len(index.parts) == 3
    probes = {"nprobe": build["nlist"]} if "nlist" in build else {}
    full = probes | ({"p": 120} if mode == "ivf_pq" else {"ef": 200} if "hnsw" in mode else {})
    assert rows(index.search(q, 10, **full)) == exact(x, y, 10)
    less = probes and index.search(q, 10, **full | {"nprobe": 1}).count()
    assert not probes or 0 < less <= 60
    with pytest.raises(ValueError):
        ShardedIndex.build(b, 2, "tree")


def test_queries_in_blocks(spark, data, monkeypatch):
    """Query sets beyond one block give the same rows."""
    b, q, x, y = data
    sq, ivf = quantise.ScalarQuantiser.build(b), IvfIndex.build(b, 4, 1)
    want = rows(sq.search_twice(b, q, 5, 120)), rows(sq.search_codes(q, 5)), rows(ivf.search_masked(q, 5, 2))
    monkeypatch.setattr(flat, "BLOCK_VALUES", 16)
    monkeypatch.setattr(quantise, "BLOCK_VALUES", 16)
    monkeypatch.setattr(quantise, "PAIRS", 10)
    assert (rows(sq.search_twice(b, q, 5, 120)), rows(sq.search_codes(q, 5)), rows(ivf.search_masked(q, 5, 2))) == want


def test_handles_and_metrics(spark, data, tmp_path):
    b, q, x, y = data
    index = flat.FlatIndex(b).remove(b.where("id >= 100").select("id"))
    assert rows(index.search(q, 10)) == exact(x[:100], y, 10)
    IvfIndex.build(b, 4, 1).save(str(tmp_path / "i"))
    assert rows(IvfIndex.load(spark, str(tmp_path / "i")).search(q, 10, 4)) == exact(x, y, 10)
    if "l1" not in METRICS:
        l1 = lambda a, v: np.abs(a - v).sum(axis=1)
        register_metric("l1", lambda a, v: F.aggregate(F.zip_with(a, v, lambda s, t: F.abs(s.cast("double") - t.cast("double"))), F.lit(0.0), lambda s, t: s + t), lambda a, qs: np.stack([l1(a, v) for v in qs], axis=1), l1)
    assert rows(flat.flat_search(b, q, 4, "l1")) == rows(flat.flat_search(b, q, 4, "l1", "arrow"))
    with pytest.raises(ValueError):
        register_metric("ip", None, None, None)
    one = evaluate.summary("flat", lambda: flat.flat_search(b, q, 10), flat.flat_search(b, q, 10)).first()
    assert one["avg_recall"] == 1.0 and one["total_time_us"] > 0


def test_plans_push_down(spark, data):
    """Filters and columns reach the scan; top-k is limited before the shuffle; probes are a broadcast equi-join."""
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id >= 20").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    queries = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 20").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    plan = flat.flat_search(base, queries, 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,20)" in plan and "WindowGroupLimit" in plan and "label" not in plan


def _clumped(kind: str) -> np.ndarray:
    """Vectors whose pruned links leave some nodes without a way to them: copies, and lengths that differ."""
    rng = np.random.default_rng(5)
    return np.ones((300, 4)) if kind == "copies" else rng.normal(size=(600, 8)) * rng.lognormal(size=(600, 1))


@pytest.mark.parametrize("kind", ["copies", "lengths"])
def test_a_beam_as_wide_as_the_shard_finds_every_node(kind):
    x = _clumped(kind)
    graph = Graph(x, np.arange(len(x)), 4, 20)
    assert max(len(layers[0]) for layers in graph.links) <= 8
    assert all(n not in near and len(set(near)) == len(near) for n, layers in enumerate(graph.links) for near in layers)
    for q in x[:30]:
        assert sorted(i for _, i in graph.search(q, len(x), 1 << 30)) == list(range(len(x)))


def test_graph_searches_with_whole_beams_are_exact_on_copies(spark):
    x = np.concatenate((_clumped("lengths")[:200], np.ones((100, 8))))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    q = base.where("id % 25 = 0").selectExpr("id as qid", "vec as q")
    truth = [tuple(r) for r in flat.flat_search(base, q, 100).select("qid", "rank", "id").orderBy("qid", "rank").collect()]
    for index in (GraphIndex.build(base, 4, 20, shards=2), IvfGraphIndex.build(base, 3, m=4, ef_construction=20).graphs):
        assert [tuple(r) for r in index.search(q, 100, 1 << 30).select("qid", "rank", "id").orderBy("qid", "rank").collect()] == truth
