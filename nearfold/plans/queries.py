"""Registered queries over the ``embeddings`` table and report fixtures, each with DuckDB SQL where SQL can say it.

Queries are the vectors with ``vec_id`` below 20, held out of the base. The queries named ``..._hundredths``
take every vector whose ``vec_id`` is divisible by 100 as a query, against all vectors: its own row counts and
may be found. Distances are rounded after ranking.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.functions.scratch import scratch_path
from nearfold.operators import evaluate, flat, quantise, topk
from nearfold.operators.graph import GraphIndex, IvfGraphIndex
from nearfold.operators.ivf import IvfIndex, IvfPqIndex
from nearfold.operators.sharded import ShardedIndex
from nearfold.plans import reports
from nearfold.sources import reports as files

QUERY_IDS, K, NLIST, NPROBE, BATCH = 20, 10, 16, 4, 8
SPACES, WORDS, P, SHARDS = 8, 16, 100, 4
EPS, EPS_MOST, DOCS = 0.75, 25, 3
ITERATIONS = 2
#: The ``..._wide`` queries reach a recall of 0.9: lists probed of NLIST, words of a sub-space, and the hundredths of the rows that are ranked again.
WIDE_PROBE, WIDE_WORDS, WIDE_PERCENT = 13, 256, 20
#: Beam widths of the graph searches that stop early, and lists of an index of one shard.
BEAMS, SHARD_LISTS, EVERYTHING = (10, 32, 64, 128), 4, 1 << 30

Query = Callable[[SparkSession, str], DataFrame]


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).where(F.col("vec_id") >= QUERY_IDS).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("doc_id"))


def query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).where(F.col("vec_id") < QUERY_IDS).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return base_rows(spark, sf_dir), query_rows(spark, sf_dir)


def _hundredths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All rows, and every hundredth of them as queries."""
    rows = _embeddings(spark, sf_dir)
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("doc_id")), rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def _ranked(df: DataFrame) -> DataFrame:
    return topk.rounded(df.select("qid", "rank", "id", "dist"))


def _ivf(b: DataFrame) -> IvfIndex:
    return IvfIndex.build(b.select("id", "vec"), NLIST, ITERATIONS)


def _pq(b: DataFrame) -> quantise.ProductQuantiser:
    return quantise.ProductQuantiser.build(b.select("id", "vec"), SPACES, WORDS, ITERATIONS)


def _lists(df: DataFrame) -> DataFrame:
    """Codes in long form."""
    return df.select("id", F.posexplode("codes").alias("m", "code"))


def _hnsw(b: DataFrame, q: DataFrame, **more) -> DataFrame:
    return _ranked(GraphIndex.build(b).search(q, K, ef=1 << 30, **more))


def _deleted(b: DataFrame, q: DataFrame) -> DataFrame:
    index = GraphIndex.build(b).materialise()
    return _ranked(index.mark_deleted(b.where(F.col("id") % 3 == 0).select("id")).search(q, K, ef=1 << 30))


def _recalls(b: DataFrame, q: DataFrame) -> DataFrame:
    truth = flat.flat_search(b, q, K).persist()  # read once for each method
    named = {
        "sq": quantise.ScalarQuantiser.build(b).search(q, K),
        "ivf": _ivf(b).search(q, K, NPROBE),
        "pq_twice": _pq(b).search_twice(b, q, K, P),
    }
    return evaluate.mean_recall(named, truth, K)


def _wide_p(b: DataFrame) -> int:
    """Rows to rank again: a share of the table, P at least."""
    return max(P, b.count() * WIDE_PERCENT // 100)


def _wide(b: DataFrame, q: DataFrame) -> dict[str, DataFrame]:
    rows = b.select("id", "vec")
    return {
        "ivf": _ivf(b).search(q, K, WIDE_PROBE),
        "pq_twice": quantise.ProductQuantiser.build(rows, SPACES, WIDE_WORDS, ITERATIONS).search_twice(b, q, K, _wide_p(b)),
        "ivf_pq": IvfPqIndex.build(rows, NLIST, SPACES, WIDE_WORDS, ITERATIONS).search(q, K, WIDE_PROBE, _wide_p(b)),
    }


def _beams(b: DataFrame, q: DataFrame) -> DataFrame:
    """Recall of graph searches at working beam widths."""
    index = GraphIndex.build(b).materialise()
    return evaluate.mean_recall({f"ef={ef}": index.search(q, K, ef) for ef in BEAMS}, flat.flat_search(b, q, K), K)


def _work(b: DataFrame, q: DataFrame) -> DataFrame:
    """Nodes expanded and distances computed of every query, by beam width."""
    index, out = GraphIndex.build(b).materialise(), None
    for ef in BEAMS:
        row = index.work(q, K, ef).select(F.lit(ef).alias("ef"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def _whole_shards(mode: str, build: dict, search: dict) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A sharded index whose settings reach every row, so that its answer is exact."""
    return lambda b, q: _ranked(ShardedIndex.build(b, SHARDS, mode, **build).search(q, K, **search))


def _csv_scan(spark: SparkSession, name: str, kind: str) -> DataFrame:
    """A fixture appended to a CSV report in two parts and scanned again."""
    path = scratch_path(spark, "report")
    names = [c.split(" ")[0] for c in files.SCHEMAS[kind].split(", ")]
    for part in (F.col("line") % 2 == 0, F.col("line") % 2 == 1):
        files.append_report(_fixture(spark, name).where(part).select(*names), path)
    return files.read_report(spark, path, kind)


def _log_scan(spark: SparkSession) -> DataFrame:
    """The selected fixture as a log, whose last labelled figures count."""
    path = scratch_path(spark, "log")
    figures = [F.concat(F.lit(label + " "), F.col(c).cast("string")) for c, label in files.LOG_FIELDS.items()]
    lines = _fixture(spark, "sel").orderBy("line").coalesce(1).select(F.explode(F.array(F.concat(F.lit("mode "), "mode"), *figures)).alias("value"))
    lines.write.text(path)
    return files.read_log(spark, path).drop("file")


def _round_trip(spark: SparkSession, b: DataFrame, q: DataFrame) -> DataFrame:
    path = scratch_path(spark, "index")
    flat.FlatIndex(b).save(path)
    return _ranked(flat.FlatIndex.load(spark, path).search(q, K))


def _upsert_share(b: DataFrame, q: DataFrame) -> DataFrame:
    """An eleventh of the vectors moves to the next id's place and a seventh of the ids goes, whatever the table's size."""
    moved = b.where(F.col("id") % 11 == 3).select((F.col("id") + 1).alias("id"), "vec")
    index = flat.FlatIndex(b).upsert(moved)
    return _ranked(index.remove(index.base.where(F.col("id") % 7 == 0).select("id")).search(q, K, engine="arrow"))


def _on_both(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir, rows=_both: f(*rows(spark, sf_dir))


#: Report fixtures as SQL that both engines read: rows with duplicate modes, whose last line counts.
FIXTURES = {
    "sel": ("line, mode, threads, recall, latency_us, total_us", [
        (1, "seq", 1, 0.99, 900.0, 18000.0), (2, "pthread", 8, 0.99, 950.0, 2600.0), (3, "openmp", 8, 0.99, 940.0, 2500.0), (4, "ivf_pq", 1, 0.95, 500.0, 10715.0),
        (5, "ivf_pq_pthread", 8, 0.95, 520.0, 2719.0), (6, "ivf_pq_openmp", 8, 0.95, 515.0, 3166.0), (7, "hnsw", 1, 0.97, 59.0, 1187.0), (8, "hnsw_pthread", 8, 0.97, 61.0, 1150.0),
        (9, "hnsw_openmp", 8, 0.97, 60.0, 1160.0), (10, "seq", 1, 0.98, 880.0, 17600.0), (11, "other", 4, 0.5, 1.0, 2.0)]),
    "thr": ("line, mode, threads, recall, latency_us, total_us", [
        (1, "pthread", 1, 0.99, 900.0, 9000.0), (2, "pthread", 4, 0.99, 930.0, 2400.0), (3, "pthread", 8, 0.99, 990.0, 1300.0), (4, "hnsw_pthread", 1, 0.97, 60.0, 600.0),
        (5, "hnsw_pthread", 4, 0.97, 62.0, 310.0), (6, "hnsw_pthread", 8, 0.97, 66.0, 310.0), (7, "ivf_pq_pthread", 8, 0.95, 510.0, 1400.0), (8, "hnsw_openmp", 8, 0.97, 66.0, 330.0), (9, "hnsw_pthread", 8, 0.9, 67.0, 320.0)]),
    "x86": ("line, mode, threads, avg_recall, avg_latency_us, total_time_us", [
        (1, "ivf_pq", 1, 0.95, 535.0, 10715.0), (2, "thread_ivf_pq", 8, 0.95, 540.0, 2719.0), (3, "openmp_ivf_pq", 8, 0.95, 541.0, 3166.0), (4, "hnsw", 1, 0.97, 59.0, 1187.0),
        (5, "thread_hnsw", 8, 0.97, 60.0, 1201.0), (6, "openmp_hnsw", 8, 0.97, 60.5, 1210.0), (7, "hnsw", 1, 0.97, 58.0, 1180.0)]),
    "var": ("line, variant, label, recall, latency_us", [
        (1, "auto", "compiler", 1.0, 900.0), (2, "neon4", "4 lanes", 1.0, 700.0), (3, "auto", "compiler again", 1.0, 920.0), (4, "neon16", "16 lanes", 0.99, 420.0), (5, "neon4", "4 lanes", 0.98, 690.0)]),
    "trd": ("line, family, param_name, param_value, recall, latency_us, total_us", [
        (1, "flat_pq", "p", 100, 0.8, 300.0, 6000.0), (2, "flat_pq", "p", 550, 0.97, 420.0, 8400.0), (3, "hnsw", "ef", 64, 0.97, 60.0, 1200.0), (4, "flat_pq", "p", 550, 0.96, 410.0, 8200.0)]),
}


def _values(name: str) -> str:
    """A fixture as a SQL relation."""
    columns, rows = FIXTURES[name]
    cell = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS {name}({columns}))"


def _fixture(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_values(name)}")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


QUERIES: dict[str, Query] = {
    "flat_ip_topk": _on_both(lambda b, q: _ranked(flat.flat_search(b, q, K))),
    "flat_ip_topk_arrow": _on_both(lambda b, q: _ranked(flat.flat_search(b, q, K, engine="arrow"))),
    "flat_l2_topk": _on_both(lambda b, q: _ranked(flat.flat_search(b, q, K, "l2"))),
    "flat_l2_topk_arrow": _on_both(lambda b, q: _ranked(flat.flat_search(b, q, K, "l2", "arrow"))),
    "filtered_topk": _on_both(lambda b, q: _ranked(flat.flat_search(b, q, K, where=F.col("doc_id") % 2 == 0))),
    "range_eps_topk": _on_both(lambda b, q: _ranked(topk.within(flat.pair_distances(b, q), EPS, EPS_MOST))),
    "doc_prefix_search": _on_both(lambda b, q: topk.rounded(topk.document_prefix(flat.pair_distances(b, q), DOCS).select("qid", "rank", "id", "doc_id", "dist"))),
    "doc_prefix_search_l2": _on_both(lambda b, q: topk.rounded(topk.document_prefix(flat.pair_distances(b, q, "l2"), DOCS).select("qid", "rank", "id", "doc_id", "dist"))),
    "padded_range": _on_both(lambda b, q: topk.padded(topk.within(flat.pair_distances(b, q), EPS, EPS_MOST), q, EPS_MOST).select("qid", F.array_join("ids", ",").alias("ids"))),
    "padded_round_trip": _on_both(lambda b, q: _ranked(topk.unpadded(topk.padded(topk.within(flat.pair_distances(b, q), EPS, EPS_MOST), q, EPS_MOST)))),
    "ivf_upsert_remove": _on_both(lambda b, q: _ranked(_ivf(b).upsert(b.where(F.col("id") % 11 == 3).select((F.col("id") + 1).alias("id"), "vec")).remove(b.where(F.col("id") % 7 == 0).select("id")).search(q, K, NLIST))),
    "sharded_topk_merge": _on_both(lambda b, q: _ranked(flat.sharded_search(b, q, SHARDS, K))),
    "shard_assignment": _on_both(lambda b, q: topk.balanced_shards(b.select("id"), SHARDS)),
    "sorted_id_lists": _on_both(lambda b, q: topk.sorted_ids(flat.flat_search(b, q, K)).select("qid", F.array_join("ids", ",").alias("ids"))),
    "flat_upsert_remove_share": _on_both(_upsert_share),
    "index_round_trip": lambda s, d, rows=_both: _round_trip(s, *rows(s, d)),
    "sq_params": _on_both(lambda b, q: _rounded(quantise.sq_parameters(b), "minv", "scale")),
    "sq_codes": _on_both(lambda b, q: quantise.ScalarQuantiser.build(b).codes.select("id", F.posexplode("codes").alias("d", "code")).select("id", "d", F.col("code").cast("int").alias("code"))),
    "sq_topk": _on_both(lambda b, q: _ranked(quantise.ScalarQuantiser.build(b).search(q, K))),
    "sq_twostage": _on_both(lambda b, q: _ranked(quantise.ScalarQuantiser.build(b).search_twice(b, q, K, P))),
    "int_l2_topk": _on_both(lambda b, q: quantise.ScalarQuantiser.build(b).search_codes(q, K)),
    "ivf_assignments": _on_both(lambda b, q: _ivf(b).assignments()),
    "ivf_list_stats": _on_both(lambda b, q: _rounded(_ivf(b).list_stats(), "avg_len")),
    "ivf_csr_offsets": _on_both(lambda b, q: _ivf(b).csr().select("cid", "offset", "len", F.array_join("ids", ",").alias("ids"))),
    "ivf_topk": _on_both(lambda b, q: _ranked(_ivf(b).search(q, K, NPROBE))),
    "ivf_topk_masked": _on_both(lambda b, q: _ranked(_ivf(b).search_masked(q, K, NPROBE))),
    "ivf_full_probe": _on_both(lambda b, q: _ranked(_ivf(b).search(q, K, NLIST))),
    "ivf_work_counters": _on_both(lambda b, q: _ivf(b).work_counters(q, NPROBE, BATCH)),
    "pq_codes": _on_both(lambda b, q: _lists(_pq(b).codes)),
    "pq_adc_topk": _on_both(lambda b, q: _ranked(_pq(b).search(q, K))),
    "pq_twostage": _on_both(lambda b, q: _ranked(_pq(b).search_twice(b, q, K, P))),
    "pq_partitioned_topk": _on_both(lambda b, q: _ranked(_pq(b).search_parts(b, q, topk.balanced_shards(b.select("id"), SHARDS), K, 50))),
    "ivf_pq_topk": _on_both(lambda b, q: _ranked(IvfPqIndex.build(b.select("id", "vec"), NLIST, SPACES, WORDS, ITERATIONS).search(q, K, NPROBE, P))),
    "ivf_topk_wide": _on_both(lambda b, q: _ranked(_wide(b, q)["ivf"])),
    "pq_twostage_wide": _on_both(lambda b, q: _ranked(_wide(b, q)["pq_twice"])),
    "ivf_pq_topk_wide": _on_both(lambda b, q: _ranked(_wide(b, q)["ivf_pq"])),
    "recall_by_method_wide": _on_both(lambda b, q: _rounded(evaluate.mean_recall(_wide(b, q), flat.flat_search(b, q, K), K), "avg_recall")),
    "recall_by_method": _on_both(lambda b, q: _rounded(_recalls(b, q), "avg_recall")),
    "recall_per_query": _on_both(lambda b, q: _rounded(evaluate.recall(_ivf(b).search(q, K, NPROBE), flat.flat_search(b, q, K), K), "recall")),
    "hnsw_topk": _on_both(lambda b, q: _hnsw(b, q)),
    "hnsw_filtered": _on_both(lambda b, q: _hnsw(b, q, allowed=b.where(F.col("doc_id") % 2 == 0).select("id"))),
    "hnsw_deleted": _on_both(_deleted),
    "hnsw_sharded": _on_both(lambda b, q: _ranked(GraphIndex.build(b, shards=SHARDS).search(q, K, ef=1 << 30))),
    "ivf_hnsw_topk": _on_both(lambda b, q: _ranked(IvfGraphIndex.build(b.select("id", "vec"), NLIST).search(q, K, NLIST, 1 << 30))),
    "hnsw_range_eps": _on_both(lambda b, q: _ranked(topk.within(GraphIndex.build(b).search_within(q, EPS, EVERYTHING, EVERYTHING).drop("rank"), EPS, EPS_MOST))),
    "hnsw_documents": _on_both(lambda b, q: topk.rounded(GraphIndex.build(b).search_documents(q, b.select("id", "doc_id"), DOCS, EVERYTHING).select("qid", "rank", "id", "doc_id", "dist"))),
    "hnsw_beam_recall": _on_both(lambda b, q: _rounded(_beams(b, q), "avg_recall")),
    "hnsw_beam_topk": _on_both(lambda b, q: _ranked(GraphIndex.build(b).search(q, K, 64))),
    "hnsw_work": _on_both(_work),
    "sharded_ivf_topk": _on_both(_whole_shards("ivf", {"nlist": SHARD_LISTS, "iterations": ITERATIONS}, {"nprobe": SHARD_LISTS})),
    "sharded_ivf_pq_topk": _on_both(_whole_shards("ivf_pq", {"nlist": SHARD_LISTS, "words": WORDS, "iterations": ITERATIONS}, {"nprobe": SHARD_LISTS, "p": EVERYTHING})),
    "sharded_ivf_hnsw_topk": _on_both(_whole_shards("ivf_hnsw", {"nlist": SHARD_LISTS}, {"nprobe": SHARD_LISTS, "ef": EVERYTHING})),
    "graph_integrity": _on_both(lambda b, q: GraphIndex.build(b).materialise().integrity()),
    "graph_integrity_zeros": _on_both(lambda b, q: GraphIndex.build(b).materialise().integrity().select("nodes", "self_links", "repeated_links", "dangling_links")),
    "report_csv_scan": lambda s, d: _csv_scan(s, "sel", "selected"),
    "report_bench_scan": lambda s, d: _csv_scan(s, "x86", "bench"),
    "report_log_scan": lambda s, d: _log_scan(s),
    "report_selected_summary": lambda s, d: _rounded(reports.selected_summary(_fixture(s, "sel")), "total_ms", "speedup_vs_seq"),
    "report_variant_summary": lambda s, d: _rounded(reports.variant_summary(_fixture(s, "var")), "avg_recall", "avg_latency_us"),
    "report_best_threads": lambda s, d: reports.best_threads(_fixture(s, "thr")),
    "report_ratios": lambda s, d: _rounded(reports.write_up_ratios(_fixture(s, "sel")), "ratio"),
    "report_trade_off": lambda s, d: reports.trade_off(_fixture(s, "trd"), "flat_pq"),
    "report_figure_series": lambda s, d: reports.figure_series(_fixture(s, "thr"), "threads", "total_us", ("pthread", "hnsw_openmp")).select("mode", F.size("xs").alias("points"), F.array_max("ys").alias("highest"), *[F.array_join(F.transform(c, lambda v: v.cast("long")), ",").alias(c) for c in ("xs", "ys")]),
    "report_cross_platform": lambda s, d: reports.cross_platform(_fixture(s, "sel"), _fixture(s, "x86")),
    "report_cross_platform_threads": lambda s, d: reports.cross_platform(_fixture(s, "thr"), _fixture(s, "x86"), 8),
}

#: Searches that also run with ``_hundredths``. Recall isn't among them: a query that is in the base flatters it.
SEARCHES = (
    "flat_ip_topk", "flat_ip_topk_arrow", "flat_l2_topk", "flat_l2_topk_arrow", "filtered_topk", "range_eps_topk", "doc_prefix_search", "sharded_topk_merge", "sorted_id_lists",
    "flat_upsert_remove_share", "index_round_trip", "sq_topk", "sq_twostage", "int_l2_topk", "ivf_topk", "ivf_topk_masked", "ivf_full_probe", "ivf_work_counters",
    "pq_adc_topk", "pq_twostage", "pq_partitioned_topk", "ivf_pq_topk", "hnsw_topk", "hnsw_filtered", "hnsw_deleted", "hnsw_sharded", "ivf_hnsw_topk",
)
QUERIES |= {f"{name}_hundredths": lambda s, d, own=QUERIES[name]: own(s, d, _hundredths) for name in SEARCHES}


# ---- SQL oracles -------------------------------------------------------------------------------------

_BASE = f"""
    q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < {QUERY_IDS}),
    b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label AS doc_id FROM embeddings WHERE vec_id >= {QUERY_IDS})"""
_ALL = """
    q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
    b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label AS doc_id FROM embeddings)"""
_IP = "1 - list_inner_product(v, q)"
_L2 = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - q[i]) * (v[i] - q[i])))"


def _top(pairs: str, k: int = K, digits: int | None = 6) -> str:
    """Ranking of ``pairs(qid, id, dist)``."""
    dist = "dist" if digits is None else f"round(dist, {digits}) AS dist"
    return f"SELECT qid, rank, id, {dist} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank FROM ({pairs})) WHERE rank <= {k}"


def _flat_sql(dist: str = _IP, where: str = "TRUE", source: str = "b") -> str:
    return f"WITH {_BASE} " + _top(f"SELECT qid, id, {dist} AS dist FROM q, {source} WHERE {where}")


def _kmeans_sql(spaces: int, k: int, iterations: int) -> str:
    """CTEs ending in ``cents(m, c, v)`` and ``codes(id, m, c)``: stride seeds, empty centroids keep their place."""
    size = f"(len(v) // {spaces})"
    out = [
        f"sub AS (SELECT id, m, v[m * {size} + 1 : (m + 1) * {size}] AS v, row_number() OVER (PARTITION BY m ORDER BY id) - 1 AS r, count(*) OVER (PARTITION BY m) AS n FROM b, range({spaces}) t(m))",
        f"c0 AS MATERIALIZED (SELECT s.m, t.c, s.v FROM sub s JOIN range({k}) t(c) ON s.r = least((t.c * s.n) // {k}, s.n - 1))",
    ]
    for i in range(iterations + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT id, m, c, v FROM (SELECT s.id, s.m, c.c, s.v, row_number() OVER (PARTITION BY s.id, s.m ORDER BY list_inner_product(s.v, c.v) DESC, c.c) AS w FROM sub s JOIN c{i} c ON s.m = c.m) WHERE w = 1)")
        if i < iterations:
            out.append(f"u{i} AS (SELECT m, c, list(x ORDER BY d) AS v FROM (SELECT m, c, d, avg(v[d]) AS x FROM a{i}, range(1, 257) t(d) WHERE d <= len(v) GROUP BY m, c, d) GROUP BY m, c)")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT o.m, o.c, coalesce(u.v, o.v) AS v FROM c{i} o LEFT JOIN u{i} u ON o.m = u.m AND o.c = u.c)")
    return ", ".join([*out, f"cents AS (SELECT * FROM c{iterations})", f"codes AS (SELECT id, m, c FROM a{iterations})"])


_IVF = f"WITH {_BASE}, {_kmeans_sql(1, NLIST, ITERATIONS)}"
_PQ = f"WITH {_BASE}, {_kmeans_sql(SPACES, WORDS, ITERATIONS)}"
_SIZES = "sizes AS (SELECT c.c AS cid, count(a.id) AS len FROM cents c LEFT JOIN codes a ON a.c = c.c GROUP BY 1)"
_PROBES = "probes AS (SELECT qid, q, cid FROM (SELECT qid, q, c.c AS cid, row_number() OVER (PARTITION BY qid ORDER BY list_inner_product(c.v, q) DESC, c.c) AS r FROM q, cents c) WHERE r <= {n})"
_LISTS = f"SELECT qid, b.id, {_IP} AS dist FROM probes JOIN codes ON codes.c = cid JOIN b ON b.id = codes.id"
_IVF_TOP = f"{_IVF}, {_PROBES.format(n=NPROBE)} " + _top(_LISTS)
_LUT = f"lut AS MATERIALIZED (SELECT qid, m, c, list_inner_product(cents.v, q[m * (len(q) // {SPACES}) + 1 : (m + 1) * (len(q) // {SPACES})]) AS ip FROM q, cents)"
_ADC = "SELECT qid, id, 1 - sum(ip) AS dist FROM codes JOIN lut USING (m, c) GROUP BY qid, id"


def _again(found: str, p: int | str, by: str = "qid") -> str:
    """Exact ranking of the first p of ``found``."""
    near = f"SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY dist, id) AS r FROM ({found})) WHERE r <= {p}"
    return _top(f"SELECT qid, id, {_IP} AS dist FROM ({near}) JOIN b USING (id) JOIN q USING (qid)")


_SQ = f"""WITH {_BASE},
    sp AS (SELECT d, min(v[d]) AS minv, CASE WHEN max(v[d]) - min(v[d]) < 1e-8 THEN 1 ELSE max(v[d]) - min(v[d]) END / 255 AS scale FROM b, range(1, 65) t(d) GROUP BY d),
    pl AS (SELECT list(minv ORDER BY d) AS lo, list(scale ORDER BY d) AS sc FROM sp),
    sc AS (SELECT id, list_transform(range(1, len(v) + 1), lambda i: floor((v[i] - lo[i]) / sc[i] + 0.5)) AS codes FROM b, pl),
    sq AS (SELECT qid, q, list_transform(range(1, len(q) + 1), lambda i: q[i] * sc[i]) AS qs, list_inner_product(q, lo) AS qm FROM q, pl)"""
_SQ_PAIRS = "SELECT qid, id, 1 - (list_inner_product(codes, qs) + qm) AS dist FROM sc, sq"
_ACTIVE = f"numbered AS (SELECT qid, qid // {BATCH} AS b FROM q), nb AS (SELECT b, count(*) AS nb FROM numbered GROUP BY b), work AS (SELECT b, cid, nq, len, nb FROM (SELECT b, cid, count(*) AS nq FROM probes JOIN numbered USING (qid) GROUP BY b, cid) JOIN sizes USING (cid) JOIN nb USING (b) WHERE len > 0)"
_TRUTH = f"truth AS (SELECT qid, id FROM ({_top(f'SELECT qid, id, {_IP} AS dist FROM q, b')}))"
_SPLIT = f"ntile({SHARDS}) OVER (ORDER BY id) - 1"


def _recall_sql(name: str, found: str) -> str:
    return f"SELECT '{name}' AS method, round(count(*) / {QUERY_IDS * K}.0, 6) AS avg_recall FROM truth JOIN (SELECT qid, id FROM ({found})) USING (qid, id)"


_WIDE_PQ = f"WITH {_BASE}, {_kmeans_sql(SPACES, WIDE_WORDS, ITERATIONS)}"
_WIDE_P = f"(SELECT greatest({P}, count(*) * {WIDE_PERCENT} // 100) FROM b)"
_WIDE = {
    "ivf": f"{_IVF}, {_PROBES.format(n=WIDE_PROBE)} " + _top(_LISTS),
    "pq_twice": f"{_WIDE_PQ}, {_LUT} " + _again(_ADC, _WIDE_P),
    "ivf_pq": f"{_IVF}, {_PROBES.format(n=WIDE_PROBE)}, listed AS MATERIALIZED (SELECT qid, id FROM probes JOIN codes ON codes.c = cid), found AS ({_WIDE_PQ}, {_LUT} {_ADC}) " + _again("SELECT * FROM found JOIN listed USING (qid, id)", _WIDE_P),
}


def _last(name: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY line DESC) AS w FROM {_values(name)}) WHERE w = 1)"


def _pairs_sql(rows: tuple, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(repr(x) for x in r) + ')' for r in rows)}) p({names})"


def _platform_sql(arm: str) -> str:
    rows = tuple((i, a, b) for i, (a, b) in enumerate(reports.PLATFORM_MODES))
    return f"SELECT position, arm_mode, a.threads AS arm_threads, a.recall AS arm_recall, a.total_us / 1000 AS arm_total_ms, x86_mode, x.threads AS x86_threads, x.avg_recall AS x86_recall, x.total_time_us / 1000 AS x86_total_ms FROM {_pairs_sql(rows, 'position, arm_mode, x86_mode')} JOIN {arm} a ON a.mode = arm_mode JOIN {_last('x86')} x ON x.mode = x86_mode"


def _prefix_sql(dist: str) -> str:
    """The longest prefix of each query's neighbours that touches DOCS documents."""
    return f"""WITH {_BASE}, d AS (SELECT qid, id, doc_id, {dist} AS dist FROM q, b),
        f AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid, doc_id ORDER BY dist, id) = 1 AS INTEGER) AS first FROM d),
        s AS (SELECT *, sum(first) OVER (PARTITION BY qid ORDER BY dist, id ROWS UNBOUNDED PRECEDING) AS seen FROM f)
        SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank, id, doc_id, round(dist, 6) AS dist FROM s WHERE seen <= {DOCS}"""


_RANGE = _top(f"SELECT qid, id, {_IP} AS dist FROM q, b WHERE {_IP} <= {EPS}", EPS_MOST)
_FLAT = _flat_sql()
ORACLE_SQL: dict[str, str] = {
    "flat_ip_topk": _FLAT,
    "flat_ip_topk_arrow": _FLAT,
    "flat_l2_topk": _flat_sql(_L2),
    "flat_l2_topk_arrow": _flat_sql(_L2),
    "filtered_topk": _flat_sql(where="doc_id % 2 = 0"),
    "range_eps_topk": f"WITH {_BASE} {_RANGE}",
    "doc_prefix_search": _prefix_sql(_IP),
    "doc_prefix_search_l2": _prefix_sql(_L2),
    "padded_range": f"WITH {_BASE}, near AS ({_RANGE}) SELECT q.qid, array_to_string(list_resize(coalesce(list(id ORDER BY rank) FILTER (id IS NOT NULL), []), {EPS_MOST}, -1), ',') AS ids FROM q LEFT JOIN near ON near.qid = q.qid GROUP BY q.qid",
    "padded_round_trip": f"WITH {_BASE} {_RANGE}",
    "ivf_upsert_remove": f"""WITH {_BASE}, moved AS (SELECT id + 1 AS id, v FROM b WHERE id % 11 = 3),
        u AS (SELECT id, v FROM b WHERE id NOT IN (SELECT id FROM moved) UNION ALL SELECT id, v FROM moved), n AS (SELECT * FROM u WHERE id NOT IN (SELECT id FROM b WHERE id % 7 = 0)) """
    + _top(f"SELECT qid, id, {_IP} AS dist FROM q, n"),
    "sharded_topk_merge": _FLAT,
    "shard_assignment": f"WITH {_BASE} SELECT id, CAST({_SPLIT} AS INTEGER) AS shard_id FROM b",
    "sorted_id_lists": f"SELECT qid, string_agg(id, ',' ORDER BY rank) AS ids FROM ({_FLAT}) GROUP BY qid",
    "flat_upsert_remove_share": f"""WITH {_BASE}, moved AS (SELECT id + 1 AS id, v FROM b WHERE id % 11 = 3),
        u AS (SELECT id, v FROM b WHERE id NOT IN (SELECT id FROM moved) UNION ALL SELECT id, v FROM moved), n AS (SELECT * FROM u WHERE id % 7 <> 0) """
    + _top(f"SELECT qid, id, {_IP} AS dist FROM q, n"),
    "index_round_trip": _FLAT,
    "sq_params": f"{_SQ} SELECT CAST(d - 1 AS INTEGER) AS d, round(minv, 6) AS minv, round(scale, 6) AS scale FROM sp",
    "sq_codes": f"{_SQ} SELECT id, CAST(d - 1 AS INTEGER) AS d, CAST(codes[d] AS INTEGER) AS code FROM sc, range(1, 65) t(d)",
    "sq_topk": f"{_SQ} " + _top(_SQ_PAIRS),
    "sq_twostage": f"{_SQ} " + _again(_SQ_PAIRS, P),
    "int_l2_topk": f"{_SQ}, qc AS (SELECT qid, list_transform(range(1, len(q) + 1), lambda i: greatest(0, least(255, floor((q[i] - lo[i]) / sc[i] + 0.5)))) AS qc FROM q, pl) "
    + _top("SELECT qid, id, CAST(list_sum(list_transform(range(1, len(qc) + 1), lambda i: (codes[i] - qc[i]) * (codes[i] - qc[i]))) AS BIGINT) AS dist FROM sc, qc", digits=None),
    "ivf_assignments": f"{_IVF} SELECT id, CAST(c AS INTEGER) AS cid FROM codes",
    "ivf_list_stats": f"{_IVF}, {_SIZES} SELECT count(*) AS nlist, count(*) FILTER (len > 0) AS non_empty, CAST(sum(len) AS BIGINT) AS total, round(avg(len), 6) AS avg_len, max(len) AS max_len, min(len) AS min_len, min(len) FILTER (len > 0) AS min_non_empty FROM sizes",
    "ivf_csr_offsets": f"{_IVF}, {_SIZES}, ids AS (SELECT c AS cid, string_agg(id, ',' ORDER BY id) AS ids FROM codes GROUP BY c) SELECT CAST(cid AS INTEGER) AS cid, CAST(coalesce(sum(len) OVER (ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, len, coalesce(ids, '') AS ids FROM sizes LEFT JOIN ids USING (cid)",
    "ivf_topk": _IVF_TOP,
    "ivf_topk_masked": _IVF_TOP,
    "ivf_full_probe": _FLAT,
    "ivf_work_counters": f"""{_IVF}, {_SIZES}, {_PROBES.format(n=NPROBE)}, {_ACTIVE}
        SELECT 'grouped' AS mode, count(DISTINCT b) AS batches, count(*) AS refine_groups, CAST(sum(nq * len) AS BIGINT) AS refine_pairs, CAST(0 AS BIGINT) AS skipped_pairs FROM work
        UNION ALL SELECT 'wasteful', count(DISTINCT b), count(*), CAST(sum(nb * len) AS BIGINT), CAST(sum((nb - nq) * len) AS BIGINT) FROM work""",
    "pq_codes": f"{_PQ} SELECT id, CAST(m AS INTEGER) AS m, CAST(c AS INTEGER) AS code FROM codes",
    "pq_adc_topk": f"{_PQ}, {_LUT} " + _top(_ADC),
    "pq_twostage": f"{_PQ}, {_LUT} " + _again(_ADC, P),
    "pq_partitioned_topk": f"{_PQ}, {_LUT}, placed AS (SELECT id, {_SPLIT} AS shard_id FROM b) " + _again(f"SELECT * FROM ({_ADC}) JOIN placed USING (id)", 50, "qid, shard_id"),
    "ivf_pq_topk": f"WITH {_BASE}, {_kmeans_sql(1, NLIST, ITERATIONS)}, {_PROBES.format(n=NPROBE)}, listed AS MATERIALIZED (SELECT qid, id FROM probes JOIN codes ON codes.c = cid), found AS ({_PQ}, {_LUT} {_ADC}) " + _again("SELECT * FROM found JOIN listed USING (qid, id)", P),
    "ivf_topk_wide": _WIDE["ivf"],
    "pq_twostage_wide": _WIDE["pq_twice"],
    "ivf_pq_topk_wide": _WIDE["ivf_pq"],
    "recall_by_method_wide": f"WITH {_BASE}, {_TRUTH} " + " UNION ALL ".join(_recall_sql(n, s) for n, s in _WIDE.items()),
    "recall_by_method": f"WITH {_BASE}, {_TRUTH} " + " UNION ALL ".join(_recall_sql(n, s) for n, s in (("sq", f"{_SQ} " + _top(_SQ_PAIRS)), ("ivf", _IVF_TOP), ("pq_twice", f"{_PQ}, {_LUT} " + _again(_ADC, P)))),
    "recall_per_query": f"WITH {_BASE}, {_TRUTH} SELECT truth.qid, round(count(f.id) / {K}.0, 6) AS recall FROM truth LEFT JOIN ({_IVF_TOP}) f ON f.qid = truth.qid AND f.id = truth.id GROUP BY truth.qid",
    "hnsw_topk": _FLAT,
    "hnsw_filtered": _flat_sql(where="doc_id % 2 = 0"),
    "hnsw_deleted": _flat_sql(where="id % 3 <> 0"),
    "hnsw_sharded": _FLAT,
    "ivf_hnsw_topk": _FLAT,
    "hnsw_range_eps": f"WITH {_BASE} {_RANGE}",
    "sharded_ivf_topk": _FLAT,
    "sharded_ivf_pq_topk": _FLAT,
    "sharded_ivf_hnsw_topk": _FLAT,
    "graph_integrity_zeros": f"WITH {_BASE} SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS self_links, CAST(0 AS BIGINT) AS repeated_links, CAST(0 AS BIGINT) AS dangling_links FROM b",
    "report_csv_scan": f"SELECT mode, threads, recall, latency_us, total_us FROM {_values('sel')}",
    "report_bench_scan": f"SELECT mode, threads, avg_recall, avg_latency_us, total_time_us FROM {_values('x86')}",
    "report_log_scan": f"SELECT recall, latency_us, total_us FROM {_values('sel')} ORDER BY line DESC LIMIT 1",
    "report_selected_summary": f"SELECT position, l.mode, threads, recall, latency_us, round(total_us / 1000, 6) AS total_ms, round((SELECT total_us FROM {_last('sel')} WHERE mode = 'seq') / total_us, 6) AS speedup_vs_seq FROM {_last('sel')} l JOIN {_pairs_sql(tuple(enumerate(reports.SUMMARY_MODES)), 'position, mode')} ON p.mode = l.mode",
    "report_variant_summary": f"SELECT *, CAST(row_number() OVER (ORDER BY avg_latency_us DESC, variant) AS INTEGER) AS place FROM (SELECT variant, min_by(label, line) AS label, round(avg(recall), 6) AS avg_recall, round(avg(latency_us), 6) AS avg_latency_us FROM {_values('var')} GROUP BY variant)",
    "report_best_threads": f"SELECT mode, threads, total_us, rows FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY total_us, line) AS w, count(*) OVER (PARTITION BY mode) AS rows FROM {_values('thr')}) WHERE w = 1",
    "report_ratios": f"SELECT slower, faster, round(a.total_us / b.total_us, 6) AS ratio FROM {_pairs_sql(reports.RATIOS, 'slower, faster')} JOIN {_last('sel')} a ON a.mode = slower JOIN {_last('sel')} b ON b.mode = faster",
    "report_trade_off": f"SELECT family, param_name, param_value, recall, latency_us, total_us FROM (SELECT *, row_number() OVER (PARTITION BY param_value ORDER BY line DESC) AS w FROM {_values('trd')} WHERE family = 'flat_pq') WHERE w = 1",
    "report_figure_series": f"SELECT mode, CAST(count(*) AS INTEGER) AS points, max(total_us) AS highest, string_agg(threads, ',' ORDER BY threads) AS xs, string_agg(CAST(total_us AS BIGINT), ',' ORDER BY threads) AS ys FROM {_values('thr')} WHERE mode IN ('pthread', 'hnsw_openmp') GROUP BY mode",
    "report_cross_platform": _platform_sql(_last("sel")),
    "report_cross_platform_threads": _platform_sql(f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY line) AS w FROM {_values('thr')} WHERE threads = 8) WHERE w = 1)"),
}
ORACLE_SQL["hnsw_documents"] = ORACLE_SQL["doc_prefix_search"]
# a row's distance to itself rounds to -0 in DuckDB and to 0 in Spark
ORACLE_SQL |= {f"{name}_hundredths": ORACLE_SQL[name].replace(_BASE, _ALL).replace("round(dist, 6)", "round(dist, 6) + 0.0") for name in SEARCHES}
