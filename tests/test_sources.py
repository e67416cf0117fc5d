"""Vector files, reports, configuration and the query stream."""

from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.operators import flat
from nearfold.sources import fbin, reports
from nearfold.streaming.search import search_stream


def test_vector_files(spark, tmp_path):
    x = np.arange(30, dtype=np.float32).reshape(10, 3)
    path = tmp_path / "a.fbin"
    path.write_bytes(fbin.vector_bytes(x))
    fbin.register(spark)
    read = spark.read.format("fbin").option("rowsPerPartition", "4").load(f"file://{path}")
    assert spark.read.format("fbin").option("limit", "4").load(str(path)).count() == 4
    assert read.rdd.getNumPartitions() == 3
    assert [r["vec"] for r in read.orderBy("id").collect()] == x.tolist()
    assert fbin.read_vectors(spark, str(path), limit=4).count() == 4
    assert [r["vec"] for r in fbin.read_vectors(spark, str(path)).orderBy("id").collect()] == x.tolist()
    gt = tmp_path / "gt.bin"
    gt.write_bytes(fbin.vector_bytes(np.array([[3, 1, -1], [2, 0, 5]]), "int32"))
    assert sorted(map(tuple, fbin.read_truth(spark, str(gt), 3).collect())) == [(0, 1, 3), (0, 2, 1), (1, 1, 2), (1, 2, 0), (1, 3, 5)]
    path.write_bytes(fbin.vector_bytes(x)[:-1])
    for load in (lambda: spark.read.format("fbin").load(str(path)).count(), lambda: fbin.read_vectors(spark, str(path)).count()):
        with pytest.raises(Exception, match="cut off"):
            load()


def test_reports(spark, tmp_path, monkeypatch):
    path = tmp_path / "r.csv"
    path.write_bytes("﻿mode,threads,recall,latency_us,total_us\nseq,1,0.9,10,200\na_b,8,0.8,5,100\n".encode())
    rows = reports.read_report(spark, str(path), "selected")
    assert [tuple(r) for r in rows.orderBy("threads").collect()] == [("seq", 1, 0.9, 10.0, 200.0), ("a_b", 8, 0.8, 5.0, 100.0)]
    out = str(tmp_path / "out")
    reports.append_report(rows, out)
    reports.append_report(rows, out)
    assert reports.read_report(spark, out, "selected").count() == 4
    assert "| seq | 1 |" in reports.markdown_table(rows.select("mode", "threads"))
    assert r"a\_b & 8 \\" in reports.latex_table(rows.select("mode", "threads"))
    assert reports.latex_table(rows.select("mode", "threads")).count(r"\hline") == 3
    odd = rows.unionByName(spark.createDataFrame([("<a & b>", 2, None, None, None)], rows.schema))
    bars = ElementTree.fromstring(reports.svg_bars(odd, "mode", "total_us"))
    tag = "{http://www.w3.org/2000/svg}"
    assert sorted(round(float(r.get("height"))) for r in bars.iter(f"{tag}rect")) == [0, 118, 236]
    assert "<a & b>" in [t.text for t in bars.iter(f"{tag}text")] and len(list(bars.iter(f"{tag}line"))) == 6
    lines = ElementTree.fromstring(reports.svg_lines(odd.unionByName(rows.withColumn("threads", F.col("threads") + 4)), "threads", "total_us", "mode"))
    assert [len(p.get("points").split()) for p in lines.iter(f"{tag}polyline")] == [2, 2] and len(list(lines.iter(f"{tag}rect"))) == 2
    assert {"seq", "a_b", "threads", "total_us"} <= {t.text for t in lines.iter(f"{tag}text")}
    assert "<svg" in reports.svg_lines(rows.limit(0), "threads", "total_us", "mode") and "<svg" in reports.svg_bars(rows.limit(0), "mode", "total_us")
    log = tmp_path / "l.txt"
    log.write_text("average recall: 0.5\naverage latency (us): 7\nx\naverage recall: 0.75\ntotal time (us): 1.5e3\n")
    r = reports.read_log(spark, str(log)).first()
    assert (r["recall"], r["latency_us"], r["total_us"]) == (0.75, 7.0, 1500.0)
    log.write_text("stage refine total (ms): 2.5\nstage refine total (ms): 3.5\ngpu batches: 4\nivf skipped pairs in wasteful baseline: 120\n")
    r = reports.read_log(spark, str(log), stages=True).first()
    assert (r["refine_ms"], r["batches"], r["skipped_pairs"], r["recall"], r["topk_ms"]) == (3.5, 4.0, 120.0, None, None)
    for kind, schema in reports.SCHEMAS.items():
        names = [c.split()[0] for c in schema.split(", ")]
        path.write_text(",".join(names) + "\n" + ",".join("7" for _ in names) + "\n")
        row = reports.read_report(spark, str(path), kind).first()
        assert list(row.asDict()) == names and {str(v).removesuffix(".0") for v in row} == {"7"}
    monkeypatch.setenv("ANN_IVF_NPROBE", "4")
    monkeypatch.setenv("ANN_MODE", "ivf_pq")
    monkeypatch.setenv("ANN_GPU_BATCH", "many")
    assert reports.SearchConfig.read(topk=3) == reports.SearchConfig(mode="ivf_pq", nprobe=4, topk=3)
    for bad in (dict(nprobe=1000), dict(mode="tree"), dict(engine="gpu"), dict(batch=0)):
        with pytest.raises(ValueError):
            reports.SearchConfig.read(**bad)
    assert reports.data_path("/a/", "b") == reports.data_path("/a", "b") == "/a/b"


def test_stream(spark, tmp_path):
    base = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, vec array<float>")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "qid long, q array<float>").write.parquet(source)
    stream = spark.readStream.schema("qid long, q array<float>").parquet(source)
    query = search_stream(stream, lambda q: flat.flat_search(base, q, 2), out, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(out).select("qid", "rank", "id").orderBy("qid", "rank").collect()
    assert [tuple(r) for r in got] == [(1, 1, 19), (1, 2, 18), (2, 1, 0), (2, 2, 1)]
    assert spark.read.parquet(out).where(F.col("batch_id") == 0).count() == 4
