"""Every registered search query against its SQL."""

import pytest
from oracle import difference, sql_rows

from nearfold.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    rows = QUERIES[name](spark, SF).toPandas()
    assert len(rows)
    if name in ORACLE_SQL:
        assert difference(rows, sql_rows(SF, ORACLE_SQL[name])) == ""
    else:
        assert name in ("graph_integrity", "hnsw_beam_recall", "hnsw_beam_topk", "hnsw_work")


def test_graph_integrity(spark):
    row = QUERIES["graph_integrity"](spark, SF).first()
    assert row.nodes == 480 and row.min_in_degree > 0
    assert row.self_links == row.repeated_links == row.dangling_links == 0


def test_beams_stop_early_and_reach_recall(spark):
    """Working beam widths: recall grows with the width and reaches nine tenths, work stays below a full scan."""
    recall = QUERIES["hnsw_beam_recall"](spark, SF).toPandas().set_index("method")["avg_recall"]
    assert list(recall[["ef=10", "ef=32", "ef=64", "ef=128"]]) == sorted(recall) and recall["ef=64"] >= 0.9
    work = QUERIES["hnsw_work"](spark, SF).toPandas().groupby("ef").mean()
    assert work["distances"].is_monotonic_increasing and work["hops"].is_monotonic_increasing
    assert work["distances"][10] < 480 / 2 and (work["hops"] <= work["distances"]).all()
    assert len(QUERIES["hnsw_beam_topk"](spark, SF).toPandas()) == 200


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 200


def test_upsert_remove_reaches_the_whole_table(spark):
    """Ids far above 400 are found, and removed ones are not; the comparison with SQL is in test_query."""
    large = "/root/testdata/sf0.1"
    ids = QUERIES["flat_upsert_remove_share"](spark, large).toPandas()["id"]
    assert (ids > 400).mean() > 0.5 and (ids % 7 != 0).all()
    assert difference(QUERIES["flat_upsert_remove_share"](spark, large).toPandas(), sql_rows(large, ORACLE_SQL["flat_upsert_remove_share"])) == ""


def test_hundredths_are_the_query_set(spark):
    """Every hundredth row is a query and every row can be found, ids below 20 too; a query finds itself first."""
    rows = QUERIES["flat_ip_topk_arrow_hundredths"](spark, "/root/testdata/sf0.1").toPandas()
    assert sorted(rows["qid"].unique()) == list(range(0, 2000, 100))
    assert (rows[rows["rank"] == 1]["qid"] == rows[rows["rank"] == 1]["id"]).all()
    assert (rows["id"] < 20).any() and all(name.removesuffix("_hundredths") in ORACLE_SQL for name in QUERIES if name.endswith("_hundredths"))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_wide_searches_reach_recall(spark, sf):
    """Held-out queries find nine tenths of their true neighbours, on the larger table too."""
    recall = QUERIES["recall_by_method_wide"](spark, sf).toPandas().set_index("method")["avg_recall"]
    assert len(recall) == 3 and (recall >= 0.9).all(), recall
