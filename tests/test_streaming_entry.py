"""Streaming ingest and the driver contract."""

import importlib.util
import os


from textprov.streaming import replies as rs

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_ingest_exactly_once(spark, tmp):
    df = spark.createDataFrame([("r1", "x", "ok", 1, None), ("r2", "y", "ok", 2, None)],
                               "request_id string, reply string, status string, attempts int, error string")
    folder, table, ck = f"{tmp}/in", f"{tmp}/table", f"{tmp}/ck"
    rs.write_reply_files(df, folder)
    t1 = rs.run_ingest(spark, folder, table, ck)
    assert t1.count() == 2
    more = spark.createDataFrame([("r2", "y", "ok", 2, None), ("r3", "z", "ok", 1, None)],
                                 "request_id string, reply string, status string, attempts int, error string")
    rs.write_reply_files(more, folder)
    t2 = rs.run_ingest(spark, folder, table, ck)
    assert sorted(r.request_id for r in t2.collect()) == ["r1", "r2", "r3"]


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_contract(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"source", "label", "n", "mean_tokens", "min_tokens", "max_tokens", "n_kept"}
    qs, sql = m.queries(), m.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 90


def test_all_queries_build_plans(spark):
    """Every query returns a DataFrame with a schema on the smallest tables."""
    m = _entry()
    skip = {"round_summary", "fit_score", "pool_build", "pool_append", "reply_ingest"}
    for name, fn in m.queries().items():
        if name in skip or name == "pipeline" or name.startswith("op"):  # these have tests of their own
            continue
        df = fn(spark, "/root/testdata/sf0.001")
        assert len(df.schema.fields) > 0, name
