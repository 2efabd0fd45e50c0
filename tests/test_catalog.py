import importlib.util

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from folioscope.plans import catalog


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
    core = {k for k in q if not (k[0] == "p" and k[1].isdigit())}
    assert core == core & set(o)
    assert importlib.util.find_spec("folioscope.llm") is None or sum(k.endswith("_found") for k in q) == 8


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:3] == ["query_id", "rank", "chunk_key"]


def test_quick_rounding_is_that_of_sql(spark):
    """bm25_scores has a row for nearly every pair: each is rounded without a decimal number, and as SQL rounds."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(0)
    x = [0.0, -0.0, -0.00001, 1e-300, 0.00005, -0.00005, 2.5, 123456789.98765, *rng.normal(0, 20, 20_000).tolist(), *rng.normal(0, 1e-4, 2_000).tolist()]
    got = [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, x double").select("i", catalog.quick_r4("x").alias("y")).orderBy("i").collect()]
    given = pa.table({"i": range(len(x)), "x": x})  # noqa: F841
    want = [r[0] for r in duckdb.sql("SELECT round(x, 4) + 0.0::DOUBLE FROM given ORDER BY i").fetchall()]
    assert got == want and not np.signbit(np.array(got)[np.array(got) == 0]).any()
    plan = entry.queries()["bm25_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan
