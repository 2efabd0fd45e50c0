import os

import pytest

from folioscope import session


def hinted(df):
    return "broadcast" in df._jdf.queryExecution().logical().toString().lower()


def test_a_broadcast_is_bounded_in_rows_and_bytes(spark):
    df = spark.range(10).selectExpr("id", "repeat('x', 1000) as t", "array('ab', 'c') as a")
    assert hinted(session.broadcast_if_small(df)) and hinted(session.broadcast_if_small(df.limit(0)))
    assert not hinted(session.broadcast_if_small(df, rows=9))
    assert not hinted(session.broadcast_if_small(df, size=10_000))


def test_staged_tables_last_until_they_are_released(spark, monkeypatch):
    monkeypatch.setattr(session, "_STAGED", [])
    df = session.staged(spark.range(5), "five")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    session.release()
    assert not os.path.exists(path) and session._STAGED == []


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:
            @staticmethod
            def get(name, default=None):
                return default

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster)
