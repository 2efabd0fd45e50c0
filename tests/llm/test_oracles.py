import pytest

from folioscope.llm import queries

from ..compare import DATA, engine, same


@pytest.fixture(scope="module")
def con():
    return engine()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    same(spark, con, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, con, name):
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0


def test_neighbours_of_every_vector(spark, con):
    got = {}
    for r in queries.queries()["p2_neighbours"](spark, DATA).collect():
        got.setdefault(r.vec_id, set()).add(r.near_vec_id)
    valid = "SELECT vec_id, min(embedding)::DOUBLE[] AS v FROM chunk_vectors WHERE len(embedding) = 64 GROUP BY vec_id"
    valid = f"SELECT vec_id FROM ({valid}) WHERE isfinite(list_sum(list_transform(v, lambda x: x * x))) AND list_sum(list_transform(v, lambda x: x * x)) > 0"
    assert got.keys() == {x for (x,) in con.sql(valid).fetchall()}
    assert all(len(v) == 5 and k not in v for k, v in got.items())
