"""Every registered query of the engine against its SQL, over the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry_point

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry_point._engine.QUERIES]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or str(value) == "<NA>" or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    return value


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(repr(tuple(map(plain, r))) for r in frame[names].astype(object).values.tolist())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    found = rows(entry_point.queries()[name](spark, DATA).toPandas())
    if name in entry_point.oracle_sql():
        assert found == rows(duck.sql(entry_point.oracle_sql()[name]).df())
    else:
        assert found[1]


def test_entry(spark):
    frame = entry_point.entry(spark)
    assert frame.columns == ["query_id", "context", "n_citations"] and frame.count() > 0


def test_plans_have_no_cross_joins(spark):
    for name in ("ad_cut", "neighbor_fill", "sparse_topk", "dense_topk", "point_lookup"):
        plan = entry_point.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_weighted_ranks_at_equal_products(spark, tmp_path):
    """Scores whose products with the weights differ in the last digit alone stand in one order: section and place are multiplied first."""
    import duckdb

    talk = [(c, t, "user" if t % 2 == 0 else "assistant", "x" * ((c * 37 + t * 11) % 997)) for c in range(1500) for t in range(4)]
    spark.createDataFrame(talk, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    with duckdb.connect() as own:
        own.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        for name in ("position_weight", "group_top_videos"):
            assert rows(own.sql(entry_point.oracle_sql()[name]).df()) == rows(entry_point.queries()[name](spark, str(tmp_path)).toPandas())
