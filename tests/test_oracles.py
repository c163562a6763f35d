"""Every registered query of the library against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from strandline.plans import catalogue_queries, queries, raster_queries  # noqa: F401
from strandline.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    for frame in (got, want):
        for c in columns:
            if not pd.api.types.is_numeric_dtype(frame[c]):
                frame[c] = frame[c].astype(str)
            else:
                frame[c] = frame[c].astype(float)
    key = lambda f: f[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(key(got), key(want), check_dtype=False, rtol=1e-9)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_training_vectors_of_odd_values(spark, tmp_path):
    """The float next to -0.1, ids past what a double holds, and values, vectors and labels that are missing."""
    nan, inf, rows = float("nan"), float("inf"), []
    for k, vector in enumerate([[-0.1, 0.5, 0.25], [-0.10000001, 0.5], [0.25, None, 0.5], [nan, 1.0], [inf, -inf], [None, None], [], None]):
        rows += [(k, vector, k), (2**53 + k, vector, None), (-k - 1, vector, 1234 + k), (2**63 - 1 - k, vector, -k)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = duck.execute(ORACLE_SQL["training_vectors"]).fetchall()
    got = [tuple(r) for r in QUERIES["training_vectors"](spark, str(tmp_path)).select("vec_id", "label", "total").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) == 32 and (0, 0, 0.65) in want
