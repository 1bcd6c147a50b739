"""Similarities of all pairs by blocks against the SQL, and on vectors that have none."""

import duckdb
import numpy as np
import pytest

from lodestar import catalog
from lodestar.operators import retrieval


@pytest.mark.parametrize("size", [retrieval.VECTORS, 7])
def test_blocks_equal_the_sql(spark, monkeypatch, size):
    monkeypatch.setattr(retrieval, "VECTORS", size)
    monkeypatch.setattr(retrieval, "STRIP", 3)
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.standard_normal(5).astype(np.float32)], k % 3) for k in range(60)]
    rows += [(60, [0.0078125, 0.0, 0.0, 0.0, 0.0], 0), (61, [1.0, 0.0, 0.0, 0.0, 0.0], 0), (5, rows[8][1], 2), (62, rows[1][1], None), (None, rows[1][1], 1)]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    want = con.execute(catalog.oracle_sql()["RET07_similarities"]).fetchall()
    got = catalog.apply("RET07_similarities", spark, {"embeddings": spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")})
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_vectors_without_a_product(spark):
    rows = [(1, [1.0, 2.0], 1), (2, None, 1), (3, [1.0, None], 1), (4, [1.0], 1), (5, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {(r.a, r.b): r.dot for r in catalog.apply("RET07_similarities", spark, {"embeddings": df}).collect()}
    assert len(got) == 25 and {k: v for k, v in got.items() if v is not None} == {(1, 1): 5.0, (1, 5): 10.0, (5, 1): 10.0, (5, 5): 20.0, (4, 4): 1.0}
    assert catalog.apply("RET07_similarities", spark, {"embeddings": df.limit(0)}).count() == 0


def test_rows_of_vectors_are_dealt_not_pairs(spark, data):
    plan = catalog.apply("RET07_similarities", spark, catalog.reader(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan


def test_a_vector_travels_once_for_few_blocks(spark):
    """Large labels have few blocks, vectors travel as they are, and unique ids are not joined."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.standard_normal(3).astype(np.float32)], k % 2) for k in range(30)]
    plan = catalog.apply("RET07_similarities", spark, {"embeddings": spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")})._jdf.queryExecution().executedPlan().toString()
    assert "as array<double>" not in plan and "SortMergeJoin" not in plan and retrieval.VECTORS >= 1 << 16


def test_tiles_equal_the_products(spark, monkeypatch):
    """Two blocks of a label, met in tiles; both orders of each pair, each once."""
    monkeypatch.setattr(retrieval, "TILE", 8)
    monkeypatch.setattr(retrieval, "STRIP", 3)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((50, 4)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = catalog.apply("RET07_similarities", spark, {"embeddings": df}).collect()
    assert len(got) == 2500 and {(r.a, r.b) for r in got} == {(a, b) for a in range(50) for b in range(50)}
    assert all(abs(r.dot - x[r.a] @ x[r.b]) < 1e-6 for r in got)
