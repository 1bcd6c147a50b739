"""The stored cells against exact neighbours, and exact percentiles against numpy, with brackets cut small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.plans import cells, quantiles
from lodestar.plans.search import nearest_vectors


def rows(df):
    return {(r.query_id, r.rk): (r.vec_id, r.cosine) for r in df.collect()}


def recall(got, want):
    of = lambda rows: {(q, i) for (q, _), (i, _) in rows.items()}
    return len(of(got) & of(want)) / len(want)


def test_recall_of_the_table(spark):
    """Vectors without clusters: the fitted number of cells is large, and the recall is what was asked for."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0")
    index = cells.build_cells(vectors)
    want = rows(nearest_vectors(vectors, asked, 20))
    got = rows(index.nearest(asked, 20))
    assert len(got) == len(want) and recall(got, want) >= 0.95
    assert rows(index.nearest(asked, 20, probes=len(index.centres))) == want


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    x = np.repeat(centres, 100, 0) + 0.25 * rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_stored_cells_are_read_by_need(spark, clustered, tmp_path):
    built = cells.build_cells(clustered)
    built.save(str(tmp_path / "c"))
    index = cells.load_cells(spark, str(tmp_path / "c"))
    assert index.probes == built.probes <= 8 and len(index.centres) == 64
    asked = clustered.where("vec_id % 20 = 0")
    want, got = rows(nearest_vectors(clustered, asked, 20)), rows(index.nearest(asked, 20))
    assert recall(got, want) >= 0.95 and got == rows(built.nearest(asked, 20))
    # what one query opens
    one = clustered.where("vec_id = 0")
    opened = [r.cell for r in index.probed(one).select("cell").distinct().collect()]
    files = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    assert files(index.cells.where(F.col("cell").isin(opened))) <= len(opened) < files(index.cells) / 6


def test_vectors_that_take_no_part(spark, clustered):
    nan, inf = float("nan"), float("inf")
    odd = [(9000, None), (9001, [0.0] * 32), (9002, [nan] * 32), (9003, [inf] + [1.0] * 31), (9004, [None] + [1.0] * 31), (9005, [1.0]), (None, [1.0] * 32)]
    both = clustered.limit(300).unionByName(spark.createDataFrame(odd, clustered.schema))
    index = cells.build_cells(both)
    assert index.cells.count() == 300
    assert {r.query_id for r in index.nearest(both.where("vec_id >= 9000 or vec_id = 5 or vec_id is null"), 3).collect()} <= {5}
    none = cells.build_cells(clustered.limit(0))
    assert none.nearest(clustered, 3).count() == 0 and index.nearest(clustered.limit(0), 3).count() == 0


def test_large_cells_are_dealt_out(spark, monkeypatch):
    """A third of the vectors are copies of one; parts and turns leave the result as it is."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.tile(rng.normal(size=8), (300, 1)), rng.normal(size=(600, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(cells, "BLOCK", 64)
    monkeypatch.setattr(cells, "QUERIES", 4)
    index = cells.build_cells(vectors, cells=5)
    assert index.parts.max() >= 5
    asked = vectors.where("vec_id % 20 = 0")
    assert rows(index.nearest(asked, 7, probes=5)) == rows(nearest_vectors(vectors, asked, 7))


WANTED = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p95": 0.95, "p100": 1.0}


@pytest.mark.parametrize("most", [100_000, 7])
def test_percentiles(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "VALUES", most)
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=4000), "b": np.repeat([1.5, 2.5], [3000, 1]), "c": 10.0 ** rng.uniform(-300, 300, 999), "d": np.asarray([7.0]), None: rng.integers(0, 50, 5000).astype(float), "e": np.asarray([-1.0, 1.0])}
    table = [(k, float(v)) for k, vs in values.items() for v in vs] + [("f", None), ("a", None)]
    df = spark.createDataFrame(table, "g string, x double")
    got = {r.g: r for r in quantiles.percentiles(df, ["g"], F.col("x"), WANTED).collect()}
    assert set(got) == {*values, "f"} and all(got["f"][n] is None for n in WANTED)
    for k, vs in values.items():
        for name, p in WANTED.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-9), (k, name)
    whole = quantiles.percentiles(df, [], F.col("x"), {"m": 0.5}).collect()
    assert len(whole) == 1 and whole[0].m == pytest.approx(np.quantile(np.concatenate(list(values.values())), 0.5))
    assert [r.m for r in quantiles.percentiles(df.limit(0), [], F.col("x"), {"m": 0.5}).collect()] == [None]


def test_merged_sketches_keep_ranks(spark):
    from lodestar import catalog

    folder = "/root/testdata/sf0.01"
    values = {}
    for r in spark.read.parquet(f"{folder}/events.parquet").select("event_type", "value").where("value is not null").collect():
        values.setdefault(r.event_type, []).append(r.value)
    for r in catalog.queries()["AGG04_percentile_merged"](spark, folder).collect():
        v = np.sort(values[r.event_type])
        assert r.n == len(v)
        for got, q in ((r.p50, 0.5), (r.p90, 0.9)):
            assert np.searchsorted(v, got, "left") - 0.01 * len(v) <= q * len(v) <= np.searchsorted(v, got, "right") + 0.01 * len(v)
