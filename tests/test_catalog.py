"""Every operator runs, and gives what its oracle SQL gives in DuckDB."""

import math

import duckdb
import pytest

from lodestar import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) and math.isfinite(value) else repr(value)


@pytest.mark.parametrize("name", catalog.names())
def test_operator_equals_oracle(spark, duck, name):
    frame = catalog.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    if name not in catalog.oracle_sql():
        assert columns
        return
    found = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_operators_run_over_given_tables(spark):
    docs = spark.createDataFrame([(1, "a  b\r\n\r\n\r\n\r\nc-\nd", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    assert catalog.apply("TXT01_normalize_whitespace", spark, {"documents": docs}).first().cleaned == "a b\n\ncd"


def test_all_rows_are_asked(spark):
    """Ids that no modulo filter would let through, and what stands late in a text."""
    vectors = spark.createDataFrame([(k, [float(k), 1.0], 1) for k in (1, 2, 3)], "vec_id long, embedding array<float>, label int")
    assert catalog.apply("RET07_similarities", spark, {"embeddings": vectors}).count() == 9
    docs = spark.createDataFrame([(k, "filler " * 100 + f"alpha beta gamma word{k}", "en", "s", 10 * k) for k in (1, 2, 4)], "doc_id long, text string, lang string, source string, n_chars long")
    asked = spark.createDataFrame([(1, "alpha beta gamma word2")], "item_id long, text string")
    found = catalog.apply("SET02_intersection_coverage", spark, {"documents": docs, "benchmark": asked}).collect()
    assert {r.doc_id: r.shared for r in found} == {1: 3, 2: 4, 4: 3}
    assert [r.doc_id for r in catalog.apply("TOP03_sort_with_fallback", spark, {"documents": docs}).orderBy("rank").collect()] == [4, 2, 1]
    near = catalog.apply("WIN02_neighbour_expansion", spark, {"documents": docs, "benchmark": asked.selectExpr("item_id", "'word2' as text")}).collect()
    assert {(r.query_id, r.doc_id, r.context_type) for r in near} == {(1, 2, "hit"), (1, 1, "preceding"), (1, 4, "following")}


def test_dense_list_sees_whole_texts(spark):
    docs = spark.createDataFrame([(1, "filler " * 100 + "needle in the haystack", "en", "s", 722), (2, "filler of another kind", "en", "s", 22), (3, "plain", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    asked = spark.createDataFrame([(1, "needle in the haystack")], "item_id long, text string")
    fused = catalog.apply("FUS01_reciprocal_rank_fusion", spark, {"documents": docs, "benchmark": asked, "part": docs}).collect()
    assert {r.doc_id: r.dense_rank for r in fused} == {1: 1}
    gold = catalog.apply("EVL06_retriever_comparison", spark, {"documents": docs, "benchmark": asked, "part": docs}).collect()
    assert {r.retriever: r.recall_hit_10 for r in gold}["dense"] == 1


def test_evidence_is_the_whole_text(spark):
    docs = spark.createDataFrame([(k, " ".join(f"term{i:04d}" for i in range(60)), "en", "s", 539) for k in (4, 5, 6)], "doc_id long, text string, lang string, source string, n_chars long")
    late = {r.doc_id: r.score for r in catalog.apply("VER01_overlap_score", spark, {"documents": docs}).collect()}
    assert min(late.values()) == 1
