"""The k best by bounds of blocks: the same rows as scoring everything, with a part of the postings read."""

import pytest
from pyspark.sql import functions as F

from lodestar.plans import search
from lodestar.plans.search import best, build_index, load_index


def rows(df):
    return sorted(tuple(r[c] for c in ("query_id", "doc_id", "score", "rk")) for r in df.collect())


def every(index, queries, k, *columns):
    return rows(best(index.score(queries, *columns).where("score > 0"), k))


@pytest.mark.parametrize("k", [1, 10, 50])
def test_top_equals_all_scores(spark, data, k):
    docs, asked = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    index = build_index(docs)
    assert rows(index.top(asked, k)) == every(index, asked, k)


def test_under_half_of_the_postings_is_read(spark):
    folder = "/root/testdata/sf0.1"
    docs, asked = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    index = build_index(docs)
    read, whole = index.postings_read(asked, 10)
    assert whole > 8_000_000 and read < 0.5 * whole
    assert rows(index.top(asked, 10)) == every(index, asked, 10)


def test_copies_ties_and_names(spark, tmp_path):
    """More copies than k in every segment, ids that are texts, a query that repeats words, one without a hit."""
    texts = [(f"d{i:05d}", "same words in all of these copies") for i in range(3000)] + [(f"e{i}", f"rare{i} words words {'long ' * (i % 40)}") for i in range(300)] + [("x", None), ("y", ""), ("z", "!!!")]
    docs = spark.createDataFrame(texts, "name string, body string").repartition(4)
    asked = spark.createDataFrame([(1, "same words rare7 words"), (2, "nothing known"), (3, None), (4, "copies"), (5, "RARE7 rare8 long long")], "q long, text string")
    index = build_index(docs, "name", "body")
    for at in (index, None):
        if at is None:
            index.save(str(tmp_path / "i"))
            at = load_index(spark, str(tmp_path / "i"))
        got = rows(at.top(asked, 7, "q"))
        assert got == every(index, asked, 7, "q") and {r[0] for r in got} == {1, 4, 5}
        assert [r[1] for r in got if r[0] == 4] == [f"d{i:05d}" for i in range(7)]
    presence = index.hits(asked, "q", "text").where(F.length("term") >= 5).groupBy("query_id", "doc_id").agg(F.round(F.sum("idf"), 6).alias("score"))
    assert rows(index.top(asked, 7, "q", presence=5)) == rows(best(presence.where("score > 0"), 7))


def test_nothing_to_index_and_nothing_asked(spark):
    docs, asked = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert build_index(docs.limit(0)).top(asked, 3).count() == 0
    assert build_index(docs).top(asked.limit(0), 3).count() == 0
    assert build_index(docs).postings_read(asked, 3) == (0, 1)  # a term of every document has a negative idf: no document can have a score over 0


def test_many_queries_take_turns(spark, data, monkeypatch):
    docs, asked = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    index = build_index(docs)
    want = every(index, asked, 5)
    monkeypatch.setattr(search, "FEW_TERMS", 100)
    assert rows(index.top(asked, 5)) == want


def test_kept_tables_are_bounded(spark, data, monkeypatch):
    from lodestar import catalog
    from lodestar.plans import prepared

    get, made = catalog.reader(spark, data), []
    monkeypatch.setattr(prepared, "MOST_KEPT", 2)
    monkeypatch.setattr(prepared, "_KEPT", {})
    ask = lambda name: prepared._once(name, get, ("nation",), lambda: made.append(name) or name)
    assert [ask(n) for n in "aababca"] == list("aababca") and made == ["a", "b", "c", "a"]
    prepared.release()
    assert ask("a") == "a" and made[-1] == "a" and len(made) == 5
