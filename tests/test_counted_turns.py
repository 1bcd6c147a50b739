"""N-gram counts of turns against the SQL, on repeated, null, empty and short turns; and what is shuffled."""

import duckdb
import pytest

from lodestar import catalog

TURNS = [
    (0, 0, "The cat sat on a mat, the cat"), (0, 1, "the cat  sat on\ta Mat the cat"), (0, 1, "a cat sat on the mat"), (0, 2, ""), (0, 3, None), (0, 4, "x"),
    (1, 0, "one"), (1, 1, "one"), (2, 0, "one two"), (2, 1, "one"), (3, 0, None), (3, 1, None), (4, 0, "éa b c d e"), (4, 1, "éa b c d e f"), (5, 2, "alone"), (None, 0, "a b"), (None, 1, "a b"), (6, None, "a b"), (6, 0, "a b"),
]
NAMES = ("EVL08_rouge_1", "EVL08_rouge_2", "EVL09_corpus_bleu")


@pytest.mark.parametrize("rows", [TURNS, TURNS[6:10], TURNS[:0]], ids=["all", "short", "none"])
@pytest.mark.parametrize("name", NAMES)
def test_counts_equal_the_sql(spark, name, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn int, text string").selectExpr("*", "'user' as role")
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn int, text varchar, role varchar)")
    if rows:
        con.executemany("insert into conversations values (?, ?, ?, 'user')", rows)
    want = con.execute(catalog.oracle_sql()[name]).fetchall()
    got = catalog.apply(name, spark, {"conversations": df})
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", NAMES)
def test_grams_are_not_shuffled(spark, data, name):
    plan = catalog.apply(name, spark, catalog.reader(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate posexplode" not in plan
