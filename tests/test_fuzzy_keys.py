"""Fuzzy hits against the SQL on many queries that are nearly alike, and the keys by which they meet."""

import random

import duckdb

from lodestar import catalog
from lodestar.operators import caching


def _made() -> list[tuple]:
    rng, rows = random.Random(4), []
    for k in range(60):
        base = "".join(rng.choice("abcdefgh é") for _ in range(rng.choice((2, 3, 18, 25, 60, 150, 400))))
        for j in range(5):
            text = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                text.insert(rng.randrange(len(text) + 1), rng.choice("xyz")) if rng.random() < 0.5 or not text else text.pop(rng.randrange(len(text)))
            rows.append((rng.randrange(200), rng.randrange(9), rng.choice(("user", "user", "assistant")), "".join(text)))
    return list({r[:2]: r for r in rows}.values()) + [(300, 0, "user", None), (None, 0, "user", "abc"), (301, 0, "user", "")]


def test_similar_queries_share_a_key():
    pairs = 0
    texts = [r[3] for r in _made() if r[3]]
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    keys = [list(caching.gram_keys(t)) for t in texts]
    for i, a in enumerate(grams):
        for j, b in enumerate(grams):
            if a and len(a) <= len(b) and len(a & b) / len(a | b) >= caching.FUZZY:
                pairs += i != j
                assert {k for k, own, _ in keys[i] if own} & {k for k, _, _ in keys[j]}
    assert pairs > 50 and all(len(k) <= 3 * (2 + 0.06 * len(g)) for k, g in zip(keys, grams, strict=True))


def test_hits_equal_the_sql(spark):
    rows = _made()
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = con.execute(catalog.oracle_sql()["CAC02_fuzzy_hit"]).fetchall()
    got = catalog.apply("CAC02_fuzzy_hit", spark, {"conversations": spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")})
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 20
