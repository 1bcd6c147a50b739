"""Semantic and adaptive chunks against a plain version over the whole corpus."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestar import catalog
from lodestar.operators import semantic
from lodestar.operators.greedy import pack_paragraphs, pack_sentences, sentences, split_by_size


def words(s):
    return Counter(zlib.crc32(w.encode()) % semantic.DIMS for w in re.findall(r"\w+", s.lower()))


def plain(texts, least):
    """Chunks of every text by dense idf vectors."""
    said = [sentences(t or "") for t in texts]
    every = [words(s) for x in said for s in x]
    df = Counter(b for w in every for b in w)
    at = {b: i for i, b in enumerate(df)}
    idf = np.asarray([math.log((1 + len(every)) / (1 + df[b])) + 1 for b in at])
    out = []
    for x in said:
        v = np.zeros((len(x), len(at)))
        for i, s in enumerate(x):
            for b, n in words(s).items():
                v[i, at[b]] = n * idf[at[b]]
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        runs = []
        for i, s in enumerate(x):
            if not i or v[i - 1] @ v[i] < least:
                runs.append([])
            runs[-1].append(s)
        out.append([c for r in runs for c in (split_by_size(" ".join(r)) if len(" ".join(r).split()) > 800 else [" ".join(r)])])
    return out


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(80)


def test_chunks_equal_a_plain_version(table):
    rows = table.collect()
    want = plain([r.text for r in rows], semantic.IDF_SIMILAR)
    got = {}
    for r in semantic.semantic_chunks(table).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {r.doc_id: w for r, w in zip(rows, want, strict=True) if w}
    assert any(1 < len(w) < len(sentences(r.text)) for r, w in zip(rows, want, strict=True) if w)
    for r in rows:
        assert " ".join(got.get(r.doc_id, [])) == " ".join(sentences(r.text or ""))


def test_adaptive_chooses(spark):
    many = " ".join(f"Alpha beta gamma {i}." for i in range(12)) + " " + " ".join(f"Kappa lambda mu {i}." for i in range(12))
    docs = spark.createDataFrame([(1, "\n\n".join("one two three" for _ in range(8)), "x"), (2, many, "x"), (3, "Short one. Two.", "x"), (4, None, "x"), (5, "", "x"), (2, many, "x")], "doc_id long, text string, chunk string")
    got = {}
    for r in semantic.semantic_chunks(docs, chunker=semantic.adaptive).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert set(got) == {1, 2, 3} and got[1] == pack_paragraphs(docs.first().text) and got[3] == pack_sentences("Short one. Two.")
    assert len(got[2]) == 4 and got[2][0].endswith("gamma 11.") and got[2][2].startswith("Kappa lambda")
    assert semantic.semantic_chunks(docs.limit(0)).count() == 0


def test_large_runs_go_to_the_size_split(spark):
    long = " ".join("same words again and again." for _ in range(400))
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    rows = semantic.semantic_chunks(docs).orderBy("place").collect()
    assert [r.chunk for r in rows] == split_by_size(long) and len(rows) == 3 and max(r.tokens for r in rows) <= 800


def test_an_embedder_decides(spark):
    docs = spark.createDataFrame([(1, "Red one. Red two. Blue three. Blue four.")], "doc_id long, text string")
    colour = lambda said: np.asarray([[1.0, 0.0] if s.startswith("Red") else [0.0, 2.0] for s in said])
    assert [r.chunk for r in semantic.semantic_chunks(docs, colour).orderBy("place").collect()] == ["Red one. Red two.", "Blue three. Blue four."]


def test_queries_cover_every_document(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for name in ("CHK08_semantic_chunks", "CHK10_adaptive_chunks"):
        assert {r.doc_id for r in catalog.queries()[name](spark, data).select("doc_id").distinct().collect()} == {i for i, t in texts.items() if sentences(t or "")}
