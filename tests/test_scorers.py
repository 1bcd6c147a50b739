"""Interfaces for models, and their defaults."""

import pandas as pd
from pyspark.sql import functions as F

from lodestar.functions import scorers as s


def test_rerank_passes_through_or_scores(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, "alpha beta", "nothing here"), (1, 11, 0.1, "alpha beta", "alpha beta gamma")], "query_id long, doc_id long, score double, query string, content string")
    assert [r.doc_id for r in s.rerank(hits).orderBy("rank").collect()] == [10, 11]
    assert [r.doc_id for r in s.rerank(hits, s.term_overlap).orderBy("rank").collect()] == [11, 10]


def test_embed_generate_transcribe(spark):
    texts = spark.createDataFrame([("a b",), (None,)], "text string")
    v = [r.embedding for r in s.embed(texts, dims=8).collect()]
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-5 and not any(v[1])
    prompts = spark.createDataFrame([("p",)], "prompt string")
    assert s.generate(prompts).first().generated == "Insufficient evidence"
    assert s.generate(prompts, lambda p: p + "!").first().generated == "p!"
    assert s.generate(prompts, fallback=F.upper).first().generated == "P"
    files = spark.createDataFrame([(bytearray(b"x"),)], "content binary")
    assert s.transcribe(files).first().text == ""
    assert s.term_overlap(pd.Series(["one two"]), pd.Series(["one"]))[0] == 0.65
