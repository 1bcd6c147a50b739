"""Interfaces for what a model would do, with defaults that need none.

A scorer is any callable over batches of texts; pass one where a model is at hand. The defaults are
the fallbacks: passthrough ranking, term overlap, extraction, empty captions and transcripts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class PairScorer(Protocol):
    """Scores of (query, passage) pairs: a cross-encoder or an entailment model."""

    def __call__(self, queries: pd.Series, passages: pd.Series) -> pd.Series: ...


class Embedder(Protocol):
    """Rows of vectors for a batch of texts, images' captions or queries."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    """Texts for prompts: planning, expansion, answers, judging."""

    def __call__(self, prompts: pd.Series) -> pd.Series: ...


class Transcriber(Protocol):
    """Text of binary content: captions, recognised text, transcripts, pages of a document."""

    def __call__(self, content: bytes) -> str: ...


def nothing(content: bytes) -> str:
    """The default where a binary needs a model: no text."""
    return ""


def term_overlap(queries: pd.Series, passages: pd.Series) -> pd.Series:
    """Share of the query's words of three characters or more that the passage has, times 1.3, at most 1."""
    words = lambda t: {w for w in str(t).lower().split() if len(w) >= 3}
    return pd.Series([min(1.0, 1.3 * len(words(q) & words(p)) / max(1, len(words(q)))) for q, p in zip(queries, passages, strict=True)])


def rerank(hits: DataFrame, scorer: PairScorer | None = None, n: int = 50, query_col: str = "query", text_col: str = "content", most_chars: int | None = 2000) -> DataFrame:
    """hits with rerank_score, the best n of each query_id; without a scorer the order stays as it is.

    A scorer reads the first most_chars of a passage, as models have a limit; None: all of it.
    """
    if scorer is None:
        scored = hits.withColumn("rerank_score", F.col("score"))
    else:
        score = F.pandas_udf(lambda q, p: scorer(q, p.str.slice(0, most_chars)).astype(float), "double")
        scored = hits.withColumn("rerank_score", score(F.col(query_col), F.col(text_col)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "doc_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= n)


def embed(texts: DataFrame, embedder: Embedder | None = None, dims: int = 64, text_col: str = "text") -> DataFrame:
    """texts with a unit vector of each text: by the embedder, or hashed counts of its words (ours, no model)."""

    def hashed(batch: list[str]) -> np.ndarray:
        out = np.zeros((len(batch), dims))
        for i, t in enumerate(batch):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dims] += 1 if h >> 32 & 1 else -1
        return out

    make = embedder or hashed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(make(batch.column(batch.schema.get_field_index(text_col)).to_pylist()), float)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pa.record_batch([*batch.columns, pa.array(list(v.astype(np.float32)), pa.list_(pa.float32()))], names=[*batch.schema.names, "embedding"])

    from pyspark.sql import types as T

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def generate(prompts: DataFrame, generator: Generator | None = None, prompt_col: str = "prompt", fallback: Callable | None = None) -> DataFrame:
    """prompts with generated text; without a generator the fallback column expression, or an abstention."""
    if generator is None:
        return prompts.withColumn("generated", fallback(F.col(prompt_col)) if fallback else F.lit("Insufficient evidence"))
    return prompts.withColumn("generated", F.pandas_udf(lambda p: generator(p).astype(str), "string")(F.col(prompt_col)))


def transcribe(files: DataFrame, transcriber: Transcriber = nothing, content_col: str = "content") -> DataFrame:
    """binaryFile rows with their text."""
    return files.withColumn("text", F.pandas_udf(lambda c: c.map(transcriber).astype(str), "string")(F.col(content_col)))
