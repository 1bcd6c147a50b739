"""Chunks of a document by the likeness of neighbouring sentences.

Without a model a sentence's vector holds, for each of its words, the idf that all sentences of the corpus give to the
word. Words go by DIMS buckets, so what is fitted on the corpus has a fixed size, however many documents there are;
after that each document is chunked by itself, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import builder
from ..functions.scorers import Embedder
from .chunking import SIMILAR
from .greedy import SPLIT, chunked, pack_paragraphs, pack_sentences, sentences, split_by_size

#: Buckets of words; a word's is its CRC-32.
DIMS = 1 << 18
#: Cosine of idf vectors under which a new chunk begins: neighbours that share little more than common words.
IDF_SIMILAR = 0.05
#: Sentences that adaptive chunking wants more of, and paragraph breaks.
MANY_SENTENCES, MANY_BREAKS = 10, 5


def buckets(sentence: str) -> Counter:
    return Counter(zlib.crc32(w.encode()) % DIMS for w in re.findall(r"\w+", sentence.lower()))


def fit_idf(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """ln((1 + n) / (1 + df)) + 1 of each bucket, over the n sentences of all texts; at most DIMS sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMS + 1, np.int64)  # the last one counts sentences
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for s in sentences(text or ""):
                    df[-1] += 1
                    for b in buckets(s):
                        df[b] += 1
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some), pa.array(df[some])], names=["bucket", "df"])

    total = np.zeros(DIMS + 1, np.int64)
    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket bigint, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    total[rows["bucket"].to_numpy()] = rows["df"].to_numpy()
    return (np.log((1 + total[-1]) / (1 + total[:-1])) + 1).astype(np.float32)


def idf_likeness(idf: np.ndarray) -> Callable[[list[str]], list[float]]:
    """The cosines of neighbouring sentences."""

    def like(said: list[str]) -> list[float]:
        vectors = [{b: n * float(idf[b]) for b, n in buckets(s).items()} for s in said]
        norms = [sum(x * x for x in v.values()) ** 0.5 for v in vectors]
        return [sum(x * w.get(b, 0.0) for b, x in v.items()) / (m * n) if m * n else 0.0 for v, w, m, n in zip(vectors, vectors[1:], norms, norms[1:], strict=False)]

    return like


def embedder_likeness(embedder: Embedder) -> Callable[[list[str]], list[float]]:
    def like(said: list[str]) -> list[float]:
        v = np.asarray(embedder(said), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return (v[:-1] * v[1:]).sum(1).tolist()

    return like


def semantic(text: str, like: Callable[[list[str]], list[float]], least: float, most: int = SPLIT) -> list[str]:
    """Runs of sentences whose neighbours are alike; a run of over `most` tokens goes to the split by size.

    Every sentence is in exactly one chunk: short runs stay chunks of their own.
    """
    said = sentences(text)
    if len(said) <= 1:
        return said
    runs, now = [], [said[0]]
    for s, alike in zip(said[1:], like(said), strict=True):
        if alike < least:
            runs.append(now)
            now = []
        now.append(s)
    out = []
    for run in [*runs, now]:
        chunk = " ".join(run)
        out += split_by_size(chunk, most) if len(chunk.split()) > most else [chunk]
    return out


def adaptive(text: str, like: Callable[[list[str]], list[float]], least: float) -> list[str]:
    """Paragraphs where there are many breaks, runs of like sentences where there are many sentences, else packed sentences."""
    if len(re.findall(r"\n\s*\n", text)) > MANY_BREAKS:
        return pack_paragraphs(text)
    return semantic(text, like, least) if len(sentences(text)) > MANY_SENTENCES else pack_sentences(text)


def semantic_chunks(docs: DataFrame, embedder: Embedder | None = None, chunker: Callable = semantic, id_col: str = "doc_id", text_col: str = "text", least: float | None = None) -> DataFrame:
    """(id, place, chunk, tokens) of each text, by an embedder's vectors or idf vectors fitted on docs.

    chunker is semantic or adaptive. Null and empty texts have no chunks; repeated ids are chunked each by itself.
    """
    if embedder is not None:
        least = SIMILAR if least is None else least
        return chunked(docs, lambda t: chunker(t, embedder_likeness(embedder), least), id_col, text_col)
    least, shared = IDF_SIMILAR if least is None else least, docs.sparkSession.sparkContext.broadcast(fit_idf(docs, text_col))  # DIMS numbers
    return chunked(docs, lambda t: chunker(t, idf_likeness(shared.value), least), id_col, text_col)


builder("CHK08_semantic_chunks")(lambda spark, get: semantic_chunks(get("documents")))
builder("CHK10_adaptive_chunks")(lambda spark, get: semantic_chunks(get("documents"), chunker=adaptive))
