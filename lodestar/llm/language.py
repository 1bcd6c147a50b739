"""Language identification by multilingual mixture inference.

A document is a mixture of languages over hashed byte trigrams. Expectation-maximisation estimates
the proportions; nested sets of the likeliest languages, of any size, are compared by a penalised
likelihood, so that a document gets the smallest set of languages that explains it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, release, table, text_buffers

#: Buckets of trigrams: a fixed size, so the model's size depends on the number of languages alone.
BUCKETS = 1 << 13
#: Documents whose mixtures are inferred together: several tables of BLOCK x BUCKETS numbers are open at a time.
BLOCK = 64
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _c in range(ord("a"), ord("z") + 1):
    _FOLD[_c] = _FOLD[_c - 32] = _c


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts by document and bucket; whatever is no letter is one kind of space."""
    rows = len(offsets) - 1
    b0 = _FOLD[data]
    b1, b2 = np.full(len(b0), 0x20, np.uint8), np.full(len(b0), 0x20, np.uint8)
    b1[:-1], b2[:-2] = b0[1:], b0[2:]
    ends = offsets[1:][np.diff(offsets) > 0]
    b1[ends - 1] = b2[ends - 1] = 0x20
    b2[np.maximum(ends - 2, 0)] = 0x20
    keep = (b1 != 0x20) | ((b0 != 0x20) & (b2 != 0x20)) | (b0 != 0x20)
    code = b0.astype(np.uint32) * np.uint32(0x9E3779B1) ^ b1.astype(np.uint32) * np.uint32(0x85EBCA77) ^ b2.astype(np.uint32) * np.uint32(0xC2B2AE3D)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    code = (code >> np.uint32(19)).astype(np.int64)
    row = np.repeat(np.arange(rows) * BUCKETS, np.diff(offsets))
    return np.bincount((row + code)[keep], minlength=rows * BUCKETS).reshape(rows, BUCKETS)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    probabilities: np.ndarray  # languages x BUCKETS


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: tuple[int, int] = (4, 2), smoothing: float = 0.05) -> LanguageModel:
    """Count the trigrams of all documents outside the held-out part that have a language and a text.

    Each task adds up its own rows before the shuffle; the driver gets one vector a language.
    """
    learn = docs.where((crc_bucket(id_col, held_out[0]) != held_out[1]) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.asarray(batch.column(0).to_pylist(), object)
            for first, data, offsets in text_buffers(batch.column(1)):
                for lo in range(0, len(offsets) - 1, BLOCK):
                    part = offsets[lo : lo + BLOCK + 1]
                    counts = trigram_counts(data[part[0] : part[-1]], part - part[0])
                    own = langs[first + lo : first + lo + len(counts)]
                    for lang in set(own):
                        totals[lang] = totals.get(lang, 0) + counts[own == lang].sum(0)
        yield pa.record_batch([pa.array(list(totals), pa.string()), pa.array([v.astype(np.int64).tobytes() for v in totals.values()], pa.binary())], names=["lang", "counts"])
        release()

    def add(key, group):
        total = np.zeros(BUCKETS, np.int64)
        for x in group.column("counts").to_pylist():
            total += np.frombuffer(x, np.int64)
        return pa.table({"lang": [key[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    found = learn.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary").collect()
    found = sorted((r.lang, np.frombuffer(bytes(r.counts), np.int64)) for r in found)
    found = [(lang, c) for lang, c in found if c.sum() > 0]
    if not found:
        return LanguageModel((), np.zeros((0, BUCKETS), np.float32))
    counts = np.stack([c for _, c in found]).astype(float) + smoothing
    return LanguageModel(tuple(lang for lang, _ in found), (counts / counts.sum(1, keepdims=True)).astype(np.float32))


def infer_mixtures(counts: np.ndarray, p: np.ndarray, rounds: int = 12, still: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by document (rows sum to 1 over the chosen set) and the chosen sets as booleans.

    Expectation-maximisation over all languages ranks them; then the set of the likeliest grows by one
    language at a time, with its own proportions, for as long as the likelihood less half the logarithm
    of the document's length for each further language grows. Each document stops by itself, when no
    proportion changes by `still` or more, or after `rounds` rounds (half as many for each set, none for one
    language), converged or not; so its row depends on no other document, and proportions may lie short of
    the fixed point.
    """
    c, p = counts.astype(float), p.astype(float)
    n = np.maximum(c.sum(1, keepdims=True), 1)
    docs, langs = len(c), len(p)

    def em(weights: np.ndarray, of: np.ndarray, rounds: int) -> np.ndarray:
        weights, going = weights.copy(), np.arange(len(of))
        for _ in range(rounds):
            w = weights[going]
            new = w * ((c[of[going]] / np.maximum(w @ p, 1e-30)) @ p.T) / n[of[going]]
            weights[going] = new
            going = going[np.abs(new - w).max(1) >= still]
            if not len(going):
                break
        return weights

    live = np.arange(docs)
    free = em(np.full((docs, langs), 1 / langs), live, rounds)
    rank = np.argsort(np.argsort(-free, axis=1, kind="stable"), axis=1, kind="stable")
    best, chosen, reached = np.zeros((docs, langs)), np.zeros((docs, langs), bool), np.full(docs, -np.inf)
    for size in range(1, langs + 1):
        inside = rank[live] < size
        w = np.where(inside, free[live] + 1e-3, 0)
        w = em(w / w.sum(1, keepdims=True), live, rounds // 2 if size > 1 else 0)
        likelihood = (c[live] * np.log(np.maximum(w @ p, 1e-30))).sum(1) - 0.5 * (size - 1) * np.log(n[live, 0])
        better = likelihood > reached[live]
        w, inside, live = w[better], inside[better], live[better]
        reached[live], best[live], chosen[live] = likelihood[better], w, inside
        if not len(live):
            break
    return best / np.maximum(best.sum(1, keepdims=True), 1e-30), chosen


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    kind = _FOLD[data]
    ascii_seen = np.concatenate([[0], np.cumsum((kind != 0x20) & (data < 0x80))])
    out = ascii_seen[offsets[1:]] > ascii_seen[offsets[:-1]]
    for i in range(rows) if not out.all() else ():
        if not out[i] and offsets[i + 1] > offsets[i]:
            out[i] = any(ch.isalpha() for ch in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore"))
    return out


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, langs): the main language, its proportion, and the chosen set in order.

    A null text or one without a letter gets und and score 0; so do all texts if nothing was learned.
    One row for each row of docs, repeated ids and null ids included; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers, whatever the size of docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, pick, score, sets in _predicted(batch.column(1), shared.value):
                yield pa.record_batch([batch.column(0).slice(first, len(pick)), pa.array(pick, pa.string()), pa.array(score), pa.array(sets, pa.string())], names=[id_col, "lang_pred", "score", "langs"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"{id_col} bigint, lang_pred string, score double, langs string")


def _predicted(texts: pa.Array, model: LanguageModel) -> Iterator[tuple[int, list[str], np.ndarray, list[str]]]:
    """(first row, languages, proportions, sets) of neighbouring texts."""
    p, names = model.probabilities, np.asarray([*model.languages, UNKNOWN], object)
    for first, data, offsets in text_buffers(texts):
        for lo in range(0, len(offsets) - 1, BLOCK):
            part = offsets[lo : lo + BLOCK + 1]
            rows, mine = len(part) - 1, data[part[0] : part[-1]]
            letters = has_letter(mine, part - part[0])
            pick, score, sets = np.full(rows, len(p)), np.zeros(rows), [""] * rows
            if len(p) and letters.any():
                weights, chosen = infer_mixtures(trigram_counts(mine, part - part[0]), p)
                pick = np.where(letters, weights.argmax(1), len(p))
                score = np.where(letters, weights.max(1), 0.0).astype(float)
                order = np.argsort(-weights, axis=1, kind="stable")
                sets = [",".join(names[k] for k in o if ch[k]) if ok else "" for o, ch, ok in zip(order, chosen, letters, strict=True)]
            yield first + lo, names[pick].tolist(), np.round(np.clip(score, 0, 1), 6), sets


def keep_known(docs: DataFrame, model: LanguageModel, least: float = 0.35, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose main language is known and makes up at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, pick, score, _ in _predicted(batch.column(at), shared.value):
                keep = (np.asarray(pick, object) != UNKNOWN) & (score >= least)
                yield batch.slice(first, len(pick)).filter(pa.array(keep))
        release()

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, fit_languages(docs)).select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "langs")
