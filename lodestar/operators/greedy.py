"""Operators whose state is carried from item to item: one Arrow pass over documents or small groups."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import builder, run_sql
from ..functions.alignment import longest_common, meteor
from ..functions.stem import stem
from ..plans.dialect import SPARK
from .retrieval import bm25, ranked

# fixed values: limits of the chunkers in whitespace tokens, and of the diversification
PACK, PACK_OVERLAP, SPLIT = 512, 128, 800
LAMBDA, CANDIDATES = 0.7, 24
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
STRICT = re.compile(r"(?<=\S[.!?])\s+(?=[A-Z0-9\"'“])")


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(text)) if s]


def strict_sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in STRICT.split(text)) if s]


def pack_sentences(text: str, most: int = PACK, overlap: int = PACK_OVERLAP) -> list[str]:
    """Sentences to chunks of at most `most` tokens; the next one begins with the last ones up to `overlap`."""
    chunks, current, size = [], [], 0  # current: (sentence, its tokens)
    for s in sentences(text):
        n = len(s.split())
        if current and size + n > most:
            chunks.append(" ".join(x for x, _ in current))
            first, size = len(current), 0
            while first and size + current[first - 1][1] <= overlap:
                first -= 1
                size += current[first][1]
            current = current[first:]
        current.append((s, n))
        size += n
    return [*chunks, " ".join(x for x, _ in current)] if current else chunks


def pack_paragraphs(text: str, most: int = PACK) -> list[str]:
    chunks, current, size = [], [], 0
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        n = len(p.split())
        if not p:
            continue
        if current and size + n > most:
            chunks.append("\n\n".join(current))
            current, size = [], 0
        current.append(p)
        size += n
    return [*chunks, "\n\n".join(current)] if current else chunks


def split_by_size(text: str, most: int = SPLIT) -> list[str]:
    chunks, current, size = [], [], 0
    for s in sentences(text):
        n = len(s.split())
        if current and size + n > most:
            chunks.append(" ".join(current))
            current, size = [], 0
        current.append(s)
        size += n
    return [*chunks, " ".join(current)] if current else chunks


def trim_last(text: str, least: int = 6) -> list[str]:
    """The window without its last sentence, if that has fewer than `least` words and is not alone."""
    found = strict_sentences(text)
    return [" ".join(found[:-1] if len(found) >= 2 and len(found[-1].split()) < least else found)]


def chunked(docs: DataFrame, chunker: Callable[[str], list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, chunk, tokens) of the chunker's output for each text; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, c, len(c.split())) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, c in enumerate(chunker(t or ""))]
            ids, places, chunks, tokens = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(chunks, pa.string()), pa.array(tokens, pa.int32())], names=[id_col, "place", "chunk", "tokens"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} bigint, place int, chunk string, tokens int")


for _name, _chunker in (("TXT06_strict_sentences", strict_sentences), ("CHK03_sentence_trimming", trim_last), ("CHK06_sentence_packing", pack_sentences), ("CHK07_paragraph_packing", pack_paragraphs), ("CHK09_size_split", split_by_size), ("CHK11_topic_chunks", pack_sentences)):
    builder(_name)(lambda spark, get, c=_chunker: chunked(get("documents"), c))


def marginal_relevance(vectors: np.ndarray, scores: np.ndarray, n: int, trade: float = LAMBDA) -> list[int]:
    """Greedy choice of n rows by trade * relevance - (1 - trade) * largest cosine to those chosen; ties to the first."""
    span = scores.max() - scores.min()
    relevance = np.full(len(scores), 0.5) if span == 0 else (scores - scores.min()) / span
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return _greedy(relevance, lambda i: unit @ unit[i], n, trade, int(relevance.argmax()))


def term_relevance(texts: list[str], scores: np.ndarray, n: int, trade: float = LAMBDA) -> list[int]:
    """As marginal_relevance with the overlap of terms as similarity; the first row comes first."""
    terms = [set(t.lower().split()) for t in texts]
    like = lambda i: np.asarray([len(t & terms[i]) / max(1, min(len(t), len(terms[i]) + 1)) for t in terms])
    return _greedy(scores, like, n, trade, 0)


def _greedy(relevance: np.ndarray, like: Callable[[int], np.ndarray], n: int, trade: float, seed: int) -> list[int]:
    chosen, nearest = [seed], like(seed)
    while len(chosen) < min(n, len(relevance)):
        value = trade * relevance - (1 - trade) * nearest
        value[chosen] = -np.inf
        chosen.append(int(value.argmax()))
        nearest = np.maximum(nearest, like(chosen[-1]))
    return chosen


@builder("FUS04_mmr_embeddings")
def _mmr(spark, get) -> DataFrame:
    """For each label's queries: the nearest CANDIDATES vectors, diversified. A group is CANDIDATES rows."""
    from .retrieval import neighbours

    near = run_sql(spark, f"with {neighbours(SPARK, CANDIDATES)} select query_id, vec_id, cosine, embedding from nn join embeddings using (vec_id)", get)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cosine", "vec_id"], ascending=[False, True]).reset_index(drop=True)
        rows = marginal_relevance(np.stack(pdf.embedding).astype(float), pdf.cosine.to_numpy(), 10)
        return pd.DataFrame({"query_id": pdf.query_id[rows], "vec_id": pdf.vec_id[rows], "place": range(1, len(rows) + 1)})

    return near.groupBy("query_id").applyInPandas(pick, "query_id long, vec_id long, place int")


def _hits(spark, get) -> DataFrame:
    return run_sql(spark, f"with {bm25(SPARK, CANDIDATES)}, {ranked('top', 'bm', CANDIDATES)} select t.query_id, t.doc_id, t.score, cast(t.rk as int) as rk, d.source, d.text as content from top t join documents d on d.doc_id = t.doc_id", get)


@builder("FUS05_mmr_terms")
def _terms(spark, get) -> DataFrame:
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rk").reset_index(drop=True)
        rows = term_relevance(pdf.content.tolist(), pdf.score.to_numpy(), 10)
        return pd.DataFrame({"query_id": pdf.query_id[rows], "doc_id": pdf.doc_id[rows], "place": range(1, len(rows) + 1)})

    return _hits(spark, get).groupBy("query_id").applyInPandas(pick, "query_id long, doc_id long, place int")


def context_parts(pdf: pd.DataFrame, most_chunks: int = 12, most_tokens: int = 1200) -> tuple[list[tuple[str, str]], int]:
    """((citation, text), ...) of one query's hits (doc_id, score, source, content), and their tokens: first
    occurrences, best first, diversified, within the budget, long ones cut."""
    pdf = pdf.drop_duplicates("doc_id").sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
    pdf = pdf.iloc[term_relevance(pdf.content.tolist(), pdf.score.to_numpy(), 2 * most_chunks)].reset_index(drop=True)
    budget, used, parts = int(most_tokens * 0.92), 0, []
    for row in pdf.itertuples():
        text = row.content
        tokens = max(1, int(len(text.split()) * 1.3))
        if tokens > budget // 2:
            text, tokens = text[: budget // 2 * 4] + "...", budget // 2
        if used + tokens > budget:
            if budget - used > 100:
                parts.append((row, text[: (budget - used) * 4] + "..."))
            break
        parts.append((row, text))
        used += tokens
    seen: Counter = Counter()
    out = []
    for row, text in parts[:most_chunks]:
        base = f"{row.source}#{row.doc_id}"
        seen[base] += 1
        out.append((f"{base}{'' if seen[base] == 1 else f'~{seen[base]}'}", text))
    return out, used


def build_context(pdf: pd.DataFrame, most_chunks: int = 12, most_tokens: int = 1200) -> pd.DataFrame:
    parts, used = context_parts(pdf, most_chunks, most_tokens)
    return pd.DataFrame({"query_id": [pdf.query_id.iloc[0]], "context": ["\n\n".join(f"[{cite}] {text}" for cite, text in parts)], "chunks": [len(parts)], "tokens": [used]})


@builder("FUS06_build_context")
def _context(spark, get) -> DataFrame:
    return _hits(spark, get).groupBy("query_id").applyInPandas(lambda pdf: build_context(pdf), "query_id long, context string, chunks int, tokens long")


def sample_scenes(times: np.ndarray, values: np.ndarray, interval: float, change: float, last: tuple[float, float] = (-math.inf, math.inf)) -> np.ndarray:
    """True for events kept: 0.9 * interval after the last kept one, or over `change` apart from it."""
    keep = np.zeros(len(times), bool)
    at, value = last
    for i, (t, v) in enumerate(zip(times.tolist(), values.tolist(), strict=True)):
        if t - at >= 0.9 * interval or abs(v - value) > change:
            keep[i], at, value = True, t, v
    return keep


@builder("WIN09_scene_sampling")
def _scenes(spark, get) -> DataFrame:
    """A user's events come in the order of time, batch by batch; only the last kept event is carried on."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, last = None, (-math.inf, math.inf)
        for batch in batches:
            parts = []
            for key, pdf in batch.groupby("user_id", sort=False):
                if key != user:
                    user, last = key, (-math.inf, math.inf)
                kept = pdf[sample_scenes(pdf.t.to_numpy(), pdf.value.to_numpy(), 43_200.0, 60.0, last)]
                if len(kept):
                    last = (kept.t.iloc[-1], kept.value.iloc[-1])
                parts.append(kept[["user_id", "event_id"]])
            if parts:
                yield pd.concat(parts)

    events = get("events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"), "value")
    return events.where("user_id is not null").repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").mapInPandas(pick, "user_id long, event_id long")


def bleu(candidate: list[str], reference: list[str]) -> tuple[float, float, float, float]:
    """Sentence BLEU-1 to 4 of tokens, an empty overlap smoothed to 0.1, rounded to four places."""
    precisions = []
    for n in range(1, 5):
        c = Counter(tuple(candidate[i : i + n]) for i in range(len(candidate) - n + 1))
        r = Counter(tuple(reference[i : i + n]) for i in range(len(reference) - n + 1))
        hit, total = sum((c & r).values()), max(1, sum(c.values()))
        if n == 1 and not hit:
            return 0.0, 0.0, 0.0, 0.0
        precisions.append((hit or 0.1) / total)
    short = 1.0 if len(candidate) > len(reference) else math.exp(1 - len(reference) / max(1, len(candidate)))
    weights = ((1,), (0.5, 0.5), (0.33, 0.33, 0.34), (0.25,) * 4)
    return tuple(round(short * math.exp(sum(w * math.log(p) for w, p in zip(ws, precisions, strict=False))), 4) for ws in weights)


def rouge_tokens(text: str, stemmed: bool = True) -> list[str]:
    """Lower-case runs of ASCII letters and digits; those of over three characters as stems."""
    words = re.findall("[a-z0-9]+", text.lower())
    return [stem(w) if len(w) > 3 else w for w in words] if stemmed else words


def f_measure(hit: int, a: int, b: int) -> float:
    return round(2 * hit / (a + b), 4) if hit else 0.0


def rouge(candidate: str, reference: str) -> tuple[float, float, float]:
    """ROUGE-1, -2 and -L, F-measures of stemmed tokens."""
    a, b = rouge_tokens(candidate), rouge_tokens(reference)
    pairs = lambda w: Counter(zip(w, w[1:], strict=False))
    two = sum((pairs(a) & pairs(b)).values())
    return f_measure(sum((Counter(a) & Counter(b)).values()), len(a), len(b)), f_measure(two, max(0, len(a) - 1), max(0, len(b) - 1)), rouge_l(a, b)


def rouge_l(candidate: list[str], reference: list[str]) -> float:
    return f_measure(longest_common(candidate, reference), len(candidate), len(reference))


def support_ratio(answer: str, evidence: str) -> float:
    """Share of the answer's sentences whose words of three characters and more stand to 0.7 (times 1.3) in the evidence."""
    terms = lambda t: set(re.findall(r"\w{3,}", t.lower()))
    known, said = terms(evidence), [terms(x) for x in sentences(answer) if len(x) > 12][:8]
    return sum(min(1.0, 1.3 * len(t & known) / max(1, len(t))) >= 0.7 for t in said) / len(said) if said else 0.0


def correct(answer: str, reference: str, claims: float, similarity: float = 0.0) -> bool:
    """The cascade: same text, reference in the answer, similarity (of a model, if there is one), ROUGE-L, then weighted
    signals; without a reference the claims' support."""
    if not reference:
        return claims >= 0.5
    a, r = answer.strip().lower(), reference.strip().lower()
    overlap = rouge(answer, reference)[2]
    if a == r or r in a or similarity >= 0.7 or overlap >= 0.5:
        return True
    return 0.3 * (similarity >= 0.5) + 0.3 * (overlap >= 0.3) + 0.4 * (claims >= 0.5) >= 0.5


def _turns(get) -> DataFrame:
    c = get("conversations")
    return c.alias("c").join(c.alias("n"), (F.col("n.conv_id") == F.col("c.conv_id")) & (F.col("n.turn") == F.col("c.turn") + 1)).select("c.conv_id", "c.turn", F.lower("n.text").alias("cand"), F.lower("c.text").alias("ref"))


def _scored(df: DataFrame, score: Callable[[str, str], tuple], names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [score(a or "", b or "") for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(len(names)))], names=["conv_id", "turn", *names])

    return df.mapInArrow(run, "conv_id long, turn long, " + ", ".join(f"{n} double" for n in names))


builder("EVL07_bleu")(lambda spark, get: _scored(_turns(get), lambda a, b: (s := bleu(a.split(), b.split())) + (round(sum(s) / 4, 4),), ["bleu_1", "bleu_2", "bleu_3", "bleu_4", "bleu_avg"]))
builder("EVL08_rouge_l")(lambda spark, get: _scored(_turns(get), lambda a, b: (rouge_l(rouge_tokens(a, stemmed=False), rouge_tokens(b, stemmed=False)),), ["rouge_l"]))
builder("EVL09_meteor")(lambda spark, get: _scored(_turns(get), lambda a, b: (round(meteor(a.split(), b.split()), 6),), ["meteor"]))
builder("EVL08_rouge_stemmed")(lambda spark, get: _scored(_turns(get), rouge, ["rouge_1", "rouge_2", "rouge_l"]))


@builder("EVL11_correctness")
def _correctness(spark, get) -> DataFrame:
    """Each turn as an answer to be judged by the one before as its reference and evidence."""

    def judged(a: str, b: str) -> tuple[float, float, float]:
        claims = support_ratio(a, b)
        return rouge(a, b)[2], round(claims, 6), float(correct(a, b, claims))

    return _scored(_turns(get), judged, ["rouge_l", "claim_ratio", "correct"]).withColumn("correct", F.col("correct") == 1)
