"""Quality classifier: a sparse rule ensemble over statistics of the text.

Small regression trees are boosted on a bounded sample of labelled rows; every path from a root
to a node is a conjunctive rule; lasso logistic regression keeps few of the rules; the kept rules
are compiled into one Spark column expression, so scoring is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, crc_bucket, prefix_hash, release, span_hash, table, text_buffers, word_spans

STATISTICS = ("n_bytes", "n_words", "mean_word", "max_word", "upper", "digit", "symbol", "stop", "bar", "line", "same_next", "distinct", "capital_words", "marked_words", "common_share")

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 upper, 2 lower, 3 digit, 4 symbol, 5 stop or comma, 6 bar, 7 newline
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _c in b"!#$%&*+-/<=>?@[]^_`{}~\\\"':;()":
    _CLASS[_c] = 4
for _c in b".,":
    _CLASS[_c] = 5
_CLASS[ord("|")] = 6
_CLASS[ord("\n")] = 7


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of STATISTICS for the texts between the offsets; an empty text has zeros."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    kind = _CLASS[data]
    by = np.bincount(row * 8 + kind, minlength=rows * 8).reshape(rows, 8).astype(float)
    n_bytes = np.diff(offsets).astype(float)
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first)
    owner = np.repeat(np.arange(rows), words)
    length = (ends - starts).astype(float)
    of = lambda values: np.bincount(owner, values, minlength=rows)
    out = np.zeros((rows, len(STATISTICS)))
    n_words = np.maximum(words, 1).astype(float)
    longest = np.zeros(rows)
    np.maximum.at(longest, owner, length)
    same = np.zeros(len(starts))
    distinct = np.zeros(rows)
    top = np.zeros(rows)
    if len(starts):
        h = span_hash(prefix_hash(data), starts, ends)
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        order = np.lexsort((h, owner))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        at = np.flatnonzero(new)
        distinct = np.bincount(owner[order][at], minlength=rows).astype(float)
        np.maximum.at(top, owner[order][at], np.diff(np.append(at, len(h))).astype(float))
    upper = np.concatenate([[0], np.cumsum(kind == 1)])
    lower = np.concatenate([[0], np.cumsum(kind == 2)])
    symbol = np.concatenate([[0], np.cumsum(kind == 4)])
    in_upper, in_lower, in_symbol = (c[ends] - c[starts] for c in (upper, lower, symbol))
    per_byte = np.maximum(n_bytes, 1)
    out[:, 0], out[:, 1] = n_bytes, words
    out[:, 2], out[:, 3] = of(length) / n_words, longest
    out[:, 4], out[:, 5], out[:, 6], out[:, 7], out[:, 8], out[:, 9] = (by[:, k] / per_byte for k in (1, 3, 4, 5, 6, 7))
    out[:, 10], out[:, 11] = of(same) / n_words, distinct / n_words
    out[:, 12] = of((in_upper > 0) & (in_lower == 0)) / n_words
    out[:, 13] = of(in_symbol >= 2) / n_words
    out[:, 14] = top / n_words
    return out


def with_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: the id and STATISTICS of the whole text (null text: as empty)."""
    schema = f"{id_col} bigint, " + ", ".join(f"{s} double" for s in STATISTICS)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, data, offsets in text_buffers(texts):
                out = statistics(data, offsets)
                yield pa.record_batch([ids.slice(first, len(out)), *(pa.array(out[:, k]) for k in range(out.shape[1]))], names=[id_col, *STATISTICS])

    return df.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, True for >, threshold), all of which must hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for name, above, threshold in self.conditions:
            value = F.col(prefix + name)
            out = out & ((value > threshold) if above else (value <= threshold))
        return out.cast("double")

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, threshold in self.conditions:
            value = x[:, STATISTICS.index(name)]
            out &= value > threshold if above else value <= threshold
        return out


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self, prefix: str = "") -> Column:
        """The score over columns named as STATISTICS after the prefix."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + rule.column(prefix) * weight
        return 1.0 / (1.0 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += rule.holds(x) * weight
        return 1 / (1 + np.exp(-total))


def _tree_paths(binned: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, depth: int, least: int) -> tuple[list[tuple], np.ndarray]:
    """The conditions of every node below the root of one least-squares tree, and its prediction."""
    paths: list[tuple] = []
    fitted = np.zeros(len(residual))

    def grow(index: np.ndarray, conditions: tuple, left: int) -> None:
        fitted[index] = residual[index].mean()
        if left == 0 or len(index) < 2 * least:
            return
        best = (1e-9, None)
        total, n = residual[index].sum(), len(index)
        for f, edge in enumerate(edges):
            if not len(edge):
                continue
            b = binned[index, f]
            count = np.cumsum(np.bincount(b, minlength=len(edge) + 1))[:-1]
            summed = np.cumsum(np.bincount(b, residual[index], minlength=len(edge) + 1))[:-1]
            fits = (count >= least) & (n - count >= least)
            gain = np.where(fits, summed**2 / np.maximum(count, 1) + (total - summed) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
        if best[1] is None:
            return
        f, k = best[1]
        for above in (False, True):
            path = (*conditions, (STATISTICS[f], above, float(edges[f][k])))
            paths.append(path)
            grow(index[(binned[index, f] > k) == above], path, left - 1)

    grow(np.arange(len(residual)), (), depth)
    return paths, fitted


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, penalty: float = 1e-3, most: int = 64, seed: int = 7) -> RuleModel:
    """Boost trees, take their paths as rules, and keep those to which the lasso gives weight."""
    base = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(base / (1 - base)))
    if len(y) == 0 or y.min() == y.max():
        return RuleModel((), (), start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    rng, total, rules = np.random.default_rng(seed), np.full(len(y), start), {}
    least = max(2, min(20, len(y) // 50))
    for _ in range(trees):
        part = np.sort(rng.permutation(len(y))[: max(2, int(len(y) * 0.6))])
        p = 1 / (1 + np.exp(-total))
        paths, _ = _tree_paths(binned[part], edges, (y - p)[part], depth, least)
        step = np.zeros(len(y))
        for path in paths:
            rule = rules.setdefault(tuple(sorted(path)), Rule(tuple(sorted(path))))
            inside = rule.holds(x)
            if len(path) == depth:
                step[inside] = (y - p)[inside].sum() / max(1e-6, (p * (1 - p))[inside].sum() + 1)
        total += rate * np.clip(step, -4, 4)
    kept = list(rules.values())
    if not kept:  # too few rows to split
        return RuleModel((), (), start)
    matrix = np.stack([r.holds(x) for r in kept], 1).astype(float)
    _, first = np.unique(matrix, axis=1, return_index=True)
    kept, matrix = [kept[i] for i in sorted(first)], matrix[:, sorted(first)]
    weights, intercept = _lasso(matrix, y, penalty)
    order = [i for i in np.argsort(-np.abs(weights)) if abs(weights[i]) > 1e-4][:most]
    if not order:
        return RuleModel((), (), intercept)
    refit, intercept = _lasso(matrix[:, order], y, penalty / 4)
    return RuleModel(tuple(kept[i] for i in order), tuple(map(float, refit)), float(intercept))


def _lasso(matrix: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty by accelerated proximal gradient steps."""
    n = len(y)
    full = np.hstack([matrix, np.ones((n, 1))])
    v = np.ones(full.shape[1])
    for _ in range(30):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(np.linalg.norm(full @ v) ** 2 * 1.05)
    w = ahead = np.zeros(full.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ ahead, -30, 30)))
        new = ahead - step * (full.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:-1], float(w[-1])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: tuple[int, int] = (5, 0), sample_rows: int = 20_000) -> RuleModel:
    """Fit on at most sample_rows labelled rows (those of smallest hashed id) outside the held-out part.

    held_out is (modulus, remainder) of crc32(id as text). Null ids and null labels teach nothing; an id
    that repeats teaches once, by its smallest label and statistics.
    """
    chosen = (
        labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("double").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (crc_bucket("_id", held_out[0]) != held_out[1]))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample_rows)
    )
    # at most sample_rows ids and labels: a proven bound for the broadcast
    picked = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_y", "_text")
    schema = "_id bigint, _y double, " + ", ".join(f"{s} double" for s in STATISTICS)

    def run(batches):
        for batch in batches:
            for first, data, offsets in text_buffers(batch.column(2)):
                out = statistics(data, offsets)
                yield pa.record_batch([batch.column(0).slice(first, len(out)), batch.column(1).slice(first, len(out)), *(pa.array(out[:, k]) for k in range(out.shape[1]))], names=["_id", "_y", *STATISTICS])

    # one row an id, so the driver gets no more than sample_rows, however often an id stands in docs or labels
    least = picked.mapInArrow(run, schema).groupBy("_id").agg(F.min(F.struct("_y", *STATISTICS)).alias("least"))
    rows = least.select("_id", "least.*").toPandas().sort_values("_id", kind="stable")
    return fit_rules(rows[list(STATISTICS)].to_numpy(float), (rows["_y"].to_numpy() > 0.5).astype(float))


def score_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of docs, repeated ids included; a null id keeps a null id.

    A null or empty text has statistics of zero and gets the score that the rules give to them.
    Other columns of docs, whatever their names, are left out.
    """
    return with_statistics(docs, id_col, text_col).select(id_col, F.round(model.column(), 9).alias("score"))


def keep_good(docs: DataFrame, model: RuleModel, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text scores at least `least`; no row is moved for it."""
    prefix = "_statistic_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    fields = T.StructType([*docs.schema.fields, *(T.StructField(prefix + s, T.DoubleType()) for s in STATISTICS)])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for first, data, offsets in text_buffers(batch.column(at)):
                out = statistics(data, offsets)
                part = batch.slice(first, len(out))
                yield pa.record_batch([*part.columns, *(pa.array(out[:, k]) for k in range(out.shape[1]))], names=[*part.schema.names, *(prefix + s for s in STATISTICS)])
        release()

    return docs.mapInArrow(run, fields).where(F.round(model.column(prefix), 9) >= least).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
