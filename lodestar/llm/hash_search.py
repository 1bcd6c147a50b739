"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes from learned rotations (iterative quantisation). A code is cut into
substrings, each an index of its own. If the substrings' radii r_i add up to radius - substrings + 1, a
code within the radius of a query's lies within r_i of it in some substring, so probing every substring
value within its radius retrieves every such code. What is retrieved is reranked by the exact measure
on the float vectors. The radius and the radii are fitted to the vectors.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import matrix, usable

#: Bits of a code; a substring has 64 of them.
CODE_BITS = 256
#: Share of true neighbours that should lie within the radius, estimated on the sample.
RECALL = 0.975
#: Rows of a length on which its model is learned, roughly, and rows whose neighbours are looked at for the radius.
SAMPLE = 8192
PROBES = 256
#: Rows of a block of queries; a block of candidates has at most so many rows and bytes.
QUERIES = 1024
BLOCK = 32_768
BLOCK_BYTES = 16 << 20


def learn_rotations(x: np.ndarray, bits: int = CODE_BITS, rounds: int = 20, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, dims x bits projections): as many learned rotations of the principal axes as bits ask for."""
    mean = x.mean(0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    rng, parts, dims = np.random.default_rng(seed), [], x.shape[1]
    while sum(p.shape[1] for p in parts) < bits:
        take = min(dims, bits - sum(p.shape[1] for p in parts))
        v = centred @ axes[:, ::-1][:, :take]
        r = np.linalg.qr(rng.normal(size=(take, take)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(axes[:, ::-1][:, :take] @ r)
    return mean, np.hstack(parts)


class Hashing:
    """Codes for vectors of one length, and the radii for a search among `rows` of them.

    Inner products become angles: a candidate gets one more coordinate that fills it up to the longest
    candidate's norm, a query gets zero there. So a longer vector is nearer, as it should be.
    """

    def __init__(self, x: np.ndarray, rows: int, longest: float, k: int, recall: float = RECALL, seed: int = 5) -> None:
        self.longest = longest
        self.model = learn_rotations(self._filled(x))
        parts = CODE_BITS // 64
        if len(x) < PROBES:  # too few to fit a radius: every code is reranked
            self.radius, self.radii, self.probed = CODE_BITS, [64] * parts, 1.0
            return
        asked = np.random.default_rng(seed).choice(len(x), PROBES, replace=False)
        codes, wanted = self.candidates(x), self.queries(x[asked])
        score = x[asked] @ x.T
        score[np.arange(len(asked)), asked] = -np.inf
        near = max(1, round(k * len(x) / rows))
        best = np.argpartition(-score, near - 1, axis=1)[:, :near]
        apart = np.stack([np.bitwise_count(wanted[:, None, s] ^ codes[None, :, s]) for s in range(parts)])
        self.radius = int(np.quantile(np.take_along_axis(apart.sum(0, dtype=np.int64), best, 1), recall))
        # each further bit of radius goes to the substring where it lets in the fewest codes
        share = np.stack([np.cumsum(np.bincount(a.ravel(), minlength=65)) for a in apart]) / apart[0].size
        self.radii = [-1] * parts
        for _ in range(self.radius + 1):
            more = [share[s, r + 1] - (share[s, r] if r >= 0 else 0) if r < 64 else np.inf for s, r in enumerate(self.radii)]
            self.radii[int(np.argmin(more))] += 1
        self.probed = float(np.any([a <= r for a, r in zip(apart, self.radii, strict=True)], axis=0).mean())

    def _filled(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1)))])

    def _encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.model[0]) @ self.model[1] >= 0, axis=1).view(np.uint64)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 64-bit substrings."""
        return self._encode(self._filled(x))

    def queries(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(1, keepdims=True)
        return self._encode(np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]))


class SubstringIndex:
    """The rows of a block by the value of each substring."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.tables = codes, []
        for s in range(codes.shape[1]):
            order = np.argsort(codes[:, s], kind="stable")
            values, begin = np.unique(codes[order, s], return_index=True)
            self.tables.append((values, np.append(begin, len(order)), order))

    def probe(self, code: np.ndarray, radii: list[int]) -> np.ndarray:
        """Rows that are within some substring's radius."""
        found = np.zeros(len(self.codes), bool)
        for s, (values, begin, order) in enumerate(self.tables):
            hit = np.bitwise_count(values ^ code[s]) <= radii[s] if radii[s] >= 0 else np.zeros(len(values), bool)
            found[order[hit] if len(values) == len(order) else order[np.repeat(hit, np.diff(begin))]] = True
        return np.flatnonzero(found)

    def within(self, code: np.ndarray, radius: int, radii: list[int]) -> np.ndarray:
        """Rows whose codes differ from code by at most radius bits."""
        rows = self.probe(code, radii)
        return rows[self.distance(code, rows) <= radius]

    def distance(self, code: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.codes[rows] ^ code).sum(1, dtype=np.int64)


def search_block(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, q: np.ndarray, query_codes: np.ndarray, k: int, radius: int, radii: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best among the codes retrieved from one block.

    Where fewer than k codes lie within the radius, the radius grows until k do, ties included.
    """
    index, out = SubstringIndex(codes), ([], [], [])
    for query, vector, code in zip(query_ids, q, query_codes, strict=True):
        rows = index.within(code, radius, radii)
        rows = rows[ids[rows] != query]
        if len(rows) < k:
            rows = np.flatnonzero(ids != query)
            if len(rows) > k:
                distance = index.distance(code, rows)
                rows = rows[distance <= np.partition(distance, k - 1)[k - 1]]
        score = np.einsum("ij,j->i", x[rows], vector)
        if len(rows) > k:
            kth = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= kth], score[score >= kth]
        order = np.lexsort((ids[rows], -score))[:k]
        out[0].append(np.full(len(order), query))
        out[1].append(ids[rows[order]])
        out[2].append(score[order])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(out[0], np.int64), join(out[1], np.int64), join(out[2], float)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, sample_rows: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k largest inner products found in vectors.

    A query's own id is no candidate, nor is a vector of another length. Nearest first, ties to the
    smaller id; fewer than k candidates: all. Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do rows without an id; of rows that repeat an id the smallest vector
    counts. Other columns do not matter. Each length of vectors has a model of its own, learned on about
    sample_rows of them (the driver gets one model a length); every row is indexed. A length whose sample
    has under PROBES vectors is too small to fit a radius, and all its codes are reranked. Queries meet
    candidates block by block; a block is what bounds a task.
    """
    spark, empty = vectors.sparkSession, "query_id bigint, rank int, vec_id bigint, score double"
    one = lambda df: usable(df, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v"))
    base, asked = cut(one(vectors)), cut(one(queries))
    top = F.array_max(F.transform("v", F.abs))
    norm = top * F.sqrt(F.aggregate(F.transform("v", lambda c: c / top), F.lit(0.0), lambda s, c: s + c * c))
    counted = asked.groupBy("dims").agg(F.count(F.lit(1)).alias("queries"))
    lengths = [tuple(r) for r in base.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest")).join(counted, "dims").select("dims", "n", "queries", "longest").collect()]
    if not lengths:
        return spark.createDataFrame([], empty)
    plan = spark.createDataFrame([(d, n, -(-n // max(1, min(BLOCK, BLOCK_BYTES // (8 * d)))), -(-m // QUERIES), longest) for d, n, m, longest in lengths], "dims int, n bigint, blocks int, asked int, longest double")

    def learn(key, rows):
        x = matrix(rows.column("v"))
        model = Hashing(x, rows.column("n")[0].as_py(), rows.column("longest")[0].as_py(), k, recall)
        return pa.table({"dims": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([pickle.dumps(model)], pa.binary())})

    planned = base.join(F.broadcast(plan), "dims")
    sample = planned.where(F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / sample_rows)) == 0)
    models = spark.sparkContext.broadcast({r.dims: bytes(r.model) for r in sample.select("dims", "v", "n", "longest").groupBy("dims").applyInArrow(learn, "dims int, model binary").collect()})
    deal = lambda column: F.pmod(F.xxhash64("id"), F.col(column)).cast("int")
    every = lambda column: F.explode(F.sequence(F.lit(0), F.col(column) - 1))
    left = planned.select("dims", deal("blocks").alias("b"), every("asked").alias("q"), "id", "v")
    right = asked.join(F.broadcast(plan), "dims").select("dims", every("blocks").alias("b"), deal("asked").alias("q"), "id", "v")

    def run(key, candidates, wanted):
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(candidates) or not len(wanted):
            return none
        x, q = matrix(candidates.column("v")), matrix(wanted.column("v"))
        model = pickle.loads(models.value[key[0].as_py()])
        found = search_block(candidates.column("id").to_numpy(), x, model.candidates(x), wanted.column("id").to_numpy(), q, model.queries(q), k, model.radius, model.radii)
        return pa.table({"query_id": pa.array(found[0]), "vec_id": pa.array(found[1]), "score": pa.array(found[2])})

    found = left.groupBy("dims", "b", "q").cogroup(right.groupBy("dims", "b", "q")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
