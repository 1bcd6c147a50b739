"""Approximate nearest neighbours: vectors in cells around centres, of which a query reads the nearest ones.

    index = build_cells(vectors); index.save(path); index = load_cells(spark, path)
    index.nearest(queries, 20)            # (query_id, vec_id, cosine, rk)

The centres are fitted on a bounded sample by spherical k-means, and the number of cells that a query reads is the
least that reaches the wanted recall for queries of the sample. Every vector is indexed. A cell is a folder of
Parquet files, so cells that no query asks for are not opened; a large cell is dealt out in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import BEST, BLOCK, QUERIES, _matrix, best_of_blocks
from .store import stored

#: Rows that centres are fitted on, queries among them that the recall is fitted by, and the most cells.
SAMPLE, ASKED, MOST_CELLS = 32_768, 256, 1024
#: Neighbours that the recall counts, and what is reached on the sample.
NEIGHBOURS, RECALL = 20, 0.97
ROUNDS = 12


def usable(vectors: DataFrame, id_col: str, vector_col: str, dims: int | None = None) -> DataFrame:
    """(id, v): rows with an id and a vector of numbers only that is not zero, of dims components where given."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return rows if dims is None else rows.where(F.size("v") == dims)


def fit_centres(sample: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Unit centres of unit rows, by spherical k-means; a centre without rows starts anew at a row far from its own."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), cells, False)].copy()
    for _ in range(ROUNDS):
        like = sample @ centres.T
        own = like.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        if len(empty):
            sums[empty] = sample[np.argsort(like[np.arange(len(sample)), own])[: len(empty)]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit_probes(sample: np.ndarray, centres: np.ndarray, recall: float) -> int:
    """How many of the nearest cells hold that share of the neighbours, over queries of the sample."""
    asked = np.arange(0, len(sample), max(1, len(sample) // ASKED))
    like = sample[asked] @ sample.T
    like[np.arange(len(asked)), asked] = -np.inf
    k = min(NEIGHBOURS, len(sample) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-like, k - 1, axis=1)[:, :k]
    cell = (sample @ centres.T).argmax(1)
    order = np.argsort(-(sample[asked] @ centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape), 1)
    needed = np.sort(np.take_along_axis(place, cell[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


@dataclass
class CellIndex:
    """cells (cell, part, id, v), the centres, a row for each, how many parts a cell has, and how many cells are read."""

    cells: DataFrame
    centres: np.ndarray
    parts: np.ndarray
    probes: int

    def save(self, path: str) -> None:
        self.cells.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
        rows = [(c, [float(x) for x in v], int(p), self.probes) for c, (v, p) in enumerate(zip(self.centres, self.parts, strict=True))]
        self.cells.sparkSession.createDataFrame(rows, "cell int, centre array<double>, parts int, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")

    def probed(self, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None) -> DataFrame:
        """(cell, id, v): each query with every cell that it reads."""
        centres, n = self.centres, min(probes or self.probes, len(self.centres))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                v = _matrix(pa.chunked_array([batch.column(1)]))
                near = np.argpartition(-(v @ centres.T), n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(n), (len(v), 1))
                at = pa.array(np.repeat(np.arange(len(v)), n))
                yield pa.record_batch([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], names=["cell", "id", "v"])

        return usable(queries, id_col, vector_col, centres.shape[1]).mapInArrow(run, "cell int, id bigint, v array<double>")

    def nearest(self, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None) -> DataFrame:
        """(query_id, vec_id, cosine, rk): each query's k largest inner products, rounded to six places, in the cells that it
        reads, ties to the smaller id, without itself. Reading all cells (probes) gives the exact neighbours."""
        if not len(self.centres):
            return self.cells.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, cosine double, rk int")
        asked = stored(self.probed(queries, id_col, vector_col, probes))
        # at most MOST_CELLS numbers: the folders that are opened
        wanted = [r["cell"] for r in asked.groupBy("cell").agg(F.max(F.lit(1))).select("cell").collect()]
        turns = 1 + asked.count() // (QUERIES * max(1, len(wanted)))
        parts = F.element_at(F.array(*(F.lit(int(p)) for p in self.parts)), F.col("cell") + 1)
        right = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(turns)))
        left = self.cells.where(F.col("cell").isin(wanted)).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)).cast("array<bigint>")))
        group = ["cell", "part", "turn"]
        found = left.select(*group, "id", "v").groupBy(*group).cogroup(right.select(*group, "id", "v").groupBy(*group)).applyInArrow(best_of_blocks(k), BEST)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
        return found.select("query_id", "vec_id", "cosine").withColumn("rk", place).where(F.col("rk") <= k)


def build_cells(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, recall: float = RECALL) -> CellIndex:
    """Index every usable vector, of the length that most of the sample has; about the root of their number cells.

    Null vectors, zero vectors, vectors with null or non-finite components, and those of other lengths take no part.
    """
    rows = usable(vectors, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    if not len(sample):
        return CellIndex(rows.select(F.lit(0).alias("cell"), F.lit(0).alias("part"), "id", "v"), np.zeros((0, 0)), np.zeros(0, int), 1)
    dims = int(sample.map(len).mode()[0])
    x = np.stack(sample[sample.map(len) == dims])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = rows.where(F.size("v") == dims)
    n = rows.count()
    centres = fit_centres(x, min(cells or int(np.ceil(np.sqrt(n))), MOST_CELLS, len(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own = (_matrix(pa.chunked_array([batch.column(1)])) @ centres.T).argmax(1)
                yield pa.record_batch([pa.array(own.astype(np.int32)), batch.column(0), batch.column(1)], names=["cell", "id", "v"])

    dealt = stored(rows.mapInArrow(run, "cell int, id bigint, v array<double>"))
    sizes = {r["cell"]: r["n"] for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = np.asarray([-(-max(1, sizes.get(c, 0)) // BLOCK) for c in range(len(centres))])
    part = F.pmod(F.xxhash64("id"), F.element_at(F.array(*(F.lit(int(p)) for p in parts)), F.col("cell") + 1)).cast("int")
    return CellIndex(dealt.select("cell", part.alias("part"), "id", "v"), centres, parts, fit_probes(x, centres, recall))


def load_cells(spark: SparkSession, path: str) -> CellIndex:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    cells = spark.read.schema("part int, id bigint, v array<double>, cell int").parquet(f"{path}/cells")
    return CellIndex(cells.select("cell", "part", "id", "v"), np.asarray([r["centre"] for r in rows], float).reshape(len(rows), -1), np.asarray([r["parts"] for r in rows], int), rows[0]["probes"] if rows else 1)
