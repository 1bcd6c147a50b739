"""Connected components of links that lie in a table, by rounds of joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join

#: Links that one task contracts at a time, and of a checkpoint file, roughly.
FILE_LINKS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    edges has long columns u and v; null ends, loops and repeats are harmless. Each round links every
    neighbour of a node that is larger than it to the smallest one (large star), then every smaller one
    (small star), and then contracts the links that lie in one file, FILE_LINKS at a time. The links
    converge to stars in a logarithmic number of rounds, and the rounds go on until nothing changes.
    Minima are taken with partial sums before the shuffle, and the links of a node with very many
    neighbours meet its minimum in many tasks.
    """
    now = cut(_clean(edges))
    seen = _digest(now)
    while seen[0]:
        files = 1 + seen[0] // FILE_LINKS
        # few links need few files: what a round leaves is no more than what it was given
        now = cut(now.coalesce(files).mapInArrow(_contract, "u bigint, v bigint"))
        if files == 1:  # one task has seen all links
            break
        now = cut(_star(_star(now, seen[0], larger=True), seen[0], larger=False))
        # a fixed point has the same links: their number and a sum of their hashes say so
        before, seen = seen, _digest(now)
        if before == seen:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of FILE_LINKS rows as stars to their smallest ends."""
    wait, rows = [], 0
    for batch in batches:
        wait.append(batch)
        rows += len(batch)
        if rows > 2 * FILE_LINKS:
            yield _stars(wait)
            wait, rows = [], 0
    if rows:
        yield _stars(wait)


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    u, v = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in (0, 1))
    ends, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(ends))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])  # roots hook on to smaller ones
        while (root != root[root]).any():
            root = root[root]
    far = np.flatnonzero(root != np.arange(len(ends)))
    return pa.record_batch([pa.array(ends[far]), pa.array(ends[root[far]])], names=["u", "v"])


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _star(edges: DataFrame, rows: int, larger: bool) -> DataFrame:
    """edges hold u > v. Large star: x -> min(N(u), u) for x in N(u), x > u; small star: for x <= u."""
    near = edges.select("u", "v")
    if larger:
        near = near.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_n"))
    joined = salted_join(near, least.select("u", "m"), ["u"], counts=least.select("u", "_n"), rows=2 * rows)
    if larger:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return _clean(out)


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
