"""Embedding near-duplicates by a forest of random-projection trees with spill overlap.

A tree splits recursively near the median along random directions; points near a split go to both
sides. Vectors that share a leaf of any tree are compared exactly; links are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, salted_join, table
from .components import components
from .vectors import usable

TREES = 6
#: Vectors that a leaf should hold at most, and how many are compared in one matrix product.
LEAF = 512
BLOCK = 2048
#: Levels that are split in one round, and vectors of a leaf, roughly, on which its medians are fitted.
LEVELS = 4
SAMPLE = 2048
#: Overlap on each side of a split, as a share of the largest distance of a link over sqrt(dimensions).
SPILL = 0.55
#: Directions that are tried for a split, and the share of a node in one side over which a split is no use.
TRIES = 4
LOPSIDED = 0.85
#: A leaf's number is its tree, then its path from the root (1) in so many bits.
PATH = 56
#: Leaves whose splits are broadcast (240 bytes each); more are joined.
SMALL = 1 << 15


@lru_cache(maxsize=1 << 14)
def direction(leaf: int, attempt: int, dims: int) -> np.ndarray:
    """The random unit direction of a node, the same in every task."""
    d = np.random.default_rng([leaf, attempt, dims]).normal(size=dims)
    return d / np.linalg.norm(d)


def child(leaf: int, side: int) -> int:
    tree, path = leaf >> PATH, leaf & ((1 << PATH) - 1)
    return tree << PATH | 2 * path + side


def descend(x: np.ndarray, leaf: int, split: tuple[np.ndarray, np.ndarray], spill: float) -> Iterator[tuple[np.ndarray, int, bool]]:
    """(rows, node, final) of the nodes that a leaf's rows go to; split has a cut (nan: none) and a direction's number a node."""
    stack = [(np.arange(len(x)), leaf, 0)]
    while stack:
        rows, node, k = stack.pop()
        if not len(rows):
            continue
        if k >= len(split[0]) or np.isnan(split[0][k]):
            yield rows, node, k < len(split[0])
            continue
        side = x[rows] @ direction(node, int(split[1][k]), x.shape[1]) - split[0][k]
        stack += [(rows[side <= spill], child(node, 0), 2 * k + 1), (rows[side > -spill], child(node, 1), 2 * k + 2)]


def fit_split(x: np.ndarray, leaf: int, rows: int, spill: float, least: int, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Medians along random directions for the nodes under a leaf of `rows` rows, of which x is a sample.

    A node that should hold at most `least` rows is not split, nor is one that no direction divides: its
    vectors are nearly alike.
    """
    cuts, tries = np.full(2**levels - 1, np.nan), np.zeros(2**levels - 1, np.int32)
    stack = [(np.arange(len(x)), leaf, 0)]
    while stack:
        own, node, k = stack.pop()
        if k >= len(cuts) or len(own) < 2 or len(own) * rows <= least * len(x) or (node & ((1 << PATH) - 1)) >> (PATH - 2):
            continue
        for attempt in range(TRIES):
            side = x[own] @ direction(node, attempt, x.shape[1])
            cut_ = float(np.median(side))
            low, high = own[side <= cut_ + spill], own[side > cut_ - spill]
            if max(len(low), len(high)) <= LOPSIDED * len(own):
                cuts[k], tries[k] = cut_, attempt
                stack += [(low, child(node, 0), 2 * k + 1), (high, child(node, 1), 2 * k + 2)]
                break
    return cuts, tries


def leaf_links(x: np.ndarray, count: np.ndarray, places: list[np.ndarray], leaf: int, threshold: float, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between own and other rows of one leaf: what each own row gains, and a forest's ends.

    A pair that shares several leaves counts only in the first of them. Rows are unit vectors; other
    comes after own or is it.
    """
    gain = np.zeros(len(x), np.int64)
    root = np.arange(len(x))
    us, vs = [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    # earlier leaves that several rows share: only these can be a pair's first
    earlier = np.concatenate([p[p < leaf] for p in places]) if places else np.zeros(0, np.int64)
    seen, often = np.unique(earlier, return_counts=True)
    seen = seen[often > 1]
    for lo in range(0, len(own), BLOCK):
        a = own[lo : lo + BLOCK]
        for ro in range(0, len(other), BLOCK):
            b = other[ro : ro + BLOCK]
            linked = x[a] @ x[b].T >= threshold
            linked[a[:, None] == b[None, :]] = False
            i, j = np.nonzero(linked)
            if len(i) > 4 * len(x):  # a dense leaf: earlier common leaves of all rows at once, some columns at a time
                for col in range(0, len(seen), 1024):
                    part = seen[col : col + 1024]
                    linked &= _member(places, a, part) @ _member(places, b, part).T == 0
                i, j = np.nonzero(linked)
                i, j = a[i], b[j]
            else:
                i, j = a[i], b[j]
                first = np.fromiter((not np.intersect1d(places[p][places[p] < leaf], places[q][places[q] < leaf], True).size for p, q in zip(i, j, strict=True)), bool, len(i))
                i, j = i[first], j[first]
            np.add.at(gain, i, count[j])
            for p, q in zip(i.tolist(), j.tolist(), strict=True) if len(i) <= 4 * len(x) else _thin(i, j):
                p, q = find(p), find(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    us.append(p)
                    vs.append(q)
    return gain, np.asarray(us, np.int64), np.asarray(vs, np.int64)


def _member(places: list[np.ndarray], rows: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Which of the leaves each row is in, as ones and zeros."""
    out = np.zeros((len(rows), len(leaves)), np.float32)
    for k, r in enumerate(rows.tolist()):
        at = np.searchsorted(leaves, places[r])
        at = at[at < len(leaves)]
        out[k, at[np.isin(leaves[at], places[r])]] = 1
    return out


def _thin(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ends of links that join what the links i-j of a dense block join."""
    ends = np.unique(np.concatenate([i, j]))
    label = np.arange(len(ends))
    a, b = np.searchsorted(ends, i), np.searchsorted(ends, j)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return zip(ends.tolist(), ends[label].tolist(), strict=True)


def _unit(parts: list[bytes], dims: int) -> np.ndarray:
    """Vectors of 4 or 8 bytes a component as unit vectors of doubles."""
    x = np.stack([np.frombuffer(p, np.float32 if len(p) == 4 * dims else float).astype(float) for p in parts])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


STATE = "node bigint, count bigint, label string, dims int, x binary, leaves array<bigint>, done array<boolean>"


def grow_forest(state: DataFrame, threshold: float, leaf: int = LEAF) -> DataFrame:
    """state (STATE) with each vector's leaves in all trees, by rounds of LEVELS levels.

    A round fits the splits of every leaf over `leaf` rows on a sample of it, in a task a leaf, and
    sends the vectors down. It ends when no leaf is too large but those of vectors nearly alike.
    """
    keys = ["label", "dims", "leaf"]
    spill_of = lambda dims: SPILL * float(np.sqrt(2 - 2 * threshold) / np.sqrt(dims))

    def fit(key, rows):
        dims, at = key[1].as_py(), key[2].as_py()
        cuts, tries = fit_split(_unit(rows.column("x").to_pylist(), dims), at, rows.column("n")[0].as_py(), spill_of(dims), leaf)
        return pa.table({"label": pa.array([key[0].as_py()], pa.string()), "dims": pa.array([dims], pa.int32()), "leaf": pa.array([at], pa.int64()), "cuts": pa.array([cuts.tolist()], pa.list_(pa.float64())), "tries": pa.array([tries.tolist()], pa.list_(pa.int32()))})

    def moved(batch: pa.RecordBatch, split_of) -> pa.RecordBatch:
        """split_of(row, label, dims, leaf) is the split of a leaf or None."""
        labels, dims, raw = (batch.column(c).to_pylist() for c in ("label", "dims", "x"))
        leaves, done = [list(v) for v in batch.column("leaves").to_pylist()], batch.column("done").to_pylist()
        groups: dict[tuple, list[int]] = {}
        after: list[list[tuple[int, bool]]] = [[] for _ in raw]
        for r, (own, ends) in enumerate(zip(leaves, done, strict=True)):
            for at, end in zip(own, ends, strict=True):
                if end or split_of(r, labels[r], dims[r], at) is None:
                    after[r].append((at, end))
                else:
                    groups.setdefault((labels[r], dims[r], at), []).append(r)
        units = {d: _unit([v for v, e in zip(raw, dims, strict=True) if e == d], d) for d in set(dims)}
        place = {d: {r: k for k, r in enumerate([r for r, e in enumerate(dims) if e == d])} for d in units}
        for (label, d, at), rows in groups.items():
            x = units[d][[place[d][r] for r in rows]]
            for hit, node, final in descend(x, at, split_of(rows[0], label, d, at), spill_of(d)):
                for k in hit.tolist():
                    after[rows[k]].append((node, final))
        columns = [*batch.columns[:5], pa.array([[a for a, _ in v] for v in after], pa.list_(pa.int64())), pa.array([[e for _, e in v] for v in after], pa.list_(pa.bool_()))]
        return pa.record_batch(columns, names=["node", "count", "label", "dims", "x", "leaves", "done"])

    while True:
        open_ = state.select("label", "dims", "node", F.explode(F.arrays_zip("leaves", "done")).alias("z")).where("not z.done").select("label", "dims", "node", F.col("z.leaves").alias("leaf"))
        large = cut(open_.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf))
        if not (m := large.count()):
            return state
        few = m <= SMALL
        asked = open_.join(F.broadcast(large), keys) if few else salted_join(open_, large, keys)
        sample = asked.where(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SAMPLE)) == 0).join(state.select("node", "x"), "node")
        splits = cut(sample.select(*keys, "n", "x").groupBy(*keys).applyInArrow(fit, "label string, dims int, leaf bigint, cuts array<double>, tries array<int>"))
        if few:
            shared = state.sparkSession.sparkContext.broadcast({(r.label, r.dims, r.leaf): (np.asarray(r.cuts), np.asarray(r.tries)) for r in splits.collect()})

            def down(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for lo in range(0, len(batch), 4096):
                        yield moved(batch.slice(lo, 4096), lambda _, label, dims, at: shared.value.get((label, dims, at)))

            state = cut(state.mapInArrow(down, STATE))
        else:  # each vector gets the splits of its own leaves
            given = salted_join(open_, splits, keys).groupBy("node").agg(F.collect_list(F.struct("leaf", "cuts", "tries")).alias("splits"))

            def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for lo in range(0, len(batch), 1024):
                        part = batch.slice(lo, 1024)
                        own = [{s["leaf"]: (np.asarray(s["cuts"], float), np.asarray(s["tries"])) for s in v or ()} for v in part.column("splits").to_pylist()]
                        yield moved(part, lambda r, label, dims, at, own=own: own[r].get(at))

            state = cut(state.join(given, "node", "left").mapInArrow(down, STATE))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(id, n_links, component_id, kept) for every row that has an id.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, as do rows
    whose label is null; vectors of different lengths never link. Rows of equal label and vector are
    one class with its size: they link with each other and are compared once. A repeated id counts by
    its smallest vector; rows without an id are left out. Other columns do not matter. A label of at most
    `leaf` different vectors of a length is one leaf: all of its pairs are compared, without splits.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector")).where("id is not null")
    ids = rows.select("id").distinct()
    good = cut(usable(rows, "id", "vector", "label").where("label is not null").groupBy("id").agg(F.min(F.struct("label", "v")).alias("b")).select("id", "b.label", "b.v"))
    classes = cut(good.groupBy("label", "v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("_n")))
    # the list of vectors with very many copies is broadcast, so it is short
    member = cut(salted_join(good, classes.select("label", "v", "node", F.col("_n").alias("count")), ["label", "v"], counts=classes.select("label", "v", "_n"), hot_keys=2048).select("id", "node", "count"))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for v in batch.column("v").to_pylist():
                v = np.asarray(v, float)
                with np.errstate(over="ignore", under="ignore"):
                    narrow = v.astype(np.float32)
                raw.append((narrow if (narrow == v).all() else v).tobytes())
            roots = [[t << PATH | 1 for t in range(k)] for k in batch.column("trees").to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in ("node", "count", "label", "dims")), pa.array(raw, pa.binary()), pa.array(roots, pa.list_(pa.int64())), pa.array([[False] * len(r) for r in roots], pa.list_(pa.bool_()))], names=["node", "count", "label", "dims", "x", "leaves", "done"])

    points = classes.select("node", F.col("_n").alias("count"), "label", F.size("v").alias("dims"), "v")
    # one leaf holds all of a small label, whatever the tree
    sizes = points.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("_n"))
    dealt = salted_join(points, sizes.select("label", "dims", F.when(F.col("_n") > leaf, trees).otherwise(1).alias("trees")), ["label", "dims"], counts=sizes)
    state = grow_forest(cut(dealt.mapInArrow(start, STATE)), threshold, leaf)
    found = cut(_compare(state, threshold))
    gains = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("gain").alias("gain"))
    joined = components(found.where("v is not null").select("u", "v")).withColumnRenamed("component", "top")
    of = state.select("node").join(gains, "node", "left").join(joined, "node", "left").select("node", F.coalesce("gain", F.lit(0)).alias("gain"), F.coalesce("top", "node").alias("top"))
    out = salted_join(member, of, ["node"], counts=member.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))).select("id", (F.col("gain") + F.col("count") - 1).alias("n_links"), F.col("top").alias("component_id"))
    return ids.join(out, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("component_id", "id") == F.col("id")).alias("kept"))


def _compare(state: DataFrame, threshold: float) -> DataFrame:
    """(u, null, gain) and (u, v, 0): what each vector's links add up to by leaf, and links that join what they join."""
    placed = state.select("node", "count", "label", "dims", "x", "leaves", F.explode("leaves").alias("leaf"))
    # a leaf over BLOCK rows, of vectors nearly alike, is compared by pairs of blocks in tasks of their own
    big = cut(placed.groupBy("label", "dims", "leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    keys = ["label", "dims", "leaf"]
    sized = placed.join(F.broadcast(big), keys, "left") if big.count() <= SMALL else salted_join(placed, big, keys, "left")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = (
        sized.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(*keys, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "count", "x", "leaves")
    )

    def compare(key, group):
        group = group.combine_chunks().sort_by("node")
        x = _unit(group.column("x").to_pylist(), key[1].as_py())
        count, block, node = (group.column(c).to_numpy() for c in ("count", "block", "node"))
        places = [np.sort(np.asarray(p, np.int64)) for p in group.column("leaves").to_pylist()]
        leaf, lo, hi = key[2].as_py(), key[3].as_py(), key[4].as_py()
        own, other = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        gain, us, vs = leaf_links(x, count, places, leaf, threshold, own, other)
        if lo != hi:
            gain += leaf_links(x, count, places, leaf, threshold, other, own)[0]
        linked = np.flatnonzero(gain)
        return pa.table({"u": pa.array(np.concatenate([node[linked], node[us]])), "v": pa.array([None] * len(linked) + node[vs].tolist(), pa.int64()), "gain": pa.array(np.concatenate([gain[linked], np.zeros(len(us), np.int64)]))})

    return dealt.groupBy(*keys, "lo", "hi").applyInArrow(compare, "u bigint, v bigint, gain bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: The same rows by comparing everything with everything, in DuckDB.
ORACLE = r"""
with recursive good as (select vec_id, label, cast(embedding as double[]) as v from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as u, b.vec_id as w from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.93),
reach as (select vec_id as u, vec_id as w from embeddings where vec_id is not null union select r.u, l.w from reach r join links l on l.u = r.w)
select e.vec_id, (select count(*) from links l where l.u = e.vec_id) as n_links, (select min(w) from reach r where r.u = e.vec_id) as component_id, (select min(w) from reach r where r.u = e.vec_id) = e.vec_id as kept from embeddings e
"""
