"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are the bit majorities of hashed word shingles. Links (few differing bits) are found
by partitions of correlated bits with unequal thresholds: if the thresholds t_i of the partitions sum
to at least limit - parts + 1 (a partition may have -1: not probed), then two fingerprints within the
limit are within t_i in at least one partition. The thresholds come from a dynamic programme over
estimated candidate counts. Every candidate is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEYS, SPACE, cut, mix, partitions, release, salted_join, sweep, table, text_buffers, word_spans
from .components import components

BITS = 64
#: Fingerprints of a bucket that are compared with each other in one task, and with how many others that
#: probe it; larger buckets are dealt out.
BUCKET = 1 << 14
PROBING = 1 << 17
ROW_PRICE = 2000
#: Pairs of fingerprints that are compared at a time.
PAIRS = 1 << 17
#: Rows of keys that are shuffled at a time: so many for each fingerprint, and this number in any case. How many
#: keys a fingerprint has grows with the fingerprints.
ROUND = 32
LEAST_ROUND = 1 << 22

#: The bits of a byte as the bytes of a number.
_LANES = np.asarray([sum((x >> b & 1) << 8 * b for b in range(8)) for x in range(256)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts, in order, and how many of them each text has."""
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    # the words again, with one space after each, so that a shingle is one slice
    solid = ~SPACE[data]
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - lengths - 1
    flat = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    flat[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(starts)), lengths)] = _LOWER[data[solid]]
    view, end = flat.tobytes(), at + lengths
    n_words = np.diff(first)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
    lo = np.repeat(first[:-1], n_shingles) + np.arange(int(n_shingles.sum())) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    hi = np.minimum(lo + words, np.repeat(first[1:], n_shingles)) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(view[a:b], seed) for a, b in zip(at[lo].tolist(), end[hi].tolist(), strict=True)), np.uint64, len(lo)), n_shingles


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int, seed: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    h, n = shingles(data, offsets, words, seed)
    return [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])]


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int, seed: int) -> np.ndarray:
    """The fingerprint of each text: bit i is set if it is in over half of the shingles' hashes."""
    return majorities(*shingles(data, offsets, words, seed))


def majorities(h: np.ndarray, n_shingles: np.ndarray, more: int = 0) -> np.ndarray:
    """Fingerprints of hashes, so many for each text.

    Columns after the first are fingerprints by other hashes, made from the first one.
    """
    out = np.zeros((len(n_shingles), 1 + more), np.uint64)
    full = np.flatnonzero(n_shingles)
    begin = (np.cumsum(n_shingles) - n_shingles)[full]
    # up to 255 hashes of a text are counted in eight numbers of eight bytes, a byte a bit
    pieces = -(-n_shingles[full] // 255)
    of = np.repeat(np.arange(len(full)), pieces)
    start = begin[of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    for column in range(1 + more):
        counts, lo = np.zeros((len(full), BITS), np.int64), 0
        while lo < len(of):  # bits of a bounded number of hashes at a time
            hi = max(lo + 1, int(np.searchsorted(start, start[lo] + (1 << 14))))
            lanes = _LANES[h[start[lo] : start[hi] if hi < len(of) else len(h)].view(np.uint8)].reshape(-1, 8)
            np.add.at(counts, of[lo:hi], np.add.reduceat(lanes, start[lo:hi] - start[lo], axis=0).view(np.uint8))
            lo = hi
        major = (counts * 2 > n_shingles[full][:, None]).astype(np.uint64)
        out[full, column] = (major << np.arange(BITS, dtype=np.uint64)).sum(1, dtype=np.uint64)
        h = mix(h + np.uint64(0x9E3779B97F4A7C15))
    return out


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 4, seed: int = 42) -> DataFrame:
    """(id, f): the fingerprint as a signed long, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_buffers(batch.column(1)):
                f = fingerprints(data, offsets, words, seed)
                yield pa.record_batch([batch.column(0).slice(first, len(f)), pa.array(f[:, 0].copy().view(np.int64))], names=[id_col, "f"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"{id_col} bigint, f bigint")


def plan_partitions(sample: np.ndarray, n: int, limit: int, parts: int) -> list[tuple[int, int]]:
    """(mask of bits, threshold) of the partitions to probe, for n distinct fingerprints like the sample.

    Bits that agree most with a partition's bits are grouped, since a partition whose bits depend on
    one another tells little about the rest and is best spent once; the thresholds minimise the
    estimated number of candidates plus probes under the generalised pigeonhole condition.
    """
    bits = np.unpackbits(sample.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float) if len(sample) else np.zeros((1, BITS))
    centred = bits - bits.mean(0)
    scale = np.sqrt((centred**2).sum(0))
    corr = np.abs(centred.T @ centred) / np.maximum(np.outer(scale, scale), 1e-9)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - k)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: corr[b, group].sum())
            left.remove(best)
            group.append(best)
        groups.append(group)
    masks = [sum(1 << b for b in g) for g in groups]
    cost = np.full((parts, limit + 2), np.inf)  # by partition and threshold + 1
    few = sample[: 1 << 11].astype(np.uint64)
    for i, mask in enumerate(masks):
        near = np.cumsum(np.bincount(np.bitwise_count((few[:, None] ^ few[None, :]) & np.uint64(mask)).ravel(), minlength=BITS + 1))
        pairs = max(1, len(few) * (len(few) - 1))
        probes, c = 0.0, 1.0
        cost[i, 0] = 0.0
        for t in range(limit + 1):
            probes += c
            c = c * (len(groups[i]) - t) / (t + 1)
            share = max((float(near[t]) - len(few)) / pairs, probes / 2.0 ** len(groups[i]))
            cost[i, t + 1] = share * n * n / 2 + probes * n * 4
    need = limit - parts + 1  # sum of the thresholds
    best = {0: (0.0, [])}
    for i in range(parts):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (value, path) in best.items():
            for t in range(-1, limit + 1):
                seen = step.get(total + t)
                if seen is None or value + cost[i, t + 1] < seen[0]:
                    step[total + t] = (value + cost[i, t + 1], [*path, t])
        best = step
    path = min((v for k, v in best.items() if k >= need), key=lambda v: v[0])[1]
    return [(mask, t) for mask, t in zip(masks, path, strict=True) if t >= 0]


def choose_plan(sample: np.ndarray, n: int, limit: int, share: float = 1.0) -> list[tuple[int, int]]:
    """The cheapest plan over the numbers of partitions, judged by keys a fingerprint and candidates.

    A key is a row that is shuffled, once for each part that its bucket is cut into; it costs as much as ROW_PRICE
    comparisons. share is the part of a bucket's pairs that are compared.
    """
    best = None
    for parts in range(max(2, limit // 2), limit + 2):
        plan, price = plan_partitions(sample, n, limit, parts), 0.0
        for mask, t in plan:
            size = bin(mask).count("1")
            patterns, plains = sum(_choose(size, d) for d in range(t + 1)), n / 2.0**size
            price += (patterns + 1) / 2 * max(1.0, plains / BUCKET) * ROW_PRICE + plains * patterns / 2 * share
        if best is None or price < best[0]:
            best = (price, plan)
    return best[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _probes(plan: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """By partition: its number, its mask, and the bit patterns to flip within its threshold."""
    out = []
    for k, (mask, t) in enumerate(plan):
        bits = [b for b in range(BITS) if mask >> b & 1]
        out.append((k, mask, [sum(1 << b for b in c) for d in range(t + 1) for c in combinations(bits, d)]))
    return out


def _rounds(rows: list[int], limit: int) -> list[tuple[list[int], int, int]]:
    """(partitions, residue, modulus) of rounds of at most limit rows, given each partition's rows.

    A partition with more rows has rounds of its own, one for each residue of its keys.
    """
    out: list[tuple[list[int], int, int]] = []
    some, total = [], 0
    for k, n in enumerate(rows):
        if n > limit:
            out += [([k], r, -(-n // limit)) for r in range(-(-n // limit))]
            continue
        if total + n > limit:
            out.append((some, 0, 1))
            some, total = [], 0
        some.append(k)
        total += n
    return [*out, (some, 0, 1)] if some or not out else out


def _near(f: np.ndarray, n: np.ndarray, own: int, limit: int, least: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs within the limit of the first own rows, and between them and the other rows of a bucket.

    Of sizes n the smaller is at least that share of the larger. Both the first own and the others are sorted by n, so
    that a row meets a stretch of them; about PAIRS are compared at a time.
    """
    for first, rest in ((0, n[:own]), (own, n[own:])):
        lo = 0
        while lo < own:
            begin = lo + 1 if not first else int(np.searchsorted(rest, -(-int(n[lo]) * least[0] // least[1])))
            upto = lambda hi: int(np.searchsorted(rest, int(n[hi - 1]) * least[1] // least[0], "right"))  # noqa: B023, E731
            hi = min(own, lo + max(1, PAIRS // max(1, upto(lo + 1) - begin)))
            while hi - lo > 1 and (hi - lo) * (upto(hi) - begin) > PAIRS:
                hi = lo + (hi - lo) // 2
            end = upto(hi)
            for at in range(begin, end, PAIRS):
                other = f[first + at : first + min(end, at + PAIRS)]
                close = np.flatnonzero((np.bitwise_count(f[lo:hi, None] ^ other[None, :]) <= limit).ravel())
                if len(close):
                    a, b = close // len(other) + lo, close % len(other) + first + at
                    ok = (a < b) & (np.minimum(n[a], n[b]) * least[1] >= np.maximum(n[a], n[b]) * least[0])
                    yield a[ok], b[ok]
            lo = hi


def _forest(f: np.ndarray, g: np.ndarray, n: np.ndarray, own: int, limit: int, overall: int, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of those pairs that are also within `overall`."""
    root, us, vs = np.arange(len(f)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _near(f, n, own, limit, least):
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        if g.shape[1] and len(a):
            ok = np.bitwise_count(g[a] ^ g[b]).sum(1) + np.bitwise_count(f[a] ^ f[b]) <= overall
            a, b = a[ok], b[ok]
        while len(a):
            # each root hooks on to a smaller one by one link
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            _, one = np.unique(high, return_index=True)
            us.append(a[one])
            vs.append(b[one])
            root[high[one]] = low[one]
            while (root != root[root]).any():
                root = root[root]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
    return np.concatenate(us), np.concatenate(vs)


def _matrix(f: np.ndarray, g: list[bytes]) -> np.ndarray:
    """All fingerprints of each row as columns."""
    return np.column_stack([f.view(np.uint64), np.frombuffer(b"".join(g), np.uint64).reshape(len(f), -1)]) if len(f) else np.zeros((0, 1), np.uint64)


def _part(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Part and slice of each row as one number; zero where buckets are whole."""
    if "part" not in t.schema.names:
        return np.zeros(len(t), np.int64)
    return t.column("part").to_numpy().astype(np.int64) << 32 | t.column("slice").to_numpy().astype(np.int64)


def _size_share(n: np.ndarray, least: tuple[int, int]) -> float:
    """The part of all pairs of sizes whose smaller one is at least that share of the larger."""
    n = np.sort(n)
    reach = np.searchsorted(n, n * least[1] // least[0], "right") - np.arange(len(n))
    return 2 * float(reach.sum()) / len(n) ** 2 if len(n) else 1.0


def hamming_links(points: DataFrame, limit: int, overall: int = 0, columns: int = 1, sample_rows: int = 4096, least: tuple[int, int] = (1, 1)) -> DataFrame:
    """(u, v): links that join what links of at most limit differing bits join.

    points has distinct rows (f, g, node). Where g holds further fingerprints, a link must also differ in
    at most `overall` bits of f and g together. A bucket's links are thinned to a spanning forest, which
    has the same components. With columns > 1 the first of g's fingerprints propose pairs as f does. Where points has
    sizes n, the smaller one of a link is at least the share `least` of the larger; a bucket is sorted by them and
    compared as far as they reach. Of two patterns the one whose lowest differing bit is 0 probes the other. The
    plan is fitted on sample_rows fingerprints and the exact count. A bucket's plain patterns are compared with all that probe it; where there are more than BUCKET of
    the former or PROBING of the latter, both are cut, and each part meets each slice in a group of its own.
    Keys are dealt in rounds, and a round's shuffle is given up before the next; points should be cheap to read again.
    """
    spark = points.sparkSession
    n = points.count()
    points = points.select("f", "g", "node", F.col("n").cast("bigint").alias("n") if "n" in points.columns else F.lit(1).cast("bigint").alias("n"))
    rows = points.orderBy(F.xxhash64("f")).limit(sample_rows).select("f", "g", "n").collect()
    share = _size_share(np.asarray([r.n for r in rows], np.int64), least)
    sample = _matrix(np.asarray([r.f for r in rows], np.int64), [r.g for r in rows])
    probes: list[tuple[int, int, int, list[int]]] = []  # the column that proposes, then as _probes
    for column in range(columns):
        probes += [(column, len(probes) + k, mask, flips) for k, mask, flips in _probes(choose_plan(np.ascontiguousarray(sample[:, column]) if len(rows) else np.zeros(0, np.uint64), n, limit, share))]
    assert len(probes) <= 64  # a key's last six bits

    def deal(flipped: bool, only: list[int], residue: int = 0, modulus: int = 1):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, len(batch), 8192):
                    part = batch.slice(lo, 8192)
                    whole = _matrix(part.column(0).to_numpy(), part.column(1).to_pylist()) if columns > 1 else None
                    of, f, given = -1, part.column(0).to_numpy().view(np.uint64), part.columns[:2]
                    for column, k, mask, flips in (probes[k] for k in only):
                        if columns > 1 and column != of:
                            of, f = column, np.ascontiguousarray(whole[:, column])
                            given = [pa.array(f.view(np.int64)), pa.array([r.tobytes() for r in np.delete(whole, column, 1)], pa.binary())]
                        for i, flip in enumerate(flips if flipped else flips[:1]):
                            key = mix(((f ^ np.uint64(flip)) & np.uint64(mask)) + np.uint64(k)) & ~np.uint64(63) | np.uint64(k)
                            out = pa.record_batch([pa.array(key.view(np.int64)), *given, *part.columns[2:], pa.array(np.full(len(f), i == 0))], names=["key", "f", "g", "node", "n", "plain"])
                            keep = f & np.uint64(flip & -flip) == 0
                            if modulus > 1:
                                keep &= (key >> np.uint64(6)) % np.uint64(modulus) == residue
                            yield out if keep.all() else out.filter(pa.array(keep))

        return run

    schema = "key bigint, f bigint, g binary, node bigint, n bigint, plain boolean"
    all_of = list(range(len(probes)))
    plain = points.mapInArrow(deal(False, all_of), schema)
    hot = cut(plain.groupBy("key").agg(F.count(F.lit(1)).alias("plains")).where(F.col("plains") > BUCKET))
    rows = [n * (len(flips) + 1) // 2 for *_, flips in probes]
    # who probes a bucket is plain in a neighbouring one, so without large buckets no bucket has many to probe it
    if split := not hot.isEmpty():
        every = points.mapInArrow(deal(True, all_of), schema)
        sizes = every.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("plain").cast("long")).alias("plains"))
        sizes = sizes.where((F.col("plains") > BUCKET) | (F.col("size") > PROBING) & (F.col("plains") > 0)).withColumn("parts", F.ceil(F.col("plains") / BUCKET).cast("int")).withColumn("slices", F.ceil(F.col("size") / PROBING).cast("int"))
        hot = cut(sizes.select("key", "parts", "slices", (F.col("size") * (F.col("parts") - 1) + F.col("plains") * (F.col("slices") - 1)).alias("more")))
        for r in hot.groupBy(F.col("key").bitwiseAND(63).alias("k")).agg(F.sum("more").alias("more")).collect():
            rows[r.k] += r.more
        hot = hot.drop("more")
        hot = F.broadcast(hot) if hot.count() <= FEW else hot
    rounds = _rounds(rows, max(LEAST_ROUND, ROUND * n))
    tasks = min(partitions(spark), max(spark.sparkContext.defaultParallelism, -(-partitions(spark) // len(rounds))))

    def dealt(only: list[int], residue: int, modulus: int) -> DataFrame:
        """The keys of a round. Part -1: not split. A plain pattern of a split bucket is compared in its own part with
        every slice of those that probe the bucket, and is in one of these slices itself for the other parts."""
        every = points.mapInArrow(deal(True, only, residue, modulus), schema)
        out = every.select("key", "f", "g", "node", "n", "plain")
        if split:
            keyed = every.join(hot, "key", "left")
            own, at = F.pmod(F.xxhash64("f"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("f", "node"), F.col("slices")).cast("int")
            slices = lambda part: F.when(F.col("plain") & (part == F.col("own")), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array("at"))
            groups = F.flatten(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda part: F.transform(slices(part), lambda k: F.struct(part.alias("part"), k.alias("slice")))))
            one = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).alias("slice")))
            out = keyed.withColumn("own", own).withColumn("at", at).withColumn("to", F.explode(F.when(F.col("parts").isNull(), one).otherwise(groups))).select("key", "f", "g", "node", "n", "plain", "own", "to.part", "to.slice")
            out = out.withColumn("plain", F.col("plain") & ((F.col("part") == -1) | (F.col("part") == F.col("own")))).drop("own")
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, part = t.column("key").to_numpy(), _part(t)
            f, node, is_plain = t.column("f").to_numpy().view(np.uint64), t.column("node").to_numpy(), t.column("plain").to_numpy(zero_copy_only=False)
            n = t.column("n").to_numpy()
            raw = b"".join(t.column("g").to_pylist())
            g = np.frombuffer(raw, np.uint64).reshape(len(f), -1)
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            us, vs = [], []
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(f)], strict=True):
                if b - a > 1 and is_plain[a:b].any():
                    order = a + np.lexsort((n[a:b], ~is_plain[a:b]))
                    u, v = _forest(f[order], g[order], n[order], int(is_plain[a:b].sum()), limit, overall, least)
                    us.append(node[order[u]])
                    vs.append(node[order[v]])
            if us:
                yield pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

        wait: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            # all but the last group of what has come can be compared
            key, part = batch.column(0).to_numpy(), _part(batch)
            last = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1 if (key[0], part[0]) != (key[-1], part[-1]) else 0
            same = bool(wait) and (wait[-1].column(0)[0].as_py(), _part(wait[-1])[0]) == (key[-1], part[-1])
            if last or not same:
                whole = [*wait, batch.slice(0, last)]
                whole = [w for w in whole if len(w)]
                if whole:
                    yield from links(pa.Table.from_batches(whole).combine_chunks())
                wait = []
            wait.append(batch.slice(last))
        if wait:
            yield from links(pa.Table.from_batches(wait).combine_chunks())
        wait = []
        release()

    def linked(*of_round) -> DataFrame:
        by = ["key", "part", "slice"] if split else ["key"]
        return dealt(*of_round).repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(compare, "u bigint, v bigint")

    if len(rounds) == 1:
        return linked(*rounds[0])
    found = None
    for of_round in rounds:
        links = cut(linked(*of_round))
        found = links if found is None else found.unionByName(links)
        sweep(spark)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, limit: int = 4, seed: int = 42) -> DataFrame:
    """(id, f, component_id): the fingerprint and the smallest id reachable by links, for each row.

    Links have at most limit differing bits. Copies share a fingerprint, and so a node: they are never
    paired. Null and empty texts, and those of white space, have fingerprint zero. Rows of one id are one
    node each way they link. A row with a null id gets the component of its fingerprint, but never names
    one (null if it is alone).
    """
    marked = cut(with_fingerprints(docs, id_col, text_col, words, seed))
    # nodes are fingerprints' smallest ids; an id with several texts links their fingerprints
    classes = cut(marked.groupBy("f").agg(F.min(id_col).alias("node"), F.count(F.lit(1)).alias("_n")).where(F.col("node").isNotNull()))
    several = marked.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("f").alias("least"), F.max("f").alias("most"), F.count(F.lit(1)).alias("_n")).where(F.col("least") != F.col("most"))
    of = lambda x, name: classes.select(F.col("f").alias(x), F.col("node").alias(name))
    ends = cut(salted_join(marked, several.select(id_col, "least"), [id_col], counts=several.select(id_col, "_n")).select("f", "least").distinct())
    same = ends.join(of("f", "u"), "f").join(of("least", "v"), "least").select("u", "v")
    found = components(hamming_links(classes.select("f", F.lit(b"").alias("g"), "node"), limit).unionByName(same))
    to = classes.join(found, "node", "left").select("f", F.coalesce("component", "node").alias("component_id"))
    return salted_join(marked, to, ["f"], "left", counts=classes.select("f", "_n")).select(id_col, "f", "component_id")


#: The stage of the pipeline: five-word shingles. Any of four fingerprints proposes, 256 bits thin out, and
#: the shingle sets decide: a Jaccard similarity of at least `least` (a fraction). Texts of a similarity of 0.8
#: differ in about 15 % of the bits, unrelated ones in half.
STAGE = {"words": 5, "limit": 12, "more": 3, "overall": 64, "least": (4, 5)}

#: Ids up to which the documents of proposed links are found by a broadcast.
FEW = 1 << 20


#: Links of a text up to which they meet its shingles in one task.
MANY_LINKS = 1024


def _with_set(links: DataFrame, sets: DataFrame, end: str, counts: DataFrame, rows: int) -> DataFrame:
    if counts.where(F.col("_n") > MANY_LINKS).isEmpty():
        return links.join(sets, end)
    return salted_join(links, sets, [end], counts=counts, rows=max(rows, MANY_LINKS * HOT_KEYS))


#: Texts of a block that is compared with another one in a task, and columns of shingles at a time.
TEXTS = 256
SHINGLES = 8192


def _across(placed: DataFrame, classes: DataFrame, texts: DataFrame, listed: Callable, least: tuple[int, int]) -> DataFrame | None:
    """(u, v): links that join what links between different groups of a cluster join; None if no cluster has several.

    placed has (node, cluster, at), at being the group. Every text outside a cluster's largest group is
    compared with every text of another group, by their sets and in pairs of blocks, and only links come
    out, thinned to a forest. The largest group's texts are not compared with one another.
    """
    groups = cut(placed.groupBy("cluster", "at").agg(F.count(F.lit(1)).alias("n")))
    clusters = groups.groupBy("cluster").agg(F.max(F.struct("n", "at")).alias("top"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    blocks = lambda n: F.ceil(n / TEXTS).cast("int")
    clusters = cut(clusters.select("cluster", "_n", F.col("top.at").alias("largest"), blocks(F.col("top.n")).alias("inner"), blocks(F.col("_n") - F.col("top.n")).alias("outer")))
    if clusters.isEmpty():
        return None
    points = cut(salted_join(placed, clusters.drop("_n"), ["cluster"], counts=clusters.select("cluster", "_n")).withColumn("inside", F.col("at") == F.col("largest")))
    ids = cut(points.join(classes, "node").select("id").distinct())
    ids = F.broadcast(ids) if ids.count() <= FEW else ids
    sets = texts.join(ids, "id", "left_semi").mapInArrow(listed, "node bigint, shingles array<bigint>").dropDuplicates(["node"])
    own = F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    key = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    # outer blocks meet each other (kind 0) and the blocks of the largest group (kind 1)
    met = F.concat(F.transform(upto(F.col("outer")), lambda k: key(0, F.least("own", k), F.greatest("own", k))), F.transform(upto(F.col("inner")), lambda k: key(1, F.col("own"), k)))
    to = F.when(F.col("inside"), F.transform(upto(F.col("outer")), lambda k: key(1, k, F.col("own")))).otherwise(met)
    dealt = points.join(sets, "node").withColumn("own", own).withColumn("to", F.explode(to)).select("cluster", "to.kind", "to.a", "to.b", "inside", "own", "node", "at", "shingles")

    def compare(key, group):
        kind, a, b = (k.as_py() for k in key[1:])
        group = group.combine_chunks().sort_by("node")
        inside, block = group.column("inside").to_numpy(zero_copy_only=False), group.column("own").to_numpy()
        node, at = group.column("node").to_numpy(), group.column("at").to_numpy()
        column = group.column("shingles").combine_chunks()
        begin = np.asarray(column.offsets, np.int64) - int(column.offsets[0].as_py())
        flat, row = column.flatten().to_numpy(), np.repeat(np.arange(len(node)), np.diff(begin))
        left = np.flatnonzero(~inside & (block == a))
        right = np.flatnonzero(inside) if kind else np.flatnonzero(~inside & (block == b))
        us, vs = similar_pairs(flat, row, np.diff(begin), left, right, at, least)
        return pa.table({"u": pa.array(node[us]), "v": pa.array(node[vs])})

    return cut(dealt.groupBy("cluster", "kind", "a", "b").applyInArrow(compare, "u bigint, v bigint"))


def similar_pairs(flat: np.ndarray, row: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs of left and right rows of different groups (at) whose sets are alike.

    flat holds the rows' sets one after the other, row the row of each element.
    """
    shared = np.zeros((len(left), len(right)), np.float32)
    values, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    several = np.cumsum(often > 1) - 1  # what stands in one set only is in no intersection
    code, row = several[code][often[code] > 1], row[often[code] > 1]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    place = np.full((2, len(sizes)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, SHINGLES):
        a, z = np.searchsorted(code, (lo, lo + SHINGLES))
        sides = []
        for side, n in ((place[0], len(left)), (place[1], len(right))):
            at_ = side[row[a:z]]
            ones = np.zeros((n, SHINGLES), np.float32)
            ones[at_[at_ >= 0], code[a:z][at_ >= 0] - lo] = 1
            sides.append(ones)
        shared += sides[0] @ sides[1].T
    shared = shared.astype(float)
    alike = shared * least[1] >= (sizes[left][:, None] + sizes[right][None, :] - shared) * least[0]
    i, j = np.nonzero(alike & (at[left][:, None] != at[right][None, :]))
    # one link for each pair of groups is enough
    a, b = at[left][i], at[right][j]
    _, first = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1, return_index=True)
    return left[i[first]], right[j[first]]


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, limit: int = 12, more: int = 3, overall: int = 64, least: tuple[int, int] = (4, 5), seed: int = 42) -> DataFrame:
    """(id, component_id): the smallest id reachable by links of a shingle similarity of at least `least`.

    Nodes are distinct shingle sets, so copies are never paired; their fingerprints are of sets, not of
    repeats. The bits propose a spanning forest, whose links are verified on the sets. Where one fails, the
    groups at its ends may be joined by pairs that the forest left out: texts of different groups of such a
    cluster are compared by their sets. So every proposed pair is verified or lies in one group anyway.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_buffers(batch.column(1)):
                sets = shingle_sets(data, offsets, words, seed)
                n = np.asarray([len(x) for x in sets], np.int64)
                f = majorities(np.concatenate(sets), n, more)
                node = np.asarray([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64)
                further = pa.array([r.tobytes() for r in np.ascontiguousarray(f[:, 1:])], pa.binary())
                yield pa.record_batch([batch.column(0).slice(first, len(f)), pa.array(node.view(np.int64)), pa.array(n), pa.array(f[:, 0].copy().view(np.int64)), further], names=["id", "node", "n", "f", "g"])
        release()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_buffers(batch.column(1)):
                sets = shingle_sets(data, offsets, words, seed)
                node = np.asarray([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64)
                yield pa.record_batch([pa.array(node.view(np.int64)), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "shingles"])
        release()

    marked = cut(texts.mapInArrow(mark, "id bigint, node bigint, n bigint, f bigint, g binary"))
    classes = cut(marked.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("id"), F.first("n").alias("n"), F.first("f").alias("f"), F.first("g").alias("g")).where(F.col("id").isNotNull()))

    of = lambda df, x: df.groupBy(x).agg(F.count(F.lit(1)).alias("_n"))

    def verified(pairs: DataFrame) -> DataFrame:
        """(u, v, ok) of distinct pairs: whether the sets are alike."""
        a, b = (classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}")) for x in "uv")
        pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        sized = salted_join(salted_join(pairs, a, ["u"], rows=(n := pairs.count()), counts=of(pairs, "u")), b, ["v"], rows=n, counts=of(pairs, "v"))
        sized = cut(sized.withColumn("may", F.least("nu", "nv") * least[1] >= F.greatest("nu", "nv") * least[0]))
        may = sized.where("may")
        ids = cut(may.select(F.col("u").alias("node")).unionByName(may.select(F.col("v").alias("node"))).distinct().join(classes, "node").select("id").distinct())
        ids = F.broadcast(ids) if ids.count() <= FEW else ids
        sets = texts.join(ids, "id", "left_semi").mapInArrow(listed, "node bigint, shingles array<bigint>").dropDuplicates(["node"])
        # only a text of very many links is dealt out with them: sets are wide, and lie by node already
        one = _with_set(may.select("u", "v"), sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u", of(may, "u"), n)
        both = _with_set(one, sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v", of(may, "v"), n)
        shared = F.size(F.array_intersect("su", "sv"))
        alike = shared * least[1] >= (F.size("su") + F.size("sv") - shared) * least[0]
        return cut(both.select("u", "v", alike.alias("ok")).unionByName(sized.where("not may").select("u", "v", F.lit(False).alias("ok"))))

    many = marked.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("last"), F.count(F.lit(1)).alias("_n")).where(F.col("u") != F.col("last"))
    same = salted_join(marked, many.select("id", "u"), ["id"], counts=many.select("id", "_n")).select("u", F.col("node").alias("v"))  # an id with several texts links their sets
    checked = verified(hamming_links(classes.select("f", "g", "node", "n"), limit, overall, 1 + more, least=least))
    links = checked.where("ok").select("u", "v").unionByName(same)
    found = cut(components(links))
    # all that bits propose lies in one cluster; where links failed, its groups may yet belong together
    cluster = components(checked.select("u", "v")).withColumnRenamed("component", "cluster")
    placed = cut(cluster.join(found, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("at")))
    if further := _across(placed, classes, texts, listed, least):
        found = cut(components(links.unionByName(further)))
    at = cut(classes.join(found, "node", "left").select("node", "id", F.coalesce("component", "node").alias("at")))
    to = salted_join(at, at.groupBy("at").agg(F.min("id").alias("component_id")), ["at"]).select("node", "component_id")
    return salted_join(marked, to, ["node"], "left", counts=classes.select("node", "_n")).select(F.col("id").alias(id_col), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that are the smallest id of their near-duplicates, with all columns; null ids stay.

    Rows that repeat a kept id stay too.
    """
    found = similar_texts(docs, id_col, text_col, **(STAGE | how))
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("bigint") == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), limit=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
