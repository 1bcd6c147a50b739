"""Best-fit packing by a grouping genetic algorithm on islands.

Items of one length are alike, so a solution is a list of bins, each a tuple of lengths. Crossover
puts whole well-filled bins of one parent into the other, takes out the bins that then hold an item
twice, and fits what fell out by best fit. Items are dealt to shards; each shard is evolved on several
islands whose best solutions migrate between the rounds.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, text_groups, vocabulary
from .common import cut, release, table

#: Pieces of a shard: what one task assigns; a shard's last bin is all that dealing can cost.
SHARD_PIECES = 65_536
ISLANDS = 3
ROUNDS = 2
POPULATION = 4
GENERATIONS = 8
#: Bins that a search goes through, and displaced items that are fitted tightly.
WORK = 20_000
TIGHT = 240

Bins = list[tuple[int, ...]]


def best_fit(lengths: list[int], capacity: int, bins: list[list[int]] | None = None) -> Bins:
    """Put lengths, in the given order, into the tightest bins; bins that are given stay open."""
    bins = bins if bins is not None else []
    open_: dict[int, list[int]] = defaultdict(list)
    mask = 0  # bit r: a bin with r left is open
    for k, b in enumerate(bins):
        left = capacity - sum(b)
        open_[left].append(k)
        mask |= 1 << left
    for length in lengths:
        fits = mask >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            k = open_[left].pop()
            if not open_[left]:
                mask ^= 1 << left
            bins[k].append(length)
        else:
            k, left = len(bins), capacity
            bins.append([length])
        open_[left - length].append(k)
        mask |= 1 << (left - length)
    return [tuple(b) for b in bins]


def tight_fit(lengths: list[int], capacity: int) -> Bins:
    """New bins only: the longest item with the one or two others that leave the least room, again and again.

    Quadratic, so for the displaced items of a step and not for a shard.
    """
    left, out = sorted(lengths), []
    while left:
        first = left.pop()
        room, best = capacity - first, (0, ())
        i, j = 0, len(left) - 1
        while j >= 0 and left[j] > room:
            j -= 1
        if j >= 0:
            best = (left[j], (j,))
        while i < j:
            total = left[i] + left[j]
            if total > room:
                j -= 1
            else:
                if total > best[0]:
                    best = (total, (i, j))
                i += 1
        chosen = [first, *(left[k] for k in best[1])]
        for k in sorted(best[1], reverse=True):
            left.pop(k)
        out.append(tuple(chosen))
    return out


def refit(displaced: list[int], kept: Bins, capacity: int) -> Bins:
    """kept with the displaced items put back: by best fit, or in tight bins of their own if that is fitter."""
    ways = [best_fit(sorted(displaced, reverse=True), capacity, [list(b) for b in kept])]
    if len(displaced) <= TIGHT:
        tight = tight_fit(displaced, capacity)
        full = [b for b in tight if sum(b) == capacity]
        rest = sorted((x for b in tight if sum(b) < capacity for x in b), reverse=True)
        ways += [[*kept, *tight], best_fit(rest, capacity, [list(b) for b in [*kept, *full]])]
    return max(ways, key=lambda w: fitness(w, capacity))


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then fuller ones (the sum of squared fills)."""
    return -len(bins), sum((sum(b) / capacity) ** 2 for b in bins)


def crossover(one: Bins, other: Bins, capacity: int, rng: np.random.Generator) -> Bins:
    """one with some of other's well-filled bins: bins that would hold an item twice go, their rest is refitted."""
    fills = np.asarray([sum(b) for b in other])
    good = np.flatnonzero(fills >= np.quantile(fills, 0.5))
    brought = [other[i] for i in rng.choice(good, max(1, len(good) // 4), replace=False)]
    double = Counter(x for b in brought for x in b)
    kept: Bins = []
    displaced: list[int] = []
    for k in rng.permutation(len(one)):
        b = one[k]
        if any(double[x] > 0 for x in b):
            for x in b:
                if double[x] > 0:
                    double[x] -= 1
                else:
                    displaced.append(x)
        else:
            kept.append(b)
    return refit(displaced, [*kept, *brought], capacity)


def mutate(bins: Bins, capacity: int, rng: np.random.Generator) -> Bins:
    """Take the emptiest bins and a few others apart and fit their items anew."""
    order = np.argsort([sum(b) for b in bins], kind="stable")
    gone = {*order[: max(1, len(bins) // 50)].tolist(), *rng.choice(len(bins), max(2, min(len(bins) // 10, TIGHT // 4))).tolist()}
    return refit([x for k in gone for x in bins[k]], [b for k, b in enumerate(bins) if k not in gone], capacity)


def evolve(counts: dict[int, int], capacity: int, seed: int, migrants: list[Bins] = ()) -> Bins:
    """The best packing found of counts[length] items of each length; stops at the lower bound.

    Without migrants it starts from best fit; with them from the migrants alone.
    """
    items = [x for x in sorted(counts, reverse=True) for _ in range(counts[x])]
    if not items:
        return []
    bound, rng = -(-sum(items) // capacity), np.random.default_rng(seed)
    people = list(migrants) or [best_fit(items, capacity)]
    while len(people) < POPULATION and -max(fitness(p, capacity) for p in people)[0] > bound:
        noise = np.asarray(items) * (1 + rng.normal(0, 0.02 * len(people), len(items)))
        people.append(best_fit([items[i] for i in np.argsort(-noise, kind="stable")], capacity))
    # small shards get more generations for the same work
    for _ in range(max(GENERATIONS, WORK // max(1, len(people[0])))):
        people.sort(key=lambda p: fitness(p, capacity), reverse=True)
        if len(people[0]) <= bound:
            break
        a, b = people[0], people[int(rng.integers(1, len(people)))]
        young = [crossover(a, b, capacity, rng), crossover(b, a, capacity, rng), mutate(a, capacity, rng), mutate(b, capacity, rng)]
        people = sorted([*people, *young], key=lambda p: fitness(p, capacity), reverse=True)[:POPULATION]
    return max(people, key=lambda p: fitness(p, capacity))


def _packed(bins: Bins) -> bytes:
    return zlib.compress(np.asarray([x for b in bins for x in (len(b), *b)], "<u4").tobytes(), 1)


def _unpacked(blob: bytes) -> Bins:
    flat, out, at = np.frombuffer(zlib.decompress(blob), "<u4").tolist(), [], 0
    while at < len(flat):
        out.append(tuple(flat[at + 1 : at + 1 + flat[at]]))
        at += 1 + flat[at]
    return out


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): every document's ids and end_id, cut only where over capacity."""
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)
    schema = f"{id_col} bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        words_of = encoder(shared.value, None, "I")
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for first, group in text_groups(batch.column(1).to_pylist()):
                words = [vocab.words(t) for t in group]
                get = words_of.entries(words)
                at, piece, start, length, crc, parts = [], [], [], [], [], []
                for i, w in enumerate(words):
                    ids = b"".join(map(get, w)) + end
                    for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[lo : lo + 4 * capacity]
                        at.append(first + i)
                        piece.append(k)
                        start.append(lo // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        parts += [part] * with_ids
                columns = [batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))))
                yield pa.record_batch(columns, names=[id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
        release()

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """pieces with sequence_id and offset: their places in sequences of at most capacity.

    Every row is an item of its own, repeated rows and null ids included. Lengths must be from 1 to
    capacity: others raise an error. An empty table stays empty. Columns of pieces that are called
    sequence_id or offset are replaced; others stay, whatever their names. Each shard is packed by best
    fit first; only shards that miss the lower bound are evolved, each island in a task of its own.
    """
    spark, taken = pieces.sparkSession, {"sequence_id", "offset", "_shard", "length"}
    pieces = pieces.drop(*(c for c in pieces.columns if c.lower() in ("sequence_id", "offset")))
    number = "_n"
    while number in taken | {c.lower() for c in pieces.columns}:
        number += "_"
    pieces = cut(pieces.withColumn(number, F.monotonically_increasing_id()))
    shards = max(1, -(-pieces.count() // SHARD_PIECES))
    items = pieces.select(F.pmod(F.xxhash64(number), F.lit(shards)).alias("_shard"), F.col(number).alias("_n"), F.col(length_col).cast("bigint").alias("length"))
    sizes = cut(items.groupBy("_shard", "length").agg(F.count(F.lit(1)).alias("count")))
    schema = "_shard bigint, island int, fewer bigint, fuller double, bins binary"

    def solution(shard: int, island: int, found: Bins) -> pa.Table:
        score = fitness(found, capacity)
        return pa.table({"_shard": pa.array([shard], pa.int64()), "island": pa.array([island], pa.int32()), "fewer": pa.array([score[0]], pa.int64()), "fuller": pa.array([float(score[1])]), "bins": pa.array([_packed(found)], pa.binary())})

    def histogram_of(rows: pa.Table) -> dict[int, int]:
        return dict(zip(rows.column("length").to_pylist(), rows.column("count").to_pylist(), strict=True))

    def fit(key, histogram):
        counts = histogram_of(histogram)
        if None in counts or min(counts) < 1 or max(counts) > capacity:
            raise ValueError(f"lengths must be from 1 to {capacity}")
        return solution(key[0].as_py(), 0, best_fit([x for x in sorted(counts, reverse=True) for _ in range(counts[x])], capacity))

    # shards are few and their tables small: without a number of partitions they would share tasks
    first = cut(sizes.repartition(2 * shards, "_shard").groupBy("_shard").applyInArrow(fit, schema))
    bound = sizes.groupBy("_shard").agg(F.ceil(F.sum(F.col("length") * F.col("count")) / capacity).alias("bound"))
    missed = cut(first.join(bound, "_shard").where(-F.col("fewer") > F.col("bound")).select("_shard"))
    n_missed, solutions = missed.count(), first
    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")

    def evolved(round_: int):
        def run(key, histogram, migrants):
            shard, island = key[0].as_py(), key[1].as_py()
            return solution(shard, island, evolve(histogram_of(histogram), capacity, hash((shard, island, round_)) & 0x7FFFFFFF, [_unpacked(b) for b in migrants.column("bins").to_pylist()]))

        return run

    if n_missed:
        tasks = 2 * n_missed * ISLANDS
        spread = sizes.join(missed, "_shard").select("_shard", "length", "count", islands).repartition(tasks, "_shard", "island")
        after = first.join(missed, "_shard").select("_shard", islands, "bins")
        for round_ in range(ROUNDS):
            elites = cut(spread.groupBy("_shard", "island").cogroup(after.repartition(tasks, "_shard", "island").groupBy("_shard", "island")).applyInArrow(evolved(round_), schema))
            # the best of an island migrates to the next one, and stays on its own
            after = elites.select("_shard", F.explode(F.array("island", ((F.col("island") + 1) % ISLANDS).cast("int"))).alias("island"), "bins")
        solutions = first.join(missed, "_shard", "left_anti").unionByName(elites)
    best = solutions.withColumn("_k", F.row_number().over(Window.partitionBy("_shard").orderBy(F.desc("fewer"), F.desc("fuller"), "island"))).where("_k = 1").select("_shard", "bins")

    def place(key, rows, solution):
        if not len(rows):
            return pa.table({"_n": pa.array([], pa.int64()), "sequence_id": pa.array([], pa.int64()), "offset": pa.array([], pa.int64())})
        slots: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for s, b in enumerate(_unpacked(solution.column("bins")[0].as_py())):
            at = 0
            for x in b:
                slots[x].append((s, at))
                at += x
        base = key[0].as_py() << 32
        ns, lengths = rows.column("_n").to_pylist(), rows.column("length").to_pylist()
        found = [slots[x].pop() for x in lengths]
        return pa.table({"_n": pa.array(ns, pa.int64()), "sequence_id": pa.array([base + s for s, _ in found], pa.int64()), "offset": pa.array([o for _, o in found], pa.int64())})

    placed = items.repartition(2 * shards, "_shard").groupBy("_shard").cogroup(best.repartition(2 * shards, "_shard").groupBy("_shard")).applyInArrow(place, "_n bigint, sequence_id bigint, offset bigint")
    return pieces.join(placed.withColumnRenamed("_n", number), number).drop(number)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document and its place; a null text counts as empty (end_id alone).

    Repeated ids and null ids are documents of their own; other columns of docs are left out.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
