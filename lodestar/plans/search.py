"""An inverted index over any texts: built once, stored, searched by many queries.

    index = build_index(docs)                  # or build_index(docs, "id", "body", tokens="space")
    index.save(path); index = load_index(spark, path)
    index.top(queries, 10, "item_id", "text")  # (query_id, doc_id, score, rk): the ten best
    index.score(queries, "item_id", "text")    # (query_id, doc_id, score): every document with a query's term

Documents are indexed by segments, in one pass without a shuffle. In a segment, BLOCK_DOCS documents of like length
make a block, and a term's postings go by blocks, each with what bounds their impact: the largest count and the
least length. A search for the k best adds up these bounds first. Each segment scores the blocks of highest
bound, which gives every query a threshold; then only blocks whose bound reaches it are read, their weightiest terms
first, and of those only documents that can still reach it go on. No score is written but the k best of a segment.
Exact neighbours of vectors come from matrix products of blocks, with the best k of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stored, written

# fixed values of the scoring formula
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Terms of queries up to which they are broadcast.
FEW_TERMS = 1 << 20
#: Documents and tokens of a segment, at most (a longer document is a segment alone), and documents of a block.
SEGMENT, SEGMENT_TOKENS, BLOCK_DOCS = 1024, 1 << 21, 8
#: Blocks of a segment that a query scores for its threshold, and queries that are scored together.
SEEDS, TOGETHER = 4, 128
#: Shares of a block's bound at which documents that cannot reach the threshold any more are left.
STEPS = (0.3, 0.45, 0.6, 0.75, 0.9, 1.0)
#: What rounding to six places and sums in another order may change.
SLACK = 2e-6
#: Rows of a block of vectors and of queries.
BLOCK, QUERIES = 16_384, 1024


def tokens_of(text: Column, kind: str = "words") -> Column:
    """Lower-cased tokens: runs of letters, digits and _ ("words"), or what white space parts ("space")."""
    if kind == "space":
        return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


@dataclass
class Index:
    """lists, lexicon (term, df, idf) and stats, one row (n, avgdl).

    lists has a row for each term of a segment: docs, dls and tfs, a place for each posting; and for each block with
    the term blocks (its number), ends (where its postings end), most_tf and least_dl.
    """

    lists: DataFrame
    lexicon: DataFrame
    stats: DataFrame
    tokens: str

    @property
    def postings(self) -> DataFrame:
        """(doc_id, dl, term, tf)"""
        return self.lists.select("term", F.explode(F.arrays_zip("docs", "dls", "tfs")).alias("p")).select(F.col("p.docs").alias("doc_id"), F.col("p.dls").cast("bigint").alias("dl"), "term", F.col("p.tfs").cast("bigint").alias("tf"))

    def save(self, path: str) -> None:
        """Parquet; lists in order of terms, so a search for few terms reads few of them."""
        self.lists.repartitionByRange("term", "segment").sortWithinPartitions("term", "segment").write.mode("overwrite").parquet(f"{path}/lists")
        self.lexicon.write.mode("overwrite").parquet(f"{path}/lexicon")
        self.stats.withColumn("tokens", F.lit(self.tokens)).write.mode("overwrite").parquet(f"{path}/stats")

    def terms(self, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(query_id, term, qn) of the queries."""
        term = F.explode(tokens_of(F.col(text_col), self.tokens)).alias("term")
        return queries.select(F.col(id_col).alias("query_id"), term).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))

    def hits(self, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(query_id, qn, doc_id, dl, term, tf, idf): the postings of the queries' terms."""
        asked = stored(self.terms(queries, id_col, text_col).join(self.lexicon, "term"))
        few = asked.count() <= FEW_TERMS  # a checked size; more are joined
        return self.postings.join(F.broadcast(asked) if few else asked, "term")

    def score(self, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", hits: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score) by BM25 of every document with a query's term; repeated terms count again."""
        hits = self.hits(queries, id_col, text_col) if hits is None else hits
        part = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        return hits.crossJoin(F.broadcast(self.stats.select("avgdl"))).groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))

    def top(self, queries: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text", presence: int | None = None) -> DataFrame:
        """(query_id, doc_id, score, rk): the k best of each query by BM25, ties to the smaller document, scores over 0.

        As the k best of score(), without scoring everything. With presence, the score is the sum of idf of the query's
        distinct terms of that many characters or more that stand in the document. Queries without a hit have no rows.
        """
        return self._search(queries, k, id_col, text_col, presence)[0]

    def postings_read(self, queries: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text", presence: int | None = None) -> tuple[int, int]:
        """How many postings top() reads, threshold and all, and how many the queries' terms have, query by query."""
        return tuple(self._search(queries, k, id_col, text_col, presence)[1].agg(F.sum("read"), F.sum("asked")).first())

    def _search(self, queries: DataFrame, k: int, id_col: str, text_col: str, presence: int | None) -> tuple[DataFrame, DataFrame]:
        weight = F.col("idf") if presence else F.col("qn") * F.col("idf")
        terms = self.terms(queries, id_col, text_col).join(self.lexicon, "term").select("query_id", "term", weight.alias("w"))
        terms = stored(terms.where(F.length("term") >= presence) if presence else terms)
        # queries go to every segment, so many of them with at most about FEW_TERMS terms at a time
        turns, found = 1 + terms.count() // FEW_TERMS, []
        for turn in range(turns):
            now = terms if turns == 1 else terms.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn)
            found.append(self._search_few(now, k, presence is not None))
        whole, work = found[0]
        for other, more in found[1:]:
            whole, work = whole.unionByName(other), work.unionByName(more)
        return whole, work

    def _search_few(self, terms: DataFrame, k: int, presence: bool) -> tuple[DataFrame, DataFrame]:
        spark = terms.sparkSession
        rows = self.lists.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
        asked, avgdl = terms.orderBy("query_id", "term").toArrow().combine_chunks(), self.stats.first()["avgdl"]
        names = asked.column("query_id").combine_chunks().dictionary_encode() if len(asked) else None
        shared = spark.sparkContext.broadcast(_Queries(asked, names))
        doc, query = self.lists.schema["docs"].dataType.elementType, terms.schema["query_id"].dataType
        schema = T.StructType([T.StructField("query_id", query), T.StructField("doc_id", doc), T.StructField("score", T.DoubleType()), T.StructField("read", T.LongType()), T.StructField("asked", T.LongType())])

        def scored(least: dict | None) -> DataFrame:
            """The k best of each segment: of its seeds, or of all that may reach the query's least score."""
            out = rows.groupBy("segment").applyInArrow(lambda t: shared.value.best_of(t, avgdl, k, least, presence), schema)
            return stored(out)

        seeds = scored(None)
        least = seeds.where("query_id is not null").transform(lambda df: best(df, k)).where(F.col("rk") == k).select("query_id", "score").collect()
        final = scored({r["query_id"]: r["score"] for r in least})
        work = seeds.where("query_id is null").unionAll(final.where("query_id is null").withColumn("asked", F.lit(0).cast("bigint")))
        return best(final.where("query_id is not null").select("query_id", "doc_id", "score"), k), work.select("read", "asked")


class _Queries:
    """Queries' terms and weights, and the search of one segment for all of them."""

    def __init__(self, asked: pa.Table, names: pa.DictionaryArray | None) -> None:
        self.names = names.dictionary if names is not None else pa.array([])
        self.n = len(self.names)
        order = pc.sort_indices(asked, [("term", "ascending")]).to_numpy() if len(asked) else np.zeros(0, np.int64)
        self.query = names.indices.to_numpy()[order].astype(np.int64) if self.n else np.zeros(0, np.int64)
        self.weight = asked.column("w").to_numpy()[order].astype(float) if self.n else np.zeros(0)
        words = asked.column("term").combine_chunks().take(pa.array(order)).dictionary_encode() if self.n else pa.array([], pa.string()).dictionary_encode()
        self.terms = words.dictionary  # a term's queries lie together
        self.begin = np.searchsorted(words.indices.to_numpy(), np.arange(len(self.terms) + 1))

    def best_of(self, segment: pa.Table, avgdl: float, k: int, least: dict | None, presence: bool) -> pa.Table:
        segment = segment.combine_chunks()
        column = lambda name: segment.column(name).combine_chunks()
        # a row for each block of a term: its postings lie from begin on
        listed, length = np.diff(column("ends").offsets.to_numpy()), np.diff(column("docs").offsets.to_numpy())
        term = np.repeat(pc.index_in(column("term"), self.terms).to_numpy(), listed)
        block = np.unique(column("blocks").flatten().to_numpy(), return_inverse=True)[1]
        end = column("ends").flatten().to_numpy() + np.repeat(np.cumsum(length) - length, listed)
        begin = np.concatenate([np.zeros(1, np.int64), end[:-1]])
        size = end - begin
        docs = column("docs").flatten().dictionary_encode()
        doc, known = docs.indices.to_numpy().astype(np.int64), docs.dictionary
        place = np.empty(len(known), np.int64)
        place[pc.sort_indices(known).to_numpy()] = np.arange(len(known))
        norm = lambda dl: K1 * (1 - B + B * dl / avgdl)
        tf, dl = (column(c).flatten().to_numpy().astype(float) for c in ("tfs", "dls"))
        most = column("most_tf").flatten().to_numpy().astype(float)
        impact = np.ones(len(tf)) if presence else tf * (K1 + 1) / (tf + norm(dl))
        bound = np.ones(len(most)) if presence else most * (K1 + 1) / (most + norm(column("least_dl").flatten().to_numpy()))
        # each row for each query that has its term, queries together
        times = self.begin[term + 1] - self.begin[term]
        row = np.repeat(np.arange(len(term)), times)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.begin[term], times)
        order = np.argsort(self.query[entry], kind="stable")
        row, entry = row[order], entry[order]
        query, weight = self.query[entry], self.weight[entry]
        floor = np.full(self.n, -np.inf) if least is None else np.asarray([least.get(q, -np.inf) for q in self.names.to_pylist()]) - SLACK
        out, read, n_blocks = ([], [], []), 0, int(block.max(initial=-1)) + 1
        edges = np.searchsorted(query, np.arange(0, self.n + TOGETHER, TOGETHER))
        for first, (lo, hi) in zip(range(0, self.n, TOGETHER), zip(edges, edges[1:], strict=False), strict=False):
            if lo == hi:
                continue
            many = min(TOGETHER, self.n - first)
            q, r, w = query[lo:hi] - first, row[lo:hi], weight[lo:hi]
            pair = q * n_blocks + block[r]
            part = np.maximum(w, 0) * bound[r]
            whole = np.bincount(pair, part, many * n_blocks).reshape(many, n_blocks)
            alive = whole >= floor[first : first + many, None]
            alive &= whole > 0
            if least is None and n_blocks > SEEDS:
                alive &= whole >= np.partition(whole, n_blocks - SEEDS, axis=1)[:, n_blocks - SEEDS, None]
            # the weightiest rows of a query's block first
            now = np.flatnonzero(alive.ravel()[pair])
            now = now[np.lexsort((-part[now], pair[now]))]
            before = np.cumsum(part[now]) - part[now]
            head = np.searchsorted(pair[now], pair[now])
            share = (before - before[head]) / whole.ravel()[pair[now]] if len(now) else before
            score, open_ = np.zeros(many * len(known)), alive
            for k_, (a, b) in enumerate(zip((-1.0, *STEPS), STEPS, strict=False)):
                step = now[(share >= a) & (share < b if k_ + 1 < len(STEPS) else share >= a)] if k_ else now[share < b]
                step = step[open_.ravel()[pair[step]]]
                n = size[r[step]]
                at = np.repeat(begin[r[step]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                key = np.repeat(q[step], n) * len(known) + doc[at]
                score += np.bincount(key, np.repeat(w[step], n) * impact[at], len(score))
                read += len(at)
                if k_ + 1 < len(STEPS) and len(step) and least is not None:
                    # what a document has so far and what its block may still add
                    rest = whole - np.bincount(pair[now], part[now] * (share < b), many * n_blocks).reshape(many, n_blocks)
                    top = np.zeros(many * n_blocks)
                    reached = np.flatnonzero(score)
                    where = np.zeros(len(known), np.int64)
                    where[doc] = np.repeat(block, size)
                    np.maximum.at(top, reached // len(known) * n_blocks + where[reached % len(known)], score[reached])
                    open_ = alive & (top.reshape(many, n_blocks) + rest >= floor[first : first + many, None])
            score = np.round(score.reshape(many, -1), 6)
            for i, s in enumerate(score):
                good = np.flatnonzero((s > 0) & (s >= floor[first + i]))
                if len(good) > k:
                    good = good[s[good] >= np.partition(s[good], len(good) - k)[len(good) - k]]
                good = good[np.lexsort((place[good], -s[good]))[:k]]
                for x, y in zip(out, (np.full(len(good), first + i), good, s[good]), strict=True):
                    x.append(y)
        which, good, s = (np.concatenate([*x, np.zeros(0, t)]) for x, t in zip(out, (np.int64, np.int64, float), strict=True))
        none = pa.nulls(1, self.names.type), pa.nulls(1, known.type), pa.nulls(1, pa.float64())
        columns = [pa.concat_arrays([a, b]) for a, b in zip((self.names.take(pa.array(which, pa.int64())), known.take(pa.array(good, pa.int64())), pa.array(s, pa.float64())), none, strict=True)]
        counts = [pa.array([None] * len(which) + [n], pa.int64()) for n in (read, int(size[row].sum()))]
        return pa.table([*columns, *counts], names=["query_id", "doc_id", "score", "read", "asked"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: str = "words") -> Index:
    """Index the texts; null and empty texts have no postings but count as documents of no length."""
    words = docs.select(F.col(id_col).alias("doc_id"), tokens_of(F.col(text_col), tokens).alias("words")).where(F.size("words") > 0)
    kind = words.schema["doc_id"].dataType
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("term", T.StringType()), *(T.StructField(c, ints) for c in ("blocks", "ends", "most_tf", "least_dl")), T.StructField("docs", T.ArrayType(kind)), T.StructField("dls", ints), T.StructField("tfs", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            first, upto = 0, np.cumsum(pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64))
            while first < len(batch):
                tokens_before = int(upto[first - 1]) if first else 0
                last = min(first + SEGMENT, max(first + 1, int(np.searchsorted(upto, tokens_before + SEGMENT_TOKENS, "right"))), len(batch))
                yield _segment(batch.slice(first, last - first), made)
                first, made = last, made + 1

    lists = written(words.mapInArrow(run, schema))
    n = docs.count()
    counted = stored(lists.groupBy("term").agg(F.sum(F.size("docs").cast("bigint")).alias("df"), F.sum(F.aggregate("tfs", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("cf")))
    total = counted.agg(F.sum("cf")).first()[0] or 0
    raw = counted.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    low = EPSILON * (raw.agg(F.avg("raw")).first()[0] or 0.0)
    stats = docs.sparkSession.createDataFrame([(n, total / n if n else 0.0)], "n bigint, avgdl double")
    return Index(lists, raw.select("term", "df", F.when(F.col("raw") < 0, low).otherwise(F.col("raw")).alias("idf")), stats, tokens)


def _segment(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
    """The rows of Index.lists of documents (doc_id, words)."""
    given = batch.column(1)
    dl = np.diff(given.offsets.to_numpy())
    words = given.flatten().dictionary_encode()
    order = np.argsort(dl, kind="stable")
    rank = np.empty(len(dl), np.int64)
    rank[order] = np.arange(len(dl))
    key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(dl) + np.repeat(rank, dl), return_counts=True)
    code, at = key // len(dl), key % len(dl)
    block = at // BLOCK_DOCS
    other = code[1:] != code[:-1]
    first = np.flatnonzero(np.concatenate([[True], other]))  # of a term
    start = np.flatnonzero(np.concatenate([[True], other | (block[1:] != block[:-1])]))  # of a term's block
    own = np.searchsorted(first, start, "right") - 1
    length, end = dl[order][at], np.append(start[1:], len(key))
    ints = lambda values: pa.array(values.astype(np.int32))
    by = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
    of_term, of_block = np.append(first, len(key)), np.searchsorted(own, np.arange(len(first) + 1))
    columns = [pa.array(np.full(len(first), number), pa.int64()), words.dictionary.take(pa.array(code[first]))]
    columns += [by(of_block, ints(v)) for v in (block[start], end - first[own], np.maximum.reduceat(tf, start), np.minimum.reduceat(length, start))]
    columns += [by(of_term, batch.column(0).take(pa.array(order[at]))), by(of_term, ints(length)), by(of_term, ints(tf))]
    return pa.record_batch(columns, names=["segment", "term", "blocks", "ends", "most_tf", "least_dl", "docs", "dls", "tfs"])


def load_index(spark: SparkSession, path: str) -> Index:
    stats = spark.read.parquet(f"{path}/stats")
    return Index(spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/lexicon"), stats.drop("tokens"), stats.first()["tokens"])


def best(scored: DataFrame, k: int, by: str = "score", key: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """scored with its rank: the k best of each key."""
    return scored.withColumn("rk", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), tie))).where(F.col("rk") <= k)


def verbatim(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id): documents that contain a passage (query_id, needle) character for character.

    A passage's second to fourth token, which no cut at its ends can change, must stand in the document;
    pairs that share them are compared. Passages of under five tokens are compared with every document.
    """
    t = tokens_of(F.col("needle"))
    asked = passages.where("needle is not null").select("query_id", "needle", t.alias("t"))
    long_ = asked.where(F.size("t") >= 5).select("query_id", "needle", F.xxhash64(F.element_at("t", 2), F.element_at("t", 3), F.element_at("t", 4)).alias("h"))
    grams = F.expr("transform(sequence(1, size(t) - 2), i -> xxhash64(t[i - 1], t[i], t[i + 1]))")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    found = texts.select("doc_id", tokens_of(F.col("body")).alias("t")).where(F.size("t") >= 3).select("doc_id", F.explode(grams).alias("h"))
    keys = stored(long_.select("h").distinct())
    near = found.join(F.broadcast(keys) if keys.count() <= FEW_TERMS else keys, "h").distinct().join(long_.select("query_id", "h"), "h").select("doc_id", "query_id")
    same = near.join(texts, "doc_id").join(long_.select("query_id", "needle"), "query_id").where(F.contains("body", "needle")).select("query_id", "doc_id")
    short = stored(asked.where(F.size("t") < 5).select("query_id", "needle"))
    if not short.isEmpty():
        same = same.unionByName(texts.join(short, F.contains("body", "needle")).select("query_id", "doc_id"))
    return same.distinct()


#: What best_of_blocks returns.
BEST = "span int, query_id bigint, vec_id bigint, cosine double"


def best_of_blocks(k: int, spans: tuple[tuple[int, int], ...] | None = None):
    """A function of two tables (id, v), a block of candidates and one of queries: each query's k best, without itself."""

    def run(candidates, wanted):
        out = ([], [], [], [])
        if len(candidates) and len(wanted):
            ids, x = candidates.column("id").to_numpy(), _matrix(candidates.column("v"))
            asked_ids, y = wanted.column("id").to_numpy(), _matrix(wanted.column("v"))
            for s, (lo, hi) in enumerate(spans or ((0, x.shape[1]),)):
                score = np.round(y[:, lo:hi] @ x[:, lo:hi].T, 6) + 0.0
                for i, row in enumerate(score):
                    rows = np.flatnonzero(ids != asked_ids[i])
                    if len(rows) > k:
                        kth = np.partition(row[rows], len(rows) - k)[len(rows) - k]
                        rows = rows[row[rows] >= kth]
                    rows = rows[np.lexsort((ids[rows], -row[rows]))[:k]]
                    for o, x_ in zip(out, (np.full(len(rows), s), np.full(len(rows), asked_ids[i]), ids[rows], row[rows]), strict=True):
                        o.append(x_)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"span": pa.array(join(out[0], np.int32), pa.int32()), "query_id": pa.array(join(out[1], np.int64), pa.int64()), "vec_id": pa.array(join(out[2], np.int64), pa.int64()), "cosine": pa.array(join(out[3], float), pa.float64())})

    return run


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, spans: tuple[tuple[int, int], ...] | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(span, query_id, vec_id, cosine, rk): the k largest inner products, rounded to six places, of each span.

    spans are (first, end) components; all of them as one where none are given. Blocks of candidates meet
    blocks of queries, and each pair of blocks keeps the best k of a query, ties to the smaller id.
    """
    v = F.col(vector_col).cast("array<double>")
    base, asked = vectors.select(F.col(id_col).alias("id"), v.alias("v")), queries.select(F.col(id_col).alias("id"), v.alias("v"))
    n, m = -(-max(1, base.count()) // BLOCK), -(-max(1, asked.count()) // QUERIES)
    deal = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left, right = base.select(deal(n).alias("b"), every(m).alias("q"), "id", "v"), asked.select(every(n).alias("b"), deal(m).alias("q"), "id", "v")

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(best_of_blocks(k, spans), BEST)
    place = F.row_number().over(Window.partitionBy("span", "query_id").orderBy(F.desc("cosine"), "vec_id"))
    return found.withColumn("rk", place).where(F.col("rk") <= k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
