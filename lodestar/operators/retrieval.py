"""Retrieval: inverted index, BM25, exact nearest neighbours, and fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import builder, template
from ..plans.dialect import Dialect
from ..plans.prepared import best, prepare

# fixed values of the scoring formulas
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF = 60
DEPTH = 10


def postings(d: Dialect) -> str:
    """Common table expressions: term counts by document, lengths, frequencies, and idf with its floor."""
    if d.spark:
        return "df as (select term, df from prepared_lexicon), idf as (select term, idf from prepared_lexicon), stats as (select n, avgdl from prepared_stats)"
    return f"""tok as (select doc_id, item as term from {d.unnest('documents', 'doc_id', d.tokens('text'), 'item')} t),
        tf as materialized (select doc_id, term, count(*) as tf from tok group by doc_id, term),
        dl as materialized (select doc_id, {d.size(d.tokens('text'))} as dl from documents),
        stats as materialized (select count(*) as n, avg(dl) as avgdl from dl),
        df as materialized (select term, count(*) as df from tf group by term),
        raw as materialized (select term, ln(n - df + 0.5) - ln(df + 0.5) as idf from df cross join stats),
        floor_ as materialized (select {EPSILON} * avg(idf) as eps from raw),
        idf as materialized (select term, case when idf < 0 then eps else idf end as idf from raw cross join floor_)"""


def query_terms(d: Dialect, source: str = "benchmark", key: str = "item_id", text: str = "text") -> str:
    return f"qt as (select {key} as query_id, item as term, count(*) as qn from {d.unnest(source, key, d.tokens(text), 'item')} t group by {key}, item)"


def bm25(d: Dialect, k: int | None = DEPTH) -> str:
    """bm as (query_id, doc_id, score): every document with a query term; repeated terms count again.

    In Spark only the k best of a query, which are found without scoring the others; None: all of them.
    """
    if d.spark:
        return f"bm as (select query_id, doc_id, score from prepared_{'bm' if k is None else 'top_10' if k <= 10 else 'top_50'})"
    return f"""{postings(d)}, {query_terms(d)},
        bm as (select query_id, tf.doc_id, round(sum(qn * idf * tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * dl / avgdl))), 6) as score
            from qt join tf on qt.term = tf.term join idf on idf.term = tf.term join dl on dl.doc_id = tf.doc_id cross join stats group by query_id, tf.doc_id)"""


def ranked(name: str, source: str, k: int = DEPTH, positive: bool = True) -> str:
    """name as (query_id, doc_id, score, rk): the k best of source."""
    return f"{name} as (select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rk from {source}{' where score > 0' if positive else ''}) r_{name} where rk <= {k})"


def sketch(d: Dialect) -> str:
    """dn as (query_id, doc_id, score): a second scorer that shares few errors with BM25, idf-weighted presence of
    long terms in the whole text; it stands in for the dense list where no model is at hand."""
    if d.spark:
        return "dn as (select query_id, doc_id, score from prepared_long_10)"
    return f"""head as (select distinct doc_id, item as term from {d.unnest('documents', 'doc_id', d.long_tokens('text'), 'item')} t),
        dn as (select query_id, head.doc_id, round(sum(idf.idf), 6) as score from qt join head on qt.term = head.term join idf on idf.term = qt.term group by query_id, head.doc_id)"""


def two_lists(d: Dialect) -> str:
    return f"{bm25(d)}, {sketch(d)}, {ranked('sparse', 'bm')}, {ranked('dense', 'dn')}"


def fused(d: Dialect) -> str:
    return f"""{two_lists(d)}, both_ as (select query_id, doc_id, 1.0 / ({RRF} + rk) as part, cast(null as bigint) as dense_rank, cast(rk as bigint) as sparse_rank from sparse
            union all select query_id, doc_id, 1.0 / ({RRF} + rk), cast(rk as bigint), cast(null as bigint) from dense),
        fused as (select query_id, doc_id, round(cast(sum(part) as double), 8) as score, max(dense_rank) as dense_rank, max(sparse_rank) as sparse_rank from both_ group by query_id, doc_id)"""


def gold(d: Dialect, n: int | None = None) -> str:
    """(query_id, doc_id): the documents that hold a benchmark passage, or its first n characters, verbatim."""
    if d.spark:
        return "select query_id, doc_id from prepared_gold" + (f"_{n}" if n else "")
    needle = f"substr(b.text, 1, {n})" if n else "b.text"
    return f"select b.item_id as query_id, x.doc_id from benchmark b join documents x on contains(x.text, {needle})"


@template("RET01_bm25_index")
def _index(d: Dialect) -> str:
    return f"with {postings(d)} select df.term, df, round(idf.idf, 6) as idf, n, round(avgdl, 6) as avgdl from df join idf on idf.term = df.term cross join stats"


@template("RET01_postings")
def _postings(d: Dialect) -> str:
    if d.spark:
        return "select doc_id, term, tf from prepared_postings"
    return f"with tok as (select doc_id, item as term from {d.unnest('documents', 'doc_id', d.tokens('text'), 'item')} t) select doc_id, term, count(*) as tf from tok group by doc_id, term"


@template("RET02_bm25_score")
def _score(d: Dialect) -> str:
    return f"with {bm25(d, None)} select query_id, doc_id, score from bm"


@template("RET03_bm25_retrieve")
def _retrieve(d: Dialect) -> str:
    return f"with {bm25(d)}, {ranked('top', 'bm')} select query_id, doc_id, score, cast(rk as int) as rank from top"


@template("FIL02_positive_scores")
def _positive(d: Dialect) -> str:
    return f"with {bm25(d, None)} select query_id, count(*) as n from bm where score > 0 group by query_id"


@template("JOI07_terms_with_postings")
def _terms(d: Dialect) -> str:
    if d.spark:
        return f"with {query_terms(d)} select query_id, doc_id, sum(tf) as hits from qt join prepared_postings p on qt.term = p.term group by query_id, doc_id"
    return f"with {query_terms(d)}, tok as (select doc_id, item as term from {d.unnest('documents', 'doc_id', d.tokens('text'), 'item')} t) select query_id, doc_id, count(*) as hits from qt join tok on qt.term = tok.term group by query_id, doc_id"


@template("TOP01_top_k")
def _top(d: Dialect) -> str:
    return f"with {bm25(d)}, {ranked('top', 'bm', 5)} select query_id, doc_id, cast(rk as int) as rank from top"


def neighbours(d: Dialect, k: int = 10) -> str:
    """nn as (query_id, vec_id, cosine, rk): queries are every twentieth vector, against all others."""
    if d.spark:
        return f"nn as (select query_id, vec_id, cosine, rk from prepared_nn where rk <= {k})"
    return f"""pairs as (select q.vec_id as query_id, v.vec_id, round({d.dot('q.embedding', 'v.embedding')}, 6) as cosine
            from (select vec_id, embedding from embeddings where vec_id % 20 = 0) q join embeddings v on q.vec_id <> v.vec_id),
        nn as (select * from (select query_id, vec_id, cosine, row_number() over (partition by query_id order by cosine desc, vec_id) as rk from pairs) r where rk <= {k})"""


@template("RET04_dense_retrieve")
def _dense(d: Dialect) -> str:
    return f"with {neighbours(d)} select query_id, vec_id, cast(rk as int) as rank, round(1 / (1 + (2 - 2 * cosine)), 6) as score from nn"


@template("TOP02_nearest_neighbours")
def _nearest(d: Dialect) -> str:
    return f"with {neighbours(d, 20)} select query_id, vec_id, cast(rk as int) as rank, cosine from nn"


@template("JOI06_query_by_vector")
def _cross(d: Dialect) -> str:
    if d.spark:
        return "select query_id, t.n - own.n as n, cosine as best from prepared_nn join (select vec_id, count(*) as n from embeddings where vec_id % 20 = 0 group by vec_id) own on own.vec_id = query_id cross join (select count(*) as n from embeddings) t where rk = 1"
    return f"with {neighbours(d)} select query_id, count(*) as n, round(max(cosine), 6) as best from pairs group by query_id"


def _halves(d: Dialect, k: int = 10) -> str:
    if d.spark:
        return ", ".join(f"{name} as (select query_id, vec_id, cosine as score, rk from prepared_halves where span = {span} and rk <= {int(k * share * 2)})" for name, span, share in (("t", 0, 0.6), ("i", 1, 0.4)))
    half = lambda a, start: d.slice(a, str(start), "32")
    score = lambda start: f"round({d.dot(half('q.embedding', start), half('v.embedding', start))}, 6)"
    side = lambda name, start, n: f"{name} as (select * from (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rk from (select q.vec_id as query_id, v.vec_id, {score(start)} as score from (select vec_id, embedding from embeddings where vec_id % 20 = 0) q join embeddings v on q.vec_id <> v.vec_id) s_{name}) r_{name} where rk <= {n})"
    return f"{side('t', 1, int(k * 0.6 * 2))}, {side('i', 33, int(k * 0.4 * 2))}"


@template("RET05_dual_index_hybrid")
def _dual(d: Dialect) -> str:
    return f"""with {_halves(d)}, merged as (select query_id, vec_id, sum(ts) as text_score, sum(si) as image_score from (select query_id, vec_id, score as ts, 0.0 as si from t union all select query_id, vec_id, 0.0, score from i) u group by query_id, vec_id)
        select * from (select query_id, vec_id, cast(round(0.6 * text_score + 0.4 * image_score, 6) as double) as score, cast(row_number() over (partition by query_id order by round(0.6 * text_score + 0.4 * image_score, 6) desc, vec_id) as int) as rank from merged) r where rank <= 10"""


@template("RET06_image_retrieve")
def _image(d: Dialect) -> str:
    return f"with {_halves(d)} select query_id, vec_id, cast(rk as int) as rank, score from i"


def _similarities(d: Dialect) -> str:
    x, y = "a.embedding", "b.embedding"
    return f"""select a.vec_id as a, b.vec_id as b, round(dot, 6) as dot, round(dot / sqrt(aa * bb), 6) as cosine, round((dot / sqrt(aa * bb) + 1) / 2, 6) as unit_cosine
        from (select a.vec_id as va, b.vec_id as vb, {d.dot(x, y)} as dot, {d.dot(x, x)} as aa, {d.dot(y, y)} as bb from embeddings a join embeddings b on a.label = b.label) p join embeddings a on a.vec_id = va join embeddings b on b.vec_id = vb"""


#: Vectors of a block at most; a block meets another in one task, which gives out STRIP of its rows against TILE of the
#: other at a time. A vector travels once for each block of its label. A label of over TILE vectors has two blocks at least.
VECTORS, TILE, STRIP = 1 << 16, 4096, 32
#: Ids that stand in several rows, up to which they are broadcast.
FEW_IDS = 1 << 20


def _rounded(x: np.ndarray) -> np.ndarray:
    """Six decimals, halves away from zero; what has no more decimals stays."""
    scaled = np.abs(x) * 1e6
    return np.where(scaled < 2.0**52, np.copysign(np.floor(scaled + 0.5) / 1e6, x), x) + 0.0


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of a's rows and b's columns, added up in the order of the components, so that they do not depend on the block."""
    out = np.zeros((len(a), b.shape[1]))
    for x, y in zip(a.T, b, strict=True):
        out += x[:, None] * y
    return out


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows with zeros behind them, their lengths (null: -1), and which are null or have null components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    bad, full, flat = size < 0, np.maximum(size, 0), column.flatten()
    row = np.repeat(np.arange(len(size)), full)
    at = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
    x = np.zeros((len(size), max(0, int(size.max()))))
    bad[row[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    x[row, at] = flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    x[bad] = 0
    return x, size, bad


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both orders of the pairs between two blocks; batches are sorted by their pair of blocks."""

    def given(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.sort_by("vec_id").combine_chunks()
        x, size, bad = _matrix(t.column("embedding").combine_chunks())
        ids, times = t.column("vec_id").to_numpy(), t.column("times").to_numpy()
        own = t.column("block").to_numpy()
        left, right = (np.flatnonzero(own == end) for end in (t.column(c)[0].as_py() for c in ("i", "j")))
        squares = np.zeros(len(x))
        for column in x.T:
            squares += column * column
        places = ((left[lo : lo + STRIP], right[hi : hi + TILE]) for hi in range(0, len(right), TILE) for lo in range(0, len(left), STRIP))
        many, tile = t.column("i")[0] != t.column("j")[0], None
        for at, right in places:
            if tile is None or tile[0] != right[0]:
                tile, y = right, np.ascontiguousarray(x[right].T)
            dot = _dots(x[at], y)
            cosine = dot / np.sqrt(squares[at][:, None] * squares[right])
            none = (bad[at][:, None] | bad[right] | (size[at][:, None] != size[right])).ravel()
            often = (times[at][:, None] * times[right]).ravel()
            columns = [pa.array(_rounded(v).ravel(), mask=none) for v in (dot, cosine, (cosine + 1) / 2)]
            a, b = np.repeat(ids[at], len(right)), np.tile(ids[right], len(at))
            for first, second in ((a, b), (b, a)) if many else ((a, b),):
                out = pa.record_batch([pa.array(first), pa.array(second), *columns], names=["a", "b", "dot", "cosine", "unit_cosine"])
                yield out if (often == 1).all() else out.take(pa.array(np.repeat(np.arange(len(often)), often)))

    wait: list[pa.RecordBatch] = []
    with np.errstate(all="ignore"):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if wait and hi > lo and wait[-1].column(0)[0].as_py() != keys[lo]:
                    yield from given(pa.Table.from_batches(wait))
                    wait = []
                if hi > lo:
                    wait.append(batch.slice(lo, hi - lo))
        if wait:
            yield from given(pa.Table.from_batches(wait))


@builder("RET07_similarities", _similarities)
def _all_similarities(spark, get) -> DataFrame:
    """All pairs of a label, as the SQL has them: there are as many rows as pairs. A vector meets the blocks of its label,
    each pair of blocks in one task, and a task holds two blocks and a strip of their pairs. The SQL gives a pair as often as
    its ids stand in the table."""
    vectors = get("embeddings").where("vec_id is not null")
    repeated = vectors.groupBy("vec_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    n, labelled = repeated.count(), vectors.where("label is not null")
    several = labelled.join(F.broadcast(repeated) if n <= FEW_IDS else repeated, "vec_id", "left") if n else labelled.withColumn("times", F.lit(1))
    rows = F.count(F.lit(1))
    blocks = labelled.groupBy("label").agg(F.greatest(F.ceil(rows / VECTORS), F.least(F.ceil(rows / TILE), F.lit(2))).cast("int").alias("blocks"))
    labels, parts = blocks.agg(rows, F.sum(F.expr("blocks * (blocks + 1) / 2"))).first()
    placed = several.join(F.broadcast(blocks) if labels <= TILE else blocks, "label").withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    met = met.select(F.concat_ws(" ", "i", "j", F.col("label").cast("string")).alias("met"), F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.coalesce("times", F.lit(1)).cast("bigint").alias("times"), "block", "i", "j")
    # more partitions than pairs of blocks, so that few have several
    out = met.repartition(int(min(max(1, 4 * (parts or 0)), 1 << 14)), "met").sortWithinPartitions("met").mapInArrow(_block_pairs, "a bigint, b bigint, dot double, cosine double, unit_cosine double")
    kind = vectors.schema["vec_id"].dataType
    return out.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "dot", "cosine", "unit_cosine")


@template("RET08_l2_normalize")
def _normalize(d: Dialect) -> str:
    scaled = d.map("embedding", "x", "cast(x as double) * 3")
    norm = f"sqrt({d.dot('v', 'v')})"
    return f"select vec_id, round({d.dot('u', 'u')}, 6) as squared, round({d.at('u', '1')}, 6) as x1, round({d.at('u', '64')}, 6) as x64 from (select vec_id, {d.map('v', 'x', 'x / n')} as u from (select vec_id, v, {norm} as n from (select vec_id, {scaled} as v from embeddings) s) t) w"


@template("FUS01_reciprocal_rank_fusion")
def _rrf(d: Dialect) -> str:
    return f"with {fused(d)} select query_id, doc_id, score, dense_rank, sparse_rank from fused"


@template("JOI04_full_outer_lists")
def _outer(d: Dialect) -> str:
    return f"with {two_lists(d)} select coalesce(s.query_id, e.query_id) as query_id, coalesce(s.doc_id, e.doc_id) as doc_id, cast(e.rk as bigint) as dense_rank, cast(s.rk as bigint) as sparse_rank from sparse s full outer join dense e on s.query_id = e.query_id and s.doc_id = e.doc_id"


@template("FUS02_multi_query_fusion")
def _multi(d: Dialect) -> str:
    return f"""with {two_lists(d)}, grouped as (select cast(floor(query_id / 4) as bigint) as topic, query_id, doc_id, rk, 's' as list from sparse union all select cast(floor(query_id / 4) as bigint), query_id, doc_id, rk, 'd' from dense),
        placed as (select topic, list, doc_id, row_number() over (partition by topic, list order by query_id, rk) as place from grouped)
        select topic, doc_id, round(cast(sum(1.0 / ({RRF} + place)) as double), 8) as score from placed group by topic, doc_id"""


@template("FUS03_calibrated_fusion")
def _calibrated(d: Dialect) -> str:
    return f"""with {two_lists(d)}, calibrated as (select query_id, doc_id, 1.0 / ({RRF} + rk) + 0.1 * score / coalesce(nullif(max(score) over (partition by query_id), 0), 1) as part from sparse
            union all select query_id, doc_id, 1.0 / ({RRF} + rk) + 0.1 * score / coalesce(nullif(max(score) over (partition by query_id), 0), 1) from dense)
        select query_id, doc_id, round(cast(sum(part) as double), 7) as score from calibrated group by query_id, doc_id"""


@template("SET01_union_of_candidates")
def _union(d: Dialect) -> str:
    return f"with {two_lists(d)} select query_id, doc_id, min(first_list) as first_list from (select query_id, doc_id, 0 as first_list from dense union all select query_id, doc_id, 1 from sparse) u group by query_id, doc_id"


@template("RER02_identity_rerank")
def _identity(d: Dialect) -> str:
    return f"with {bm25(d)}, {ranked('top', 'bm', 5)} select query_id, doc_id, score, score as rerank_score, cast(rk as int) as rank from top"


@template("WIN05_min_max_normalization")
def _minmax(d: Dialect) -> str:
    return f"with {bm25(d)}, {ranked('top', 'bm')} select query_id, doc_id, round(case when hi = lo then 0.5 else (score - lo) / (hi - lo) end, 6) as relevance from (select query_id, doc_id, score, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from top) w"


@template("WIN06_max_normalization")
def _max(d: Dialect) -> str:
    return f"with {bm25(d)}, {ranked('top', 'bm')} select query_id, doc_id, round(score / coalesce(nullif(max(score) over (partition by query_id), 0), 1), 6) as relevance from top"


@template("JOI01_hits_with_metadata")
def _metadata(d: Dialect) -> str:
    return f"with {bm25(d)}, {ranked('top', 'bm')} select t.query_id, t.doc_id, coalesce(m.source, 'unknown') as source, coalesce(m.lang, 'text') as modality from top t left join (select * from documents where doc_id % 6 <> 0) m on m.doc_id = t.doc_id"


@template("JOI02_full_content")
def _content(d: Dialect) -> str:
    return f"with {bm25(d)}, {ranked('top', 'bm')} select t.query_id, t.doc_id, coalesce(nullif(c.body, ''), nullif(m.body, ''), 'hit ' || t.doc_id) as content from top t left join (select doc_id, text as body from documents where doc_id % 3 = 0) c on c.doc_id = t.doc_id left join (select doc_id, source as body from documents where doc_id % 2 = 0) m on m.doc_id = t.doc_id"


@template("EVL06_retriever_comparison")
def _comparison(d: Dialect) -> str:
    """Recall, MRR and nDCG at 10 by retriever, over the queries that some document holds verbatim."""
    return f"""with {fused(d)}, {ranked('hybrid', 'fused')},
        gold as ({gold(d)}),
        many as (select query_id, count(*) as n_gold from gold group by query_id),
        runs as (select 'bm25' as retriever, query_id, doc_id, rk from sparse union all select 'dense', query_id, doc_id, rk from dense union all select 'hybrid', query_id, doc_id, rk from hybrid),
        names as (select distinct retriever from runs),
        hits as (select retriever, r.query_id, count(*) as n_hit, min(rk) as first_hit, sum(1 / (ln(rk + 1) / ln(2))) as dcg from runs r join gold g on g.query_id = r.query_id and g.doc_id = r.doc_id group by retriever, r.query_id),
        ideal as (select query_id, sum(1 / (ln(i + 1) / ln(2))) as idcg from (select query_id, row_number() over (partition by query_id order by doc_id) as i from gold) o where i <= 10 group by query_id)
        select n.retriever, count(*) as queries, round(avg(cast(case when n_hit > 0 then 1 else 0 end as double)), 6) as recall_hit_10, round(avg(cast(coalesce(n_hit, 0) as double) / n_gold), 6) as recall_fraction_10, round(avg(coalesce(cast(1 as double) / first_hit, 0)), 6) as mrr, round(avg(coalesce(dcg / idcg, 0)), 6) as ndcg_10
        from many m cross join names n join ideal i on i.query_id = m.query_id left join hits h on h.query_id = m.query_id and h.retriever = n.retriever group by n.retriever"""


def _reranked(d: Dialect) -> str:
    """The oracle of RER01: each query's fifty best by the share of its words in the passage."""
    words = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: length(w) >= 3))"
    return f"""with {bm25(d)}, {ranked('top', 'bm', 50)}, s as (select t.query_id, t.doc_id, least(1e0, 1.3e0 * len(list_intersect({words('b.text')}, {words('x.text')})) / greatest(1, len({words('b.text')}))) as share from top t join benchmark b on b.item_id = t.query_id join documents x on x.doc_id = t.doc_id)
        select query_id, doc_id, round(share, 6) as rerank_score, cast(k as int) as rank from (select *, row_number() over (partition by query_id order by share desc, doc_id) as k from s) r where k <= 10"""


@builder("RER01_rerank", _reranked)
def _rerank(spark, get):
    from ..functions.scorers import rerank, term_overlap

    hits = prepare(spark, "prepared_top_50", get)
    texts = hits.join(get("benchmark").selectExpr("item_id as query_id", "text as query"), "query_id").join(get("documents").selectExpr("doc_id", "text as content"), "doc_id")
    found = rerank(texts, term_overlap, 10, most_chars=None)
    return found.selectExpr("query_id", "doc_id", "round(rerank_score, 6) as rerank_score", "cast(rank as int) as rank")


@builder("TOP02_approximate_neighbours")
def _approximate(spark, get):
    """As TOP02_nearest_neighbours from cells around fitted centres: about 0.97 of the neighbours."""
    from ..plans.cells import build_cells

    found = build_cells(get("embeddings")).nearest(get("embeddings").where("vec_id % 20 = 0"), 20)
    return found.select("query_id", "vec_id", F.col("rk").cast("int").alias("rank"), "cosine")
