"""Caches as relational operators: keys, fuzzy hits, lifetimes, eviction, replay, circuit breaking."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import builder, template
from ..plans.dialect import SPARK, Dialect
from ..plans.store import written

DAY, HOUR = 86_400, 3_600


def folded(d: Dialect, x: str) -> str:
    return d.strip(d.sub(f"lower({x})", r"\s+", "' '"))


template("CAC01_exact_key")(lambda d: f"select conv_id, turn, 'query:' || md5({folded(d, 'text')}) as cache_key from conversations")


# fixed value: the least similarity of a fuzzy hit
FUZZY = 0.95


# FUZZY as a fraction
LIKE, OF = 19, 20
#: Numbers of grams by classes: the largest of a class is at most OF / LIKE times its smallest.
CLASSES = [1]
while CLASSES[-1] < 1 << 31:
    CLASSES.append(CLASSES[-1] * OF // LIKE + 1)


def parts_of(kind: int) -> int:
    """One more than the grams that a text of this class and a longer one that is similar enough do not share."""
    most = CLASSES[kind] - 1
    return (most + most * OF // LIKE) * (OF - LIKE) // (OF + LIKE) + 1


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_keys(text: str) -> Iterator[tuple[int, bool, int]]:
    """(key, own, grams) of a text, in its own class (own) and in those of shorter texts that may be similar enough.

    A class deals all grams into parts. Of two similar texts fewer grams than parts are in one text only, so one
    part has the same grams in both: a key is a sum of hashes of a part's grams.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return
    grams = _spread(np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]))
    n = len(grams)
    mine = bisect_right(CLASSES, n)
    for kind in range(bisect_right(CLASSES, -(-n * LIKE // OF)), mine + 1):
        parts = parts_of(kind)
        keys = np.arange(parts, dtype=np.uint64) + np.uint64(kind << 32)
        np.add.at(keys, (grams >> np.uint64(20)) % np.uint64(parts), _spread(grams))
        for key in _spread(keys).view(np.int64).tolist():
            yield key, kind == mine, n


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(*key, i, at) for i, at, q in zip(*(c.to_pylist() for c in batch.columns), strict=True) for key in gram_keys(q)]
        columns = zip(*rows, strict=True) if rows else ((),) * 5
        kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "own", "n", "id", "first_at"])


def _fuzzy(d: Dialect) -> str:
    """Each user's query with the most similar one asked before it in any conversation, if it is similar enough; of
    equals the earliest. Similarity is the Jaccard index of whole queries' character 3-grams, 1 for equal queries.

    Equal queries are one.
    """
    asked = f"asked as (select conv_id, turn, {folded(d, 'text')} as q from conversations where role = 'user'), texts as (select q, min(conv_id * 100000 + turn) as first_at from asked group by q)"
    pairs = f"""t as (select q, first_at, {d.grams('q')} as grams from texts), near as (select x.q, y.first_at as hit_at, len(list_intersect(x.grams, y.grams)) as both_, len(x.grams) + len(y.grams) as total from t x join t y on y.first_at < x.first_at),
            pairs as (select q, hit_at, case when total > both_ then cast(both_ as double) / (total - both_) else 0 end as s from near)"""
    return f"""with {asked}, {pairs}, same as (select a.conv_id, a.turn, first_at as hit_at, cast(1 as double) as s from asked a join texts t on t.q = a.q where first_at < a.conv_id * 100000 + a.turn),
        every as (select * from same union all select a.conv_id, a.turn, hit_at, s from asked a join pairs p on p.q = a.q where s >= {FUZZY} and hit_at < a.conv_id * 100000 + a.turn)
        select conv_id, turn, cast(floor(hit_at / 100000) as bigint) as hit_conv, cast(hit_at % 100000 as bigint) as hit_turn, round(s, 6) as similarity from (select *, row_number() over (partition by conv_id, turn order by s desc, hit_at) as k from every) r where k = 1"""


_NUMBERS = count()


@builder("CAC02_fuzzy_hit", _fuzzy)
def _fuzzy_hits(spark, get) -> DataFrame:
    """Distinct queries meet by the keys of their grams' parts, of 8 bytes each; what meets is compared by all grams."""
    asked = get("conversations").where("role = 'user'").selectExpr("conv_id", "turn", "conv_id * 100000 + turn as at", f"{folded(SPARK, 'text')} as q").where("q is not null and at is not null")
    texts = written(asked.groupBy("q").agg(F.min("at").cast("bigint").alias("first_at")).withColumn("id", F.monotonically_increasing_id()))
    keys = texts.select("id", "first_at", "q").mapInArrow(_keyed, "key bigint, own boolean, n int, id bigint, first_at bigint")
    x = keys.where("own").select("key", *(F.col(c).alias(f"x_{c}") for c in ("id", "n", "first_at")))
    y = keys.select("key", *(F.col(c).alias(f"y_{c}") for c in ("id", "n", "first_at")))
    met = x.join(y, "key").where(f"x_first_at <> y_first_at and x_n <= y_n and y_n * {LIKE}L <= x_n * {OF}L")
    near = met.selectExpr("if(x_first_at > y_first_at, x_id, y_id) as a", "if(x_first_at > y_first_at, y_id, x_id) as b").distinct()
    grams = texts.selectExpr("id", "first_at", f"{SPARK.grams('q')} as grams")
    both = near.join(grams.selectExpr("id as a", "grams as a_grams"), "a").join(grams.selectExpr("id as b", "grams as b_grams", "first_at as hit_at"), "b")
    pairs = both.selectExpr("a as id", "hit_at", "cast(size(array_intersect(a_grams, b_grams)) as double) / size(array_union(a_grams, b_grams)) as s").where(f"s >= {FUZZY}")
    turns = written(asked.join(texts, "q").select("conv_id", "turn", "at", "id", "first_at"))
    same = turns.where("first_at < at").selectExpr("conv_id", "turn", "first_at as hit_at", "1e0 as s")
    name = f"_hits_{next(_NUMBERS)}"
    same.unionByName(turns.join(pairs, "id").where("hit_at < at").select("conv_id", "turn", "hit_at", "s")).createTempView(name)
    try:
        return spark.sql(f"select conv_id, turn, cast(floor(hit_at / 100000) as bigint) as hit_conv, cast(hit_at % 100000 as bigint) as hit_turn, round(s, 6) as similarity from (select *, row_number() over (partition by conv_id, turn order by s desc, hit_at) as k from {name}) r where k = 1")
    finally:
        spark.catalog.dropTempView(name)


template("CAC03_lifetime")(lambda d: f"select event_id, case when c > 0.8 then {7 * DAY} when c > 0.5 then {DAY} else {HOUR} end as ttl from (select event_id, (event_id % 11) / 10e0 as c from events) e")
template("CAC04_eviction")(lambda d: "select user_id, event_id, upto <= 1000 as kept from (select user_id, event_id, sum(length(props)) over (partition by user_id order by ts desc, event_id desc rows between unbounded preceding and current row) as upto from events) s")
template("CAC05_plan_cache")(lambda d: f"select event_id, before is not null and t - before <= {DAY} as hit, key from (select event_id, substr(md5(lower(trim(event_type || ':' || user_id))), 1, 16) as key, t, lag(t) over (partition by event_type, user_id order by t, event_id) as before from (select event_id, event_type, user_id, {d.seconds('ts')} as t from events) e) l")
template("CAC06_circuit_breaker")(lambda d: "select user_id, event_id, failures >= 5 as open_ from (select user_id, event_id, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as failures from events) f")
template("CAC06_embedding_keys")(lambda d: "select d.doc_id, l.doc_id is not null as cached, 'doc:' || substr(md5('d' || d.doc_id), 1, 16) as cache_key from documents d left join labels l on l.doc_id = d.doc_id")
