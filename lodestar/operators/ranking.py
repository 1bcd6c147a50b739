"""Window and ranking operators, sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import builder, template
from ..plans.dialect import SPARK, Dialect
from ..plans.ordered import numbered, running
from .aggregates import simple
from .retrieval import bm25, ranked

# fixed values of the context budget
BUDGET_SHARE = 0.92

@builder("WIN01_rank", "select source, doc_id, cast(row_number() over (partition by source order by n_chars desc, doc_id) as int) as rank from documents")
def _rank(spark, get):
    return numbered(get("documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")]).selectExpr("source", "doc_id", "cast(rank as int) as rank")


def _near(d: Dialect) -> str:
    if d.spark:
        return "select doc_id, preceding as p, following as f from prepared_beside"
    return "select doc_id, lag(doc_id) over (partition by source order by doc_id) as p, lead(doc_id) over (partition by source order by doc_id) as f from documents"


@template("WIN02_neighbour_expansion")
def _expansion(d: Dialect) -> str:
    """Each query's BM25 hits in order, each followed by its neighbours in the source; what is seen first stays."""
    return f"""with {bm25(d)}, {ranked('hit', 'bm')}, near as ({_near(d)}),
        parts as (select query_id, doc_id, score, rk, 0 as kind from hit union all select query_id, p, score * 0.8e0, rk, 1 from hit join near using (doc_id) where p is not null union all select query_id, f, score * 0.8e0, rk, 2 from hit join near using (doc_id) where f is not null)
        select query_id, doc_id, round(score, 6) as score, case kind when 0 then 'hit' when 1 then 'preceding' else 'following' end as context_type from (select *, row_number() over (partition by query_id, doc_id order by rk, kind) as n from parts) r where n = 1"""


def _budget(d: Dialect) -> str:
    """By source: texts in order until the budget of tokens is full; a long one is cut to half the budget, and the
    first that overflows to what is left, if that is over 100."""
    budget = int(1200 * BUDGET_SHARE)
    return f"""with t as (select source, doc_id, least(tokens, {budget // 2}) as tokens, tokens > {budget // 2} as cut from (select source, doc_id, greatest(1, cast(floor({d.size(d.words('text'))} * 1.3) as bigint)) as tokens from documents) x),
        s as (select *, cast(sum(tokens) over (partition by source order by doc_id rows between unbounded preceding and current row) as bigint) as upto from t),
        o as (select *, cast(sum(case when upto > {budget} then 1 else 0 end) over (partition by source order by doc_id rows between unbounded preceding and current row) as bigint) as over_ from s)
        select source, doc_id, case when upto <= {budget} then tokens else {budget} - (upto - tokens) end as tokens, cut or upto > {budget} as truncated from o where over_ = 0 or (over_ = 1 and upto > {budget} and {budget} - (upto - tokens) > 100)"""


@builder("WIN03_token_budget", _budget)
def _budgeted(spark, get):
    """As the SQL, with the sums of a source made in many tasks: what fits lies before the first text that does not."""
    budget = int(1200 * BUDGET_SHARE)
    n = F.greatest(F.lit(1), F.floor(F.expr(SPARK.size(SPARK.words("text"))) * 1.3).cast("bigint"))
    t = get("documents").select("source", "doc_id", n.alias("tokens")).select("source", "doc_id", F.least("tokens", F.lit(budget // 2)).cast("bigint").alias("tokens"), (F.col("tokens") > budget // 2).alias("cut"))
    s = running(t, ["source"], [F.asc("doc_id")], {"upto": F.col("tokens")})
    first = s.where(F.col("upto") > budget).groupBy("source").agg(F.min("doc_id").alias("first"))
    left = F.lit(budget) - (F.col("upto") - F.col("tokens"))
    fits = F.col("upto") <= budget
    kept = s.join(first, "source", "left").where((F.col("first").isNull() | (F.col("doc_id") < F.col("first"))) & fits | (F.col("doc_id") == F.col("first")) & (left > 100))
    return kept.select("source", "doc_id", F.when(fits, F.col("tokens")).otherwise(left).alias("tokens"), (F.col("cut") | ~fits).alias("truncated"))


@builder("WIN04_first_occurrence", "select doc_id, source from (select doc_id, source, row_number() over (partition by text order by doc_id) as n from documents) r where n = 1")
def _first(spark, get):
    """Texts meet by their SHA-256 and length, with partial minima, and never travel."""
    return get("documents").groupBy(F.sha2("text", 256).alias("h"), F.length("text").alias("n")).agg(F.min(F.struct("doc_id", "source")).alias("least")).select("least.doc_id", "least.source")


@template("WIN07_page_bucket_diversity")
def _diverse(d: Dialect) -> str:
    """Each query's hits whose source or page bucket comes first with them, 2 * 12 at most; where that leaves under
    three, the other hits fill up to twelve. A hit's page is the place of its document in tens of ids; buckets have three."""
    return f"""with {bm25(d, 20)}, {ranked('hit', 'bm', 20)}, x as (select query_id, h.doc_id, rk, source, cast(floor(floor(h.doc_id / 10) / 3) * 3 as bigint) as bucket from hit h join documents m on m.doc_id = h.doc_id),
        o as (select *, row_number() over (partition by query_id, source order by rk) as a, row_number() over (partition by query_id, bucket order by rk) as b, count(*) over (partition by query_id) as n from x),
        k as (select *, case when a = 1 or b = 1 then 0 else 1 end as rest, sum(case when a = 1 or b = 1 then 1 else 0 end) over (partition by query_id) as kept from o),
        p as (select *, row_number() over (partition by query_id order by rest, rk) as place from k)
        select query_id, doc_id, cast(place as int) as place from p where (rest = 0 and place <= 24) or (rest = 1 and kept < least(3, n) and place <= 12)"""


simple(
    "WIN08_keyframes",
    """select user_id, event_id, ts from (select user_id, event_id, ts, place, n, row_number() over (partition by user_id, case when place = 1 or place = n then 0 else 1 end order by value desc, event_id) as best from (select *, row_number() over (partition by user_id order by ts, event_id) as place, count(*) over (partition by user_id) as n from events) p) r where place = 1 or place = n or best <= 6""",
)
simple("WIN10_frame_reduction", "select user_id, event_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as place from (select *, row_number() over (partition by user_id order by value desc, event_id) as n from events) r where n <= 5")
simple(
    "WIN11_table_rows",
    """select user_id, table_row, count(*) as cells, min(event_id) as first_cell from (select user_id, event_id, cast(sum(case when before is null or value - before > 20 then 1 else 0 end) over (partition by user_id order by value, event_id rows between unbounded preceding and current row) as bigint) as table_row from (select user_id, event_id, value, lag(value) over (partition by user_id order by value, event_id) as before from events) g) s group by user_id, table_row""",
)
simple("WIN12_chart_zones", "select event_id, case when y < 0.15 then 'title' when y > 0.85 then 'x_axis' when x < 0.15 then 'y_axis' else 'body' end as zone from (select event_id, (value - floor(value)) as x, cast(event_id % 100 as double) / 100 as y from events) p")
@builder("TOP03_sort_with_fallback", "select doc_id, cast(row_number() over (order by case when any_rerank then coalesce(rerank, 0) else score end desc, doc_id) as int) as rank from (select doc_id, score, rerank, max(case when rerank is not null then 1 else 0 end) over () = 1 as any_rerank from (select doc_id, cast(n_chars as double) as score, cast(case when doc_id % 2 = 0 then doc_id % 13 end as double) as rerank from documents) x) r")
def _fallback(spark, get):
    """All rows in one order, by rerank scores if any row has one; ranks are made in many tasks."""
    x = get("documents").selectExpr("doc_id", "cast(n_chars as double) as score", "cast(case when doc_id % 2 = 0 then doc_id % 13 end as double) as rerank")
    some = x.agg(F.max(F.col("rerank").isNotNull()).alias("any_rerank"))
    by = x.crossJoin(F.broadcast(some)).select("doc_id", F.when(F.col("any_rerank"), F.coalesce("rerank", F.lit(0.0))).otherwise(F.col("score")).alias("by"))
    return numbered(by, [], [F.desc("by"), F.asc("doc_id")]).selectExpr("doc_id", "cast(rank as int) as rank")


simple("TOP04_hard_cap", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 12")
@builder("TOP05_composite_sort", "select source, doc_id, cast(row_number() over (partition by source order by n_chars, doc_id) as int) as place from documents")
def _composite(spark, get):
    return numbered(get("documents").select("source", "doc_id", "n_chars"), ["source"], [F.asc("n_chars"), F.asc("doc_id")], "place").selectExpr("source", "doc_id", "cast(place as int) as place")


simple("TOP06_query_cap", "select conv_id, turn from (select conv_id, turn, row_number() over (partition by conv_id order by turn) as n from conversations) r where n <= 5")
