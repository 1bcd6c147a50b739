"""Aggregates: counts, summaries, percentiles, votes, agreement, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import builder, template
from ..plans.dialect import SPARK, Dialect
from ..plans.quantiles import percentiles


def simple(name: str, sql) -> None:
    template(name)(sql if callable(sql) else lambda d: sql)


simple("AGG01_count_by_category", "select source, lang, count(*) as n from documents group by source, lang")
simple("AGG03_mean_or_zero", "select event_type, round(coalesce(avg(case when value > 1000 then value end), 0), 6) as mean from events group by event_type")
simple("AGG07_throughput", lambda d: f"select event_type, round(cast(sum(case when value > 0 then 1 else 0 end) as double) / (max({d.seconds('ts')}) - min({d.seconds('ts')})), 9) as per_second from events group by event_type")
simple("AGG08_plan_metrics", "select count(*) as n, round(avg(n_chars), 6) as mean, min(n_chars) as least, max(n_chars) as most, round(avg(case when n_chars > 2000 then cast(1 as double) else 0 end), 6) as long_rate, sum(case when lang = 'en' then 1 else 0 end) as english, sum(case when lang = 'fr' then 1 else 0 end) as french from documents")
simple("AGG09_macro_average", "select d.lang, round(avg(cast(coalesce(l.quality, 0) as double)), 4) as over_all, round(avg(cast(l.quality as double)), 4) as over_available from documents d left join labels l on l.doc_id = d.doc_id group by d.lang")
simple("AGG10_majority_vote", "select source, lang as vote from (select source, lang, row_number() over (partition by source order by case when lang in ('xx') then 0 else 1 end, count(*) desc, lang) as n from documents where length(lang) = 2 group by source, lang) r where n = 1")
simple("AGG11_rates", "select lang, round(avg(cast(quality as double)), 6) as quality_rate, round(avg(cast(case when toxic = 1 then 1 else 0 end as double)), 6) as toxic_rate, count(*) as n from labels join documents on labels.doc_id = documents.doc_id group by lang")
simple("AGG12_group_stats", "select event_type, count(*) as n, round(avg(value), 6) as mean, round(avg(cast(case when value > 10 then 1 else 0 end as double)), 6) as success from events group by event_type")
simple("AGG13_region_confidence", "select user_id, round(avg(value), 3) as confidence from events group by user_id")
simple("AGG14_most_common_line", lambda d: f"select source, {d.argmax('line', 'n * 1000000 - rank_')} as line, max(n) as n from (select source, line, n, row_number() over (partition by source order by n desc, line) as rank_ from (select source, {d.at(d.split('text', chr(92) + 'n'), '1')} as line, count(*) as n from documents group by 1, 2) c) r where rank_ = 1 and n >= 2 group by source")
simple("AGG15_hit_rate", "select event_type, sum(case when value > 20 then 1 else 0 end) as hits, count(*) as n, round(cast(sum(case when value > 20 then 1 else 0 end) as double) / nullif(count(*), 0), 6) as rate from events group by event_type")
simple(
    "AGG16_cohens_kappa",
    """with p as (select count(*) as n, avg(cast(case when quality = toxic then 1 else 0 end as double)) as po, avg(cast(quality as double)) as a, avg(cast(toxic as double)) as b from labels where quality is not null and toxic is not null)
    select n, round(po, 6) as po, round(a * b + (1 - a) * (1 - b), 6) as pe, round(case when 1 - (a * b + (1 - a) * (1 - b)) <= 1e-12 then 0 else (po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))) end, 6) as kappa from p""",
)
simple("AGG17_human_summary", "select role, round(avg(length(text)), 6) as mean_length, round(avg(cast(case when turn % 2 = 0 then 1 else 0 end as double)), 6) as a_win_rate, count(*) as n from conversations group by role")
simple("AGG18_total_time", "select user_id, round(sum(case when event_type <> 'error' then value else 0 end), 6) as total from events group by user_id")
simple("AGG19_best_attempt", "select user_id, event_id, value from (select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id) as n from events) r where n = 1")
simple("AGG20_issue_report", "select doc_id, case when quality = 0 and toxic = 1 then 'both' when quality = 0 then 'failed' else 'unfaithful' end as issue from labels where quality = 0 or toxic = 1")
simple("AGG_rollup_extension", "select coalesce(lang, 'all') as lang, coalesce(source, 'all') as source, count(*) as n from documents group by rollup(lang, source)")
simple("SNK03_index_manifest", "select lang as modality, count(*) as n, sum(n_chars) as chars from documents group by lang")
simple("SNK04_evaluation_csv", "select item_id, replace(substr(b.text, 1, 200), chr(10), ' ') as query, substr(d.text, 1, 500) as answer from benchmark b join documents d on d.doc_id = b.item_id")
simple("SRC16_modality_routing", lambda d: f"select kind, count(*) as n from (select case when ext in ('html', 'htm', 'txt', 'pdf', 'md', '') then 'text' when ext in ('png', 'jpg', 'jpeg') then 'image' when ext in ('mp3', 'wav') then 'audio' when ext in ('mp4', 'mov') then 'video' else 'unknown' end as kind from (select lower({d.extract('url', chr(92) + '.([a-z0-9]+)$', 1)}) as ext from pages) e) k group by kind")
simple("SRC18_file_dedupe", "select source, n_chars, min(doc_id) as doc_id, count(*) as copies from documents group by source, n_chars")
simple("SRC18_latest_files", "select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id desc) as n from documents) r where n <= 3")

# generic relational coverage on the star schema: an extension, not in the inventory
simple("EXT_pricing_summary", "select l_returnflag, l_linestatus, round(sum(cast(l_quantity as double)), 2) as qty, round(sum(cast(l_extendedprice as double)), 2) as price, count(*) as n from lineitem group by l_returnflag, l_linestatus")
simple("EXT_nation_revenue", "select n_name, round(sum(cast(l_extendedprice as double) * (1 - cast(l_discount as double))), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey group by n_name")


@builder("AGG04_percentile_sketch")
def _sketch(spark, get):
    """As AGG04_percentile by a sketch of bounded size: each value's rank is off by at most a 10,000th of the rows."""
    p = lambda q: F.percentile_approx("value", q, 10_000)
    return get("events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.9).alias("p90"))


def _with_percentiles(df, keys: list[str], wanted: dict[str, float], *others, value: str = "value"):
    """Aggregates of groups beside exact percentiles that no task holds whole, rounded to six places."""
    found = percentiles(df, keys, F.col(value), wanted).select(*keys, *(F.round(n, 6).alias(n) for n in wanted))
    if not others:
        return found
    rest = df.groupBy(*keys).agg(*others)
    own = found.select(*(F.col(k).alias(f"_{k}") for k in keys), *wanted)
    return rest.join(own, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] or F.lit(True)).select(*keys, *(c for c in rest.columns if c not in keys), *wanted)


def _mean(column: str = "value"):
    return F.round(F.avg(column), 6).alias("mean")


def _tokens(get):
    return get("documents").select("source", F.expr(SPARK.size(SPARK.words("text"))).alias("n"))


@builder("AGG02_token_summary", lambda d: f"select source, min(n) as least, max(n) as most, round(avg(n), 6) as mean, round({d.percentile('n', 0.5)}, 6) as median from (select source, {d.size(d.words('text'))} as n from documents) t group by source")
def _token_summary(spark, get):
    return _with_percentiles(_tokens(get), ["source"], {"median": 0.5}, F.min("n").alias("least"), F.max("n").alias("most"), _mean("n"), value="n")


@builder("AGG04_percentile", lambda d: f"select event_type, round({d.percentile('value', 0.5)}, 6) as p50, round({d.percentile('value', 0.9)}, 6) as p90 from events group by event_type")
def _percentile(spark, get):
    return _with_percentiles(get("events").select("event_type", "value"), ["event_type"], {"p50": 0.5, "p90": 0.9})


@builder("AGG05_latency_summary", lambda d: f"select round({d.percentile('value', 0.5)}, 6) as p50, round({d.percentile('value', 0.95)}, 6) as p95, round({d.percentile('value', 0.99)}, 6) as p99, round(avg(value), 6) as mean from events")
def _latency(spark, get):
    return _with_percentiles(get("events").select("value"), [], {"p50": 0.5, "p95": 0.95, "p99": 0.99}, _mean())


@builder("AGG06_stage_latency", lambda d: f"select stage, count(*) as n, round({d.percentile('v', 0.5)}, 6) as p50, round({d.percentile('v', 0.95)}, 6) as p95, round(avg(v), 6) as mean from (select 'total' as stage, value as v from events union all select event_type, value from events) s group by stage")
def _stage_latency(spark, get):
    events = get("events")
    stages = events.select(F.lit("total").alias("stage"), "value").unionAll(events.select(F.col("event_type").alias("stage"), "value"))
    return _with_percentiles(stages, ["stage"], {"p50": 0.5, "p95": 0.95}, F.count(F.lit(1)).alias("n"), _mean())


@builder("SNK02_ingestion_manifest", lambda d: f"select count(distinct source) as n_files, count(*) as n_chunks, min(n) as least, max(n) as most, round(avg(n), 6) as mean, round({d.percentile('n', 0.5)}, 6) as median from (select source, {d.size(d.words('text'))} as n from documents) t")
def _manifest(spark, get):
    return _with_percentiles(_tokens(get), [], {"median": 0.5}, F.countDistinct("source").alias("n_files"), F.count(F.lit(1)).alias("n_chunks"), F.min("n").alias("least"), F.max("n").alias("most"), _mean("n"), value="n")


@builder("AGG04_percentile_merged")
def _merged(spark, get):
    """As AGG04_percentile by sketches that merge: one of each day's values, which could be kept, merged by type.

    A value's rank is off by at most about 0.4 % of the rows (sketches of k = 1000).
    """
    days = get("events").groupBy("event_type", F.to_date(F.col("ts").cast("timestamp")).alias("day")).agg(F.kll_sketch_agg_double("value", 1000).alias("sketch"))
    whole = days.groupBy("event_type").agg(F.kll_merge_agg_double("sketch", 1000).alias("sketch"))
    return whole.select("event_type", F.kll_sketch_get_n_double("sketch").alias("n"), *(F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in (("p50", 0.5), ("p90", 0.9))))
