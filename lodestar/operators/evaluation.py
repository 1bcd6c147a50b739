"""Evaluation: retrieval and text metrics, gates, comparisons."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import builder, template
from ..plans.dialect import Dialect
from .answers import checked, claim_pairs
from .retrieval import bm25, fused, gold, ranked, two_lists
from .text import answers

LOG2 = "ln({0}) / ln(2)"


def judged(d: Dialect, depth: int = 10) -> str:
    """rk: ranked hits with their grade; many: how much gold each query has. Gold holds the passage verbatim
    (grade 2), or is a document of gold's source that shares the first 40 characters (grade 1)."""
    return f"""{bm25(d)}, {ranked('top', 'bm', depth)},
        gold as (select query_id, doc_id, max(grade) as grade from (select query_id, doc_id, 2 as grade from ({gold(d)}) g2 union all select query_id, doc_id, 1 from ({gold(d, 40)}) g1) g group by query_id, doc_id),
        many as (select query_id, count(*) as n_gold from gold group by query_id),
        rk as (select t.query_id, t.doc_id, cast(t.rk as int) as rk, coalesce(g.grade, 0) as grade from top t join many m on m.query_id = t.query_id left join gold g on g.query_id = t.query_id and g.doc_id = t.doc_id)"""


def _metric(name: str, expression: str, extra: str = "") -> None:
    template(name)(lambda d: f"with {judged(d)}{extra} select m.query_id, {expression} from many m left join rk on rk.query_id = m.query_id group by m.query_id, n_gold")


_metric("EVL01_hit_recall", "max(case when grade > 0 and rk <= 1 then 1 else 0 end) as hit_1, max(case when grade > 0 and rk <= 5 then 1 else 0 end) as hit_5, max(case when grade > 0 then 1 else 0 end) as hit_10")
_metric("EVL02_fraction_recall", "round(cast(sum(case when grade > 0 and rk <= 5 then 1 else 0 end) as double) / n_gold, 6) as recall_5, round(cast(sum(case when grade > 0 then 1 else 0 end) as double) / n_gold, 6) as recall_10")
_metric("EVL03_precision", "round(coalesce(cast(sum(case when grade > 0 and rk <= 5 then 1 else 0 end) as double) / nullif(least(5, count(rk)), 0), 0), 6) as precision_5")
_metric("EVL04_reciprocal_rank", "round(coalesce(1e0 / min(case when grade > 0 then rk end), 0), 6) as reciprocal_rank")
template("EVL05_ndcg")(
    lambda d: f"""with {judged(d)}, ideal as (select query_id, sum((power(2, grade) - 1) / (ln(i + 1) / ln(2))) as best from (select query_id, grade, row_number() over (partition by query_id order by grade desc, doc_id) as i from gold) o where i <= 10 group by query_id),
    got as (select query_id, sum((power(2, grade) - 1) / (ln(rk + 1) / ln(2))) as dcg from rk group by query_id)
    select i.query_id, round(coalesce(dcg, 0) / best, 6) as ndcg_10 from ideal i left join got g on g.query_id = i.query_id"""
)


@template("EVL07_bleu_1")
def _bleu(d: Dialect) -> str:
    """Clipped unigram precision with the brevity penalty, of each turn against the one before."""
    pair = "(select c.conv_id, c.turn, lower(n.text) as cand, lower(c.text) as ref from conversations c join conversations n on n.conv_id = c.conv_id and n.turn = c.turn + 1)"
    return f"""with p as {pair}, c as (select conv_id, turn, item, count(*) as n from {d.unnest('p', 'conv_id, turn', d.words('cand'), 'item')} t group by conv_id, turn, item), r as (select conv_id, turn, item, count(*) as n from {d.unnest('p', 'conv_id, turn', d.words('ref'), 'item')} t group by conv_id, turn, item),
        s as (select c.conv_id, c.turn, sum(least(c.n, coalesce(r.n, 0))) as hit, sum(c.n) as total from c left join r on r.conv_id = c.conv_id and r.turn = c.turn and r.item = c.item group by c.conv_id, c.turn), l as (select conv_id, turn, {d.size(d.words('cand'))} as cl, {d.size(d.words('ref'))} as rl from p)
        select s.conv_id, s.turn, round(case when cl > rl then 1e0 else exp(1e0 - cast(rl as double) / greatest(cl, 1)) end * hit / total, 4) as bleu_1 from s join l on l.conv_id = s.conv_id and l.turn = s.turn"""


def counted_turns(get, counts: Callable[[list, list], Sequence[int]], names: Sequence[str], added: bool = False) -> DataFrame:
    """(conv_id, turn, names) by counts(candidates, references), lower-cased texts or nulls: those of the next turn and
    of the turn itself. With added only the names' sums, one row for each batch.

    The two meet by one shuffle, and what is counted stays in the task. A turn that stands twice is paired with each
    next one, so it has several candidates or references.
    """
    turns = get("conversations").where("conv_id is not null and turn is not null").select("conv_id", "turn", F.lower("text").alias("text"))
    kind = turns.schema["turn"].dataType
    own = turns.select("conv_id", "turn", F.struct("text").alias("ref"), F.lit(None).cast("struct<text:string>").alias("cand"))
    following = turns.select("conv_id", (F.col("turn") - 1).cast(kind).alias("turn"), F.lit(None).cast("struct<text:string>").alias("ref"), F.struct("text").alias("cand"))
    met = own.unionByName(following).groupBy("conv_id", "turn").agg(F.collect_list("cand").alias("cand"), F.collect_list("ref").alias("ref")).where("size(cand) > 0 and size(ref) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ([[x["text"] for x in row] for row in batch.column(k).to_pylist()] for k in (2, 3))
            rows = [counts(c, r) for c, r in zip(*texts, strict=True)]
            if added:
                yield pa.record_batch([pa.array([sum(r[k] for r in rows)], pa.int64()) for k in range(len(names))], names=names)
            else:
                yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names)))], names=["conv_id", "turn", *names])

    keys = "" if added else ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn")) + ", "
    return met.mapInArrow(run, keys + ", ".join(f"{n} bigint" for n in names))


def clipped(candidates: list[Sequence], references: list[Sequence]) -> tuple[int, int, int]:
    """Common grams, the candidates' and the references', of all pairs; None is in no other list."""
    c, r = (Counter(g for x in side for g in x) for side in (candidates, references))
    hit = sum(min(n * len(references), r[g] * len(candidates)) for g, n in c.items() if g in r and g is not None)
    return hit, c.total() * len(references), r.total() * len(candidates)


def _rouge(name: str, n: int) -> None:
    def sql(d: Dialect) -> str:
        def grams(x: str) -> str:
            w = d.all(f"lower({x})", "[a-z0-9]+")
            return w if n == 1 else d.map(d.count_up("1", f"greatest({d.size(w)} - {n - 1}, 1)"), "i", d.join(d.slice(w, "i", str(n)), "' '"))

        pair = "(select c.conv_id, c.turn, n.text as cand, c.text as ref from conversations c join conversations n on n.conv_id = c.conv_id and n.turn = c.turn + 1)"
        count = lambda x: f"(select conv_id, turn, item, count(*) as n from {d.unnest('p', 'conv_id, turn', grams(x), 'item')} t group by conv_id, turn, item)"
        return f"""with p as {pair}, c as {count('cand')}, r as {count('ref')}, h as (select c.conv_id, c.turn, sum(least(c.n, r.n)) as hit from c join r on r.conv_id = c.conv_id and r.turn = c.turn and r.item = c.item group by c.conv_id, c.turn),
            cn as (select conv_id, turn, sum(n) as n from c group by conv_id, turn), rn as (select conv_id, turn, sum(n) as n from r group by conv_id, turn)
            select cn.conv_id, cn.turn, round(coalesce(2e0 * hit / (cn.n + rn.n), 0), 4) as f from cn join rn on rn.conv_id = cn.conv_id and rn.turn = cn.turn left join h on h.conv_id = cn.conv_id and h.turn = cn.turn"""

    def grams_of(text: str | None) -> list[str | None]:
        if text is None:
            return [] if n == 1 else [None]
        w = re.findall("[a-z0-9]+", text)
        return w if n == 1 else [" ".join(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))]

    @builder(name, sql)
    def counted(spark, get) -> DataFrame:
        """A text with fewer words is one gram, a null text one that equals no other."""
        counts = lambda cand, ref: clipped([grams_of(x) for x in cand], [grams_of(x) for x in ref])
        return counted_turns(get, counts, ["hit", "c", "r"]).where("c > 0 and r > 0").selectExpr("conv_id", "turn", "round(2e0 * hit / (c + r), 4) as f")


_rouge("EVL08_rouge_1", 1)
_rouge("EVL08_rouge_2", 2)
template("EVL10_support_ratio")(lambda d: f"with {checked(d)}, {claim_pairs(d)} select doc_id, count(*) as claims, round(avg(case when score >= 0.7 then cast(1 as double) else 0 end), 6) as ratio from cl group by doc_id")


def _corpus_bleu(d: Dialect) -> str:
    """BLEU-4 of all turns against the ones before: clipped n-gram counts are added up over the corpus first. The
    hypothesis is the next turn; without a match of some length the score is 0."""
    pair = "(select c.conv_id, c.turn, lower(n.text) as cand, lower(c.text) as ref from conversations c join conversations n on n.conv_id = c.conv_id and n.turn = c.turn + 1)"
    run = lambda w, n: d.map(d.count_up("1", f"greatest({d.size(w)} - {n - 1}, 1)"), "i", d.join(d.slice(w, "i", str(n)), "' '"))
    parts = []
    for n in range(1, 5):
        count = lambda x, n=n: f"(select conv_id, turn, item, count(*) as n from {d.unnest('w', 'conv_id, turn', run(x, n), 'item')} t where {d.size(d.words('item'))} = {n} group by conv_id, turn, item)"
        parts.append(f"select {n} as n, cast(sum(least(c.n, coalesce(r.n, 0))) as double) as hit, cast(sum(c.n) as double) as total from {count('cand')} c left join {count('ref')} r on r.conv_id = c.conv_id and r.turn = c.turn and r.item = c.item")
    return f"""with p as {pair}, w as (select conv_id, turn, {d.words('cand')} as cand, {d.words('ref')} as ref from p), g as ({' union all '.join(parts)}),
        l as (select cast(sum({d.size('cand')}) as double) as cl, cast(sum({d.size('ref')}) as double) as rl from w)
        select round(case when min(hit) > 0 then 100 * exp(avg(ln(greatest(hit, 1) / total))) * case when max(cl) > max(rl) then 1e0 else exp(1e0 - max(rl) / max(cl)) end else 0e0 end, 4) as bleu from g cross join l"""


def _bleu_counts(candidates: list[str | None], references: list[str | None]) -> tuple[int, ...]:
    """For each length up to 4 the clipped matches and the candidates' n-grams, then both sides' words."""
    cand, ref = ([[w for w in re.split(r"[ \t\n\x0b\f\r]+", x or "") if w] for x in side] for side in (candidates, references))
    runs = lambda side, n: [list(zip(*(w[k:] for k in range(n)), strict=False)) for w in side]
    found = [x for n in range(1, 5) for x in clipped(runs(cand, n), runs(ref, n))[:2]]
    return (*found, sum(map(len, cand)) * len(ref), sum(map(len, ref)) * len(cand))


@builder("EVL09_corpus_bleu", _corpus_bleu)
def _added_bleu(spark, get) -> DataFrame:
    """Each task adds its counts up; the score is of the sums."""
    names = [*(f"{x}{n}" for n in range(1, 5) for x in ("hit", "total")), "cl", "rl"]
    sums = counted_turns(get, _bleu_counts, names, added=True).selectExpr(*(f"cast(sum({x}) as double) as {x}" for x in names))
    # a length that no candidate has does not count
    lengths = "stack(4, " + ", ".join(f"{n}, case when total{n} > 0 then hit{n} end, nullif(total{n}, 0e0)" for n in range(1, 5)) + ") as (n, hit, total)"
    return sums.selectExpr("cl", "rl", lengths).selectExpr("round(case when min(hit) > 0 then 100 * exp(avg(ln(greatest(hit, 1) / total))) * case when max(cl) > max(rl) then 1e0 else exp(1e0 - max(rl) / max(cl)) end else 0e0 end, 4) as bleu")


template("EVL13_keyword_score")(lambda d: f"select doc_id, round(cast({d.count_of('lower(text)', ('the', 'and', 'machine', 'que', 'der'))} as double) / 5, 6) as score from documents")
# fixed values: the service levels, by check
SLO = (("retrieval recall_hit@5", "<", 0.80, 3), ("retrieval mrr", "<", 0.50, 3), ("retrieval ndcg@10", "<", 0.60, 3), ("retrieval p95_ms", ">", 500.0, 1), ("pipeline p95_ms", ">", 8000.0, 1), ("load qps", "<", 0.1, 3))
MAX_DROP = 0.03


def run_metrics(d: Dialect, runs: str) -> str:
    """rm as (run, recall_hit_5, mrr, ndcg_10), means over the queries that have gold, of runs (run, query_id, doc_id, rk)."""
    gain = f"1e0 / ({LOG2.format('rk + 1')})"
    return f"""gd as ({gold(d)}), gm as (select query_id, count(*) as n_gold from gd group by query_id), rs as ({runs}), rn as (select distinct run from rs),
        rh as (select run, rs.query_id, min(rk) as first_, sum(case when rk <= 10 then {gain} else 0e0 end) as dcg from rs join gd on gd.query_id = rs.query_id and gd.doc_id = rs.doc_id group by run, rs.query_id),
        ri as (select query_id, sum(1e0 / ({LOG2.format('i + 1')})) as best from (select query_id, row_number() over (partition by query_id order by doc_id) as i from gd) o where i <= 10 group by query_id),
        rm as (select rn.run, avg(case when first_ <= 5 then 1e0 else 0e0 end) as recall_hit_5, avg(coalesce(1e0 / first_, 0e0)) as mrr, avg(coalesce(dcg / best, 0e0)) as ndcg_10 from gm cross join rn join ri on ri.query_id = gm.query_id left join rh on rh.query_id = gm.query_id and rh.run = rn.run group by rn.run)"""


@template("EVL14_slo_gate")
def _slo(d: Dialect) -> str:
    """Six checks and their violations. An event stands for a request: a click for a retrieval, any for a pipeline's run."""
    values = ("recall_hit_5", "mrr", "ndcg_10", "click_p95", "all_p95", "qps")
    checks = " union all ".join(f"select {i} as place, {d.text(name)} as check_name, cast({v} as double) as value, {bound}e0 as bound, not ({v} {sign} {bound}) as ok, case when {v} {sign} {bound} then {d.text(name + ' ')} || {d.fixed(v, n)} || {d.text(f' {sign} {bound:.{n}f}')} end as violation from m" for i, ((name, sign, bound, n), v) in enumerate(zip(SLO, values, strict=True)))
    late = "prepared_latencies" if d.spark else f"""(select {d.percentile("case when event_type = 'click' then value end", 0.95)} as click_p95, {d.percentile('value', 0.95)} as all_p95 from events) x"""
    return f"""with {bm25(d)}, {ranked('sparse', 'bm')}, {run_metrics(d, "select 'bm25' as run, query_id, doc_id, rk from sparse")},
        l as (select click_p95, all_p95, qps from {late} cross join (select count(*) / (max({d.seconds('ts')}) - min({d.seconds('ts')})) as qps from events) r), m as (select * from rm cross join l)
        select place, check_name, round(value, 6) as value, bound, ok, violation from ({checks}) c"""


@template("EVL15_drift_gate")
def _drift(d: Dialect) -> str:
    """Three metrics of a current run (the second list) against a baseline (BM25); a drop over the limit is drift."""
    values = (("recall_hit@5", "recall_hit_5"), ("mrr", "mrr"), ("ndcg@10", "ndcg_10"))
    rows = " union all ".join(f"select '{name}' as metric, b.{v} as baseline, c.{v} as current_value from rm b join rm c on b.run = 'a' and c.run = 'b'" for name, v in values)
    drop = f"'(drop=' || {d.fixed('baseline - current_value', 3)} || ')'"
    return f"""with {two_lists(d)}, {run_metrics(d, "select 'a' as run, query_id, doc_id, rk from sparse union all select 'b', query_id, doc_id, rk from dense")}
        select metric, round(baseline, 6) as baseline, round(current_value, 6) as current_value, baseline - current_value > {MAX_DROP} as drifted, case when baseline - current_value > {MAX_DROP} then metric || ' dropped ' || {d.fixed('baseline', 3)} || ' -> ' || {d.fixed('current_value', 3)} || ' ' || {drop} end as violation from ({rows}) r"""


@template("EVL16_ablation")
def _ablation(d: Dialect) -> str:
    """The retriever comparison over variants: each list alone, their fusion, and the fusion of shorter lists."""
    short = "select query_id, doc_id, sum(1e0 / (60 + rk)) as score from (select query_id, doc_id, rk from sparse where rk <= 5 union all select query_id, doc_id, rk from dense where rk <= 5) h group by query_id, doc_id"
    runs = " union all ".join(f"select '{name}' as run, query_id, doc_id, rk from {source}" for name, source in (("sparse_only", "sparse"), ("dense_only", "dense"), ("fused", "hybrid"), ("fused_top_5", "halved")))
    return f"""with {fused(d)}, {ranked('hybrid', 'fused')}, sh as (select query_id, doc_id, round(score, 8) as score from ({short}) s), {ranked('halved', 'sh')}, {run_metrics(d, runs)}
        select run as variant, round(recall_hit_5, 6) as recall_hit_5, round(mrr, 6) as mrr, round(ndcg_10, 6) as ndcg_10 from rm"""


template("EVL17_blind_packing")(lambda d: "select conv_id, case when flip then 'b' else 'a' end as a_label, case when flip then t2 else t1 end as a_text, case when flip then t1 else t2 end as b_text from (select q.conv_id, substr(md5(cast(q.conv_id as varchar(20)) || ':13'), 1, 1) in ('0', '1', '2', '3', '4', '5', '6', '7') as flip, q.text as t1, a.text as t2 from conversations q join conversations a on a.conv_id = q.conv_id and q.turn = 0 and a.turn = 1) p")
template("EVL18_rolling_tracker")(lambda d: "select user_id, window_no, count(*) as queries, round(avg(value), 6) as mean_latency, sum(case when event_type = 'error' then 1 else 0 end) as failures from (select user_id, value, event_type, cast(floor((row_number() over (partition by user_id order by ts, event_id) - 1) / 10) as bigint) as window_no from events) w group by user_id, window_no")
