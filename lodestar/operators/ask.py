"""Questions to checked answers, in batches: the whole way from a question to a cited, verified answer.

    answers = ask(questions, chunks)                       # no model
    answers = ask(questions, chunks, index=stored_index, embedder=e, scorer=s, generator=g, cache=earlier)

Each step is one of the operators: preprocessing, cache, plan, expansion, sparse and dense retrieval of
every variant, fusion, reranking, context, answer, verification; what is not verified is asked again with
more candidates, and the better of the attempts stays.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import builder
from ..functions.scorers import Embedder, Generator, PairScorer, embed, generate, rerank
from ..plans.dialect import SPARK as D
from ..plans.search import Index, best, build_index, nearest_vectors
from ..plans.store import stored
from .answers import BRACKETS, CITATION, SUPPORTED, WEIGHTS, level, overlap
from .caching import DAY, HOUR, folded
from .greedy import context_parts, sentences
from .planning import planned, strategy, variants
from .retrieval import RRF
from .text import ABSTAIN, hedging

NOTE = "Best effort response (confidence below threshold)"
NO_ANSWER = "I couldn't find a confident answer to your question."
#: What an answer must reach to be accepted, and to be worth another attempt.
ACCEPTED, HOPELESS = 0.7, 0.25
ANSWER = "query_id string, query string, intent string, strategy string, attempt int, answer string, cites array<string>, confidence double, level string, verified boolean, from_cache boolean, note string"


def _with_view(df: DataFrame, sql) -> DataFrame:
    """SQL over df, by a view that is gone afterwards."""
    name = f"_asked_{id(df)}"
    df.createTempView(name)
    try:
        return df.sparkSession.sql(sql(name))
    finally:
        df.sparkSession.catalog.dropTempView(name)


def plan(questions: DataFrame) -> DataFrame:
    """questions (item_id, q) with intent, strategy, dense_k, sparse_k and rerank_k."""
    return _with_view(questions, lambda v: f"select item_id, q, intent, {strategy()} from {planned(D, v)} p")


def retrieve(plans: DataFrame, chunks: DataFrame, index: Index, vectors: DataFrame, embedder: Embedder | None, factor: int) -> DataFrame:
    """(item_id, doc_id, score): every variant's sparse and dense list, as deep as planned times factor, fused by ranks."""
    asked = stored(_with_view(plans.select("item_id", "q"), lambda v: f"select item_id, place, variant, xxhash64(item_id, place) as vid from {variants(D, v)} w"))
    depth = plans.select("item_id", "dense_k", "sparse_k")
    sparse = index.top(asked, 100 * factor, "vid", "variant").select(F.col("query_id").alias("vid"), "doc_id", "rk", F.lit("sparse_k").alias("list"))
    embedded = embed(asked.select("vid", F.col("variant").alias("text")), embedder)
    dense = nearest_vectors(vectors.select(F.col("doc_id").alias("vid"), "embedding"), embedded, 100 * factor, id_col="vid").where("cosine > 0").select(F.col("query_id").alias("vid"), F.col("vec_id").alias("doc_id"), "rk", F.lit("dense_k").alias("list"))
    lists = sparse.unionByName(dense).join(asked.select("vid", "item_id"), "vid").join(depth, "item_id")
    inside = F.col("rk") <= factor * F.when(F.col("list") == "sparse_k", F.col("sparse_k")).otherwise(F.col("dense_k"))
    return lists.where(inside).groupBy("item_id", "doc_id").agg(F.round(F.sum(1.0 / (RRF + F.col("rk"))), 8).alias("score"))


def best_sentence(query: str, parts: list[tuple[str, str]]) -> str:
    """The context's sentence with most of the question's words, and its citation; an abstention if none has any."""
    words = set(re.findall(r"\w{3,}", query.lower()))
    found = [(len(words & set(re.findall(r"\w{3,}", s.lower()))), -i, -k, s, cite) for i, (cite, text) in enumerate(parts) for k, s in enumerate(sentences(text))]
    shared, _, _, sentence, cite = max(found, default=(0, 0, 0, "", ""))
    return f"{sentence.rstrip('.!? ')} [{cite}]." if shared else "Insufficient context to answer."


def answered(hits: DataFrame, generator: Generator | None) -> DataFrame:
    """(item_id, answer, cites, contents) of hits (item_id, q, doc_id, score, source, content)."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, _ = context_parts(pdf)
        context = "\n\n".join(f"[{c}] {t}" for c, t in parts)
        return pd.DataFrame({"item_id": [pdf.item_id.iloc[0]], "prompt": [f"{context}\n\nQuestion: {pdf.q.iloc[0]}"], "extract": [best_sentence(pdf.q.iloc[0], parts)], "cites": [[c for c, _ in parts]], "contents": [[t for _, t in parts]]})

    made = hits.groupBy("item_id").applyInPandas(make, "item_id string, prompt string, extract string, cites array<string>, contents array<string>")
    return generate(made, generator, fallback=lambda _: F.col("extract")).select("item_id", F.col("generated").alias("answer"), "cites", "contents")


def verified(answers: DataFrame) -> DataFrame:
    """answers (answer, cites, contents) with confidence, level and verified: support by the evidence, citations,
    claims against the chunks that they cite, and neutral consistency, weighted; hedges and unknown citations cost."""
    cited, w = r"\[([^\[\]]+?)\]", WEIGHTS
    text = D.join("contents", "' '")
    a = answers.selectExpr("*", f"{D.distinct(D.map(D.all('answer', cited, 1), 'c', 'trim(c)'))} as used", f"{D.slice(D.filter(D.sentences('answer'), 's', 'length(s) > 12'), '1', '8')} as said", f"{D.terms('answer')} as a_t", f"{D.terms(text)} as c_t", f"{D.filter(D.sentences('answer'), 's', 'length(s) > 10 and ' + D.matches('s', BRACKETS))} as evidence")
    premise = "try_element_at(contents, nullif(cast(array_position(cites, trim(c)) as int), 0))"
    claim = D.sub("s", BRACKETS, "''")
    score = f"coalesce(array_max(transform({D.all('s', cited, 1)}, c -> {overlap(D, D.terms(claim), f'coalesce({D.terms(premise)}, array())', '1.3e0')})), 0e0)"
    a = a.selectExpr("*", f"{D.size('used')} as n_used", f"{D.size(D.both('used', 'cites'))} as n_valid", f"{D.size('said')} as n_said", f"{D.size(D.filter('said', 's', D.matches('s', BRACKETS)))} as n_cited", f"case when size(a_t) = 0 then 0.5e0 else {overlap(D, 'a_t', 'c_t', '1.2e0')} end as support", f"aggregate(transform(evidence, s -> case when {score} >= {SUPPORTED} then 1e0 else 0e0 end), 0e0, (x, y) -> x + y) as n_supported")
    claims = "case when size(evidence) = 0 then 0.5e0 else n_supported / size(evidence) end"
    confidence = f"greatest(0e0, least(1e0, {w[0]}e0 * support + {w[1]}e0 * ({CITATION}) + {w[2]}e0 * {claims} + {w[3]}e0 * 0.5e0 - cast({hedging(D, 'answer')} as double) - 0.1e0 * (n_used - n_valid)))"
    a = a.selectExpr("*", f"{D.any_of('lower(answer)', ABSTAIN)} as abstains", f"round({confidence}, 6) as sure")
    return a.selectExpr(*answers.columns, "case when abstains then 0.95e0 else sure end as confidence", f"case when abstains then 'HIGH' else {level('sure')} end as level", f"abstains or sure >= {ACCEPTED} as verified", f"not abstains and sure > {HOPELESS} and sure < {ACCEPTED} as retry")


def ask(questions: DataFrame, chunks: DataFrame, index: Index | None = None, embedder: Embedder | None = None, scorer: PairScorer | None = None, generator: Generator | None = None, cache: DataFrame | None = None, attempts: int = 2) -> DataFrame:
    """(query_id, query, intent, strategy, attempt, answer, cites, confidence, level, verified, from_cache, note).

    questions (query_id, query); chunks (doc_id, text, source), doc_id a whole number. cache holds earlier rows
    of this kind with cache_key; questions that fold to a cached key are answered from it. A question without
    hits gets no confident answer, with confidence 0. One row for each row of questions; an id must not repeat.
    """
    key = f"'query:' || md5({folded(D, 'query')})"
    given = questions.selectExpr("cast(query_id as string) as query_id", f"{D.join(D.slice(D.words('query'), '1', '512'), chr(39) + ' ' + chr(39))} as query").selectExpr("*", f"{key} as cache_key")
    given = stored(given)
    done = given.sparkSession.createDataFrame([], ANSWER)
    open_ = given
    if cache is not None:
        kept = cache.select("cache_key", "intent", "strategy", "attempt", "answer", "cites", "confidence", "level", "verified", "note")
        kept = kept.withColumn("k", F.row_number().over(Window.partitionBy("cache_key").orderBy(F.desc("confidence"), "answer"))).where("k = 1").drop("k")
        done = given.join(kept, "cache_key").withColumn("from_cache", F.lit(True)).select(*done.columns)
        open_ = stored(given.join(kept, "cache_key", "left_anti"))
    index = index or build_index(chunks)
    vectors = stored(embed(chunks.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), embedder).select("doc_id", "embedding"))
    tried, attempt = None, 1
    while attempt <= attempts and not open_.isEmpty():
        plans = stored(plan(open_.select(F.col("query_id").alias("item_id"), F.col("query").alias("q"))))
        fused = retrieve(plans, chunks, index, vectors, embedder, attempt)
        hits = best(fused, 100 * attempt, key="item_id").join(plans.select("item_id", "q", "rerank_k"), "item_id").join(chunks.selectExpr("cast(doc_id as bigint) as doc_id", "coalesce(source, 'unknown') as source", "coalesce(text, '') as content"), "doc_id")
        ranked = rerank(hits.drop("rk").withColumn("query_id", F.col("item_id")), scorer, 100 * attempt, query_col="q").where(F.col("rank") <= F.col("rerank_k"))
        found = answered(ranked.select("item_id", "q", "doc_id", F.col("rerank_score").alias("score"), "source", "content"), generator)
        now = verified(found).join(plans.select("item_id", "intent", "strategy"), "item_id").withColumn("attempt", F.lit(attempt))
        now = stored(now.select(F.col("item_id").alias("query_id"), "intent", "strategy", "attempt", "answer", "cites", "confidence", "level", "verified", "retry"))
        tried = now if tried is None else tried.unionByName(now)
        open_ = open_.join(now.where("retry"), "query_id", "left_semi")
        attempt += 1
    if tried is None:
        return done
    kept = tried.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("verified"), F.desc("confidence"), "attempt"))).where("k = 1").drop("k", "retry")
    rest = given.join(done.select("query_id"), "query_id", "left_anti").join(kept, "query_id", "left").withColumn("from_cache", F.lit(False))
    rest = rest.withColumn("note", F.when(F.col("answer").isNull(), F.lit("Max attempts reached without confident response")).when(~F.col("verified"), F.lit(NOTE))).fillna({"answer": NO_ANSWER, "confidence": 0.0, "level": "LOW", "verified": False, "attempt": 0})
    return done.unionByName(rest.withColumn("cites", F.coalesce("cites", F.array().cast("array<string>"))).select(*done.columns))


def cache_rows(answers: DataFrame) -> DataFrame:
    """answers as rows of a cache: their key, and how many seconds they hold, longer the surer they are."""
    sure = F.when(F.col("verified"), F.col("confidence")).otherwise(0.3)
    return answers.withColumn("cache_key", F.expr(f"'query:' || md5({folded(D, 'query')})")).withColumn("ttl", F.when(sure > 0.8, 7 * DAY).when(sure > 0.5, DAY).otherwise(HOUR))


@builder("ASK_questions")
def _ask(spark, get) -> DataFrame:
    """The benchmark's passages as questions to all documents."""
    questions = get("benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("Explain: "), F.col("text"), F.lit("?")).alias("query"))
    return ask(questions, get("documents")).withColumn("cites", F.array_join("cites", ","))
