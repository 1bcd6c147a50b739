"""Tables that templates name as prepared_*: made once from the tables at hand, then only read.

They hold for the files that they were made from, by their sizes and times; tables that are no files are
prepared anew each time.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import beside
from .quantiles import percentiles
from .search import Index, best, build_index, nearest_vectors, verbatim
from .store import stamp, stored

Get = Callable[[str], DataFrame]

#: Neighbours that are kept of a query.
NEIGHBOURS = 24
#: Tables that are kept at a time; the one that was asked for longest ago goes first.
MOST_KEPT = 64
_KEPT: dict[tuple, object] = {}
_LOCK = threading.RLock()


def _once(name: str, get: Get, tables: tuple[str, ...], make: Callable[[], object]) -> object:
    stamps = [stamp(get(t)) for t in tables]
    if None in stamps:
        return make()
    key = (name, *stamps)
    with _LOCK:  # two threads do not make one table twice
        _KEPT[key] = _KEPT.pop(key) if key in _KEPT else make()
        while len(_KEPT) > MOST_KEPT:
            del _KEPT[next(iter(_KEPT))]
        return _KEPT[key]


def release() -> None:
    """Forget what is kept; its checkpoint files go when nothing uses them any more."""
    with _LOCK:
        _KEPT.clear()


def index(get: Get) -> Index:
    return _once("index", get, ("documents",), lambda: build_index(get("documents")))


def _bm(get: Get) -> DataFrame:
    """Every score: only for those who want all of them, and not kept."""
    return index(get).score(get("benchmark"))


def _top(get: Get, k: int, presence: int | None = None) -> DataFrame:
    """The k best by BM25; with presence the second list: idf of the query's long terms that stand in the text."""
    return _once(f"top{k}-{presence}", get, ("documents", "benchmark"), lambda: stored(index(get).top(get("benchmark"), k, presence=presence)))


def _gold(get: Get, n: int | None) -> DataFrame:
    def make() -> DataFrame:
        needle = F.col("text") if n is None else F.substring("text", 1, n)
        return stored(verbatim(get("documents"), get("benchmark").select(F.col("item_id").alias("query_id"), needle.alias("needle"))))

    return _once(f"gold{n}", get, ("documents", "benchmark"), make)


def _asked(get: Get) -> DataFrame:
    return get("embeddings").where("vec_id % 20 = 0")


def _nn(get: Get) -> DataFrame:
    return _once("nn", get, ("embeddings",), lambda: stored(nearest_vectors(get("embeddings"), _asked(get), NEIGHBOURS)))


def _halves(get: Get) -> DataFrame:
    return _once("halves", get, ("embeddings",), lambda: stored(nearest_vectors(get("embeddings"), _asked(get), 12, ((0, 32), (32, 64)))))


def _latencies(get: Get) -> DataFrame:
    """(click_p95, all_p95) of the events, one row."""
    events = get("events").select(F.col("value"), F.when(F.col("event_type") == "click", F.col("value")).alias("click"))
    one = lambda c: percentiles(events, [], F.col(c), {f"{c}_p95": 0.95})
    return one("click").crossJoin(F.broadcast(one("value").withColumnRenamed("value_p95", "all_p95")))


PREPARED: dict[str, Callable[[Get], DataFrame]] = {
    "prepared_lexicon": lambda get: index(get).lexicon,
    "prepared_stats": lambda get: index(get).stats,
    "prepared_postings": lambda get: index(get).postings,
    "prepared_bm": _bm,
    "prepared_top_10": lambda get: _top(get, 10),
    "prepared_top_50": lambda get: _top(get, 50),
    "prepared_long_10": lambda get: _top(get, 10, presence=3),
    "prepared_gold": lambda get: _gold(get, None),
    "prepared_gold_40": lambda get: _gold(get, 40),
    "prepared_nn": _nn,
    "prepared_halves": _halves,
    "prepared_latencies": _latencies,
    "prepared_beside": lambda get: _once("beside", get, ("documents",), lambda: stored(beside(get("documents").select("source", "doc_id"), ["source"], [F.asc("doc_id")], "doc_id"))),
}


def prepare(spark: SparkSession, name: str, get: Get) -> DataFrame:
    return PREPARED[name](get)


__all__ = ["PREPARED", "best", "index", "prepare"]
