"""Every operator by name: its query over the tables, and its oracle SQL.

An operator is either a template, a function of a dialect that returns one SELECT over named tables, or
a function of (spark, tables) that returns a DataFrame. Both run over any tables of the expected
columns by apply(), and over a folder of Parquet tables by queries().
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from . import ship
from .plans.dialect import DUCK, SPARK, Dialect
from .plans.prepared import PREPARED, prepare

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Modules that register operators when they are imported.
MODULES = ("operators.text", "operators.retrieval", "operators.joins", "operators.aggregates", "operators.ranking", "operators.planning", "operators.answers", "operators.evaluation", "operators.caching", "operators.chunking", "operators.greedy", "operators.anchored", "operators.semantic", "operators.lines", "operators.ask", "sources.readers", "streaming.twins")

Template = Callable[[Dialect], str]
Builder = Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]

_TEMPLATES: dict[str, Template] = {}
_BUILDERS: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}


def template(name: str) -> Callable[[Template], Template]:
    """Register a template, which is its own oracle in the other dialect."""

    def add(f: Template) -> Template:
        _TEMPLATES[name] = f
        return f

    return add


def builder(name: str, oracle: str | Template | None = None) -> Callable[[Builder], Builder]:
    """Register a DataFrame builder, with an oracle where SQL can express it."""

    def add(f: Builder) -> Builder:
        _BUILDERS[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle(DUCK) if callable(oracle) else oracle
        return f

    return add


def _load() -> None:
    for module in MODULES:
        import_module(f"{__package__}.{module}")


def names() -> list[str]:
    _load()
    return [*_TEMPLATES, *_BUILDERS]


def apply(name: str, spark: SparkSession, tables: Callable[[str], DataFrame] | dict[str, DataFrame]) -> DataFrame:
    """Run an operator over tables, given by name or by a function of the name."""
    _load()
    get = tables.__getitem__ if isinstance(tables, dict) else tables
    if name in _BUILDERS:
        ship(spark)
        return _BUILDERS[name](spark, get)
    return run_sql(spark, _TEMPLATES[name](SPARK), get)


_NAMED = re.compile(rf"\b(from|join)(\s+)({'|'.join((*TABLES, *PREPARED))})\b(?!\s*\.)")
_NUMBERS = itertools.count()


def run_sql(spark: SparkSession, sql: str, get: Callable[[str], DataFrame]) -> DataFrame:
    """Spark SQL over the tables that it names after from or join.

    They are bound to views of their own names, which are gone when the plan is made: the caller's views
    stay as they are.
    """
    views: dict[str, str] = {}

    def bound(m: re.Match) -> str:
        t = m.group(3)
        if t not in views:
            views[t] = f"_{t}_{next(_NUMBERS)}"
            (prepare(spark, t, get) if t in PREPARED else get(t)).createTempView(views[t])
        return f"{m.group(1)}{m.group(2)}{views[t]}" + (f" as {t}" if aliased(m) else "")

    def aliased(m: re.Match) -> bool:
        """Whether the table goes by its own name: no other follows."""
        return not re.match(r"\s+(?!(?:where|join|cross|left|full|inner|on|using|group|order|limit|lateral|union|having)\b)\w", sql[m.end() :])

    bound_sql = _NAMED.sub(bound, sql)
    try:
        return spark.sql(bound_sql)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def reader(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval evaluation: BM25 and gram retrieval, fused by reciprocal ranks, against the gold."""
    return apply("EVL06_retriever_comparison", spark, reader(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: lambda spark, sf_dir, n=n: apply(n, spark, reader(spark, sf_dir)) for n in names()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: t(DUCK) for n, t in _TEMPLATES.items()} | dict(_ORACLES)
