"""Chunkers as table functions of SQL.

register(spark) makes two of them known to a session:

    select d.doc_id, c.* from docs d, lateral chunks(d.text, 'sentences') c
    select * from table_chunks(table(docs), 'text', 'windows')

chunks gives (place, chunk, tokens) of a text; 'windows' also says where each chunk stands (char_start, char_end).
table_chunks takes any table and keeps its other columns. A null text has no chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, UserDefinedTableFunction

from .. import ship

PLAIN = StructType().add("place", "integer").add("chunk", "string").add("tokens", "integer")
PLACED = StructType([*PLAIN.fields]).add("char_start", "long").add("char_end", "long")


def _chunked(text: str | None, by: str) -> Iterator[tuple]:
    from ..operators import anchored, greedy

    if by == "windows":
        for place, (_, n, start, end) in enumerate(anchored.anchored_windows(text or "")):
            yield place, text[start:end], n, start, end
        return
    chunker = {"sentences": greedy.pack_sentences, "paragraphs": greedy.pack_paragraphs, "size": greedy.split_by_size, "trimmed": greedy.trim_last}[by]
    for place, chunk in enumerate(chunker(text or "")):
        yield place, chunk, len(chunk.split())


def _columns(by: AnalyzeArgument) -> StructType:
    if not by.isConstantExpression or by.value not in ("sentences", "paragraphs", "size", "trimmed", "windows"):
        raise ValueError("chunks are by 'sentences', 'paragraphs', 'size', 'trimmed' or 'windows'")
    return PLACED if by.value == "windows" else PLAIN


class Chunks:
    @staticmethod
    def analyze(text: AnalyzeArgument, by: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=_columns(by))

    def eval(self, text: str, by: str) -> Iterator[tuple]:
        yield from _chunked(text, by)


class TableChunks:
    @staticmethod
    def analyze(row: AnalyzeArgument, text: AnalyzeArgument, by: AnalyzeArgument) -> AnalyzeResult:
        if not row.isTable or text.value not in row.dataType.names:
            raise ValueError("the first argument is a table, the second the name of its column of texts")
        made = _columns(by)
        clash = set(made.names) & set(row.dataType.names)
        if clash:
            raise ValueError(f"the table has columns of the names of the chunks': {', '.join(sorted(clash))}")
        return AnalyzeResult(schema=StructType([f for f in row.dataType.fields if f.name != text.value] + made.fields))

    def eval(self, row, text: str, by: str) -> Iterator[tuple]:
        given = row.asDict(recursive=False)
        rest = tuple(v for c, v in given.items() if c != text)
        for made in _chunked(given[text], by):
            yield (*rest, *made)


def register(spark: SparkSession) -> dict[str, UserDefinedTableFunction]:
    """Make chunks and table_chunks known to a session and its executors."""
    ship(spark)
    made = {"chunks": udtf(Chunks), "table_chunks": udtf(TableChunks)}
    for name, function in made.items():
        spark.udtf.register(name, function)
    return made
