"""Windows of tokens that keep their place in the source, without a search for it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import builder, run_sql
from ..functions.tables import register
from .chunking import OVERLAP, SIZE
from .greedy import STRICT

# fixed value: a last sentence of fewer words is cut off
LEAST_WORDS = 6
_TOKEN = re.compile(r"\S+")


def anchored_windows(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST_WORDS) -> Iterator[tuple[int, int, int, int]]:
    """(first token, tokens, char_start, char_end) of each window; text[char_start:char_end] is the chunk.

    Tokens carry their place, so a window that loses its last sentence (one of several, with fewer than `least`
    words) still knows where it ends. Characters between sentences stay as they are. A text without tokens has no
    window, and a window that would only repeat the end of the one before is left out.
    """
    spans, step = [m.span() for m in _TOKEN.finditer(text)], max(1, size - overlap)
    for first in range(0, len(spans), step):
        if first and first - step + size >= len(spans):
            return
        last = min(first + size, len(spans))
        start, end, breaks = spans[first][0], spans[last - 1][1], None
        for breaks in STRICT.finditer(text, start, end):  # noqa: B007
            pass
        n = last - first
        if breaks is not None and (words := len(_TOKEN.findall(text, breaks.end(), end))) < least:
            end, n = breaks.start(), n - words
        yield first, n, start, end


def windows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_start, tokens, char_start, char_end, chunk) of all windows; null and empty texts have none.

    Offsets count code points. One pass without a shuffle; a task holds a batch of texts, and gives out the windows of
    one text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(key, *w, text[w[2] : w[3]]) for w in anchored_windows(text or "", size, overlap, least)]
                if rows:
                    yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names, kinds = [id_col, "token_start", "tokens", "char_start", "char_end", "chunk"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} bigint, token_start bigint, tokens int, char_start bigint, char_end bigint, chunk string")


@builder("CHK06_chunk_function")
def _by_function(spark, get) -> DataFrame:
    """The packing of sentences as a lateral call in SQL."""
    register(spark)
    return run_sql(spark, "select d.doc_id, c.place, c.chunk, c.tokens from documents d, lateral chunks(d.text, 'sentences') c", get)


@builder("CHK03_anchored_windows")
def _anchored(spark, get) -> DataFrame:
    return windows(get("documents"))
