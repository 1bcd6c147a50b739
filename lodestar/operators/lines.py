"""Lines that are alike: a similarity join by matching blocks, and headers and footers told by it.

Two lines are alike if their first HEAD characters have over ALIKE of their characters in matching blocks. Then few
characters are left over, so of one more pieces of the shorter line than that, one piece stands in the other line as
it is, not far from its place. Lines meet by such pieces; only what meets is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import builder
from ..plans.dialect import SPARK as D
from ..plans.store import stored
from .chunking import host_pages, without_headers

# fixed values: the characters that are compared, and the ratio that alike lines exceed
HEAD, ALIKE = 60, 0.95


def alike(a: str, b: str) -> bool:
    m = SequenceMatcher(None, a[:HEAD], b[:HEAD])
    return m.real_quick_ratio() > ALIKE and m.quick_ratio() > ALIKE and m.ratio() > ALIKE  # bounds first


@cache
def left_over(a: int, b: int) -> int:
    """The most characters of lines of these lengths outside matching blocks; -1 if they cannot be alike."""
    total = a + b
    return max((d for d in range(abs(a - b), total + 1, 2) if (total - d) / total > ALIKE), default=-1) if total else 0


@cache
def pieces(a: int) -> tuple[tuple[int, int], ...]:
    """(begin, end) of one piece more than the characters that a line of length a or longer may leave over: of equal
    widths, so that they begin alike in lines of like lengths; the last has the rest."""
    n = 1 + max(left_over(a, b) for b in range(a, max(a, HEAD) + 1))
    return tuple((a // n * i, a // n * (i + 1) if i + 1 < n else a) for i in range(n)) if 1 < n <= a else ()


def measure(a: int) -> tuple[int, int]:
    """The number of pieces and their width, the last one's cut to it."""
    return len(pieces(a)), pieces(a)[0][1] if pieces(a) else 0


@cache
def places(b: int) -> tuple[tuple[int, int, int, int], ...]:
    """(number, width, piece, place) of what a line of length b looks for as the longer one of two.

    Take the first piece up to whose end there are at most as many left over characters as pieces before it. It has
    none itself, and exactly as many stand before it: so it is shifted by their number, or by less in steps of two,
    and the characters after it must make up for the rest of the difference in length.
    """
    found = set()
    for a in range(1, b + 1):
        d, (n, width) = left_over(a, b), measure(a)
        if d < b - a:
            continue
        for i in range(min(n, d + 1)):
            found |= {(n, width, i, i * width + shift) for shift in range(-i, i + 1, 2) if abs(b - a - shift) <= d - i and 0 <= i * width + shift <= b - width}
    return tuple(sorted(found))


def keys_of(line: str) -> Iterator[tuple[str, bool]]:
    """What a line is found by as the shorter one of two (True), and what it looks for as the longer one."""
    n, width = measure(len(line))
    for i in range(n):
        yield f"{n} {width} {i} {line[i * width : (i + 1) * width]}", True
    for n, width, i, at in places(len(line)):
        yield f"{n} {width} {i} {line[at : at + width]}", False


def sketch(line: str) -> int:
    """64 parities of the line's pairs of neighbours: a character that is put in or taken out changes three at most."""
    out = 0
    for two in zip(line, line[1:], strict=False):
        out ^= 1 << (ord(two[0]) * 0x9E3779B1 + ord(two[1]) * 0x85EBCA77 >> 9 & 63)
    return out - (1 << 64) if out >> 63 else out


def alike_lines(lines: DataFrame, within: list[str], line_col: str = "line") -> DataFrame:
    """(within, head, n, n_links, n_alike): each distinct head of lines, HEAD characters, of a group.

    n: lines with this head; n_links: other heads that are alike to it; n_alike: lines that are alike to it, its own among
    them. Null lines are left out, an empty line is a head. A head that very many lines share is one row from the
    start; heads meet within their group only.
    """
    heads = lines.where(F.col(line_col).isNotNull()).groupBy(*within, F.substring(line_col, 1, HEAD).alias("head")).agg(F.count(F.lit(1)).alias("n"))
    heads = stored(heads.withColumn("id", F.monotonically_increasing_id()))  # kept as they are stored
    group = F.xxhash64(*within) if within else F.lit(0).cast("bigint")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, g, mark, k, short) for i, g, h in zip(*(c.to_pylist() for c in batch.columns), strict=True) for mark in (sketch(h),) for k, short in keys_of(h)]
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["id", "group", "sketch", "key", "short"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # matching blocks depend on the order of the two
            rows = [x for i, j, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in ((i, j, a, b), (j, i, b, a)) if alike(x[2], x[3])]
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["id", "other"])

    entries = heads.select("id", group.alias("group"), "head").mapInArrow(keyed, "id bigint, group bigint, sketch bigint, key string, short boolean")
    entries = entries.select(F.xxhash64("group", "key").alias("key"), "id", "sketch", "short")
    short = entries.where("short").select("key", F.col("id").alias("a"), F.col("sketch").alias("a_sketch"))
    long = entries.where("not short").select("key", F.col("id").alias("b"), F.col("sketch").alias("b_sketch"))
    most = 3 * max(left_over(a, HEAD) for a in range(1, HEAD + 1))
    met = short.join(long, "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a_sketch").bitwiseXOR(F.col("b_sketch"))) <= most))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own = lambda x: heads.select(F.col("id").alias(x), group.alias(f"{x}_group"), F.col("head").alias(f"{x}_head"))
    near = met.join(own("a"), "a").join(own("b"), "b").where((F.col("a_group") == F.col("b_group")) & (F.levenshtein("a_head", "b_head", HEAD // 10) >= 0))
    pairs = near.select("a", "b", "a_head", "b_head").mapInArrow(compared, "id bigint, other bigint").distinct()
    linked = pairs.join(heads.select(F.col("id").alias("other"), F.col("n").alias("other_n")), "other").groupBy("id").agg(F.count(F.lit(1)).alias("n_links"), F.sum("other_n").alias("more"))
    return heads.join(linked, "id", "left").select(*within, "head", "n", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_alike"))


def strip_alike_headers(pages: DataFrame) -> DataFrame:
    """(file, page, header, footer, text) of pages (file, page, text), as without_headers(), with lines that are alike
    counted together: the first, or last, line that most pages of a file have alike, if half of them do."""
    spark = pages.sparkSession
    own = pages.selectExpr("file", "page", f"{D.split(D.strip('text'), chr(92) + 'n')} as own")
    ends = own.selectExpr("file", f"stack(2, 'h', {D.strip(D.at('own', '1'))}, 'f', {D.strip(D.at('own', D.size('own')))}) as (kind, line)").where("line <> ''")
    counted = ends.groupBy("file", "kind", "line").agg(F.count(F.lit(1)).alias("own"), F.substring(F.first("line"), 1, HEAD).alias("head"))
    like = alike_lines(ends, ["file", "kind"])
    like = like.select(*(F.col(c).alias(f"_{c}") for c in ("file", "kind", "head")), F.col("n_alike").alias("n"))
    both = counted.join(like, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("file", "kind", "head")]).select("file", "kind", "line", "own", "n")
    names = f"_pages_{id(pages)}", f"_lines_{id(pages)}"
    for name, df in zip(names, (pages, both), strict=True):
        df.createTempView(name)
    try:
        return spark.sql(f"select file, page, header, footer, text from {without_headers(D, names[0], names[1])} w")
    finally:
        for name in names:
            spark.catalog.dropTempView(name)


@builder("CHK12_alike_headers")
def _headers(spark, get) -> DataFrame:
    """Pages of a host as CHK12_headers, with lines that are alike counted together."""
    name = f"_web_{id(get)}"
    get("pages").createTempView(name)
    try:
        pages = spark.sql(host_pages(D, name))
    finally:
        spark.catalog.dropTempView(name)
    return strip_alike_headers(pages).select("file", "page", "header", "footer", F.md5("text").alias("text"))


@builder("JOI08_alike_lines")
def _lines(spark, get) -> DataFrame:
    """Every distinct line of all documents, by its head, with how many others are alike."""
    lines = get("documents").select(F.explode(F.split("text", r"\n")).alias("line")).select(F.trim("line").alias("line")).where("line <> ''")
    return alike_lines(lines, [])
