"""Substring dedup by compaction of a de Bruijn graph of words.

An edge is a run of `length` words, from the node of its first length - 1 words to that of its last.
Edges are dealt out by their minimiser, so equal edges meet in one task, and an edge that stands more
than once is known by its earliest place. Edges whose places go on alike are one run: a document's
runs are joined to their sources' blocks by coordinates, compared word by word, and removed.
repeated_paths compacts the same runs to the graph's paths without branches, by joins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, salted_join, table
from .windows import NO_ID, Opened, Runs, Windows, blocks, occurrences, repeated_windows

WORD = 8  # bytes of a word's hash


def compact(classes: list[tuple[tuple[int, int], int, bytes]], length: int) -> list[list[tuple[int, int, int, int]]]:
    """For each class its runs of edges (first, last, other class, place there) that a class of smaller order has.

    Classes are (order, anchor's place, word hashes). A run goes on while the earliest class that has the
    next edge is the same and has it at the next place; the paths of the graph are made of such runs.
    """
    size = length * WORD
    source: dict[bytes, tuple[int, int]] = {}  # edge: its earliest class, and its place there
    for c in sorted(range(len(classes)), key=lambda i: classes[i][0]):
        words = classes[c][2]
        for place, k in enumerate(range(0, len(words) - size + 1, WORD)):
            source.setdefault(words[k : k + size], (c, place))
    out = []
    for order, _, words in classes:
        runs: list[tuple[int, int, int, int]] = []
        before = None
        for place, k in enumerate(range(0, len(words) - size + 1, WORD)):
            c, there = source[words[k : k + size]]
            if classes[c][0] >= order:
                before = None
                continue
            if before == (c, there - 1):
                first, _, _, start = runs[-1]
                runs[-1] = (first, place, c, start)
            else:
                runs.append((place, place, c, there))
            before = (c, there)
        out.append(runs)
    return out


class _Finish:
    """Removes the words and reports on each document."""

    SCHEMA = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<array<bigint>>, kept string"

    def __init__(self, full: bool) -> None:
        self.full = full
        self.schema = self.SCHEMA if full else self.SCHEMA.partition(", spans")[0]
        self.empty = self._table([], [], [], [], [], [])

    def _table(self, ids, n, removed, sha, spans, kept) -> pa.Table:
        out = {"id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if self.full:
            out |= {"spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "kept": pa.array(kept, pa.string())}
        return pa.table(out)

    def __call__(self, b: Opened, gone: np.ndarray, _: Runs) -> pa.Table:
        offsets, words, data = b.offsets, b.spans, b.block.data
        starts, ends = words[0][~gone], words[1][~gone]
        # the kept words again, each followed by one space
        lengths = ends - starts
        at = np.cumsum(lengths + 1) - lengths - 1
        flat = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
        cover = np.zeros(len(data) + 1, np.int8)
        cover[starts] += 1
        np.add.at(cover, ends, -1)
        flat[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(starts)), lengths)] = data[np.cumsum(cover[:-1], dtype=np.int8).astype(bool)]
        text = flat.tobytes()
        removed_before = np.concatenate([[0], np.cumsum(gone)])
        first = (offsets - removed_before[offsets]).tolist()
        at = [*at.tolist(), len(text)]
        sha, spans, kept = [], [], []
        for lo, hi in zip(first, first[1:], strict=False):
            left = text[at[lo] : at[hi] - 1] if hi > lo else b""
            sha.append(hashlib.sha256(left).hexdigest())
            if self.full:
                kept.append(left.decode())
        if self.full:
            spans = [np.flatnonzero(np.diff(gone[lo:hi], prepend=False, append=False)).reshape(-1, 2).tolist() for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
        removed = removed_before[offsets[1:]] - removed_before[offsets[:-1]]
        return self._table([None if i == NO_ID else i for i in b.block.ids.tolist()], np.diff(offsets), removed, sha, spans, kept)


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, full: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, spans, kept]) for each row of docs.

    Words are runs of anything but ASCII white space, unchanged; a null text has none. A word goes if
    a run of `length` words over it also starts earlier: in a smaller id, or earlier in the same one.
    spans are the removed (first, end) words; kept is the rest, joined by single spaces. Rows of one
    id are the same document twice: what they hold at equal places is one occurrence. Rows without an
    id come last and count as one document. Other columns do not matter.
    """
    finish = _Finish(full)
    spec = Windows(length, max(2, length // 3), words=True)
    return repeated_windows(blocks(docs, id_col, text_col), spec, lambda c: compact(c, length), finish, finish.schema).withColumnRenamed("id", id_col)


def repeated_paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20) -> DataFrame:
    """(path, place, doc, start, n_words): the compacted paths of the graph of repeated edges, by their sources.

    An edge is a run of `length` words that stands more than once; it is known by its earliest place. A
    node is the run of length - 1 words between two edges. A path is a longest chain of edges whose inner
    nodes have one way in and one way out; it consists of stretches of source documents, one after the
    other, each of n_words words from word `start` of document `doc`. Paths are numbered by nothing in
    particular. Edges come verified; stretches are cut where a document enters or leaves, and chained
    across documents by joins that double the distance each round. A ring begins at some stretch.
    Null ids are null here too, and null and empty texts have no edges.
    """
    spec = Windows(length, max(2, length // 3), words=True)
    runs = cut(occurrences(docs, id_col, text_col, spec, lambda c: compact(c, length)))
    at = F.struct
    edges = F.col("length") - length  # edges of a run, less one
    # ways from edge to edge that are not simply the next place of the same source; an edge beside a run that is in
    # none stands first where it is
    turn = Window.partitionBy("block", "row").orderBy("start")  # the runs of one document
    there, end = at(F.col("sblock").alias("block"), F.col("srow").alias("row"), F.col("splace").alias("place")), F.col("start") + edges
    beside = lambda place: at("block", "row", place.alias("place"))
    far = at(F.col("sblock").alias("block"), F.col("srow").alias("row"), (F.col("splace") + edges).alias("place"))
    around = runs.select("block", "row", there.alias("first"), far.alias("last"), F.col("start"), end.alias("end"))
    around = around.withColumn("prior", F.lag("last").over(turn)).withColumn("prior_end", F.lag("end").over(turn)).withColumn("later_start", F.lead("start").over(turn))
    into = around.where("start > 0").select(F.when(F.col("prior_end") + 1 == F.col("start"), F.col("prior")).otherwise(beside(F.col("start") - 1)).alias("a"), F.col("first").alias("b"))
    out_of = around.where("later_start is null or later_start > end + 1").select(F.col("last").alias("a"), beside(F.col("end") + 1).alias("b"))
    links = into.unionByName(out_of).distinct()
    links = cut(links.where(~((F.col("a.block") == F.col("b.block")) & (F.col("a.row") == F.col("b.row")) & (F.col("a.place") + 1 == F.col("b.place")))))
    # steps of the number of runs over each place of a document; a link counts if both its ends are covered
    document = Window.partitionBy("block", "row").orderBy("place")  # the marks of one document
    source = [F.col("sblock").alias("block"), F.col("srow").alias("row")]
    steps = runs.select(*source, F.col("splace").alias("place"), F.lit(1).alias("step")).unionByName(runs.select(*source, (F.col("splace") + edges + 1).alias("place"), F.lit(-1).alias("step")))

    def swept(marks: DataFrame) -> DataFrame:
        """marks (block, row, place, step, cut), one a place, with the depth from the place on, and before it."""
        one = marks.groupBy("block", "row", "place").agg(F.sum("step").alias("step"), F.max("cut").alias("cut"))
        deep = one.withColumn("depth", F.sum("step").over(document))
        return deep.withColumn("end", F.lead("place").over(document) - 1).withColumn("before", F.lag("depth", 1, 0).over(document))

    ends = links.select("a.*").unionByName(links.select("b.*"))
    covered = cut(swept(steps.withColumn("cut", F.lit(0)).unionByName(ends.select("*", F.lit(0).alias("step"), F.lit(1).alias("cut")))).where("cut = 1 and depth > 0").select(at("block", "row", "place").alias("end_")))
    links = cut(links.join(covered, F.col("a") == F.col("end_"), "left_semi").join(covered, F.col("b") == F.col("end_"), "left_semi"))
    cuts = links.select("a.block", "a.row", (F.col("a.place") + 1).alias("place")).unionByName(links.select("b.*"))
    # stretches: places that some run covers, cut at the links
    parts = swept(steps.withColumn("cut", F.lit(0)).unionByName(cuts.select("*", F.lit(0).alias("step"), F.lit(1).alias("cut"))))
    parts = parts.withColumn("n", F.sum(F.when((F.col("cut") == 1) | (F.col("before") == 0), 1).otherwise(0)).over(document)).where("depth > 0")
    pieces = cut(parts.groupBy("block", "row", "n").agg(F.min("place").alias("lo"), F.max("end").alias("hi")).select(F.xxhash64("block", "row", "lo").alias("id"), "block", "row", "lo", "hi"))
    head = pieces.select(at("block", "row", F.col("lo").alias("place")).alias("b"), F.col("id").alias("to"))
    tail = pieces.select(at("block", "row", F.col("hi").alias("place")).alias("a"), F.col("id").alias("from"))
    next_ = tail.select("from", F.struct(F.col("a.block").alias("block"), F.col("a.row").alias("row"), (F.col("a.place") + 1).alias("place")).alias("b")).join(head, "b").select("from", "to")
    ways = cut(links.join(tail, "a").join(head, "b").select("from", "to").unionByName(next_).distinct())
    # nodes with one way in and one way out
    single = lambda c: ways.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(c)
    chain = ways.join(single("from"), "from", "left_semi").join(single("to"), "to", "left_semi")
    ids = pieces.select("id")
    placed = _along(pieces.select("id"), chain)
    if not (rings := cut(placed.where("moves"))).isEmpty():  # a ring is cut before its smallest piece
        placed = _along(pieces.select("id"), chain.join(rings.select(F.col("least").alias("to")).distinct(), "to", "left_anti"))
    named = runs.select(*source, F.col("sdoc").alias("doc")).distinct()
    return placed.select("id", F.col("back").alias("path"), F.col("far").alias("place")).join(pieces, "id").join(named, ["block", "row"]).select("path", "place", "doc", F.col("lo").alias("start"), (F.col("hi") - F.col("lo") + length).alias("n_words"))


def _along(ids: DataFrame, chain: DataFrame) -> DataFrame:
    """(id, back, far, least, moves): each id's head by the chain (from, to), how far it is, and the smallest id on the way.

    Every id points back; each round it takes over where the id that it points to points, so distances
    double. After as many rounds as the number of ids has bits only those of rings move.
    """
    back = F.coalesce("from", "id")
    now = cut(ids.join(chain.select(F.col("to").alias("id"), "from"), "id", "left").select("id", back.alias("back"), F.col("from").isNotNull().cast("bigint").alias("far"), F.least("id", back).alias("least"), F.col("from").isNotNull().alias("moves")))
    n = now.count()
    for _ in range(n.bit_length() + 1):
        other = now.select(F.col("id").alias("back"), F.col("back").alias("further"), F.col("far").alias("more"), F.col("least").alias("low"))
        moved = salted_join(now.select("id", "back", "far", "least"), other, ["back"], rows=n)
        now = cut(moved.select("id", F.col("further").alias("back"), (F.col("far") + F.col("more")).alias("far"), F.least("least", "low").alias("least"), (F.col("further") != F.col("back")).alias("moves")))
        if now.where("moves").isEmpty():
            break
    return now


class _Replace(_Finish):
    """The rows of a block with the kept words as their text; texts of which nothing goes stay as they are."""

    def __init__(self, schema, names: list[str], id_col: str, text_col: str, size_col: str | None) -> None:
        super().__init__(full=True)
        self.schema, self.names, self.id_col, self.text_col, self.size_col = schema, names, id_col, text_col, size_col
        self.empty = to_arrow_schema(schema).empty_table()

    def __call__(self, opened: Opened, gone: np.ndarray, runs: Runs) -> pa.Table:
        report, b = super().__call__(opened, gone, runs), opened.block
        removed, kept = report.column("n_removed").to_pylist(), report.column("kept").to_pylist()
        bounds = b.offsets.tolist()
        texts = [k if r else None if n else b.data[x:y].tobytes().decode() for k, r, n, x, y in zip(kept, removed, b.null.tolist(), bounds, bounds[1:], strict=False)]
        columns = {self.id_col: report.column("id"), self.text_col: pa.array(texts, pa.string())}
        columns |= {n: b.more.column(k) for k, n in enumerate(self.names)} if b.more is not None else {}
        if self.size_col:
            old = columns[self.size_col].to_pylist()
            columns[self.size_col] = pa.array([len(t) if r else o for t, r, o in zip(texts, removed, old, strict=True)], pa.int64())
        want = self.empty.schema
        return pa.table([columns[f.name].cast(f.type) for f in want], schema=want)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", length: int = 20) -> DataFrame:
    """docs, all its rows and columns, with repeated words gone from the texts as remove_repeated_words says.

    A text of which nothing goes stays byte for byte; others are their kept words, joined by single
    spaces, and size_col (if any) gets their new number of characters.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    finish = _Replace(docs.withColumn(id_col, F.col(id_col).cast("bigint")).withColumn(text_col, F.col(text_col).cast("string")).schema, rest, id_col, text_col, size_col if size_col in rest else None)
    spec = Windows(length, max(2, length // 3), words=True)
    return repeated_windows(blocks(docs, id_col, text_col, tuple(rest)), spec, lambda c: compact(c, length), finish, finish.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents"), full=False)


#: The same rows by comparing everything with everything, in DuckDB.
ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, unnest(range(1, len(w) - 18)) as i, w from w),
win as (select doc_id, i, md5(array_to_string(w[i:i+19], ' ')) as h from p),
f as (select *, row_number() over (partition by h order by doc_id, i) as n from win),
rep as (select distinct doc_id, i + k as spot from f, range(0, 20) r(k) where n > 1),
g as (select doc_id, list(spot) as gone from rep group by doc_id),
k as (select w.doc_id, w, coalesce(gone, []) as gone from w left join g on g.doc_id = w.doc_id),
x as (select doc_id, len(w) as n_words, len(gone) as n_removed, case when len(gone) = 0 then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: not list_contains(gone, z[2])), lambda z: z[1]) end as kept from k)
select doc_id, cast(n_words as bigint) as n_words, cast(n_removed as bigint) as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from x
"""
