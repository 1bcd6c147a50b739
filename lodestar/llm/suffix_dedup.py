"""Suffix-array dedup: maximal repeats from the common-prefix interval tree.

The strings that share an anchor are put in suffix order from the anchor on; a stack scan over their
longest common prefixes yields the intervals of the enhanced suffix array. Each interval's left
contexts are put in order too, and a second scan tests how far to the left which of them agree: an
interval of both is a maximal repeat with all of its occurrences.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, salted_join, table
from .windows import NO_ID, Opened, Runs, Windows, blocks, occurrences, repeated_windows


def stack_scan(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(prefix, first, end) of every interval of an ordered list whose neighbours share common[i] symbols.

    common[i] belongs to entries i - 1 and i; common[0] is not used. Only intervals of `least` and more.
    """
    stack: list[list[int]] = []  # [prefix, first entry]
    for i in range(1, len(common) + 1):
        shared = common[i] if i < len(common) else -1
        first = i - 1
        while stack and stack[-1][0] > shared:
            prefix, first = stack.pop()
            if prefix >= least:
                yield prefix, first, i
        if shared >= 0 and (not stack or stack[-1][0] < shared):
            stack.append([shared, first])


def _ordered(texts: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the texts and the common prefixes of neighbours in it."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    return order, [0, *(_common(texts[a], texts[b]) for a, b in zip(order, order[1:], strict=False))]


def intervals(texts: list[bytes], least: int) -> list[tuple[int, list[int]]]:
    """(common prefix, members) of every interval of texts' suffix order with a prefix of at least `least`.

    Equal texts lie side by side and meet with their whole length as the common prefix.
    """
    order, common = _ordered(texts)
    return [(prefix, order[first:end]) for prefix, first, end in stack_scan(common, least)]


def _common(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    return len(os.path.commonprefix((a, b)))


def maximal_repeats(strings: list[tuple[int, bytes]], length: int) -> list[tuple[int, int, list[int]]]:
    """(left, right, members): all members that agree on `left` symbols before their anchor and `right` from it on.

    strings are (anchor's place, content). An entry is maximal: its members differ (or end) at once to
    the right, and at once to the left. Every pair of strings that share at least `length` symbols around
    their anchors is in an entry with exactly the left and right extent which they share. Left contexts
    are put in order once; an interval's members are taken in that order, and the prefixes of neighbours
    are range minima, so an interval costs its size and no comparison of strings.
    """
    out = []
    most = max(at for at, _ in strings)
    order, common = _ordered([text[at:] for at, text in strings])
    by_left, left_common = _ordered([text[:at][::-1] for at, text in strings])
    rank = np.empty(len(strings), np.int64)
    rank[by_left] = np.arange(len(strings))
    minima = [np.asarray(left_common, np.int64)]  # of 1, 2, 4 ... neighbours
    while 2 ** len(minima) < len(strings):
        half = 2 ** (len(minima) - 1)
        minima.append(np.minimum(minima[-1][:-half], minima[-1][half:]))
    suffixes, shared = np.asarray(order, np.int64), np.asarray(common, np.int64)
    for right, first, end in stack_scan(common, max(1, length - most)):
        members = suffixes[first:end]
        child = np.concatenate([[0], np.cumsum(shared[first + 1 : end] == right)])  # those of one child go on alike
        place = np.argsort(rank[members])
        members, child = members[place], child[place]
        at = rank[members]
        level = np.frexp((at[1:] - at[:-1]).astype(float))[1] - 1
        lefts = [0, *(min(int(minima[k][i + 1]), int(minima[k][j - 2**k + 1])) for i, j, k in zip(at[:-1].tolist(), at[1:].tolist(), level.tolist(), strict=True))]
        for left, lo, hi in stack_scan(lefts, max(0, length - right)):
            if (child[lo:hi] != child[lo]).any():  # else they agree on more to the right, and are an entry there
                out.append((left, right, members[lo:hi].tolist()))
    return out


def compare(classes: list[tuple[tuple[int, int], int, bytes]], length: int) -> list[list[tuple[int, int, int, int]]]:
    """For each class the windows (first, last place, other class, place there) that also stand in a class of smaller order."""
    spans: list[list[tuple[int, int, int, int]]] = [[] for _ in classes]
    for left, right, members in maximal_repeats([(at, text) for _, at, text in classes], length):
        earliest = min(members, key=lambda i: classes[i][0])
        for i in members:
            order, at, text = classes[i]
            if order > classes[earliest][0]:
                first, last = max(0, at - left), min(len(text) - length, at + right - length)
                if first <= last:
                    spans[i].append((first, last, earliest, classes[earliest][1] - at + first))
    return spans


class _Finish:
    """Removes the bytes and reports on each document."""

    SCHEMA = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>, sources array<array<bigint>>, kept binary"

    def __init__(self, full: bool, length: int) -> None:
        self.full, self.length = full, length
        self.schema = self.SCHEMA if full else self.SCHEMA.partition(", spans")[0]
        self.empty = self._table([], [], [], [], [], [], [], [])

    def _table(self, ids, n, removed, runs, sha, spans, sources, kept) -> pa.Table:
        out = {"id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if self.full:
            lists = pa.list_(pa.list_(pa.int64()))
            out |= {"spans": pa.array(spans, lists), "sources": pa.array(sources, lists), "kept": pa.array(kept, pa.binary())}
        return pa.table(out)

    def __call__(self, b: Opened, gone: np.ndarray, found: Runs) -> pa.Table:
        bounds, data = b.offsets.tolist(), b.block.data
        padded = np.concatenate([[0], np.cumsum(gone)])
        removed = padded[b.offsets[1:]] - padded[b.offsets[:-1]]
        sha, runs, spans, kept = [], [], [], []
        for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
            mask = gone[lo:hi]
            if removed[k]:
                edge = np.flatnonzero(np.diff(mask, prepend=False, append=False)).reshape(-1, 2)
                left = data[lo:hi][~mask].tobytes()
            else:
                edge, left = np.zeros((0, 2), np.int64), data[lo:hi].tobytes()
            runs.append(len(edge))
            sha.append(hashlib.sha256(left).hexdigest())
            if self.full:
                spans.append(edge.tolist())
                kept.append(left)
        return self._table([None if i == NO_ID else i for i in b.block.ids.tolist()], np.diff(b.offsets), removed, runs, sha, spans, by_row(b, found, self.length) if self.full else [], kept)


def by_row(b: Opened, runs: Runs, length: int) -> list[list[list[int]]]:
    """For each row of a block its verified runs as (first symbol, end, source's block, row there, place there)."""
    out: list[list[list[int]]] = [[] for _ in b.block.ids]
    own = np.searchsorted(b.offsets, runs[0], "right") - 1
    for row, first, last, *source in zip(own.tolist(), *(x.tolist() for x in runs), strict=True):
        out[row].append([first - int(b.offsets[row]), last - int(b.offsets[row]) + length, *source])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, full: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, spans, sources, kept]) for each row of docs.

    Texts are taken as UTF-8 bytes, null as empty; matches never cross documents. A byte goes if a
    string of `length` bytes over it also starts earlier: in a smaller id, or earlier in the same
    one, and the bytes themselves have been compared. Rows of one id are the same document twice: what
    they hold at equal places is one occurrence. Rows without an id come last and count as one document.
    Other columns do not matter. sources are the removed runs as (first byte, end, block, row, place) of
    their earliest source.
    """
    finish = _Finish(full, length)
    return repeated_windows(blocks(docs, id_col, text_col), _spec(length), lambda c: compare(c, length), finish, finish.schema).withColumnRenamed("id", id_col)


def _spec(length: int) -> Windows:
    return Windows(length, max(8, length // 3), words=False)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """(group_doc, group_start, length, doc, start): repeats of at least `length` bytes with all their occurrences.

    A group is a stretch of bytes at its earliest place (group_doc, group_start): a longest one that some
    other place holds and of which every window stands there first. Its occurrences are that place and
    all others that hold it, alone or within a longer repeat, so a group that lies in another's stretch
    has the other's occurrences too; nested repeats cost as many rows. A null id is null here too;
    documents without repeats are in no group.
    """
    found = cut(occurrences(docs, id_col, text_col, _spec(length), lambda c: compare(c, length)))
    source = ["sblock", "srow"]
    groups = found.select(*source, F.col("sdoc").alias("group_doc"), F.col("splace").alias("group_start"), F.col("length").alias("group_length")).distinct()
    pairs = salted_join(found.select(*source, "splace", "length", "doc", "start"), groups, source)
    inside = (F.col("group_start") >= F.col("splace")) & (F.col("group_start") + F.col("group_length") <= F.col("splace") + F.col("length"))
    held = pairs.where(inside).select("group_doc", "group_start", F.col("group_length").alias("length"), "doc", (F.col("start") + F.col("group_start") - F.col("splace")).alias("start"))
    head = groups.select("group_doc", "group_start", F.col("group_length").alias("length"), F.col("group_doc").alias("doc"), F.col("group_start").alias("start"))
    return head.unionByName(held).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), full=False)


#: The same rows by comparing everything with everything, in DuckDB.
ORACLE = r"""
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
win as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as m from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as i from t) p),
f as (select doc_id, i, row_number() over (partition by m order by doc_id, i) as n from win),
d as (select doc_id, i from f where n > 1),
e as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as fresh from d),
r as (select doc_id, min(i) as a, max(i) + 100 as b from (select doc_id, i, sum(fresh) over (partition by doc_id order by i rows between unbounded preceding and current row) as g from e) q group by doc_id, g),
cuts as (select doc_id, list(a order by a) as a, list(b order by a) as b, sum(b - a) as removed, count(*) as n from r group by doc_id),
k as (select t.doc_id, length(h) // 2 as n_bytes, coalesce(removed, 0) as n_removed, coalesce(n, 0) as n_spans,
  case when n is null then h else array_to_string(list_transform(range(0, n + 1), lambda j: substr(h, 2 * case when j = 0 then 0 else b[j] end + 1, 2 * (case when j = n then length(h) // 2 else a[j + 1] end - case when j = 0 then 0 else b[j] end))), '') end as kept
  from t left join cuts on cuts.doc_id = t.doc_id)
select doc_id, cast(n_bytes as bigint) as n_bytes, cast(n_removed as bigint) as n_removed, cast(n_spans as bigint) as n_spans, sha256(unhex(kept)) as kept_sha256 from k
"""
