"""First occurrences of all windows of a corpus, without moving the windows.

Every window of `length` symbols (bytes or words) is anchored at its minimiser: the position in it whose
`gram` symbols have the smallest hash. Equal windows have equal anchors at equal places, so only
segments (the run of windows of one anchor) have to meet, by their anchor's hash. Segments of equal
content are one class, whose copies are told apart by their places alone; only where an anchor has
several classes does a class's content travel, once, to the task that compares them. An anchor with very
many classes (a passage's edge in a large part of all documents) is not compared in one task: Spark
groups its windows, with partial minima before the shuffle.

So far hashes speak. What they give is, for each document, runs of windows and where each has its
earliest source. The sources' tiles are then joined to the blocks that need them, and a symbol goes only
where a whole window over it equals its source, byte for byte.

Documents travel in compressed blocks, written once to the checkpoint folder, so that each later step
joins a few answers by block to compressed texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, partitions, prefix_hash, release, salted_join, span_hash, text_buffers, word_spans

BLOCK_BYTES = 2 << 20
#: Symbols whose windows are anchored together; positions must fit in PLACE bits.
BATCH = 1 << 20
PLACE = 22
#: Blocks whose anchors one part gathers.
PART_BLOCKS = 8
#: Classes of an anchor over which its windows are compared by their hashes, in Spark, and not in one task.
HOT = 1 << 15
#: Symbols of a tile, in which sources travel to be verified.
TILE_BYTES, TILE_WORDS = 2048, 256
#: Stands for a null id: such rows come last in the order.
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Windows:
    """length: symbols of a window; gram: symbols of an anchor; words: symbols are words, not bytes."""

    length: int
    gram: int
    words: bool

    @property
    def tile(self) -> int:
        return TILE_WORDS if self.words else TILE_BYTES


def pack(*arrays, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(arrays, 5))


def unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


@dataclass
class Block:
    ids: np.ndarray  # NO_ID for null
    offsets: np.ndarray
    data: np.ndarray
    null: np.ndarray  # which texts are null
    more: pa.Table | None = None

    def symbols(self, spec: Windows) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
        """Symbols, their offsets by document, and the words' byte spans if symbols are words."""
        if not spec.words:
            return self.data, self.offsets, None
        out, firsts, spans = [], [np.zeros(1, np.int64)], []
        lo = 0
        while lo < len(self.ids):  # word hashes of about a megabyte of text at a time
            hi = max(lo + 1, int(np.searchsorted(self.offsets, self.offsets[lo] + BATCH, "right")) - 1)
            base = self.offsets[lo]
            data = self.data[base : self.offsets[hi]]
            starts, ends, first = word_spans(data, self.offsets[lo : hi + 1] - base)
            out.append(span_hash(prefix_hash(data), starts, ends))
            firsts.append(first[1:] + firsts[-1][-1])
            spans.append((starts + base, ends + base))
            lo = hi
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return join(out, np.uint64), np.concatenate(firsts), (join([s for s, _ in spans], np.int64), join([e for _, e in spans], np.int64))


def blocks(docs: DataFrame, id_col: str, text_col: str, more: tuple[str, ...] = ()) -> DataFrame:
    """(block, body) rows of neighbouring documents, in the checkpoint folder.

    more: further columns of docs, which Block.more holds as a table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, nulls, others, texts, size, made = [], [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            lengths = [len(t) for t in texts]
            rest = None
            if others:
                sink = pa.BufferOutputStream()
                rest = pa.Table.from_batches(others)
                with pa.ipc.new_stream(sink, rest.schema) as stream:
                    stream.write_table(rest)
                rest = sink.getvalue().to_pybytes()
            body = pack(np.concatenate(ids), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), b"".join(texts), np.concatenate(nulls), rest, level=3)
            return pa.record_batch([pa.array([(TaskContext.get().partitionId() << 32) + made]), pa.array([body], pa.binary())], names=["block", "body"])

        for batch in batches:
            own = batch.column(0).fill_null(NO_ID).to_numpy()
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for first, data, offsets in text_buffers(batch.column(1)):
                raw = data.tobytes()
                ids.append(own[first : first + len(offsets) - 1])
                nulls.append(null[first : first + len(offsets) - 1])
                if more:
                    others.append(batch.select(list(range(2, 2 + len(more)))).slice(first, len(offsets) - 1))
                texts += [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield out()
                    ids, nulls, others, texts, size, made = [], [], [], [], 0, made + 1
        if texts:
            yield out()

    made = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), *(docs[c].alias(f"more_{k}") for k, c in enumerate(more))).mapInArrow(run, "block bigint, body binary")
    return cut(made)


def open_block(body: bytes) -> Block:
    ids, offsets, data, null, more = unpack(body)
    return Block(ids, offsets, np.frombuffer(data, np.uint8), null, pa.ipc.open_stream(more).read_all() if more is not None else None)


@dataclass
class Segments:
    """Runs of windows with one anchor, by place: document (its row in the block), first and last window, anchor."""

    row: np.ndarray
    first: np.ndarray  # these three count symbols from the block's first
    last: np.ndarray
    anchor: np.ndarray
    place: np.ndarray  # the anchor's place in its document
    key: np.ndarray  # 40 bits: the anchor's hash
    content: np.ndarray  # 48 bits: hash of the windows' symbols and of the anchor's place among them


def segments(symbols: np.ndarray, offsets: np.ndarray, spec: Windows) -> Segments:
    found = [[] for _ in range(5)]
    width = spec.length - spec.gram + 1

    def batch(lo: int, hi: int, bounds: np.ndarray) -> None:
        """Windows that begin in [lo, hi) within the documents whose symbol offsets are bounds."""
        end = min(hi + spec.length - 1, int(bounds[-1]))
        part = symbols[lo:end]
        n = len(part)
        if n < spec.length:
            return
        prefix = prefix_hash(part)
        at = np.arange(n - spec.gram + 1)
        grams = span_hash(prefix, at, at + spec.gram)
        least = (grams >> np.uint64(PLACE) << np.uint64(PLACE)) | at.astype(np.uint64)
        reach = 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        inside = np.ones(len(least), bool)
        for b in bounds[(bounds > lo) & (bounds < end)].tolist():  # no window crosses a document's end
            inside[max(0, b - lo - spec.length + 1) : b - lo] = False
        inside[hi - lo :] = False
        w = np.flatnonzero(inside)
        if not len(w):
            return
        anchor = (least[w] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        edge = np.ones(len(w), bool)
        edge[1:] = (anchor[1:] != anchor[:-1]) | (w[1:] != w[:-1] + 1)
        begin = np.flatnonzero(edge)
        first, last, anchor = w[begin], w[np.append(begin[1:], len(w)) - 1], anchor[begin]
        content = mix(span_hash(prefix, first, last + spec.length) + (anchor - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        for out, x in zip(found, (first + lo, last + lo, anchor + lo, grams[anchor] >> np.uint64(24), content >> np.uint64(16)), strict=True):
            out.append(x)

    docs, row = len(offsets) - 1, 0
    while row < docs:
        top = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BATCH, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[top])
        for a in range(lo, hi, BATCH) if top == row + 1 else (lo,):
            batch(a, min(hi, a + BATCH) if top == row + 1 else hi, offsets[row : top + 1])
        row = top
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    first, last, anchor, key, content = (join(x, k) for x, k in zip(found, (np.int64, np.int64, np.int64, np.uint64, np.uint64), strict=True))
    rows = np.searchsorted(offsets, first, "right") - 1
    return Segments(rows, first, last, anchor, anchor - offsets[rows], key, content)


def classes(ids: np.ndarray, s: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Order of the segments by class and place, and where each class begins in it."""
    order = np.lexsort((s.place, ids[s.row], s.content, s.key))
    key, content = s.key[order], s.content[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    return order, np.flatnonzero(new)


def _deal(block: int, part: np.ndarray, parts: int, columns: list, more: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """One row for each part that has entries: (part, block, body) of the columns' entries and their numbers."""
    order = np.argsort(part, kind="stable")
    begin = np.searchsorted(part[order], np.arange(parts + 1))
    to, bodies = [], []
    for p in np.flatnonzero(np.diff(begin)):
        pick = order[begin[p] : begin[p + 1]]
        to.append(int(p))
        bodies.append(pack(*(c[pick] for c in columns), *(more(pick) if more else ())))
    if to:
        yield pa.record_batch([pa.array(to, pa.int64()), pa.array([block] * len(to), pa.int64()), pa.array(bodies, pa.binary())], names=["part", "block", "body"])


def _answers(block: np.ndarray, columns: list, kind: int) -> pa.Table:
    """(block, kind, body): the columns' entries by the block that they are for."""
    order = np.argsort(block, kind="stable")
    names, begin = np.unique(block[order], return_index=True)
    begin = np.append(begin, len(order))
    bodies = [pack(*(c[order[a:b]] for c in columns)) for a, b in zip(begin, begin[1:], strict=False)]
    return pa.table({"block": pa.array(names, pa.int64()), "kind": pa.array([kind] * len(names), pa.int32()), "body": pa.array(bodies, pa.binary())})


ANSWER = "block bigint, kind int, body binary"
#: Windows of a block by place: first and last symbol, and the source of the first (block, row in it, place in the text).
Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Opened:
    """A block with its symbols, segments and classes."""

    def __init__(self, name: int, body: bytes, spec: Windows) -> None:
        self.name, self.spec, self.block = name, spec, open_block(body)
        self.symbols, self.offsets, self.spans = self.block.symbols(spec)
        self._segments = None

    @property
    def segments(self) -> tuple[Segments, np.ndarray, np.ndarray]:
        """The segments, their order by class, and where each class begins in it."""
        if self._segments is None:
            s = segments(self.symbols, self.offsets, self.spec)
            self._segments = (s, *classes(self.block.ids, s))
        return self._segments

    def copies(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All segments of the classes, and at which place in `number` the class of each stands."""
        s, order, begin = self.segments
        sizes = (np.append(begin[1:], len(order)) - begin)[number]
        return order[np.repeat(begin[number] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))], np.repeat(np.arange(len(number)), sizes)

    def first_copies(self, number: np.ndarray) -> np.ndarray:
        _, order, begin = self.segments
        return order[begin[number]]

    def leads(self, number: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments and numbers of those classes whose first copy is here."""
        s, lead = self.segments[0], self.first_copies(number)
        holds = (self.block.ids[s.row[lead]] == doc) & (s.place[lead] == place)
        return lead[holds], number[holds]

    def runs(self, answers: pa.Table) -> Runs:
        """What the answers (kinds 0 and 1) say, where neighbouring windows with neighbouring sources are one run."""
        s, _, _ = self.segments
        parts: list[tuple] = []
        for kind, body in zip(answers.column("kind").to_pylist(), answers.column("body").to_pylist(), strict=True):
            if kind == 0:  # every copy but the first repeats it as a whole
                number, doc, place, block, row, _ = unpack(body)
                at, of = self.copies(number)
                later = (self.block.ids[s.row[at]] != doc[of]) | (s.place[at] != place[of])
                at, of = at[later], of[later]
                parts.append((s.first[at], s.last[at], block[of], row[of], place[of] - (s.anchor - s.first)[at]))
            elif kind == 1:  # these windows of the first copy
                number, first, last, block, row, place = unpack(body)
                at, of = self.copies(number)
                lead = self.first_copies(number)[of]
                same = (self.block.ids[s.row[at]] == self.block.ids[s.row[lead]]) & (s.place[at] == s.place[lead])
                at, of = at[same], of[same]
                parts.append((s.first[at] + first[of], s.first[at] + last[of], block[of], row[of], place[of]))
        if not parts:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        first, last, block, row, place = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
        own = np.searchsorted(self.offsets, first, "right") - 1
        order = np.lexsort((first, first - place, row, block, own))
        first, last, block, row, place, own = (x[order] for x in (first, last, block, row, place, own))
        new = np.ones(len(first), bool)
        new[1:] = (own[1:] != own[:-1]) | (block[1:] != block[:-1]) | (row[1:] != row[:-1]) | ((first - place)[1:] != (first - place)[:-1])
        span = len(self.symbols) + 1  # the furthest end so far in the same alignment
        group = np.cumsum(new)
        reach = np.maximum.accumulate(group * span + last) - group * span
        new[1:] |= first[1:] > reach[:-1] + 1
        begin = np.flatnonzero(new)
        return first[begin], np.maximum.reduceat(last, begin) if len(begin) else last, block[begin], row[begin], place[begin]

    def content(self, row: int, first: int, last: int):
        """Symbols [first, last) of a row's text: bytes, or a list of words as bytes."""
        lo, hi = int(self.offsets[row]) + first, min(int(self.offsets[row]) + last, int(self.offsets[row + 1]))
        if not self.spec.words:
            return self.block.data[lo:hi].tobytes()
        starts, ends = self.spans[0][lo:hi].tolist(), self.spans[1][lo:hi].tolist()
        if not starts:
            return []
        base = starts[0]
        raw = self.block.data[base : ends[-1]].tobytes()
        return [raw[a - base : b - base] for a, b in zip(starts, ends, strict=True)]

    def verified(self, runs: Runs, tiles: dict[tuple[int, int, int], bytes | list]) -> Runs:
        """The parts of the runs in which every window equals its source; a source that is missing equals nothing."""
        length, tile, out = self.spec.length, self.spec.tile, []
        for first, last, block, row, place in zip(*(x.tolist() for x in runs), strict=True):
            n = last - first + length
            own = int(np.searchsorted(self.offsets, first, "right")) - 1
            mine = self.content(own, first - int(self.offsets[own]), first - int(self.offsets[own]) + n)
            if block == self.name:
                theirs = self.content(row, place, place + n)
            else:
                theirs = [] if self.spec.words else b""
                for k in range(place // tile, (place + n - 1) // tile + 1):
                    part = tiles.get((block, row, k), theirs[:0])
                    theirs += part[max(0, place - k * tile) : place + n - k * tile]
            if mine == theirs:
                out.append((first, last, block, row, place))
                continue
            # what differs stays: only windows without a difference count
            differs = [k for k in range(n) if k >= len(theirs) or mine[k] != theirs[k]]
            for a, z in zip([-1, *differs], [*differs, n], strict=True):
                if z - a - 1 >= length:
                    out.append((first + a + 1, first + z - length, block, row, place + a + 1))
        return tuple(np.asarray(x, np.int64) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def repeated_windows(source: DataFrame, spec: Windows, compare: Callable, finish: Callable, schema: str) -> DataFrame:
    """finish(opened block, removed, runs) for each block, where removed has a True for each symbol in a
    window that also starts earlier, and runs are those windows with their sources, verified.

    compare(classes) gets, for one anchor, a list of (order, anchor's place in the content, content)
    with order = (document, place) of the class's first copy; it returns for each class (first, last,
    other class, its place there) for windows of its content which also stand in a class of smaller order.
    """
    answers = find_sources(source, spec, compare)
    return remove_verified(source, spec, answers, finish, schema)


def find_sources(source: DataFrame, spec: Windows, compare: Callable) -> DataFrame:
    """(block, kind, body): for the classes of each block where they stand first (0), and for windows of first copies (1)."""
    n, most = source.count(), HOT
    parts = max(2 * partitions(source.sparkSession), n // PART_BLOCKS)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = Opened(name, body, spec)
                s, order, begin = b.segments
                lead = order[begin]
                copies = np.diff(np.append(begin, len(order))) > 1
                key, content = s.key[lead], s.content[lead]
                split = [key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint8), content.astype(np.uint32), (content >> np.uint64(32)).astype(np.uint16)]
                doc, row = np.unique(s.row[lead], return_inverse=True)

                def more(pick, ids=b.block.ids, doc=doc, row=row):
                    used, at = np.unique(row[pick], return_inverse=True)
                    return ids[doc[used]], doc[used].astype(np.uint32), at.astype(np.uint16 if len(used) < 65536 else np.uint32)

                yield from _deal(name, (key % np.uint64(parts)).astype(np.int64), parts, [*split, s.place[lead].astype(np.uint32), copies, np.arange(len(lead), dtype=np.uint32)], more)

    def meet(key, group):
        """The anchors that stand more than once: each class's first copy, and whether classes must be compared."""
        columns = [[] for _ in range(8)]
        for name, body in zip(group.column("block").to_pylist(), group.column("body").to_pylist(), strict=True):
            k0, k1, c0, c1, place, copies, number, ids, rows, at = unpack(body)
            for out, x in zip(columns, (k0.astype(np.uint64) | k1.astype(np.uint64) << np.uint64(32), c0.astype(np.uint64) | c1.astype(np.uint64) << np.uint64(32), ids[at], place.astype(np.int64), copies, number, rows[at], np.full(len(number), name)), strict=True):
                out.append(x)
        k, c, doc, place, copies, number, row, block = map(np.concatenate, columns)
        order = np.lexsort((place, doc, c, k))
        k, c, doc, place, copies, number, row, block = (x[order] for x in (k, c, doc, place, copies, number, row, block))
        new_key, new_class = np.ones(len(k), bool), np.ones(len(k), bool)
        new_key[1:] = k[1:] != k[:-1]
        new_class[1:] = new_key[1:] | (c[1:] != c[:-1])
        group_of, class_of = np.cumsum(new_key) - 1, np.cumsum(new_class) - 1
        entries, distinct = np.bincount(group_of), np.bincount(group_of, new_class)
        several = (distinct > 1).astype(np.uint8) + (distinct > most)
        again = (entries > 1) | (np.bincount(group_of, copies) > 0)
        lead = np.flatnonzero(new_class)[class_of]
        keep = np.flatnonzero(again[group_of])
        return _answers(block[keep], [c[keep] for c in (number, doc[lead], place[lead], block[lead], row[lead], several[group_of])], 0)

    met = cut(source.mapInArrow(anchors, "part bigint, block bigint, body binary").groupBy("part").applyInArrow(meet, ANSWER))
    nothing = pa.table({"part": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "body": pa.array([], pa.binary())})

    def contents(key, block, answers):
        """Contents of the classes to be compared, from the blocks that hold their first copies."""
        if not len(block) or not len(answers):
            return nothing
        number, doc, place, _, _, several = map(np.concatenate, zip(*(unpack(x) for x in answers.column("body").to_pylist()), strict=True))
        few = several == 1
        if not few.any():
            return nothing
        b = Opened(key[0].as_py(), block.column("body")[0].as_py(), spec)
        s = b.segments[0]
        lead, number = b.leads(number[few], doc[few], place[few])
        first, end = s.first[lead], s.last[lead] + spec.length
        width = b.symbols.dtype.itemsize

        def more(pick):
            return (b"".join(b.symbols[x:y].tobytes() for x, y in zip(first[pick].tolist(), end[pick].tolist(), strict=True)), (end - first)[pick] * width)

        columns = [s.key[lead], s.content[lead], b.block.ids[s.row[lead]], s.place[lead], s.row[lead], (s.anchor - s.first)[lead].astype(np.uint32), number]
        dealt = list(_deal(b.name, (s.key[lead] % np.uint64(parts)).astype(np.int64), parts, columns, more))
        return pa.Table.from_batches(dealt) if dealt else nothing

    def decide(key, group):
        columns, bodies = [[] for _ in range(8)], []
        for name, body in zip(group.column("block").to_pylist(), group.column("body").to_pylist(), strict=True):
            *own, text, sizes = unpack(body)
            for out, x in zip(columns, (*own, np.full(len(own[0]), name)), strict=True):
                out.append(x)
            ends = np.cumsum(sizes.astype(np.int64)).tolist()
            bodies += [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        k, c, doc, place, row, at, number, block = map(np.concatenate, columns)
        order = np.lexsort((c, k))
        edges = np.flatnonzero(np.diff(k[order], prepend=np.uint64(1 << 63)))
        out = ([], [], [], [], [], [], [])
        for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            if z - a < 2:
                continue
            pick = order[a:z].tolist()
            group_of = [((int(doc[i]), int(place[i])), int(at[i]), bodies[i]) for i in pick]
            for i, spans in zip(pick, compare(group_of), strict=True):
                for first, last, other, there in spans:
                    j = pick[other]
                    for to, x in zip(out, (int(block[i]), int(number[i]), first, last, int(block[j]), int(row[j]), int(place[j]) - int(at[j]) + there), strict=True):
                        to.append(x)
        return _answers(np.asarray(out[0], np.int64), [np.asarray(x, np.int64) for x in out[1:]], 1)

    keyed = source.groupBy("block")
    asked = keyed.cogroup(met.groupBy("block")).applyInArrow(contents, "part bigint, block bigint, body binary")
    decided = asked.groupBy("part").applyInArrow(decide, ANSWER)

    def hashes(key, block, answers):
        """Two hashes, order and place of every window of the hot anchors' classes, from their first copies."""
        names = ("h1", "h2", "doc", "place", "block", "row", "number", "at")
        out = {c: pa.array([], pa.int64()) for c in names}
        if not len(block) or not len(answers):
            return pa.table(out)
        number, doc, place, _, _, several = map(np.concatenate, zip(*(unpack(x) for x in answers.column("body").to_pylist()), strict=True))
        many = several == 2
        if not many.any():
            return pa.table(out)
        b = Opened(key[0].as_py(), block.column("body")[0].as_py(), spec)
        s = b.segments[0]
        lead, number = b.leads(number[many], doc[many], place[many])
        if len(lead):
            count = s.last[lead] - s.first[lead] + 1
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(s.first[lead], count) + at
            values = (
                *(span_hash(prefix_hash(x), start, start + spec.length).view(np.int64) for x in (b.symbols, mix(b.symbols.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)))),
                b.block.ids[np.repeat(s.row[lead], count)], np.repeat(s.place[lead] - s.anchor[lead], count) + start, np.full(len(at), b.name), np.repeat(s.row[lead], count), np.repeat(number, count).astype(np.int64), at,
            )
            out = dict(zip(names, (pa.array(v, pa.int64()) for v in values), strict=True))
        return pa.table(out)

    def settle(key, group):
        number, at, block, row, place = (group.column(c).to_numpy() for c in ("number", "at", "sblock", "srow", "splace"))
        return _answers(np.full(len(at), key[0].as_py()), [number, at, at, block, row, place], 1)

    wide = cut(keyed.cogroup(met.groupBy("block")).applyInArrow(hashes, "h1 bigint, h2 bigint, doc bigint, place bigint, block bigint, row bigint, number bigint, at bigint")) if _any_hot(met) else None
    if wide is not None:
        first_place = wide.groupBy("h1", "h2").agg(F.min(F.struct("doc", "place", "block", "row")).alias("lead"), F.count(F.lit(1)).alias("_n"))
        found = salted_join(wide, first_place.select("h1", "h2", "lead"), ["h1", "h2"], counts=first_place.select("h1", "h2", "_n"))
        later = found.where(F.struct("doc", "place") > F.struct("lead.doc", "lead.place")).select("block", "number", "at", F.col("lead.block").alias("sblock"), F.col("lead.row").alias("srow"), F.col("lead.place").alias("splace"))
        decided = decided.unionByName(later.groupBy("block").applyInArrow(settle, ANSWER))
    return met.unionByName(decided)


def _any_hot(met: DataFrame) -> bool:
    """Whether an anchor has over HOT classes."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = [bool((unpack(x)[5] == 2).any()) for x in batch.column(0).to_pylist()]
            if any(hot):
                yield pa.record_batch([pa.array([True])], names=["hot"])

    return not met.select("body").mapInArrow(look, "hot boolean").isEmpty()


def remove_verified(source: DataFrame, spec: Windows, answers: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish for each block, after the sources that the answers name have been compared."""
    tile = spec.tile

    def ask(key, block, given):
        """A block's runs, and the tiles of other blocks that it needs for them."""
        if not len(block) or not len(given):
            return pa.table({"block": pa.array([], pa.int64()), "runs": pa.array([], pa.binary()), **{c: pa.array([], pa.int64()) for c in ("sblock", "srow", "tile")}})
        b = Opened(key[0].as_py(), block.column("body")[0].as_py(), spec)
        runs = b.runs(given)
        far = runs[2] != b.name
        first, last, sblock, srow, place = (x[far] for x in runs)
        low, high = place // tile, (place + last - first + spec.length - 1) // tile
        count = high - low + 1
        k = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        wanted = np.unique(np.stack([np.repeat(sblock, count), np.repeat(srow, count), k]), axis=1)
        n = wanted.shape[1]
        columns = {"block": pa.array([b.name] * (n + 1), pa.int64()), "runs": pa.array([pack(*runs)] + [None] * n, pa.binary())}
        return pa.table(columns | {c: pa.array([None, *x.tolist()], pa.int64()) for c, x in zip(("sblock", "srow", "tile"), wanted, strict=True)})

    def serve(key, block, asked):
        out = {"sblock": [], "srow": [], "tile": [], "body": []}
        if len(block) and len(asked):
            b = Opened(key[0].as_py(), block.column("body")[0].as_py(), spec)
            for row, k in zip(asked.column("srow").to_pylist(), asked.column("tile").to_pylist(), strict=True):
                got = b.content(row, k * tile, k * tile + tile)
                for c, x in zip(out, (b.name, row, k, pickle.dumps((b.name, row, k, b" ".join(got) if spec.words else got), 5)), strict=True):
                    out[c].append(x)
        return pa.table({c: pa.array(v, pa.binary() if c == "body" else pa.int64()) for c, v in out.items()})

    keyed = source.groupBy("block")
    laid = cut(keyed.cogroup(answers.groupBy("block")).applyInArrow(ask, "block bigint, runs binary, sblock bigint, srow bigint, tile bigint"))
    asked = laid.where("runs is null").select("block", "sblock", "srow", "tile")
    tiles = asked.groupBy("sblock", "srow", "tile").agg(F.count(F.lit(1)).alias("_n"))
    served = keyed.cogroup(tiles.withColumnRenamed("sblock", "block").groupBy("block")).applyInArrow(serve, "sblock bigint, srow bigint, tile bigint, body binary")
    # a tile that very many blocks need is dealt out with them
    given = salted_join(asked, served, ["sblock", "srow", "tile"], counts=tiles).select("block", F.lit(1).alias("kind"), "body")
    given = laid.where("runs is not null").select("block", F.lit(0).alias("kind"), F.col("runs").alias("body")).unionByName(given)

    def close(key, block, given):
        if not len(block):
            return finish.empty
        b = Opened(key[0].as_py(), block.column("body")[0].as_py(), spec)
        change, runs, found = np.zeros(len(b.symbols) + 1, np.int64), tuple(np.zeros(0, np.int64) for _ in range(5)), {}
        for kind, body in zip(given.column("kind").to_pylist(), given.column("body").to_pylist(), strict=True) if len(given) else ():
            if kind == 0:
                runs = unpack(body)
            else:
                *at, got = pickle.loads(body)
                found[tuple(at)] = got.split(b" ") if spec.words else got
        if len(runs[0]):
            runs = b.verified(runs, found)
            np.add.at(change, runs[0], 1)
            np.add.at(change, runs[1] + spec.length, -1)
        out = finish(b, np.cumsum(change)[:-1] > 0, runs)
        del b, found
        release()
        return out

    return keyed.cogroup(given.groupBy("block")).applyInArrow(close, schema)


class _Places:
    """The verified runs of a block as rows."""

    schema = "sblock bigint, srow bigint, splace bigint, length bigint, block bigint, row bigint, doc bigint, start bigint"
    names = [c.split()[0] for c in schema.split(", ")]
    empty = pa.table({c: pa.array([], pa.int64()) for c in names})

    def __init__(self, length: int) -> None:
        self.length = length

    def __call__(self, b: Opened, _, runs: Runs) -> pa.Table:
        first, last, *source = runs
        own = np.searchsorted(b.offsets, first, "right") - 1
        doc = [None if i == NO_ID else i for i in b.block.ids[own].tolist()]
        columns = (*source, last - first + self.length, np.full(len(own), b.name), own, doc, first - b.offsets[own])
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(self.names, columns, strict=True)})


def occurrences(docs: DataFrame, id_col: str, text_col: str, spec: Windows, compare: Callable) -> DataFrame:
    """The runs of windows that stand earlier too: (sdoc, sblock, srow, splace) is where a run's windows stand first,
    length its symbols, (doc, block, row, start) the run. All are verified."""
    source, finish = blocks(docs, id_col, text_col), _Places(spec.length)
    found = cut(repeated_windows(source, spec, compare, finish, finish.schema))
    # copies of a segment name its first copy, whose own windows may stand earlier yet
    own = found.groupBy(F.col("block").alias("sblock"), F.col("row").alias("srow")).agg(F.sort_array(F.collect_list(F.struct("start", "length", "sblock", "srow", "splace"))).alias("own"))
    first = salted_join(found, own, ["sblock", "srow"], "left").select(*_Places.names, "own")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lo, hi = r["splace"], r["splace"] + r["length"] - spec.length  # windows
                rest, done = [], lo
                for o in r["own"] or ():  # in order of places; of runs that overlap the first one counts
                    a, z = max(done, o["start"]), min(hi, o["start"] + o["length"] - spec.length)
                    if a <= z:
                        rest.append((a, z, o["sblock"], o["srow"], o["splace"] + a - o["start"]))
                        done = z + 1
                at = lo
                for a, z, *to in [*rest, (hi + 1, hi + 1, 0, 0, 0)]:
                    if at < a:  # these stand first in the source itself
                        out.append((r["sblock"], r["srow"], at, a - at - 1 + spec.length, r["block"], r["row"], r["doc"], r["start"] + at - lo))
                    if a <= hi:
                        out.append((*to, z - a + spec.length, r["block"], r["row"], r["doc"], r["start"] + a - lo))
                    at = z + 1
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 8)], names=_Places.names)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = open_block(body).ids
                yield pa.record_batch([pa.array([name] * len(own), pa.int64()), pa.array(range(len(own)), pa.int64()), pa.array([None if i == NO_ID else i for i in own.tolist()], pa.int64())], names=["sblock", "srow", "sdoc"])

    resolved = cut(first.mapInArrow(resolve, _Places.schema))
    return salted_join(resolved, source.mapInArrow(ids, "sblock bigint, srow bigint, sdoc bigint"), ["sblock", "srow"])
