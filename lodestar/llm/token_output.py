"""Token ids as packed binary rows: best-fit-decreasing packing with a segment tree of capacities.

One pass without a shuffle: each task encodes its documents, packs them a buffer at a time and hands
poorly filled rows' documents on to its next buffer. Documents longer than a row are cut into pieces
that carry their start, so that every document can be put together again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, text_groups, vocabulary
from .common import table

#: Tokens that a task packs together.
BUFFER_TOKENS = 1 << 22
#: Rows filled less than this go on to the task's next buffer.
WELL_FILLED = 0.98


class CapacityTree:
    """Open rows by what is left in them; finds the tightest row that takes a piece in logarithmic time.

    A segment tree over the possible capacities holds at each node how many open rows lie below it.
    """

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << (capacity + 1 - 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, row: int) -> None:
        self.rows[left].append(row)
        self._change(left, 1)

    def _change(self, left: int, by: int) -> None:
        at = left + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (row, what is left in it) of the row with the least that is enough."""
        at = need + self.leaves
        if not self.count[at]:
            while at & 1 or not self.count[at + 1]:  # up, until a larger capacity's subtree has rows
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.leaves:
                at *= 2
                if not self.count[at]:
                    at += 1
        left = at - self.leaves
        self._change(left, -1)
        return self.rows[left].pop(), left


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices; the longest piece first, each into the tightest row, ties to the first index."""
    tree, rows = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        row, left = found if found else (len(rows), capacity)
        if not found:
            rows.append([])
        rows[row].append(i)
        tree.add(left - lengths[i], row)
    return rows


def packed_rows(docs: DataFrame, tokenizer_path: str, row_tokens: int = 4096, end_id: int = 50256, pad_id: int = 50256, id_col: str = "doc_id", text_col: str = "text", bits: int = 16) -> DataFrame:
    """One row for each packed sequence of row_tokens ids.

    sequence_id; ids: little-endian unsigned bits-bit ids, padded with pad_id; cu_seqlens: where the
    pieces begin and the last one ends; resets: position_ids as the places where positions start anew
    (the same numbers without the end); doc_ids and starts: each piece's document and its first
    token's place there; n_tokens without padding; ids_crc32 of the ids' bytes. Each document ends
    with end_id. A null text counts as empty: it is end_id alone. Null and repeated ids are kept as
    they are; other columns are left out. No documents: no rows. A task packs BUFFER_TOKENS at a time:
    the pieces of rows filled under WELL_FILLED wait for its next documents, unless they are over half
    of the buffer, and its last rows go as they are. So nothing is left out.
    """
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)
    kind = np.dtype(f"<u{bits // 8}")
    schema = "sequence_id bigint, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<bigint>, starts array<bigint>, n_tokens int, ids_crc32 bigint"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        words_of = encoder(shared.value, None, "H" if bits == 16 else "I")
        end, width = np.asarray([end_id], kind).tobytes(), kind.itemsize
        # pieces in waiting: (document, start, ids)
        wait: list[tuple[int | None, int, bytes]] = []
        size, task, made = 0, TaskContext.get().partitionId(), 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal wait, size, made
            rows, kept, columns = best_fit_decreasing([len(p[2]) // width for p in wait], row_tokens), [], [[] for _ in names]
            for row in rows:
                pieces = [wait[i] for i in row]
                filled = sum(len(p[2]) for p in pieces) // width
                if not last and filled < WELL_FILLED * row_tokens:
                    kept += pieces
                    continue
                cuts = np.cumsum([0, *(len(p[2]) // width for p in pieces)]).tolist()
                ids = b"".join(p[2] for p in pieces) + np.full(row_tokens - filled, pad_id, kind).tobytes()
                for column, value in zip(columns, ((task << 32) + made, ids, cuts, cuts[:-1], [p[0] for p in pieces], [p[1] for p in pieces], filled, zlib.crc32(ids)), strict=True):
                    column.append(value)
                made += 1
            wait, size = kept, sum(len(p[2]) for p in kept) // width
            types = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int64()]
            for lo in range(0, len(columns[0]), 512):
                yield pa.record_batch([pa.array(c[lo : lo + 512], t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for first, group in text_groups(batch.column(1).to_pylist()):
                words = [vocab.words(t) for t in group]
                get = words_of.entries(words)
                for i, w in enumerate(words):
                    ids = b"".join(map(get, w)) + end
                    for lo in range(0, len(ids), row_tokens * width):
                        wait.append((batch.column(0)[first + i].as_py(), lo // width, ids[lo : lo + row_tokens * width]))
                    size += len(ids) // width
                    if size >= BUFFER_TOKENS:
                        before = size
                        yield from flush(last=False)
                        if size > before // 2:  # too little was well filled: do not carry it for ever
                            yield from flush(last=True)
        yield from flush(last=True)

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


def write_packed(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: the id matrix is the column ids, a row of it in each row."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def unpack(rows: DataFrame, bits: int = 16) -> DataFrame:
    """(doc_id, start, ids array<int>) of every piece: what packed_rows packed, without padding."""
    kind = np.dtype(f"<u{bits // 8}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, starts, out = [], [], []
            for ids, cuts, d, s in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                row = np.frombuffer(ids, kind)
                docs, starts, out = docs + d, starts + s, out + [row[a:b].astype(np.int32) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return rows.select("ids", "cu_seqlens", "doc_ids", "starts").mapInArrow(run, "doc_id bigint, start bigint, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
