"""Spelling variants of words: words one edit apart, by bands of letter-parity masks.

A word's mask holds the parity of how often each of its letters stands in it. One inserted, deleted or replaced
letter flips at most two bits, so of three bands of the mask one at least is the same in both words. The bands
get letters of like total entropy, by counts over all words. One edit also leaves the first or the second half
of the shorter word as it is, so words meet by band, half and length of the shorter one, and buckets stay small
however many words there are. What meets is compared by masks, then by its letters; each pair is found once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, release, salted_join, table, text_buffers
from .oracle import CRC_TABLE, crc32

#: Bits of a mask: a to z, then the letters beyond by their place (some share a bit).
BITS = 63
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 200_000
#: A maximal run of letters in lower-cased UTF-8 (U+00C0 to U+00FF are C3 80 to C3 BF).
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def _value_of_bytes() -> np.ndarray:
    out = np.zeros(256, np.uint64)
    for b in range(26):
        out[ord("a") + b] = 1 << b
    for b in range(64):
        out[0x80 + b] = 1 << (26 + b % (BITS - 26))
    return out


_VALUE = _value_of_bytes()


def letter_masks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, code points) of each word of lower-cased letters; the words are not empty."""
    return np.bitwise_xor.reduceat(_VALUE[data], offsets[:-1]), np.add.reduceat((data != 0xC3).astype(np.int64), offsets[:-1])


def counted_words(docs: DataFrame, every: int = 97, least_size: int = 5, least_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, size, mask) of the words of docs.

    A run of letters, A to Z lower-cased, loses one letter where `every` divides the CRC-32 h of "<id>:<run>": the one at
    h % its length (every=0: none does). Words of under least_size letters or least_count occurrences are left out.
    A null id reads as nothing, so its h is that of ":<run>"; a null text has no words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs = Counter(_RUN.findall((body.as_py() or b"").lower()))
                before = zlib.crc32(f"{'' if i is None else i}:".encode())
                for run, n in runs.items():
                    if every:
                        h = zlib.crc32(run, before)
                        if not h % every:
                            letters = run.decode()
                            at = h % len(letters)
                            run = (letters[:at] + letters[at + 1 :]).encode()
                    if len(run) - run.count(b"\xc3") >= least_size:
                        seen[run] += n
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        yield out()
        release()

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_buffers(batch.column(0)):
                mask, size = letter_masks(data, offsets)
                yield pa.record_batch([batch.column(0).slice(first, len(mask)), batch.column(1).slice(first, len(mask)), pa.array(size, pa.int32()), pa.array(mask.view(np.int64))], names=["word", "n", "size", "mask"])

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string").cast("binary")).where(F.col(text_col).isNotNull())
    words = rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    return words.mapInArrow(masked, "word string, n bigint, size int, mask bigint")


def bands_of(words: DataFrame) -> list[int]:
    """Three masks that share the bits: the bit of most entropy next goes to the band of least."""
    bit = lambda b: F.sum(F.shiftrightunsigned("mask", b).bitwiseAND(F.lit(1)))
    row = words.agg(F.count(F.lit(1)), *(bit(b) for b in range(BITS))).first()
    share = [(n or 0) / max(1, row[0]) for n in row[1:]]
    entropy = [-sum(q * math.log2(q) for q in (p, 1 - p) if q > 0) for p in share]
    bands, total = [0, 0, 0], [0.0, 0.0, 0.0]
    for b in sorted(range(BITS), key=lambda b: (-entropy[b], b)):
        k = total.index(min(total))
        bands[k] |= 1 << b
        total[k] += entropy[b]
    return bands


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of words (word, n, size, mask) exactly one edit apart, word < near, each once."""
    bands = bands_of(words)
    half = lambda m: F.floor(m / 2).cast("int")
    entries = []
    for shorter in (0, 1):  # the word is the shorter one of the two, or the longer one
        m = F.col("size") - shorter
        for k, band in enumerate(bands):
            value = F.col("mask").bitwiseAND(F.lit(band))
            for second, text in enumerate((F.left("word", half(m)), F.right("word", half(m)))):
                slot = m * 6 + 2 * k + second
                entries.append(F.struct(F.xxhash64(slot, value, text).alias("key"), slot.alias("slot")))
    keyed = words.select("word", "n", "size", "mask", F.explode(F.array(*entries)).alias("e")).select("e.key", "e.slot", "word", "n", "size", "mask")
    other = keyed.select("key", *(F.col(c).alias(f"{c}_") for c in ("slot", "word", "n", "size", "mask")))
    m = F.least("size", "size_")
    flipped = F.col("mask").bitwiseXOR(F.col("mask_"))
    same_head = F.left("word", half(m)) == F.left("word_", half(m))
    same_tail = F.right("word", half(m)) == F.right("word_", half(m))
    # the first band and half that both share: so a pair counts in one bucket only, whatever the keys' collisions
    first: Column = F.when(flipped.bitwiseAND(F.lit(bands[0])) == 0, 0).when(flipped.bitwiseAND(F.lit(bands[1])) == 0, 1).when(flipped.bitwiseAND(F.lit(bands[2])) == 0, 2)
    own = m * 6 + 2 * first + F.when(same_head, 0).when(same_tail, 1)
    met = salted_join(keyed, other, ["key"])
    near = met.where((F.col("slot") == F.col("slot_")) & (F.col("word") < F.col("word_")) & (F.bit_count(flipped) <= 2) & (F.abs(F.col("size") - F.col("size_")) <= 1) & (F.col("slot") == own) & (F.levenshtein("word", "word_", 1) == 1))
    return near.select("word", "n", F.col("word_").alias("near"), F.col("n_").alias("near_n"))


def variant_groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of words (word, n, size, mask).

    form: the near word of largest n, the first in code-point order among equals, if it has ratio times the word's n, else
    null. root: the last of the forms from the word on; n grows from form to form, so there is one.
    """
    words = cut(words)
    near = cut(near_words(words))
    both = near.select("word", "near", "near_n").unionByName(near.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed = words.select("word", "n").join(best, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    formed = cut(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    # each round doubles the steps; a chain of forms is no longer than the binary logarithm of the largest n
    links = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = cut(salted_join(links, further, ["root"], "left"))
        links = stepped.select("word", F.coalesce("further", "root").alias("root"))
        if stepped.where("further is not null").isEmpty():
            break
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(counted_words(table(spark, sf_dir, "documents")))


_UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
#: Near words share what is left of them without one letter: both lose the same place, or the longer one loses one.
ORACLE = f"""with recursive {CRC_TABLE}, r as (select doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[a-zÀ-ÿ]+')) as run from documents where text is not null),
    g as (select doc_id, run, count(*) as n from r group by doc_id, run),
    h as (select run, n, {crc32("coalesce(cast(doc_id as varchar), '') || ':' || run")} as h from g cross join crc_),
    s as (select case when h % 97 = 0 then substr(run, 1, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word, n from h),
    w as materialized (select word, cast(sum(n) as bigint) as n from s where length(word) >= 5 group by word having sum(n) >= 3),
    e as (select word, n, p, substr(word, 1, cast(p as int) - 1) || substr(word, cast(p as int) + 1) as less from (select word, n, unnest(range(1, length(word) + 1)) as p from w) x),
    pairs as (select a.word as a, b.word as b from e a join e b on a.p = b.p and a.less = b.less and a.word <> b.word
        union select e.word, w.word from e join w on w.word = e.less union select w.word, e.word from e join w on w.word = e.less),
    f as (select a as word, count(*) as n_near, arg_min(b, (-w.n, b)) as near, max(w.n) as near_n from pairs join w on w.word = b group by a),
    o as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * w.n then near end as form, case when near_n >= 2 * w.n then near_n end as form_n from w left join f on f.word = w.word),
    c as (select word, word as root, 0 as step from o union all select c.word, o.form, step + 1 from c join o on o.word = c.root where o.form is not null)
    select o.word, form, c.root, n, n_near, form_n from o join (select word, arg_max(root, step) as root from c group by word) c on c.word = o.word"""
