"""Byte-pair encoding and decoding with a frequent-word lexicon.

The lexicon is a minimal acyclic automaton (words share suffixes) that numbers its words; the number
leads to the word's ids. It is compiled once on the driver, sent as a file and memory-mapped, so the
workers of a machine share its pages. Words that it lacks are merged exactly.
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import json
import os
import re
import shutil
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, release, table

#: Words of the lexicon: what stands outside it costs time, never exactness.
LEXICON_WORDS = 100_000
#: Longest word of the lexicon in bytes.
LEXICON_BYTES = 48
#: A word that stands less often in the corpus is no lexicon word.
LEAST_COUNT = 8
#: Words whose ids a worker keeps at hand.
KEPT_WORDS = 600_000
#: Words of like length that are merged together.
MERGED_WORDS = 1 << 14

# fixed values: the two pre-tokenizers' patterns, and the white space they go by
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORD_ENDS = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

#: Texts below this code point are split by plain character classes, which are quicker than properties.
_PLAIN = 0x250
_BEYOND = re.compile(f"[^\x00-{chr(_PLAIN - 1)}]")


def _splitter(pattern: str) -> Callable[[str], list[str]]:
    chars = [chr(c) for c in range(_PLAIN)]
    letters, numbers = ("".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == kind) for kind in "LN")
    spaces = "".join(map(re.escape, _SPACE))
    general = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}\\p{{L}}\\p{{N}}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))
    quick = re.compile(pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]").replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))
    return lambda text: (general if _BEYOND.search(text) else quick).findall(text)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Pairs:
    """Rank and merged id by pair of ids: a hash table that many pairs look up at once."""

    SLOTS = 1 << 18

    def __init__(self, merges: list[tuple[int, int, int, int]]) -> None:
        a, b, rank, made = (np.asarray(x, np.int64) for x in zip(*merges, strict=True))
        size = max(self.SLOTS, 1 << (4 * len(a)).bit_length())
        self.none, self.mask = len(a), size - 1
        self.keys, self.ranks, self.made = np.full(size, -1, np.int64), np.full(size, self.none, np.int32), np.full(size, -1, np.int32)
        key, todo, self.probes = a << 32 | b, np.arange(len(a)), 0
        while len(todo):
            slot = self._slot(key[todo], self.probes)
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.ranks[slot[won]], self.made[slot[won]] = key[todo[won]], rank[todo[won]], made[todo[won]]
            todo, self.probes = np.delete(todo, won), self.probes + 1

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        return (((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) + probe) & self.mask

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)).ravel()
        key[(a < 0).ravel() | (b < 0).ravel()] = -2
        slot = self._slot(key, 0)
        held = self.keys[slot]
        hit = held == key
        ranks, made = np.where(hit, self.ranks[slot], np.int32(self.none)), np.where(hit, self.made[slot], np.int32(-1))
        todo, probe = np.flatnonzero(~hit & (held != -1) & (key != -2)), 1
        while len(todo) and probe < self.probes:
            slot = self._slot(key[todo], probe)
            held = self.keys[slot]
            hit = held == key[todo]
            ranks[todo[hit]], made[todo[hit]] = self.ranks[slot[hit]], self.made[slot[hit]]
            todo, probe = todo[~hit & (held != -1)], probe + 1
        return ranks.reshape(a.shape), made.reshape(a.shape)


class Vocabulary:
    """A tokenizer file of byte-level BPE, with or without an end-of-word suffix."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._chars = _byte_chars()
        self._split = _splitter(_WORD_ENDS if self.suffix else _BYTE_LEVEL)
        self._parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._normal = None
        if spec.get("normalizer"):
            from tokenizers import Tokenizer

            self._normal = Tokenizer.from_str(content.decode()).normalizer
        byte_of = {c: b for b, c in enumerate(self._chars)}
        self._first = np.asarray([self.ids.get(c, -1) for c in self._chars], np.int32)
        self._last = np.asarray([self.ids.get(c + self.suffix, -1) for c in self._chars], np.int32)
        self._whole = bool((self._first >= 0).all() and (self._last >= 0).all())
        self._pairs = Pairs([(self.ids[a], self.ids[b], r, self.ids[a + b]) for (a, b), r in self.ranks.items()])
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in self.ids.items() if all(c in byte_of for c in token)} | {i: t.encode() for t, i in self.special.items()}

    def words(self, text: str) -> list[str]:
        """The pre-tokens of text in order; special tokens' strings are words of their own."""
        if self._parts is None or not any(s in text for s in self.special):
            return self._split(self._fold(text))
        out: list[str] = []
        for i, part in enumerate(self._parts.split(text)):
            out += [part] if i % 2 else self._split(self._fold(part))
        return out

    def _fold(self, text: str) -> str:
        if self._normal is None:
            return text
        if _BEYOND.search(text) or not unicodedata.is_normalized("NFC", text):
            return self._normal.normalize_str(text)
        return text.lower()

    def merge(self, word: str) -> list[int]:
        """The ids of one pre-token by the merges in order of rank, leftmost first."""
        return self.merge_all([word])[0]

    def merge_all(self, words: list[str], code: str | None = None) -> list:
        """The ids of each word, as a list or as bytes of an array code. Words of like length are merged together, one
        merge a word and step."""
        out: list = [b"" if code else []] * len(words)
        made = (lambda ids: array(code, ids).tobytes()) if code else list
        coded = [w.encode() for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(words))
        if self.special:
            for i, w in enumerate(words):
                if w in self.special:
                    out[i], sizes[i] = made([self.special[w]]), 0
        for lo, hi in ((1, 6), (7, 10), (11, 16), (17, 32), (33, 64)):
            fitting = np.flatnonzero((sizes >= lo) & (sizes <= hi))
            for first in range(0, len(fitting), MERGED_WORDS):
                rows = fitting[first : first + MERGED_WORDS]
                self._merge_rows([coded[i] for i in rows], sizes[rows], rows, out, code, made)
        for i in np.flatnonzero(sizes > 64):
            parts = [self._chars[b] for b in coded[i]]
            parts[-1] += self.suffix
            out[i] = made([self.ids[p] for p in self._merge_long(parts) if p in self.ids])
        return out

    def _merge_rows(self, words: list[bytes], sizes: np.ndarray, rows: np.ndarray, out: list, code: str | None, made: Callable[[list[int]], object]) -> None:
        n, width = len(words), int(sizes.max())
        flat = np.frombuffer(b"".join(words), np.uint8)
        column = np.arange(width)
        inside = column < sizes[:, None]
        symbols = np.full((n, width + 1), -1, np.int32)
        symbols[:, :-1][inside] = self._first[flat]
        symbols[np.arange(n), sizes - 1] = self._last[flat[np.cumsum(sizes) - 1]]
        ranks, merged = np.full((n, width), len(self.ranks), np.int32), np.full((n, width), -1, np.int32)
        pair = column < sizes[:, None] - 1
        ranks[pair], merged[pair] = self._pairs.find(symbols[:, :-1][pair], symbols[:, 1:][pair])
        left, none = np.arange(n), len(self.ranks)
        while len(left):
            at = ranks.argmin(1)
            row = np.arange(len(left))
            going = ranks[row, at] < none
            if not going.all():
                ended = symbols[~going]
                counts = (ended >= 0).sum(1).tolist()
                ends = rows[left[~going]].tolist()
                if code and self._whole:  # each word's ids are a slice of the rows' bytes
                    wide = ended.astype(f"<u{array(code).itemsize}")
                    flat, step, size = wide.tobytes(), wide.strides[0], wide.itemsize
                    for i, k, count in zip(ends, range(0, len(flat), step), counts, strict=True):
                        out[i] = flat[k : k + count * size]
                else:
                    for i, ids, count in zip(ends, ended.tolist(), counts, strict=True):
                        out[i] = made(ids[:count] if self._whole else [x for x in ids if x >= 0])
                left, symbols, ranks, merged, at = left[going], symbols[going], ranks[going], merged[going], at[going]
                row = np.arange(len(left))
                if not len(left):
                    break
            symbols[row, at] = merged[row, at]
            behind = column[None, :] > at[:, None]  # what stands behind the merged pair moves up
            symbols[:, :-1] = np.where(behind, symbols[:, 1:], symbols[:, :-1])
            symbols[:, -1] = -1
            ranks[:, :-1] = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            merged[:, :-1] = np.where(behind[:, :-1], merged[:, 1:], merged[:, :-1])
            ranks[:, -1] = none
            ranks[row, at], merged[row, at] = self._pairs.find(symbols[row, at], symbols[row, at + 1])
            back = np.flatnonzero(at > 0)
            ranks[back, at[back] - 1], merged[back, at[back] - 1] = self._pairs.find(symbols[back, at[back] - 1], symbols[back, at[back]])

    def _merge_long(self, parts: list[str]) -> list[str]:
        """Merges by a heap over linked symbols, for words of any length."""
        n, ranks = len(parts), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (parts[a], parts[b])) in ranks:
                    heapq.heappush(heap, (ranks[p], a, p))
        return [p for p in parts if p]


_LOADED: dict[bytes, Vocabulary] = {}


def vocabulary(content: bytes) -> Vocabulary:
    """Parsed once in each process."""
    key = hashlib.sha256(content).digest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(content)
    return _LOADED[key]


class Lexicon:
    """A minimal acyclic automaton over words' bytes that numbers its words, and their ids.

    Arrays: byte class by byte; next state by state and class (0: none, 1: start); how many words come
    before a transition's words; accepting states; ids and where each word's begin.
    """

    NAMES = ("classes", "next", "before", "accepts", "begin", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        for name in self.NAMES:
            setattr(self, name, arrays[name])

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        words = sorted(w for w in entries if w)
        used = sorted({b for w in words for b in w})
        classes = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)
        classes[used] = np.arange(1, len(used) + 1)
        # states as [accepts, {class: state}]; equal ones are merged as soon as they are complete
        known: dict[tuple, list] = {}
        root: list = [False, {}]
        path: list[list] = [root]

        def close(depth: int, last: bytes) -> None:
            while len(path) - 1 > depth:
                state = path.pop()
                key = (state[0], *((c, id(s)) for c, s in state[1].items()))
                path[-1][1][int(classes[last[len(path) - 1]])] = known.setdefault(key, state)

        last = b""
        for word in words:
            shared = len(os.path.commonprefix([word, last]))
            close(shared, last)
            for b in word[shared:]:
                path.append([False, {}])
                path[-2][1][int(classes[b])] = path[-1]
            path[-1][0] = True
            last = word
        close(0, last)
        number, order, todo = {id(root): 1}, [root], [root]
        while todo:
            for s in todo.pop()[1].values():
                if id(s) not in number:
                    number[id(s)] = len(number) + 1
                    order.append(s)
                    todo.append(s)
        below: dict[int, int] = {}

        def count(state: list) -> int:  # depth is at most LEXICON_BYTES
            if id(state) not in below:
                below[id(state)] = int(state[0]) + sum(count(s) for s in state[1].values())
            return below[id(state)]

        count(root)
        shape = (len(order) + 1, len(used) + 1)
        after, before, accepts = np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape[0], bool)
        for state in order:
            at, seen = number[id(state)], int(state[0])
            accepts[at] = state[0]
            for c in sorted(state[1]):
                after[at, c], before[at, c] = number[id(state[1][c])], seen
                seen += below[id(state[1][c])]
        begin = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(entries[w]) for w in words], out=begin[1:]) if words else None
        ids = np.asarray([i for w in words for i in entries[w]], np.int32)
        return cls({"classes": classes, "next": after, "before": before, "accepts": accepts, "begin": begin, "ids": ids})

    def save(self, path: str) -> None:
        arrays = [np.ascontiguousarray(getattr(self, n)) for n in self.NAMES]
        head = json.dumps([[n, a.dtype.str, list(a.shape)] for n, a in zip(self.NAMES, arrays, strict=True)]).encode()
        with open(path, "wb") as f:
            f.write(len(head).to_bytes(8, "little") + head)
            for a in arrays:
                f.write(b"\0" * (-f.tell() % 64))
                a.tofile(f)

    @classmethod
    def load(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            n = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(n))
        at, arrays = 8 + n, {}
        for name, kind, shape in head:
            at += -at % 64
            size = int(np.prod(shape)) * np.dtype(kind).itemsize
            arrays[name] = np.memmap(path, kind, "r", at, tuple(shape)) if size else np.zeros(shape, kind)
            at += size
        return cls(arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words, -1 for those that the lexicon lacks; all words walk at once."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(length) - length
        out = np.full(len(words), -1, np.int64)
        live = np.flatnonzero((length > 0) & (length <= LEXICON_BYTES))
        state, number = np.ones(len(live), np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            kind = self.classes[data[start[live] + step]]
            number += self.before[state, kind]
            state = self.next[state, kind].astype(np.int64)
            step += 1
            ended = (length[live] == step) & (state > 0)
            done = ended & self.accepts[state]
            out[live[done]] = number[done]
            on = (state > 0) & ~ended
            live, state, number = live[on], state[on], number[on]
        return out

    def word_ids(self, number: int) -> list[int]:
        return self.ids[self.begin[number] : self.begin[number + 1]].tolist()


class Encoder:
    """Ids of texts: words of the lexicon by the automaton, others by merges; recent words are kept."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None, entry: Callable[[list[int]], object], code: str | None = None) -> None:
        self.vocab, self.lexicon, self.entry, self.code = vocab, lexicon, entry, code
        self.kept: dict[str, object] = {}

    def entries(self, words: list[list[str]]) -> Callable[[str], object]:
        """A function that gives what entry makes of the ids, for every word of the given lists."""
        now = set().union(*words)
        new = now - self.kept.keys()
        if len(self.kept) + len(new) > KEPT_WORDS:  # what stands in these texts is kept
            self.kept = {w: self.kept[w] for w in now - new}
        ordered = list(new)
        numbers = self.lexicon.find([w.encode() for w in ordered]).tolist() if self.lexicon is not None else [-1] * len(ordered)
        unseen = [w for w, number in zip(ordered, numbers, strict=True) if number < 0] if self.lexicon is not None else ordered
        merged = self.vocab.merge_all(unseen, self.code)
        self.kept.update(zip(unseen, merged if self.code else map(self.entry, merged), strict=True))
        for word, number in zip(ordered, numbers, strict=True) if len(unseen) < len(ordered) else ():
            if number >= 0:
                self.kept[word] = self.entry(self.lexicon.word_ids(number))
        return self.kept.__getitem__


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(content: bytes, lexicon: str | None, kind: str) -> Encoder:
    """The process's encoder: a later task of the same worker finds the words that an earlier one met.

    kind: text for decimal ids joined by commas, or the array code of little-endian binary ids.
    """
    key = (hashlib.sha256(content).digest(), lexicon, kind)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        entry = (lambda ids: ",".join(map(str, ids))) if kind == "text" else (lambda ids: array(kind, ids).tobytes())
        _ENCODERS[key] = Encoder(vocabulary(content), Lexicon.load(SparkFiles.get(lexicon)) if lexicon else None, entry, None if kind == "text" else kind)
    return _ENCODERS[key]


def text_groups(texts: list[str | None], most: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of about most characters together, with the first one's place; null as empty."""
    group, size, first = [], 0, 0
    for i, text in enumerate(texts):
        if group and size + len(text or "") > most:
            yield first, group
            group, size, first = [], 0, i
        group.append(text or "")
        size += len(text or "")
    if group:
        yield first, group


def frequent_words(docs: DataFrame, content: bytes, text_col: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """The pre-tokens that stand most often in all of docs, at most `most` of them (a bound for the driver)."""
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seen = vocabulary(shared.value), Counter()

        def out() -> pa.RecordBatch:
            words = [w for w in seen if len(w) <= LEXICON_BYTES]
            return pa.record_batch([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(vocab.words(text.as_py() or ""))
                if len(seen) > KEPT_WORDS // 2:
                    yield out()
                    seen.clear()
        yield out()

    words = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").mapInArrow(count, "word string, n bigint")
    often = cut(words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT))
    # the least count that leaves at most `most` words, from a few hundred bands of counts
    band = F.floor(F.log2("n") * 16).cast("int")
    least, total = None, 0
    for row in often.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("band")).collect():
        total += row["words"]
        if total > most:
            break
        least = row["band"]
    return sorted(r.word for r in often.where(band >= least).select("word").collect()) if least is not None else []


def ship_lexicon(spark: SparkSession, content: bytes, words: list[str]) -> str:
    """Compile the words' automaton and hand its file to every executor; its name is returned."""
    vocab = vocabulary(content)
    words = [w for w in words if len(w.encode()) <= LEXICON_BYTES]
    lexicon = Lexicon.compile({w.encode(): ids for w, ids in zip(words, vocab.merge_all(words), strict=True)})
    folder = tempfile.mkdtemp(prefix="lodestar-lexicon-")
    atexit.register(shutil.rmtree, folder, True)  # the driver serves the file to executors until it ends
    made = os.path.join(folder, "made")
    lexicon.save(made)
    with open(made, "rb") as f:
        name = f"lexicon-{hashlib.sha256(f.read()).hexdigest()[:24]}.bin"
    os.rename(made, os.path.join(folder, name))
    if not any(os.path.basename(p) == name for p in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(id, ids array<int>, decoded string) for each row: ids of the whole text, and their decoding.

    Null and empty texts have no ids. One row for each row of docs, repeated and null ids included;
    other columns are left out. The strings of special tokens in a text are those tokens.
    """
    return _encode(docs, tokenizer_path, id_col, text_col, lexicon_words, digests=False)


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what encode_documents returns, made where it is made."""
    return _encode(docs, tokenizer_path, id_col, text_col, lexicon_words, digests=True)


def decode(bytes_of: dict[str, bytes], ids: str) -> str:
    """The text of decimal ids joined by commas; ids that the vocabulary lacks are an error."""
    return b"".join(map(bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


def _encode(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, lexicon_words: int, digests: bool) -> DataFrame:
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    spark = docs.sparkSession
    name = ship_lexicon(spark, content, frequent_words(docs, content, text_col, lexicon_words)) if lexicon_words else None
    shared = spark.sparkContext.broadcast(content)  # the tokenizer's file, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        words_of = encoder(shared.value, name, "text")
        bytes_of = {str(i): b for i, b in vocab.bytes_of.items()}
        for batch in batches:
            for first, group in text_groups(batch.column(1).to_pylist()):
                words = [vocab.words(t) for t in group]
                get = words_of.entries(words)
                ids = [",".join(filter(None, map(get, w))) for w in words]
                texts = [decode(bytes_of, i) for i in ids]
                own = batch.column(0).slice(first, len(group))
                if digests:
                    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                    columns = [pa.array([i.count(",") + 1 if i else 0 for i in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, texts), pa.string())]
                    yield pa.record_batch([own, *columns], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.record_batch([own, pa.array([[int(x) for x in i.split(",")] if i else [] for i in ids], pa.list_(pa.int32())), pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])
        release()

    schema = f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else f"{id_col} bigint, ids array<int>, decoded string"
    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
