"""Token counts of texts by a cache of digests.

A text is normalised as its tokenizer would; the digest of what is left and the digest of the tokenizer's
version lead to a stored count. Only distinct contents that the cache lacks are encoded, and their counts
are appended to it. Texts travel once, and only where their content is missed; everything else goes by
digests of 16 bytes.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _SPACE, encoder, text_groups, vocabulary
from .common import checkpoint_folder, cut, release, remove_folder, salted_join, table

#: The rule of normalisation: a part of the version, since digests of another rule mean other contents.
RULE = "1"
#: The setting that names a cache which outlives a query.
CACHE = "spark.lodestar.tokenCounts"
#: Digests that a task remembers, so that it does not encode a content twice.
REMEMBERED = 1 << 18

_BLANKS = re.compile(f"[{re.escape(_SPACE)}]+")


class Counting:
    """A tokenizer's normal form and counts: a tokenizer file (.json) or a sentencepiece model (.model)."""

    def __init__(self, content: bytes, name: str) -> None:
        self.content, self.vocab = content, None
        if name.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
        else:
            self.vocab = vocabulary(content)

    def normal(self, text: str) -> bytes:
        """Texts with equal results have equal ids; a text with a special token's string stays as it is."""
        if self.vocab is None or not self.vocab.suffix or any(s in text for s in self.vocab.special):
            return b"=" + text.encode()
        # words end where white space begins, and white space itself is dropped
        return b"~" + _BLANKS.sub(" ", self.vocab._fold(text)).strip(" ").encode()

    def count(self, texts: list[str]) -> list[int]:
        if self.vocab is None:
            return [len(ids) for ids in self.pieces.encode(texts, num_threads=1)]
        words = [self.vocab.words(t) for t in texts]
        get = encoder(self.content, None, "I").entries(words)
        return [sum(map(len, map(get, w))) // 4 for w in words]


_COUNTING: dict[bytes, Counting] = {}


def counting(content: bytes, name: str) -> Counting:
    """The process's counter for a tokenizer."""
    key = hashlib.sha256(content).digest()
    if key not in _COUNTING:
        _COUNTING.clear()
        _COUNTING[key] = Counting(content, name)
    return _COUNTING[key]


def digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def version(tokenizer_path: str) -> str:
    """The digest of a tokenizer's version: its file and the rule of normalisation."""
    with open(tokenizer_path, "rb") as f:
        return hashlib.sha256(RULE.encode() + b":" + f.read()).hexdigest()


def stored_counts(spark: SparkSession, cache: str, of: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds for a version; a cache that is not there yet is empty.

    Runs that append at the same time may store a content twice: each digest comes once.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/version={of}")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    return spark.read.schema("digest binary, n_tokens bigint").parquet(f"{cache}/version={of}").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of docs, by the counts that the cache holds or gets.

    cache is a folder that all executors share. A null text counts as empty: no bytes, no tokens. Rows with
    repeated or null ids are counted each by itself; other columns are left out. No rows give none, and
    add nothing to the cache. Special tokens' strings in a text are those tokens, as the library has them.
    A content that very many rows hold is met by partial sums first, and its rows are dealt out by salts
    where they get their count.
    """
    spark, name = docs.sparkSession, tokenizer_path.rsplit("/", 1)[-1]
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    shared, of = spark.sparkContext.broadcast(content), version(tokenizer_path)  # the tokenizer's file, a fixed size
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.select("id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.xxhash64("text").alias("raw"), "text")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = counting(shared.value, name).normal
        for batch in batches:
            for first, group in text_groups(batch.column(3).to_pylist()):
                own = [batch.column(k).slice(first, len(group)) for k in range(3)]
                yield pa.record_batch([*own, pa.array([digest(normal(t)) for t in group], pa.binary())], names=["id", "n_bytes", "raw", "digest"])
        release()

    seen = cut(rows.mapInArrow(digests, "id bigint, n_bytes bigint, raw bigint, digest binary"))
    contents = cut(seen.groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("n_bytes", "raw", "id")).alias("least")))
    missed = contents.join(stored_counts(spark, cache, of), "digest", "left_anti").select("least.*")
    folder = f"{checkpoint_folder(spark)}/missed-{uuid.uuid4().hex}"
    # as files, so that Spark knows the size and broadcasts few of them: then no text travels
    missed.write.parquet(folder)
    missed = spark.read.parquet(folder)
    if not missed.isEmpty():
        _append(rows, missed, lambda: counting(shared.value, name), cache, of)
    remove_folder(spark, folder)
    found = salted_join(seen.select("id", "n_bytes", "digest"), stored_counts(spark, cache, of), ["digest"], "left", contents.select("digest", "_n"))
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _append(rows: DataFrame, missed: DataFrame, get: Callable[[], Counting], cache: str, of: str) -> None:
    """Encode one text of each missed content and append the counts.

    A content's text is that of its least (n_bytes, raw, id). Rows that agree in these are one and the same,
    or another content whose count does no harm.
    """
    wanted = missed.select(*(F.col(c).alias(f"_{c}") for c in missed.columns))
    same = (F.col("n_bytes") == F.col("_n_bytes")) & (F.col("raw") == F.col("_raw")) & F.col("id").eqNullSafe(F.col("_id"))
    texts = rows.join(wanted, same, "left_semi").select("text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, done = get(), set()
        for batch in batches:
            for _, group in text_groups(batch.column(0).to_pylist()):
                new = {}
                for t in group:
                    d = digest(tokens.normal(t))
                    if d not in done:
                        new[d] = t
                if len(done) > REMEMBERED:
                    done.clear()
                done.update(new)
                yield pa.record_batch([pa.array(list(new), pa.binary()), pa.array(tokens.count(list(new.values())), pa.int64())], names=["digest", "n_tokens"])
        release()

    made = texts.mapInArrow(encode, "digest binary, n_tokens bigint").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    made.write.mode("append").parquet(f"{cache}/version={of}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the cache that the session names in spark.lodestar.tokenCounts; without one, by a new cache for each run."""
    cache = spark.conf.get(CACHE, None) or f"{checkpoint_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)
