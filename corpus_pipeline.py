"""From documents to packed token sequences: five stages, each on all that the one before it kept.

Language ID drops texts without a known main language; the quality classifier drops what scores under
its threshold; SimHash keeps one document of each group of near copies; substring dedup takes repeated
passages out of the texts; best-fit packing lays the tokens into sequences. Each stage takes a table
with the columns of documents and any others; all but the last return its columns.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestar import ship
from lodestar.llm.common import bound_batches, checkpoint_folder, remove_folder, sweep, table
from lodestar.llm.language import fit_languages, keep_known
from lodestar.llm.packing import pack_documents
from lodestar.llm.quality import fit_quality, keep_good
from lodestar.llm.simhash import keep_one_of_each
from lodestar.llm.word_paths import without_repeats


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is mainly in a learned language; null, empty and letterless texts go. No rows give none."""
    bound_batches(spark)
    return keep_known(docs, fit_languages(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score at least the threshold; a null text scores as an empty one. Ids may be null or repeat."""
    bound_batches(spark)
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies; rows that repeat a kept id and rows without an id stay."""
    bound_batches(spark)
    return keep_one_of_each(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without words that a window of 20 repeats; a null text stays null, an empty one empty."""
    bound_batches(spark)
    return without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its token ids and its place; null and empty texts give the end id."""
    bound_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("substrings", no_repeats),
    ("packing", packed),
]

#: SQL expresses none of the stages; tests/llm holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what one keeps is written to the shared folder and read by the next.

    A stage's table is deleted when the next one is written, and so are its shuffle files; the last stage's input stays
    for the result.
    """
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                remove_folder(spark, before)
            before = f"{folder}/{name}"
            sweep(spark)
    return docs
