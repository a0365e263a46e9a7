"""A text corpus through five stages: toxic documents go, one document of each near-duplicate class stays, repeated byte
strings are cut out, documents with benchmark passages go, and the rest is counted and coded as tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet into the shared folder
and hands the reread table to the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyrisk.llm import byte_bpe, decontaminate, simhash_dedup, suffix_dedup, toxicity
from tallyrisk.llm.common import prepare, table, write_out

TOXIC_FROM = 0.3
SHINGLE, RADIUS = 4, 4
REPEAT_BYTES = 100
BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under the threshold. Labels of held-out documents are not learnt from; a label without
    a document is left out. Rows without an id are scored like any other."""
    prepare(spark)
    model = toxicity.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, model, TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, that with the smallest id. A row without an id stays if its class has no ids and no
    smaller row; rows of one id are told apart by their texts."""
    prepare(spark)
    return simhash_dedup.keep_first(docs, simhash_dedup.near_duplicates(docs, SHINGLE, RADIUS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat earlier ones; n_chars follows the text. A document that loses all of its
    text goes, one that was empty before stays. A character that is cut in two is dropped."""
    prepare(spark)
    return suffix_dedup.cut_documents(docs, REPEAT_BYTES)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Each row is judged by its own text, whatever its id."""
    prepare(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of the token ids and of the bytes that decoding them gives; a null text is empty."""
    prepare(spark)
    return byte_bpe.round_trip(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", encode),
]

# A trained classifier and linked components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, on the whole documents table."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_out(partial(stage, spark)(docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
