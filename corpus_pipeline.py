"""A corpus for training, stage by stage: each takes the documents that the one before kept.

Every stage is (spark, docs, sf_dir) -> DataFrame. Its result is written as
Parquet to the shared checkpoint folder and read again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bytewren.llm import bpe, mixing, secret_scan, simhash, toxicity
from bytewren.llm.common import table
from bytewren.llm.queries import RANKS, WORDS


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on the labels finds toxic go.

    Null and empty texts stay unless the labels make nothing toxic; a label whose
    document is gone, null labels and repeated rows do no harm. An empty table gives no rows.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the first of its rows.

    Similar are texts whose sets of five-word shingles have a Jaccard similarity
    of 0.8 or more. Null, empty and wordless texts are one group; ids may be null
    or repeated. An empty table gives no rows.
    """
    return simhash.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, and n_chars follows.

    What is a word, and so no secret, is learnt from all of ``docs``. Null texts
    stay null. An empty table gives no rows.
    """
    ranks = secret_scan.dictionary(docs, vocabularies=[public_tokenizers.path(w) for w in WORDS])
    return secret_scan.redacted(docs, ranks=ranks)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources come near their targets.

    Null texts have no words, null sources are one source, rows with equal ids are
    taken together. An empty table gives no rows.
    """
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids; the digest of the text decoded from them shows that nothing was lost.

    A null text has no ids. An empty table gives no rows.
    """
    done = bpe.tokenised(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return done.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: SQL can neither train the classifier nor run the merges; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
