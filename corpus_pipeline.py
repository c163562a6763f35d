"""A training corpus from `documents`: toxic texts out, near-duplicates out, mixed to target weights, encoded.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Null texts count as empty everywhere, empty
tables give empty ones, other columns are carried along unread.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandline.llm.bpe import encode_documents
from strandline.llm.mixing import Repeated, label_domains, mixed_documents
from strandline.llm.near_duplicates import without_near_duplicates
from strandline.llm.shared import shared_folder, written
from strandline.llm.toxicity import without_toxic

#: Shares of tokens by quality; toxic texts are gone by then, so none are asked for. By the classifier 0.91 of sf0.1 are high before.
TARGETS = Repeated(high=0.95, low=0.05)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Equal texts score alike, whatever their ids; without labels everything stays."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8) the smallest id stays. Texts without words stay all; rows without an id
    come after all ids; equal rows of one id stay once."""
    return without_near_duplicates(docs, 5, 80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, which is 1 at least: the mixture is reached by repeating, nothing clean is lost.
    Rows that share an id or have none are repeated alike."""
    return mixed_documents(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS, at_least=1)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row, ids null where they were."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]

#: The stages' model fits can't be put in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, folder, name)
    return docs
