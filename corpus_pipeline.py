"""A corpus from raw documents to tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and gives the rows that go on, as a DataFrame that is written
as Parquet and read again for the next one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawl.llm import bpe_codec, decontamination, language_id, minhash_dedup, toxicity
from pawl.llm.common import delete, quoted, scratch, shared_folder, table


def aside(docs: DataFrame) -> DataFrame:
    """Numbered names for all columns, so that none clashes with what an operator appends."""
    return docs.select(*[quoted(c).alias(f"column_{k}") for k, c in enumerate(docs.columns)])


def numbered(docs: DataFrame, name: str) -> str:
    return f"column_{docs.columns.index(name)}"


def restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"column_{k}").alias(c) for k, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Models learn from the documents' own lang column; what no model takes for its language goes.

    Null texts and texts without letters go. Whole texts are judged, however long; repeated rows stay or
    go alike; an empty table stays empty. Columns are as before, whatever their names.
    """
    models = language_id.fit(docs, F.lit(True))
    return restored(language_id.identify(aside(docs), models, numbered(docs, "text")).where("NOT rejected"), docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A model of the labelled documents judges all; those predicted toxic go.

    Null and empty texts are judged by the share of toxic labels alone. Whole texts are judged, however
    long; repeated rows stay or go alike; an empty table stays empty. Columns are as before.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return restored(toxicity.rate(aside(docs), model, numbered(docs, "text")).where("predicted = 0"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the least id stays, once.

    Rows of one id and text are one document; rows of one id with other texts are others, and each is
    judged by its own text. Documents without words or without an id are in no group and stay, all of
    them. Whole texts are compared, however long; an empty table stays empty. Columns are as before.
    """
    return minhash_dedup.deduplicated(docs, shingle_words=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of texts; documents that are mostly benchmark go.

    Null and empty texts stay. Whole texts are scanned, however long; repeated rows are cut alike; an
    empty table stays empty. Columns are as before; n_chars is counted again where a text was cut.
    """
    cut = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and the digest of what they decode to.

    A null text has no ids. Whole texts are encoded, however long; repeated rows each get a row; an
    empty table stays empty. Other columns are left out.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe_codec.round_trip(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, with_ids=True)
    return found.select("doc_id", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: Trained models and token ids are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows kept as Parquet in the shared folder.

    A stage's checkpoints, and the rows that it read, are deleted when its own have been written; what
    stays is the last stage's rows, from which the result is read.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
