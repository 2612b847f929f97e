"""A training-data pipeline over ``documents``: toxicity, near copies, substrings, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetgrid.llm import jaccard, packing, secrets, substrings, toxicity
from vetgrid.session import small_batches, stage_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored toxic; the model learns from labels as the query ``op4`` does.

    Null and empty texts stay, repeated rows are scored alike, columns of any names are kept.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text").filter(~toxicity.held_out()), labels.filter(~toxicity.held_out()))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Of repeated rows and of several near texts under one id one stays, texts without words all stay.
    """
    small_batches(spark)
    return jaccard.keep_one(docs, width=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that started earlier; untouched texts stay as they are.

    Rows are kept, a null text stays null, and a text may become empty.
    """
    small_batches(spark)
    return _with_text(docs, substrings.kept_texts(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with accepted secrets replaced by a mark; rows are kept, null and empty texts as they are."""
    small_batches(spark)
    return _with_text(docs, secrets.redacted(docs))


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``n_chars`` set to the length of the new text."""
    return changed.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, with the ids of each piece.

    A null or empty text is the end id alone, repeated rows are packed each, and no rows give no pieces.
    """
    small_batches(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

# A trained model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        folder = stage_folder(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
