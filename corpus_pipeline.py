"""The corpus pipeline: documents through five operators of ``pricetide.llm``, each one working on what its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``. Nulls, empty texts,
repeated rows and extra columns are treated as the operators' docstrings say; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import langid, linededup, minhash, mixing, packing
from pricetide.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Documents are repeated this often on average, so few fall out of the mixture by a count of zero.
EPOCHS = 2.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on a bounded sample of the labelled rows (``langid.SAMPLE_ROWS``); rejected documents go.

    Rejected are texts without a letter and texts whose n-grams are not those of the labelled texts (``langid.identify``,
    ``familiar``). Where the table has no label at all there is no model, and only texts without letters go.
    """
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs)
    judged = langid.identify(docs, model, "familiar")
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & F.col("familiar")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text."""
    clean = linededup.dedup_lines(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; of each group one row stays, that of the least id.

    Null ids come last; rows of one id are told apart by their texts, as ``dedup_lines`` has merged those equal in both.
    """
    return minhash.near_duplicates(docs.select(*COLUMNS), words=5, threshold=0.8, first="first_of_group").where("first_of_group").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh as their size to the power 0.7; a document appears as often as its Poisson count, ``EPOCHS`` times on
    average. Null texts and sources count as in ``mixing.replicate``; rows that repeat draw the same count."""
    return mixing.replicate(docs.select(*COLUMNS), epochs=EPOCHS).select(*COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their length bucket, batch and place."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("identify_language", identify_language),
    ("dedup_lines", dedup_lines),
    ("drop_near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_batches", pack_batches),
]

# Fitted weights and random hashes have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's result is written as Parquet in the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
