"""A training-data pipeline over documents: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
docs. Between stages the rows are written as Parquet and read again, and each begins by freeing what those before left
behind on the driver.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, line_dedup, minhash_dedup, mixing, packing
from tessera.llm.shared import delete_folder, drop_tables, release, shared_dir, sided, tables_written


def _without(docs: DataFrame, rejected: DataFrame, key: Column | None = None) -> DataFrame:
    """docs without the rows whose doc_id (and key) is rejected."""
    side = sided(rejected.distinct().withColumnsRenamed({c: f"__pipeline_{c}" for c in rejected.columns}))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__pipeline_doc_id"))
    return docs.join(side, same & (key == F.col("__pipeline_text_key")) if key is not None else same, "left_anti")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go."""
    release(spark)
    key = F.xxhash64("text")
    judged = language_id.identify_documents(docs, key)
    return _without(docs, judged.where("not accepted").select("doc_id", "text_key"), key)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that came earlier; n_chars, where docs has it, is the new text's."""
    release(spark)
    kept = line_dedup.dedup_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    A document is named by its doc_id and text together, so rows without an id, or with one id and different texts, are
    judged each; rows that are equal in both stay or go together.
    """
    release(spark)
    key = F.xxhash64("doc_id", "text")
    groups = minhash_dedup.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    side = sided(groups.where("not kept").select(F.col("doc_id").alias("__pipeline_key")).distinct())
    return docs.join(side, key == F.col("__pipeline_key"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    release(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, opened and numbered in the order of the mixture: that of the rows in docs' files."""
    release(spark)
    try:
        place = docs.select("*", F.col("_metadata.file_name").alias("__pipeline_file"), F.col("_metadata.row_index").alias("__pipeline_row"))
    except AnalysisException:  # rows that aren't read from files have no order
        return packing.pack(docs, seeds=packing.SEEDS)
    part = F.regexp_extract("__pipeline_file", r"part-(\d+)", 1)
    return packing.pack(place, order=[part.try_cast("long"), F.col("__pipeline_row")], seeds=packing.SEEDS)


STAGES = [
    ("language ID", keep_known_language),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Likelihoods, schedules and retrieval have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir. What a stage has read and its operator's tables are deleted when it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path, held = f"{folder}/{number}", tables_written(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_tables(spark, held)
        if number:
            delete_folder(spark, f"{folder}/{number - 1}")
        docs = spark.read.parquet(path)
    return docs
