"""Documents to training tokens in five stages, each an operator of revspan.llm on what the last one kept."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from revspan.llm import line_dedup, mixing, ngram_join, queries, sentencepiece_codec, toxicity
from revspan.llm.common import free_name, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its limit; it learns from the labels of sf_dir.

    NULL and empty texts are scored as texts without n-grams; equal texts go or stay together."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share; n_chars follows the text.

    NULL texts stay NULL, empty ones empty; repeated rows each stay."""
    kept = line_dedup.without_repeated_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id, whole rows.

    Rows without doc_id cannot be told apart and all stay; so do rows that share the smallest doc_id."""
    ids = ngram_join.ngram_jaccard(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: every one once, small sources up to twice.

    In order of progress, from part to part too; ties lie by hash, so that equal progress can be split. Columns with
    the names that mixing adds step aside meanwhile."""
    aside = {c: free_name([*docs.columns, *mixing.ADDED], c) for c in docs.columns if c.lower() in mixing.ADDED}
    mixed = mixing.temperature_mix(docs.withColumnsRenamed(aside), max_passes=queries.MAX_PASSES)
    return mixed.orderBy("progress", F.xxhash64("doc_id", "source"), "doc_id").select(
        *[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def in_written_order(docs: DataFrame) -> DataFrame:
    """Rows by part and place in it where docs is read from files: a scan deals parts out by size."""
    names = {n: free_name(docs.columns, f"__{n}") for n in ("part", "file", "place")}
    try:
        file = F.col("_metadata.file_name")
        placed = docs.select(
            "*", F.expr("try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) AS BIGINT)").alias(names["part"]),
            file.alias(names["file"]), F.col("_metadata.row_index").alias(names["place"]))
    except AnalysisException:  # not read from files
        return docs
    return placed.orderBy(*names.values()).select(*[F.col(f"`{c}`") for c in docs.columns])


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and source with the token ids of the text, and what was verified of them, in the order of the mixture.

    NULL and empty texts have no ids; every row of docs gives one."""
    return sentencepiece_codec.encode(in_written_order(docs), queries._model(), ("doc_id", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", one_of_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", to_tokens),
]

#: Classifier, shingle join and tokens have no counterpart in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
