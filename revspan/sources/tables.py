"""Reading and writing the source tables and the metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from revspan.sources.files import source_files
from revspan.sources.schemas import TableSpec
from revspan.sources.shared import stored

_QUOTING = {"header": True, "escape": '"', "quote": '"'}


def read_table_csv(
    spark: SparkSession, path: str, spec: TableSpec, multiline: bool | None = None
) -> DataFrame:
    """Scan a source CSV by position against its declared schema; malformed rows fail.

    An unquoted empty field is NULL, a quoted one is an empty string. Line breaks inside
    quotes need ``multiline``, which makes Spark read each file in one task, so it is on
    only for tables that declare free text; deliver those as many files.
    """
    multiline = spec.has_free_text if multiline is None else multiline
    # A marker that no text holds: with it the reader keeps "" apart from an empty field.
    return (
        spark.read.schema(spec.schema)
        .options(**_QUOTING, nullValue="\x01", multiLine=multiline, mode="FAILFAST")
        .csv(path)
    )


def with_surrogate_key(table: DataFrame, key: str) -> DataFrame:
    """Add a unique, not consecutive, long key in front, in one pass. It follows the input splits, so a
    recomputation elsewhere may differ; loaded tables get with_dense_key instead."""
    return table.select(F.monotonically_increasing_id().alias(key), "*")


def with_dense_key(table: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Add the key 1, 2, ... n in front, in the declared order; columns that are not named break ties.

    Two passes: the rows are stored in ranges of the order, sorted, with range and place; then each range
    starts where the counts of those before it end. Rows alike in all columns are interchangeable, so a
    second load gives the same numbers, whatever ranges Spark has sampled. No task orders more than a range.
    """
    order = [*order, *[c for c in table.columns if c not in order]]
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # the range's number above 33 bits, the place in it below
    ranged = table.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = stored(ranged.select(
        "*", F.shiftright(at, 33).alias("__range"), at.bitwiseAND(2**33 - 1).alias("__place")), "ranges")
    counts = placed.groupBy("__range").agg(F.count("*").alias("n"))
    add = lambda done, c: F.struct(
        (done.total + c.n).alias("total"),
        F.concat(done.starts, F.array(F.struct(c["__range"].alias("__range"), done.total.alias("before")))).alias("starts"))
    nothing = F.expr("named_struct('total', 0L, 'starts', cast(array() as array<struct<__range: bigint, before: bigint>>))")
    starts = counts.agg(F.array_sort(F.collect_list(F.struct("__range", "n"))).alias("ranges")).select(
        F.inline(F.aggregate("ranges", nothing, add).starts))
    numbered = placed.join(starts, "__range")
    return numbered.select((F.col("before") + F.col("__place") + 1).alias(key), *table.columns)


#: A file whose free text may hold line breaks is one task's work: larger ones are refused.
MOST_FREE_TEXT = 512 * 2**20


def _check_splits(table: DataFrame, spec: TableSpec, most: int) -> None:
    files = source_files([table])
    too_big = [f for f in files if f.size > most]
    if too_big:
        needed = -(-sum(f.size for f in files) // most)
        raise ValueError(
            f"{spec.name}: {len(too_big)} of {len(files)} files are over {most} bytes, and files with free text cannot be "
            f"split; deliver at least {needed} files of up to {most} bytes")


def load_table(
    spark: SparkSession, path: str, spec: TableSpec, target: str, most_free_text: int = MOST_FREE_TEXT
) -> DataFrame:
    """Full refresh of one table: CSV in, typed Parquet at ``target`` out.

    A declared surrogate key is dense and the same on every load. Tables with free text must come in files of
    at most ``most_free_text`` bytes; a larger one raises and says how many files are needed."""
    table = read_table_csv(spark, path, spec)
    if spec.has_free_text:
        _check_splits(table, spec, most_free_text)
    if spec.surrogate_key:
        table = with_dense_key(table, spec.surrogate_key, spec.surrogate_order)
    table.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def write_csv(table: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header. ``single_file`` is for metric tables of a few rows per month."""
    out = table.coalesce(1) if single_file else table
    out.write.mode("overwrite").options(**_QUOTING).csv(path)


def write_by_month(table: DataFrame, path: str) -> None:
    """Parquet partitioned by month_start, so that a month range reads only its months.

    Rebalancing gathers a month's rows into few files and splits a month that is too big
    for one task.
    """
    (
        table.hint("rebalance", "month_start")
        .write.mode("overwrite").partitionBy("month_start").parquet(path)
    )


def _if_present(scan) -> DataFrame | None:
    try:
        return scan()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_metric_csv(
    spark: SparkSession, path: str, schema: StructType | Sequence[tuple[str, str]]
) -> DataFrame | None:
    """A metric table written by ``write_csv``; None if there is none yet. The schema says
    which columns are dates, so no column is guessed from its name."""
    if not isinstance(schema, StructType):
        schema = ", ".join(f"`{name}` {kind}" for name, kind in schema)
    return _if_present(
        lambda: spark.read.schema(schema).options(**_QUOTING, mode="FAILFAST").csv(path)
    )


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per row. NULL fields are kept, so every document has all fields."""
    documents.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """JSON documents, one per line; None if there are none yet."""
    return _if_present(lambda: spark.read.schema(schema).json(path, mode="FAILFAST"))


def read_pretty_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """A single indented JSON document per file."""
    return _if_present(
        lambda: spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    )
