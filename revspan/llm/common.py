"""What several operators share: the checkpoint folder, whole-table inputs and learning folds."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, made the checkpoint folder if none is set.

    Only a session on one machine may go without that setting: it gets a folder of its own."""
    context = spark.sparkContext
    made = context._jsc.sc().getCheckpointDir()
    named = context.getConf().get("spark.checkpoint.dir")
    if made.isEmpty():
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = named or tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(named)
    return (named or made.get()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3; NULL for a NULL doc_id. Remainder 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from. A NULL doc_id counts as not held out."""
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """A row may be learned from when its id is known and not held out."""
    return F.coalesce(fold(doc_id) != 1, F.lit(False))


def spread(column: Column, seed: int) -> Column:
    """A number in [0, 2^31) that depends on the value alone, for repeatable samples."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 33)


def values(batch: pa.RecordBatch, column: str, rows: int = 256) -> Iterator:
    """A column's values, some rows at a time: a batch of texts takes several times its bytes as strings."""
    held = batch.column(column)
    for start in range(0, len(held), rows):
        yield from held.slice(start, rows).to_pylist()


def give_back() -> None:
    """Return memory that was freed to the machine. Allocators keep it, and a worker goes on to tasks of other
    operators, so that without this it holds what the largest of them once took."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """task, after which its worker gives back what it freed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def released_group(task: Callable[[pa.Table], pa.Table]):
    """task on one group, after which its worker gives back what it freed."""
    def run(group: pa.Table) -> pa.Table:
        made = task(group)
        give_back()
        return made

    return run


def free_name(columns: Iterable[str], name: str) -> str:
    """name, or name with underscores after it until no column is called so (case does not tell columns apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


MOST_BITS = 28  # of the broadcast filter: 32 MB
_PAGE = 15  # bits that one row of the filter holds, as a power of two: what bitmap_construct_agg makes


def marked(rows: DataFrame, hits: DataFrame, keys: Sequence[str | Column], of_hits: Sequence[str], mark: str) -> DataFrame:
    """rows with a flag: false only where no hit has these keys, so that most other rows need no shuffle.

    A bit is set for each hit's hashed keys; the bits are broadcast, 2^MOST_BITS / 8 bytes at most. With more
    hits than that serves well, more rows are marked in vain, which a join on the keys puts right."""
    size = min(MOST_BITS, max(_PAGE, (8 * hits.count()).bit_length()))
    at, page, bits = (free_name(rows.columns, n) for n in ("__at", "__page", "__bits"))

    def place(columns: Sequence[str | Column]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(1 << size))

    pages = hits.select(place(of_hits).alias(at)).groupBy(F.shiftright(at, _PAGE).alias(page)).agg(
        F.bitmap_construct_agg(F.col(at).bitwiseAND((1 << _PAGE) - 1)).alias(bits))
    placed = rows.withColumn(at, place(keys)).withColumn(page, F.shiftright(at, _PAGE)).join(F.broadcast(pages), page, "left")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(F.col(at).bitwiseAND((1 << _PAGE) - 1), 3).cast("int") + 1, F.lit(1))),
                  16, 10).cast("int")
    is_set = F.getbit(byte, F.col(at).bitwiseAND(7).cast("int")) == 1
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(is_set, F.lit(False)).alias(mark))
