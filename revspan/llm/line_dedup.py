"""Line deduplication by range-partitioned hashes and a sorted stream.

Every line becomes (hash of its key, document, position). The rows are range-partitioned by hash and
document and sorted by hash, document and position, so a common line may run over several
partitions and no task holds more than its range. One pass over each partition decides the runs it
sees whole; only the first and last run of a partition wait for their neighbours' counts. What
comes back per document is a compressed bitmap of the lines that stay, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from revspan.llm.common import checkpointed, free_name, marked, released, shuffle_partitions, values

#: The white space that is stripped from both ends of a line to make its key.
BLANKS = b" \t\n\x0b\x0c\r"

#: Stands for a missing doc_id, so that it sorts first and can be joined on.
NO_ID = -(2**63)

ROWS = 1_000  # documents whose lines are held before they are handed on

_LINES = "h1 long, h2 long, doc long, body long, pos int"
_FOUND = "h1 long, h2 long, doc long, body long, pos int, n_docs long"


def _identified(docs: DataFrame) -> DataFrame:
    """doc and body (hash of the text) identify a document; rows alike in both are one document."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("body"), F.col("text"),
    )


def line_keys(text: str | None) -> list[bytes]:
    """Keys of a text's lines: stripped, A-Z lower-cased, UTF-8."""
    return [line.strip(BLANKS) for line in (text or "").encode().lower().split(b"\n")]


def _hash_lines(min_chars: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            digests, owners, places = [], [], []
            for i, text in enumerate(values(batch, "text")):
                for pos, key in enumerate(line_keys(text)):
                    if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        owners.append(i)
                        places.append(pos)
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            owners = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column("doc").take(owners),
                 batch.column("body").take(owners), pa.array(places, pa.int32())],
                names=["h1", "h2", "doc", "body", "pos"],
            )

    return hashed


class _Run:
    """Occurrences of one hash at the edge of what has been streamed so far."""

    def __init__(self, h1: int, h2: int, first: bool):
        self.h1, self.h2, self.first = h1, h2, first
        self.docs, self.last, self.waiting = 0, None, []


def _decide_runs(min_docs: int):
    """Stream a sorted partition; give the lines of frequent runs, and open runs with their counts.

    Rows: a decided line has no hash; a line of an open run has its hash; a count has pos -1."""

    def rows(h1, h2, doc, body, pos, n_docs=None) -> pa.RecordBatch:
        n = len(pos)
        column = lambda value: pa.nulls(n, pa.int64()) if value is None else pa.array(np.full(n, value))
        return pa.RecordBatch.from_arrays(
            [column(h1), column(h2), pa.array(doc), pa.array(body), pa.array(pos, pa.int32()), column(n_docs)],
            names=["h1", "h2", "doc", "body", "pos", "n_docs"],
        )

    def extend(run: _Run, doc, body, pos) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[run.last != (doc[0], body[0])], (doc[1:] != doc[:-1]) | (body[1:] != body[:-1])])
        run.docs += int(new.sum())
        run.last = (doc[-1], body[-1])
        if run.first:
            yield rows(run.h1, run.h2, doc, body, pos)
        elif run.docs >= min_docs:
            for part in [*run.waiting, (doc, body, pos)]:
                yield rows(None, None, *part)
            run.waiting = []
        else:
            run.waiting.append((doc, body, pos))

    def close(run: _Run, at_end: bool) -> Iterator[pa.RecordBatch]:
        if at_end:
            for part in run.waiting:
                yield rows(run.h1, run.h2, *part)
        if at_end or run.first:
            yield rows(run.h1, run.h2, np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([-1]), run.docs)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, body, pos = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc", "body", "pos"))
            starts = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
            ends = np.append(starts[1:], len(h1))
            if run is not None and (run.h1, run.h2) == (h1[0], h2[0]):
                yield from extend(run, doc[: ends[0]], body[: ends[0]], pos[: ends[0]])
                starts, ends = starts[1:], ends[1:]
            if not len(starts):
                continue
            if run is not None:
                yield from close(run, at_end=False)
            elif len(starts) > 1:
                run = _Run(h1[0], h2[0], first=True)
                yield from extend(run, doc[: ends[0]], body[: ends[0]], pos[: ends[0]])
                yield from close(run, at_end=False)
                starts, ends = starts[1:], ends[1:]
            if len(starts) > 1:  # whole runs between the edges
                low, high = starts[0], starts[-1]
                new = np.concatenate([[True], (doc[low + 1: high] != doc[low: high - 1])
                                      | (body[low + 1: high] != body[low: high - 1])])
                new[starts[:-1] - low] = True
                docs = np.add.reduceat(new, starts[:-1] - low, dtype=np.int64)
                often = np.repeat(docs >= min_docs, ends[:-1] - starts[:-1])
                if often.any():
                    yield rows(None, None, *(x[low:high][often] for x in (doc, body, pos)))
            last = starts[-1]
            run = _Run(h1[last], h2[last], first=run is None)
            yield from extend(run, doc[last:], body[last:], pos[last:])
        if run is not None:
            yield from close(run, at_end=True)

    return stream


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc, body, pos) of every line whose key is in at least min_docs documents."""
    lines = _identified(docs).mapInArrow(released(_hash_lines(min_chars)), _LINES)
    parts = shuffle_partitions(docs.sparkSession)
    ranged = lines.repartitionByRange(parts, "h1", "h2", "doc", "body").sortWithinPartitions(
        "h1", "h2", "doc", "body", "pos")
    found = checkpointed(ranged.mapInArrow(released(_decide_runs(min_docs)), _FOUND))
    # At most two counts per partition, so this side is small whatever the data.
    totals = found.where("pos = -1").groupBy("h1", "h2").agg(F.sum("n_docs").alias("total")).where(
        F.col("total") >= min_docs)
    waited = found.where("pos >= 0 and h1 is not null").join(F.broadcast(totals), ["h1", "h2"], "left_semi")
    return found.where("pos >= 0 and h1 is null").unionByName(waited).select("doc", "body", "pos")


def pack_kept(dropped: Sequence[int]) -> bytes:
    """The compressed keep bitmap of a document: bit i is set when line i stays. It ends with the last line
    that goes; all lines after it stay."""
    keep = np.ones(max(dropped, default=-1) + 1, np.bool_)
    keep[list(dropped)] = False
    return zlib.compress(np.int64(len(keep)).tobytes() + np.packbits(keep).tobytes(), 1)


def unpack_kept(bitmap: bytes, n_lines: int) -> np.ndarray:
    (stored,) = np.frombuffer(zlib.decompress(bitmap), "<i8", 1)
    keep = np.ones(n_lines, bool)
    keep[:stored] = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8, offset=8), count=stored)
    return keep


def kept_text(text: str | None, bitmap: bytes) -> str:
    """The text without the lines its bitmap leaves out."""
    lines = (text or "").split("\n")
    keep = unpack_kept(bitmap, len(lines))
    return text or "" if keep.all() else "\n".join(line for line, stays in zip(lines, keep) if stays)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dropped = batch.column("dropped").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(map(len, dropped), pa.int64()), pa.array(map(pack_kept, dropped), pa.binary())],
            names=[*batch.schema.names[:-1], "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc, body, n_dropped, keep_bitmap) of every document that loses a line; checkpointed.

    All that the sorted stream gives back: no text has been touched since its lines were hashed."""
    places = repeated_lines(docs, min_docs, min_chars).groupBy("doc", "body").agg(F.collect_set("pos").alias("dropped"))
    return checkpointed(places.mapInArrow(released(_bitmaps), "doc long, body long, n_dropped long, keep_bitmap binary"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = pack_kept(())
    for batch in batches:
        n_lines = [(t or "").count("\n") + 1 for t in values(batch, "text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text"), pa.array(n_lines, pa.int64()),
             batch.column("n_dropped").fill_null(0), batch.column("keep_bitmap").fill_null(whole)],
            names=["doc_id", "text", "n_lines", "n_dropped", "keep_bitmap"])


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per document row: doc_id, text, n_lines, n_dropped, keep_bitmap.

    Lines whose key (stripped, A-Z lower-cased) of at least min_chars code points is found in at
    least min_docs documents lose all their occurrences. A NULL or empty text is one empty line,
    which always stays. Rows with the same doc_id (or none) and the same text count as one
    document and get the same bitmap. Other columns are not read. An empty table gives no rows.
    Texts that lose nothing are not shuffled, but for a few that a filter lets pass."""
    bitmaps = keep_bitmaps(docs, min_docs, min_chars)
    rows = marked(_identified(docs), bitmaps, ["doc", "body"], ["doc", "body"], "may_lose")
    near = rows.where("may_lose").join(bitmaps, ["doc", "body"], "left")
    columns = ["doc", "text", "n_dropped", "keep_bitmap"]
    both = near.select(*columns).unionByName(rows.where("not may_lose").select("doc", "text"), allowMissingColumns=True)
    return both.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), *columns[1:]).mapInArrow(
        released(_counted), "doc_id long, text string, n_lines long, n_dropped long, keep_bitmap binary")


def _rewritten(bitmap_name: str):
    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            bitmaps = columns.pop(bitmap_name).to_pylist()
            columns["text"] = pa.array(
                [kept_text(t, m) if m else t for t, m in zip(values(batch, "text"), bitmaps)], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rewritten


def without_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with the same columns, whatever their names, repeated lines taken out of text. NULL texts stay NULL.

    Texts that lose nothing are passed on as they are, without a shuffle."""
    names = {n: free_name(docs.columns, f"__{n}") for n in ("doc", "body", "keep_bitmap", "may_lose")}
    bitmaps = keep_bitmaps(docs, min_docs, min_chars).select(*[F.col(n).alias(names[n]) for n in ("doc", "body", "keep_bitmap")])
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64("text")]
    on = [names["doc"], names["body"]]
    rows = marked(docs, bitmaps, key, on, names["may_lose"])
    own = [F.col(f"`{c}`") for c in docs.columns]
    near = rows.where(F.col(names["may_lose"])).withColumns(dict(zip(on, key))).join(bitmaps, on, "left").select(
        *own, names["keep_bitmap"])
    return near.mapInArrow(released(_rewritten(names["keep_bitmap"])), docs.schema).unionByName(
        rows.where(~F.col(names["may_lose"])).select(*own))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        kept = map(kept_text, values(batch, "text"), columns["keep_bitmap"].to_pylist())
        yield pa.RecordBatch.from_arrays(
            [columns["doc_id"], columns["n_lines"], columns["n_dropped"],
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in kept], pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def line_digests(deduped: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 from the rows of line_dedup."""
    return deduped.mapInArrow(released(_digests), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
