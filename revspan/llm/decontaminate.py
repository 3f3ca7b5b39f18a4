"""Benchmark passages in documents, by Wu-Manber search for many strings at once.

The strings are the windows of a benchmark's items: runs of ten words, and the whole of a shorter item.
Words are the alphabet. For the strings of one length a table gives, for each block of words that
occurs in them, how far the search may move on; a block that is in none moves it by the whole length
but for the block. A block that ends strings (shift 0) names a bucket by its hash; the strings in it are
found by the hash of the words before the block and compared word by word. Strings of
different lengths have tables of their own, so that a short item does not shorten the moves of the
others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from revspan.llm.common import checkpointed

WINDOW = 10
BLOCK = 3
#: Words of the benchmark that one broadcast may hold: some 100 MB of tables in a worker. A larger benchmark
#: is dealt into parts of about this size, each one pass over the documents.
PART_WORDS = 250_000

#: A-Z lower-cased; ASCII characters other than letters and digits part words; all others belong to them.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

Words = Sequence[bytes]


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


def windows(words: Words, size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    """All stretches of size words; of fewer words, but not none, the whole."""
    if words:
        for at in range(max(1, len(words) - size + 1)):
            yield tuple(words[at: at + size])


class ShiftTables:
    """Wu-Manber tables for strings of one length, each with the numbers of the items that hold it."""

    def __init__(self, length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[int]]] = {}

    def add(self, string: tuple[bytes, ...], item: int) -> None:
        for end in range(self.block, self.length + 1):
            part, rest = string[end - self.block: end], self.length - end
            if rest < self.shift.get(part, self.length):
                self.shift[part] = rest
        bucket = self.buckets.setdefault(string[self.length - self.block:], {})
        bucket.setdefault(string[: self.length - self.block], set()).add(item)

    def occurrences(self, words: Words) -> Iterator[tuple[int, set[int]]]:
        """(place after the occurrence, its items) in page order."""
        length, block, shift, buckets = self.length, self.block, self.shift, self.buckets
        end, n, most = length, len(words), length - block + 1
        while end <= n:
            part = tuple(words[end - block: end])
            move = shift.get(part, most)
            if move:
                end += move
                continue
            items = buckets[part].get(tuple(words[end - length: end - block]))
            if items:
                yield end, items
            end += 1


def build_tables(items: Iterable[str | None], size: int = WINDOW) -> list[ShiftTables]:
    """Tables for each length of string; item i is known by its number."""
    by_length: dict[int, ShiftTables] = {}
    for number, text in enumerate(items):
        for string in windows(split_words(text), size):
            length = len(string)
            if length not in by_length:
                by_length[length] = ShiftTables(length)
            by_length[length].add(string, number)
    return list(by_length.values())


def search(words: Words, tables: Iterable[ShiftTables]) -> tuple[list[tuple[int, int]], set[int]]:
    """Stretches (start, end) of hit words, apart and in order, and the numbers of the items found."""
    found, items = [], set()
    for table in tables:
        for end, numbers in table.occurrences(words):
            start = end - table.length
            if found and found[-1][0] <= start <= found[-1][1]:
                found[-1] = (found[-1][0], max(end, found[-1][1]))
            else:
                found.append((start, end))
            items |= numbers
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged, items


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SEARCHED = ("doc_id long, body long, n_words long, spans array<struct<start: long, end: long>>, items array<string>")


#: Tables of the last part a worker searched, by the broadcast's id, for the next task in it.
_built: dict[int, list[ShiftTables]] = {}


def _tables(part: Broadcast, size: int, key: int) -> list[ShiftTables]:
    if key not in _built:
        _built.clear()
        _built[key] = build_tables((text for _, text in part.value), size)
    return _built[key]


def _searched(part: Broadcast, size: int, all_rows: bool):
    key = part._jbroadcast.id() if part._jbroadcast is not None else id(part)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, ids = _tables(part, size, key), [item for item, _ in part.value]
        for batch in batches:
            rows, n_words, spans, items = [], [], [], []
            for row, text in enumerate(batch.column("text")):
                words = split_words(text.as_py())
                found, numbers = search(words, tables)
                if found or all_rows:
                    rows.append(row)
                    n_words.append(len(words))
                    spans.append([{"start": s, "end": e} for s, e in found])
                    items.append(sorted({ids[i] for i in numbers} - {None}))
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("body").take(rows), pa.array(n_words, pa.int64()),
                 pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "body", "n_words", "spans", "items"])

    return searched


def _parts(benchmark: DataFrame, part_words: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's items in parts of about part_words words each; one part is on the driver at a time."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_parts = max(1, -(-size // (5 * part_words)))  # a word and what parts it take more than two bytes, five as a rule
    for part in range(n_parts):
        own = items if n_parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == part)
        yield [tuple(row) for row in own.collect()]


def benchmark_passages(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (start, end; numbers of words hit, apart and in order) and
    items (ids, as text and sorted, of the benchmark items with an occurring window).

    A NULL text has no words and no spans; a NULL doc_id stays NULL; repeated rows each give a row. Items
    with a NULL or empty text have no windows; the windows of an item without id mark words but are in
    no list; rows with the same item_id are one item. Other columns are not read. An empty table of
    documents gives no rows, an empty benchmark no spans. Whole texts are searched, one at a time. The benchmark is broadcast in parts of a
    checked size, each one search of all documents; the parts' findings meet by document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"),
                       F.col("text").cast("string").alias("text"))
    parts = [spark.sparkContext.broadcast(part) for part in _parts(benchmark, part_words)]
    first = rows.mapInArrow(_searched(parts[0], size, True), _SEARCHED)
    if len(parts) == 1:
        return first.drop("body")
    first = checkpointed(first)
    found = first.where("size(spans) > 0")
    for part in parts[1:]:
        found = found.unionByName(rows.mapInArrow(_searched(part, size, False), _SEARCHED))
    # Equal rows have equal findings, so a part's findings count once however often the row is there.
    found = checkpointed(found).select("doc_id", "body", F.explode_outer("items").alias("item"), "spans").groupBy(
        "doc_id", "body").agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.flatten(F.collect_set("spans")).alias("spans"))
    joined = first.select("doc_id", "body", "n_words").alias("d").join(
        found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.body") == F.col("f.body")), "left")
    nothing = "cast(array() as array<struct<start: long, end: long>>)"
    return joined.select(
        "d.doc_id", "n_words", merged_spans(F.coalesce("spans", F.expr(nothing))).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def merged_spans(spans: Column) -> Column:
    """Overlapping and adjoining spans made one, in order."""
    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1),
                          F.array(F.struct(last.start.alias("start"), F.greatest(last.end, span.end).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)).end >= span.start), joined).otherwise(
            F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), add)


def contamination(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from the rows of benchmark_passages."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span.end - span.start)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
