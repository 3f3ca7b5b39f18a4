"""Runs of repeated words, found by online dyadic square catching.

A task's texts are appended to one stream of words, each text ended by a word that occurs nowhere
else. At level k a catcher is opened over every completed block of 2^k words. As words are
appended, the suffix of 2^k words is compared with the blocks that began 2^k to 2^(k+1) - 1 words
before it (names of suffixes are made level by level, by doubling). An equal one is a square's two
halves: period q, seen over a block. A run of period q >= 2^k that lasts for three periods repeats itself over
2q words and so over a whole block, which its catcher reports. Squares of one period over neighbouring
blocks merge, and comparing word by word to both sides gives the run's ends. The cost is n log n
vector steps, whatever repeats; squares inside a run of a smaller period are passed over.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST_LENGTH = 24
LEAST_EXPONENT = 3
STREAM_WORDS = 1 << 18  # texts are gathered until their words are this many; a longer text makes a stream alone
_FIRST = 3  # blocks of 8 words serve all periods below 16: such a run repeats itself over 16 words or more
_SLICE = 64
_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Run(NamedTuple):
    start: int
    length: int
    period: int


def _doubled(names: np.ndarray, half: int) -> np.ndarray:
    """Names of all suffixes of 2 * half words from those of half words."""
    mixed = names[:-half] * _MIX_A
    mixed ^= mixed >> np.uint64(29)
    mixed += names[half:]
    mixed *= _MIX_B
    mixed ^= mixed >> np.uint64(32)
    return mixed


def _equal_ahead(words: np.ndarray, left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    """How many words are equal from the places left and right on, forwards (step 1) or backwards (-1)."""
    n, equal = len(words), np.zeros(len(left), np.int64)
    active, offsets = np.arange(len(left)), np.arange(_SLICE) * step
    while len(active):
        moved = equal[active] * step
        a, b = (left[active] + moved)[:, None] + offsets, (right[active] + moved)[:, None] + offsets
        inside = (a >= 0) & (b >= 0) & (a < n) & (b < n)
        same = inside & (words[np.clip(a, 0, n - 1)] == words[np.clip(b, 0, n - 1)])
        whole = same.all(axis=1)
        equal[active] += np.where(whole, _SLICE, same.argmin(axis=1))
        active = active[whole]
    return equal


class _Merged:
    """Runs found so far: the smallest period of each extent, and how far runs reach from a place."""

    def __init__(self) -> None:
        self.period: dict[tuple[int, int], int] = {}
        self.starts, self.reach = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> None:
        for start, end, period in zip(starts.tolist(), ends.tolist(), periods.tolist()):
            # The same extent with three periods inside: the larger period is a multiple of the smaller.
            if period < self.period.get((start, end), period + 1):
                self.period[start, end] = period

    def settle(self) -> None:
        extents = np.array(sorted(self.period), np.int64).reshape(-1, 2)
        self.starts, self.reach = extents[:, 0], np.maximum.accumulate(extents[:, 1])

    def covers(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether one run holds all words from start to end."""
        at = np.searchsorted(self.starts, starts, "right") - 1
        return (at >= 0) & (np.append(self.reach, 0)[at] >= ends)


def _report(words: np.ndarray, block: int, caught: np.ndarray, periods: np.ndarray, merged: _Merged) -> None:
    """Merge squares (first place of the block, period) over neighbouring blocks, extend and keep the runs."""
    order = np.lexsort((caught, periods))
    caught, periods = caught[order], periods[order]
    first = np.append(True, (periods[1:] != periods[:-1]) | (caught[1:] != caught[:-1] + block))
    low, high = caught[first], caught[np.append(first[1:], True)] + block
    periods = periods[first]
    new = ~merged.covers(low, high + periods)
    low, high, periods = low[new], high[new], periods[new]
    if not len(low):
        return
    start = low - _equal_ahead(words, low - 1, low - 1 + periods, -1)
    end = high + _equal_ahead(words, high, high + periods, 1) + periods
    long_enough = end - start >= LEAST_EXPONENT * periods
    # Names may collide, words cannot.
    exact = np.array([np.array_equal(words[s:e - q], words[s + q:e]) for s, e, q in
                      zip(start[long_enough].tolist(), end[long_enough].tolist(), periods[long_enough].tolist())], bool)
    merged.add(*(x[long_enough][exact] for x in (start, end, periods)))


def stream_runs(words: np.ndarray, longest: int) -> list[Run]:
    """All runs of at least three periods and LEAST_LENGTH words in a stream, ordered by start and period.

    words are numbers; longest is the number of words of its longest text. Shorter runs may be found
    too on the way and are left out."""
    merged, n = _Merged(), len(words)
    if longest < LEAST_LENGTH or n < LEAST_LENGTH:
        return []
    names = words.astype(np.uint64)
    for level in range(_FIRST):
        names = _doubled(names, 1 << level)
    level = _FIRST
    while True:
        block = 1 << level
        low, high = (1, 2 * block) if level == _FIRST else (block, 2 * block)
        places = np.arange(0, len(names), block)
        catchers = names[places]
        caught, periods = [], []
        if level == _FIRST:  # small periods one by one, so that multiples meet the runs of their divisors
            for q in range(low, min(high, longest // LEAST_EXPONENT + 1)):
                some = places[: len(names[q::block])]
                hits = some[names[q::block] == catchers[: len(some)]]
                if len(hits):
                    _report(words, block, hits, np.full(len(hits), q), merged)
                    merged.settle()
        else:
            most = min(high, longest // LEAST_EXPONENT + 1)
            ahead = np.lib.stride_tricks.sliding_window_view(
                np.append(names, np.zeros(most, np.uint64)), most - low)[low::block][: len(places)]
            for at in range(0, len(places), rows := max(1, (1 << 21) // (most - low))):
                i, j = np.nonzero(ahead[at: at + rows] == catchers[at: at + rows, None])
                inside = places[at + i] + low + j < len(names)
                caught.append(places[at + i][inside])
                periods.append(low + j[inside])
            if sum(map(len, caught)):
                _report(words, block, np.concatenate(caught), np.concatenate(periods), merged)
                merged.settle()
        if LEAST_EXPONENT * 2 * block > longest or len(names) <= block:
            break
        names = _doubled(names, block)
        level += 1
    return sorted((Run(s, e - s, q) for (s, e), q in merged.period.items() if e - s >= LEAST_LENGTH),
                  key=lambda r: (r.start, r.period))


def split_words(text: str | None) -> list[bytes]:
    """Words between white space (space, tab to carriage return), in UTF-8."""
    return (text or "").encode().split()


def text_runs(texts: Sequence[Sequence[bytes]]) -> list[list[Run]]:
    """The runs of each text, given as words."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    ends = np.cumsum([len(t) + 1 for t in texts])
    stream = np.empty(ends[-1] if len(ends) else 0, np.int64)
    for i, (text, end) in enumerate(zip(texts, ends.tolist())):
        stream[end - 1 - len(text): end - 1] = np.fromiter(map(numbers.__getitem__, text), np.int64, len(text))
        stream[end - 1] = -1 - i
    found: list[list[Run]] = [[] for _ in texts]
    for run in stream_runs(stream, max(map(len, texts), default=0)):
        i = int(np.searchsorted(ends, run.start, "right"))
        found[i].append(run._replace(start=run.start - (int(ends[i]) - 1 - len(texts[i]))))
    return found


def repeat_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document with a planted repetition: every tenth document (by crc32 of its id) repeats
    the period of its last words up to its end. A NULL doc_id plants nothing."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapsed(words: list[bytes], runs: Sequence[Run]) -> list[bytes]:
    """The words without those that come after the first period of a run that holds them."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for run in runs:
        keep[run.start + run.period: run.start + run.length] = False
    return [w for w, stays in zip(words, keep.tolist()) if stays]


def strongest(runs: Sequence[Run]) -> Run | None:
    """The run with the greatest exact length / period; of equal ones the first, then that of least period."""
    best = None
    for run in runs:  # ordered by start, then period
        if best is None or run.length * best.period > best.length * run.period:
            best = run
    return best


def _streams(batches: Iterator[pa.RecordBatch], planted: bool) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, texts, gathered = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            words = split_words(text.as_py())
            ids.append(doc_id)
            texts.append(repeat_tail(words, doc_id) if planted else words)
            gathered += len(words) + 1
            if gathered >= STREAM_WORDS:
                yield ids, texts
                ids, texts, gathered = [], [], 0
    if ids:
        yield ids, texts


_FOUND = ("doc_id long, runs array<struct<start: long, length: long, period: long>>, "
          "best struct<start: long, length: long, period: long>, collapsed string")


def _found(planted: bool):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([(name, pa.int64()) for name in Run._fields])
        for ids, texts in _streams(batches, planted):
            runs = text_runs(texts)
            kept = [b" ".join(collapsed(t, r)).decode() for t, r in zip(texts, runs)]
            best = [strongest(r) for r in runs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()),
                 pa.array([[r._asdict() for r in own] for own in runs], pa.list_(run)),
                 pa.array([b and b._asdict() for b in best], run), pa.array(kept, pa.string())],
                names=["doc_id", "runs", "best", "collapsed"])

    return found


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Per row of docs: doc_id, runs (start, length, period; by start, then period), the strongest of them
    (best, NULL if none) and the collapsed text: the words that no run repeats, joined by one space.

    A run is a stretch of words with smallest period q that no neighbouring word extends, of at least
    max(24, 3q) words. A NULL or empty text has no words: no runs and an empty collapsed text. A NULL
    doc_id stays NULL; repeated rows each give a row; other columns are not read; an empty table
    gives no rows. A text is held by one task as a whole, about 100 bytes a word. planted rewrites documents by
    repeat_tail first."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _found(planted), _FOUND)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    for batch in batches:
        runs, best = batch.column("runs").to_pylist(), batch.column("best").to_pylist()
        listed = ["".join(f"{r['start']},{r['length']},{r['period']}\n" for r in own) for own in runs]
        of_best = [[b and b[name] for b in best] for name in Run._fields]
        milli = [b and 1000 * b["length"] // b["period"] for b in best]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(map(len, runs), pa.int64()),
             *(pa.array(column, pa.int64()) for column in (*of_best, milli)),
             pa.array(map(sha, listed), pa.string()), pa.array(map(sha, batch.column("collapsed").to_pylist()), pa.string())],
            names=["doc_id", "n_runs", *Run._fields, "exponent_milli", "runs_sha256", "collapsed_sha256"])


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run and its exponent in thousandths, and digests of the runs and the
    collapsed text, from the rows of periodic_runs."""
    return found.select("doc_id", "runs", "best", "collapsed").mapInArrow(
        _digests, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                  "runs_sha256 string, collapsed_sha256 string")
