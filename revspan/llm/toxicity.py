"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Each hashed n-gram has the log ratio of its smoothed frequencies in toxic and clean texts. A text is the
vector of the ratios of the n-grams it has, and a logistic regression on such vectors gives the
score. Every n-gram of the texts that are learned from is counted; those whose frequencies differ between
the classes by SURE standard errors or more carry weight, however many they are. Ratios and regression
are fitted on a repeatable sample of at most SAMPLE labelled texts.

Every whole text is scored, in passages of PASSAGE characters that overlap by half; its score is that
of its most toxic passage. So the score does not grow with the length, and one toxic passage
is found in a text of any length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from revspan.llm.char_ngrams import CHUNK, ngram_buckets, present
from revspan.llm.common import free_name, checkpointed, held_out, learnable, released, spread, values

ORDERS = (3, 4, 5, 6)
BITS = 22
SAMPLE = 6_000  # labelled texts that are learned from, at most
SURE = 3.0  # standard errors by which an n-gram's frequencies differ between the classes; by chance 0.3 % differ so much
PASSAGE = 4_000  # characters that are scored together
LIMIT = 0.7  # scores from here on are predicted toxic
_PARTS = 8


@dataclass(frozen=True)
class ToxicityModel:
    """weights holds for each of the buckets kept the regression weight times the log-count ratio."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, texts = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
    stamp = np.empty(1 << BITS, np.int32)
    for batch in batches:
        for text, label in zip(values(batch, "text"), batch.column("label").to_pylist()):
            counts[label][present(text, ORDERS, BITS, stamp)] += 1
            texts[label] += 1
    if texts.any():
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(counts, 1)], pa.binary()), pa.array([texts.tobytes()], pa.binary())],
                                         names=["counts", "texts"])


def _sure_ratios(counts: np.ndarray, clean: int, toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets whose frequencies surely differ between the classes, ascending, and their log-count ratios."""
    found = []
    for start in range(0, counts.shape[1], 1 << 18):  # bounds what is in memory at once
        held = counts[:, start: start + (1 << 18)].astype(np.float64)
        share = (held + 0.5) / (np.array([[clean], [toxic]]) + 1.0)
        pooled = (held.sum(axis=0) + 1) / (clean + toxic + 2)
        error = np.sqrt(pooled * (1 - pooled) * (1 / clean + 1 / toxic))
        sure = held.any(axis=0) & (np.abs(share[1] - share[0]) >= SURE * error)
        found.append((start + np.flatnonzero(sure), np.log(share[1] / share[0])[sure]))
    buckets, ratios = zip(*found)
    return np.concatenate(buckets), np.concatenate(ratios)


def _numbers(chosen: np.ndarray) -> np.ndarray:
    """For each bucket its place among the chosen, or -1."""
    number = np.full(1 << BITS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    return number


def _chosen_features(chosen: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers(chosen)
        stamp = np.empty(1 << BITS, np.int32)
        for batch in batches:
            out = []
            for text in values(batch, "text"):
                found = number[present(text, ORDERS, BITS, stamp)]
                out.append(np.sort(found[found >= 0]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.binary())], names=["label", "found"])

    return rows


def _regress(found: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, steps: int = 120, ridge: float = 1e-3):
    """Logistic regression on the scaled presence vectors, by Adam on whole passes.

    The rarer class weighs more, by the square root of how much rarer it is."""
    heavy = np.where(labels > 0, ((1 - labels.mean()) / labels.mean()) ** 0.5, 1.0)
    blocks = [found[i: i + 500] for i in range(0, len(found), 500)]  # bounds what is in memory at once
    w, b = np.zeros(len(ratio)), np.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        slope, weighed = np.append(ridge * w, 0.0), w * ratio
        for i, block in enumerate(blocks):
            at = slice(500 * i, 500 * i + len(block))
            lengths = np.array([len(f) for f in block])
            columns = np.concatenate(block)
            ends = np.concatenate([[0], np.cumsum(weighed[columns])])
            z = np.diff(ends[np.concatenate([[0], np.cumsum(lengths)])]) + b
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[at]) * heavy[at]
            slope[:-1] += np.bincount(columns, np.repeat(error, lengths), len(w)) * ratio / len(found)
            slope[-1] += error.sum() / len(found)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learn from docs (doc_id, text) whose label (doc_id, toxic 0 or 1) is known and not held out.

    Without labels of both classes every text gets the score of the one there is; where no n-gram is sure, as with very
    few labels, every text gets about the share of toxic labels."""
    known = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.max("toxic").alias("label"))
    # A limit on the hash leaves about one and a half times the sample, so that few rows are put in order.
    share = min(1.0, 1.5 * sample / max(1, known.count()))
    at = spread(F.col("doc_id"), 2)
    chosen = known.where(at < int(share * 2**31)).orderBy(at, "doc_id").limit(sample)  # so the broadcast is bounded
    learned = checkpointed(docs.select("doc_id", F.col("text")).join(F.broadcast(chosen), "doc_id").select(
        F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int")).repartition(_PARTS))
    parts = learned.mapInArrow(released(_class_counts), "counts binary, texts binary").collect()  # _PARTS rows
    counts, (clean, toxic) = np.zeros((2, 1 << BITS), np.int32), sum((np.frombuffer(p.texts, np.int64) for p in parts), np.zeros(2))
    for p in parts:
        counts += np.frombuffer(zlib.decompress(p.counts), np.int32).reshape(2, -1)
    if not clean or not toxic:
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), 20.0 if toxic else -20.0)
    picked, ratio = _sure_ratios(counts, clean, toxic)
    rows = learned.mapInArrow(released(_chosen_features(picked)), "label int, found binary").collect()  # bounded by sample
    found = [np.frombuffer(r.found, np.int32) for r in rows]
    w, bias = _regress(found, np.array([r.label for r in rows], float), ratio)
    return ToxicityModel(picked, w * ratio, bias)


def passage_sums(text: str | None, number: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each passage of a text the weights of the distinct kept n-grams that begin in it."""
    half, kept, last, found = PASSAGE // 2, max(len(weights), 1), 0, [np.empty((2, 0), np.int64)]
    for i, buckets in enumerate(ngram_buckets(text, ORDERS, BITS)):
        start, places = CHUNK * (i // len(ORDERS)), number[buckets]
        at = np.flatnonzero(places >= 0)
        last = max(last, (start + len(buckets) - 1) // half)
        found.append(np.stack([(start + at) // half, places[at]]))
    halves, places = np.concatenate(found, axis=1)
    passages = max(last, 1)  # passage k is halves k and k + 1
    pairs = np.concatenate([np.minimum(halves, passages - 1), np.maximum(halves - 1, 0)]) * kept + np.tile(places, 2)
    pairs = np.unique(pairs)
    return np.bincount(pairs // kept, weights[pairs % kept], passages)


def _scored(model: ToxicityModel, name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers(model.buckets)
        for batch in batches:
            z = np.array([passage_sums(t, number, model.weights).max()
                          for t in values(batch, "text")], np.float64) + model.bias
            scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """docs with the score (0 to 1) under a name that docs does not have; a NULL or empty text gets that of a
    text without n-grams."""
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(released(_scored(model, name)), schema)


def toxicity(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs; see fit_toxicity for what is learned.

    Only text decides a score, so rows with equal texts have equal scores. A NULL doc_id is not held
    out and not learned from. Other columns are not read. An empty table gives no rows."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= limit).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """docs, same columns, whatever their names, without the rows predicted toxic."""
    name = free_name(docs.columns, "score")
    return score_toxicity(docs, fit_toxicity(docs, labels), name).where(F.col(name) < limit).drop(name)
