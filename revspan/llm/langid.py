"""Language identification in two steps: the family first, then the language within it.

Texts are hashed character n-grams (square roots of counts, unit length). A linear one-against-rest
classifier picks the language family; in a family of several languages, linear support vector
machines for each pair of them vote. All are fitted on a repeatable sample of about PER_LANGUAGE texts
of each language, MOST_TEXTS in all; every whole text is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revspan.llm.char_ngrams import counted
from revspan.llm.common import held_out, learnable, spread

ORDERS = (1, 2, 3)
BITS = 12
PER_LANGUAGE = 1_000
MOST_TEXTS = 4_000
UNKNOWN = "und"

#: Families by language code; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"), "celtic": ("ga", "gd", "cy", "br"), "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "ky", "uz", "tk"), "semitic": ("ar", "he", "mt", "am"),
    "iranian": ("fa", "ku", "ps", "tg"), "indic": ("hi", "ur", "bn", "pa", "gu", "mr", "ne", "si"),
    "dravidian": ("ta", "te", "kn", "ml"), "austronesian": ("id", "ms", "tl", "jv", "mg"),
}


def family_of(language: str) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    return next((f for f, members in FAMILIES.items() if code in members), f"={language}")


@dataclass(frozen=True)
class LanguageModel:
    """Rows of weights (bias last): one per family, then one per pair of languages of one family."""

    families: list[str]
    members: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray


def vector(text: str | None) -> np.ndarray:
    counts = np.sqrt(counted(text, ORDERS, BITS))
    norm = np.sqrt(counts @ counts)
    return (counts / norm if norm else counts).astype(np.float32)


def linear_svm(x: np.ndarray, sign: np.ndarray, ridge: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights, bias last, of a linear SVM with squared hinge loss; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])  # float32 throughout
    sign = sign.astype(x.dtype)
    cost = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)).astype(x.dtype)
    w, ahead, t = np.zeros(x.shape[1], x.dtype), np.zeros(x.shape[1], x.dtype), 1.0
    rate = 1 / (2 * 2.0 + ridge)  # rows have length sqrt(2) with the bias
    for _ in range(steps):  # accelerated gradient descent
        short = np.maximum(0, 1 - sign * (x @ ahead))
        slope = -2 * ((cost * sign * short) @ x) + ridge * ahead
        new = ahead - x.dtype.type(rate) * slope
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = new + x.dtype.type((before - 1) / t) * (new - w)
        w = new
    return w


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [vector(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary())], names=["lang", "x"])


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST_TEXTS) -> LanguageModel:
    """Learn from text and lang of docs that have both and are not held out."""
    known = docs.select("doc_id", "text", "lang").where(
        learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # language codes
    each = max(1, min(per_language, most // max(len(counts), 1)))
    if not counts:
        return LanguageModel([], [], [], np.zeros((0, (1 << BITS) + 1), np.float32))
    share = F.element_at(F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))]), F.col("lang"))
    sample = known.where(spread(F.col("doc_id"), 4) < share * 2.0**31).select("lang", "text")
    rows = sample.mapInArrow(_vectors, "lang string, x binary").collect()  # about each for a language
    langs = np.array([r.lang for r in rows], object)
    x = np.stack([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, 1 << BITS), np.float32)
    families = sorted({family_of(lang) for lang in langs})
    members = [sorted({lang for lang in langs if family_of(lang) == f}) for f in families]
    of = np.array([family_of(lang) for lang in langs], object)
    weights = [linear_svm(x, np.where(of == f, 1.0, -1.0)) if len(families) > 1 else np.zeros(x.shape[1] + 1) for f in families]
    pairs = [p for m in members for p in combinations(m, 2)]
    for a, b in pairs:
        at = (langs == a) | (langs == b)
        weights.append(linear_svm(x[at], np.where(langs[at] == a, 1.0, -1.0)))
    return LanguageModel(families, members, pairs, np.array(weights, np.float32).reshape(-1, (1 << BITS) + 1))


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-3 * np.clip(margin, -9, 9)))


def predict(model: LanguageModel, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages and scores: the family's share of sureness times that of the language's pairs."""
    margins = x @ model.weights[:, :-1].T + model.weights[:, -1]
    n = len(model.families)
    sure = _sure(margins[:, :n])
    family = margins[:, :n].argmax(axis=1)
    score = sure[np.arange(len(x)), family] / np.maximum(sure.sum(axis=1), 1e-12)
    names = np.empty(len(x), object)
    column = {p: n + i for i, p in enumerate(model.pairs)}
    for f, members in enumerate(model.members):
        at = np.flatnonzero(family == f)
        votes, trust = np.zeros((len(at), len(members))), np.zeros((len(at), len(members)))
        for i, j in combinations(range(len(members)), 2):
            first = _sure(margins[at, column[members[i], members[j]]])
            votes[:, i] += first >= 0.5
            votes[:, j] += first < 0.5
            trust[:, i] += first
            trust[:, j] += 1 - first
        best = (votes + trust / max(len(members), 1) / 2).argmax(axis=1) if len(members) > 1 else np.zeros(len(at), int)
        names[at] = np.array(members, object)[best]
        if len(members) > 1:
            score[at] *= trust[np.arange(len(at)), best] / (len(members) - 1)
    return list(names), score


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter (Unicode's L, as in the fit); numerals such as ½ or Ⅷ are none."""
    return any(map(str.isalpha, text or ""))


def _predicted(model: LanguageModel):
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            texts = batch.column("text").to_pylist()
            for start in range(0, len(texts), 512):
                part = texts[start: start + 512]
                known = [has_letter(t) and bool(model.families) for t in part]
                x = np.stack([vector(t) if k else np.zeros(1 << BITS, np.float32) for t, k in zip(part, known)])
                names, sure = predict(model, x) if model.families else ([UNKNOWN] * len(part), np.zeros(len(part)))
                langs += [name if k else UNKNOWN for name, k in zip(names, known)]
                scores += [float(s) if k else 0.0 for s, k in zip(sure, known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return predicted


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of docs.

    A NULL text, and one without a letter, is "und" with score 0; so is every text when there is no
    language to learn. Only text decides a prediction. A NULL doc_id is not held out and not learned
    from. Other columns are not read. An empty table gives no rows."""
    model = fit_languages(docs)
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_predicted(model), "doc_id long, held_out boolean, lang_pred string, score double")
