"""Personal data by weak supervision.

Every whole text is scanned for candidate spans. Patterns propose matches of the base forms, their failed
matches, and looser forms (national phone numbers, spelled-out addresses, colon groups, secrets after a
sign, titled names); gazetteers propose known prefixes of secrets and first names with what follows them;
context proposes what stands after a cue word. Of overlapping proposals of a kind the first proposer's
stays. Regex, gazetteer and context labelers vote on each candidate: 1 for, -1 against, 0 silent.
Expectation-maximisation over the counts of vote patterns (at most KINDS * 3^labelers rows) estimates
how reliable each labeler is for each kind; with the resulting soft labels a logistic span classifier on
votes, shape and surroundings is trained on at most SAMPLE candidates. Valid base matches are always
spans; every other candidate is one when the classifier says so.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revspan.llm.common import checkpointed

KINDS = ("email", "ip", "card", "phone", "secret", "name")
SAMPLE = 20_000  # candidates that the span classifier is trained on, at most
FEATURES = 512  # hashed span features

# Patterns of the contract. In a run of digits no later start can match what the first could not,
# so the look-behind changes no match; it only keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

# Looser forms.
_NATIONAL = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_AT = re.compile(r" ?[\[(]at[\])] ?")
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| \. | ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)+")
_GROUPS = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_SECRET = re.compile(r"[=:] ?[\"']?([A-Za-z0-9_+][A-Za-z0-9_/+.-]{15,})")
_NAMED = re.compile(r"\b(?:Mrs?|Ms|Miss|Mme|Dr|Prof|Herr|Frau|Sra?)\.? ([A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)?)")

#: What the gazetteer labelers look up.
_DOMAINS = frozenset("com org net edu gov int io co info biz eu de fr es it uk us ca au nl ch at be jp cn in br ru pl se".split())
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|4[4-9]|5)|3(?:0[0-5]|[68])|62")
_CALLING = re.compile(r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})")
_FIRST_NAMES = frozenset(
    "James John Robert Michael William David Mary Patricia Jennifer Linda Elizabeth Susan Hans Peter Klaus "
    "Anna Julia Jean Pierre Marie Sophie Claire José Juan Carlos María Carmen Ana Luis".split())
_CUES = {
    "email": ("mail", "contact", "write to", "correo", "courriel"), "ip": ("ip", "host", "server", "addr", "login"),
    "card": ("card", "visa", "master", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "handy", "móvil"),
    "secret": ("token", "key", "secret", "passw", "pwd", "auth", "bearer", "credential"), "name": ("name", "dear", "signed"),
}
#: Words after a title or a greeting that name no one.
_NO_NAMES = frozenset("All Colleague Colleagues Copy Customer Customers Everyone Friend Friends Guest Madam None Reader Readers "
                      "Required Sir Sirs Team Unknown User Users".split())
_AGAINST = ("version", "order", "isbn", "issn", "section", "chapter", "figure", "sha", "build", "release")

# What gazetteers and context propose.
_PREFIXES = ("sk_", "pk_", "ghp_", "AKIA", "xox")
_PREFIXED = re.compile(rf"(?<![A-Za-z0-9_])(?:{'|'.join(_PREFIXES)})[A-Za-z0-9_/+-]{{12,}}")
_FIRST_AND_LAST = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(_FIRST_NAMES))})(?: [A-ZÀ-Þ][\w'-]+)+")
_CUED = {
    "secret": re.compile(r"(?i:token|key|secret|passw(?:or)?d|pwd|auth|bearer|credentials?)[\"']?[ :=]{1,3}(?:is )?[\"']?"
                         r"([A-Za-z0-9_+][A-Za-z0-9_/+.-]{15,})"),
    "phone": re.compile(r"(?i:\b(?:phone|tel|call|mobile|fax|handy|móvil))[.:]?(?: (?:us|me|at|number|is))?:? ?"
                        r"([(0-9][0-9 ()./-]{5,}[0-9])(?![0-9])"),
    "email": re.compile(r"([A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)+)"),
    "name": re.compile(r"(?i:\b(?:dear|signed(?: by)?|name(?: is)?))[:,]? ([A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)?)"),
}

LABELERS = ("pattern", "check", "gazetteer", "cue", "counter_cue", "surroundings")

_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()),
                   ("votes", pa.int32()), ("features", pa.list_(pa.int32()))])
_SPAN_SQL = "array<struct<kind:int,start:int,end:int,base:boolean,votes:int,features:array<int>>>"


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the longest local part before each @, from the end of the last match on."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)  # nothing can match over this @
        at = text.find("@", done)


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a word in brackets for the @, of any length."""
    done = 0
    for at in _AT.finditer(text):
        start = done + len(text[done:at.start()].rstrip(_LOCAL))
        found = _SPELLED_DOMAIN.match(text, at.end()) if start < at.start() else None
        if found:
            yield start, found.end()
        done = found.end() if found else at.end()


def _secret_like(span: str) -> bool:
    """Two of lower case, upper case and digits, and 16 characters or more without a separator between them."""
    mixed = sum(bool(re.search(c, span)) for c in ("[a-z]", "[A-Z]", "[0-9]"))
    return mixed >= 2 and max(map(len, re.split(r"[-_/.+]", span))) >= 16


def _name_like(span: str) -> bool:
    words = span.split()
    return all(w[1:].islower() and w.isalpha() or "'" in w or "-" in w for w in words) and _NO_NAMES.isdisjoint(words)


def _is_ipv6(span: str) -> bool:
    try:
        return ipaddress.IPv6Address(span).version == 6
    except ValueError:
        return False


def _proposed(text: str) -> Iterator[tuple[int, int, int, bool, bool, bool]]:
    """(kind, start, end, is a base span, matches a pattern of its kind, passes the kind's check); proposers by turns."""
    for a, b in _emails(text):
        yield 0, a, b, True, True, not text[b - 1].isdigit()
    for m in _IP.finditer(text):
        ok = all(len(p.lstrip("0")) <= 3 and int(p[-3:] if p.lstrip("0") else "0") <= 255 for p in m[0].split("."))
        yield 1, m.start(), m.end(), ok, ok, ok
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            ok = len(digits) <= 19 and luhn(digits)
            if 13 <= len(digits) <= 19:
                yield 2, m.start(), m.end(), ok and len(digits) >= 16, ok and len(digits) >= 16, ok
    for m in _PHONE.finditer(text):
        ok = 8 <= sum(c.isdigit() for c in m[0]) <= 15
        yield 3, m.start(), m.end(), ok, ok, ok
    for m in _NATIONAL.finditer(text):
        yield 3, m.start(), m.end(), False, False, m[0].count("(") == m[0].count(")")
    if "at]" in text or "at)" in text:
        for a, b in _spelled(text):
            last = re.split(r"[^A-Za-z0-9-]+", text[a:b])[-1]
            yield 0, a, b, False, False, last.isalpha() and len(last) >= 2
    if text.count(":") >= 2:
        for m in _GROUPS.finditer(text):
            if sum(map(bool, m[0].split(":"))) >= 3:
                yield 1, m.start(), m.end(), False, False, _is_ipv6(m[0])
    for m in _SECRET.finditer(text):
        if re.search("[0-9]", m[1]):
            yield 4, m.start(1), m.end(1), False, True, _secret_like(m[1])
    for m in _NAMED.finditer(text):
        yield 5, m.start(1), m.end(1), False, True, _name_like(m[1])
    if any(p in text for p in _PREFIXES):
        for m in _PREFIXED.finditer(text):
            yield 4, m.start(), m.end(), False, False, _secret_like(m[0])
    for m in _FIRST_AND_LAST.finditer(text):
        yield 5, m.start(), m.end(), False, False, _name_like(m[0])
    lowered = text.lower()
    for name, pattern in _CUED.items():
        if not any(cue in lowered for cue in _CUES[name]) or name == "email" and " dot " not in text:
            continue
        kind = KINDS.index(name)
        for m in pattern.finditer(text):
            a, b = m.span(1)
            if name == "phone":
                digits = sum(c.isdigit() for c in m[1])
                yield kind, a, b, False, False, 7 <= digits <= 15 and m[1].count("(") == m[1].count(")")
            elif name == "secret":
                if re.search("[0-9]", m[1]):
                    yield kind, a, b, False, False, _secret_like(m[1])
            elif name == "name":
                yield kind, a, b, False, False, _name_like(m[1])
            elif _cued("email", text, a):
                yield kind, a, b, False, False, m[1].rpartition(" ")[2].isalpha()


def _candidates(text: str) -> Iterator[tuple[int, int, int, bool, bool, bool]]:
    """The proposals without those that overlap an earlier proposer's of the same kind, or a base span."""
    starts: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}

    def free(kind: int, a: int, b: int) -> bool:
        i = bisect_left(starts.setdefault(kind, []), b) - 1  # the last span that starts before b
        return i < 0 or ends[kind][i] <= a

    for kind, a, b, base, match, ok in _proposed(text):
        if base or free(kind, a, b) and free(-1, a, b):
            for held in (kind, -1) if base else (kind,):
                i = bisect_left(starts.setdefault(held, []), a)
                starts[held].insert(i, a)
                ends.setdefault(held, []).insert(i, b)
            yield kind, a, b, base, match, ok


def _cued(name: str, text: str, start: int) -> bool:
    before = text[max(0, start - 32): start].lower()
    return any(cue in before for cue in _CUES[name])


def _gazetteer(kind: str, span: str) -> int:
    if kind == "email":
        return 1 if span.rpartition(".")[2].lower().strip(" ])") in _DOMAINS else 0
    if kind == "ip":
        return -1 if span.startswith(("0.", "255.")) else 0
    if kind == "card":
        return 1 if _ISSUERS.match(span) else -1
    if kind == "phone":
        return (1 if _CALLING.match(span) else -1) if span[0] == "+" else 0
    if kind == "name":
        return 1 if span.split()[0] in _FIRST_NAMES else 0
    return 1 if span.startswith(_PREFIXES) else 0


def vote(text: str, kind: int, start: int, end: int, match: bool, ok: bool) -> list[int]:
    """The labelers' votes, in the order of LABELERS."""
    name = KINDS[kind]
    before = text[max(0, start - 32): start].lower()
    around = text[max(0, start - 1): start] + text[end: end + 1]
    return [
        1 if match else 0, 1 if ok else -1, _gazetteer(name, text[start:end]),
        1 if _cued(name, text, start) else 0,
        -1 if any(cue in before for cue in _AGAINST) else 0,
        -1 if any(c.isalnum() or c == "_" for c in around) else 0,
    ]


def _char_class(c: str) -> str:
    return "e" if not c else "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" if c.isspace() else c


def span_features(text: str, kind: int, start: int, end: int, votes: list[int]) -> list[int]:
    """Hashed features: votes, shape, length and neighbours, each together with the kind."""
    span = text[start: min(end, start + 64)]
    shape = re.sub(r"(.)\1+", r"\1", "".join(map(_char_class, span)))[:12]
    named = [f"{name}={v}" for name, v in zip(LABELERS, votes)]
    named += [f"shape={shape}", f"size={(end - start).bit_length()}", f"left={_char_class(text[max(0, start - 1): start])}",
              f"right={_char_class(text[end: end + 1])}", f"word={text[max(0, start - 24): start].lower().split()[-1:]}", "kind"]
    return [int.from_bytes(hashlib.blake2b(f"{kind}|{f}".encode(), digest_size=4).digest(), "big") % FEATURES for f in named]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            text, spans = text or "", []
            for kind, a, b, base, match, ok in _candidates(text):
                votes = vote(text, kind, a, b, match, ok)
                spans.append({"kind": kind, "start": a, "end": b, "base": base,
                              "votes": sum((v + 1) * 3**i for i, v in enumerate(votes)),
                              "features": span_features(text, kind, a, b, votes)})
            rows.append(spans)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "spans"])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and all candidate spans with votes and features, one row per row of docs."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_scan, f"doc_id long, spans {_SPAN_SQL}")


def unpack_votes(patterns: np.ndarray) -> np.ndarray:
    """Votes (0, 1, 2 for -1, 0, 1) by pattern number."""
    return patterns[:, None] // 3 ** np.arange(len(LABELERS)) % 3


def estimate_reliability(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation for one kind: posterior per pattern, vote probabilities, share of true spans.

    The probabilities [class, labeler, vote] start from labelers that are right more often than not,
    as much as ten candidates would say so; where they are of two minds, a candidate is none. Voters are
    independent given the truth."""
    prior = np.stack([np.tile([4.0, 4.0, 2.0], (votes.shape[1], 1)), np.tile([2.0, 4.0, 4.0], (votes.shape[1], 1))])
    emit, share = prior / prior.sum(axis=2, keepdims=True), 0.4
    labelers = np.arange(votes.shape[1])
    posterior = np.full(len(votes), 0.5)
    for _ in range(rounds):
        logs = np.log(emit[:, labelers, votes]).sum(axis=2) + np.log([[1 - share], [share]])
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))
        for c, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            for v in range(3):
                emit[c, :, v] = prior[c, :, v] + ((votes == v) * weight[:, None]).sum(axis=0)
        emit /= emit.sum(axis=2, keepdims=True)
        share = ((counts * posterior).sum() + 2) / (counts.sum() + 4)
    return posterior, emit, float(share)


@dataclass(frozen=True)
class SpanClassifier:
    weights: np.ndarray

    def sure(self, features: list[int]) -> bool:
        return self.weights[features].sum() >= 0


def _train(features: np.ndarray, target: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression on hashed features with soft targets, by gradient descent."""
    w = np.zeros(FEATURES)
    rate = 4 / features.shape[1]
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(w[features].sum(axis=1), -30, 30))) - target
        w -= rate * (np.bincount(features.ravel(), np.repeat(error, features.shape[1]), FEATURES) / len(target) + ridge * w)
    return w


def fit_spans(found: DataFrame, sample: int = SAMPLE) -> SpanClassifier:
    """Reliabilities from the vote patterns of all candidates, then the classifier."""
    spans = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    patterns = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # bounded by the number of patterns
    truth: dict[tuple[int, int], float] = {}
    for kind in sorted({p.kind for p in patterns}):
        own = sorted((p.votes, p.n) for p in patterns if p.kind == kind)
        numbers, counts = np.array(own, np.int64).T
        posterior, _, _ = estimate_reliability(unpack_votes(numbers), counts.astype(float))
        truth.update(((kind, int(v)), float(q)) for v, q in zip(numbers, posterior))
    # A limit on the hash leaves about one and a half times the sample, whatever the number of candidates is.
    share = min(1.0, 1.5 * sample / max(1, sum(p.n for p in patterns)))
    at = F.shiftrightunsigned(F.xxhash64("doc_id", "kind", "start"), 33)
    rows = spans.select(at.alias("at"), "doc_id", "kind", "start", "votes", "features").where(
        F.col("at") < int(share * 2**31)).limit(2 * sample).collect()
    rows = sorted(rows, key=lambda r: (r.at, r.doc_id or 0, r.kind, r.start))[:sample]
    if not rows:
        return SpanClassifier(np.zeros(FEATURES))
    return SpanClassifier(_train(np.array([r.features for r in rows]), np.array([truth[r.kind, r.votes] for r in rows])))


def _decide(model: SpanClassifier):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for spans in batch.column("spans").to_pylist():
                spans.sort(key=lambda s: (s["kind"], s["start"], s["end"]))
                written = [f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in spans]
                base = [s["base"] for s in spans]
                for k in range(4):
                    columns[k].append(sum(s["kind"] == k and s["base"] for s in spans))
                columns[4].append(hashlib.sha256(",".join(w for w, b in zip(written, base) if b).encode()).hexdigest())
                chosen = [s["base"] or bool(model.sure(s["features"])) for s in spans]
                columns[5].append(",".join(w for w, c in zip(written, chosen) if c))
                columns[6].append(sum(chosen) - sum(base))
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return decide


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, all spans (kind:start:end, comma-joined), n_added.

    Offsets are code points, ends exclusive; kinds in the order of KINDS, then by start. n_added counts
    the spans that are not base ones. A NULL text counts as empty: no spans, the hash of the empty string. Every row of docs gives one row, repeated
    rows too; other columns are not read. An empty table gives no rows."""
    found = checkpointed(candidates(docs))
    model = fit_spans(found)
    return found.mapInArrow(_decide(model), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
