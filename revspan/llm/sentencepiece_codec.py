"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read field by field: pieces with scores and kinds, the trainer's model type and
byte fallback, the normaliser's character map and white-space rules. From them the same model is
built for the tokenizers library (unigram scores, or merges in the order of the pieces' scores).

No piece runs on over a white-space marker, so a text splits before each run of markers into chunks
that encode apart. A task encodes each distinct chunk once, in multithreaded batches, decodes it
again and compares it with the sentencepiece library: round trip and parity are verified for every
chunk of every text. Models with pieces that cross a marker encode whole texts instead.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revspan.llm.common import released

MARK = "▁"  # stands for a space in pieces
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
CACHE = 120_000  # chunks that a worker remembers; beyond, it starts anew and takes over what it meets again
RUN = 64  # new chunks that are encoded and verified as one text
SLICE = 128  # texts whose new chunks are encoded in one batch
ROWS = 1_000  # texts whose ids are held before they are handed on
THREADS = "2"  # of a batch, unless RAYON_NUM_THREADS says otherwise


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield key >> 3, message[at: at + size]
        at += size


@dataclass(frozen=True)
class PieceModel:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    single_spaces: bool
    escape: bool


def parse_model(raw: bytes) -> PieceModel:
    pieces, scores, kinds = [], [], []
    trainer: dict[int, int | bytes] = {}
    normaliser: dict[int, int | bytes] = {}
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    return PieceModel(
        pieces, scores, kinds, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normaliser.get(2, b""),
        bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)))


def merges_of(model: PieceModel) -> list[tuple[str, str]]:
    """Every way to put a normal piece together from two pieces, the best-scored pieces first."""
    number = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (NORMAL, USER, UNUSED)}
    found = []
    for piece, i in number.items():
        if model.kinds[i] == NORMAL:
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in number and right in number:
                    found.append((-model.scores[i], number[left], number[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


class Codec:
    """Encoder and decoder of one model; reads only the model's bytes."""

    def __init__(self, raw: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        from tokenizers import Tokenizer, decoders, models, normalizers

        self.raw, self.model = raw, parse_model(raw)
        m = self.model
        if m.model_type == BPE:
            inner = models.BPE(vocab={p: i for i, p in enumerate(m.pieces)}, merges=merges_of(m), unk_token=m.pieces[m.kinds.index(UNKNOWN)],
                               fuse_unk=True, byte_fallback=m.byte_fallback)
        elif m.model_type == UNIGRAM:
            inner = models.Unigram(list(zip(m.pieces, m.scores)), unk_id=m.kinds.index(UNKNOWN), byte_fallback=m.byte_fallback)
        else:
            raise ValueError(f"model type {m.model_type} is neither unigram nor BPE")
        self.tokenizer = Tokenizer(inner)
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.charsmap = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        self.by_text = m.single_spaces or self.charsmap is not None  # chunks cannot be given to the peer, whole texts can
        self.is_byte = np.array([k == BYTE for k in m.kinds])
        apart = not any(MARK in p.lstrip(MARK) for p, k in zip(m.pieces, m.kinds) if k in (NORMAL, USER, UNUSED))
        self.chunks = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if apart else re.compile("(?s).+")
        self.in_runs = apart and m.model_type == BPE
        self.at_marker = np.array([p.startswith(MARK) for p in m.pieces])
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # what was known until the last new start
        self.not_round: set[str] = set()
        self.not_par: set[str] = set()
        self._peer = None

    def normalise(self, text: str) -> str:
        """The text as the model sees it: character map, white-space rules, markers."""
        m = self.model
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        if m.single_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        if m.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if m.escape else text

    def restore(self, normalised: str) -> str:
        """Normalised text back with its spaces, without the prefix that was put before it."""
        text = normalised.replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def _peer_ids(self, texts: list[str]) -> list[list[int]]:
        if self._peer is None:
            import sentencepiece

            self._peer = sentencepiece.SentencePieceProcessor(model_proto=self.raw)
        return self._peer.encode(texts, num_threads=1)

    def _come_back(self, texts: list[str], ids: list[list[int]]) -> list[bool]:
        return [b == t.replace(MARK, " ") for t, b in zip(texts, self.tokenizer.decode_batch(ids, skip_special_tokens=False))]

    def _as_peer(self, texts: list[str], ids: list[list[int]]) -> list[bool]:
        if self.by_text:
            return [True] * len(texts)
        skip = int(self.model.dummy_prefix)
        return [own == theirs for own, theirs in zip(ids, self._peer_ids([t[skip:].replace(MARK, " ") for t in texts]))]

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks; note those that do not come back or that the peer encodes otherwise.

        Merges stay within a chunk, so plain ones (a marker, then none) are encoded and verified in runs and
        cut apart where a piece starts with the marker. Runs that differ anywhere go chunk by chunk."""
        plain = [c for c in chunks if c[0] == MARK and len(c) > 1 and MARK not in c[1:]] if self.in_runs else []
        alone = list(set(chunks).difference(plain))
        runs = [plain[i: i + RUN] for i in range(0, len(plain), RUN)]
        texts = ["".join(r) for r in runs]
        ids = self._ids(texts)
        for run, own, back, same in zip(runs, ids, self._come_back(texts, ids), self._as_peer(texts, ids)):
            packed = np.array(own, "<i4")
            cuts = np.flatnonzero(self.at_marker[packed]).tolist()
            if back and same and len(cuts) == len(run):
                self.known.update((c, packed[a:b].tobytes()) for c, a, b in zip(run, cuts, [*cuts[1:], len(own)]))
            else:
                alone += run
        ids = self._ids(alone)
        self.known.update((c, np.array(i, "<i4").tobytes()) for c, i in zip(alone, ids))
        self.not_round.update(c for c, back in zip(alone, self._come_back(alone, ids)) if not back)
        # The peer puts its own marker first; a lone marker has no text it could be given.
        same = [(c, i) for c, i in zip(alone, ids) if c != MARK and (c[0] == MARK) == self.model.dummy_prefix]
        alone, ids = [c for c, _ in same], [i for _, i in same]
        self.not_par.update(c for c, equal in zip(alone, self._as_peer(alone, ids)) if not equal)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _recall(self, chunks: set[str]) -> None:
        """See that chunks are known: most are; some were before the last new start; the rest is learned."""
        missing = chunks.difference(self.known)
        if len(self.known) + len(missing) > CACHE:
            self.before, self.known, missing = self.known, {}, chunks
            self.not_round &= self.before.keys()
            self.not_par &= self.before.keys()
        new = [c for c in missing if c not in self.before]
        self.known.update((c, self.before[c]) for c in missing if c in self.before)
        if new:
            self.learn(new)

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool, bool]]:
        """Ids, whether they decode to the normalised text, whether the peer agrees, for each text."""
        for start in range(0, len(texts), SLICE):
            part = [self.chunks.findall(self.normalise(t)) for t in texts[start: start + SLICE]]
            self._recall(set().union(*part))
            theirs = self._peer_ids(texts[start: start + SLICE]) if self.by_text else part
            for chunks, peer in zip(part, theirs):
                ids = np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), "<i4")
                yield ids, self.not_round.isdisjoint(chunks), (
                    ids.tolist() == peer if self.by_text else self.not_par.isdisjoint(chunks))

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of lists of ids, decoded in one multithreaded batch."""
        return [self.restore(t) for t in self.tokenizer.decode_batch(ids, skip_special_tokens=False)]


@lru_cache(maxsize=2)
def _codec(raw: bytes) -> Codec:
    return Codec(raw)


def load_model(path: str) -> bytes:
    """The model file's bytes, which travel with the job; executors need no copy of the file."""
    with open(path, "rb") as file:
        return file.read()


def _encoded(raw: bytes, digests: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw)
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            made, hashes = [], []
            for ids, back, same in codec.encode_texts([t or "" for t in batch.column("text").to_pylist()]):
                made.append((len(ids), int(codec.is_byte[ids].sum()), back, same))
                hashes.append(hashlib.sha256(ids.tobytes()).hexdigest() if digests else ids)
            if digests:
                tokens = pa.array(hashes, pa.string())
            else:
                ends = np.concatenate([[0], np.cumsum([n for n, *_ in made])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*hashes, np.empty(0, "<i4")])))
            facts = zip(*made) if made else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], tokens, *[pa.array(list(f), k) for f, k in zip(facts, kinds)]],
                names=[*batch.schema.names[:-1], "ids", "n_tokens", "n_byte_tokens", "round_trip", "parity"])

    return encode


def encode(docs: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """The columns keep, then ids, n_tokens, n_byte_tokens, round_trip, parity, per row of docs.

    A NULL text counts as empty and has no ids. round_trip: the ids decode to the normalised text;
    parity: the sentencepiece library encodes every chunk alike, or the whole text where the model has a
    character map or strips spaces. With digests, ids is their SHA-256 (as
    little-endian 32-bit numbers) in lowercase hex. Repeated rows each give a row. An empty table
    gives no rows."""
    kept = docs.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    kind = "string" if digests else "array<int>"
    return docs.select(*keep, F.col("text")).mapInArrow(
        released(_encoded(model, digests)), f"{fields}, ids {kind}, n_tokens long, n_byte_tokens long, round_trip boolean, parity boolean")


def _decoded(raw: bytes):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _codec(raw).decode([i or [] for i in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return decode


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text for rows of doc_id and ids; NULL ids give an empty text."""
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(_decoded(model), "doc_id long, text string")
