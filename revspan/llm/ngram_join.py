"""Jaccard self-join on word shingles with adaptive multi-match prefixes.

A document is the set of its shingles, held as 64-bit hashes; equal sets share one key (96 bits of a
digest and the set's size) and are one class from then on. With n shingles and t = ceil(threshold * n), two sets that link share at
least t of them, so in any common order of shingles their prefixes of length n - t + l share at
least l (for different l: the smaller one). The order is rare first, by exact document counts.

1. Shingles are dealt out by hash range, packed, in as many ranges as their number asks for: a
   range's task counts classes per shingle and returns only shingles that two classes or more hold. The others (count 1) come first in the
   order and can match nothing, so most documents end here with an empty prefix.
2. Each class chooses the l with the least estimated cost: reading the posting lists of a longer
   prefix against verifying at most (postings read) / l candidates.
3. Components need no link that only confirms them. Each class is first compared with one partner,
   a class of few shingles of its own that it meets most often; then every pair in a posting list
   that is still in different components, fits in size and has enough matches is verified. Pairs
   are only passed over when a bound on their overlap rules the link out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from revspan.llm.common import checkpointed, released, released_group, shuffle_partitions, values
from revspan.llm.components import components

MAX_MATCHES = 8  # the largest l that a class may choose; any choice is exact
VERIFY_COST = 0.05  # verifying one shingle of a candidate, in postings read
RANGE = 2**24  # shingles that a hash range, held by one task at a time, is meant for: 128 MB and their keys
DEALT = 2**19  # shingles that a task deals out at a time, and those of one more set
SLICES = np.uint64(8)  # a hash range is counted in so many slices, one after another

_FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, fixed


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, width: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. known keeps words' hashes between calls."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.empty(len(words), np.uint64)
    for i, word in enumerate(words):
        h = known.get(word)
        if h is None:
            h = known[word] = xxhash.xxh3_64_intdigest(word)
        ids[i] = h
    size = min(width, len(ids))
    h = ids[: len(ids) - size + 1].copy()
    for k in range(1, size):
        h = _mixed(h * _FACTOR) + ids[k: len(ids) - size + 1 + k]
    return np.unique(_mixed(h + np.uint64(size)))


def class_key(tokens: np.ndarray) -> bytes | None:
    """Names a set: 12 bytes of its digest, 4 of its size. An empty set has no name."""
    return xxhash.xxh3_128_digest(tokens.tobytes())[:12] + len(tokens).to_bytes(4, "big") if len(tokens) else None


def _sets(texts: Iterable[str | None], width: int, known: dict[bytes, int]) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """Key and hashes of each text's shingle set."""
    if len(known) > 200_000:
        known.clear()  # a cache only
    for text in texts:
        tokens = shingle_hashes(text, width, known)
        yield class_key(tokens), tokens


def _key_rows(width: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            made = [(k, len(t)) for k, t in _sets(values(batch, "text"), width, known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for _, n in made], pa.int64()),
                 pa.array([k for k, _ in made], pa.binary())],
                names=["doc_id", "n_shingles", "key"],
            )

    return keys


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, key of the set (NULL when empty), one row per row of docs."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        released(_key_rows(width)), "doc_id long, n_shingles long, key binary")


_PACKED = "part int, keys binary, held binary, tokens binary, counts binary"


def _pack(part: int, keys: np.ndarray, held: np.ndarray, tokens: np.ndarray, counts: np.ndarray | None) -> pa.RecordBatch:
    """Classes and their shingles (held of them each, in order) as one row for one part."""
    blobs = [keys.tobytes(), held.astype(np.uint32).tobytes(), tokens.tobytes(), b"" if counts is None else counts.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]],
                                      names=["part", "keys", "held", "tokens", "counts"])


def _blobs(group: pa.Table, name: str, kind: str | type) -> list[np.ndarray]:
    """A packed column row by row, without copying."""
    return [np.frombuffer(value.as_buffer(), kind) for value in group.column(name)]


def _unpacked(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, owners (places in keys) of the shingles, shingles, counts of all rows of one part."""
    join = lambda c, kind: np.concatenate([np.empty(0, kind), *_blobs(group, c, kind)])
    held = join("held", np.uint32)
    owner = np.repeat(np.arange(len(held), dtype=np.int32), held)
    return join("keys", "V16"), owner, join("tokens", np.uint64), join("counts", np.uint16)


def _portions(sets: Iterable[tuple[bytes | None, np.ndarray]]) -> Iterator[dict[bytes, np.ndarray]]:
    """The different sets that are not empty, in order, in portions of DEALT shingles."""
    seen, held, n = set(), {}, 0
    for key, tokens in sets:
        if key is None or key in seen:
            continue
        seen.add(key)
        held[key] = tokens
        n += len(tokens)
        if n >= DEALT:
            yield held
            held, n = {}, 0
    if held:
        yield held


def _dealt(width: int, ranges: int):
    """Per portion of a batch and hash range one row: the classes of the portion and their shingles in the range."""
    small = np.uint16 if ranges <= 2**16 else np.int64

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for sets in (p for batch in batches for p in _portions(_sets(values(batch, "text"), width, known))):
            keys = np.frombuffer(b"".join(sets), "V16")
            owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(t) for t in sets.values()])
            tokens = np.concatenate(list(sets.values()))
            sets.clear()
            at = ((tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(small)
            order = np.argsort(at, kind="stable")  # owners stay in order within a range
            tokens = tokens[order]  # one by one, so that few arrays are held twice
            at, owner = at[order], owner[order]
            del order
            cuts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
            for start, end in zip(cuts, cuts[1:]):
                own = owner[start:end]
                firsts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                yield _pack(int(at[start]), keys[own[firsts]], np.diff(np.append(firsts, len(own))), tokens[start:end], None)

    return deal


def _held_by_many(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the shingles occur twice or more, and how often each occurs (65,535 stands for more)."""
    order = np.argsort(tokens, kind="stable")
    ranked = tokens[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    counts = np.diff(np.append(starts, len(ranked)))
    n_classes = np.empty(len(tokens), np.uint16)
    n_classes[order] = np.repeat(np.minimum(counts, 65535), counts)  # the same wherever the shingle is
    return n_classes > 1, n_classes


def _shared(parts: int):
    """Of one hash range, the shingles that two classes or more hold, with counts, dealt out by class.

    The range is gone through slice by slice, so that a task holds it once and works on an eighth of it."""

    def shared(group: pa.Table) -> pa.Table:
        keys = np.concatenate(_blobs(group, "keys", "V16"))
        first = np.unique(keys.view("u8").reshape(-1, 2), axis=0, return_index=True)[1]
        once = np.zeros(len(keys), bool)
        once[first] = True  # copies of a class count once
        rows = list(zip(_blobs(group, "tokens", np.uint64), _blobs(group, "held", np.uint32)))
        ends = np.cumsum([len(held) for _, held in rows])
        found = []
        for number in range(SLICES):
            picked, owners = [], []
            for (tokens, held), end in zip(rows, ends):
                owner = np.repeat(np.arange(end - len(held), end, dtype=np.int32), held)
                at = np.flatnonzero((tokens % SLICES == number) & once[owner])
                picked.append(tokens[at])
                owners.append(owner[at])
            tokens, owner = np.concatenate(picked), np.concatenate(owners)
            if len(tokens):
                common, n_classes = _held_by_many(tokens)
                found.append((owner[common], tokens[common], n_classes[common]))
        owner, tokens, n_classes = (np.concatenate(c) for c in zip(*found))
        part = (keys.view("u8").reshape(-1, 2)[:, 0] % np.uint64(parts)).astype(np.int64)
        packed = [_pack(0, keys[:0], np.empty(0), tokens[:0], n_classes[:0]).slice(0, 0)]
        order = np.lexsort((owner, part[owner]))
        for at in np.split(order, np.flatnonzero(np.diff(part[owner][order])) + 1):
            if len(at):
                who, held = np.unique(owner[at], return_counts=True)  # at keeps the owners in order
                packed.append(_pack(int(part[owner[at[0]]]), keys[who], held, tokens[at], n_classes[at]))
        return pa.Table.from_batches(packed)

    return shared


def overlap_needed(n: int, percent: int) -> int:
    """The least number of shingles that a set of n shares with any set it links with."""
    return -(-percent * n // 100)


def choose_matches(counts: np.ndarray, unshared: int, n: int, percent: int) -> int:
    """The l whose prefix is cheapest; counts are the shared shingles' class counts, ascending."""
    base = n - overlap_needed(n, percent) - unshared
    read = np.concatenate([[0], np.cumsum(counts.astype(np.float64) - 1)])
    most = min(MAX_MATCHES, overlap_needed(n, percent))
    lengths = np.clip(base + np.arange(1, most + 1), 0, len(counts))
    postings = read[lengths]
    return int(np.argmin(postings + VERIFY_COST * n * postings / np.arange(1, most + 1))) + 1


_CLASSES = "key binary, n long, shared long, matches int, rest long, prefix array<long>, tokens binary"


def _prefixes(percent: int):
    """Of one part, the classes whose prefix is not empty. rest: how many shingles follow the prefix."""

    def choose(group: pa.Table) -> pa.Table:
        keys, owner, tokens, counts = _unpacked(group)
        names, which = np.unique(keys.view("u8").reshape(-1, 2), axis=0, return_inverse=True)
        owner = which.ravel()[owner]
        order = np.lexsort((tokens, counts, owner))
        tokens, counts = tokens[order], counts[order]
        ends = np.cumsum(np.bincount(owner, minlength=len(names)))
        out: list[tuple] = []
        for name, start, end in zip(names, np.concatenate([[0], ends[:-1]]), ends):
            n, shared = int.from_bytes(name.tobytes()[12:], "big"), int(end - start)
            needed = overlap_needed(n, percent)
            if shared - needed + min(MAX_MATCHES, needed) <= 0 or shared < needed:
                continue
            matches = choose_matches(counts[start:end], n - shared, n, percent)
            length = max(0, shared - needed + matches)
            out.append((name.tobytes(), n, shared, matches, needed - matches,
                        tokens[start: start + length].view(np.int64), np.sort(tokens[start:end]).tobytes()))
        columns = zip(*out) if out else [()] * 7
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                    names=["key", "n", "shared", "matches", "rest", "prefix", "tokens"])

    return choose


def range_count(n_shingles: int, parts: int) -> int:
    """Hash ranges: no more than the shuffle needs, as a class's key is repeated in each range that it has
    shingles in, but enough for none to expect more than RANGE shingles, however few partitions are set."""
    return max(1, parts // 2, -(-n_shingles // RANGE))


def prefixes(docs: DataFrame, width: int = 5, percent: int = 80, n_shingles: int = 0) -> DataFrame:
    """Classes that can link at all: key, n, shared (of n), matches (their l), rest, prefix, tokens (shared, packed).

    n_shingles: how many the sets of docs hold in all, by which the work is cut into groups."""
    ranges = range_count(n_shingles, shuffle_partitions(docs.sparkSession))
    parts = max(shuffle_partitions(docs.sparkSession), ranges)
    dealt = docs.select("text").mapInArrow(released(_dealt(width, ranges)), _PACKED)
    shared = dealt.groupBy("part").applyInArrow(released_group(_shared(parts)), _PACKED)
    return shared.groupBy("part").applyInArrow(released_group(_prefixes(percent)), _CLASSES)


def _verified(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb, na, nb = (batch.column(c).to_pylist() for c in ("ta", "tb", "na", "nb"))
            keep = []
            for x, y, n, m in zip(ta, tb, na, nb):
                common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(100 * common >= percent * (n + m - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets link. Sets are compared whole, by shared shingles."""
    side = lambda s: classes.select(F.col("key").alias(s), F.col("n").alias(f"n{s}"), F.col("tokens").alias(f"t{s}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.mapInArrow(released(_verified(percent)), "a binary, b binary")


LONG_LIST = 64  # posting lists from here on are compared in tiles instead of a join
TILE = 512  # classes of one long list that meet another such block in one task

_FACTS = ("key", "n", "shared", "matches", "rest")


def _may_link(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, found) from rows of structs a, b, one per shingle that two prefixes share.

    The overlap needed is at most the smaller count of shared shingles; it is at most the matches found
    in the prefixes and all that follows the longer rest; and the matches reach the smaller l."""
    needed = (F.col("a.n") + F.col("b.n")) * percent
    scale = 100 + percent
    return pairs.where(F.least("a.shared", "b.shared") * scale >= needed).groupBy(
        F.col("a.key").alias("a_key"), F.col("b.key").alias("b_key")).agg(
        F.count("*").alias("found"), F.first("a").alias("a"), F.first("b").alias("b")).where(
        (F.col("found") >= F.least("a.matches", "b.matches"))
        & ((F.col("found") + F.greatest("a.rest", "b.rest")) * scale >= needed)
    ).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), "found")


def _tile_pairs(percent: int):
    """Of one tile of a long list, the pairs (a, b) in different components that no bound rules out."""
    scale = 100 + percent

    def pairs(tile: pa.Table) -> pa.Table:
        facts = {c: tile.column(f"c_{c}").to_numpy().astype(np.int64) for c in _FACTS[1:]}
        keys = np.array(tile.column("c_key").to_pylist(), object)
        at = np.unique(tile.column("at").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        block, lo, hi = (tile.column(c).to_numpy() for c in ("block", "lo", "hi"))
        left, right = np.flatnonzero(block == lo[0]), np.flatnonzero(block == hi[0])
        prefix = tile.column("prefix").combine_chunks()
        tokens = np.unique(prefix.flatten().to_numpy(), return_inverse=True)[1]
        row = np.repeat(np.arange(len(keys)), np.diff(prefix.offsets.to_numpy()))
        order = np.argsort(tokens, kind="stable")
        tokens, row = tokens[order], row[order]
        found = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, tokens[-1] + 1, 4096):
            a, b = np.searchsorted(tokens, [start, start + 4096])
            held = np.zeros((len(keys), 4096), np.float32)
            held[row[a:b], tokens[a:b] - start] = 1
            found += held[left] @ held[right].T
        either = lambda f, c: f(facts[c][left][:, None], facts[c][right][None, :])
        needed = either(np.add, "n") * percent
        ok = (at[left][:, None] != at[right][None, :]) & (either(np.minimum, "shared") * scale >= needed)
        ok &= (found >= either(np.minimum, "matches")) & ((found + either(np.maximum, "rest")) * scale >= needed)
        x, y = np.nonzero(ok)
        if lo[0] == hi[0]:
            x, y = x[x < y], y[x < y]
        x, y = keys[left[x]], keys[right[y]]
        return pa.table({"a": pa.array(np.minimum(x, y), pa.binary()), "b": pa.array(np.maximum(x, y), pa.binary())})

    return pairs


def _in_tiles(long: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs from long lists (token, m, c, at): blocks of each list meet two by two."""
    blocks = F.ceil(F.col("m") / TILE).cast("int")
    whole = long.join(classes.select(F.col("key").alias("k"), "prefix"), F.col("c.key") == F.col("k"))
    tiles = whole.withColumn("block", F.pmod(F.xxhash64("k"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "token", "at", "prefix", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        *[F.col(f"c.{c}").alias(f"c_{c}") for c in _FACTS])
    return tiles.groupBy("token", "lo", "hi").applyInArrow(_tile_pairs(percent), "a binary, b binary")


def link_components(classes: DataFrame, percent: int) -> DataFrame:
    """(node, component) over class keys; classes without links have no row."""
    classes = checkpointed(classes)
    postings = classes.select(F.struct(*_FACTS).alias("c"), F.explode("prefix").alias("token"))
    lists = postings.groupBy("token").agg(
        F.min(F.struct((F.col("c.n") - F.col("c.shared")).alias("own"), "c")).alias("p"), F.count("*").alias("m")).where("m > 1")
    met = postings.join(lists.select("token", F.col("p.c").alias("a")), "token").where("c.key <> a.key").select(
        "a", F.col("c").alias("b"))
    partner = _may_link(met, percent).groupBy("b").agg(F.max(F.struct("found", "a")).alias("p")).select("p.a", "b")
    links = checkpointed(verified(partner, classes, percent))
    found = components(links)
    # What is still apart: lists that hold more than one component.
    placed = postings.join(found, F.col("c.key") == F.col("node"), "left").select(
        "token", "c", F.coalesce("component", "c.key").alias("at"))
    mixed = placed.groupBy("token").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("m")).where(
        "lo <> hi").select("token", "m")
    apart = placed.join(mixed, "token")
    short = apart.where(F.col("m") < LONG_LIST)
    rest = short.select("token", F.col("c").alias("a"), F.col("at").alias("at_a")).join(
        short.select("token", F.col("c").alias("b"), F.col("at").alias("at_b")), "token").where(
        "a.key < b.key and at_a <> at_b").select("a", "b")
    # A pair that meets in a long list too is counted whole there, so each way may use its own counts.
    pairs = _may_link(rest, percent).select("a", "b").unionByName(
        _in_tiles(apart.where(F.col("m") >= LONG_LIST), classes, percent)).distinct()
    more = checkpointed(verified(pairs, classes, percent))
    if more.isEmpty():
        return found
    return components(links.unionByName(more))


def ngram_jaccard(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Two rows link when 100 * |intersection| >= percent * |union| of their shingle sets. component_id is
    the smallest doc_id reachable by links, the row's own when it has none. A NULL or empty text, or
    one of white space only, has no shingles and links with nothing; a text of fewer than width words
    is one shingle. Rows with equal sets link whatever their doc_id; a NULL doc_id counts as larger
    than any other. Other columns are not read. An empty table gives no rows."""
    sets = checkpointed(shingle_sets(docs, width))
    n_shingles = sets.agg(F.sum("n_shingles")).first()[0] or 0
    found = link_components(prefixes(docs, width, percent, n_shingles), percent)
    named = sets.join(found, F.col("key") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "key").alias("component"))
    least = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
