"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

A unit vector o is rotated once by a fixed random orthogonal matrix P. Stored are the signs of P o, packed into bits,
the factor f = <o', o>, where o' is the code as a unit vector, and P o itself in bytes. Two tests on what
is stored settle a pair whose cosine would reach the threshold t only with a chance below MISS:

* the share of bits in which the codes differ estimates the angle; more differing bits than an angle
  of arccos t leaves likely rule the pair out (one XOR and bit count per 64 dimensions);
* <o', q> / f is an unbiased estimate of <o, q>. Its error is at most
  z sqrt((1 - f^2)(1 - t^2) / (D - 1)) / f with confidence, for a pair that reaches t; an estimate below
  t by more rules the pair out.

Pairs that are left open are computed again in double precision, and only that makes a link; for
them alone the whole vectors are fetched, tile by tile. Equal vectors are one class with a weight
before any pair is looked at.

A label's classes meet in square tiles of two blocks of about TILE codes, a small label in one tile. A pair
meets in one tile only, so links are counted where they are found and no pair leaves its task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from revspan.llm.common import checkpointed
from revspan.llm.components import components

BUCKET = 4_096  # classes of a label that are compared in one task
TILE = 2_048  # classes of a larger label that meet another such block in one task
MISS = 1e-12  # the chance that a pair at the threshold is ruled out, by either test
_WORD = 64


@lru_cache(maxsize=4)
def rotation(d: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere for the same d and seed; made once per process."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def padded(d: int) -> int:
    return -(-d // _WORD) * _WORD


class Codes:
    """Stored codes of unit vectors: packed signs, factors, and the rotated vectors in bytes with their steps."""

    def __init__(self, bits: np.ndarray, factor: np.ndarray, coarse: np.ndarray, step: np.ndarray):
        self.bits, self.factor, self.coarse, self.step = bits, factor, coarse, step

    @staticmethod
    def of(units: np.ndarray) -> Codes:
        d = units.shape[1]
        wide = np.zeros((len(units), padded(d)))
        wide[:, :d] = units
        turned = wide @ rotation(padded(d)).T
        factor = np.abs(turned).sum(axis=1) / math.sqrt(padded(d))
        step = np.abs(turned).max(axis=1) / 127
        return Codes(np.packbits(turned >= 0, axis=1).view(np.uint64), factor,
                     np.rint(turned / step[:, None]).astype(np.int8), step)

    @property
    def dims(self) -> int:
        return self.bits.shape[1] * _WORD


@lru_cache(maxsize=64)
def most_differing(dims: int, threshold: float, miss: float = MISS) -> int:
    """The fewest differing bits that a pair at the threshold exceeds with a chance below miss."""
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    if p <= 0:
        return 0
    logs = [math.lgamma(dims + 1) - math.lgamma(k + 1) - math.lgamma(dims - k + 1) + k * math.log(p)
            + ((dims - k) * math.log1p(-p) if p < 1 else 0.0) for k in range(dims + 1)]
    tail, k = 0.0, dims
    while k > 0 and tail + math.exp(logs[k]) < miss:
        tail += math.exp(logs[k])
        k -= 1
    return k


@lru_cache(maxsize=64)
def _z(miss: float) -> float:
    return math.sqrt(2 * math.log(1 / miss))


def estimates(codes: Codes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of rows a (as codes) and b (as rotated vectors)."""
    signs = np.unpackbits(codes.bits[a].view(np.uint8), axis=1).astype(np.int32) * 2 - 1
    product = np.einsum("ij,ij->i", signs, codes.coarse[b].astype(np.int32)) * codes.step[b]
    return product / math.sqrt(codes.dims) / codes.factor[a]


def margin(codes: Codes, a: np.ndarray, b: np.ndarray, threshold: float, miss: float = MISS) -> np.ndarray:
    """How far below its cosine the estimate of a pair at the threshold or above may lie, with confidence."""
    f, spread = codes.factor[a], max(0.0, 1 - threshold**2)
    rotated = _z(miss) * np.sqrt(np.maximum(0, 1 - f**2) * spread / (codes.dims - 1)) / f
    return rotated + math.sqrt(codes.dims) * codes.step[b] / 2 / f  # the bytes are off by half a step at most


def open_pairs(codes: Codes, rows: np.ndarray, cols: np.ndarray, threshold: float, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows and cols that the codes leave open. Rows are taken in slices, so memory stays bounded."""
    most, found = most_differing(codes.dims, threshold), []
    step = max(1, (1 << 21) // max(1, len(cols)))
    for at in range(0, len(rows), step):
        part = rows[at: at + step]
        differ = np.zeros((len(part), len(cols)), np.uint16)
        for word in range(codes.bits.shape[1]):
            differ += np.bitwise_count(codes.bits[part, word][:, None] ^ codes.bits[cols, word])
        near = differ <= most
        if diagonal:
            near &= np.arange(len(cols)) < (at + np.arange(len(part)))[:, None]
        i, j = np.nonzero(near)
        for cut in range(0, len(i), 1 << 15):
            a, b = part[i[cut: cut + (1 << 15)]], cols[j[cut: cut + (1 << 15)]]
            stays = estimates(codes, a, b) >= threshold - margin(codes, a, b, threshold)
            found.append((a[stays], b[stays]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _unit_rows(vectors: list) -> tuple[list[np.ndarray], list[int]]:
    """Unit vectors in double precision and the places they come from; unusable ones are left out."""
    places, rows = [], []
    for i, v in enumerate(vectors):
        if v is None or not len(v) or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        if np.isfinite(x).all() and (peak := np.abs(x).max()) > 0:
            x = x / peak
            places.append(i)
            rows.append(x / np.sqrt(x @ x))
    return rows, places


def _usable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (label, dim, id, unit vector) of usable vectors."""
    for batch in batches:
        rows, places = _unit_rows(list(batch.embedding))
        batch = batch.iloc[places]
        yield pd.DataFrame({
            "label": batch.label, "dim": pd.Series([len(u) for u in rows], batch.index, "int32"), "id": batch.id,
            "unit": pd.Series([u.tobytes() for u in rows], batch.index, object)})


_CODE = "bits binary, factor double, coarse binary, step double"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the codes to rows with a unit vector; each vector is rotated here and nowhere else."""
    for batch in batches:
        units = [np.frombuffer(u) for u in batch.column("unit").to_pylist()]
        bits, coarse = np.empty(len(units), object), np.empty(len(units), object)
        factor, step = np.zeros(len(units)), np.zeros(len(units))
        for dim in {len(u) for u in units}:
            at = [i for i, u in enumerate(units) if len(u) == dim]
            codes = Codes.of(np.stack([units[i] for i in at]))
            for k, i in enumerate(at):
                bits[i], coarse[i] = codes.bits[k].tobytes(), codes.coarse[k].tobytes()
            factor[at], step[at] = codes.factor, codes.step
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(bits, pa.binary()), pa.array(factor), pa.array(coarse, pa.binary()), pa.array(step)],
            names=[*batch.schema.names, "bits", "factor", "coarse", "step"])


def _read_codes(tile: pd.DataFrame) -> Codes:
    return Codes(np.stack([np.frombuffer(b, np.uint64) for b in tile.bits]), tile.factor.to_numpy(),
                 np.stack([np.frombuffer(c, np.int8) for c in tile.coarse]), tile.step.to_numpy())


def _tile_pairs(tile: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Open pairs of a tile, by place in it."""
    diagonal = tile.lo.iloc[0] == tile.hi.iloc[0]
    block = tile.block.to_numpy()
    rows = np.arange(len(block)) if diagonal else np.flatnonzero(block == tile.lo.iloc[0])
    cols = rows if diagonal else np.flatnonzero(block == tile.hi.iloc[0])
    return open_pairs(_read_codes(tile), rows, cols, threshold, diagonal)


def _screen(threshold: float):
    """The members of a tile that are in an open pair there."""
    def screened(tile: pd.DataFrame) -> pd.DataFrame:
        a, b = _tile_pairs(tile, threshold)
        return tile.iloc[np.unique(np.concatenate([a, b]))][["label", "dim", "lo", "hi", "block", "h1", "h2"]]

    return screened


def _recompute(threshold: float):
    """The same open pairs in double precision: weighted links of each member, and links that span its components."""

    def recomputed(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("cls", ignore_index=True)
        units = np.stack([np.frombuffer(u) for u in tile.unit])
        ids, weight = tile.cls.to_numpy(), tile.weight.to_numpy()
        a, b = _tile_pairs(tile, threshold)
        step = max(1, (1 << 21) // units.shape[1])  # bounds what is in memory at once
        exact = np.concatenate([np.empty(0, bool), *[
            np.einsum("ij,ij->i", units[a[i: i + step]], units[b[i: i + step]]) >= threshold for i in range(0, len(a), step)]])
        a, b = a[exact], b[exact]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        root = np.arange(len(ids))  # smallest member first: ids are sorted

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(a.tolist(), b.tolist()):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
        top = np.array([find(i) for i in range(len(ids))], int)
        said = np.flatnonzero(links > 0)
        return pd.DataFrame({"h1": tile.h1.to_numpy()[said], "h2": tile.h2.to_numpy()[said], "cls": ids[said],
                             "links": links[said], "least": ids[top[said]]})

    return recomputed


_CELL = ["label", "dim"]


def coded_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes of equal unit vectors with their codes; label, dim, id, h1, h2 of every usable vector).

    vectors: id, label, embedding. A class is known by 128 bits of hash (h1, h2) of its unit vector; cls is its
    smallest id, weight the number of its vectors."""
    label = vectors.schema["label"].dataType
    units = vectors.mapInPandas(
        _usable, StructType().add("label", label).add("dim", "integer").add("id", "long").add("unit", "binary"))
    hashed = checkpointed(units.select(*_CELL, "id", F.xxhash64("unit").alias("h1"), F.xxhash64(F.lit(7), "unit").alias("h2"), "unit"))
    classes = hashed.groupBy(*_CELL, "h1", "h2").agg(
        F.min("id").alias("cls"), F.count("*").alias("weight"), F.first("unit").alias("unit"))
    schema = StructType(classes.schema.fields + StructType.fromDDL(_CODE).fields)
    return checkpointed(classes.mapInArrow(_coded, schema)), hashed.drop("unit")


def class_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(h1, h2, cls, links, least) pieces from all tiles of coded classes; checkpointed."""
    counts = classes.groupBy(*_CELL).agg(F.count("*").alias("size"))
    blocks = F.when(F.col("size") <= BUCKET, 1).otherwise(F.ceil(F.col("size") / TILE)).cast("int")
    codes = classes.drop("unit", "cls", "weight").join(counts, _CELL).where("size > 1").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int"))
    tiled = codes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "size", "blocks")
    tile = StructType([f for f in tiled.schema.fields if f.name in ("label", "dim")]).add("lo", "integer").add(
        "hi", "integer").add("block", "integer").add("h1", "long").add("h2", "long")
    members = checkpointed(tiled.groupBy(*_CELL, "lo", "hi").applyInPandas(_screen(threshold), tile))
    fetched = members.join(classes, [*_CELL, "h1", "h2"])
    return checkpointed(fetched.groupBy(*_CELL, "lo", "hi").applyInPandas(
        _recompute(threshold), "h1 long, h2 long, cls long, links long, least long"))


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Vectors link when their labels are equal and not NULL and their cosine in double precision is at
    least the threshold; a pair that is is passed over with a chance of MISS per test. A vector that is NULL, empty,
    zero, or holds a NULL or non-finite number links with nothing, and so do vectors of different length and rows without
    vec_id: those have no links, no component_id, and are kept. Rows with the same vec_id are different
    vectors of one id: they are told apart by their content, exact repeats count once. Long vectors cost a rotation
    matrix of their length squared in each worker. Other columns are not read. An empty table gives no rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    usable = rows.where("vec_id is not null and label is not null and embedding is not null").select(
        F.col("vec_id").alias("id"), "label", "embedding").distinct()
    classes, members = coded_classes(usable)
    found = class_links(classes, threshold)
    # An id with several vectors joins their classes.
    several = members.select("id", *_CELL, "h1", "h2").distinct().withColumn("one", F.lit(1)).groupBy("id").agg(
        F.sum("one").alias("n")).where("n > 1").select("id")
    key = [*_CELL, "h1", "h2"]
    bridges = members.join(several, "id").join(classes.select(*key, "cls"), key).where("id <> cls").select(
        F.col("id").alias("a"), F.col("cls").alias("b"))
    edges = found.where("cls <> least").select(F.col("cls").alias("a"), F.col("least").alias("b")).unionByName(bridges)
    joined = components(edges.distinct())
    per_class = found.groupBy("h1", "h2", "cls").agg(F.sum("links").alias("links"))
    of_class = classes.select(*key, "cls", "weight").join(per_class, ["h1", "h2", "cls"], "left").select(
        *key, "cls", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")).join(
        joined, F.col("cls") == joined["node"], "left").select(
        *key, "links", F.coalesce("component", "cls").alias("component")).where("links > 0")
    per_id = members.join(of_class, key).groupBy("id").agg(F.sum("links").alias("n_links"), F.min("component").alias("component"))
    return rows.select("vec_id").join(per_id, F.col("vec_id") == per_id["id"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"))
