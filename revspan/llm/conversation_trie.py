"""The prefix trie of conversations, by collapsing whole sequences.

Every conversation is rebuilt from the opening of the first of its hundred and its own later turns. Equal
rebuilt conversations are grouped into one weighted sequence with the list of its ends before any prefix
is formed. Sequences that are a proper prefix of another are taken out of the leaves by an
anti-join; the prefixes of all sequences, weighted, give the nodes. A turn travels as two 64-bit hashes of role and text
and its length; a prefix is known by its depth and the exclusive-or of its turns' hashes with their places,
128 bits in all. Sums over subtrees take no pairs of nodes: each node belongs to the smallest leaf
below it, so a leaf's own nodes are the end of its path, and a subtree is a running sum over
one path and whole totals of the other leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from revspan.llm.common import checkpointed, shuffle_partitions

OPENING = 6  # a conversation takes 0 to OPENING - 1 turns from the first of its hundred
CHUNK_BITS = 12  # one task orders at most 2^CHUNK_BITS turns of a path, or neighbouring conv_ids, as one group

_NODE = ["depth", "k1", "k2"]


def _placed(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0 in its conversation), a and b (hashes of role and text) and size of every turn.

    The order comes from ranges of (conversation, turn), so that a conversation may run over many tasks."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"),
        F.char_length(text).cast("long").alias("size"))
    order = ["conv_id", F.asc_nulls_first("turn"), "a", "b"]
    ranged = turns.repartitionByRange(shuffle_partitions(conversations.sparkSession), *order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id()
    numbered = checkpointed(ranged.select(
        "conv_id", "a", "b", "size", F.shiftright(within, 33).alias("part"), within.bitwiseAND(2**33 - 1).alias("row")))
    firsts = numbered.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = firsts.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return numbered.join(shifts, ["conv_id", "part"]).select(
        "conv_id", (F.col("row") + F.col("shift")).alias("place"), "a", "b", "size")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id of every conversation; conv_id, place, a, b, size of every turn of the rebuilt ones)."""
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), "n",
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENING).alias("h"))
    opening = placed.where((F.col("conv_id") % 100 == 0) & (F.col("place") < OPENING - 1)).withColumnRenamed("conv_id", "base")
    given = convs.join(opening, "base").where("place < h").select("conv_id", "place", "a", "b", "size")
    heads = opening.groupBy("base").agg(F.count("*").alias("n_head"))
    base, h = F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENING
    own = placed.withColumns({"base": base, "h": h}).where("place >= h").join(heads, "base", "left").select(
        "conv_id", (F.col("place") - F.col("h") + F.least("h", F.coalesce("n_head", F.lit(0)))).alias("place"), "a", "b", "size")
    return convs.select("conv_id"), given.unionByName(own)


def _turn_key(side: int) -> Column:
    return F.xxhash64(F.lit(side), "place", "a", "b")


def _running(df: DataFrame, key: str, place: str, columns: dict[str, tuple[str, str]], backwards: bool = False) -> DataFrame:
    """Running totals along key in the order of place (or against it): name -> ("sum" or "bit_xor", column).

    A key is worked off in chunks of places, and every chunk adds the totals of those before it: no
    task needs more than a chunk, however long the key's path is."""
    at = -F.col(place) if backwards else F.col(place)
    whole = {"sum": F.sum, "bit_xor": F.bit_xor}
    both = {"sum": lambda x, y: x + y, "bit_xor": lambda x, y: x.bitwiseXOR(y)}
    chunked = df.withColumn("chunk", F.shiftright(at, CHUNK_BITS))
    inner = Window.partitionBy(key, "chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = chunked.groupBy(key, "chunk").agg(*[whole[f](c).alias(name) for name, (f, c) in columns.items()])
    offsets = sums.select(key, "chunk", *[
        F.coalesce(whole[f](name).over(before), F.lit(0)).alias(f"{name}_before") for name, (f, _) in columns.items()])
    return chunked.withColumns({name: whole[f](c).over(inner) for name, (f, c) in columns.items()}).join(
        offsets, [key, "chunk"]).withColumns({
            name: both[f](F.col(name), F.col(f"{name}_before")) for name, (f, _) in columns.items()}).drop(
        "chunk", *[f"{name}_before" for name in columns])


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per sequence over rows sorted by sequence and block of conv_ids, fed block by block."""
    def row(key, state):
        return pa.RecordBatch.from_pylist(
            [dict(zip(("depth", "k1", "k2", "ends_sha256"), (*key, state.hexdigest())))],
            schema=pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())]))

    key, state = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "ids")]
        done = []
        for *own, ids in zip(*columns):
            if own != key:
                if key is not None:
                    done.append(row(key, state))
                key, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if key is not None:
        yield row(key, state)


def _ends(of_convs: DataFrame) -> DataFrame:
    """depth, k1, k2 and the digest of the conv_ids, ascending, of the conversations that end there.

    The ids of a sequence are sorted in blocks of neighbours by many tasks; one streams the blocks."""
    blocks = of_convs.groupBy(*_NODE, F.shiftright("conv_id", CHUNK_BITS).alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return blocks.repartition(shuffle_partitions(of_convs.sparkSession), *_NODE).sortWithinPartitions(
        *_NODE, "block").mapInArrow(_end_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of the first d rebuilt turns; the root has depth 0. Turns are ordered by
    turn, NULL first; turns of equal number lie in the order of a hash of role and text. A NULL role or text
    is empty. Rows without conv_id belong to no conversation and are left out. Other columns are not read.
    Repeated rows are turns of their own. An empty table has no members and gives no rows, not even a root."""
    convs, turns = rebuilt(_placed(conversations))
    turns = checkpointed(turns)
    keyed = turns.select("conv_id", _turn_key(11).alias("k1"), _turn_key(12).alias("k2")).withColumn("one", F.lit(1))
    nothing = convs.select("conv_id", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).alias("one"))
    of_convs = checkpointed(keyed.unionByName(nothing).groupBy("conv_id").agg(
        F.sum("one").alias("depth"), F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2")))
    sequences = checkpointed(of_convs.groupBy(*_NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("seq")))

    steps = turns.join(sequences.select(F.col("seq").alias("conv_id"), "weight", F.col("depth").alias("whole")), "conv_id").select(
        F.col("conv_id").alias("seq"), "place", "weight", "whole", "size", _turn_key(11).alias("t1"), _turn_key(12).alias("t2"))
    prefixes = _running(steps, "seq", "place", {"k1": ("bit_xor", "t1"), "k2": ("bit_xor", "t2")}).select(
        "seq", (F.col("place") + 1).alias("depth"), "k1", "k2", "weight", "whole", "size",
        F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"))
    zero = F.lit(0).cast("long")
    roots = sequences.select("seq", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "weight",
                             F.col("depth").alias("whole"), zero.alias("size"), zero.alias("p1"), zero.alias("p2"))
    prefixes = checkpointed(prefixes.unionByName(roots))

    inner = prefixes.where("depth < whole").select(*_NODE).distinct()
    leaves = sequences.join(inner, _NODE, "left_anti").select("seq", F.lit(True).alias("is_leaf"))
    paths = checkpointed(prefixes.join(leaves, "seq", "left"))
    nodes = paths.groupBy(*_NODE).agg(
        F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("size").alias("size"), F.max("p1").alias("p1"),
        F.max("p2").alias("p2"), F.count("is_leaf").alias("n_leaves"), F.min(F.when(F.col("is_leaf"), F.col("seq"))).alias("leaf"))
    nodes = checkpointed(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("size")))

    # Of each leaf: what its own nodes save in all, and from a node of its own path on.
    totals = nodes.groupBy(F.col("leaf").alias("seq")).agg(F.sum("saved").alias("total"))
    below = _running(nodes, "leaf", "depth", {"from_here": ("sum", "saved")}, backwards=True)
    of_leaves = paths.where("is_leaf").join(totals, "seq", "left").select(*_NODE, "seq", F.coalesce("total", zero).alias("total"))

    def as_facts(df: DataFrame, **columns: Column | str) -> DataFrame:
        """Rows about a node with the columns that df knows and NULL for the others."""
        kinds = {"conv_id": "long", "p1": "long", "p2": "long", "n_convs": "long", "n_leaves": "long", "from_here": "long",
                 "child": "long", "seq": "long", "total": "long", "ends_sha256": "string"}
        return df.select(*[columns.get(c, F.col(c)) for c in _NODE], *[
            columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])

    own = {c: F.col(c) for c in ("conv_id", "p1", "p2", "n_convs", "n_leaves", "from_here")}
    facts = as_facts(below, **own).unionByName(
        as_facts(below.where("depth > 0"), depth=(F.col("depth") - 1).alias("depth"), k1=F.col("p1").alias("k1"),
                 k2=F.col("p2").alias("k2"), child=F.lit(1))).unionByName(
        as_facts(of_leaves, seq=F.col("seq"), total=F.col("total"))).unionByName(
        as_facts(_ends(of_convs), ends_sha256=F.col("ends_sha256")))
    known = checkpointed(facts.groupBy(*_NODE).agg(
        *[F.max(c).alias(c) for c in own], F.count("child").alias("n_children"),
        (F.sum("total") - F.min_by("total", "seq")).alias("of_others"), F.max("ends_sha256").alias("ends_sha256")))
    parents = known.select(F.col("depth").alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    with_parents = known.where("depth > 0").join(parents.withColumn("depth", F.col("d") + 1), ["depth", "p1", "p2"])
    rows = with_parents.unionByName(known.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")), True)
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("from_here") + F.col("of_others")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
