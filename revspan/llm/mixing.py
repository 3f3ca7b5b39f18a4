"""Temperature mixing of sources: weights p^t / sum(p^t) of the sources' token shares p.

The exponent t is bisected until the weights have the target entropy, or until no source is
repeated more often than a limit. Normalised weights then become token budgets, and each budget
is spent on permutations of the source's blocks: as many whole passes as it holds, each in an
order of its own, and of one further pass the documents that still fit. Only DataFrame operations.

Blocks keep hot sources apart: a source of n rows has about sqrt(n) blocks of sqrt(n) rows, so that
running totals first go over blocks, then over the rows of one block, and no task gets a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from revspan.llm.common import checkpointed

LEVELS = 4  # bisection steps answered by one pass over the sources
BROADCAST_SOURCES = 10_000  # rows of the weights that may be broadcast
STEPS = 48  # steps in all: the exponent is right to 2^-48 of its range


def token_count(text: Column) -> Column:
    """Words of a text: maximal runs without white space; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def source_shares(tokens: DataFrame) -> DataFrame:
    """source, n_rows, n_tokens, share of every source that has tokens; a NULL source is one source."""
    per = tokens.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"))
    return checkpointed(per.where("n_tokens > 0").crossJoin(
        F.broadcast(per.agg(F.sum("n_tokens").alias("all")))  # one row
    ).select("source", "n_rows", "n_tokens", (F.col("n_tokens") / F.col("all")).alias("share")))


def _bisect(shares: DataFrame, low: float, high: float, measure, goes_right) -> float:
    """The exponent in [low, high] where a falling measure crosses; several steps per pass."""
    for _ in range(STEPS // LEVELS):
        inner = [low + (high - low) * k / 2**LEVELS for k in range(1, 2**LEVELS)]
        row = shares.agg(*[measure(t).alias(f"m{i}") for i, t in enumerate(inner)]).first()
        a, b = 0, 2**LEVELS
        while b - a > 1:  # the bisection itself, over values already at hand
            mid = (a + b) // 2
            a, b = (mid, b) if goes_right(row[mid - 1]) else (a, mid)
        points = [low, *inner, high]
        low, high = points[a], points[b]
    return high


def entropy(t: float) -> Column:
    """Entropy in nats of the weights for exponent t, as an aggregate over the sources."""
    logs = F.log("share") * F.lit(float(t))
    z = F.sum(F.exp(logs))
    return F.log(z) - F.sum(F.exp(logs) * logs) / z


def exponent_for_entropy(shares: DataFrame, target: float, most: float = 64.0) -> float:
    """The exponent in [0, most] whose weights have the target entropy; the nearest end if none has."""
    return _bisect(shares, 0.0, most, entropy, lambda h: h is not None and h > target)


def exponent_for_repeats(shares: DataFrame, limit: float) -> float:
    """The flattest exponent in [0, 1] for which, with every source seen in full at least once, none is
    seen more than limit times."""
    def spread(t: float) -> Column:
        times = F.log("share") * F.lit(float(t) - 1)
        return F.max(times) - F.min(times)

    return _bisect(shares, 0.0, 1.0, spread, lambda s: s is not None and s > math.log(limit))


def weights(shares: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """shares with weight, budget (tokens) and passes (budget / tokens) for an exponent.

    Without a budget, the total is the least with which every source is seen in full."""
    powered = shares.withColumn("power", F.pow("share", F.lit(float(exponent))))
    total = powered.agg(F.sum("power").alias("z"), F.max(F.col("n_tokens") / F.col("power")).alias("full"))
    out = powered.crossJoin(F.broadcast(total))  # one row
    spent = F.col("full") * F.col("z") if budget is None else F.lit(float(budget))
    return out.select(
        "source", "n_rows", "n_tokens", "share", (F.col("power") / F.col("z")).alias("weight"),
        (F.col("power") / F.col("z") * spent).alias("budget"),
    ).withColumn("passes", F.col("budget") / F.col("n_tokens"))


def block_permutations(tokens: DataFrame, weighted: DataFrame, seed: int = 0) -> DataFrame:
    """Rows of tokens (n_tokens, source, ...) as often as their source's budget holds them.

    Adds pass (0, 1, ...), block, weight, before (tokens of the source that come earlier) and
    progress (before / budget): ordered by progress, the sources are mixed by weight all along.
    Pass k shuffles blocks, and rows in a block, by hashes of k. A budget that ends within a pass
    takes its documents in order while they fit whole; rounding is forgiven up to a millionth of a token. Rows
    of sources without tokens come once, at progress 0. Which block a row is in follows from its id and text."""
    columns = tokens.columns
    sized = weighted.select(
        F.struct("source").alias("__source"), "weight", "budget", "passes", F.col("n_tokens").alias("__all"),
        F.greatest(F.round(F.sqrt("n_rows")), F.lit(1)).cast("long").alias("__blocks"))
    if weighted.count() <= BROADCAST_SOURCES:  # else a plain join, which adaptive execution can split
        sized = F.broadcast(sized)
    passes = F.greatest(F.ceil(F.coalesce("passes", F.lit(1)) - 1e-9), F.lit(1)).cast("int")
    # A struct is never NULL, so that a NULL source groups and joins like any other.
    placed = tokens.withColumn("__source", F.struct("source")).join(sized, "__source", "left").withColumn(
        "__key", F.xxhash64("doc_id", "text", F.lit(seed))).withColumn(
        "block", F.pmod("__key", F.coalesce("__blocks", F.lit(1)))).withColumn(
        "pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    cell = ["__source", "pass", "block"]
    blocks = placed.where("__all is not null").groupBy(*cell).agg(
        F.sum("n_tokens").alias("__size"), F.first("__all").alias("__sum"))
    order = Window.partitionBy("__source", "pass").orderBy(F.xxhash64("block", "pass", F.lit(seed + 1)), "block")
    starts = blocks.select(*cell, (
        F.col("pass") * F.col("__sum") + F.sum("__size").over(order) - F.col("__size")).alias("__start"))
    within = Window.partitionBy(*cell).orderBy(F.xxhash64("__key", "pass"), "__key", "doc_id").rowsBetween(
        Window.unboundedPreceding, -1)
    running = placed.withColumn("__in", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    met = running.join(starts, cell, "left").withColumn(
        "before", F.coalesce(F.col("__start"), F.lit(0)) + F.col("__in"))
    fits = F.col("before") + F.col("n_tokens") <= F.col("budget") * (1 + 1e-12) + 1e-6
    return met.where(F.col("budget").isNull() | fits).select(
        *columns, "pass", "block", "weight", "before",
        F.coalesce(F.col("before") / F.col("budget"), F.lit(0.0)).alias("progress"))


#: Names of the columns that mixing adds or works with.
ADDED = ("n_tokens", "pass", "block", "weight", "before", "progress", "budget", "passes", "__source", "__all", "__blocks",
         "__key", "__size", "__sum", "__start", "__in")


def temperature_mix(
    docs: DataFrame, *, target_entropy: float | None = None, max_passes: float | None = None,
    budget: float | None = None, seed: int = 0,
) -> DataFrame:
    """docs mixed to tempered weights: its rows, with n_tokens, pass, block, weight, before, progress.

    Give target_entropy (nats) or max_passes (the repetition limit). Rows need doc_id, text, source;
    each may be NULL. An empty text has no tokens and takes none of a budget. Equal rows are
    separate rows. An empty table gives no rows; further columns of docs are kept, but for those
    with the names added here."""
    tokens = docs.select(*[c for c in docs.columns if c.lower() not in ADDED], token_count(F.col("text")).alias("n_tokens"))
    shares = source_shares(tokens)
    if max_passes is not None:
        exponent = exponent_for_repeats(shares, max_passes)
    else:
        exponent = exponent_for_entropy(shares, target_entropy)
    return block_permutations(tokens, weights(shares, exponent, budget), seed)
