"""Stored spans that later sessions find again, for as long as the source files stay as they are."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from revspan.functions.calendar import Calendar
from revspan.operators.spans import account_spans
from revspan.sources.files import children, exists, remove, rename, source_files

#: Raise this when the spans' columns or meaning change: stored spans of another layout are not found.
LAYOUT = 2


def fingerprint(accounts: DataFrame, subscriptions: DataFrame, calendar: Calendar, attribute: str) -> str:
    """Of the source files (path, size, time of change), what is read from them, the calendar and the layout."""
    spark = accounts.sparkSession
    bounds = calendar.bounds(spark).first()
    parts = [str(LAYOUT), attribute, str(bounds.first_month), str(bounds.last_month)]
    parts += [f"{f.path} {f.size} {f.modified}" for f in source_files([accounts, subscriptions])]
    # Two mappings of the same files differ in their plans; the numbers of expressions differ from call to call.
    parts += [re.sub(r"#\d+L?", "", df._jdf.queryExecution().analyzed().toString()) for df in (accounts, subscriptions)]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


def cached_spans(
    accounts: DataFrame, subscriptions: DataFrame, calendar: Calendar, attribute: str, folder: str, keep: int = 8
) -> DataFrame:
    """account_spans from ``folder``, computed and written there if the sources have none yet.

    Spans become visible by one rename when they are complete; of two sessions that write the same ones the
    first wins. The ``keep`` newest stay, older ones are removed. Tables that are not read from files
    have no fingerprint and raise."""
    spark = accounts.sparkSession
    if not (accounts.inputFiles() and subscriptions.inputFiles()):
        raise ValueError("spans are cached for tables that are read from files")
    pinned = calendar.resolve(spark)
    path = f"{folder}/spans-{fingerprint(accounts, subscriptions, pinned, attribute)}"
    if not exists(spark, path):
        writing = f"{folder}/writing-{uuid.uuid4().hex}"
        account_spans(accounts, subscriptions, pinned, (attribute,)).write.parquet(writing)
        if not rename(spark, writing, path):
            remove(spark, writing)
        _expire(spark, folder, keep, path)
    return spark.read.parquet(path)


def _expire(spark: SparkSession, folder: str, keep: int, new: str) -> None:
    stored = [f for f in children(spark, folder) if f.path.rsplit("/", 1)[-1].startswith("spans-")]
    for old in sorted(stored, key=lambda f: f.modified, reverse=True)[keep:]:
        if not old.path.endswith(new.rsplit("/", 1)[-1]):
            remove(spark, old.path)
