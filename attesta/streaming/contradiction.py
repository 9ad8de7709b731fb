"""Contradictions of themes on a stream of their spans.

Polarity is a Column expression, so only spans with a direction are shuffled. State is kept by theme and part, a hash of the
span's id, so that a theme which holds most rows is counted in ``PARTS`` places. A part keeps how many of its spans rise and fall,
and the ids of those whose time the watermark hasn't passed: a span that comes again is known by its id. A timer frees the ids
when it has; the two counts stay. Each change of a part is a row with a version, to be appended anywhere; ``settled`` adds up the
latest ones of each theme.

Defined cases: spans later than the watermark are dropped by Spark, those without a time or an id by ``directed``; a span counts once if
it comes again before the watermark has passed its latest time, with the direction it first came with; a null theme is a theme; themes
without directed spans have no row; an empty stream gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, Settings
from ..functions import text as T
from ..operators import verify
from ..shipping import ship

#: Places in which a theme is counted.
PARTS = 64
STATE = "ids array<long>, times array<long>, up long, down long, version long"
CHANGES = "theme_id long, part int, up long, down long, version long"


def directed(spans: DataFrame, time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """theme_id, part, id, rises and the time of the spans (theme_id, span_id, text) that have a direction."""
    rows = spans.filter(F.col(time_col).isNotNull() & F.col("span_id").isNotNull()).withWatermark(time_col, late)
    told = rows.select("theme_id", "span_id", time_col, T.polarity(F.col("text")).alias("polarity")).filter(F.col("polarity").isin("positive", "negative"))
    key = F.xxhash64("span_id")
    return told.select(F.col("theme_id").cast("long").alias("theme_id"), F.pmod(key, F.lit(PARTS)).cast("int").alias("part"), key.alias("id"), (F.col("polarity") == "positive").alias("rises"), time_col)


def changes(spans: DataFrame, time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """A row under CHANGES whenever a part's counts change, for output mode append. spans: a stream."""
    ship(spans.sparkSession)

    def count(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, times, up, down, version = state.get if state.exists else ((), (), 0, 0, 0)
        seen, before = dict(zip(ids, times, strict=True)), (up, down)
        for rows in () if state.hasTimedOut else batches:
            at = rows[time_col].astype("datetime64[ms]").astype("int64")
            for one, when, rises in zip(rows["id"].tolist(), at.tolist(), rows["rises"].tolist(), strict=True):
                if one not in seen:
                    up, down = up + rises, down + (not rises)
                seen[one] = max(when, seen.get(one, when))
        passed = state.getCurrentWatermarkMs()
        seen = {one: when for one, when in seen.items() if when > passed}
        version += (up, down) != before
        state.update((list(seen), list(seen.values()), up, down, version))
        if seen:
            state.setTimeoutTimestamp(max(seen.values()) + 1)
        if (up, down) != before:
            yield pd.DataFrame([(*key, up, down, version)], columns=["theme_id", "part", "up", "down", "version"])

    keyed = directed(spans, time_col, late).groupBy("theme_id", "part")
    return keyed.applyInPandasWithState(count, CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def settled(changed: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """theme_id, up, down, contradiction and consistency of each theme, by the latest of its ``changes``."""
    latest = changed.groupBy("theme_id", "part").agg(F.max(F.struct("version", "up", "down")).alias("x"))
    sums = latest.groupBy("theme_id").agg(F.sum("x.up").alias("up"), F.sum("x.down").alias("down"))
    up, down = F.col("up"), F.col("down")
    return sums.withColumn("contradiction", (up > 0) & (down > 0)).withColumn("consistency", verify.consistency(up, down, cfg))
