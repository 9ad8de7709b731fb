"""Places of pattern matches, with built-in functions only.

split() and regexp_extract_all() walk the same matches, so a match starts where the pieces and the
matches before it end. Offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,ord:int,start:int,end:int,value:string,left:string,right:string>>"
#: Matches whose places are added up in one array.
RUN = 256


def hits(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _starts(found: Column, pieces: Column) -> Column:
    """Where each match starts: the lengths of the pieces and matches before it, added up.

    Matches go in blocks of ``RUN``: an array grows by copying, so one of n would cost n * n.
    """
    n = F.size(found)

    def step(a: Column, i: Column) -> Column:
        here = a["at"] + F.char_length(F.get(pieces, i))
        return F.struct((here + F.char_length(F.get(found, i))).alias("at"), F.concat(a["starts"], F.array(here)).alias("starts"))

    def block(a: Column, first: Column) -> Column:
        own = F.aggregate(F.sequence(first, F.least(first + RUN, n) - 1), F.struct(a["at"].alias("at"), F.array().cast("array<int>").alias("starts")), step)
        return F.get(F.transform(F.array(own), lambda b: F.struct(b["at"].alias("at"), F.concat(a["starts"], F.array(b["starts"])).alias("starts"))), 0)

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("starts"))
    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(RUN)), empty, block, lambda a: F.flatten(a["starts"]))


def with_spans(df: DataFrame, text: str, name: str, kind: str, order: int, pattern: str, gate: Column, ok, group: int = 0, context: int = 0) -> DataFrame:
    """Adds column ``name``: spans of the matches of ``pattern`` for which ok(match, group's text) holds.

    gate: a cheap test that every text with a match passes. value is the given group's text; left
    and right are up to ``context`` characters around. Matching is leftmost and non-overlapping.
    """
    m, g, p, s = f"_{name}_m", f"_{name}_g", f"_{name}_p", f"_{name}_s"
    t = F.col(text)
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.when(gate, hits(t, pattern)).otherwise(none))
    some = F.size(m) > 0
    df = df.withColumn(g, F.when(some, hits(t, pattern, group)).otherwise(none) if group else F.col(m))
    df = df.withColumn(p, F.when(some, F.split(t, pattern, -1)).otherwise(none))
    start = _starts(F.col(m), F.col(p))
    df = df.withColumn(s, F.when(some, start).otherwise(F.array().cast("array<int>")))
    # Of the pieces and matches around, two matches to either side: neighbours may themselves match
    near = lambda k, end: F.coalesce((F.right if end else F.left)(F.get(F.col(p), k), F.lit(context)), F.lit(""))
    match = lambda k: F.coalesce(F.get(F.col(m), k), F.lit(""))

    def around(i: Column, side: str) -> Column:
        if not context:
            return F.lit("")
        if side == "left":
            return F.right(F.concat(near(i - 2, True), match(i - 2), near(i - 1, True), match(i - 1), near(i, True)), F.lit(context))
        return F.left(F.concat(near(i + 1, False), match(i + 1), near(i + 2, False), match(i + 2), near(i + 3, False)), F.lit(context))

    made = F.transform(
        F.col(s),
        lambda at, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(order).alias("ord"), at.alias("start"), (at + F.char_length(F.get(F.col(m), i))).alias("end"),
            F.get(F.col(g), i).alias("value"), around(i, "left").alias("left"), around(i, "right").alias("right"), F.get(F.col(m), i).alias("match"),
        ),
    )
    kept = F.filter(made, lambda x: ok(x["match"], x["value"]))
    df = df.withColumn(name, F.when(some, kept.cast(SPAN.replace(",right:string", ",right:string,match:string")))).drop(m, g, p, s)
    slim = F.transform(F.col(name), lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "ord", "start", "end", "value", "left", "right"))))
    return df.withColumn(name, F.coalesce(slim, F.array().cast(SPAN)))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind in its order, comma-joined."""
    keys = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["ord"], x["end"], x["kind"])))
    return F.array_join(F.transform(keys, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
