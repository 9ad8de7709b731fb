"""Quality rules with adaptive thresholds (operator 4).

Per document a few integer metrics are taken in one pass over the texts. Their distribution is kept per language and
source as a quantile sketch: counts of logarithmic bins with 64 steps to a doubling (relative error under 1/64).
Sketches merge by adding counts, so those of a language and of the whole corpus come from the same table. The tail
quantile, the median and the lower tail quantile of a source are read from its sketch and shrunk to its language's by
the number of documents behind each, the language's to the corpus's; so a small or spoilt source doesn't set its own
standard. A bound is a fence, ``tail + reach * max(tail - median, floor)`` above and likewise below; the floor, a few
thousandths, is for metrics that are the same in nearly all documents. The bounds are joined to the metrics and decide.

Defined cases: a null or empty text has no words and fails the base rules; null language or source is a group of its
own; each row is judged alone, repeated rows included; an empty table gives an empty result; columns beyond those
named are kept by ``apply_rules``, whatever their names, and ignored elsewhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import heavy_keys, materialize, renamed, ship, skew_join, slices, utf8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = b"#*$%&|<>"
#: Metric: floor of a spread, and whether there is a fence below. Units: thousandths; wlen is hundredths of a character.
METRICS = {"sym": (10, False), "dup": (30, False), "rep": (30, False), "wlen": (20, True)}
#: Duplicate lines that any document may have: in a short one a single copy is a large share.
SPARE_LINES = 2
#: Tail quantile in hundredths, and how far, in spreads between it and the median, a fence stands off.
TAIL, REACH = 85, 5
#: Documents that the standard of the level above counts for.
WEIGHT = 200


def measure(text: bytes) -> tuple[int, ...]:
    """The COUNTS of one text in UTF-8."""
    words = text.split()  # ASCII white space only, as bytes
    n = len(words)
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(seen := set(windows)) < len(windows):
            twice = {w for w, k in Counter(windows).items() if k > 1} if seen else set()
            covered = bytearray(n)
            for i, w in enumerate(windows):
                if w in twice:
                    covered[i : i + 3] = b"\1\1\1"
            repeated = sum(covered)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def with_counts(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of every row and its COUNTS."""
    ship(docs.sparkSession)
    source = docs.select(*columns, *([] if text_col in columns else [text_col]))
    schema = T.StructType([source.schema[c] for c in columns] + [T.StructField(f"q_{c}", T.LongType()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [measure(t) for t in utf8(batch, text_col)]
            new = [pa.array([x[i] for x in found], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + new, names=schema.names)

    return source.mapInArrow(run, schema)


def metric(name: str) -> Column:
    q = lambda c: F.col(f"q_{c}")
    top, bottom = {
        "sym": (q("n_symbols") * 1000, q("word_chars")),
        "dup": (F.greatest(q("n_dup_lines") - SPARE_LINES, F.lit(0)) * 1000, q("n_lines")),
        "rep": (q("n_repeat_words") * 1000, q("n_words")),
        "wlen": (q("word_chars") * 100, q("n_words")),
    }[name]
    return F.floor(top / F.greatest(bottom, F.lit(1))).cast("long")


def to_bin(value: Column) -> Column:
    """Seven leading bits of a value and how many follow: monotone, exact to 127, integer work only."""
    drop = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return (drop * 128).cast("long") + F.floor(value / F.pow(F.lit(2.0), drop)).cast("long")


def bin_floor(b: Column) -> Column:
    """The least value of a bin."""
    drop = F.when(b < 128, F.lit(0)).otherwise(F.floor((b - 64) / 128))
    return ((b - drop * 128) * F.pow(F.lit(2.0), drop)).cast("long")


def base_failed() -> Column:
    return (F.col("q_n_words") < 50) | (F.col("q_n_repeat_words") * 100 > F.col("q_n_words") * 50)


def sketch(counted: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Mergeable sketches: lang, source, metric, bin, n. Only documents with a word take part."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), to_bin(metric(m)).alias("bin")) for m in METRICS))
    cells = counted.filter(F.col("q_n_words") > 0).select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.explode(pairs).alias("p"))
    return cells.groupBy("lang", "source", F.col("p.metric").alias("metric"), F.col("p.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(cells: DataFrame, keys: list[str], tail: int = TAIL) -> DataFrame:
    """Of sketches merged by ``keys``, per metric: n and the quantiles low, mid and high. A group has a few hundred bins at most."""
    merged = cells.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    at = lambda per: F.min(F.when(F.col("upto") * 100 >= F.col("all") * per, bin_floor(F.col("bin"))))
    return run.groupBy(*keys, "metric").agg(F.max("all").alias("n"), at(100 - tail).alias("low"), at(50).alias("mid"), at(tail).alias("high"))


def bounds(cells: DataFrame, weight: int = WEIGHT, reach: int = REACH, tail: int = TAIL) -> DataFrame:
    """A row per language and source: lang, source, docs (its documents with a word), max_<metric> and, with a fence below, min_<metric>."""
    corpus, lang, own = (quantiles(cells, k, tail) for k in ([], ["lang"], ["lang", "source"]))
    three = ("low", "mid", "high")

    def shrunk(rows: DataFrame, above: DataFrame, on: list[str]) -> DataFrame:
        """``rows`` with quantiles drawn to those of ``above``, as if ``weight`` documents had them."""
        above = above.select(*(F.col(c).alias(f"_{c}") for c in (*on, *three)))
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on))
        drawn = {c: (F.col(c) * F.col("n") + F.col(f"_{c}") * weight) / (F.col("n") + weight) for c in three}
        return rows.join(above, same).withColumns(drawn).drop(*(f"_{c}" for c in (*on, *three)))

    lang = materialize(shrunk(lang, materialize(corpus), ["metric"]))
    own = shrunk(own, lang, ["lang", "metric"])
    floor = F.create_map(*(F.lit(x) for m, (least, _) in METRICS.items() for x in (m, least)))[F.col("metric")]
    upper = F.col("high") + reach * F.greatest(F.col("high") - F.col("mid"), floor)
    lower = F.col("low") - reach * F.greatest(F.col("mid") - F.col("low"), floor)
    one = lambda m, bound, name: F.max(F.when(F.col("metric") == m, F.round(bound, 6))).alias(name)
    fences = [one(m, upper, f"max_{m}") for m in METRICS] + [one(m, lower, f"min_{m}") for m, (_, both) in METRICS.items() if both]
    return own.groupBy("lang", "source").agg(F.max("n").alias("docs"), *fences)


#: Bounds are broadcast up to this many groups of language and source (some 10 MB); beyond, they are joined by
#: shuffle, and those of groups that hold a large share of the rows still broadcast. The rows are the same.
BROADCAST_GROUPS = 100_000


def judge(counted: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Adds base_failed, kept and the bounds. Groups that no sketch knows have no outliers."""
    key = lambda a, b: F.to_json(F.struct(F.col(a).cast("string").alias("l"), F.col(b).cast("string").alias("s")))
    limits = limits.withColumn("_group", key("lang", "source")).drop("lang", "source")
    counted = counted.withColumn("_group", key(lang_col, source_col))
    size = limits.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs")).first()
    if size["groups"] <= BROADCAST_GROUPS:
        joined = counted.join(F.broadcast(limits), "_group", "left")
    else:
        joined = skew_join(counted, limits, "_group", heavy_keys(limits, "_group", "docs", size["docs"]))
    odd = F.lit(False)
    for m, (_, both) in METRICS.items():
        odd = odd | F.coalesce(metric(m) > F.col(f"max_{m}"), F.lit(False))
        if both:
            odd = odd | F.coalesce(metric(m) < F.col(f"min_{m}"), F.lit(False))
    return joined.drop("_group", "docs").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~odd)


def assess(docs: DataFrame, weight: int = WEIGHT, reach: int = REACH) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, kept and the bounds applied, for every row of ``docs``.

    The counts (about 70 bytes a row) are written once; sketches and verdicts both read them.
    """
    counted = materialize(with_counts(docs, ["doc_id", "lang", "source"]))
    return judge(counted, materialize(bounds(materialize(sketch(counted)), weight, reach)))


def apply_rules(docs: DataFrame, weight: int = WEIGHT, reach: int = REACH) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Texts aren't shuffled: the counts are
    taken once for the sketches and again beside the text."""
    # The sketches are read at three levels: written once, so that the texts are measured once for them
    limits = materialize(bounds(materialize(sketch(with_counts(docs, ["lang", "source"]))), weight, reach))
    inner, names, back = renamed(docs)
    judged = judge(with_counts(inner, inner.columns, names["text"]), limits, names["lang"], names["source"])
    return back(judged.filter("kept"))


def query(docs: DataFrame) -> DataFrame:
    out = assess(docs)
    names = [c for c in COUNTS if c != "n_lines"]
    return out.select("doc_id", *(F.col(f"q_{c}").alias(c) for c in names), "base_failed", "kept")
