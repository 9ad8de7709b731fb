"""Personal data by bootstrapped contextual extraction (operator 8), built-in functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; these seed entities induce lexical patterns:
the two words before, the two words after, the word on either side, the word before alone if it ends as a label
does (``:``, ``=``, ``#``), and each longer word among the last three before, whatever stands between. The last kind
reaches other wordings than the seeds' ("call us on" beside "call me at"). It asks for twice the seeds and a word nine in ten
of whose places around values are so near before one, so that words of the subject at hand, which stand near and far
alike, say nothing; then a lower confidence will do, as unseen wordings are what it is for. For a value's own score, its
words count as the best of them. Patterns don't depend on a value's form, so they reach identifiers of other forms than the
seeds'. Candidates of the same corpus hang on the same patterns: number groups of seven digits or more, tokens of six
characters or more that mix letters and digits, and addresses that the base doesn't take (no dot in the host, or
``(at)``). Over this graph of patterns and values scores pass to and fro: a pattern's confidence is the mean score of
its values (smoothed; values that aren't seeds count half), a value's score is one minus the product of its patterns'
doubts; seeds stay at one. After
``ROUNDS`` rounds, candidates are spans of kind ``ctx`` where a pattern of high confidence and enough seeds stands
around them, and wherever their value's own score is higher still.

Edges are distinct (pattern, value) pairs, so copies weigh once; sums are pre-aggregated, and
patterns or values that hold a large share of the edges return to them by broadcast (skew_join).

Defined cases: null text is empty, without spans; of a neighbouring word longer than ``CONTEXT`` characters those
nearest to the value count; repeated rows each return; ties don't matter, as scores are sums; an empty table, or one
without seeds, has no pattern and base spans only; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy_keys, materialize, skew_join
from .spans import SPAN, joined, of_kind, with_spans

# The base's patterns. Possessive, so that long runs are walked once; a match starts at the
# beginning of its run or where the match before it ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Number groups, mixed tokens and addresses that may be identifiers.
NUMBERS = r"(?<![0-9A-Za-z])[0-9]++(?:[\x20().-]{1,2}+[0-9]++)*+"
TOKENS = r"(?<![A-Za-z0-9_/-])(?=[A-Za-z_/-]*+[0-9])[A-Za-z0-9_/-]{6,}+"
ADDRESSES = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9.-]{2,}+"

MIN_DIGITS, MAX_DIGITS = 7, 24
ROUNDS = 3
#: A pattern counts with so many distinct seed values and such a confidence; a value counts by itself with the last.
MIN_SEEDS, CONFIDENCE, VALUE_SCORE = 5, 0.9, 0.99
#: Words before a value that are patterns by themselves: so many, of so many letters at least; they start with ``MARK``.
REACH, LETTERS, MARK = 3, 4, "~"
#: Such a word counts with this confidence, if it stands so many times as often near before values as elsewhere around them.
ALONE, NEARER = 0.7, 9
#: What the score of a value that isn't a seed counts for in its patterns: without it, patterns and values that only
#: know each other would talk each other up.
TRUST = 0.5
#: Characters around a value in which its neighbouring words are looked for.
CONTEXT = 256


def luhn(digits: Column) -> Column:
    """The checksum of a string of up to 19 digits; read from its right end."""
    at = F.sequence(F.lit(1), F.char_length(digits))
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(at, F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]++", "")


def _ip_ok(m: Column, v: Column) -> Column:
    bare = F.transform(F.split(m, r"\."), lambda x: F.regexp_replace(x, r"^0++(?=[0-9])", ""))
    return F.forall(bare, lambda x: (F.char_length(x) <= 3) & (F.when(F.char_length(x) <= 3, x).otherwise(F.lit("999")).cast("int") <= 255))


def _card_ok(m: Column, v: Column) -> Column:
    n = F.char_length(_digits(m))
    return F.when(n.between(14, 19), luhn(_digits(m))).otherwise(F.lit(False))


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, base spans and candidate spans, with the text around, of every row. One pass, no shuffle."""
    df = docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    t, yes = F.col("_text"), lambda m, v: F.lit(True)
    df = with_spans(df, "_text", "_email", "email", 0, EMAIL, F.contains(t, F.lit("@")), yes, context=CONTEXT)
    df = with_spans(df, "_text", "_ip", "ip", 1, IP, F.lit(True), _ip_ok, context=CONTEXT)
    df = with_spans(df, "_text", "_card", "card", 2, CARD, F.lit(True), _card_ok, context=CONTEXT)
    df = with_spans(df, "_text", "_phone", "phone", 3, PHONE, F.contains(t, F.lit("+")), lambda m, v: F.char_length(_digits(m)).between(10, 15), context=CONTEXT)
    digits = F.rlike(t, F.lit("[0-9]"))
    mixed = lambda m, v: F.rlike(v, F.lit("[0-9]")) & F.rlike(v, F.lit("[A-Za-z]"))
    df = with_spans(df, "_text", "_num", "ctx", 4, NUMBERS, digits, lambda m, v: F.char_length(_digits(m)).between(MIN_DIGITS, MAX_DIGITS), context=CONTEXT)
    df = with_spans(df, "_text", "_tok", "ctx", 4, TOKENS, digits, mixed, context=CONTEXT)
    df = with_spans(df, "_text", "_adr", "ctx", 4, ADDRESSES, F.contains(t, F.lit("@")) | F.rlike(t, F.lit(r"[(\[]at[)\]]")), yes, context=CONTEXT)
    apart = lambda spans, others: F.when((F.size(spans) > 0) & (F.size(others) > 0), F.filter(spans, lambda x: ~F.exists(others, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))).otherwise(F.col(spans))
    df = df.withColumn("base", F.concat("_email", "_ip", "_card", "_phone")).withColumn("_adr", apart("_adr", F.col("base")))
    df = df.withColumn("_all", F.concat("_num", "_tok")).withColumn("_taken", F.concat("base", "_adr"))
    return df.select("doc_id", "base", F.concat(apart("_all", F.col("_taken")), "_adr").alias("cand"))


def _word(w: Column) -> Column:
    """A word's letters in lower case, with a label's sign at its end: it says that a value follows. One without is ``#``."""
    return F.coalesce(F.nullif(F.concat(F.regexp_replace(F.lower(w), r"[^\p{L}\p{M}]++", ""), F.regexp_extract(w, r"[:=#]\z", 0)), F.lit("")), F.lit("#"))


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"\s++"), lambda w: w != "")


def _alone(words: Column) -> Column:
    """The patterns of single words, distinct."""
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{M}]++", ""))
    return F.array_distinct(F.transform(F.filter(bare, lambda w: F.char_length(w) >= LETTERS), lambda w: F.concat(F.lit(MARK), w)))


def patterns_of(left: Column, right: Column) -> Column:
    """The patterns around a value, as texts."""

    def build(x: Column) -> Column:
        before, after = F.slice(F.reverse(x["l"]), 1, REACH), F.slice(x["r"], 1, 2)
        l1, l2, r1, r2 = (_word(F.get(a, i)) for a, i in ((before, 0), (before, 1), (after, 0), (after, 1)))
        two_left, two_right = F.size(before) >= 2, F.size(after) == 2
        rules = F.array(
            F.when(two_left, F.concat(F.lit("<<"), l2, F.lit(" "), l1)), F.when(two_right, F.concat(F.lit(">>"), r1, F.lit(" "), r2)),
            F.when((F.size(before) > 0) & (F.size(after) > 0), F.concat(F.lit("<>"), l1, F.lit(" "), r1)), F.when(F.rlike(l1, F.lit(r"\p{L}[:=#]\z")), F.concat(F.lit("<"), l1)),
        )
        # A pattern of no word at all says nothing
        return F.concat(F.filter(rules, lambda p: p.isNotNull() & F.rlike(p, F.lit(r"\p{L}"))), _alone(before))

    # bound once: the words are used in several rules
    return F.get(F.transform(F.array(F.struct(_split(left).alias("l"), _split(right).alias("r"))), build), 0)


def farther(left: Column, right: Column) -> Column:
    """The single words around a value that aren't among the last before it, as patterns_of() writes them."""
    before = F.reverse(_split(left))
    return F.array_except(_alone(F.concat(F.slice(before, F.lit(REACH + 1), F.size(before)), _split(right))), _alone(F.slice(before, 1, REACH)))


def instances(found: DataFrame) -> DataFrame:
    """A row per span of ``found`` (with _row) and pattern: _row, span, value (hash), pattern (hash), alone (a single word's), is_seed."""
    each = found.select("_row", F.explode(F.concat("base", "cand")).alias("x"))
    return each.select(
        "_row", F.struct("x.kind", "x.ord", "x.start", "x.end").alias("span"), F.xxhash64("x.value").alias("value"),
        (F.col("x.kind") != "ctx").alias("is_seed"), F.explode(patterns_of(F.col("x.left"), F.col("x.right"))).alias("pattern"),
    ).select("_row", "span", "value", "is_seed", F.startswith("pattern", F.lit(MARK)).alias("alone"), F.xxhash64("pattern").alias("pattern"))


def telling(found: DataFrame, rows: DataFrame) -> DataFrame:
    """pattern: of the single words those that stand among the last before a value ``NEARER`` times as often as elsewhere
    around one. rows: the instances of ``found``. Counts are added up map-side, a row a word and task."""
    near = rows.filter("alone").groupBy("pattern").agg(F.count(F.lit(1)).alias("near"))
    each = found.select(F.explode(F.concat("base", "cand")).alias("x")).select(F.explode(farther(F.col("x.left"), F.col("x.right"))).alias("w"))
    far = each.groupBy(F.xxhash64("w").alias("pattern")).agg(F.count(F.lit(1)).alias("far"))
    return near.join(far, "pattern", "left").filter(F.col("near") >= NEARER * F.coalesce("far", F.lit(0))).select("pattern")


def score_graph(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """edges: distinct pattern, value, is_seed, alone. Gives patterns (pattern, alone, confidence, seeds) and values (value, score)."""
    total = edges.count()
    degree = lambda key: heavy_keys(edges.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "n", total)
    heavy_p, heavy_v = materialize(degree("pattern")), materialize(degree("value"))
    score = F.when(F.col("is_seed"), F.lit(1.0)).otherwise(F.lit(0.0))
    scored = edges.withColumn("score", score)
    for k in range(rounds):
        patterns = scored.groupBy("pattern").agg((F.round(F.sum(F.round("score", 9)), 6) / (F.count(F.lit(1)) + 1)).alias("confidence"), F.count_if("is_seed").alias("seeds"), F.first("alone").alias("alone"))
        patterns = materialize(patterns)
        known = patterns.select("pattern", F.when(F.col("seeds") >= MIN_SEEDS, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"))
        seen = skew_join(edges, known, "pattern", heavy_p)
        doubt = F.exp(F.sum(F.when(~F.col("alone"), F.log(F.lit(1.0) - F.col("confidence"))).otherwise(F.lit(0.0))))
        doubt = doubt * (F.lit(1.0) - F.max(F.when(F.col("alone"), F.col("confidence")).otherwise(F.lit(0.0))))
        values = materialize(seen.groupBy("value").agg(F.round(F.lit(1.0) - doubt, 9).alias("score")))
        if k + 1 < rounds:
            scored = skew_join(edges, values, "value", heavy_v).withColumn("score", F.when(F.col("is_seed"), F.lit(1.0)).otherwise(F.col("score") * TRUST))
    return patterns, values


def discover(found: DataFrame) -> DataFrame:
    """_row and ctx, the discovered spans, for rows that have any."""
    rows = materialize(instances(found))
    edges = materialize(rows.groupBy("pattern", "value").agg(F.max("is_seed").alias("is_seed"), F.first("alone").alias("alone")))
    # Candidates on patterns without seeds can't be vouched for.
    able = edges.groupBy("pattern").agg(F.count_if("is_seed").alias("seeds"), F.first("alone").alias("alone"))
    able = able.filter(F.col("seeds") >= F.when(F.col("alone"), 2 * MIN_SEEDS).otherwise(MIN_SEEDS))
    able = able.join(telling(found, rows).withColumn("tells", F.lit(True)), "pattern", "left").filter("tells OR NOT alone").select("pattern")
    edges = materialize(edges.join(able, "pattern", "left_semi").select("pattern", "value", "is_seed", "alone"))
    patterns, values = score_graph(edges)
    sure = patterns.filter((F.col("confidence") >= F.when(F.col("alone"), ALONE).otherwise(CONFIDENCE)) & (F.col("seeds") >= MIN_SEEDS)).select("pattern")
    known = materialize(values.filter(F.col("score") >= VALUE_SCORE).select("value"))
    open_ = rows.filter(~F.col("is_seed"))
    told = open_.join(sure, "pattern", "left_semi").select("_row", "span").unionByName(open_.join(known, "value", "left_semi").select("_row", "span"))
    return told.groupBy("_row").agg(F.collect_set("span").alias("ctx"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and ctx spans of every row."""
    found = materialize(detect(docs).withColumn("_row", F.monotonically_increasing_id()))
    ctx = discover(found.select("_row", "base", "cand").filter((F.size("base") > 0) | (F.size("cand") > 0)))
    bare = "array<struct<kind:string,ord:int,start:int,end:int>>"
    base = F.transform("base", lambda x: F.struct(x["kind"], x["ord"], x["start"], x["end"]))
    return found.join(ctx, "_row", "left").select("doc_id", base.cast(bare).alias("base"), F.coalesce("ctx", F.array().cast(bare)).cast(bare).alias("ctx"))


def query(docs: DataFrame) -> DataFrame:
    df = scan(docs)
    return df.select(
        "doc_id", *(of_kind(F.col("base"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "ctx")).alias("spans"), F.size("ctx").cast("long").alias("n_ctx"),
    )


