"""Theme discovery: ranked phrases, weak ones filtered, subsets dropped, near-duplicates merged.

Counting phrases is the only step over the corpus; from the 400 most frequent on, tables are that small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..config import DEFAULT, Settings
from ..functions import text as T
from ..tables import materialize
from . import naming
from .index import with_idf


def token_set(phrase: Column) -> Column:
    """Distinct a-z words of three letters or more."""
    return F.array_distinct(F.filter(T.words(F.lower(phrase), "[a-z]+"), lambda w: F.length(w) > 2))


def stem(word: Column) -> Column:
    """Strips the first suffix that fits and leaves three letters."""
    w = F.lower(word)
    out = w
    for suffix in reversed(L.STEM_SUFFIXES):
        fits = F.endswith(w, F.lit(suffix)) & (F.length(w) - len(suffix) >= 3)
        out = F.when(fits, F.substring(w, F.lit(1), F.length(w) - len(suffix))).otherwise(out)
    return out


def stem_set(phrase: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(T.words(F.lower(phrase), "[a-z]+"), lambda w: F.length(w) > 2), stem))


def is_weak(phrase: Column) -> Column:
    """Blacklisted, without a longer word, all generic, or a single broad noun."""
    toks = token_set(phrase)
    own = F.filter(toks, lambda w: ~w.isin(*L.GENERIC))
    broad = (F.size(own) == 1) & F.get(own, 0).isin(*L.BROAD)
    return T.is_blacklisted_theme(phrase) | (F.size(own) == 0) | F.coalesce(broad, F.lit(False))


#: Words of the texts that one task builds phrases of: tasks grow in number with the input, not in size.
PART_WORDS = 1 << 20


def frequent_phrases(chunks: DataFrame, key: str, cfg: Settings = DEFAULT) -> DataFrame:
    """key, term, tf of the ``theme_vocabulary`` most frequent 1- to 3-grams (ties by name) in each text; written.

    A phrase is no more frequent than any of its words. So the words' counts come first, and only phrases of
    words as frequent as the last of the most frequent words are built: exact, and few rows.
    """
    # Keys may repeat: a row is told apart by a number of its own, fixed by writing
    toks = materialize(chunks.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), T.tokens(F.col("text"), cfg).alias("toks")))
    words = materialize(toks.select(F.explode("toks").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    floor = words.orderBy(F.desc("n"), "term").limit(cfg.theme_vocabulary).agg(F.when(F.count(F.lit(1)) == cfg.theme_vocabulary, F.min("n")).otherwise(F.lit(1)).alias("floor"))
    able = materialize(words.crossJoin(F.broadcast(floor)).filter("n >= floor").select("term"))
    parts = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-(words.agg(F.sum("n")).first()[0] or 0) // PART_WORDS))
    placed = toks.select("_row", "_key", F.posexplode("toks").alias("at", "term")).join(able, "term", "left_semi").repartition(parts, "_row")
    w = Window.partitionBy("_row").orderBy("at")
    back = lambda n: F.when(F.lag("at", n).over(w) == F.col("at") - n, F.lag("term", n).over(w))
    near = placed.select("_row", "_key", "term", back(1).alias("one"), back(2).alias("two"))
    grams = F.array("term", F.when(F.col("one").isNotNull(), F.concat_ws(" ", "one", "term")), F.when(F.col("one").isNotNull() & F.col("two").isNotNull(), F.concat_ws(" ", "two", "one", "term")))
    each = near.select("_row", "_key", F.explode(grams).alias("term")).filter("term is not null")
    counts = materialize(each.groupBy("_row", "_key", "term").agg(F.count(F.lit(1)).alias("tf")))
    top = counts.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(cfg.theme_vocabulary).select("term")
    return materialize(counts.join(F.broadcast(top), "term", "left_semi").select("_row", F.col("_key").alias(key), "term", "tf"))


def phrase_scores(chunks: DataFrame, key: str = "chunk_id", cfg: Settings = DEFAULT) -> DataFrame:
    """term, score, n_words: for the most frequent 1- to 3-grams, the sum over chunks of the normalised
    TF-IDF weight, boosted by length. Weights are normalised within this vocabulary; the result is written."""
    rows = chunks.filter(F.coalesce("text", F.lit("")) != "")
    kept = frequent_phrases(rows, key, cfg)
    frequency = kept.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = with_idf(frequency, rows.agg(F.count(F.lit(1)).alias("n")))
    weights = kept.join(F.broadcast(terms), "term").select("_row", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weights.groupBy("_row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nrm"))
    sums = weights.join(norms, "_row").groupBy("term").agg(F.sum(F.col("w") / F.col("nrm")).alias("s"))
    n_words = F.size(F.split("term", " "))
    boost = F.when(n_words == 1, cfg.boost_one).when(n_words == 2, cfg.boost_two).otherwise(cfg.boost_three)
    return materialize(sums.select("term", n_words.alias("n_words"), (F.col("s") * boost).alias("score")))


def ranked(scores: DataFrame) -> DataFrame:
    """Adds rank by score, then name; at most as many rows as the vocabulary."""
    order = F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("neg"), "term", "n_words", "score")))
    return scores.agg(order.alias("a")).select(F.posexplode("a").alias("i", "x")).select((F.col("i") + 1).alias("rank"), "x.term", "x.n_words", "x.score")


def uncovered(rows: DataFrame, rank: str = "rank", toks: str = "toks") -> DataFrame:
    """The rows whose set of words isn't part of an earlier row's set; ranks are distinct, sets arrays of distinct words. An empty
    set is part of any, a null one neither covers nor is covered.

    A set of at most two words is covered if the least rank of the sets with these words is lower: one sum by hash. A longer one is
    looked up by its two rarest words only, among sets of three words or more, and compared with those.
    """
    posted = rows.select(F.col(rank).alias("_by"), F.array_sort(toks).alias("_set"))
    single = F.transform("_set", lambda x: F.array(x))
    pairs = F.flatten(F.transform("_set", lambda x, i: F.transform(F.slice("_set", i + 2, F.size("_set")), lambda y: F.array(x, y))))
    none = F.array(F.array().cast("array<string>"))
    first = posted.select("_by", F.explode(F.concat(none, single, pairs)).alias("_key")).groupBy("_key").agg(F.min("_by").alias("_first"))
    counts = posted.select(F.explode("_set").alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    long_ = posted.filter(F.size("_set") > 2)
    rare = long_.select("_by", F.explode("_set").alias("_w")).join(counts, "_w").groupBy("_by").agg(F.array_sort(F.collect_list(F.struct("_n", "_w"))).alias("_ws"))
    two = rare.select("_by", F.array_sort(F.transform(F.slice("_ws", 1, 2), lambda x: x["_w"])).alias("_pair"))
    short = F.when(F.size(toks) <= 2, F.array_sort(toks))
    keyed = rows.withColumn("_key", short).join(first, "_key", "left").filter(F.coalesce(F.col("_first") >= F.col(rank), F.lit(True))).drop("_key", "_first")
    keyed = keyed.join(two.withColumnRenamed("_by", "_own"), F.col(rank) == F.col("_own"), "left").drop("_own")
    better = long_.select(F.col("_by").alias("_b"), F.col("_set").alias("_bset"), F.explode(pairs).alias("_bpair"))
    inside = (F.col("_pair") == F.col("_bpair")) & (F.col("_b") < F.col(rank)) & (F.size(F.array_except(toks, "_bset")) == 0)
    return keyed.join(better, inside, "left_anti").drop("_pair")


def shortlist(ranks: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """rank, term, n_words of phrases that aren't weak, nor a subset of a better one's words; the best dozen,
    multi-word ones first (place)."""
    strong = ranks.filter(~is_weak(F.col("term"))).withColumn("toks", token_set(F.col("term")))
    best = uncovered(materialize(strong)).orderBy("rank").limit(cfg.theme_candidates)
    order = F.array_sort(F.collect_list(F.struct((F.col("n_words") < 2).alias("single"), "rank", "term", "n_words")))
    rows = best.agg(order.alias("a")).select(F.posexplode("a").alias("i", "x"))
    return rows.select((F.col("i") + 1).alias("place"), "x.rank", F.initcap("x.term").alias("theme"), "x.n_words")


def merge(themes: Column, cfg: Settings = DEFAULT) -> Column:
    """Folds an ordered array of themes: one that overlaps with an earlier one joins the first such, and takes
    its place if it has more words."""
    generic = F.array_distinct(F.transform(F.array(*(F.lit(g) for g in L.GENERIC)), stem))

    def alike(a: Column, b: Column) -> Column:
        both = F.array_intersect(a, b)
        close = F.size(both) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)) >= cfg.theme_merge
        inside = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
        core = (F.size(both) >= 2) | inside | (F.size(F.array_except(both, generic)) >= 1)
        return (F.size(a) > 0) & (F.size(b) > 0) & (close | core)

    def step(kept: Column, theme: Column) -> Column:
        hits = F.transform(kept, lambda k: alike(stem_set(theme), stem_set(k)))

        def place(at: Column) -> Column:
            longer = F.size(token_set(theme)) > F.size(token_set(F.get(kept, at - 1)))
            swapped = F.transform(kept, lambda k, i: F.when((i == at - 1) & longer, theme).otherwise(k))
            return F.when(at > 0, swapped).otherwise(F.concat(kept, F.array(theme)))

        return T.let(F.array_position(hits, F.lit(True)).cast("int"), place)

    return F.aggregate(themes, F.array().cast("array<string>"), step)


def discover_themes(chunks: DataFrame, key: str = "chunk_id", cfg: Settings = DEFAULT, namer: Callable[[list[str], list[str]], list[str] | None] | None = None) -> DataFrame:
    """theme_id, theme: the final themes of a corpus.

    namer: optional, called on the driver with the merged phrases and the first 20 chunk texts (naming.by_asking makes one); its names
    replace the phrases if the flag allows it and it gives any. It is never part of a Spark task.
    """
    listed = shortlist(ranked(phrase_scores(chunks, key, cfg)), cfg)
    merged = listed.agg(F.array_sort(F.collect_list(F.struct("place", "theme"))).alias("a")).select(merge(F.transform("a", lambda x: x["theme"]), cfg).alias("m"))
    raw = merged.select(F.slice("m", 1, max(2 * cfg.themes, 10)).alias("m"))
    if namer is not None and cfg.is_enabled("llm_theme_synthesis"):
        phrases = raw.first()["m"]
        named = namer(phrases, naming.sample(chunks, key)) if phrases else None
        if named:
            rows = [(i, t) for i, t in enumerate(named[: cfg.themes])]
            return chunks.sparkSession.createDataFrame(rows, "theme_id int, theme string")
    return raw.select(F.posexplode(F.slice("m", 1, cfg.themes)).alias("theme_id", "theme"))
