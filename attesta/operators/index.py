"""Relational TF-IDF index and top-k retrieval for all themes at once.

Weights are raw term frequency times ln((1 + N) / (1 + df)) + 1 over 1- and 2-grams, N being all
spans; similarity is the cosine. Term frequencies are counted inside a span's row, without a
shuffle; document frequencies are one aggregation by term.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as T
from ..tables import materialize, tidy
from .segment import with_hygiene, with_verdict


def tally(grams: Column) -> Column:
    """An array of (term, tf): where a term repeats, the runs of the sorted terms."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        pairs = lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), n) - i).cast("long").alias("tf")))
        return T.let(starts, pairs)

    def counted(g: Column) -> Column:
        once = lambda d: F.transform(d, lambda w: F.struct(w.alias("term"), F.lit(1).cast("long").alias("tf")))
        each = T.let(F.array_distinct(g), lambda d: F.when(F.size(d) == F.size(g), once(d)).otherwise(T.let(F.sort_array(g), runs)))
        return F.when(F.size(g) > 0, each).otherwise(F.array().cast("array<struct<term:string,tf:long>>"))

    return T.let(grams, counted)


def row_counts(rows: DataFrame, key: str, text: str = "text", longest: int = 2, cfg: Settings = DEFAULT) -> DataFrame:
    """key and counts, an array of (term, tf), of each text."""
    return rows.select(key, tally(T.ngrams(T.tokens(F.col(text), cfg), longest)).alias("counts"))


def term_counts(rows: DataFrame, key: str, text: str = "text", longest: int = 2, cfg: Settings = DEFAULT) -> DataFrame:
    """key, term, tf: a row per distinct term of each text, whose key is unique."""
    return row_counts(rows, key, text, longest, cfg).select(key, F.explode("counts").alias("c")).select(key, "c.term", "c.tf")


def document_frequency(rows: DataFrame, text: str = "text", longest: int = 2, cfg: Settings = DEFAULT) -> DataFrame:
    """term, df over all texts, partly summed before the one shuffle."""
    terms = F.array_distinct(T.ngrams(T.tokens(F.col(text), cfg), longest))
    return rows.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _counted(rows: DataFrame, text: str = "text", longest: int = 2, cfg: Settings = DEFAULT) -> DataFrame:
    """term, df over all texts, and the number of texts as that of an empty term."""
    terms = F.coalesce(F.array_distinct(T.ngrams(T.tokens(F.col(text), cfg), longest)), F.array().cast("array<string>"))
    return rows.select(F.explode(F.concat(F.array(F.lit("")), terms)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequency(rows: DataFrame, text: str = "text", longest: int = 2, cfg: Settings = DEFAULT) -> DataFrame:
    """term, df and idf over all texts. Texts are counted under an empty term, so that they are read once; the counts are written."""
    counted = materialize(_counted(rows, text, longest, cfg))
    return with_idf(counted.filter("term != ''"), counted.filter("term = ''").select(F.col("df").alias("n")))


def with_idf(frequency: DataFrame, total: DataFrame) -> DataFrame:
    """idf by term; total: one row, n."""
    idf = F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1.0
    return frequency.crossJoin(F.broadcast(total)).select("term", "df", idf.alias("idf"))


@dataclass
class Index:
    spans: DataFrame
    postings: DataFrame  # span_seq, term, tf, w
    terms: DataFrame  # term, df, idf
    norms: DataFrame  # span_seq, nrm
    #: If not null, ``spans`` holds each text once, under a number of its own; these are the spans that have the texts.
    copies: DataFrame | None = None

    def save(self, path: str) -> None:
        if self.copies is not None:
            raise ValueError("An index for given themes isn't kept; build one of all spans.")
        for name in ("spans", "postings", "terms", "norms"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("spans", "postings", "terms", "norms")))


#: Vocabularies up to this many terms are sent to all executors.
FEW_TERMS = 500_000


def weights(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """span_seq, term, tf, w of counts (span_seq, term, tf)."""
    return counts.join(terms.select("term", "idf"), "term").select("span_seq", "term", "tf", (F.col("tf") * F.col("idf")).alias("w"))


def norms_of(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("span_seq").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nrm"))


#: Norms of more spans than this are found for some of them after the other, so that only a part of the postings is shuffled at a time,
NORM_SPANS = 500_000
#: in so many turns at most: each deals the frequencies anew.
NORM_TURNS = 5


def span_norms(spans: DataFrame, cfg: Settings = DEFAULT, by: str = "span_seq") -> DataFrame:
    """The norms of build_index(spans), without its postings. by: a column by whose hash spans are dealt into turns; best one that the
    texts have before they are cut into spans."""
    # A term that isn't written stands in one span
    with tidy(spans.sparkSession):
        counted = materialize(_counted(spans, cfg=cfg).filter("df > 1 OR term = ''"))
    total = counted.filter("term = ''").select("df").first()
    n = total["df"] if total else 0
    idf = F.log((1.0 + n) / (F.lit(1.0) + F.coalesce("df", F.lit(1)))) + 1.0

    def norms(rows: DataFrame) -> DataFrame:
        known = term_counts(rows, "span_seq", cfg=cfg).join(counted.filter("term != ''"), "term", "left")
        return norms_of(known.select("span_seq", (F.col("tf") * idf).alias("w")))

    turns = min(NORM_TURNS, -(-n // NORM_SPANS))
    if turns <= 1:
        return norms(spans)
    found = []
    for i in range(turns):
        with tidy(spans.sparkSession):
            found.append(materialize(norms(spans.filter(F.pmod(F.xxhash64(by), F.lit(turns)) == i))))
    return reduce(DataFrame.unionByName, found)


def _weighted(spans: DataFrame, counts: DataFrame, terms: DataFrame) -> Index:
    postings = materialize(weights(counts, terms))
    return Index(spans, postings, terms, norms_of(postings))


def build_index(spans: DataFrame, themes: DataFrame | None = None, cfg: Settings = DEFAULT) -> Index:
    """Index of all spans (span_seq, text), to answer any themes later; with themes, index_for() these.
    Terms and postings are written once."""
    if themes is not None:
        return index_for(spans, themes, cfg)
    return _weighted(spans, term_counts(spans, "span_seq", cfg=cfg), inverse_frequency(spans, cfg=cfg))


def _text_key(spans: DataFrame) -> list[str]:
    """What spans must share to score and pass alike: the text, and the verdict if they bring one."""
    return ["text", *(c for c in ("eligible",) if c in spans.columns)]


def index_for(spans: DataFrame, themes: DataFrame, cfg: Settings = DEFAULT) -> Index:
    """The part of the index that ``themes`` need, with the scores of the whole: texts that share a term with
    a theme, and the frequencies, over all spans, of these texts' terms.

    Spans of one text score alike, so each text is worked on once and counts as often as it occurs. A first pass
    takes out the near texts; a second counts only their terms.
    """
    wanted = F.broadcast(theme_terms(themes, cfg).agg(F.collect_set("term").alias("_wanted")))  # a few words a theme
    grams = T.ngrams(T.tokens(F.col("text"), cfg), 2)
    # Written, so that the numbers stay
    texts = materialize(spans.groupBy(*_text_key(spans)).agg(F.count(F.lit(1)).alias("_n")).withColumn("span_seq", F.monotonically_increasing_id()))
    maybe = F.exists("_wanted", lambda w: F.contains(F.lower("text"), w))
    near = texts.crossJoin(wanted).filter(maybe).filter(F.arrays_overlap(grams, "_wanted"))
    near = materialize(near.withColumn("_counts", tally(grams)).drop("_wanted", "_n"))
    counts = near.select("span_seq", F.explode("_counts").alias("c")).select("span_seq", "c.term", "c.tf")
    vocabulary = materialize(counts.select("term").distinct())
    seen = texts.select("_n", F.explode(F.array_distinct(grams)).alias("term"))
    if vocabulary.count() <= FEW_TERMS:
        frequency = seen.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.sum("_n").alias("df"))
    else:
        # Summed before the shuffle, not each occurrence sent
        frequency = seen.groupBy("term").agg(F.sum("_n").alias("df")).join(vocabulary, "term", "left_semi")
    total = texts.agg(F.coalesce(F.sum("_n"), F.lit(0).cast("long")).alias("n"))
    made = _weighted(near.drop("_counts"), counts, with_idf(materialize(frequency), total))
    return Index(made.spans, made.postings, made.terms, made.norms, spans)


def theme_terms(themes: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """theme_id, term, tf of themes (theme_id, theme): a handful of terms each."""
    return term_counts(themes, "theme_id", "theme", cfg=cfg)


def theme_vectors(index: Index, themes: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """theme_id, term, qw, qn; terms that no span has drop out."""
    q = index.terms.join(F.broadcast(theme_terms(themes, cfg)), "term").select("theme_id", "term", (F.col("tf") * F.col("idf")).alias("qw"))
    norm = q.groupBy("theme_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    return q.join(F.broadcast(norm), "theme_id")


def similarities(index: Index, themes: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """theme_id, span_seq, score for all pairs that share a term."""
    q = theme_vectors(index, themes, cfg)
    dots = index.postings.join(F.broadcast(q), "term").groupBy("theme_id", "span_seq").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.first("qn").alias("qn"))
    return dots.join(index.norms, "span_seq").select("theme_id", "span_seq", (F.col("dot") / (F.col("nrm") * F.col("qn"))).alias("score"))


def r4(x: Column) -> Column:
    """Four decimals; ties that binary fractions blur go up, alike in every engine."""
    return F.round(x + 1e-9, 4)


#: So many times k spans of a theme are cleaned first; all others only where these hold fewer than k eligible ones.
FIRST_LOOK = 20


def retrieve(index: Index, themes: DataFrame, k: int | None = None, min_score: float | None = None, cfg: Settings = DEFAULT) -> DataFrame:
    """The first k eligible spans of each theme by similarity, then position; rejected spans use no place.

    Spans without hygiene columns get them here, best first, so that only spans that may be returned are cleaned.
    The result, k rows a theme, is written: all later steps read it.
    """
    k, least = cfg.top_k if k is None else k, cfg.min_score if min_score is None else min_score
    scored = materialize(similarities(index, themes, cfg).filter(F.col("score") >= least))
    by_span = Window.partitionBy("theme_id").orderBy(F.round("score", 9).desc(), "span_seq")
    # Texts have no position: those that score alike share a place and all stay, until their spans are ranked
    place = F.row_number().over(by_span) if index.copies is None else F.rank().over(Window.partitionBy("theme_id").orderBy(F.round("score", 9).desc()))

    def best(rows: DataFrame) -> DataFrame:
        near = rows.join(index.spans, "span_seq")
        if "eligible" not in near.columns:
            # Written before the filter: pushed down, it would clean a text anew for every test
            near = materialize(with_hygiene(near, cfg) if index.copies is None else with_verdict(near, cfg))
        return near.filter("eligible").withColumn("retrieval_rank", place).filter(F.col("retrieval_rank") <= k)

    # Cleaning is the costly part, and the first few spans nearly always hold k eligible ones
    some = max(1, k * FIRST_LOOK)
    found = materialize(best(scored.withColumn("_place", place).filter(F.col("_place") <= some).drop("_place")))
    more = scored.groupBy("theme_id").count().filter(F.col("count") > some).select("theme_id")
    more = materialize(more.join(found.groupBy("theme_id").count().filter(F.col("count") >= k), "theme_id", "left_anti"))
    if not more.isEmpty():
        found = found.join(more, "theme_id", "left_anti").unionByName(best(scored.join(more, "theme_id", "left_semi")))
    if index.copies is not None:
        key = _text_key(index.copies)
        each = index.copies.join(materialize(found.select("theme_id", "score", *key)), key)
        found = each.withColumn("retrieval_rank", F.row_number().over(by_span)).filter(F.col("retrieval_rank") <= k)
        if "eligible" not in found.columns:
            found = with_hygiene(materialize(found), cfg)
    return candidates(found, themes, k, cfg)


def candidates(found: DataFrame, themes: DataFrame, k: int, cfg: Settings = DEFAULT) -> DataFrame:
    """The candidates of all later steps, of ranked spans with their hygiene columns; written."""
    step = (1.0 - cfg.rank_floor) / (k - 1) if k > 1 else 0.0
    found = found.withColumns({"semantic_similarity": r4(F.col("score")), "retrieval_rank_score": r4(F.lit(1.0) - (F.col("retrieval_rank") - 1) * F.lit(step))})
    keep = [c for c in ("evidence_type", "polarity") if c in found.columns]
    return materialize(
        found.join(F.broadcast(themes), "theme_id").select(
            "theme_id", "theme", "retrieval_rank", "span_seq", "span_id", "chunk_id", "page_number", "source_document",
            F.col("clean_text").alias("text"), "semantic_similarity", "retrieval_rank_score", *keep,
        )
    )


def span_by_id(index: Index, span_ids: DataFrame) -> DataFrame:
    """Spans by span_id; unknown ids drop out."""
    return index.spans.join(span_ids.select("span_id"), "span_id")
