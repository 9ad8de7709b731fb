"""An index that is kept in files, answers any themes by reading few of its blocks, and takes changes without a rebuild.

**Layout.** An index is a folder of segments, each with three tables. ``postings``: the postings of a term in blocks of about
``BLOCK`` spans of like weight, each with its largest; bucketed by term (and by a part of it, so that a frequent term isn't
one bucket), in the order of term and weight. A posting has the term's count over a length that the span's vector has at least. ``terms``: what the segment adds to a term's document frequency, and the idf it
had then; bucketed by term. ``spans``: texts and hygiene columns; bucketed and ordered by span_id, with Bloom
filters, so that a lookup reads few row groups. Tables are read by their buckets: neither postings nor terms nor spans are
shuffled to be joined; what is asked for is. Spans that can't be evidence count in frequencies but have no postings. An index
that is built for lookups alone has only ``spans``.

**Lengths.** A span's vector is as long as the idf of all its terms say. The idf of frequent terms is sent to all tasks; other terms count
with the least that theirs can be. So a posting is made where its span is read and dealt once, and its weight is a bound. Bounds only decide which blocks are read.

**Search.** A posting's weight, times the idf of now, is the most that its term can have of the span's vector, and a theme's score of a span is at most the sum of the
products of weights. The best blocks of a theme give k spans and so a least score. A span not seen scores at most the sum,
over the theme's terms, of what their unread blocks allow; with one level for all terms, as high as that sum stays under the
least score, all blocks under the level are left unread, and terms that never reach it aren't opened at all. Spans found are scored
exactly, by the terms of their texts and the frequencies of now.

**Changes.** ``update`` writes one more segment: new versions of changed spans, marks for deleted ones, and differences of
frequencies. It reads the old versions by id, and the terms of those and of the new ones. Lengths in older segments are then
of another idf; a factor for each segment, how far any idf may have fallen since, keeps its bounds true, so results equal those
of an index built anew. A segment is part of the index once its row is in ``meta``.

Defined cases: a null text has no terms; a span_id that repeats within one call is one span, the one with the largest place;
rows without a span_id are left out; unknown ids drop out of lookups and deletions; themes without a known term find nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..config import DEFAULT, Settings
from ..functions import text as T
from ..tables import mark, materialize, release, tidy
from . import index as I
from .segment import with_hygiene

#: Spans of a block, about.
BLOCK = 128
#: Levels of weight that the blocks of a frequent term keep apart.
LAYERS = 32
#: Buckets that one term's postings may be spread over.
PARTS = 16
BUCKETS = 32
#: Terms whose idf is sent to all tasks, at most: the most frequent ones.
FEW_TERMS = 500_000
#: So many times k places of a theme's best blocks are read for the least score.
FIRST = 8
#: Ids up to this number are looked up by pushed-down equality; more are joined by buckets.
PUSHED = 500
#: Bytes of a row group of spans: lookups read whole ones.
GROUP_BYTES = 1 << 20
#: Ids of a row group, about: without this number each has a Bloom filter of its own size.
GROUP_IDS = 1 << 14
#: Scores are ordered by nine decimals; sums of products may differ in the last of them.
SLACK = 4e-9

META = "version int, segment int, spans long, total long, floor double, buckets int, columns string, search boolean"
TERMS = "term string, change long, df long, idf double"
POSTINGS = "term string, part int, layer int, salt long, top double, n long, spans array<struct<span_id:string,x:double>>"
KEPT = ("span_seq", "chunk_id", "page_number", "source_document", "text", "clean_text", "eligible", "evidence_type", "polarity")


@dataclass(frozen=True)
class Part:
    """A segment: spans it added less those it took away, all spans when it was made, and the least ratio of any idf of now to
    that of then."""

    segment: int
    spans: int
    total: int
    floor: float


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _any(tests: list[Column]) -> Column:
    """Whether one of the tests holds; halved, so that a long list isn't a deep expression."""
    if len(tests) < 2:
        return tests[0] if tests else F.lit(False)
    return _any(tests[: len(tests) // 2]) | _any(tests[len(tests) // 2 :])


def _idf(total: int | Column, df: Column) -> Column:
    return F.log((F.lit(1.0) + total) / (F.lit(1.0) + df)) + 1.0


def _one_of(name: str, values: list[str]) -> Column:
    """Whether a column has one of a few values: equalities, which reach statistics and Bloom filters (of a longer list only the range would),
    behind a set, so that rows which are read aren't compared with each."""
    return F.col(name).isin(values) & _any([F.col(name) == v for v in values]) if values else F.lit(False)


def _part(x: Column, df: Column) -> Column:
    """The number of a posting's group within its term and level: as many as keep groups near BLOCK spans."""
    return F.pmod(F.xxhash64(x), F.greatest(F.lit(1), F.ceil(df / (BLOCK * LAYERS / 4))).cast("long"))


class StoredIndex:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, parts: list[Part], version: int, buckets: int = BUCKETS, cfg: Settings = DEFAULT, columns: str = "", search: bool = True) -> None:
        self.spark, self.path, self.parts, self.version, self.buckets, self.cfg = spark, path.rstrip("/"), parts, version, buckets, cfg
        self.columns = columns  # of spans, as DDL
        self.search = search  # has terms and postings
        self._named = uuid.uuid4().hex[:12]  # of this session's views of the files
        self._tables: dict[str, str] = {}

    # --- files ---------------------------------------------------------------------------------------

    @staticmethod
    def build(spans: DataFrame, path: str, buckets: int = BUCKETS, cfg: Settings = DEFAULT, search: bool = True) -> StoredIndex:
        """Writes an index of all spans (span_id, span_seq, chunk_id, page_number, source_document, text) to a new folder. Without search
        it has no terms and postings, and is for lookups by id alone."""
        made = StoredIndex(spans.sparkSession, path, [], -1, buckets, cfg, search=search)
        return made.update(spans)

    @staticmethod
    def load(spark: SparkSession, path: str, cfg: Settings = DEFAULT) -> StoredIndex:
        """The last version of an index, in any session."""
        rows = spark.read.schema(META).json(f"{path.rstrip('/')}/meta")
        last = rows.agg(F.max("version")).first()[0]
        found = rows.filter(F.col("version") == last).orderBy("segment").collect()  # a row a segment
        return StoredIndex(spark, path, [Part(r["segment"], r["spans"], r["total"], r["floor"]) for r in found], last, found[0]["buckets"], cfg, found[0]["columns"], found[0]["search"] is not False)

    def _commit(self, parts: list[Part]) -> StoredIndex:
        rows = [(self.version + 1, p.segment, p.spans, p.total, p.floor, self.buckets, self.columns, self.search) for p in parts]
        self.spark.createDataFrame(rows, META).coalesce(1).write.mode("append").json(f"{self.path}/meta")
        return StoredIndex(self.spark, self.path, parts, self.version + 1, self.buckets, self.cfg, self.columns, self.search)

    def _save(self, rows: DataFrame, segment: int, name: str, keys: list[str], order: list[str], options: dict[str, str] | None = None, dealt: bool = False) -> None:
        """dealt: the rows are parted by buckets already."""
        table = f"attesta_{uuid.uuid4().hex}"
        dealt = rows if dealt else rows.repartition(self.buckets, *keys)
        dealt.write.format("parquet").options(**(options or {})).bucketBy(self.buckets, *keys).sortBy(*order).option("path", f"{self.path}/{segment}/{name}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay

    _KEYS = {"postings": (["term", "part"], ["term", "top"]), "terms": (["term"], ["term"]), "spans": (["span_id"], ["span_id"])}  # noqa: RUF012

    def table(self, segment: int, name: str) -> DataFrame:
        """A table of a segment, by its buckets."""
        at = f"{segment}/{name}"
        if at not in self._tables:
            view = f"attesta_{self._named}_{segment}_{name}"
            keys, order = self._KEYS[name]
            columns = {"postings": POSTINGS, "terms": TERMS, "spans": self.columns}[name]
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {view} ({columns}) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(order)}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{at}'"
            )
            self._tables[at] = view
        return self.spark.table(self._tables[at])

    def close(self) -> None:
        """Forgets this session's views of the files."""
        for view in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {view}")
        self._tables.clear()

    @property
    def total(self) -> int:
        return self.parts[-1].total if self.parts else 0

    # --- lookups -------------------------------------------------------------------------------------

    def _few(self, values: DataFrame) -> Column | None:
        """A filter for the values of the one column of ``values`` (written, without repeats), if they are few."""
        (name,) = values.columns
        few = [r[name] for r in values.limit(PUSHED + 1).collect()]
        return _one_of(name, few) if len(few) <= PUSHED else None

    def _versions(self, ids: DataFrame) -> DataFrame:
        """Of each known id (column span_id of ``ids``, written, without repeats) its last version, deleted ones included."""
        few = self._few(ids)
        found = []
        for p in self.parts:
            rows = self.table(p.segment, "spans")
            rows = rows.filter(few) if few is not None else rows.join(ids, "span_id", "left_semi")
            found.append(rows.withColumn("segment", F.lit(p.segment)))
        rows = _union(found)
        if len(found) == 1:
            return rows
        last = F.max_by(F.struct(*(c for c in rows.columns if c != "span_id")), "segment")
        return rows.groupBy("span_id").agg(last.alias("x")).select("span_id", "x.*")

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The spans of the given ids (span_id); unknown and deleted ones drop out."""
        wanted = materialize(ids.select("span_id").filter("span_id is not null").distinct())
        return self._versions(wanted).filter("not deleted").drop("deleted", "segment")

    def _searched(self) -> None:
        if not self.search:
            raise ValueError("This index was built for lookups alone.")

    def frequencies(self, terms: DataFrame, few: Column | None = None) -> DataFrame:
        """term, df and idf of the given terms (term, without repeats) that any span has now. few: a filter that they pass."""
        self._searched()
        read = [self.table(p.segment, "terms").select("term", "change") for p in self.parts]
        found = [(df if few is None else df.filter(few)).join(terms, "term", "left_semi") for df in read]
        now = _union(found).groupBy("term").agg(F.sum("change").alias("df")) if len(found) > 1 else found[0].withColumnRenamed("change", "df")
        return now.filter("df > 0").select("term", "df", _idf(self.total, F.col("df")).alias("idf"))

    # --- changes -------------------------------------------------------------------------------------

    def update(self, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> StoredIndex:
        """The index with new or changed spans (as for build) put in and others (span_id) taken out; a changed span that is
        deleted as well stays. Reads the old versions of these spans and the terms they have or had."""
        since = mark()
        with tidy(self.spark):
            made = self._updated(changed, deleted)
        release(self.spark, since)
        return made

    def _updated(self, changed: DataFrame | None, deleted: DataFrame | None) -> StoredIndex:
        segment = max((p.segment for p in self.parts), default=-1) + 1
        named = [df.select("span_id") for df in (changed, deleted) if df is not None]
        old = gone = None
        if self.parts:
            ids = materialize(_union(named).filter("span_id is not null").distinct())
            old = materialize(self._versions(ids).filter("not deleted").select("span_id", "text"))
            gone = old.select("span_id")
            if changed is not None:
                gone = gone.join(changed.select("span_id").filter("span_id is not null").distinct(), "span_id", "left_anti")

        # Spans, with marks for those that go
        kept = []
        if changed is not None:
            kept.append(self._prepared(changed).withColumn("deleted", F.lit(False)))
        if gone is not None:
            like = self._schema() if changed is None else kept[0].schema
            blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in like if f.name not in ("span_id", "deleted")]
            kept.append(gone.select("span_id", *blank, F.lit(True).alias("deleted")))
        if not kept:
            kept.append(self.spark.createDataFrame([], self._schema()))
        columns = self.columns or kept[0].schema.toDDL()
        options = {
            "parquet.block.size": str(GROUP_BYTES), "parquet.page.size": str(1 << 16),
            "parquet.bloom.filter.enabled#span_id": "true", "parquet.bloom.filter.expected.ndv#span_id": str(GROUP_IDS),
        }
        self._save(_union(kept), segment, "spans", *self._KEYS["spans"], options, dealt=gone is None and changed is not None)
        made = StoredIndex(self.spark, self.path, self.parts, self.version, self.buckets, self.cfg, columns, self.search)
        rows = made.table(segment, "spans").filter("not deleted")
        added, removed = rows.count(), (old.count() if old is not None else 0)
        total = self.total + added - removed
        made.parts = [*self.parts, Part(segment, added - removed, total, 1.0)]
        if not self.search:
            return made._commit(made.parts)

        # Frequencies: differences, and the idf with them
        each = lambda df, n: df.select(F.explode(F.array_distinct(self._grams())).alias("term"), F.lit(n).cast("long").alias("change"))
        changes = [each(df, n) for df, n in ((rows, 1), (old, -1)) if df is not None]
        change = _union(changes).groupBy("term").agg(F.sum("change").alias("change"))
        if self.parts:
            change = materialize(change)
            before = self.frequencies(change.select("term")).select("term", F.col("df").alias("before"))
            change = change.join(before, "term", "left").withColumn("df", F.coalesce("before", F.lit(0).cast("long")) + F.col("change"))
        else:
            change = change.withColumn("df", F.col("change"))
        self._save(change.select("term", "change", "df", _idf(total, F.col("df")).alias("idf")), segment, "terms", *self._KEYS["terms"])

        self._save(made._blocks(rows, segment), segment, "postings", *self._KEYS["postings"], dealt=True)
        return made._commit([*(made._aged(p) for p in self.parts), made.parts[-1]])

    def _schema(self) -> StructType:
        return _parse_datatype_string(self.columns)

    def _grams(self) -> Column:
        """The terms of a span's text, as often as they occur: found anew where they are needed, as they take several times the room of the text."""
        return T.ngrams(T.tokens(F.coalesce("text", F.lit("")), self.cfg), 2)

    def _prepared(self, spans: DataFrame) -> DataFrame:
        """Spans with hygiene columns, one of each id, parted by buckets."""
        rows = spans.filter("span_id is not null")
        given = [c for c in KEPT if c in rows.columns] if "eligible" in rows.columns else ["span_seq", "chunk_id", "page_number", "source_document", "text"]
        # An id that repeats is met by a grouping; few do, but none is known before
        dealt = rows.select("span_id", *given).repartition(self.buckets, "span_id")
        one = dealt.groupBy("span_id").agg(F.max_by(F.struct(*given), "span_seq").alias("x")).select("span_id", "x.*")
        return one if "eligible" in one.columns else with_hygiene(one, self.cfg)

    def _blocks(self, rows: DataFrame, segment: int) -> DataFrame:
        """term, part, layer, salt, top (largest weight), n and spans (span_id, x) of the segment's eligible spans, parted by buckets."""
        each = rows.filter("eligible").select("span_id", F.explode(I.tally(self._grams())).alias("c")).select("span_id", "c.term", "c.tf")
        often, rest = self._frequent(segment)
        w = F.col("tf") * F.coalesce("idf", rest)
        norm = F.sqrt(F.sum(w * w).over(Window.partitionBy("span_id")))  # of buckets, which aren't shuffled
        known, frequent = each.join(F.broadcast(often), "term", "left").withColumn("x", F.col("tf") / norm), F.col("df").isNotNull()
        # Other terms are one block each
        layer = F.when(frequent, F.floor(F.col("x") * F.col("idf") * LAYERS)).otherwise(0).cast("int")
        salt = F.when(frequent, _part(F.col("span_id"), F.col("df"))).otherwise(0).cast("long")
        keyed = known.select("term", (salt % PARTS).cast("int").alias("part"), layer.alias("layer"), salt.alias("salt"), F.struct("span_id", "x").alias("s"))
        return keyed.repartition(self.buckets, "term", "part").groupBy("term", "part", "layer", "salt").agg(F.max("s.x").alias("top"), F.count(F.lit(1)).alias("n"), F.collect_list("s").alias("spans"))

    def _frequent(self, segment: int) -> tuple[DataFrame, Column]:
        """term, df and idf (written) of the segment's terms that more than BLOCK spans have, or more than the least multiple by a power of two that leaves
        FEW_TERMS of them; and the least idf of the others."""
        terms = self.table(segment, "terms").filter(F.col("df") > BLOCK)
        sizes = terms.groupBy(F.floor(F.log2(F.col("df") / BLOCK)).alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a power of two
        power = 0
        while sum(r["n"] for r in sizes if r["power"] >= power) > FEW_TERMS:
            power += 1
        least = BLOCK << power
        return materialize(terms.filter(F.col("df") > least).select("term", "df", "idf")), _idf(self.total, F.lit(least))

    def _aged(self, p: Part) -> Part:
        """A segment with the least ratio of any term's idf of now to that of its time. Terms that no later segment has keep
        their frequency: for those the number of all spans decides."""
        quiet = 1.0
        if self.total < p.total:
            quiet = self.spark.range(1).select(1.0 + F.log((F.lit(1.0) + self.total) / (F.lit(1.0) + p.total))).first()[0]
        later = _union([self.table(q.segment, "terms").select("term") for q in self.parts if q.segment > p.segment]).distinct()
        then = self.table(p.segment, "terms").filter("df > 0").select("term", F.col("idf").alias("then")).join(later, "term")
        least = self.frequencies(later).join(then, "term").agg(F.min(F.col("idf") / F.col("then")).alias("least")).first()["least"]
        return Part(p.segment, p.spans, p.total, max(1e-6, min(quiet, 1.0 if least is None else least)))

    # --- search --------------------------------------------------------------------------------------

    def _asked(self, themes: DataFrame) -> DataFrame:
        """theme_id, term, qw and q (the part of the theme's vector) of terms that some span has; written."""
        terms = materialize(I.theme_terms(themes, self.cfg))
        wanted = materialize(terms.select("term").distinct())
        known = terms.join(self.frequencies(wanted, self._few(wanted)), "term").select("theme_id", "term", (F.col("tf") * F.col("idf")).alias("qw"), "idf")
        norm = F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy("theme_id")))
        return materialize(known.select("theme_id", "term", "idf", "qw", norm.alias("qn"), (F.col("qw") / norm).alias("q")))

    def reachable(self, asked: DataFrame) -> DataFrame:
        """The blocks of the themes' terms, without their spans: theme_id, segment, term, part, layer, salt, n, and bound, the
        most that a span of the block gets from the term."""
        few = self._few(materialize(asked.select("term").distinct()))
        found = []
        for p in self.parts:
            q = asked.select("theme_id", "term", (F.col("q") * F.col("idf") / p.floor).alias("most"))
            q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
            heads = self._postings(p, few).select("term", "part", "layer", "salt", "top", "n")
            found.append(heads.join(q, ["term", "part"]).select("theme_id", F.lit(p.segment).alias("segment"), "term", "part", "layer", "salt", "n", "most", (F.col("top") * F.col("most")).alias("bound")))
        return _union(found)

    def _postings(self, p: Part, few: Column | None) -> DataFrame:
        rows = self.table(p.segment, "postings")
        return rows if few is None else rows.filter(few)

    def _spans_in(self, blocks: DataFrame) -> DataFrame:
        """theme_id, span_id of the spans of blocks (as of reachable(), written) whose own bound is at least the block's level."""
        few = self._few(materialize(blocks.select("term").distinct()))
        found = []
        for p in self.parts:
            wanted = blocks.filter(F.col("segment") == p.segment).select("theme_id", "term", "part", "layer", "salt", "most", "level")
            whole = self._postings(p, few).select("term", "part", "layer", "salt", "spans").join(wanted, ["term", "part", "layer", "salt"])
            each = whole.select("theme_id", "most", "level", F.explode("spans").alias("s"))
            found.append(each.filter(F.col("s.x") * F.col("most") >= F.col("level")).select("theme_id", "s.span_id"))
        return _union(found).distinct()

    def scored(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """theme_id, score and the columns of the span, for pairs (theme_id, span_id, written) of eligible spans that are
        there now; written. Scores are exact."""
        ids = materialize(pairs.select("span_id").distinct())
        rows = materialize(self._versions(ids).filter("not deleted and eligible").drop("deleted", "segment"))
        each = rows.select("span_id", F.explode(I.tally(self._grams())).alias("c")).select("span_id", "c.term", "c.tf")
        idf = self.frequencies(each.select("term").distinct()).select("term", "idf")
        weighed = materialize(each.join(idf, "term").select("span_id", "term", (F.col("tf") * F.col("idf")).alias("w")))
        norms = weighed.groupBy("span_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nrm"))
        dots = weighed.join(asked.select("theme_id", "term", "qw", "qn"), "term").join(pairs, ["theme_id", "span_id"])
        dots = dots.groupBy("theme_id", "span_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.first("qn").alias("qn"))
        scores = dots.join(norms, "span_id").select("theme_id", "span_id", (F.col("dot") / (F.col("nrm") * F.col("qn"))).alias("score"))
        return materialize(scores.join(rows, "span_id"))

    def top_k(self, themes: DataFrame, k: int | None = None, min_score: float | None = None) -> tuple[DataFrame, DataFrame]:
        """What index.retrieve() gives for ``themes`` (theme_id, theme), and a report: theme_id, blocks of the theme's terms,
        blocks_read, spans_scored."""
        self._searched()
        k, least = self.cfg.top_k if k is None else k, self.cfg.min_score if min_score is None else min_score
        asked = self._asked(themes)
        heads = materialize(self.reachable(asked))
        key = ["theme_id", "segment", "term", "part", "layer", "salt"]
        # The best blocks of each theme
        best = Window.partitionBy("theme_id").orderBy(F.desc("bound"), *key[1:])
        before = F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = materialize(heads.withColumn("before", before).filter(F.col("before") < k * FIRST).withColumn("level", F.lit(0.0)))
        seen = materialize(self._spans_in(first))
        found = self.scored(seen, asked)
        by_score = Window.partitionBy("theme_id").orderBy(F.round("score", 9).desc(), "span_seq")
        kth = found.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") == k).select("theme_id", F.greatest(F.col("score"), F.lit(least)).alias("goal"))
        # What is left unread stays under the k-th score
        tops = heads.groupBy("theme_id", "term").agg(F.max("bound").alias("c")).groupBy("theme_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
        goal = F.coalesce(F.col("goal"), F.lit(least)) - SLACK
        levels = tops.join(kth, "theme_id", "left").select("theme_id", level(F.col("cs"), goal).alias("level"))
        more = heads.join(F.broadcast(levels), "theme_id").filter(F.col("bound") >= F.col("level"))
        more = materialize(more.join(first.select(*key), key, "left_anti"))
        rest = materialize(self._spans_in(more).join(seen, ["theme_id", "span_id"], "left_anti"))
        both = found if rest.isEmpty() else found.unionByName(self.scored(rest, asked))
        ranked = both.filter(F.col("score") >= least).withColumn("retrieval_rank", F.row_number().over(by_score)).filter(F.col("retrieval_rank") <= k)
        count = lambda df, name: df.groupBy("theme_id").agg(F.count(F.lit(1)).alias(name))
        report = count(heads, "blocks").join(count(first.select(*key).unionByName(more.select(*key)), "blocks_read"), "theme_id").join(count(seen.unionByName(rest), "spans_scored"), "theme_id")
        return I.candidates(ranked, themes, k, self.cfg), report


def level(tops: Column, goal: Column) -> Column:
    """The highest level v for which the sum of min(v, c) over the ascending array ``tops`` stays under ``goal``; above all of
    them if their sum does."""
    n = F.size(tops)

    def fill(a: Column, c: Column) -> Column:
        # v: the level if c and all that follow are over it
        v = (goal - a["sum"]) / (n - a["i"])
        return F.struct((a["i"] + 1).alias("i"), (a["sum"] + c).alias("sum"), F.when(a["v"].isNull() & (v <= c), v).otherwise(a["v"]).alias("v"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("v"))
    return F.coalesce(F.aggregate(tops, start, fill)["v"], F.lit(2.0) * F.array_max(tops) + 1.0)
