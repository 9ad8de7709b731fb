"""Phrase collocation mining (operator 12): phrases of 2 to ``LONGEST`` words that stand together more than their parts do.

All 1- to ``LONGEST``-grams of the pieces of a text become rows and are summed by hash per language. A phrase is no more
frequent than any run of its words, so a longer phrase is exploded only where both phrases that are one word shorter may have
the least count: a level for each length, each with the counts of the one before as a filter. Counts of all phrases with the
least count are exact. Then every phrase meets the counts of its two parts at each cut, is scored in decimals by the cut at
which it scores least, and is dropped if an extension by one word, an anti-join, takes in enough of its places. (A longer
phrase that does so has such an extension between, as frequent as itself or more, so one word is enough.)

The filter between levels is a field of ``FILTER`` bits, 32 MB whatever the input, set at the hashes of frequent phrases. A
phrase that passes by chance is counted and falls under the least count; as the field fills, levels come nearer to counting
everything. Each task sums its phrases in blocks before the shuffle, and Spark sums them again; long texts are worked on in
windows that overlap.

Defined cases: null text is empty and has no words; null lang is ``und``; repeated rows count each; a corpus without frequent
phrases, and an empty table, give an empty result; other columns are ignored. Phrases hold any characters but spaces, tabs
and those that split pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, materialize, ship, slices, utf8, windows

LONGEST = 4
#: The least count of a phrase.
LEAST = 30
#: A phrase is dropped if one extension holds so many hundredths of its places.
COVERED = 80
BEST = 2000
#: Score of a phrase whose parts never stand apart.
UNIT = 1_000_000
#: Bytes of text whose phrases are summed together.
BLOCK = 1 << 22
FILTER = 1 << 28
#: Parts of a language that are ranked by themselves first.
SALTS = 16

_END = b"\xff"  # between pieces; no UTF-8 text has it
_TOKENS = bytes(b | 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def tokens_of(text: bytes) -> bytes:
    """Words in lower case and the ends of pieces, between spaces."""
    return text.translate(_TOKENS).replace(_END, b" \xff ")


class _Numbers(dict):
    """Numbers words as they come; ends of pieces are 0."""

    def __init__(self) -> None:
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks(batches: Iterator[pa.RecordBatch], carry: int, most: int) -> Iterator[tuple[str, list[tuple[bytes, int]]]]:
    """A language and windows of its texts, about ``most`` bytes in all at a time."""
    held: dict[str, list[tuple[bytes, int]]] = {}
    size = 0
    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch, "text"), strict=True):
            for part, carried in windows(tokens_of(text), most, carry):
                held.setdefault(lang, []).append((part, carried))
                size += len(part)
                if size >= most:
                    yield from held.items()
                    held, size = {}, 0
    yield from held.items()


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _extend(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one word more."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * _ODD
    return mixed ^ words ^ (mixed >> np.uint64(32))


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of so many bits for each hash."""
    return (hashes >> np.uint64(8)) % np.uint64(size), (hashes * _ODD >> np.uint64(13)) % np.uint64(size)


def may_hold(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for at in _bits(hashes, 64 * len(field)):
        out &= (field[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def filter_of(frequent: DataFrame) -> np.ndarray:
    """The bit field of phrases (lang, phrase): its words are joined in the tasks, and FILTER / 64 is the most there are."""
    size = FILTER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 16):
            places = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), utf8(batch, "phrase"), strict=True):
                hashes = _word_hashes(lang, phrase.split(b" "))
                out = hashes[:1]
                for h in hashes[1:]:
                    out = _extend(out, h)
                places += [int(p[0]) for p in _bits(out, size)]
            at = np.unique(np.array(places, np.int64))
            word, first = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(bits.view(np.int64), pa.int64())], names=["word", "bits"])

    words = frequent.select("lang", "phrase").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    field = np.zeros(size // 64, np.int64)
    field[words["word"].to_numpy()] = words["bits"].to_numpy()
    return field.view(np.uint64)


def grams(lang: str, parts: list[tuple[bytes, int]], length: int, field: np.ndarray | None) -> tuple[list[bytes], np.ndarray]:
    """The distinct phrases of ``length`` words that start in what the windows own, and how often each stands there."""
    number = _Numbers()
    tokens: list[bytes] = []
    foreign: list[tuple[int, int]] = []
    for part, carried in parts:
        tokens += part.split()
        foreign.append((len(tokens) - carried, len(tokens)))
        tokens.append(_END)
    ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    own = ids > 0
    for a, b in foreign:
        own[a:b] = False
    words = list(number)
    if length == 1:
        counts = np.bincount(ids[own], minlength=len(words))
        some = np.flatnonzero(counts)
        return [words[i] for i in some], counts[some]
    each = _word_hashes(lang, words)[ids]
    within, hashes = ids > 0, each
    for n in range(1, length - 1):
        within, hashes = within[:-1] & (ids[n:] > 0), _extend(hashes[:-1], each[n:])
    # Both phrases of one word less have to pass
    able = np.flatnonzero(within)
    passed = np.zeros(len(within), bool)
    passed[able] = may_hold(field, hashes[able])
    at = np.flatnonzero(passed[:-1] & passed[1:] & own[: len(passed) - 1])
    code = ids[at]
    for n in range(1, length):
        code = code * len(words) + ids[at + n]
        if n < length - 1:
            code = np.unique(code, return_inverse=True)[1]  # stays under the number of places
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    columns = [[words[i] for i in ids[at[first] + n].tolist()] for n in range(length)]
    return list(map(b" ".join, zip(*columns, strict=True))), counts


def level(texts: DataFrame, length: int, least: int, field: Broadcast | None = None) -> DataFrame:
    """lang, phrase, n of the phrases of ``length`` words with the least count; words come with a row per language whose
    phrase is empty and whose n counts all words."""
    schema = "lang string, phrase string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, parts in blocks(batches, length - 1, BLOCK):
            phrases, counts = grams(lang, parts, length, field.value if field else None)
            if length == 1:
                phrases, counts = [*phrases, b""], np.append(counts, counts.sum())
            for i in range(0, len(phrases), 1 << 16):
                some = phrases[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array(counts[i : i + (1 << 16)], pa.int64())], names=["lang", "phrase", "n"])

    summed = texts.mapInArrow(run, schema).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return summed.filter((F.col("n") >= least) | (F.col("phrase") == ""))


def counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Exact counts (lang, phrase, words, f) of all phrases of 1 to ``longest`` words with the least count, and the number of
    all words of each language (lang, n); written."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    levels: list[DataFrame] = []
    with batches_of(spark):
        for length in range(1, longest + 1):
            field = spark.sparkContext.broadcast(filter_of(levels[-1])) if levels else None
            found = materialize(level(texts, length, least, field))
            if field:
                field.unpersist()
            levels.append(found.filter("phrase <> ''") if length == 1 else found)
            if length == 1:
                total = found.filter("phrase = ''").select("lang", "n")
    out = levels[0].select("lang", "phrase", F.lit(1).alias("words"), F.col("n").alias("f"))
    for length, found in enumerate(levels[1:], 2):
        out = out.unionByName(found.select("lang", "phrase", F.lit(length).alias("words"), F.col("n").alias("f")))
    return out, total


def scored(found: DataFrame, longest: int = LONGEST, unit: int = UNIT) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every phrase of several words, by its lowest-scoring cut (ties: the first)."""
    some = found.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.substring_index("phrase", " ", k).alias("first"))
    cuts = some.select("*", F.explode(F.filter(F.array(*(cut(k) for k in range(1, longest))), lambda c: c["k"] < F.col("words"))).alias("c"))
    cuts = cuts.select("lang", "phrase", "words", "a", "c.k", "c.first").withColumn("rest", F.expr("substring(phrase, char_length(first) + 2)"))
    part = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    both = cuts.hint("merge").join(part("first", "l"), ["lang", "first"]).hint("merge").join(part("rest", "r"), ["lang", "rest"])
    exact = both.withColumn("score", F.expr(f"(cast({2 * unit} as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    least = exact.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "words")).alias("x"))
    return least.select("lang", "phrase", "x.words", "x.a", "x.l", "x.r", "x.score")


def extended(found: DataFrame) -> DataFrame:
    """lang, phrase, most: the largest count of a phrase of one word more that starts or ends with each phrase."""
    longer = found.filter("words > 2").select("lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    return longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, best: int = BEST, unit: int = UNIT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases by score, count and name."""
    found, total = counts(docs, longest, least)
    within = extended(found).select("lang", "phrase", "most")
    rows = materialize(scored(found, longest, unit)).hint("merge").join(within, ["lang", "phrase"], "left")
    taken = F.expr(f"cast(100 as decimal(3, 0)) * cast(most as decimal(20, 0)) >= cast({covered} as decimal(3, 0)) * cast(a as decimal(20, 0))")
    rows = rows.filter(~F.coalesce(taken, F.lit(False))).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A part of a language first: what is ranked as a whole is SALTS times the best at most
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= best)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return rows.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def query(docs: DataFrame) -> DataFrame:
    return mine(docs)


ORACLE = """WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 5) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
parts AS MATERIALIZED (SELECT lang, phrase, words, a, k, array_to_string(ws[1 : k], ' ') AS first, array_to_string(ws[k + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
cuts AS (SELECT p.*, x.f AS l, y.f AS r, (2000000 * p.a) // (x.f + y.f) AS score FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.first JOIN f y ON y.lang = p.lang AND y.phrase = p.rest),
s AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = s.lang AND c.words > s.words AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * c.a >= 80 * s.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""
