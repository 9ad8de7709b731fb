"""Importance resampling towards a target distribution (operator 11).

Texts are bags of word n-grams (1 to ``N`` words), hashed to ``BUCKETS`` buckets. A bucket's gain is the logarithm of how much
more of the target falls into it than of the corpus; a document's weight is the sum of its features' gains. A document's own
noise is added to the weight, and the documents with the highest sums are drawn: a sample without replacement by weight.

Texts are worked on in chunks that overlap: a long text is cut between words, each chunk goes on with the next ``N`` - 1 words,
and owns the features that start before those. So a feature is counted once, whatever the cuts, and no task holds the words of
a whole text. Texts up to ``LONG`` bytes are one chunk where they are; the chunks of longer ones are dealt over all tasks, and
their counts and weights are summed by document.

Bucket counts are summed in each task first (at most a row a bucket); the gains, a number a bucket, go to all tasks. Documents
are ranked by ranges of the score, so no task gets all of them.

Defined cases: null and empty texts, and texts without words, have no features and weight 0; repeated rows are documents each;
a null doc_id draws noise as an empty id; of documents that tie on score and id, the one with more features, then the one
with the larger weight, then either comes first; an empty table gives an empty result; an empty target gives gains from the
corpus alone; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, materialize, ranked, read, ship, slices, utf8, windows

N = 3
BUCKETS = 10_000
#: Texts of more bytes are cut, into chunks of about this size.
LONG = 1 << 15
#: Bytes of text that are hashed together.
BLOCK = 1 << 20
LEAST_WORDS = 20
#: Hundredths of the documents with enough words that are drawn.
SHARE = 5
SEED = 42
#: What a distribution counts in thousandths.
UNIT = 1000

#: Bytes of words stay, A-Z in lower case; all others become spaces.
_WORDS = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> bytes:
    """The text's words, lower-cased, between spaces."""
    return text.translate(_WORDS)


def features(parts: list[tuple[bytes, int]], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For some chunks (words between spaces, and how many at the end aren't their own): the bucket of every feature, the
    chunk it belongs to, and how many words each chunk owns.

    The checksum of a longer feature goes on from that of the feature one word shorter.
    """
    split = [p.split() for p, _ in parts]
    sizes = np.array([len(w) for w in split], np.int64)
    owned = sizes - np.array([c for _, c in parts], np.int64)
    words = [w for ws in split for w in ws]
    chunk = np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - place  # words from here to the end of the chunk
    own = place < np.repeat(owned, sizes)
    found, of = [], []
    sums = list(map(crc32, words))
    for length in range(1, n + 1):
        if length > 1:  # sums[i] goes on with a space and the word that follows
            sums = list(map(crc32, words[length - 1 :], map(crc32, repeat(b" "), sums)))
        whole = np.flatnonzero(own & (left >= length))
        found.append(np.array(sums, np.int64)[whole] % buckets)
        of.append(chunk[whole])
    return np.concatenate(found), np.concatenate(of), owned


def chunks(texts: DataFrame, n: int = N) -> DataFrame:
    """_row, doc_id, chunk (bytes, words between spaces) and carried (words at its end that the next chunk owns) of texts (_row, doc_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row, doc_id = (batch.column(c) for c in ("_row", "doc_id"))
            for part, carried in windows(words_of(utf8(batch, "text")[0]), LONG, n - 1):
                yield pa.RecordBatch.from_arrays([row, doc_id, pa.array([part], pa.binary()), pa.array([carried], pa.int32())], names=["_row", "doc_id", "chunk", "carried"])

    return texts.mapInArrow(cut, "_row long, doc_id long, chunk binary, carried int")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[tuple[bytes, int]]]]:
    """Rows, ids and chunks of about BLOCK bytes at a time."""
    held: list[tuple[int, int, tuple[bytes, int]]] = []
    size = 0
    for batch in slices(batches):
        columns = (batch.column(c).to_pylist() for c in ("_row", "doc_id", "carried"))
        for row, doc_id, carried, chunk in zip(*columns, utf8(batch, "chunk"), strict=True):
            held.append((row, doc_id, (words_of(chunk), carried)))
            size += len(chunk)
            if size >= BLOCK:
                yield tuple(zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(zip(*held, strict=True))


def counted(chunked: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features in each bucket, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for *_, parts in blocks(batches):
            sums += np.bincount(features(parts, n, buckets)[0], minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], names=["bucket", "n"])

    return chunked.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """A bucket's gain in thousandths, rounded down, of the counts (bucket, n) of both: a number a bucket on the driver."""
    held = []
    for counts in (corpus, target):
        sums = np.zeros(buckets, np.int64)
        for r in counts.collect():  # a row a bucket at most
            sums[r["bucket"]] = r["n"]
        held.append(sums)
    s, t = held
    all_s, all_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(UNIT * math.log((b + 1.0) * (all_s + buckets) / ((a + 1.0) * (all_t + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


SUMS = "_row long, doc_id long, n_words long, n_features long, weight long"


def weighed(chunked: DataFrame, gain: np.ndarray, n: int = N) -> DataFrame:
    """_row, doc_id, n_words, n_features and weight of every chunk."""
    sent = chunked.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, parts in blocks(batches):
            bucket, of, owned = features(parts, n, len(sent.value))
            n_features = np.bincount(of, minlength=len(parts))
            order = np.argsort(of, kind="stable")
            upto = np.concatenate([[0], np.cumsum(sent.value[bucket[order]])])  # whole numbers: no rounding
            ends = np.cumsum(n_features)
            weight = upto[ends] - upto[ends - n_features]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, ids, owned, n_features, weight)], names=["_row", "doc_id", "n_words", "n_features", "weight"])

    return chunked.mapInArrow(run, SUMS)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Noise of an id in thousandths, rounded down: minus the logarithm of minus the logarithm of a uniform number that a digest gives."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(UNIT)) * F.log(-F.log(uniform)))


def _parts(docs: DataFrame, doc_id: Column, n: int) -> tuple[DataFrame, DataFrame]:
    """The chunks of short texts (one each, where they are) and of long ones (cut once, dealt evenly and written)."""
    texts = docs.select(F.monotonically_increasing_id().alias("_row"), doc_id.cast("long").alias("doc_id"), "text")
    small = F.coalesce(F.octet_length("text") <= LONG, F.lit(True))
    short = texts.filter(small).select("_row", "doc_id", F.col("text").cast("binary").alias("chunk"), F.lit(0).alias("carried"))
    return short, materialize(chunks(texts.filter(~small), n).hint("rebalance"))


def importance(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of ``docs`` (doc_id, text), with _row to tell rows apart.
    target: texts (text) whose distribution is wanted."""
    spark = docs.sparkSession
    ship(spark)
    with batches_of(spark):
        short, long = _parts(docs, F.col("doc_id"), n)
        few, many = _parts(target, F.lit(None), n)
        gain = gains(counted(short.unionByName(long), n, buckets), counted(few.unionByName(many), n, buckets), buckets)
        # A short text is one row throughout; only the chunks of long ones are summed by a shuffle
        whole, cut = materialize(weighed(short, gain, n)), materialize(weighed(long, gain, n))
    keys = ["_row", "doc_id"]
    return whole.unionByName(cut.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight"))))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row; rank is null where a row isn't drawn."""
    sums = importance(docs, target).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    able = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight"), F.asc("_row"), F.asc("n_words")]
    placed = ranked(sums.filter(able), order)
    drawn = placed.count() * share // 100
    out = placed.withColumn("rank", F.when(F.col("_rank") <= drawn, F.col("_rank"))).drop("_rank")
    return out.unionByName(sums.filter(~able).withColumn("rank", F.lit(None).cast("long"))).drop("_row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
