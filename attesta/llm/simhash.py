"""SimHash near-duplicates (operator 6): byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most three bits
share at least five of them, and of any five positions three lie in the same half of the bytes
(key_bytes = 3; other sizes in the same way). So every fingerprint is posted under the few
combinations of positions that no sharing pair can miss; pairs that meet in a posting are tallied
over all eight positions, those with five or more shared bytes are kept and verified bit by bit.
Longer keys post more often and meet fewer strangers; ``key_bytes`` follows from the number of
fingerprints and never changes the result.

Equal fingerprints are one node from the start. Postings longer than ``CROWD`` aren't paired at
all: their fingerprints go to ``crowd_links``, which connects everything within three bits through
shared neighbours with a fixed number of rows per fingerprint.

Defined cases: texts that are null or have no words have fingerprint zero, which links like any
other; fewer words than a shingle are one shingle; a null doc_id keeps its row and is never a
component's smallest, and a component of nulls has a null id; repeated rows each return; an empty
table gives an empty result; other columns are ignored, and ``drop_near_duplicates`` keeps them
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_keys, materialize, renamed, ship, skew_join, slices, utf8

SEED = 42
#: Shingles hashed at a time, for very long texts.
STEP = 1 << 15
#: A posting with more fingerprints is handled by crowd_links.
CROWD = 64


def fingerprint(text: bytes, width: int = 3) -> int:
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    last = max(1, len(words) - width + 1)
    set_bits = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, last, STEP):
        h = np.array([digest(join(words[i : i + width]), SEED) for i in range(at, min(last, at + STEP))], "<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (set_bits * 2 > last).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = pa.array([fingerprint(t, width) for t in utf8(batch, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], names=["doc_id", "fp"])

    return source.mapInArrow(run, "doc_id long, fp long")


def combos(key_bytes: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any five positions of eight contain one."""
    if key_bytes == 2:
        return [(0, 1), (2, 3), (4, 5), (6, 7)]
    if key_bytes == 3:
        return [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
    if key_bytes == 4:
        return [c for c in combinations(range(8), 4)]
    return list(combinations(range(8), 5))


def choose_key_bytes(n: int) -> int:
    """The shortest key, of three bytes or more, at which a fingerprint meets eight strangers at most."""
    return next((k for k in (3, 4) if len(combos(k)) * n / 256**k <= 8), 5)


def _byte(col: str, p: int):
    return F.shiftrightunsigned(F.col(col), 8 * p).bitwiseAND(F.lit(255))


def postings(nodes: DataFrame, key_bytes: int) -> DataFrame:
    """fp posted under (slot, key): which positions, and their bytes."""
    keys = []
    for slot, positions in enumerate(combos(key_bytes)):
        mask = sum(255 << (8 * p) for p in positions)
        mask -= (1 << 64) * (mask >= 1 << 63)
        keys.append(F.struct(F.lit(slot).alias("slot"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    return nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.slot", "k.key")


def near(a: str, b: str, max_bits: int = 3):
    """Count filter on shared positional bytes, then the exact test."""
    shared = sum((_byte(a, p) == _byte(b, p)).cast("int") for p in range(8))
    return (shared >= 8 - max_bits) & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits)


def links(nodes: DataFrame, key_bytes: int) -> DataFrame:
    """Pairs a, b of different fingerprints that connect all within three bits of each other."""
    posted = postings(nodes, key_bytes)
    size = posted.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    size = materialize(size)
    small = posted.hint("merge").join(size.filter(F.col("n") <= CROWD).select("slot", "key"), ["slot", "key"])
    lists = small.groupBy("slot", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    left = lists.select("fps", F.explode("fps").alias("a"))
    pairs = left.select("a", F.explode(F.filter("fps", lambda x: x > F.col("a"))).alias("b")).filter(near("a", "b")).distinct()
    crowded = size.filter(F.col("n") > CROWD)
    if not crowded.isEmpty():
        members = posted.hint("merge").join(crowded.select("slot", "key"), ["slot", "key"], "left_semi").select("fp").distinct()
        pairs = pairs.unionByName(crowd_links(materialize(members)))
    return pairs


def crowd_links(members: DataFrame) -> DataFrame:
    """Connects all pairs of members within three bits without listing them.

    A point z is taken for every value within one bit of a member. Members within one bit of z are
    within two of each other; one at two bits from z is within three of all of those. Any pair
    within three bits has such a z. So each z ties its one-bit members, and its two-bit members, to
    the smallest of the former: 65 and 2016 rows per member before those that have no z drop out.
    """
    one = [1 << i for i in range(63)] + [-(1 << 63)]
    flips = F.array(F.lit(0).cast("long"), *(F.lit(x).cast("long") for x in one))
    inner = members.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("z"))
    hub = materialize(inner.groupBy("z").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")))
    tie = inner.hint("merge").join(hub.filter("n > 1"), "z").filter("fp != a").select("a", F.col("fp").alias("b")).distinct()
    # At two bits: flip one bit, then a higher one.
    step = members.select("fp", F.posexplode(F.slice(flips, 2, 64)).alias("i", "x"))
    outer = step.select("fp", F.explode(F.transform(F.slice(flips, F.col("i") + 3, F.lit(63) - F.col("i")), lambda y: y.bitwiseXOR(F.col("x")).bitwiseXOR(F.col("fp")))).alias("z"))
    far = outer.hint("merge").join(hub.select("z", "a"), "z").filter("fp != a").select("a", F.col("fp").alias("b")).distinct()
    return tie.unionByName(far).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Nodes of ``edges`` (a, b) with the smallest node they reach: node, root.

    Rounds of two steps: every larger neighbour of a node is tied to the node's smallest neighbour instead, then every
    smaller one is. Both keep what is connected and shorten paths, so that stars remain, in a number of rounds that is
    logarithmic in practice. Each step is written to the shared folder. Minima are summed map-side, and the joins are
    merge joins, which Spark splits where one node has many neighbours; nothing is broadcast.
    """
    a, b = F.col("a"), F.col("b")
    live = materialize(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct())
    print_ = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(a, b))).first())
    seen = print_(live)
    while seen[0]:
        # Links run from the larger node a to the smaller b, so a node's smallest neighbour is the least b, or itself if it has none
        least = live.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        large = materialize(live.hint("merge").join(least, b == F.col("u"), "left").select("a", F.coalesce("m", b).alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        tied = large.hint("merge").join(least, a == F.col("u")).select(b.alias("a"), F.col("m").alias("b"))
        small = tied.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        live = materialize(small.filter(a != b).distinct())
        before, seen = seen, print_(live)
        if seen == before:
            break
    return live.select(a.alias("node"), b.alias("root")).unionByName(live.select(b.alias("node"), b.alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, key_bytes: int | None = None) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prints = materialize(fingerprints(docs, width))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    sums = nodes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("fps")).first()
    roots = components(links(nodes.select("fp"), key_bytes or choose_key_bytes(sums["fps"])))
    classes = materialize(labelled(nodes, roots, "fp"))
    heavy = heavy_keys(classes, "fp", "n", sums["rows"] or 0)
    return skew_join(prints, classes.select("fp", "component_id"), "fp", heavy)


def labelled(nodes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``nodes`` (key, least, n) with component_id, the smallest ``least`` of their component."""
    member = materialize(nodes.hint("merge").join(roots.withColumnRenamed("node", key), key, "left").select(key, "least", "n", F.coalesce("root", key).alias("root")))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return member.hint("merge").join(ids, "root").select(key, "component_id", "n")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: the one whose doc_id is the component's smallest.

    An id that repeats leaves one row, and does so if any of its rows leads a component. Rows
    without a doc_id all stay. Survivors are decided on ids; texts take part in one join by doc_id.
    Columns are kept whatever their names.
    """
    return keep_leaders(docs, near_duplicates(docs.select("doc_id", "text")))


def keep_leaders(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that lead their component in ``found`` (doc_id, component_id) or have no doc_id."""
    found = found.filter(F.col("doc_id").isNotNull())
    ids = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("leads"), F.count(F.lit(1)).alias("n"))
    # Written, so that its size is known: while it is small no text is shuffled
    marks = materialize(ids.filter(~F.col("leads") | (F.col("n") > 1)).select(F.col("doc_id").alias("_id"), F.col("leads").alias("_leads")))
    inner, names, back = renamed(docs)
    id_ = names["doc_id"]
    marked = inner.join(marks, F.col(id_).cast("long") == F.col("_id"), "left").filter(F.coalesce("_leads", F.lit(True)))
    # Of an id that repeats one row stays: numbered only where there are such ids
    if marks.filter("_leads").isEmpty():
        return back(marked)
    return back(marked.filter("_leads is null")).unionByName(back(marked.filter("_leads").dropDuplicates([id_])))


def query(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
