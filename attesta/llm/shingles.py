"""Near copies: documents that share 0.8 or more of their 5-word shingles, proposed by fingerprints (simhash) and MinHash bands.

Fingerprints within three bits miss most near copies of such a similarity (at 0.8 a pair differs in ten bits on
average), and no radius that would find them leaves bytes to share. So the sets of shingles are compared as well:
MinHash values in ``BANDS`` bands of ``ROWS`` propose pairs; two sets of similarity s meet in some band with chance
1 - (1 - s^ROWS)^BANDS, over 0.9999 at 0.8. Every proposed pair counts only if the exact similarity of its sets is
high enough. Components are those of both kinds of links together.

Sets are large, longer than the texts, and few nodes share a bucket. So a first pass over the texts writes bands, and a
second computes the sets of those nodes only: the hashes of their texts go into ``Marks``, a bit field of a fixed size,
by which tasks pass other texts over. A text that passes by chance costs its computation and joins with nothing.

Equal sets are one node from the start. In a bucket of a band all members are compared to a hub first, the one that meets
most others: of near copies of one text that is the least changed, to which more are similar than to any other, and the
group takes a row a member. Large buckets where that connects members take a few rounds more, with more hubs (more_hubs).
Members that no hub connects meet those others of such buckets with whom they share one of their rarest shingles, which
similar sets always do (rare_pairs): pages of a common template fill buckets but share only what is frequent there. So
hubs decide how many pairs are compared, never what links: the components are those of all similar pairs of a bucket. A
pair whose fingerprints link counts only if its sets are similar, too.

Defined cases: fewer words than a shingle are one shingle; texts without words, null ones included, are one node; rows
without a doc_id all stay; repeated rows are one group; an empty table gives an empty result; other columns are kept
by ``drop_similar`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, heavy_keys, materialize, ship, skew_join, slices, utf8
from .simhash import SEED, choose_key_bytes, components, fingerprint, keep_leaders, labelled, links

WIDTH = 5
#: Least similarity in hundredths.
SIMILAR = 80
BANDS, ROWS = 24, 5
#: Shingles whose MinHash values are computed at a time.
STEP = 1 << 12
#: Bits that mark texts for the second pass, 4 MB whatever the input. The more texts are marked, the more others pass.
MARKS = 1 << 25
#: Each round with more hubs has so many times those of the one before; a bucket goes on if a round connects 1 / SHARE of its odd members.
MORE, SHARE = 4, 16

_draw = np.random.default_rng(SEED)
_TIMES = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = text.lower().split()  # bytes, as in simhash
    digest, join = xxhash.xxh64_intdigest, b" ".join
    last = max(1, len(words) - width + 1) if words else 0
    return np.unique(np.array([digest(join(words[i : i + width]), SEED) for i in range(last)], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, (np.multiply.outer(_TIMES, hashes[at : at + STEP]) + _PLUS[:, None]).min(axis=1), out=least)
    return [_long(xxhash.xxh64_intdigest(row.tobytes(), i)) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def _long(h: int) -> int:
    return h - (1 << 64) * (h >> 63)


def node_of(hashes: np.ndarray) -> int:
    return _long(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (simhash), node (hash of the shingle set), bands and size (of the set) of every row."""
    ship(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    schema = "doc_id long, text_hash long, fp long, node long, bands array<long>, size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for t in utf8(batch, "text"):
                s = shingle_set(t)
                rows.append((fingerprint(t), node_of(s), bands(s), len(s)))
            fp, node, keys, size = zip(*rows, strict=True)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(fp, pa.int64()), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return source.mapInArrow(run, schema)


def marks_of(hashes: DataFrame) -> np.ndarray:
    """The bit field in which the values of ``text_hash`` are marked; its words are joined map-side, and MARKS / 64 is the most there are."""
    at = F.pmod("text_hash", F.lit(MARKS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(text_hash, {MARKS}) % 64 as int))")
    words = hashes.select(F.floor(at / 64).cast("long").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    marks = np.zeros(MARKS // 64, np.int64)
    marks[words["word"].to_numpy()] = words["bits"].to_numpy()
    return marks


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and hashes (the set), a row a node, of at least all ``docs`` whose text_hash is in ``wanted``."""
    ship(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    marks = docs.sparkSession.sparkContext.broadcast(marks_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a text that repeats goes on once from each task
        for batch in slices(batches):
            at = batch.column("text_hash").to_numpy()
            marked = np.flatnonzero(marks.value[at % MARKS // 64] >> (at % 64) & 1)
            new = [i for i in marked.tolist() if not (int(at[i]) in seen or seen.add(int(at[i])))]
            sets = [shingle_set(t) for t in utf8(batch.take(pa.array(new, pa.int64())), "text")] if new else []
            yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "hashes"])

    return docs.select(text_hash().alias("text_hash"), "text").mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are similar enough."""
    # Merge joins: where one node has many pairs, its part is split
    left = pairs.hint("merge").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.hint("merge").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    # shared / (x + y - shared) >= SIMILAR / 100, written so that the sets are intersected once
    return both.filter(F.size(F.array_intersect("x", "y")).cast("long") * (100 + SIMILAR) >= (F.size("x").cast("long") + F.size("y")) * SIMILAR).select("a", "b")


def shingle_links(docs: DataFrame, nodes: DataFrame, proposed: DataFrame) -> DataFrame:
    """Edges a, b between nodes that connect all similar ones. nodes: node, text_hash (of one of its ``docs``), size and bands;
    proposed: more pairs a, b to compare, written."""
    posted = nodes.select("node", "size", F.explode("bands").alias("key"))
    counts = posted.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    crowded = materialize(posted.hint("merge").join(counts, "key").select("key", "node", "size", "members"))
    weights = crowded.groupBy("node").agg(F.sum("members").alias("weight"))
    members = materialize(crowded.hint("merge").join(weights, "node").select("key", "node", "size", "weight", F.col("node").alias("root")))
    some = members.select("node").unionByName(proposed.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = nodes.select("node", "text_hash").hint("merge").join(some, "node", "left_semi")
    sets = materialize(sets_of(docs, wanted))
    edges = materialize(similar(hub_pairs(members).unionByName(proposed.select("a", "b")).distinct(), sets))
    roots = components(edges)
    left, found = more_hubs(unconnected(members, roots), sets)
    # What no hub connected may be similar to any other of its buckets
    second = materialize(rare_pairs(materialize(left.groupBy("node").agg(F.first("root").alias("root"), F.max("odd").alias("odd"))), sets))
    for more in (stars(roots), *([] if second.isEmpty() else [similar(second, sets)])):
        found = more if found is None else found.unionByName(more)
    return found


def hub_pairs(members: DataFrame, hubs: int = 1) -> DataFrame:
    """Pairs a, b of members of buckets (key, node, size, weight, root) and those ``hubs`` of the bucket that meet most others, where roots differ.

    A node's weight is the sum of its buckets' members. Of near copies of one text the least changed weigh most, and are similar to most.
    """
    part = F.pmod(F.xxhash64("node"), F.lit(hubs))
    chosen = members.groupBy("key", part.alias("part")).agg(F.max(F.struct("weight", "node", "size", "root")).alias("hub")).select("key", "hub")
    met = members.hint("merge").join(chosen, "key").filter(F.col("root") != F.col("hub.root")).filter(sized("size", "hub.size"))
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def more_hubs(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``members`` (as of unconnected) after further rounds, each with MORE times the hubs, and edges a, b between roots that stand for what these connected.

    A bucket takes part while a round connects a fair share of its odd members and it is much larger than its hubs are many, so
    a round takes a few rows a member, and buckets of pages that aren't similar take one at most.
    """
    found, hubs = None, 1
    while True:
        hubs *= MORE
        open_ = members.filter((F.col("members") > MORE * hubs) & ((F.col("before") - F.col("odds")) * SHARE >= F.col("before")))
        pairs = materialize(hub_pairs(open_, hubs))
        edges = None if pairs.isEmpty() else materialize(similar(pairs, sets))
        if edges is None or edges.isEmpty():
            return members, found
        placed = members.select("node", "root").distinct()
        ends = edges.hint("merge").join(placed.select(F.col("node").alias("a"), F.col("root").alias("a_root")), "a")
        ends = ends.hint("merge").join(placed.select(F.col("node").alias("b"), F.col("root").alias("b_root")), "b")
        moved = components(ends.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
        found = stars(moved) if found is None else found.unionByName(stars(moved))
        members = unconnected(members, moved)


def stars(roots: DataFrame) -> DataFrame:
    """Edges a, b that stand for components (node, root): fewer than the links, the same components."""
    return roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def unconnected(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets (key, node, size, weight, root) of several components, with their ``roots`` (node, root) as new roots; written.

    odd: in another component than the bucket's first hub; members, odds: how many there are and are odd, before: were odd.
    """
    moved = roots.select(F.col("node").alias("root"), F.col("root").alias("new"))
    placed = members.hint("merge").join(moved, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")
    before = F.max("odds") if "odds" in members.columns else F.count(F.lit(1)) - 1
    hubs = placed.groupBy("key").agg(F.max(F.struct("weight", "node", "root")).alias("hub"), F.count(F.lit(1)).alias("members"), before.alias("before"), F.min("root").alias("low"), F.max("root").alias("high"))
    rows = placed.select("key", "node", "size", "weight", "root").hint("merge").join(hubs.filter("low != high"), "key")
    rows = materialize(rows.select("key", "node", "size", "weight", "root", "members", "before", (F.col("root") != F.col("hub.root")).alias("odd")))
    odds = rows.groupBy("key").agg(F.count_if("odd").alias("odds"))
    return materialize(rows.hint("merge").join(odds, "key"))


def sized(n: str, m: str) -> Column:
    """Sets of too different sizes can't be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * SIMILAR


def rare_pairs(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b that may be similar, of nodes (node, root, odd) with different roots, one of them odd.

    Of two similar sets, rarest shingles first, the leading parts share one: of the larger as many shingles as it may lack in
    any similar set, and one more; of the other as many as it may lack in one that isn't smaller, and one more. Shingles that
    one node alone has lead and meet nothing, so pages that have a template in common, and enough of their own, aren't paired,
    however many they are. Where two sets first meet, what
    can be shared from there on has to be enough, too.
    """
    held = left.hint("merge").join(sets, "node").select("node", "root", "odd", F.size("hashes").cast("long").alias("size"), F.explode("hashes").alias("token"))
    shared = held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = held.hint("merge").join(shared, "token").groupBy("node").agg(*(F.first(c).alias(c) for c in ("root", "odd", "size")), F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    kept = kept.withColumn("common", F.size("tokens").cast("long"))
    own = F.col("size") - F.col("common")  # these come first
    any_size = F.col("size") - F.ceil(F.col("size") * SIMILAR / 100) + 1 - own
    not_smaller = F.col("size") - F.ceil(F.col("size") * (2 * SIMILAR) / (100 + SIMILAR)) + 1 - own
    posted = kept.filter(any_size > 0).select("node", "root", "odd", "size", "common", not_smaller.alias("least"), F.posexplode(F.slice("tokens", F.lit(1), any_size.cast("int"))).alias("at", "t"))
    posted = materialize(posted.select("node", "root", "odd", "size", "common", "at", (F.col("at") < F.col("least")).alias("leads"), "t.token"))
    side = lambda p: posted.select("token", *(F.col(c).alias(f"{p}_{c}") for c in ("node", "root", "odd", "size", "common", "at", "leads")))
    most = F.least(F.col("a_common") - F.col("a_at"), F.col("b_common") - F.col("b_at"))
    enough = most * (100 + SIMILAR) >= (F.col("a_size") + F.col("b_size")) * SIMILAR
    later = (F.col("a_size") > F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a_node") > F.col("b_node")))
    met = side("a").hint("merge").join(side("b").filter("b_leads").drop("b_leads"), "token").filter("a_root != b_root AND (a_odd OR b_odd)").filter(later & enough & sized("a_size", "b_size"))
    return met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def print_pairs(signed: DataFrame) -> DataFrame:
    """Pairs a, b of nodes whose documents have equal or linked fingerprints, through one node of each fingerprint; written.
    They are proposals: only similar ones count."""
    pairs = materialize(signed.select("fp", "node").distinct())
    chief = materialize(pairs.groupBy("fp").agg(F.min("node").alias("chief"), F.count(F.lit(1)).alias("n")))
    several = pairs.hint("merge").join(chief.filter("n > 1"), "fp").select(F.col("node").alias("a"), F.col("chief").alias("b"))
    near = links(chief.select("fp"), choose_key_bytes(chief.count()))
    ends = near.hint("merge").join(chief.select(F.col("fp").alias("a"), F.col("chief").alias("a_node")), "a")
    ends = ends.hint("merge").join(chief.select(F.col("fp").alias("b"), F.col("chief").alias("b_node")), "b")
    return materialize(several.unionByName(ends.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))).filter("a != b").distinct())


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id of its component, of every row."""
    signed = materialize(signatures(docs))
    by_node = signed.groupBy("node").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("text_hash").alias("text_hash"), F.first("bands").alias("bands"), F.first("size").alias("size")
    )
    nodes = materialize(by_node)
    roots = components(shingle_links(docs, nodes.select("node", "text_hash", "size", "bands"), print_pairs(signed)))
    classes = materialize(labelled(nodes.select("node", "least", "n"), roots, "node"))
    heavy = heavy_keys(classes, "node", "n", nodes.agg(F.sum("n").alias("n")).first()["n"] or 0)
    return skew_join(signed.select("doc_id", "node"), classes.select("node", "component_id"), "node", heavy)


def drop_similar(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, as simhash.drop_near_duplicates keeps them."""
    return keep_leaders(docs, components_of(docs.select("doc_id", "text")))
