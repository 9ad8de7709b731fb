"""Near-duplicate embeddings (operator 13): PCA-ordered tiled comparison within equal labels.

Equal vectors of a label are one class. Classes are turned to principal axes and ordered by a code of their places on the
leading ones, then cut into tiles of up to ``TILE`` classes of one label and length. A tile keeps, besides its vectors, the box
and the ball that hold its directions on the turned axes. Cosine 0.98 or more means a distance of 0.2 or less, so two tiles
whose boxes or balls are farther apart have no link and never meet; tiles meet through cells of the first two axes, so one
label's tiles aren't all paired either.

Tiles that do meet are compared a square at a time: products of the leading axes first, then a few more axes a step. What the
remaining axes can add is at most the product of the two suffix norms; a pair is left as soon as even that can't reach the
threshold, and a square when all its pairs are. Pairs that are left are decided by the cosine of the vectors as they came.
A pair of tiles gives, for each class with a link, how many rows it links to and the smallest class it reaches there: a row a
class, however many pairs link. Those stars, not the pairs, make the graph for the components.

The axes come from a bounded sample (``SAMPLE`` vectors); they decide how much is skipped, never what links. Every class is in
a tile and every pair of tiles is compared or excluded by its bounds.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with
nothing; vectors of different lengths don't link; repeated rows, also those that repeat an id, are vectors each, and equal
ones link; a row without an id links and counts like any other, is never a component's smallest, and is kept only in a
component of such rows; very large and very small components are scaled by powers of two first; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann import usable_vector
from .common import batches_of, heavy_keys, materialize, ship, skew_join
from .simhash import components, labelled

COSINE = 0.98
TILE = 2048
#: Vectors from which the axes are made.
SAMPLE = 4096
#: Axes that are added up before a pair is first judged, and with each step after.
FIRST, STEP = 8, 8
#: Rows and columns of a square.
SQUARE = 512
#: Bits of a place's code.
BITS = 60
#: For what rounding does to products of unit vectors and to bounds.
SLACK = 1e-9

TILES = "label_key string, width int, n int, ids binary, m binary, x binary, low array<double>, high array<double>, middle array<double>, radius double"


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by powers of two, so that squares neither overflow nor vanish, and the lengths of these."""
    scaled = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return scaled, np.sqrt((scaled * scaled).sum(axis=1))


class Axes:
    """Principal axes of vectors of one length, largest spread first, and the code of places on them."""

    def __init__(self, sample: np.ndarray) -> None:
        x, length = unit(sample)
        x = x / length[:, None]
        centred = x - x.mean(axis=0)
        spread, turn = np.linalg.eigh(centred.T @ centred)
        self.turn = np.ascontiguousarray(turn[:, ::-1])
        sd = np.sqrt(np.maximum(spread[::-1], 0))
        placed = x @ self.turn
        # The next bit goes to the axis whose parts are widest
        used = np.zeros(len(sd), np.int64)
        self.plan = []
        for _ in range(BITS):
            axis = int((sd / 2.0**used).argmax())
            if sd[axis] <= 0 or used[axis] >= 10:
                break
            self.plan.append((axis, int(used[axis])))
            used[axis] += 1
        self.marks = {a: np.quantile(placed[:, a], np.arange(1, 1 << used[a]) / (1 << used[a])) for a in np.flatnonzero(used).tolist()}
        self.used = used

    def code(self, placed: np.ndarray) -> np.ndarray:
        part = {a: np.searchsorted(marks, placed[:, a]) for a, marks in self.marks.items()}
        out = np.zeros(len(placed), np.int64)
        for axis, level in self.plan:
            out = out << 1 | (part[axis] >> (self.used[axis] - 1 - level)) & 1
        return out

    def place(self, x: np.ndarray) -> np.ndarray:
        """The unit vectors on the axes."""
        scaled, length = unit(x)
        return (scaled / length[:, None]) @ self.turn


def axes_of(classes: DataFrame, sample: int = SAMPLE) -> dict[int, Axes]:
    """The axes of each vector length that a bounded sample, drawn by hash, holds."""
    drawn: dict[int, list[list[float]]] = {}
    for r in classes.orderBy(F.xxhash64("v"), "id").limit(sample).select("v").collect():
        drawn.setdefault(len(r["v"]), []).append(r["v"])
    return {n: Axes(np.array(v)) for n, v in drawn.items()}


def _placed(axes: dict[int, Axes], x: np.ndarray) -> np.ndarray:
    """On the axes of their length; vectors of a length without axes stay as they are."""
    found = axes.get(x.shape[1])
    if found:
        return found.place(x)
    scaled, length = unit(x)
    return scaled / length[:, None]


def coded(classes: DataFrame, axes: dict[int, Axes]) -> DataFrame:
    """``classes`` (label_key, id, m, v) with code, their order."""
    sent = classes.sparkSession.sparkContext.broadcast(axes)
    source = classes.select("label_key", "id", "m", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            width = v.value_lengths().to_numpy()
            start = v.offsets.to_numpy()
            flat = v.values.to_numpy(zero_copy_only=False)
            code = np.zeros(batch.num_rows, np.int64)
            for n in np.unique(width):
                at = np.flatnonzero(width == n)
                if found := sent.value.get(int(n)):
                    code[at] = found.code(found.place(flat[start[at][:, None] + np.arange(n)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=[*batch.schema.names, "code"])

    return source.mapInArrow(run, "label_key string, id long, m long, v array<double>, code long")


def tiles_of(classes: DataFrame, axes: dict[int, Axes], size: int = TILE) -> DataFrame:
    """Tiles of classes of one label and length that are near each other in the order, with a number t; written."""
    sent = classes.sparkSession.sparkContext.broadcast(axes)
    order = ["label_key", "width", "code", "id"]
    dealt = coded(classes, axes).withColumn("width", F.size("v")).repartitionByRange(*order).sortWithinPartitions(*order).select("label_key", "width", "id", "m", "v")

    def tile(label: str, width: int, ids: list[int], m: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
        x = np.array(rows)
        placed = _placed(sent.value, x)
        middle = placed.mean(axis=0)
        radius = float(np.sqrt(((placed - middle) ** 2).sum(axis=1).max()))
        narrow = x.astype(np.float32)
        exact = narrow if (narrow == x).all() else x  # half the bytes where nothing is lost
        values = (label, width, len(ids), np.array(ids, np.int64).tobytes(), np.array(m, np.int64).tobytes(), exact.tobytes(), placed.min(axis=0), placed.max(axis=0), middle, radius)
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.list_(pa.float64())] * 3, pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([a], k) for a, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in TILES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, m, rows = None, [], [], []
        for batch in batches:
            v = batch.column("v")
            start, flat = v.offsets.to_numpy().tolist(), v.values.to_numpy(zero_copy_only=False)
            columns = (batch.column(c).to_pylist() for c in ("label_key", "width", "id", "m"))
            for i, (label, width, id_, weight) in enumerate(zip(*columns, strict=True)):
                if ids and (key != (label, width) or len(ids) == size):
                    yield tile(*key, ids, m, rows)
                    ids, m, rows = [], [], []
                key = (label, width)
                ids.append(id_)
                m.append(weight)
                rows.append(flat[start[i] : start[i + 1]].copy())
        if ids:
            yield tile(*key, ids, m, rows)

    return materialize(dealt.mapInArrow(run, TILES).withColumn("t", F.monotonically_increasing_id()))


def reach(cosine: float) -> float:
    """The largest distance of unit vectors with this cosine or more."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK


def meeting(tiles: DataFrame, cosine: float) -> DataFrame:
    """a, b: numbers of tiles of one label and length, a before b, that their boxes and balls don't keep apart.

    A tile stands in the cells of the first two axes that its box covers, the partner also in those within reach.
    """
    far = reach(cosine)
    side = lambda at, more: F.sequence(F.floor((F.coalesce(F.get("low", F.lit(at)), F.lit(0.0)) - more) / far), F.floor((F.coalesce(F.get("high", F.lit(at)), F.lit(0.0)) + more) / far))
    cells = lambda more: tiles.select("label_key", "width", "t", "low", "high", "middle", "radius", F.explode(side(0, more)).alias("one")).withColumn("two", F.explode(side(1, more)))
    names = ["label_key", "width", "one", "two"]
    a = cells(0.0).select(*names, *(F.col(c).alias(f"a_{c}") for c in ("t", "low", "high", "middle", "radius")))
    b = cells(far).select(*names, *(F.col(c).alias(f"b_{c}") for c in ("t", "low", "high", "middle", "radius")))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, d: s + d * d)
    gap = lambda lo, hi: F.zip_with(lo, hi, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    # On an axis one of the two gaps is nothing
    apart = total(gap("a_low", "b_high")) + total(gap("b_low", "a_high"))
    between = F.sqrt(total(F.zip_with("a_middle", "b_middle", lambda x, y: x - y))) - F.col("a_radius") - F.col("b_radius")
    near = a.join(b, names).filter(F.col("a_t") < F.col("b_t")).filter((apart <= far * far) & (between <= far))
    return near.select(F.col("a_t").alias("a"), F.col("b_t").alias("b")).distinct()


def square_links(x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs of placed unit vectors that may reach ``cosine``. xs, ys: norms of what follows each axis."""
    width, least = x.shape[1], cosine - SLACK
    upto = min(FIRST, width)
    sums = x[:, :upto] @ y[:, :upto].T
    alive = sums + np.outer(xs[:, upto], ys[:, upto]) >= least
    # While many pairs are left, their products are cheapest together
    while upto < width and alive.sum() * 8 > alive.size:
        more = min(upto + STEP, width)
        sums += x[:, upto:more] @ y[:, upto:more].T
        upto = more
        alive = sums + np.outer(xs[:, upto], ys[:, upto]) >= least
    i, j = np.nonzero(alive)
    left = sums[i, j]
    while upto < width and len(i):
        more = min(upto + STEP, width)
        left = left + (x[i, upto:more] * y[j, upto:more]).sum(axis=1)
        upto = more
        keep = left + xs[i, upto] * ys[j, upto] >= least
        i, j, left = i[keep], j[keep], left[keep]
    return i, j


def _suffixes(placed: np.ndarray) -> np.ndarray:
    """Norms of what follows each number of axes."""
    squares = np.cumsum((placed * placed)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(placed), 1))], axis=1))


def tile_links(x: np.ndarray, y: np.ndarray | None, axes: dict[int, Axes], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All links i, j between the vectors of two tiles, or within one (i before j)."""
    same = y is None
    y = x if same else y
    (xu, xn), (yu, yn) = unit(x), unit(y)
    xp, yp = _placed(axes, x), _placed(axes, y)
    xs, ys = _suffixes(xp), _suffixes(yp)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    for a in range(0, len(x), SQUARE):
        for b in range(a if same else 0, len(y), SQUARE):
            i, j = square_links(xp[a : a + SQUARE], yp[b : b + SQUARE], xs[a : a + SQUARE], ys[b : b + SQUARE], cosine)
            i, j = i + a, j + b
            if same:
                i, j = i[i < j], j[i < j]
            # Decided on the vectors as they came, some at a time
            for at in range(0, len(i), 1 << 15):
                p, q = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                fine = (xu[p] * yu[q]).sum(axis=1) / (xn[p] * yn[q]) >= cosine
                found.append((p[fine], q[fine]))
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def summary(ids: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of links between places i and j: the classes that have any, how many rows each links to, and the smallest class it reaches."""
    n = np.bincount(i, m[j], len(ids)) + np.bincount(j, m[i], len(ids))
    order = np.argsort(ids, kind="stable")
    root = np.empty(len(ids), np.int64)
    root[order] = np.arange(len(ids))
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = np.minimum(least, least[order[least]])
        if (least == root).all():
            break
        root = least
    some = np.flatnonzero(n)
    return ids[some], n[some].astype(np.int64), ids[order[root[some]]]


def compare(tiles: DataFrame, axes: dict[int, Axes], cosine: float = COSINE) -> DataFrame:
    """id, n, root for each class with a link, of each pair of tiles that has one: the rows it links to there, and the
    smallest class it reaches; written."""
    sent = tiles.sparkSession.sparkContext.broadcast(axes)
    side = lambda p: tiles.select(F.col("t").alias(p), F.col("width").alias(f"{p}_width"), *(F.col(c).alias(f"{p}_{c}") for c in ("ids", "m", "x")))
    # A tile's own pairs go through the same function, without a partner
    pairs = materialize(meeting(tiles, cosine).unionByName(tiles.filter("n > 1").select(F.col("t").alias("a"), F.lit(None).cast("long").alias("b"))))
    both = pairs.filter("b is not null").join(side("a"), "a").join(side("b"), "b").select("a_width", "a_ids", "a_m", "a_x", "b_ids", "b_m", "b_x")
    alone = pairs.filter("b is null").select("a").join(side("a"), "a").select("a_width", "a_ids", "a_m", "a_x", *(F.lit(None).cast("binary").alias(f"b_{c}") for c in ("ids", "m", "x")))

    def vectors(data: bytes, ids: np.ndarray, width: int) -> np.ndarray:
        kind = np.float32 if len(data) == 4 * len(ids) * width else np.float64
        return np.frombuffer(data, kind).reshape(len(ids), width).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                width, ids, m, x, b_ids, b_m, y = (c[r].as_py() for c in batch.columns)
                ids, m = np.frombuffer(ids, np.int64), np.frombuffer(m, np.int64)
                x = vectors(x, ids, width)
                if y is None:
                    i, j = tile_links(x, None, sent.value, cosine)
                else:
                    other = np.frombuffer(b_ids, np.int64)
                    i, j = tile_links(x, vectors(y, other, width), sent.value, cosine)
                    j, ids, m = j + len(ids), np.concatenate([ids, other]), np.concatenate([m, np.frombuffer(b_m, np.int64)])
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in summary(ids, m, i, j)], names=["id", "n", "root"])

    with batches_of(tiles.sparkSession, 4):  # rows of a megabyte or two
        return materialize(both.unionByName(alone).hint("rebalance").mapInArrow(run, "id long, n long, root long"))


def _key(label: Column) -> Column:
    """Of a usable vector v with a label: what only equal ones have in common (two hashes of 64 bits, and the label)."""
    return F.struct(label.alias("label"), F.xxhash64(F.lit(1), "v").alias("one"), F.xxhash64(F.lit("two"), F.reverse("v")).alias("two"))


def link(rows: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``rows`` (vec_id, embedding, label)."""
    ship(rows.sparkSession)
    v = F.col("embedding").cast("array<double>")
    source = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label_key"), v.alias("v"))
    able = F.coalesce(F.col("label_key").isNotNull() & usable_vector("v"), F.lit(False))
    inside = source.filter(able).select("vec_id", "label_key", _key(F.col("label_key")).alias("key"), "v")
    grouped = inside.groupBy("key").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("m"))
    classes = materialize(grouped.select("key", F.col("key.label").alias("label_key"), "v", "least", "m").withColumn("id", F.monotonically_increasing_id()))
    axes = axes_of(classes)
    links = compare(tiles_of(classes, axes, tile), axes, cosine)
    found = materialize(links.groupBy("id").agg(F.sum("n").alias("n")))
    roots = components(links.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    # Classes of several rows, and those with links; a row of any other class stands alone
    linked = classes.select("id", "key", "least", "m").hint("merge").join(found, "id", "left").filter("m > 1 or n is not null")
    linked = materialize(linked.select("id", "key", "least", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links")))
    named = labelled(linked.select("id", "least", F.col("m").alias("n")), roots, "id").select("id", "component_id")
    verdicts = materialize(linked.hint("merge").join(named, "id").select("key", "m", "n_links", "component_id", F.lit(True).alias("linked")))
    total = classes.agg(F.sum("m").alias("n")).first()["n"] or 0
    back = skew_join(inside.select("vec_id", "key"), verdicts.select("key", "n_links", "component_id", "linked"), "key", heavy_keys(verdicts, "key", "m", total))
    ids = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = back.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), ids.alias("component_id"))
    rest = source.filter(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(embeddings: DataFrame) -> DataFrame:
    return link(embeddings)


ORACLE = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, least(v.vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = v.vec_id), v.vec_id)) AS component_id,
 v.vec_id = least(v.vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = v.vec_id), v.vec_id)) AS kept FROM v"""
