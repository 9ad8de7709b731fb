"""Operators on vectors and web archives, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from conftest import DATA
from texts import documents

import corpus_pipeline
from attesta.llm import ann, langid, warc
from attesta.llm.common import heavy_keys, skew_join

VEC = "vec_id long, embedding array<float>, label int"


def exact(x, ids, k=20):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            rows = sorted((-float((q * v).sum()), j) for j, v in zip(ids, x, strict=True) if j != i)
            out[i] = [(j, -s) for s, j in rows[:k]]
    return out


def test_ann_recall(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x[3000:3700] = x[7]  # a hot vector
    monkeypatch.setattr(ann, "BLOCK", 2500)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 100)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VEC).repartition(3)
    got = {}
    for r in ann.query(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    want = exact(x.astype(np.float64), range(len(x)))
    assert got.keys() == want.keys()
    hit = 0
    for q, found in got.items():
        assert [r for *_, r in found] == list(range(1, 21))
        assert [(-s, i) for i, s, _ in found] == sorted((-s, i) for i, s, _ in found)
        best = dict(want[q])
        hit += len(best.keys() & {i for i, *_ in found})
        assert all(s == pytest.approx(best[i], abs=1e-12) for i, s, _ in found if i in best)
    assert hit / (20 * len(want)) >= 0.9


@pytest.mark.skipif(not (DATA / "sf0.1").exists(), reason="needs the test tables")
def test_ann_recall_on_the_table(spark):
    df = spark.read.parquet(str(DATA / "sf0.1/embeddings.parquet"))
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = exact(np.array([v for _, v in rows], np.float64), [i for i, _ in rows])
    got = {(r["query_id"], r["vec_id"]) for r in ann.query(df).collect()}
    assert len(got) == 20 * len(want)
    assert len(got & {(q, i) for q, best in want.items() for i, _ in best}) >= 0.9 * len(got)


def test_ann_recall_beside_a_group(spark):
    """A third of the rows are near-equal: recall of queries in that group and of the others."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3600, 64))
    group = set(rng.choice(3600, 1200, replace=False).tolist())
    x[sorted(group)] = x[7] + 0.01 * rng.normal(size=(1200, 64))
    x = x.astype(np.float32)
    want = exact(x.astype(np.float64), range(len(x)))
    got = {(r["query_id"], r["vec_id"]) for r in ann.query(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC)).collect()}
    for asked in (want.keys() & group, want.keys() - group):
        assert len(got & {(q, i) for q in asked for i, _ in want[q]}) >= 0.9 * 20 * len(asked)


def test_ann_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, [1.0, 0.0]), (20, [2.0, 0.0]), (40, [1.0]), (None, [1.0, 1.0]), (1, [3.0, 0.0]), (9, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VEC)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.query(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 3.0), (0, 2, 20, 2.0), (0, 3, 1, 1.0), (0, 4, 8, 1.0), (0, 5, 2, 0.5), (20, 1, 1, 6.0), (20, 2, 0, 2.0), (20, 3, 1, 2.0), (20, 4, 8, 2.0), (20, 5, 2, 1.0)]
    assert ann.query(df.limit(0)).count() == 0


def test_ann_repeated_queries_and_lengths(spark):
    """A query id in several rows is one query, its smallest vector; each length is searched by itself."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0]), (20, [1.0, 1.0, 1.0]), (21, [0.0, 0.0, 2.0]), (22, [1.0, 0.0, 0.0]), (40, [5.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VEC)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.query(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 0.0), (20, 1, 21, 2.0), (20, 2, 22, 1.0)]


def records(spark, rows):
    h = "array<struct<name:string,value:string>>"
    return spark.createDataFrame(rows, f"record_id long, url string, ts long, kind string, headers {h}")


def test_warc(spark):
    rows = [
        (1, "http://A.com:80/x/?utm_source=q#f", 10, "response", [("ETag", '"a"'), ("Content-Type", "t"), ("Date", "d1"), ("date", "d2")]),
        (2, "https://www.a.com/x", 20, "revisit", [("etag", 'W/"a"'), ("DATE", "d3"), ("Content-Length", "0")]),
        (3, "https://a.com/x", 20, "response", [("ETag", '"b"')]),
        (4, "https://a.com/x", 30, "revisit", [("etag", '"a"')]),
        (5, "https://a.com/x", 30, "revisit", None),
        (6, "https://a.com/x", 5, "revisit", [("etag", '"a"')]),
        (7, None, 5, "revisit", [("etag", '"a"')]),
        (8, "https://a.com/x", None, "revisit", [("etag", '"a"')]),
        (9, "https://b.com/", 1, "response", [("Last-Modified", "m")]),
        (10, "http://b.com", 2, "revisit", [("last-modified", "m")]),
        (11, "https://a.com/x", 20, "response", [("ETag", '"c"')]),
        (12, "https://a.com/x", 40, "revisit", [("ETag", '"c"')]),
        (12, "https://a.com/x", 40, "revisit", [("ETag", '"c"')]),
    ]
    got = sorted((r["record_id"], r["status"], r["ref_id"]) for r in warc.resolve(records(spark, rows)).collect())
    assert got == [
        (2, "resolved", 1), (4, "modified", None), (5, "unverified", None), (6, "orphan", None), (7, "unplaced", None), (8, "unplaced", None), (10, "resolved", 9), (12, "resolved", 11), (12, "resolved", 11),
    ]
    h = {r["record_id"]: r["headers"] for r in warc.resolve(records(spark, rows)).collect()}
    assert {(x["name"], x["value"]) for x in h[2]} == {("content-type", "t"), ("date", "d3"), ("etag", 'W/"a"')}
    assert warc.resolve(records(spark, [])).count() == 0


def test_warc_hot_url(spark):
    """One URL over many parts: each revisit finds the latest response before it."""
    rows = [(i, "http://hot.com/", i * 10, "response" if i % 50 == 0 else "revisit", [("etag", str(i // 50))]) for i in range(1, 3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["record_id"]: r["ref_id"] for r in warc.resolve(records(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: i // 50 * 50 or None for i in range(1, 3000) if i % 50}


def test_skew_join(spark):
    left = spark.range(0, 5000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    out = skew_join(left, right, "k", heavy_keys(right, "k", "n", 5000))
    assert out.count() == 5000 and out.filter("n is null").count() == 0
    assert out.filter("k = 1").select("n").distinct().count() == 1


def plain_groups(rows):
    """Component of each row: 0.8 of the 5-word shingles shared."""

    def shingle_set(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    keys = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for j in range(i):
            b = keys[j]
            if a == b or 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def test_pipeline(spark, tmp_path):
    """Each stage against a plain version of it on the rows the one before kept, and run() as a whole."""
    from test_documents import plain_kept
    from texts import local

    # 100 at most: from 100 on, ids are those of the copies
    docs = documents(spark, 100).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "secret scans", "packing"]
    kept = [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = str(tmp_path / f"stage{k}.parquet")
        stage(spark, kept[-1], str(tmp_path)).write.parquet(out)
        kept.append(spark.read.parquet(out))
        assert kept[-1].columns == docs.columns, name
    rows = [r for r in kept[0].collect()]
    bag = lambda x: sorted(((r["doc_id"], r["text"]) for r in x), key=repr)
    verdict = plain_kept([r["text"] for r in rows], [(r["lang"], r["source"]) for r in rows])
    assert bag(kept[1].collect()) == bag(r for r, (_, keep) in zip(rows, verdict, strict=True) if keep)
    labeller = langid.Labeller(langid.fit(kept[1]))
    said = [labeller.predict([(r["text"] or "").encode()])[0] for r in kept[1].collect()]
    assert bag(kept[2].collect()) == bag(r for r, (lang, share, _) in zip(kept[1].collect(), said, strict=True) if lang != "und" and share >= 0.5)
    pairs = local(kept[2])
    group = plain_groups(pairs)
    least = {}
    for (i, _), g in zip(pairs, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    assert sorted(r["doc_id"] for r in kept[3].filter("doc_id is not null").collect()) == sorted(least.values())
    assert kept[4].count() == kept[3].count() > 60 and {100} <= {r["doc_id"] for r in kept[4].collect()}
    want = sorted(((p["doc_id"], p["start"], p["ids_crc32"]) for p in corpus_pipeline.STAGES[-1][1](spark, kept[4], "").filter("start = 0").select("doc_id", "start", "ids_crc32", "length", "doc_tokens").filter("length = doc_tokens").collect()), key=repr)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in again.collect()} == {r["doc_id"] for r in kept[4].collect()} and want


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_near_copies(spark):
    """Planted pairs of 5-word similarity 0.8 to 0.95 lose one; pairs below 0.8 stay; a chain of copies loses all but one."""
    import random

    rng = random.Random(3)

    def words(n):
        return ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]

    def shingles_of(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    def changed(w, n):
        w = list(w)
        for i in range(n):
            w[(i * 2 + 1) * len(w) // (2 * n)] = words(1)[0]
        return w

    rows, near, far = [], set(), set()
    for k, (n, edits) in enumerate([(100, 1), (100, 2), (300, 2), (300, 6), (1000, 10), (1000, 20), (100, 4), (300, 12)] * 6):
        w = words(n)
        v = changed(w, edits)
        share = len(shingles_of(w) & shingles_of(v)) / len(shingles_of(w) | shingles_of(v))
        assert 0.8 <= share <= 0.99 or 0.6 < share < 0.8
        (near if share >= 0.8 else far).add(2 * k + 1)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    assert len(near) == 36 and len(far) == 12
    w = words(100)
    for k in range(1000, 1006):
        rows.append((k, " ".join(w)))
        w = changed(w, 2)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert not kept & near and far <= kept
    assert {i for i in kept if i % 2 == 0 and i < 1000} == set(range(0, 96, 2)) and {i for i in kept if i >= 1000} == {1000}


def test_pages_of_a_template(spark):
    """Pages of one template with enough of their own all stay, and the pairs compared grow as the pages do."""
    import random

    from attesta.llm import shingles

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    template = [word() for _ in range(100)]
    pages = [(i, " ".join(template + [word() for _ in range(25)])) for i in range(600)]
    pages += [(1000 + i, t) for i, (_, t) in enumerate(pages[:5])] + [(2000, pages[7][1].rsplit(" ", 2)[0])]
    compared = []
    similar = shingles.similar
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(shingles, "similar", lambda pairs, sets: compared.append(pairs.count()) or similar(pairs, sets))
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in pages], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(range(600))
    assert sum(compared) < 30 * 600


@pytest.mark.parametrize("edits", [[0, 1, 1, 2, 2, 3, 3, 4], [2]])
def test_near_copies_of_one_text(spark, edits):
    """A large group of near copies, many below 0.8 to most others: hubs connect it, so few pairs are left to compare one by one; components are those of all similar pairs.

    Fingerprints propose nothing here."""
    import random
    from itertools import combinations

    from attesta.llm import shingles

    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    base = [word() for _ in range(150)]
    copies = []
    for _ in range(300):
        w = list(base)
        for at in rng.sample(range(150), rng.choice(edits)):
            w[at] = word()
        copies.append(w)
    sets = [{tuple(w[i : i + 5]) for i in range(146)} for w in copies]
    root = list(range(300))
    for i, j in combinations(range(300), 2):
        both = len(sets[i] & sets[j])
        if both * 100 >= (len(sets[i]) + len(sets[j]) - both) * 80 and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    rare_pairs, left = shingles.rare_pairs, []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(shingles, "rare_pairs", lambda nodes, sets: left.append(rare_pairs(nodes, sets).count()) or rare_pairs(nodes, sets))
        patch.setattr(shingles, "print_pairs", lambda signed: signed.select(F.col("node").alias("a"), F.col("node").alias("b")).filter("a != b"))
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(copies)], "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: r["component_id"] for r in shingles.components_of(docs).collect()}
    assert got == dict(enumerate(root))
    assert sum(left) < 300
