"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from texts import documents

from attesta.llm import resample
from attesta.llm.common import windows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(text):
    words = WORD.findall((text or "").translate(UP))
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(g.encode()) % 10000 for g in grams)


def plain(docs, target):
    bags = [bag(t) for _, t in docs]
    source, wanted = Counter(), Counter()
    for _, b in bags:
        source += b
    for t in target:
        wanted += bag(t)[1]
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000))))
    rows = []
    for (i, _), (n, b) in zip(docs, bags, strict=True):
        weight = sum(gain(k) * c for k, c in b.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, sum(b.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: len(able) * 5 // 100], 1)}
    return Counter((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in rows)


def result(df):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect())


def put(spark, tmp_path, docs, target):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    target.write.parquet(f"{tmp_path}/benchmark.parquet")
    return resample.query(spark, str(tmp_path))


@pytest.mark.parametrize("long", [40, 1 << 15])
def test_resample(spark, tmp_path, monkeypatch, long):
    """With short chunks, so that most texts are cut, and with the usual ones."""
    monkeypatch.setattr(resample, "LONG", long)
    docs = documents(spark, 200)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = [r[1] for r in rows[:20]] + [None, ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = result(put(spark, tmp_path, docs.drop("_row"), frame))
    assert got == plain(rows, target)
    assert sum(c for k, c in got.items() if k[4]) == sum(bag(t)[0] >= 20 for _, t in rows) * 5 // 100


def test_resample_of_nothing(spark, tmp_path):
    docs = documents(spark, 5)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert result(put(spark, tmp_path / "a", docs.limit(0), empty)) == Counter()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(put(spark, tmp_path / "b", docs, empty)) == plain(rows, [])


def test_resample_clashing_columns(spark, tmp_path):
    docs = documents(spark, 30)
    more = docs.withColumns({c: docs["ids"] for c in ("rank", "score", "chunk", "carried", "n_words", "weight", "bucket")})
    target = spark.createDataFrame([(1, "a b c", 2)], "item_id long, text string, doc_id long")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(put(spark, tmp_path, more, target)) == plain(rows, ["a b c"])


def test_resample_ties(spark, tmp_path):
    """Repeated rows, a third of all, tie: the smaller id is drawn first, and each row has a rank of its own."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text)] * 40 + [(i, text) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(0, text)], "item_id long, text string")
    got = result(put(spark, tmp_path, docs, target))
    assert got == plain(rows, [text])
    assert sorted(k[4] for k in got if k[4]) == list(range(1, 7))


def test_windows():
    rng = random.Random(0)
    for _ in range(2000):
        text = "".join(rng.choices("ab   ", k=rng.randint(0, 60))).encode()
        size, carry = rng.randint(1, 9), rng.randint(0, 3)
        tokens = text.split()
        grams, held = [], []
        for part, more in windows(text, size, carry):
            own = part.split()
            held += own[: len(own) - more]
            grams += [tuple(own[i : i + carry + 1]) for i in range(len(own) - more)]
        assert held == tokens
        assert grams == [tuple(tokens[i : i + carry + 1]) for i in range(len(tokens))]
