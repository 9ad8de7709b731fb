"""Collocations against a plain version."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from texts import documents

from attesta.llm import collocations

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least=30, best=2000):
    counts = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            counts[lang or "und"].update(tuple(w[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        able = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in able.items():
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in able.items()):
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def result(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "b", "C", "dİ", "e\x85", "fé", "ß", "\U0001f600"]
    fixed = [["New", "york", "stock", "exchange"], ["per", "cent"], ["x", "x", "x", "x", "x"]]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 30)):
            text += " ".join(rng.choice(fixed) if rng.random() < 0.3 else [rng.choice(words)]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\xa0"])
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("block", [50, 1 << 22])
def test_collocations(spark, monkeypatch, block):
    """Also in windows of a few words, so that most texts are cut."""
    monkeypatch.setattr(collocations, "BLOCK", block)
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = plain([(la, t) for _, t, la in rows])
    assert result(collocations.query(df)) == want
    assert len(want) > 10
    assert result(collocations.mine(df, best=5)) == plain([(la, t) for _, t, la in rows], best=5)


def test_collocations_sql(spark):
    rows = corpus(2, 200)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    got = con.sql(collocations.ORACLE)
    assert got.columns == COLUMNS
    assert sorted(got.fetchall()) == plain([(la, t) for _, t, la in rows])


def test_collocations_of_odd_documents(spark):
    docs = documents(spark, 60)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    more = docs.withColumns({c: docs["ids"] for c in ("phrase", "n", "words", "f", "rank")})
    want = plain(rows)
    assert result(collocations.query(more)) == want
    assert any(p[2] == "word word word word" for p in want)
    assert result(collocations.query(docs.limit(0))) == []


def test_filter(spark, monkeypatch):
    """No phrase is missed, and few others pass; a full field passes all and changes no result."""
    frequent = [("en", f"w{i} v{i}") for i in range(1000)]
    field = collocations.filter_of(spark.createDataFrame(frequent, "lang string, phrase string"))

    def passed(lang, phrase):
        hashes = collocations._word_hashes(lang, phrase.encode().split(b" "))
        return bool(collocations.may_hold(field, collocations._extend(hashes[:1], hashes[1:]))[0])

    assert all(passed(*x) for x in frequent)
    assert sum(passed("de", p) or passed("en", p + "x") for _, p in frequent) < 5
    monkeypatch.setattr(collocations, "FILTER", 64)
    rows = corpus(3, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert result(collocations.mine(df, least=10)) == plain([(la, t) for _, t, la in rows], least=10)


def test_large_counts(spark):
    """Products pass 64 bits."""
    big = 4 * 10**18
    found = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, words int, f long")
    row = collocations.scored(found).first()
    assert (row["a"], int(row["score"])) == (big - 1, 2000000 * (big - 1) // (2 * big))
