"""Chunks and discovered themes of whole tables against plain versions."""

import math
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from attesta import lexicon as L
from attesta.config import DEFAULT
from attesta.functions import text as T
from attesta.operators import themes

SF = "/root/testdata/sf0.001"


def _documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# --- chunks and spans ------------------------------------------------------------------------------


def _sentences(text):
    text = re.sub(r"\b((?:[A-Z][A-Z&]+\s+){2,}[A-Z][A-Z&]+)\s+(?=[A-Z][a-z])", r"\1. ", text.strip())
    text = re.sub(r"((?:\b\d{1,3}\b[ ]+){4,}(?:[a-z][a-z ]+?)?)(?=[A-Z][a-z])", r"\1. ", text)
    text = re.sub(rf"(^|(?<=[.!?])\s)({L.SECTION_HEADERS})\s+(?=[A-Z][a-z])", r"\1\2. ", text)
    hold = lambda m: m[0].replace(".", "\0")
    text = re.sub(rf"\b(?:{L.ABBREVIATIONS})\.", lambda m: m[0][:-1] + "\0", text)
    text = re.sub(r"\d\.\d", hold, text)
    return [s for s in (p.strip().replace("\0", ".") for p in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'])", text)) if s]


def _pages(text):
    if "\f" in text:
        return text.split("\f")
    pages = [""]
    for p in re.split(r"\n\s*\n", text):
        if len(pages[-1]) + len(p) + 2 <= 3000:
            pages[-1] = (pages[-1] + "\n\n" + p).strip()
        else:
            pages.append(p)
    return [p for p in pages if p] or [text]


def _chunks(page):
    done, now = [], ""
    for para in re.split(r"\n\s*\n+", page):
        for s in _sentences(" ".join(para.split())):
            if now and len(now) + len(s) + 1 > 800:
                done.append(now)
                now = s
            else:
                now = f"{now} {s}" if now else s
        if len(now) >= 200:
            done.append(now)
            now = ""
    return [*done, now] if now else done


def _garbage(c):
    hits = sum(m in c.lower() for m in L.PDF_INTERNALS)
    return len(c) < 10 or hits >= 2 or sum(x.isalpha() or x.isspace() for x in c) / len(c) < 0.55 or c.count("�") >= 3


def test_document_chunks(spark):
    want = []
    for i, text in _documents(spark).items():
        kept = [(p, c) for p, page in enumerate(_pages(text or ""), 1) for c in _chunks(page) if not _garbage(c)]
        want += [(i, n, k, p, s) for n, (p, c) in enumerate(kept, 1) for k, s in enumerate(_sentences(c), 1)]
    got = [tuple(r) for r in entry.queries()["q48_document_chunks"](spark, SF).select("doc_id", "chunk_no", "span_no", "page_number", "text").collect()]
    assert len(got) > 1000 and sorted(got) == sorted(want)


@pytest.mark.parametrize("name", ["q48_document_chunks", "q49_web_chunks"])
def test_python_runs_once(spark, name):
    """Pages and chunks are each packed once in the plan."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


# --- themes ----------------------------------------------------------------------------------------


def _words3(phrase):
    return {w for w in re.findall("[a-z]+", phrase.lower()) if len(w) > 2}


def _stem(w):
    for s in L.STEM_SUFFIXES:
        if w.endswith(s) and len(w) - len(s) >= 3:
            return w[: -len(s)]
    return w


def _stems(phrase):
    return {_stem(w) for w in _words3(phrase)}


def _merged(listed):
    """The fold over an ordered list, by its definition."""
    dull = {_stem(g) for g in L.GENERIC}
    kept = []
    for t in listed:
        a = _stems(t)
        for i, k in enumerate(kept):
            b = _stems(k)
            both = a & b
            if a and b and (len(both) / len(a | b) >= DEFAULT.theme_merge or len(both) >= 2 or a <= b or b <= a or both - dull):
                if len(_words3(t)) > len(_words3(k)):
                    kept[i] = t
                break
        else:
            kept.append(t)
    return kept


def test_theme_discovery(spark, column):
    stop = set(DEFAULT.stop_words)
    texts = [t for t in _documents(spark).values() if t]
    grams = []
    for t in texts:
        w = [x for x in re.findall(r"\b\w\w+\b", t.lower()) if x not in stop]
        grams.append(Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)))
    total = Counter()
    for g in grams:
        total.update(g)
    vocabulary = {t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[: DEFAULT.theme_vocabulary]}
    df = Counter(t for g in grams for t in g if t in vocabulary)
    score = Counter()
    for g in grams:
        w = {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in g.items() if t in vocabulary}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            score[t] += x / norm
    boost = {1: DEFAULT.boost_one, 2: DEFAULT.boost_two, 3: DEFAULT.boost_three}
    order = sorted(score, key=lambda t: (-round(score[t] * boost[len(t.split())], 9), t))
    banned = column(order, T.is_blacklisted_theme)  # q15 has SQL of its own
    best = []
    seen = []
    for t, bad in zip(order, banned, strict=True):
        own = _words3(t) - set(L.GENERIC)
        if bad or not own or (len(own) == 1 and own <= set(L.BROAD)):
            continue
        if not any(_words3(t) <= s for s in seen):
            best.append(t)
        seen.append(_words3(t))
    best = sorted(best[: DEFAULT.theme_candidates], key=lambda t: len(t.split()) < 2)
    want = _merged([" ".join(w.capitalize() for w in t.split(" ")) for t in best])[: DEFAULT.themes]
    got = [r["theme"] for r in entry.queries()["q39_theme_discovery"](spark, SF).orderBy("theme_id").collect()]
    assert len(got) > 1 and got == want


def test_merge_is_the_fold(spark):
    """Random ordered lists of phrases."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = ["rent", "rents", "rented", "energy", "bills", "housing", "houses", "report", "study", "cost", "costs", "uk", "low", "survey"]
    lists = [[" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 9))] for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, a array<string>").select("i", themes.merge(F.col("a")).alias("m")).collect()
    assert all(r["m"] == _merged(lists[r["i"]]) for r in rows)
