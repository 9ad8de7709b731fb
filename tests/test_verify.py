"""Scores, review, confidence, status and audit at their cut-points; no model has a say."""

import inspect

import pytest
from pyspark.sql import functions as F

from attesta import lexicon as L
from attesta.config import DEFAULT, Settings
from attesta.operators import index as I
from attesta.operators import segment, verify

CAND = "theme_id int, theme string, retrieval_rank int, span_seq long, span_id string, page_number int, source_document string, text string, semantic_similarity double, retrieval_rank_score double"


def cand(spark, rows):
    return spark.createDataFrame(rows, CAND)


def row(text, sem=0.9, rank=1, theme="Rent Arrears", tid=0, src="a.txt"):
    return (tid, theme, rank, rank, f"s{rank}", 1, src, text, sem, 1.0 - 0.2 * (rank - 1))


def test_no_client_parameter():
    for _, f in inspect.getmembers(verify, inspect.isfunction):
        assert not {"client", "llm", "model"} & set(inspect.signature(f).parameters)


@pytest.mark.parametrize(
    ("args", "want"),
    [
        ((0, 0, 0, 0, "None", False), "INSUFFICIENT EVIDENCE"), ((3, 0, 0, 0, "None", False), "BLOCKED"), ((3, 2, 0, 0, "None", False), "BLOCKED"),
        ((3, 2, 2, 1, "High", True), "CONFLICTING EVIDENCE"), ((3, 2, 2, 1, "High", False), "VERIFIED"), ((3, 2, 2, 1, "Medium", False), "VERIFIED"),
        ((3, 2, 2, 0, "High", False), "PARTIALLY SUPPORTED"), ((3, 2, 2, 1, "Moderate", False), "PARTIALLY SUPPORTED"), ((3, 2, 2, 1, "Weak", False), "WEAK EVIDENCE"),
        ((3, 2, 2, 1, "Very Low", False), "BLOCKED"),
    ],
)
def test_status(spark, args, want):
    assert spark.range(1).select(verify.status(*(F.lit(a) for a in args)).alias("s")).first()["s"] == want


def test_score_and_tiers(spark):
    out = verify.score(cand(spark, [row("Rent arrears", 0.0), row("Rent arrears rose", 0.25, 2), row("Nothing alike", 0.1, 3)])).orderBy("retrieval_rank").collect()
    assert [r["final_score"] for r in out] == [0.6, 0.54, 0.22]
    assert [r["tier"] for r in out] == ["strong", "weak", "discard"]


def test_definition_is_never_strong(spark):
    out = verify.score(cand(spark, [row("Rent arrears is defined as rent arrears", 1.0)])).first()
    assert out["final_score"] <= 0.59 and out["tier"] == "weak"
    off = Settings(flags=DEFAULT.flags | {"definition_downweight": False})
    assert verify.score(cand(spark, [row("Rent arrears is defined as rent arrears", 1.0)]), off).first()["tier"] == "strong"


def test_review(spark):
    rows = [row("Rent arrears rose in the last year."), row("Rent arrears", rank=2), row("Rent of all homes rose last year.", rank=3, theme="Rent Arrears Debt Crisis"), row("Nothing alike at all in this.", rank=4)]
    out = cand(spark, rows).select("retrieval_rank", verify.review_answers(F.col("theme"), F.col("text")).alias("a")).withColumn("r", verify.review_result(F.col("a"))).orderBy("retrieval_rank").collect()
    assert [r["r"] for r in out] == ["Pass", "Weak", "Weak", "Reject"]
    missing = spark.range(1).select(verify.review_result(F.struct(F.lit("YES").alias("q1"), F.lit(None).cast("string").alias("q2"), F.lit("YES").alias("q3"))).alias("r")).first()
    assert missing["r"] == "Weak"


def findings(spark, rows, themes):
    table = spark.createDataFrame(themes, "theme_id int, theme string")
    return {r["theme_id"]: r for r in verify.findings(table, cand(spark, rows)).collect()}


def test_findings(spark):
    rows = [
        row("Rent arrears rose in the last year.", 0.8), row("Rent arrears increased again in London.", 0.7, 2, src="b.txt"),
        row("Energy bills rose in the last year.", 0.8, 1, "Energy Bills", 1), row("Energy bills fell in the last year.", 0.8, 2, "Energy Bills", 1),
        row("Nothing like the theme is here at all.", 0.2, 1, "Green Apples", 2), row("Weak words of tea in cups.", 0.06, 5, "Tea Trade History", 4),
    ]
    out = findings(spark, rows, [(0, "Rent Arrears"), (1, "Energy Bills"), (2, "Green Apples"), (3, "Purple Elephants"), (4, "Tea Trade History")])
    assert {k: v["status"] for k, v in out.items()} == {0: "VERIFIED", 1: "CONFLICTING EVIDENCE", 2: "BLOCKED", 3: "INSUFFICIENT EVIDENCE", 4: "BLOCKED"}
    assert [len(out[i]["audit_trail"]) for i in range(5)] == [5, 5, 2, 1, 3]
    assert out[0]["evidence"][0]["strength"]["label"] == "Strong Evidence"
    assert out[4]["reason"].startswith("BLOCKED — semantic/score too low (lowest ")
    assert out[3]["evidence"] == [] and out[3]["confidence"]["band"] == "None"
    c = out[0]["confidence"]
    # two spans, two sources, same direction: .4*.75 + .25*lex + .2*1 + .08*.25 + .07*.6
    lex = (2 / 5 + 2 / 5) / 2
    parts = 0.4 * 0.75 + 0.25 * lex + 0.2 + 0.02 + 0.042
    assert c["score"] == pytest.approx(min(parts * 1.35, 1), abs=2e-4)


def test_retrieval(spark):
    texts = ["Rent arrears rose sharply in many towns.", "Rent rose in some of the towns too.", "Figures on pages are listed.", "Cats were seen sleeping.", "Rent arrears rose sharply in many towns."]
    spans = spark.createDataFrame([(i, t, f"s{i}", "c", 1, "a.txt") for i, t in enumerate(texts)], "span_seq long, text string, span_id string, chunk_id string, page_number int, source_document string")
    themes = spark.createDataFrame([(0, "Rent Arrears"), (1, "Zebra")], "theme_id int, theme string")
    for rows in (spans, segment.with_hygiene(spans)):
        for given in (None, themes):
            out = I.retrieve(I.build_index(rows, given), themes).orderBy("theme_id", "retrieval_rank").collect()
            assert [(r["theme_id"], r["span_seq"]) for r in out] == [(0, 0), (0, 4), (0, 1)]
            assert [r["retrieval_rank_score"] for r in out] == [1.0, 0.8, 0.6]
    assert I.retrieve(I.build_index(spans), themes, k=1).first()["retrieval_rank_score"] == 1.0
    assert I.retrieve(I.build_index(spans.limit(0)), themes).count() == 0


def test_partition_count_does_not_matter(spark):
    texts = [(i, f"Rent arrears rose by {i % 7} percent in town {i % 5}.", f"s{i}", "c", 1, "a.txt") for i in range(60)]
    spans = spark.createDataFrame(texts, "span_seq long, text string, span_id string, chunk_id string, page_number int, source_document string")
    themes = spark.createDataFrame([(0, "Rent Arrears Town")], "theme_id int, theme string")
    got = {n: [tuple(r) for r in I.retrieve(I.build_index(spans.repartition(n)), themes).orderBy("retrieval_rank").collect()] for n in (1, 7)}
    assert got[1] == got[7]


def test_lexicon_sizes():
    assert len(DEFAULT.stop_words) == 318
    assert not set(L.POSITIVE) & set(L.NEGATIVE)
    assert not DEFAULT.is_enabled("no such flag") and not DEFAULT.is_enabled("llm_scoring")


def test_deep_look(spark, monkeypatch):
    """Eligible spans below many better but ineligible ones are found, as if all spans had been cleaned."""
    monkeypatch.setattr(I, "FIRST_LOOK", 2)
    texts = ["Rent arrears"] * 9 + [f"Rent arrears rose by {n} percent in the whole of the year." for n in range(4)] + ["Bills were low this winter."]
    spans = spark.createDataFrame([(i, t, f"s{i}", "c", 1, "a.txt") for i, t in enumerate(texts)], "span_seq long, text string, span_id string, chunk_id string, page_number int, source_document string")
    themes = spark.createDataFrame([(0, "Rent Arrears"), (1, "Bills")], "theme_id int, theme string")
    got = [(r["theme_id"], r["span_seq"]) for r in I.retrieve(I.build_index(spans, themes), themes, k=3).orderBy("theme_id", "retrieval_rank").collect()]
    assert got == [(0, 9), (0, 10), (0, 11), (1, 13)]


def test_tally(spark):
    """Term counts of a row against a plain count."""
    from collections import Counter

    rows = ["a1 b1 a1 b1 a1", "", None, "c1 " * 500, "the of"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "k int, text string")
    got = {(r["k"], r["term"]): r["tf"] for r in I.term_counts(df, "k").collect()}
    want = {}
    for i, t in enumerate(rows):
        w = [x for x in (t or "").split() if x not in ("the", "of")]
        want |= {(i, g): n for g, n in Counter(w + [" ".join(p) for p in zip(w, w[1:], strict=False)]).items()}
    assert got == want


def test_frequent_phrases(spark):
    """The most frequent phrases, found by way of the most frequent words, against counting all."""
    import random
    from collections import Counter
    from dataclasses import replace

    from attesta.config import DEFAULT
    from attesta.operators import themes as TH

    rng = random.Random(2)
    cfg = replace(DEFAULT, theme_vocabulary=12)
    rows = [(i % 9, " ".join(rng.choices([f"w{k}" for k in range(12)], weights=range(1, 13), k=rng.randint(0, 30)))) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, text string")
    grams = [[" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)] for w in (t.split() for _, t in rows)]
    total = Counter(g for gs in grams for g in gs)
    top = sorted(total, key=lambda g: (-total[g], g))[:12]
    want = Counter((k, g, n) for (k, _), gs in zip(rows, grams, strict=True) for g, n in Counter(gs).items() if g in top)
    assert Counter((r["k"], r["term"], r["tf"]) for r in TH.frequent_phrases(df, "k", cfg).collect()) == want


def test_copies_are_worked_on_once(spark):
    """Spans of one text are one row of a theme's index, and give the spans and scores that an index of all spans gives; texts that are null count."""
    kinds = [f"Rent arrears rose by {n} percent in the whole of the year." for n in range(4)] + ["Rent arrears", "Bills were low this winter.", "Arrears of bills were paid by rent.", None]
    spans = spark.createDataFrame([(i, kinds[i * i % 11 % 8], f"s{i}", "c", 1, "a.txt") for i in range(400)], "span_seq long, text string, span_id string, chunk_id string, page_number int, source_document string")
    themes = spark.createDataFrame([(0, "Rent Arrears"), (1, "Bills"), (2, "Zebra")], "theme_id int, theme string")
    for rows in (spans, segment.with_hygiene(spans)):
        few = I.build_index(rows, themes)
        texts = [r["text"] for r in few.spans.collect()]
        assert len(texts) == len(set(texts)) <= 7
        for k in (1, 3, 90):
            got, want = (sorted(tuple(r) for r in I.retrieve(x, themes, k=k).collect()) for x in (few, I.build_index(rows)))
            assert got == want and got


@pytest.mark.parametrize("name", ["q19_idf", "q20_norm"])
def test_texts_are_split_once_for_frequencies(spark, name, monkeypatch):
    """Frequencies and the number of texts come of one pass over the texts, whose sums are written."""
    import __spark_entry__ as entry

    written = []
    keep = I.materialize
    monkeypatch.setattr(I, "materialize", lambda df: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # q20 finds the terms of each text again, but nothing of them is written
    assert len(written) == 1 and written[0].count("regexp_extract_all") <= 2
    assert plan.count("split(") == (1 if name == "q20_norm" else 0)


def test_phrases_are_built_by_more_tasks_for_more_words(spark, monkeypatch):
    """The tasks that build phrases hold a bounded number of words, with the same phrases."""
    import re

    from attesta.operators import themes as TH

    df = spark.createDataFrame([(i, f"alpha{i % 7} beta gamma{i % 3} delta") for i in range(60)], "k int, text string")
    want = sorted(tuple(r) for r in TH.frequent_phrases(df, "k").select("k", "term", "tf").collect())
    plans = []
    keep = TH.materialize
    monkeypatch.setattr(TH, "materialize", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or keep(d))
    monkeypatch.setattr(TH, "PART_WORDS", 9)
    assert sorted(tuple(r) for r in TH.frequent_phrases(df, "k").select("k", "term", "tf").collect()) == want and want
    assert [int(n) for p in plans for n in re.findall(r"RepartitionByExpression \[_row#\d+L?\], (\d+)", p)] == [27]
