"""Norms of many spans are found in turns, each of which shuffles a part of the postings only."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import index as I


def spans(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, sent_no long, text string")
    return df.withColumn("span_seq", F.struct("doc_id", "sent_no"))


def norms(df):
    return {tuple(r["span_seq"]): r["nrm"] for r in df.collect()}


@pytest.mark.parametrize("by", ["span_seq", "doc_id"])
def test_turns_give_the_norms_of_the_index(spark, by, monkeypatch):
    rng = random.Random(3)
    words = ["rent", "arrears", "rose", "town", "council", *(f"w{i}" for i in range(60))]
    rows = [(d, s, rng.choice([" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))), "", None])) for d in range(60) for s in range(4)]
    df = spans(spark, rows)
    want = norms(I.build_index(df).norms)
    written = []
    keep = I.materialize
    monkeypatch.setattr(I, "materialize", lambda d: written.append(keep(d)) or written[-1])
    assert norms(I.span_norms(df, by=by)) == pytest.approx(want) and len(written) == 1
    # Of terms only those of two spans or more are kept
    assert written[0].filter("term != ''").agg(F.min("df")).first()[0] == 2
    assert written[0].filter("term = ''").first()["df"] == 240
    monkeypatch.setattr(I, "NORM_SPANS", 30)
    del written[:]
    assert norms(I.span_norms(df, by=by)) == pytest.approx(want)
    sizes = [d.count() for d in written[1:]]
    assert len(sizes) == I.NORM_TURNS and sum(sizes) == len(want) and max(sizes) < len(want) / 2


def test_norms_of_few_texts(spark):
    for rows in ([], [(1, 1, None)], [(1, 1, "Rents rose. Rents fell.")]):
        df = spans(spark, rows)
        assert norms(I.span_norms(df)) == pytest.approx(norms(I.build_index(df).norms))


def test_a_turn_reads_only_its_documents(spark, monkeypatch):
    """The turn's filter stands before texts are cut, so that each text is cut once for all turns."""
    import __spark_entry__ as entry

    plans = []
    keep = I.materialize
    monkeypatch.setattr(I, "NORM_SPANS", 100)
    monkeypatch.setattr(I, "materialize", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or keep(d))
    entry.queries()["q20_norm"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 + I.NORM_TURNS
    for plan in plans[1:]:
        lines = plan.splitlines()
        cut, kept = ([i for i, x in enumerate(lines) if part in x] for part in ("Generate posexplode", "pmod(xxhash64(doc_id"))
        assert len(cut) == len(kept) == 1 and cut[0] < kept[0], plan
