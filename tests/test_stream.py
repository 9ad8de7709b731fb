"""Contradictions on a stream against the batch result, and theme names from replies."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import naming, themes
from attesta.streaming import contradiction

SCHEMA = "theme_id long, span_id string, text string, ts timestamp, theme string"


def run(spark, tmp_path, batches, late="1 hour"):
    """What a stream of these batches, a file each, leaves."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / f"b{i:03d}"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        q = contradiction.changes(stream, late=late).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start(out).awaitTermination()
    changed = spark.read.schema(contradiction.CHANGES).parquet(out)
    return changed, {r["theme_id"]: (r["up"], r["down"], r["contradiction"], r["consistency"]) for r in contradiction.settled(changed).collect()}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    says = ["Rents rose by 3 percent.", "Rents fell by 3 percent.", "Rents are paid.", None]
    rows = []
    for i in range(600):
        theme = rng.choice([0, 0, 0, 1, 2, 3, None])  # one theme holds nearly half
        text = rng.choice(says) if theme in (0, None) else says[0] if theme == 1 else says[2] if theme == 2 else rng.choice(says[1:])
        rows.append((theme, f"s{i}", text, start + timedelta(minutes=i), "x"))
    again = [rng.choice(rows[max(0, i - 40) : i + 1]) for i in range(600)]  # repeated, up to 40 minutes late
    mixed = [x for pair in zip(rows, again, strict=True) for x in pair] + [(0, None, says[0], start, "x"), (0, "t", says[0], None, "x")]
    batches = [mixed[i : i + 300] for i in range(0, len(mixed), 300)]
    changed, got = run(spark, tmp_path, batches)
    pol = spark.createDataFrame(rows, SCHEMA).withColumn("p", T.polarity(F.col("text")))
    want = pol.groupBy("theme_id").agg(F.count_if(F.col("p") == "positive").alias("up"), F.count_if(F.col("p") == "negative").alias("down")).collect()
    assert {k: v[:2] for k, v in got.items()} == {r["theme_id"]: (r["up"], r["down"]) for r in want if r["up"] + r["down"]}
    assert got[0][2] and not got[1][2] and got[0][3] == 0 and got[1][3] > 0 and 2 not in got
    assert changed.filter("theme_id = 0").select("part").distinct().count() > contradiction.PARTS // 2


def test_stream_late_rows(spark, tmp_path):
    """Rows behind the watermark are dropped, and ids are freed once it has passed them: the counts stay."""
    day = datetime(2024, 1, 1)
    up, down = "Rents rose by 3 percent.", "Rents fell by 3 percent."
    batches = [[(0, "a", up, day, "x")], [(0, "b", up, day + timedelta(days=1), "x")], [(0, "c", down, day, "x"), (0, "b", up, day + timedelta(days=1), "x")], [(0, "d", up, day + timedelta(days=3), "x")]]
    _, got = run(spark, tmp_path, batches)
    assert got == {0: (3, 0, False, got[0][3])}


@pytest.mark.parametrize(
    ("reply", "want"),
    [('["Housing Costs", " Energy "]', ["Housing Costs", "Energy"]), ('```json\n["A b", "", 3]\n```', ["A b", "3"]), ("Here: [\"X\"] as asked", ["X"]), ("none", None), ("[broken", None), ('["a" "b"]', None), ("]x[", None), (None, None), ("[]", [])],
)
def test_names(reply, want):
    assert naming.names(reply) == want


def test_naming(spark):
    chunks = spark.createDataFrame([(f"c{i:02d}", f"Rent arrears rose in area {i}. Rent arrears persist. " + "x" * 900) for i in range(30)], "chunk_id string, text string")
    asked = []

    def ask(rule, message):
        asked.append((rule, message))
        return '["Rent Arrears Growth"]'

    plain = [r["theme"] for r in themes.discover_themes(chunks).orderBy("theme_id").collect()]
    got = [r["theme"] for r in themes.discover_themes(chunks, namer=naming.by_asking(ask)).collect()]
    assert got == ["Rent Arrears Growth"] or got == plain  # the latter where the flag is off
    assert all(len(m.split("Excerpt:\n")[1]) == naming.SAMPLE_CHARS and "area 0." in m for _, m in asked)
    for bad in (lambda *a: 1 / 0, lambda *a: "no array", lambda *a: "[]"):
        assert [r["theme"] for r in themes.discover_themes(chunks, namer=naming.by_asking(bad)).orderBy("theme_id").collect()] == plain
