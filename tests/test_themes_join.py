"""Phrases inside better ones: the keyed join against the nested loop."""

import random

from attesta.operators import themes


def _nested(sets):
    """Ranks of the sets that no earlier set holds, by holders of each word."""
    held: dict[str, set[int]] = {}
    kept = []
    for rank, s in enumerate(sets):
        if s is None:
            kept.append(rank)
            continue
        earlier = set.intersection(*(held.get(w, set()) for w in s)) if s else {r for r in range(rank) if sets[r] is not None}
        if not earlier:
            kept.append(rank)
        for w in s:
            held.setdefault(w, set()).add(rank)
    return kept


def _rows(spark, sets):
    return spark.createDataFrame(list(enumerate(sets)), "rank int, toks array<string>").repartition(8)


def test_small_lists(spark):
    """Ties of sets, empty and null ones, up to six words; other columns stay."""
    rng = random.Random(3)
    for n in (0, 1, 60):
        sets = [None if rng.random() < 0.05 else rng.sample("abcdefgh", rng.randint(0 if i % 9 == 5 else 1, 6)) for i in range(n)]
        out = themes.uncovered(_rows(spark, sets))
        assert out.columns == ["rank", "toks"]
        assert sorted(r["rank"] for r in out.collect()) == _nested(sets)


def test_many_phrases(spark):
    """100,000 phrases; a third of them hold one word."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    sets = []
    for _ in range(100_000):
        s = {rng.choice(words[: rng.choice((30, 300, 3000))]) for _ in range(rng.randint(1, 4))}
        sets.append(sorted(s | {"hot"} if rng.random() < 0.33 else s))
    got = sorted(r["rank"] for r in themes.uncovered(_rows(spark, sets)).select("rank").collect())
    assert got == _nested(sets)
