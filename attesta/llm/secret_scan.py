"""Secret scans by corpus-wide ownership (operator 10), built-in functions only.

Candidates are the base matches (assigned values, access keys, long hexadecimal runs) and long
tokens that look drawn by chance: with a run, free of separators, in which letters and digits mix.
Paths, UUIDs, identifiers with a number, dated names and what belongs to a URL don't. Over the whole corpus each candidate value, as a hash, is
counted by distinct repositories and owners. One that ``EXAMPLE_OWNERS`` owners hold, or several
owners in ``EXAMPLE_REPOS`` repositories, is a widely copied example; one that a single owner holds
in fewer repositories is a live-looking credential; what is between (a few owners, or one owner who
copies it into many repositories, as with vendored files) is shared. The method adds the mixed
tokens that are live as spans of kind ``owned``; base matches always stay spans, and their verdicts
are counted.

Counting is by (value, owner, repository), then (value, owner), then value, each with map-side
sums, so a value copied through the corpus is never gathered in one task. Verdicts return to the
candidates with values that hold a large share of them broadcast (see skew_join).

Defined cases: null text is empty, without spans; null owner or repository counts as one unnamed
owner or repository; repeated rows each return and count once per repository; an empty table gives
an empty result; extra columns are kept by ``redact``, whatever their names, and ignored by ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy_keys, materialize, renamed, skew_join
from .spans import joined, of_kind, with_spans

# The patterns of the base, written so that a match can only start where it must.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
# What follows :// is passed over.
TOKEN = r"://\S*+|(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{20,}+)"
# A run without separators, of 16 characters, 4 letters and 4 digits or more, in which letters stand between digits or digits between letters.
RANDOM = r"(?<![A-Za-z0-9+])(?=[A-Za-z0-9+]{16})(?=(?:[A-Za-z+]*+[0-9]){4})(?=(?:[0-9+]*+[A-Za-z]){4})(?=[A-Za-z0-9+]*?(?:[A-Za-z][0-9]++[A-Za-z]|[0-9][A-Za-z]++[0-9]))"

#: A value of this many distinct owners, or of several and this many distinct repositories, is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 10


def candidates(docs: DataFrame, owner: Column, repo: Column, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` of every row, owner, repo, base and extra: spans with a hash for value. One pass, no shuffle."""
    df = docs.select(*keep, owner.cast("string").alias("_owner"), repo.cast("string").alias("_repo"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    t = F.col("_text")
    df = with_spans(df, "_text", "_assign", "assign", 0, ASSIGN, F.lit(True), lambda m, v: F.char_length(v) >= 8, group=1)
    df = with_spans(df, "_text", "_access", "access", 1, ACCESS, F.contains(t, F.lit("AKIA")), lambda m, v: F.lit(True))
    df = with_spans(df, "_text", "_hex", "hex", 2, HEX, F.lit(True), lambda m, v: F.lit(True))
    df = with_spans(df, "_text", "_extra", "owned", 3, TOKEN, F.lit(True), lambda m, v: (v != "") & v.rlike(RANDOM), group=1)
    base = F.concat("_assign", "_access", "_hex")
    free = F.filter("_extra", lambda x: ~F.exists(F.col("_base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    hashed = lambda a: F.transform(a, lambda x: F.struct(x["kind"], x["ord"], x["start"], x["end"], F.unhex(F.sha2(x["value"], 256)).alias("id")))
    df = df.withColumn("_base", base).withColumn("_extra", F.when(F.size("_extra") > 0, free).otherwise(F.col("_extra")))
    return df.select(*keep, "_owner", "_repo", hashed(F.col("_base")).alias("_base"), hashed(F.col("_extra")).alias("_extra"))


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """A row per candidate value: id, n_owners, n_repos, n (candidates) and verdict."""
    each = found.select("_owner", "_repo", F.explode(F.concat(F.transform("_base", lambda x: x["id"]), F.transform("_extra", lambda x: x["id"]))).alias("id"))
    by_repo = each.groupBy("id", "_owner", "_repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("id", "_owner").agg(F.count(F.lit(1)).alias("n_repos"), F.sum("n").alias("n"))
    by_id = by_owner.groupBy("id").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_repos").alias("n_repos"), F.sum("n").alias("n"))
    many = F.col("n_repos") >= example_repos
    example = (F.col("n_owners") >= example_owners) | ((F.col("n_owners") > 1) & many)
    verdict = F.when(example, "example").when((F.col("n_owners") == 1) & ~many, "live").otherwise("shared")
    return by_id.withColumn("verdict", verdict)


def verdicts(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Of ``found`` (with _row, written once): _row and judged, its spans with their verdicts, for rows that have any."""
    owned = materialize(ownership(found, example_owners, example_repos))
    total = owned.agg(F.sum("n").alias("n")).first()["n"] or 0
    each = found.select("_row", F.explode(F.concat("_base", "_extra")).alias("x")).select("_row", "x", F.col("x.id").alias("id"))
    back = skew_join(each, owned.select("id", "verdict"), "id", heavy_keys(owned, "id", "n", total))
    span = F.struct("x.kind", "x.ord", "x.start", "x.end", "verdict")
    return back.groupBy("_row").agg(F.collect_list(span).alias("judged"))


JUDGED = "array<struct<kind:string,ord:int,start:int,end:int,verdict:string>>"


def scan(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """doc_id and judged, all candidate spans with verdicts, of every row."""
    found = candidates(docs, F.col(owner_col), F.col(repo_col), ["doc_id"])
    found = materialize(found.withColumn("_row", F.monotonically_increasing_id()))
    judged = verdicts(found.filter((F.size("_base") > 0) | (F.size("_extra") > 0)), example_owners, example_repos)
    return found.join(judged, "_row", "left").select("doc_id", F.coalesce("judged", F.array().cast(JUDGED)).alias("judged"))


def redact(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span that isn't a widely copied example replaced by ``mask``; n_chars, if there is one,
    follows the new text. Overlapping spans are masked as one. Rows without candidates aren't shuffled."""
    inner, names, back = renamed(docs)
    text_name = names["text"]
    found = candidates(inner, F.col(names[owner_col]), F.col(names[repo_col]), inner.columns, text_name)
    found = materialize(found.withColumn("_row", F.monotonically_increasing_id()))
    some = found.filter((F.size("_base") > 0) | (F.size("_extra") > 0))
    judged = verdicts(some.select("_row", "_owner", "_repo", "_base", "_extra"), example_owners, example_repos)
    risky = F.array_sort(F.transform(F.filter("judged", lambda x: (x["kind"] != "owned") & (x["verdict"] != "example") | (x["verdict"] == "live")), lambda x: F.struct(x["start"], x["end"])))
    text = F.coalesce(F.col(text_name), F.lit(""))
    masked = F.aggregate(
        risky,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mask))).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))),
    )
    done = some.join(judged, "_row").withColumn(text_name, F.when(F.size(risky) > 0, masked).otherwise(F.col(text_name)))
    if "n_chars" in docs.columns:
        chars = names["n_chars"]
        done = done.withColumn(chars, F.when(F.size(risky) > 0, F.char_length(text_name)).otherwise(F.col(chars)).cast(docs.schema["n_chars"].dataType))
    plain = found.filter((F.size("_base") == 0) & (F.size("_extra") == 0))
    return back(plain).unionByName(back(done))


def query(docs: DataFrame) -> DataFrame:
    base = F.filter("judged", lambda x: x["kind"] != "owned")
    spans = F.filter("judged", lambda x: (x["kind"] != "owned") | (x["verdict"] == "live"))
    verdict = lambda v: F.size(F.filter(F.col("spans_"), lambda x: x["verdict"] == v)).cast("long").alias(f"n_{v}")
    df = scan(docs).select("doc_id", base.alias("base"), spans.alias("spans_"))
    return df.select(
        "doc_id", *(of_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans_")).alias("spans"),
        verdict("example"), verdict("live"), verdict("shared"),
    )
