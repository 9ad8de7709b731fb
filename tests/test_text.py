"""Facts about single texts: segmentation, hygiene, typing and labels."""

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.functions.folds import chunk_texts, pack_paragraphs, pack_sentences, pages_by_size
from attesta.operators import themes, verify
from attesta.operators.segment import unique_tags


@pytest.mark.parametrize(
    ("text", "there", "gone"),
    [
        ("Rents rose by 1% in the social rented sector, Figure 1.9 and Annex Table 1.6.", "social rented sector", ["Figure", "Annex"]),
        ("As shown in Appendix B, rents rose quickly in London.", "Rents rose quickly in London.", ["Appendix"]),
        ("Vacancies fell over the year (see Table 4.2).", "Vacancies fell over the year.", ["Table"]),
        ("Output grew strongly in March. Source: national accounts.", "Output grew strongly in March.", ["Source"]),
        ("Output grew by 3 percent [12] in March.", "Output grew by 3 percent in March.", ["[12]"]),
    ],
)
def test_clean(column, text, there, gone):
    out = column([text], T.clean_evidence)[0]
    assert there in out
    assert not any(g in out for g in gone)


def test_clean_quirks(column):
    """The patterns have no leading boundary, take plurals for references, and cut at bare markers."""
    out = column(["The timetables were late again.", "Rents on many pages rose again today.", "Rents rose across the whole chart area of town."], T.clean_evidence)
    assert out[0] == "The time were late again."
    assert out[1] == ""
    assert out[2] == "Rents rose across the whole."
    assert column(["8% of", "8%of x"], lambda c: T.has(c, r"\b(?:%)\b")) == [False, True]


def test_empty_and_null(column):
    assert column(["", None, " "], T.clean_evidence) == ["", "", ""]
    assert column([""], T.sentences) == [[]]
    assert column(["", None], lambda c: T.is_eligible(T.clean_evidence(c))) == [False, False]
    assert column(["", None], T.is_low_quality) == [True, True]
    assert column(["", None], T.is_noise) == [True, True]
    assert column(["", None], T.is_metadata) == [True, True]
    assert column([None], T.is_garbage) == [True]


def test_reference(column):
    texts = ["Figure 1.9 shows it", "Appendix B", "on page 14", "Note: x", "plain words only", "the table a"]
    assert column(texts, T.has_reference) == [True, True, True, True, False, True]


def test_sentences(column):
    out = column(["Mr. Smith rose. Prices fell by 1.5 percent! Why? \"So.\" e.g. this"], T.sentences)[0]
    assert out == ["Mr. Smith rose.", "Prices fell by 1.5 percent!", "Why?", '"So." e.g. this']
    glued = column(["NHS WORKFORCE STATISTICS Staff vacancies rose.", "0 10 20 30 owner occupied The number rose.", "Results Private renters moved."], T.sentences)
    assert glued[0] == ["NHS WORKFORCE STATISTICS.", "Staff vacancies rose."]
    assert glued[1][-1] == "The number rose."
    assert glued[2] == ["Results.", "Private renters moved."]


def test_noise(column):
    texts = ["0 10 20 30 40 50 60", "12% 12% 12% of the homes were let", "Rents rose by 3 percent in 2020", "10 20 30 40 percent of homes were let out then", ""]
    assert column(texts, T.is_noise) == [True, True, False, True, True]


def test_low_quality(column):
    texts = ["14 private renters.", "Too short", "Affordability worsened in London", "The big house on hills"]
    assert column(texts, T.is_low_quality) == [True, True, False, True]


def test_types(column):
    cases = {
        "This may not hold.": "Limitation", "A tenure is defined as a right.": "Definition", "Rents rose by 3 percent.": "Statistical trend", "Rents rose.": "Trend",
        "It was 1200 homes.": "Statistical finding", 'He said "no".': "Interview quote", "The government acts.": "Policy statement", "Nothing here.": "General statement",
    }
    assert column(list(cases), T.evidence_type) == list(cases.values())
    assert column(["Nothing here."], lambda c: T.evidence_type(c, F.lit("a.CSV"))) == ["Interview quote"]


def test_polarity(column):
    assert column(["Rents rose", "Rents fell", "Rents rose and fell", "stable", ""], T.polarity) == ["positive", "negative", "neutral", "negative", "neutral"]


def test_garbage(column):
    texts = ["short", "endobj xref words words words", "12345 67890 !!!! 1234 ab", "These are plain words.", "abc ��� words here"]
    assert column(texts, T.is_garbage) == [True, True, True, False, True]


def test_labels(column):
    out = column(["https://www.gov.uk/a", "https://x.ac.uk/b", "https://y.org/", "http://z.com", "my_file-v2.pdf", ""], lambda c: T.source_label(c, F.lit(3)))
    assert out == ["Government Report (gov.uk) · Page 3", "Academic Source (x.ac.uk) · Page 3", "Organisation (y.org) · Page 3", "Web Source (z.com) · Page 3", "my file v2 · Page 3", "Unknown source"]
    assert column(["a/My File.txt", "...", "x" * 20 + ".csv", ".hidden"], T.safe_tag) == ["myfile", "doc", "x" * 8, "hidden"]


def test_long_texts(column):
    """Patterns don't run out of stack or time on very long runs."""
    long = ["A B " * 50_000, "ABC " * 50_000 + "Then it rose.", "1 " * 50_000, "x" * 200_000]
    assert len(column(long, T.sentences)) == 4
    assert column(long[2:], T.is_noise) == [True, False]


def test_themes(column):
    assert column(["Annex Table", "Households", "Data Analysis", "Rent Arrears", "", "of"], themes.is_weak) == [True, True, True, False, True, True]
    assert column(["rented", "renters", "houses", "buying", "es", "bus"], themes.stem) == ["rent", "rent", "hous", "buy", "es", "bus"]
    merged = column(["Social Rented|Social Renters|Social Rented Sector|Energy Bills"], lambda c: themes.merge(F.split(c, r"\|")))[0]
    assert merged == ["Social Rented Sector", "Energy Bills"]


def test_blacklist(column):
    assert column(["Underlying Data Presented", "Annex", "Survey Report", "First Time Buyers", "Notes on x"], T.is_blacklisted_theme) == [True, True, True, False, True]


def test_folds(column):
    assert pack_sentences([["a" * 300, "b" * 300, "c" * 300]], 800, 200) == ["a" * 300 + " " + "b" * 300, "c" * 300]
    assert pack_sentences([["short."], ["next."]], 800, 200) == ["short. next."]
    assert pack_sentences([], 800, 200) == []
    assert pack_paragraphs(["a" * 2000, "b" * 2000], 3000, "") == ["a" * 2000, "b" * 2000]
    assert pack_paragraphs([""], 3000, "whole") == ["whole"]
    assert column(["one\ftwo", "x", ""], pages_by_size) == [["one", "two"], ["x"], [""]]
    assert column(["First one. Second one.\n\nThird."], lambda c: chunk_texts(F.array(c))) == [[["First one. Second one. Third."]]]


def test_tags():
    assert unique_tags(["ab", "ab", "ab2", "ab"]) == ["ab", "ab2", "ab22", "ab3"]


def test_quotes(column):
    page = F.lit("It was seen that rents rose by five percent in the north of the country last year again")
    out = column(["rents rose", "rents rose by five percent in the north zzz", "a b c rents rose by five percent in the north", "rents rose by five qqq", "nothing"], lambda c: T.locate_quote(page, c))
    assert [o and o["strategy"] for o in out] == [1, 2, 3, 4, None]


def test_html(column):
    html = "<html><head><title>T &amp; x</title><script>var a='<p>';</script><style>p{}</style></head><body><nav>menu</nav><p>One <b>two</b></p><!-- no --><footer>f</footer></body>"
    assert column([html], T.html_text) == ["T & x\nOne\ntwo"]


def test_decimal(spark):
    rows = spark.createDataFrame([(0.5,), (0.4321,), (1.0,), (0.0005,), (0.1200,)], "x double").select(verify.decimal(F.col("x")).alias("v")).collect()
    assert [r["v"] for r in rows] == ["0.5", "0.4321", "1.0", "0.0005", "0.12"]


def test_sentences_of_odd_texts(column):
    """Held abbreviations and decimals, literal marks and white space of all kinds, against taking the full stops out and putting them back."""
    import random
    import re

    from attesta import lexicon as L

    rng = random.Random(5)
    parts = ["i.e.", "e.g.", "i.e.g.", "xi.e.g.", "No.", "Mrs.", "etc.", "é.", "3.5", "1.2.3", "A.", "Word", "b!", "c?", "<DOT>", "x<DOT>", '"Q', " ", "  ", "\n", " ", " ", "\t"]
    texts = ["".join(rng.choices(parts + [" "] * 8, k=rng.randint(0, 30))) for _ in range(400)]

    def plain(t):
        t = re.sub(rf"\b({L.ABBREVIATIONS})\.", r"\1<DOT>", t.strip())
        t = re.sub(r"(\d)\.(\d)", r"\1<DOT>\2", t)
        return [s for s in (p.replace("<DOT>", ".").strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'])", t)) if s]

    assert column(texts, T.sentences) == [plain(t) for t in texts]


def test_sentences_are_scanned_few_times(spark):
    """A text is searched once to trim it, once for each glued step and once to split it; its sentences aren't searched."""
    plan = spark.range(1).selectExpr("cast(id as string) t").select(T.sentences(F.col("t")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 4 and plan.count("split(") == 1


def test_tokens_of_ascii_and_other_texts(column):
    """Both ways to find words give the words of the Unicode classes."""
    import re

    from attesta.config import DEFAULT

    texts = ["Rent_2 a bc x9 - 12%", "", None, "the Of", "gr\u00f6\u00dfe \u00e9 \u00e9a", "Kelvin KK x", "l'\u00e9t\u00e9 \u00f1u", "x\u0001yy zz"]
    stop = set(DEFAULT.stop_words)
    want = [None if t is None else [w for w in re.findall(r"\w{2,}", t.lower()) if w not in stop] for t in texts]
    assert column(texts, T.tokens) == want


@pytest.mark.parametrize("pack", [pages_by_size, lambda c: chunk_texts(F.array(c))])
def test_packing_holds_few_texts(spark, pack):
    """A worker gets few texts at a time, however many Spark would send it; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in ((10_000, 250), (0, 250), (7, 7)):
            spark.conf.set(name, given)
            spark.createDataFrame([("One. Two.",)], "t string").select(pack(F.col("t"))).collect()
            assert int(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, before)
