"""Packing of pages and documents with odd characters against the queries' SQL."""

import random
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

PLAIN = [
    "Dr.", "e.g.", "i.e.g.", "No.", "3.14", "1 2 3 4 5 6 ", "The", "cat", "sat.", "Why?", "\"Yes", "'tis", "A&B", "ANNUAL", "SUMMARY", "REPORT", "Introduction", "<p>", "\n", "\n\n", "\r\n", "\t", "&nbsp;",
    "&lt;DOT&gt;", "<script>x</script>", "<nav>", "</nav>", "endobj", "xref", "word " * 30, "A sentence goes on and on here. " * 4, "12345 #*$%",
]
ODD = ["\f", "\v", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "​", "﻿", "\x01", "�", "\xe9", "\xf1Dr.", "\xe9e.g.", "\U0001f600", "é", "<ſcript>q</script>", "<nav\v>n</nav>", "<nav\f>n</nav\f>"]


def _texts():
    """Of every odd character 25 texts, and 100 with all of them."""
    rng = random.Random(3)
    for odd in [[o] * 6 for o in ODD for _ in range(25)] + [ODD] * 100:
        yield "".join(rng.choice(PLAIN + odd) + rng.choice(["", " ", " ", " "]) for _ in range(rng.choice([8, 20, 60, 120])))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    texts = [*_texts(), "", None]
    ids = pa.array(range(len(texts)), pa.int64())
    pq.write_table(pa.table({"page_id": ids, "url": [f"https://h.example/p{i}.html" for i in range(len(texts))], "html": pa.array(texts, pa.string())}), path / "pages.parquet")
    pq.write_table(pa.table({"doc_id": ids, "text": pa.array(texts, pa.string())}), path / "documents.parquet")
    return path


@pytest.mark.parametrize("name", ["q03_chunk_pack", "q04_garbage", "q41_html_text", "q49_web_chunks"])
def test_odd_texts(spark, folder, name):
    if name == "q04_garbage":  # the SQL has no value for a missing text
        spark.read.parquet(f"{folder}/documents.parquet").filter("text is not null").write.mode("overwrite").parquet(f"{folder}/given/documents.parquet")
        folder = folder / "given"
    con = duckdb.connect()
    for table in ("pages", "documents"):
        at = folder / f"{table}.parquet"
        if at.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/*.parquet'" if at.is_dir() else f"CREATE VIEW {table} AS SELECT * FROM '{at}'")
    want = Counter(con.execute(entry.oracle_sql()[name]).fetchall())
    got = Counter(tuple(r) for r in entry.queries()[name](spark, str(folder)).collect())
    assert sum(want.values()) > 400 and got == want
