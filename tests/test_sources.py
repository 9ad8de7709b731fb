"""Readers and writers: round trips on small files."""

import json

import pytest
from pyspark.sql import functions as F

from attesta.config import DEFAULT, Settings
from attesta.operators import index as I
from attesta.operators import segment
from attesta.plans import analyse as A
from attesta.sources import records, office, readers, sinks
from attesta.streaming import hygiene


def test_text(spark, tmp_path):
    p = tmp_path / "My Notes.txt"
    p.write_bytes("Rents rose in the north. They fell in the south.\fNext page has more words here.".encode() + b"\xff")
    got = readers.load_sources(spark, [str(p)])
    spans = got.spans.orderBy("span_seq").collect()
    assert [(r["span_id"], r["page_number"], r["text"]) for r in spans] == [
        ("mynotes_c0001_s01", 1, "Rents rose in the north."), ("mynotes_c0001_s02", 1, "They fell in the south."), ("mynotes_c0002_s01", 2, "Next page has more words here."),
    ]


@pytest.mark.parametrize(("name", "sep"), [("t.csv", ","), ("t.tsv", "\t")])
def test_table(spark, tmp_path, name, sep):
    p = tmp_path / name
    p.write_text(f"id{sep}quote\n1{sep}It was hard\n2{sep}\n{sep}\n")
    got = readers.load_sources(spark, [str(p)])
    assert [(r["chunk_id"], r["text"]) for r in got.chunks.orderBy("chunk_no").collect()] == [("t_r0001", "id: 1 | quote: It was hard"), ("t_r0002", "id: 2")]
    assert [(r["span_id"], r["text"]) for r in got.spans.orderBy("span_seq").collect()] == [("t_r0001_s01", "id: 1"), ("t_r0001_s02", "quote: It was hard"), ("t_r0002_s01", "id: 2")]


def test_table_rows_are_numbered_over_partitions(spark, tmp_path):
    """A folder of several parts, cells that span lines, and an empty table."""
    folder = tmp_path / "many.csv"
    spark.range(1000).select("id", F.lit("two\nlines").alias("quote")).repartition(5).write.csv(str(folder), header=True)
    rows = readers.load_sources(spark, [str(folder)]).chunks.collect()
    assert sorted(r["chunk_no"] for r in rows) == list(range(1, 1001))
    assert {r["text"] for r in rows} == {f"id: {i} | quote: two\nlines" for i in range(1000)}
    parts = readers.row_numbers(spark.range(0, 1000, 1, 7))
    assert all(r["id"] + 1 == r["_row_number"] for r in parts.collect())
    (tmp_path / "none.csv").write_text("id,quote\n")
    assert readers.load_sources(spark, [str(tmp_path / "none.csv")]).chunks.count() == 0


def test_office(spark, tmp_path):
    x, d = tmp_path / "a.xlsx", tmp_path / "b.docx"
    x.write_bytes(office.write_xlsx("S", [["id", "quote"], [1, "It was & is"], [None, "x"]]))
    d.write_bytes(office.write_docx([("", f"Paragraph number {i} was written.") for i in range(14)]))
    assert office.xlsx_rows(x.read_bytes()) == [["id", "quote"], ["1", "It was & is"], [None, "x"]]
    got = readers.load_sources(spark, [str(x), str(d)])
    assert got.names == ["a.xlsx", "b.docx"]
    pages = {r["page_number"] for r in got.chunks.filter("source_document = 'b.docx'").collect()}
    assert pages == {1, 2}
    assert got.spans.filter("source_document = 'a.xlsx'").count() == 3


def test_dispatch():
    with pytest.raises(ValueError, match="Unsupported"):
        readers.reader_of("a.zip")
    off = Settings(flags=DEFAULT.flags | {"input_docx": False})
    with pytest.raises(ValueError, match="disabled"):
        readers.reader_of("a.docx", off)
    assert readers.reader_of("https://x/y.pdf") is readers._read_url


def test_pipeline_and_exports(spark, tmp_path):
    p, q = tmp_path / "a.txt", tmp_path / "a.md"
    p.write_text("Rent arrears rose by 5 percent in the last year. Energy bills increased in every region of the country.")
    q.write_text("Rent arrears increased again in London this year.")
    summary, findings = A.run_pipeline(spark, [str(p), str(q)], ["Rent Arrears", "Purple Elephants"])
    findings = findings.persist()
    s = summary.first()
    assert (s["document_count"], s["chunk_count"], s["themes_analysed"], s["discovered_themes"]) == (2, 2, 2, [])
    status = {r["theme"]: r["status"] for r in findings.collect()}
    assert status == {"Rent Arrears": "VERIFIED", "Purple Elephants": "INSUFFICIENT EVIDENCE"}
    doc = json.loads(sinks.to_json(summary, findings))
    assert [f["theme"] for f in doc["findings"]] == ["Rent Arrears", "Purple Elephants"]
    rows = office.xlsx_rows(sinks.to_xlsx(findings))
    assert rows[0] == sinks.COLUMNS and len(rows) == 4 and rows[-1][0] == "Purple Elephants"
    text = office.docx_paragraphs(sinks.to_docx(findings, s["source_document"]))
    assert text[0] == "Findings Report" and any(t.startswith("[PASS] 1 ·") for t in text)
    good, bad = A.partition_by_status(findings)
    assert (good.count(), bad.count()) == (1, 1)
    named, _ = A.run_pipeline(spark, str(p), namer=lambda phrases, texts: ["Housing Costs"])
    assert named.first()["discovered_themes"] == ["Housing Costs"]
    assert A.status_styles(spark).count() == 6


def test_index_files(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("Rent arrears rose by 5 percent. Bills fell too.")
    got = readers.load_sources(spark, [str(p)])
    doc = {"source_document": "a.txt", "chunks": [{"chunk_id": "a_c0001", "page_number": 1, "source_document": "a.txt", "text": "t", "spans": [{"span_id": "s1", "text": "Rent rose."}]}]}
    (tmp_path / "i.json").write_text(json.dumps(doc))
    assert readers.load_index(spark, str(tmp_path / "i.json")).first()["span_id"] == "s1"
    readers.save_index(got.chunks, got.spans, str(tmp_path / "out"))
    assert len(spark.read.json(str(tmp_path / "out")).first()["spans"]) == 2
    index = I.build_index(segment.with_hygiene(got.spans))
    index.save(str(tmp_path / "ix"))
    themes = A.theme_table(spark, ["Rent Arrears"])
    assert I.retrieve(I.Index.load(spark, str(tmp_path / "ix")), themes).count() == 1
    assert I.span_by_id(index, spark.createDataFrame([("a_c0001_s01",), ("zz",)], "span_id string")).count() == 1


def test_streaming(spark, tmp_path):
    rows = [(i, f"Rent arrears rose by {i} percent in the year.", "a.txt", f"s{i}", "c", 1) for i in range(4)]
    schema = "span_seq long, text string, source_document string, span_id string, chunk_id string, page_number int"
    batch = spark.createDataFrame(rows, schema)
    batch.write.parquet(str(tmp_path / "in"))
    I.build_index(batch).terms.write.parquet(str(tmp_path / "terms"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = hygiene.clean_stream(stream).writeStream.format("memory").queryName("clean").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("clean").filter("eligible").count() == 4
    q = hygiene.find_in_stream(stream, str(tmp_path / "terms"), [(0, "Rent Arrears")], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_metadata_free_evidence(spark, tmp_path):
    """No eligible span keeps a reference; evidence is a subset of candidates."""
    p = tmp_path / "d.txt"
    p.write_text("\n\n".join(f"Rents rose by {i} percent in the north, Figure {i}.1 and Annex Table {i}. Notes on page {i} were lost." for i in range(5)))
    rows = segment.with_hygiene(readers.load_sources(spark, [str(p)]).spans)
    from pyspark.sql import functions as F

    from attesta.functions import text as T

    assert rows.filter("eligible").filter(T.has_reference(F.col("clean_text"))).count() == 0
    assert rows.filter("eligible").count() == 5


def test_numbered(spark):
    """Row numbers of groups that reach over several parts."""
    rows = [(i % 3 if i % 7 else None, i * 37 % 1000, f"t{i}") for i in range(900)]
    out = segment.numbered(spark.createDataFrame(rows, "g int, o int, t string"), "g", ["o", "t"]).collect()
    assert len(out) == 900
    for g in (0, 1, 2, None):
        own = sorted((r["o"], r["t"]) for r in out if r["g"] == g)
        assert [(r["o"], r["t"]) for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["place"])] == own
        assert sorted(r["place"] for r in out if r["g"] == g) == list(range(len(own)))


def test_span_places_do_not_overflow(spark):
    """Spans of a table of over 2 ** 20 rows keep places of their own, in order, also beside another source."""
    big = spark.range(1, 2**20 + 3).select(F.lit(1).cast("long").alias("source_ord"), F.lit("a.csv").alias("source_document"), F.lit("a").alias("doc_tag"), F.col("id").alias("row_number"), F.lit("x").alias("v"))
    other = big.limit(1).withColumns({"source_ord": F.lit(2).cast("long"), "row_number": F.lit(0).cast("long")})
    spans = segment.tabular(big.unionByName(other), ["v"])[1]
    assert spans.agg(F.count_distinct("span_seq")).first()[0] == 2**20 + 3
    assert spans.agg(F.max("span_seq").alias("m")).first()["m"]["source_ord"] == 2


def test_checkpoint_folder_on_a_cluster():
    """Without a shared folder a cluster is refused; local Spark gets a temporary one."""
    from types import SimpleNamespace as N

    from attesta import tables

    made = {}
    fake = N(conf=N(get=lambda k, d=None: made.get(k, d), set=made.__setitem__), sparkContext=N(master="spark://h:1", getConf=lambda: N(get=lambda k: None)))
    with pytest.raises(RuntimeError):
        tables.shared_dir(fake)
    fake.sparkContext.master = "local[2]"
    assert tables.shared_dir(fake) == made["spark.checkpoint.dir"]


def _table_rows(df, columns, start):
    """Rows by number, as one tuple each."""
    return sorted((r["_row_number"] - start, *(r[c] for c in columns)) for r in df.collect())


@pytest.mark.parametrize(("ending", "sep"), [("\n", ","), ("\r\n", "\t")])
def test_csv_by_ranges(spark, tmp_path, ending, sep):
    """Random quoting, with line breaks, separators and quotes in cells, over ranges of some dozens of bytes: as one task reads it."""
    import random

    rng = random.Random(7)
    parts = ["a", "bc", "1.5", " ", "é", "\n", ",", '"', "\t", "x y", "\r\n", ""]
    lines = [["k", "one", 'two "2"', "three"]]
    for i in range(400):
        lines.append([str(i), *("".join(rng.choices(parts, k=rng.randint(0, 5))) for _ in range(3))])
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if rng.random() < 0.2 or any(x in c for x in '\r\n,\t"') else c
    path = tmp_path / ("t.tsv" if sep == "\t" else "t.csv")
    path.write_bytes("".join(sep.join(map(quoted, r)) + ending * rng.choice([1, 1, 1, 2]) for r in lines).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = spark.read.csv(str(path), header=True, sep=sep, multiLine=True, quote='"', escape='"')
    expected = _table_rows(readers.row_numbers(want), want.columns, 1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert records.csv_records(spark, str(path), sep) is not None
        columns, rows = readers.read_csv(spark, str(path), sep)
        got = _table_rows(rows, columns, 1)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert columns == want.columns and len(got) == 400
    assert got == expected


@pytest.mark.parametrize("text", ['a,b\n1,x"y\n2,z"\n', 'a,b\n"1,2\n', 'a,b\n1,"x"y\n', "a,b\n", "a,b", '"a\nb",c\n"1\n",2'])
def test_csv_with_odd_quotes(spark, tmp_path, text):
    """Quotes that aren't around whole cells: one task reads the file; a header alone has no rows."""
    path = tmp_path / "t.csv"
    path.write_text(text)
    want = spark.read.csv(str(path), header=True, multiLine=True, quote='"', escape='"')
    columns, rows = readers.read_csv(spark, str(path), ",")
    assert columns == want.columns
    assert _table_rows(rows, columns, 1) == _table_rows(readers.row_numbers(want), columns, 1)
