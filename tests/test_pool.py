"""Many sources at once: one scan, failures as rows, pages fetched with retries and a rate per host."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from attesta.config import Settings
from attesta.sources import fetch, office, readers


def _nodes(df):
    return len(df._jdf.queryExecution().optimizedPlan().treeString().splitlines())


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def _mixed(folder, n):
    """n small files of six kinds, some of the same tag."""
    out = []
    for i in range(n):
        p = folder / (f"note {i % 7}+{i:05d}." + ("txt", "md", "csv", "tsv", "docx", "xlsx")[i % 6])
        if p.suffix in (".csv", ".tsv"):
            sep = "," if p.suffix == ".csv" else "\t"
            head = ["id", "quote"] if i % 4 else ["", "a", "A"]
            p.write_text("\n".join(sep.join(r) for r in (head, [str(i), f'"two\nlines{sep} {i}"'], ["", "x"], ["only"], ["p", "q", "r", "s"])) + "\n" * (i % 3))
        elif p.suffix == ".docx":
            p.write_bytes(office.write_docx([("", f"Paragraph {i} was written in the year {j}.") for j in range(14)]))
        elif p.suffix == ".xlsx":
            p.write_bytes(office.write_xlsx("S", [["id", None, "quote"], [i, "u"], [], [None, None, "x"]]))
        else:
            p.write_text(f"Rents rose by {i} percent in the north. They fell in the south.\n\nBills increased in every region {i} times.")
        out.append(str(p))
    return out


def test_pool_is_each_source_alone(spark, tmp_path):
    """Texts, pages and numbers of mixed files are those of one-by-one loading; a source given twice is there twice."""
    sources = _mixed(tmp_path, 12)
    sources.append(sources[2])
    got = readers.load_sources(spark, sources)
    assert got.failures.count() == 0
    ids = [r["doc_tag"] for r in got.chunks.select("source_ord", "doc_tag").distinct().orderBy("source_ord").collect()]
    assert ids == ["note0000", "note1000", "note2000", "note3000", "note4000", "note5000", "note6000", "note00002", "note10002", "note20002", "note30002", "note40002", "note20003"]
    cols = ("page_number", "chunk_no", "span_no", "text")
    for i in (0, 2, 3, 4, 5, 8):
        alone = readers.load_sources(spark, [sources[i]])
        assert _rows(got.spans.filter(f"source_ord = {i}"), *cols) == _rows(alone.spans, *cols) != []
    assert _rows(got.spans.filter("source_ord = 12"), *cols) == _rows(got.spans.filter("source_ord = 2"), *cols)


def test_tables_as_the_one_task_reader_has_them(spark, tmp_path):
    """Headers with empty and repeated names, short and long rows, cells that span lines."""
    sources = [s for s in _mixed(tmp_path, 24) if s.endswith((".csv", ".tsv"))]
    got = readers.load_sources(spark, sources).spans.collect()
    for i, s in enumerate(sources):
        df = spark.read.csv(s, header=True, multiLine=True, quote='"', escape='"', sep=readers._sep(s))
        want = [(n, k, f"{c}: {r[c]}".strip()) for n, r in enumerate(df.collect(), 1) for k, c in enumerate(df.columns, 1) if r[c] is not None]
        assert sorted((r["chunk_no"], r["span_no"], r["text"]) for r in got if r["source_ord"] == i) == sorted(want)


def test_plan_does_not_grow_with_sources(spark, tmp_path):
    """10,000 files: as many plan nodes as for a dozen, all tags unique, files packed into few tasks."""
    few = tmp_path / "few"
    few.mkdir()
    small = readers.load_sources(spark, _mixed(few, 12))
    names = [tmp_path / f"n{i:05d}.txt" for i in range(9988)]
    for i, p in enumerate(names):
        p.write_text(f"Rents rose by {i} percent in the north.")
    got = readers.load_sources(spark, [*_mixed(tmp_path, 12), *map(str, names)])
    assert _nodes(got.chunks) == _nodes(small.chunks) and _nodes(got.spans) == _nodes(small.spans)
    tags = got.chunks.select("source_ord", "doc_tag").distinct().collect()
    assert len(tags) == len({r["doc_tag"] for r in tags}) == 10_000


def test_failures(spark, tmp_path):
    """Broken files are rows; strict loading raises, naming them. A folder is one source; a missing file an error at once."""
    broken, good, folder, odd = tmp_path / "b.docx", tmp_path / "g.txt", tmp_path / "many.txt", tmp_path / "o.csv"
    broken.write_bytes(b"no zip")
    good.write_text("Rents rose in the north.")
    odd.write_text('a,b\n1,x"y\n2,z"\n')
    folder.mkdir()
    (folder / "one.txt").write_text("Bills rose in the east.")
    (folder / "two.txt").write_text("Bills rose in the west.")
    sources = [str(p) for p in (good, broken, folder, odd)]
    with pytest.raises(ValueError, match=r"b\.docx"):
        readers.load_sources(spark, sources)
    got = readers.load_sources(spark, sources, strict=False)
    assert [(r["source_ord"], r["source_document"]) for r in got.failures.collect()] == [(1, "b.docx")]
    assert _rows(got.spans.filter("source_ord <> 3"), "source_ord", "text") == [(0, "Rents rose in the north."), (2, "Bills rose in the east."), (2, "Bills rose in the west.")]
    assert got.spans.filter("source_ord = 3").count() > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.load_sources(spark, [str(tmp_path / "none.txt")])


@pytest.fixture
def site():
    """A server that knows pages, one that fails twice first, and one that isn't there; and the times of its requests."""
    seen: list[tuple[str, float]] = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, time.monotonic()))
            tries = sum(p == self.path for p, _ in seen)
            code = 404 if self.path == "/none" else 503 if self.path == "/busy" and tries < 3 else 500 if self.path == "/down" else 200
            body = f"<html><script>no()</script><p>Page {self.path} café rose.</p></html>".encode("latin-1")
            self.send_response(code)
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()
    server.server_close()


def test_fetch(spark, site):
    base, seen = site
    cfg = Settings(fetch_pause=0.01, fetch_per_second=20, fetch_timeout=5)
    urls = [f"{base}/a", f"{base}/busy", f"{base}/none", f"{base}/down", "http://127.0.0.1:9/x", "not a url", None]
    rows = {r["source_ord"]: r for r in fetch.fetched(spark.createDataFrame(list(enumerate(urls)), "source_ord long, url string"), cfg).collect()}
    assert len(rows) == 7 and "Page /a café" in rows[0]["html"] and rows[0]["error"] is None and "/busy" in rows[1]["html"]
    assert (rows[2]["error"], rows[3]["error"], rows[6]["error"]) == ("HTTP 404", "HTTP 500", "no URL")
    assert all(rows[i]["html"] is None and rows[i]["error"] for i in range(2, 7))
    paths = [p for p, _ in seen]
    assert (paths.count("/busy"), paths.count("/none"), paths.count("/down")) == (3, 1, 3)


def test_rate_of_a_host(spark, site):
    """The requests to a host are apart, whatever the number of partitions they come from."""
    base, seen = site
    urls = spark.range(0, 12, 1, 6).selectExpr("id AS source_ord", f"concat('{base}/p', id) AS url")
    assert fetch.fetched(urls, Settings(fetch_per_second=20)).filter("error IS NULL").count() == 12
    times = sorted(t for _, t in seen)
    assert min(b - a for a, b in zip(times, times[1:], strict=False)) > 0.04


def test_pages_in_the_pool(spark, tmp_path, site):
    base, _ = site
    p = tmp_path / "a.txt"
    p.write_text("Rents rose in the north.")
    got = readers.load_sources(spark, [str(p), f"{base}/one", f"{base}/none"], Settings(fetch_pause=0.01), strict=False)
    assert _rows(got.spans, "source_ord", "text") == [(0, "Rents rose in the north."), (1, "Page /one café rose.")]
    assert [r["error"] for r in got.failures.collect()] == ["HTTP 404"]
    assert got.names == ["a.txt", f"{base}/one", f"{base}/none"]
