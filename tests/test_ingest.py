import io
import json
import threading
import urllib.request
import zipfile
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from folioquarry import __main__ as cli
from folioquarry import embed
from folioquarry.config import ChunkingConfig, Config, EmbeddingConfig, ServerConfig, Shelf, StoreConfig, WatcherConfig, by_name
from folioquarry.operators import metadata
from folioquarry.plans.api import Library
from folioquarry.plans.ingest import scan_all, scan_shelf, summary_text, sync_shelves
from folioquarry.plans.store import Store
from folioquarry.sources import office
from folioquarry.streaming import watch


def packed(files):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return buf.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = packed({
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading 1"/></w:pPr><w:r><w:t>Start</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t><w:tab/><w:t>one</w:t></w:r></w:p>'
    '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:br w:type="page"/></w:r></w:p><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>',
    "docProps/core.xml": '<c xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/"><dc:title>Doc title</dc:title><dcterms:created>2020-05-06T00:00:00Z</dcterms:created></c>',
})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
SHEET = f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Cost</t></is></c></row><row><c r="A2" t="str"><v>Pump</v></c><c r="B2"><v>12.0</v></c><c r="AF2"><v>9</v></c></row></sheetData></worksheet>'
XLSX = packed({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Costs" r:id="r1"/><sheet name="Gone" state="hidden" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>Item</t></si></sst>", "xl/worksheets/sheet1.xml": SHEET,
})
O = 'xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
ODS = packed({"content.xml": f'<x {O}><table:table table:name="T"><table:table-row><table:table-cell><text:p>Item</text:p></table:table-cell><table:table-cell><text:p>Cost</text:p></table:table-cell></table:table-row>'
              '<table:table-row><table:table-cell table:number-columns-repeated="2"><text:p>same</text:p></table:table-cell><table:table-cell table:number-columns-repeated="1000"/></table:table-row></table:table></x>'})
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PPTX = packed({
    "ppt/presentation.xml": f'<p:p {P}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:p>', "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/></Relationships>',
    "ppt/slides/slide1.xml": f'<p:sld {P}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Plan</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:txBody><a:p><a:r><a:t>Point</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>',
    "ppt/slides/_rels/slide1.xml.rels": '<Relationships><Relationship Id="n" Type="x/notesSlide" Target="../notesSlides/n1.xml"/></Relationships>',
    "ppt/notesSlides/n1.xml": f'<p:n {P}><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Say this</a:t></a:r></a:p></p:txBody></p:sp></p:n>',
})


def test_readers():
    assert office.READERS[".txt"]("a\fb\f---".encode()) == [(1, "a", None), (2, "b", None)]
    assert office.READERS[".txt"]("﻿a".encode("utf-8")) == [(1, "a", None)] and office.READERS[".txt"](b"\xe4") == [(1, "ä", None)]
    assert office.READERS[".markdown"] is office.READERS[".md"] and office.READERS[".md"](b"# T #\n```\nx\n```\nb") == [(1, "T\nb", None)]
    assert office.READERS[".docx"](DOCX) == [(1, "Start\n\nBody one\n\nA | B", "Start"), (2, "Second", "Start")]
    assert office.properties(".docx", DOCX) == ("Doc title", "2020-05-06")
    assert office.READERS[".xlsx"](XLSX) == [(1, "Item: Pump | Cost: 12", "Costs")]
    assert office.READERS[".ods"](ODS) == [(1, "Item: same | Cost: same", "T")]
    assert office.READERS[".pptx"](PPTX) == [(1, "Plan\n\nPoint\n\nSay this", "Plan")]
    with pytest.raises(RuntimeError, match="PyMuPDF"):
        office.READERS[".pdf"](b"")


def test_title_by_font():
    """A larger span takes the place of what was found, even if it is larger by a hair; those after it that are hardly smaller are added."""
    assert office.title_by_font([(10, "small text"), (20, "Big Title"), (19.8, "Second line"), (30, "tiny")]) == "Big Title Second line"
    assert office.title_by_font([(20, "Big Title"), (20.2, "Larger line"), (20, "and more"), (19.6, "not this")]) == "Larger line and more"
    assert office.title_by_font([]) is None and office.title_by_font([(9, "x" * 301)]) is None
    assert office.font_title(".txt", b"") is None and office.font_title(".pdf", b"broken") is None


def test_cells():
    assert [office.cell_text(x) for x in (None, 12.0, 12.5, -3.0, 1e16, " a ", True, float("inf"))] == ["", "12", "12.5", "-3", "10000000000000000", "a", "True", "inf"]
    for cells, want in ((["Item", "Cost"], True), (["Item", ""], False), (["Item", "12"], False), (["Item", "1 200"], False), (["Item", "12,5"], True), (["a", "b" * 61], False), ([], False)):
        assert office.looks_like_header(cells) is want


@pytest.fixture
def library(tmp_path):
    manuals, meetings = tmp_path / "manuals", tmp_path / "meet"
    (manuals / "Shelly 2PM").mkdir(parents=True)
    (meetings / "2024-05-02").mkdir(parents=True)
    (manuals / "Shelly 2PM" / "rev_3.txt").write_text("Keep the valve dry. " * 30)
    (manuals / "Shelly 2PM" / ".hidden.txt").write_text("no")
    (manuals / "Shelly 2PM" / "photo.jpg").write_text("no")
    (manuals / "Shelly 2PM" / "broken.docx").write_bytes(b"not a zip")
    (meetings / "2024-05-02" / "minutes.md").write_text("# Budget\n\n" + "The board decided on the roof. " * 20)
    return Config(embedding=EmbeddingConfig(backend="hash", dimensions=32), chunking=ChunkingConfig(), store=StoreConfig(str(tmp_path / "store"), buckets=3), watcher=WatcherConfig(network_metadata=False), shelves=by_name((
        Shelf("manuals", "manuals", str(manuals)), Shelf("meet", "meetings", str(meetings), "Meetings"), Shelf("lost", "scientific", str(tmp_path / "none")))))


def test_ingest_and_tools(spark, library, tmp_path):
    store = Store(spark, library.store.path, library.store.buckets)
    sync_shelves(store, library)
    assert scan_all(spark, store, library) == {"indexed": 2, "skipped": 0, "deleted": 0, "failed": 1}
    again = scan_all(spark, store, library)
    assert again == {"indexed": 0, "skipped": 2, "deleted": 0, "failed": 1}
    first = {r["rel_path"]: r for r in store.read("documents").collect()}
    assert set(first) == {"manuals/Shelly 2PM/rev_3.txt", "meet/2024-05-02/minutes.md"}
    (tmp_path / "manuals" / "Shelly 2PM" / "rev_3.txt").write_text("Open the lid slowly. " * 30)
    assert scan_shelf(spark, store, library.shelves["manuals"], library)["indexed"] == 1
    (tmp_path / "meet" / "2024-05-02" / "minutes.md").unlink()
    (tmp_path / "meet" / "2024-05-02" / "new.txt").write_text("Fresh paint for the yard gate. " * 20)
    assert scan_shelf(spark, store, library.shelves["meet"], library) == {"indexed": 1, "skipped": 0, "deleted": 1, "failed": 0}
    docs = {r["rel_path"]: r for r in store.read("documents").collect()}
    changed = docs["manuals/Shelly 2PM/rev_3.txt"]
    assert changed["id"] == first["manuals/Shelly 2PM/rev_3.txt"]["id"] and changed["title"] == "Shelly 2PM" and changed["extra"] == {"kind": "text", "revision": "rev_3"}
    chunks = store.read("chunks").collect()
    assert {c["document_id"] for c in chunks} == {d["id"] for d in docs.values()} and all(len(c["embedding"]) == 32 for c in chunks)
    lib = Library(spark, library, store.read("shelves"), store.read("documents").withColumnRenamed("id", "doc_id"), store.read("chunks"), str(tmp_path / "feed"))
    hits = lib.search_manuals("lid", device="shelly")
    assert hits["count"] >= 1 and "Open the lid" in hits["results"][0]["text"] and hits["results"][0]["citation"]["filename"] == "rev_3.txt"
    assert lib.search_meetings("paint", date_from="2024-01-01")["count"] >= 1 and lib.search_meetings("paint", date_from="2025-01-01")["count"] == 0
    assert set(hits["results"][0]) == {"chunk_id", "text", "score", "citation"} and hits["results"][0]["citation"]["document_id"] == changed["id"]
    assert {s["name"]: s["documents"] for s in lib.list_shelves()["shelves"]} == {"manuals": 1, "meet": 1, "lost": 0}
    listed = lib.list_documents(shelf="meet", dates=["2024-05-02", "2024-05-03"])
    one = listed["documents"][0]
    assert listed["count"] == 1 and set(one) == {"document_id", "shelf", "title", "folder", "date", "pages"} and one["date"] == "2024-05-02"
    assert lib.list_documents(dates=["2024-05-03"]) == {"count": 0, "documents": []}
    info = lib.get_document_info(one["document_id"])
    assert info["filename"] == "new.txt" and info["folder"] == "2024-05-02" and info["indexed_at"] and set(info) == {"document_id", "shelf", "title", "authors", "date", "year", "filename", "folder", "pages", "summary", "indexed_at"}
    assert lib.search_meetings("paint", document_ids=[one["document_id"]])["count"] >= 1 and lib.search_meetings("paint", document_ids=[7])["count"] == 0
    assert lib.search_papers("paint", document_ids=[one["document_id"]])["count"] == 0  # another shelf
    assert "error" in lib.get_document_info(1) and "error" in lib.read_document(1)
    read = lib.read_document(one["document_id"])
    assert read["text"].startswith("Fresh paint") and read["truncated"] is False and "note" not in read
    found = lib.find_documents("lid")
    assert found["count"] == 2 and set(found["documents"][0]) == {"document_id", "shelf", "title", "authors", "year", "date", "summary", "score"}
    assert set(lib.get_context(chunks[0]["id"])["passages"][0]) == {"chunk_id", "text", "section", "pages"}
    assert lib.reindex("nope") == {"error": "Unknown shelf 'nope'", "available": ["manuals", "meet", "lost"]} and lib.reindex() == {"status": "requested", "shelf": "all"}


def test_long_documents_carry_a_note(spark, library):
    docs = spark.createDataFrame([(5, "meet", "d/x", "x", "d", "T", None, None, None, "s", None, None, 9, None)], "doc_id long, shelf string, rel_path string, filename string, source_dir string, title string, authors array<string>, doc_date date, year int, summary string, summary_embedding array<float>, content_hash string, page_count int, indexed_at timestamp")
    chunks = spark.createDataFrame([(i, 5, i, "y" * 12000) for i in range(4)], "id long, document_id long, chunk_index int, content string")
    out = Library(spark, library, docs, docs, chunks).read_document(5)
    assert out["truncated"] and out["chars_total"] == 48000 and "24002" in out["note"] and out["pages"] == 9


def test_store_writes_only_what_changed(spark, library, tmp_path):
    store = Store(spark, library.store.path, library.store.buckets)
    sync_shelves(store, library)
    for i in range(12):
        (tmp_path / "manuals" / "Shelly 2PM" / f"part {i}.txt").write_text(f"Part {i} of the valve. " * 30)
    assert scan_shelf(spark, store, library.shelves["manuals"], library)["indexed"] == 13
    before = store._pointer()
    assert scan_shelf(spark, store, library.shelves["manuals"], library)["skipped"] == 13 and store._pointer() == before
    (tmp_path / "manuals" / "Shelly 2PM" / "part 3.txt").write_text("Another valve. " * 40)
    assert scan_shelf(spark, store, library.shelves["manuals"], library)["indexed"] == 1
    after = store._pointer()
    moved = {k for k in before["chunks"] if before["chunks"][k] != after["chunks"][k]}
    assert len(before["chunks"]) == 3 and len(moved) == 1 and {k for k in before["documents"] if before["documents"][k] != after["documents"][k]} == moved
    docs, chunks = store.read("documents"), store.read("chunks")
    assert docs.count() == 13 and {r[0] for r in chunks.select("document_id").distinct().collect()} == {r[0] for r in docs.select("id").collect()}
    assert chunks.where(F.col("content").startswith("Another")).count() == 1
    assert store.vacuum(3600) == 0 and store.vacuum(-60) == 0  # every folder still holds a current part
    scan_shelf(spark, store, library.shelves["manuals"], library, force=True)
    assert store.vacuum(-60) == 4 and store.read("documents").count() == 13 and store.read("documents", "meet").count() == 0
    with pytest.raises(RuntimeError, match="another writer"):
        store._flip(0, {})


def test_vectors_of_documents_carry_the_document_prefix(spark):
    df = spark.createDataFrame([("T", "S"), (None, "S"), ("T", None), ("T", "")], "title string, summary string")
    got = [r[0] for r in df.select(summary_text(F.col("title"), F.col("summary"), "multilingual-e5")).collect()]
    assert got == ["passage: T\nS", "passage: \nS", None, None]


def test_ingest_embeds_with_the_prefix(spark, library, tmp_path):
    config = replace(library, embedding=replace(library.embedding, model="nomic-embed-text"))
    store = Store(spark, str(tmp_path / "other"), 1)
    sync_shelves(store, config)
    scan_shelf(spark, store, config.shelves["meet"], config)
    c, d = store.read("chunks").first(), store.read("documents").first()
    client = embed.HashBackend(config.embedding)
    want = embed.embed_texts([f"search_document: {c['content']}", f"search_document: {d['title']}\n{d['summary']}"], client, config.embedding)
    assert c["embedding"] == pytest.approx(want[0], abs=1e-6) and d["summary_embedding"] == pytest.approx(want[1], abs=1e-6)


@pytest.fixture
def web():
    """A server that answers what ``replies`` says: path to (status, body) or a function of the request's JSON."""
    replies, asked = {}, []

    class Handler(BaseHTTPRequestHandler):
        def go(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            asked.append((self.path, json.loads(body) if body else None))
            answer = next((v for k, v in replies.items() if self.path.startswith(k)), (404, b""))
            code, data = answer(json.loads(body)) if callable(answer) else answer
            self.send_response(code)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = go

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_address[1]}", replies, asked
    http.shutdown()


def test_server_reasons():
    cases = [(b"", "(empty response body)"), (b"plain", "plain"), (b'{"error": {"message": "too long"}}', "too long"), (b'{"error": "no"}', "no"), (b'{"detail": [1]}', "[1]"), (b'{"message": "m", "detail": "d"}', "m"), (b"[1]", "[1]"), (b'{"error": {"code": 7}}', "{'code': 7}"), (b'{"x": 1}', '{"x": 1}')]
    assert [embed.reason(b) for b, _ in cases] == [w for _, w in cases]


def test_preflight(web):
    url, replies, asked = web
    vectors = lambda n: lambda body: (200, json.dumps({"data": [{"index": i, "embedding": [0.5] * n} for i in reversed(range(len(body["input"])))]}).encode())
    config = EmbeddingConfig(base_url=url, model="bge", dimensions=3)
    replies["/v1/embeddings"] = vectors(3)
    models = lambda *ids: (200, json.dumps({"data": [{"id": i} for i in ids]}).encode())
    for served, name, sent in ((models("a", "bge"), "bge", "bge"), (models("other"), "other", "other"), (models(), "", None), ((500, b'{"error": "x"}'), None, "bge"), ((200, b"[]"), None, "bge")):
        replies["/v1/models"] = served
        ready = embed.preflight(config)
        assert ready.served_name == name and ready.model == "bge" and asked[-1][1].get("model") == sent
    replies["/v1/models"] = models("a", "b")
    with pytest.raises(RuntimeError, match="it serves a, b"):
        embed.preflight(config)
    replies["/v1/models"], replies["/v1/embeddings"] = models("bge"), vectors(4)
    with pytest.raises(ValueError, match="expected vectors of 3"):
        embed.preflight(config)
    replies["/v1/embeddings"] = (413, b'{"error": {"message": "input is too large"}}')
    with pytest.raises(RuntimeError, match="413 input is too large"):
        embed.preflight(config)
    replies["/api/embed"] = (200, json.dumps({"embeddings": [[1, 2, 3]]}).encode())
    assert embed.preflight(replace(config, backend="ollama")).served_name is None


def test_papers_are_looked_up(spark, web):
    url, replies, asked = web
    replies["/works/10.1234/abc"] = (200, b'{"message":{"title":["Found"],"author":[{"given":"Ann","family":"Bee"}],"issued":{"date-parts":[[2020,3]]}}}')
    replies["/query?id_list=2503.01234v2"] = (200, b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Arx</title><summary>s</summary><published>2025-03-02T00:00:00Z</published><author><name>Cee</name></author></entry></feed>')
    files = spark.createDataFrame([("x/10.1234_abc.pdf", ["t"], None), ("y/10.1234_abc.pdf", ["t"], None), ("x/2503.01234v2.pdf", ["t"], None), ("x/10.9999_none.pdf", ["t"], None), ("x/own_paper.pdf", ["t"], None)], "rel_path string, pages array<string>, font_title string")
    found = metadata.lookups(files, url + "/works/{}", url + "/query?id_list={}")
    got = {r["rel_path"]: r for r in metadata.paper(files, **found).collect()}
    assert [got[p]["title"] for p in ("x/10.1234_abc.pdf", "y/10.1234_abc.pdf", "x/2503.01234v2.pdf")] == ["Found", "Found", "Arx"]
    assert got["x/10.9999_none.pdf"]["extra"] == {"metadata_source": "extracted"} and got["x/own_paper.pdf"]["title"] == "Own Paper"
    assert str(got["x/10.1234_abc.pdf"]["doc_date"]) == "2020-03-01" and got["x/2503.01234v2.pdf"]["authors"] == ["Cee"]


def test_tool_server(spark, library):
    class Tools:
        def list_shelves(self):
            return {"shelves": ["ä"]}

        def get_context(self, chunk_id):
            return {"passages": [chunk_id]}

    http = cli.make_server(replace(library, server=ServerConfig("127.0.0.1", 0)), Tools)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_address[1]}"

    def post(name, body):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{url}/tools/{name}", json.dumps(body).encode())) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert post("list_shelves", {}) == (200, {"shelves": ["ä"]}) and post("get_context", {"chunk_id": 4}) == (200, {"passages": [4]})
    assert post("get_context", {"nope": 4})[0] == 400 and post("__init__", {})[0] == 404 and post("reindex", {})[0] == 500
    assert "search_papers" in json.load(urllib.request.urlopen(url))["tools"]
    http.shutdown()


def test_watch_once(spark, library):
    cli.run_watcher(spark, library, once=True, force=False)
    lib = cli.open_library(spark, Store(spark, library.store.path, library.store.buckets), library)
    assert lib.list_documents()["count"] == 2


def test_watcher(spark, library, tmp_path):
    feed, seen = str(tmp_path / "feed"), []

    def scan(name, force):
        seen.append((name, force))
        if name == "manuals":
            raise OSError("disk on fire")
        return {}

    def run():
        seen.clear()
        watch.watch(spark, feed, library, scan, str(tmp_path / "ck"), once=True).awaitTermination()
        return seen

    watch.request(spark, feed, "meet", force=True)
    watch.request(spark, feed, "meet")
    watch.request(spark, feed, "unknown")
    assert run() == [("meet", True)]
    watch.request(spark, feed)
    assert run() == [("manuals", False), ("meet", False), ("lost", False)]
    assert run() == []
