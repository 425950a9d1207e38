import io
import struct
import zipfile

import pytest

from cairnbase import models
from cairnbase.operators import ledger
from cairnbase.sources import docx, files, wiki
from cairnbase.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def make_docx(paragraphs, rows):
    p = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    t = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{p}{t}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_docx(spark):
    data = make_docx([("Title", "Doc"), ("H1", "Part"), (None, "Some body text, long.")], [["a", "b"], ["c", "d"]])
    blocks = docx.read_blocks(spark.createDataFrame([("h", data)], "content_hash string, content binary"))
    assert [(r["ord"], r["level"], r["title"]) for r in docx.chapters(blocks).orderBy("ord").collect()] == [(1, 1, "Doc"), (2, 1, "Part")]
    assert docx.tables(blocks).head()["table_md"] == "| a | b |\n|---|---|\n| c | d |"


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h)


def exif_jpeg():
    taken = b"2024:05:06 07:08:09\0"
    tiff = b"II*\0" + struct.pack("<I", 8)
    gps_at = 8 + 2 + 12 * 2 + 4 + 20
    ifd = struct.pack("<H", 2) + struct.pack("<HHII", 0x0132, 2, 20, 8 + 2 + 24 + 4) + struct.pack("<HHII", 0x8825, 4, 1, gps_at) + struct.pack("<I", 0)
    body = gps_at + 2 + 12 * 4 + 4
    gps = struct.pack("<H", 4) + struct.pack("<HHI4s", 1, 2, 2, b"S\0\0\0") + struct.pack("<HHII", 2, 5, 3, body) + struct.pack("<HHI4s", 3, 2, 2, b"E\0\0\0") + struct.pack("<HHII", 4, 5, 3, body + 24) + struct.pack("<I", 0)
    fractions = struct.pack("<6I", 10, 1, 30, 1, 0, 1) + struct.pack("<6I", 20, 1, 0, 1, 36, 1)
    block = b"Exif\0\0" + tiff + ifd + taken + gps + fractions
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 48, 64) + b"\xff\xd9"


def test_images(spark):
    assert files.image_size(png(64, 48)) == (64, 48) and files.image_size(exif_jpeg()) == (64, 48) and files.image_size(b"x") is None
    df = spark.createDataFrame([(1, exif_jpeg()), (2, png(1, 1))], "file_id long, content binary")
    rows = {r["file_id"]: r for r in files.with_exif(df).collect()}
    assert str(rows[1]["exif_datetime"]) == "2024-05-06 07:08:09" and rows[1]["gps_lat"] == pytest.approx(-10.5) and rows[1]["gps_lon"] == pytest.approx(20.01)
    assert rows[2]["exif_datetime"] is None and rows[2]["gps_lat"] is None
    places = spark.createDataFrame([(-10.4, 20.0, "AO", "near"), (50.0, 8.0, "DE", "far")], "lat double, lon double, country string, place string")
    placed = {r["file_id"]: r["geo_place"] for r in files.nearest_place(files.with_exif(df), places).collect()}
    assert placed == {1: "near", 2: None}
    assert [tuple(r[0]) for r in df.select(files.image_dims("content")).collect()] == [(64, 48), (1, 1)]


def test_scan_folder(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / ".hidden").write_bytes(b"y")
    (tmp_path / "none").write_bytes(b"z")
    rows = files.scan_folder(spark, str(tmp_path)).collect()
    assert [(r["filename"], r["format"], r["mime"], r["byte_size"]) for r in rows] == [("a.PDF", "pdf", "application/pdf", 1), ("none", "", "application/octet-stream", 1)]


def test_links_and_headings(spark):
    page = spark.createDataFrame([(1, '<h1>One <b>x</b></h1><a href="/a">a</a><h3 class="k">Two</h3><a href="/b">b</a>')], "page_id long, html string")
    assert [r["href"] for r in files.html_links(page).collect()] == ["/a", "/b"]
    assert [(r["level"], r["title"]) for r in files.html_headings(page).collect()] == [(1, "One x"), (3, "Two")]


def test_linkify():
    refs = [("butter", "butter"), ("unsalted-butter", "unsalted butter"), ("lmp", "Link Manager (LMP)")]
    got = wiki.linkify("Use unsalted butter, then butter. [[lmp|Link Manager (LMP)] and [[butter]].", refs)
    assert got == "Use [[unsalted-butter|unsalted butter]], then [[butter|butter]]. [[lmp|Link Manager (LMP)]] and butter."


def test_markdown_is_escaped():
    got = wiki.render_markdown("# T <b>\n\n- one **two**\n- [[x|Y]]\n\n> meta\n---\ntext _(source: a)_")
    assert got == '<h1 class="wiki-title">T &lt;b&gt;</h1>\n<ul class="wiki-list">\n<li>one <strong>two</strong></li>\n<li><a class="wikilink" href="/wiki/page/x">Y</a></li>\n</ul>\n<p class="wiki-meta">meta</p>\n<hr>\n<p>text <em class="cite">(source: a)</em></p>'


def test_bold_within_italics():
    cases = {
        "*see **x** now*": "<em>see <strong>x</strong> now</em>", "***a***": "<em><strong>a</strong></em>", "**a*b**": "*<em>a</em>b**", "*a* **b** *c*": "<em>a</em> <strong>b</strong> <em>c</em>",
        "**": "**", "* **b**": "* <strong>b</strong>", "*open **b** still": "*open <strong>b</strong> still",
    }
    for text, want in cases.items():
        assert wiki.render_markdown(text) == f"<p>{want}</p>"


def test_wiki_files(spark, tmp_path):
    wiki.scaffold(str(tmp_path))
    hashes = wiki.write_pages(spark.createDataFrame([("entities/a.md", "# A\n")], "path string, content string"), str(tmp_path))
    assert len(hashes["entities/a.md"]) == 64
    wiki.append_log(str(tmp_path), "did it")
    assert {r["path"] for r in wiki.read_pages(spark, str(tmp_path)).collect()} == {"entities/a.md", "index.md", "log.md", "overview.md"}
    page = wiki.file_answer(None, "Q", "An answer.", [("a", "A"), ("a", "A")], ["x p.1", "x p.1"], "2026-01-01")
    assert page.count("[[a|A]]") == 1 and wiki.file_answer(page, "Q", "An answer.", [], [], "d") is None and "## Update d" in wiki.file_answer(page, "Q", "Other.", [], [], "d")


REPLIES = [
    ('```json\n{"entities": [{"name": "E0", "type": "Cipher", "claims": "one"}]}\n```', [("E0", "concept", ["one"])]),
    ('[{"name": "A", "type": "person", "claims": ["x"], "aliases": "b"}]', [("A", "person", ["x"])]),
    ('Here you go: {"entities": [{"name": "A", "claims": ["x"]}]} done', [("A", "concept", ["x"])]),
    ('{"entities": [{"name": "A", "claims": []}, {"claims": ["x"]}, 3]}', []),
    ("garbage", []),
]


@pytest.mark.parametrize(("reply", "want"), REPLIES)
def test_parse_entities(reply, want):
    assert [(e["name"], e["type"], e["claims"]) for e in models.parse_entities(reply)] == want


def test_verdicts():
    assert models.parse_verdict('```json\n{"save": true, "reason": " r "}\n```') == (True, "r")
    assert models.parse_verdict('{"save": "true"}') is None and models.parse_verdict("x") is None
    assert models.should_save("q", "short", 1, 0)[0] is False
    assert models.should_save("q", "long " * 60, 1, 2, lambda q, a: '{"save": true, "reason": "ok"}') == (True, "ok")
    assert models.same_subject("Same.") and not models.same_subject("not the same")


def test_embedding_and_extraction(spark):
    df = models.embed(spark.createDataFrame([(1, "a b"), (2, " ")], "id long, t string"), "t")
    rows = {r["id"]: r["vector"] for r in df.collect()}
    assert sum(x * x for x in rows[1]) == pytest.approx(1, abs=1e-5) and rows[2] is None
    reply = '{"entities": [{"name": "E0", "claims": ["c"]}]}'

    def model(passage):
        if passage == "bad":
            raise RuntimeError("no model")
        return reply

    got = models.extract_entities(spark.createDataFrame([(1, "good"), (2, "bad")], "window int, passage string"), model).collect()
    assert [(r["window"], r["name"], r["claims"]) for r in got] == [(1, "E0", ["c"])]


def test_ledger_resumes(spark):
    ran, done, log, fail = [], set(), [], {"b"}

    def stage(name, deps=(), params=None):
        def run(_):
            ran.append(name)
            if name in fail:
                raise RuntimeError(name)

        return ledger.Stage(name, run, params=params or {}, deps=deps)

    stages = [stage("b", ("a",)), stage("a")]
    record = lambda *x: log.append(x)
    assert [s for _, s, _ in ledger.run_stages("h", stages, done, record)] == ["done", "error"]
    fail.clear()
    assert [s for _, s, _ in ledger.run_stages("h", stages, done, record)] == ["skipped", "done"]
    assert [s for _, s, _ in ledger.run_stages("h", stages, done, record)] == ["skipped", "skipped"]
    changed = [stage("b", ("a",), {"k": 2}), stage("a")]
    assert [s for _, s, _ in ledger.run_stages("h", changed, done, record)] == ["skipped", "done"]
    assert ran == ["a", "b", "b", "b"]


def test_stream_ingests_each_content_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("same")
    (inbox / "b.txt").write_text("same")
    (inbox / "c.txt").write_text("other")
    ran = tmp_path / "ran"
    ran.mkdir()
    stages = [ledger.Stage("identify", lambda h: (ran / h).write_text("x"))]
    led = str(tmp_path / "ledger")
    for _ in range(2):
        q = ingest.ingest(ingest.once_by_content(ingest.watch_folder(spark, str(inbox))), lambda f: stages, led, str(tmp_path / "state"))
        q.awaitTermination()
    rows = ingest.read_ledger(spark, led)
    assert rows.where("status = 'done'").count() == 2 and len(list(ran.iterdir())) == 2
    with pytest.raises(ValueError):
        ingest.guard_empty_sweep(rows.limit(0), rows)


def test_resync_plan(spark):
    src = spark.createDataFrame([("h", "docx")], "content_hash string, format string")
    jobs = spark.createDataFrame([(1, "h", "identify", "done"), (2, "h", "docx_structure", "error")], "id long, content_hash string, stage string, status string")
    plan = ledger.resync_plan(src, jobs, ledger.pipeline_table(spark))
    assert "identify" not in {r["stage"] for r in plan.collect()} and plan.count() == 7
    assert ledger.file_states(ledger.progress(src, jobs, ledger.pipeline_table(spark))).head()["state"] == "error"
