"""Uploads as a data source: blocks of files, pruned columns, damaged files, streams."""

import os
import time
import zipfile

import pytest

from quarryspark.sources import docx, uploads

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def p(text, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def cell(text, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{p(text)}</w:tc>"


def write_docx(path):
    style = lambda name: f'<w:pStyle w:val="{name}"/>'
    body = "".join(
        [
            p("Manual", style("Title")),
            p("First", style("H1")),
            p("Some text"),
            p("Below", style("Heading2")),
            p("an item", '<w:numPr><w:ilvl w:val="1"/></w:numPr>'),
            "<w:tbl><w:tr>" + cell("a", '<w:gridSpan w:val="2"/>') + cell("b", '<w:vMerge w:val="restart"/>') + "</w:tr><w:tr>" + cell("c") + cell("d") + cell("", "<w:vMerge/>") + "</w:tr></w:tbl>",
            p("Second", style("H1")),
            p("   "),
            "<w:sdt><w:sdtContent>" + p("inside a control") + "</w:sdtContent></w:sdt>",
            "<w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>",
            '<w:sectPr><w:headerReference r:id="r1"/><w:footerReference r:id="r2"/></w:sectPr>',
        ]
    )
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/header1.xml", f"<w:hdr {W}>{p('On top')}</w:hdr>")
        z.writestr("word/footer1.xml", f"<w:ftr {W}>{p('At the end')}</w:ftr>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="header1.xml"/><Relationship Id="r2" Target="footer1.xml"/></Relationships>')


BLOCKS = [
    ("header", "On top", None, ()),
    ("heading", "Manual", 1, ("Manual",)),
    ("heading", "First", 1, ("First",)),
    ("paragraph", "Some text", None, ("First",)),
    ("heading", "Below", 2, ("First", "Below")),
    ("list_item", "an item", 2, ("First", "Below")),
    ("table_row", "a | a | b", None, ("First", "Below")),
    ("table_row", "c | d | b", None, ("First", "Below")),
    ("heading", "Second", 1, ("Second",)),
    ("paragraph", "inside a control", None, ("Second",)),
    ("paragraph", "one\ttwo", None, ("Second",)),
    ("footer", "At the end", None, ()),
]


def folder(tmp_path):
    at = tmp_path / "up"
    (at / "deeper").mkdir(parents=True)
    write_docx(at / "deeper" / "b.docx")
    (at / "a.txt").write_bytes(b"plain \xff text")
    (at / "empty.txt").write_bytes(b" \n")
    (at / "bad.docx").write_bytes(b"PK no zip")
    (at / "c.pdf").write_bytes(b"%PDF-1.4")
    (at / "noending").write_bytes(b"x")
    (at / "_hidden.txt").write_bytes(b"x")
    return at


def short(path):
    return path.rsplit("/", 1)[1]


def test_blocks(tmp_path):
    write_docx(tmp_path / "b.docx")
    found = list(docx.blocks((tmp_path / "b.docx").read_bytes()))
    assert [(b.kind, b.text, b.level, b.section) for b in found] == BLOCKS
    assert [(b.cells, b.merged) for b in found if b.kind == "table_row"] == [(("a", "a", "b"), 1), (("c", "d", "b"), 1)]
    with pytest.raises(docx.TooLarge):
        list(docx.blocks((tmp_path / "b.docx").read_bytes(), most=100))


def test_batch(spark, tmp_path):
    at = folder(tmp_path)
    got = uploads.register(spark).read.format("uploads").load(str(at)).collect()
    assert [(r.kind, r.text, r.level, tuple(r.section)) for r in sorted(got, key=lambda r: r.part_index) if short(r.path) == "b.docx"] == BLOCKS
    assert {(short(r.path), r.kind, r.text) for r in got if short(r.path) == "a.txt"} == {("a.txt", "text", "plain � text")}
    assert {short(r.path): r.error.split(":")[0] for r in got if r.error} == {"bad.docx": "BadZipFile", "c.pdf": "ValueError", "noending": "ValueError"}
    assert {short(r.path) for r in got} == {"b.docx", "a.txt", "bad.docx", "c.pdf", "noending"}


def test_fewer_columns_and_options(spark, tmp_path):
    at = folder(tmp_path)
    read = uploads.register(spark).read.format("uploads")
    listed = read.schema("path string, size long").load(str(at)).collect()
    assert sorted((short(r.path), r.size) for r in listed if short(r.path) != "b.docx") == [("a.txt", 12), ("bad.docx", 9), ("c.pdf", 8), ("empty.txt", 2), ("noending", 1)]
    assert {r.error.split(":")[0] for r in read.schema("error string").option("maxFileBytes", "5").option("pathGlobFilter", "a.*").load(str(at)).collect()} == {"ValueError"}
    some = spark.read.format("uploads").option("pathGlobFilter", "*.txt").option("maxPartitionBytes", "5").load("file://" + str(at))
    assert some.rdd.getNumPartitions() == 2 and [r.text for r in some.collect()] == ["plain � text"]
    (tmp_path / "none").mkdir()
    assert spark.read.format("uploads").load(str(tmp_path / "none")).count() == 0


def test_wrong_columns_or_places(spark, tmp_path):
    read = uploads.register(spark).read.format("uploads")
    for make in (lambda: read.schema("nothing string").load(str(tmp_path)), lambda: spark.read.format("uploads").load(str(tmp_path / "missing"))):
        with pytest.raises(Exception, match="nothing|missing"):
            make().collect()


def test_stream_takes_each_file_once(spark, tmp_path):
    at = folder(tmp_path)
    old = time.time() - 60
    for path in at.rglob("*.*"):
        os.utime(path, (old, old))
    os.utime(at / "noending", (old, old))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        read = uploads.register(spark).readStream.format("uploads").option("settledSeconds", "1").load(str(at))
        done = read.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="1 second").start()
        try:
            done.processAllAvailable()
        finally:
            done.stop()
        return sorted((short(r.path), r.part_index, r.text) for r in spark.read.parquet(out).collect())

    batch = sorted((short(r.path), r.part_index, r.text) for r in uploads.register(spark).read.format("uploads").load(str(at)).collect())
    key = lambda rows: sorted(map(str, rows))
    assert key(run()) == key(batch)
    (at / "later.txt").write_text("later")
    os.utime(at / "later.txt", (old + 30, old + 30))
    assert key(run()) == key([*batch, ("later.txt", 0, "later")])
    assert key(run()) == key([*batch, ("later.txt", 0, "later")])
