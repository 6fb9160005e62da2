import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from tessera.sources import files, office

R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return b.getvalue()


def rels(*rows):
    return "<Relationships xmlns='x'>" + "".join(f"<Relationship Id='{i}' Type='t/{t}' Target='{p}'/>" for i, t, p in rows) + "</Relationships>"


def slide(text, show=""):
    return f"<p:sld xmlns:p='{P}' xmlns:a='{A}' {show}><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:sld>"


DECK = zipped({
    "ppt/presentation.xml": f"<p:presentation xmlns:p='{P}' xmlns:r='{R}'><p:sldIdLst><p:sldId id='256' r:id='r2'/><p:sldId id='257' r:id='r1'/></p:sldIdLst></p:presentation>",
    "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "slides/slide2.xml")),
    "ppt/slides/slide1.xml": slide("first file"),
    "ppt/slides/slide2.xml": slide("shown first", "show='0'"),
    "ppt/slides/_rels/slide2.xml.rels": rels(("n", "notesSlide", "../notes/n.xml")),
    "ppt/notes/n.xml": slide("a note"),
})
WORD = zipped({"word/document.xml": "<w:d xmlns:w='w'><w:p><w:t>One</w:t></w:p><w:p/><w:p><w:t>Two </w:t><w:t>three</w:t></w:p></w:d>"})
BOOK = zipped({
    "xl/workbook.xml": f"<w xmlns:r='{R}'><sheets><sheet name='S1' r:id='a'/></sheets></w>",
    "xl/_rels/workbook.xml.rels": rels(("a", "worksheet", "worksheets/s.xml")),
    "xl/sharedStrings.xml": "<sst><si><t>zero</t></si><si><t>one</t></si></sst>",
    "xl/worksheets/s.xml": "<s><c t='s'><v>1</v></c><c><v>0</v></c><c t='inlineStr'><is><t>in</t></is></c></s>",
})
EPUB = zipped({
    "META-INF/container.xml": "<c><rootfile full-path='o/b.opf'/></c>",
    "o/b.opf": "<p><item id='a' href='a%20b.html'/><item id='e' href='e.html'/><item id='z' href='z.html'/><itemref idref='a'/><itemref idref='e'/><itemref idref='z'/></p>",
    "o/a b.html": "<html><body><p>A</p></body></html>", "o/e.html": "<html><body></body></html>", "o/z.html": "<html><body>Z</body></html>",
})


def test_parts():
    assert office.rels_path("ppt/slides/slide2.xml") == "ppt/slides/_rels/slide2.xml.rels"
    assert office.part_path("ppt/slides/slide1.xml", "../media/pic.png") == "ppt/media/pic.png"
    assert office.rels_path("") == "_rels/.rels"


def test_office_units(spark):
    rows = [("d.pptx", DECK), ("w.docx", WORD), ("b.xlsx", BOOK), ("e.epub", EPUB), ("broken.docx", b"no zip"), ("other.bin", b""), ("none.docx", None)]
    got = office.office_units(spark.createDataFrame(rows, "path string, content binary")).orderBy("path", "ordinal").collect()
    assert [(r["path"], r["ordinal"], r["text"], r["hidden"]) for r in got] == [
        ("b.xlsx", 1, "[sheet] S1\none\nin", False), ("d.pptx", 1, "shown first\n\n[notes] a note", True), ("d.pptx", 2, "first file", False), ("e.epub", 1, "A", False), ("e.epub", 3, "Z", False), ("w.docx", 1, "One\nTwo three", False),
    ]
    assert "zero" in office.sheets(BOOK, compat=True)[0][3]


def test_unpack(spark):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w:gz") as t:
        for name, data in (("ok.txt", b"1"), ("../evil", b"2"), ("__MACOSX/x", b"3")):
            i = tarfile.TarInfo(name)
            i.size = len(data)
            t.addfile(i, io.BytesIO(data))
    z = zipped({"a": "12345", "b": "123456789", "c": "1"})
    df = spark.createDataFrame([("t", b.getvalue()), ("z", z), ("bad", b"xx")], "path string, content binary")
    got = {(r["path"], r["entry"]) for r in office.unpack(df, max_bytes=8).select("path", "entry").collect()}
    assert got == {("t", "ok.txt"), ("z", "a"), ("z", "c")}


def test_positioned_xml():
    xml = "<x><page number='2'><fontspec id='0' size='12'/><text top='1' left='2' width='3' height='4' font='0'> a  <b>b</b></text><text top='1' left='2' width='3' height='1' font='9'>c</text></page></x>"
    assert office.fragments_of(xml) == [(2, "a b", 2.0, 1.0, 3.0, 4.0, 12.0, True), (2, "c", 2.0, 1.0, 3.0, 1.0, 3.0, False)]


def test_scan(spark, tmp_path):
    for name, data in (("a.txt", b"Hello\nworld"), ("sub/p.pdf", b"%PDF-1.4 x"), (".hidden", b""), ("node_modules/x.txt", b""), ("skip.log", b""), ("big.md", b"x" * 50)):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(data)
    got = {r["path"]: r for r in files.scan(spark, str(tmp_path), ["*.log"], oversize=40).collect()}
    assert set(got) == {"a.txt", "sub/p.pdf", "big.md"}
    assert got["sub/p.pdf"]["mime"] == "application/pdf" and got["sub/p.pdf"]["kind"] == "pdf"
    assert got["big.md"]["oversized"] and got["big.md"]["content_hash"] is None and len(got["a.txt"]["content_hash"]) == 64


def test_plain_text_units(spark):
    df = spark.createDataFrame([("a", b"\n T \nx")], "path string, content binary")
    assert files.text_units(df).first()["title"] == "T"
    pages = files.page_units(spark.createDataFrame([("p", "one\ftwo\f\f")], "path string, text string")).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["text"]) for r in pages] == [(1, "one"), (2, "two")]
    assert spark.range(1).select(files.kind_of(F.lit("x.PPTX"))).first()[0] == "presentation"
