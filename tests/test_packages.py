import io
import zipfile

import pytest

from foliomill.operators import packages as pk
from foliomill.sources import epub, glossary, html

CHAPTER = (
    '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><p class="bold mfont" id="h1">第一章</p><p><ruby>幕<rt>まく</rt>間<rt>あい</rt></ruby>だ<a href="#n1">1</a></p>'
    '<p>　</p><aside epub:type="footnote" id="n1"><p>note text</p></aside><table><tr><th>名前</th><td colspan="2">値</td></tr><tr><td rowspan="x">アル</td></tr></table><img src="images/a.png"/></body></html>'
)


def package(spine=True, nav=True, container=True, encrypted=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        if container:
            z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="item/standard.opf"/></rootfiles></container>')
        if encrypted:
            z.writestr("META-INF/encryption.xml", "<x/>")
        items = '<item id="c1" href="ch1.xhtml" media-type="application/xhtml+xml"/><item id="css" href="style.css" media-type="text/css"/><item id="gone" href="gone.xhtml" media-type="application/xhtml+xml"/>'
        items += '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' if nav else ""
        refs = '<itemref idref="c1"/><itemref idref="nope"/>' if spine else ""
        z.writestr("item/standard.opf", f'<package><metadata><title>T</title><title>U</title><language>ja</language><meta name="cover" content="missing"/></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
        z.writestr("item/ch1.xhtml", CHAPTER)
        z.writestr("item/style.css", "body{writing-mode: vertical-rl}")
        z.writestr("item/nav.xhtml", '<html xmlns:epub="u"><nav epub:type="toc"><ol><li><a href="ch1.xhtml#h1">第一章</a><ol><li><a href="ch1.xhtml#x">sub</a></li></ol></li></ol></nav></html>')
    return out.getvalue()


@pytest.fixture(scope="module")
def packages(spark):
    data = [("good", package()), ("bare", package(spine=False, nav=False)), ("locked", package(encrypted=True)), ("junk", b"no zip"), ("nocont", package(container=False))]
    return spark.createDataFrame(data, "doc_id string, content binary")


def test_documents(packages):
    got = {r.doc_id: r for r in epub.documents(packages).collect()}
    assert (got["good"].title, got["good"].source_lang, got["good"].vertical, got["good"].spine_docs) == ("T", "ja", True, 2)
    assert got["locked"].error == "encrypted" and got["junk"].error.startswith("BadZipFile") and got["nocont"].error.startswith("KeyError")


def test_blocks(packages):
    b = [r for r in epub.blocks(packages).orderBy("ord").collect() if r.doc_id == "good"]
    assert [(r.type, r.text) for r in b] == [("heading", "第一章"), ("paragraph", "幕間だ1"), ("footnote", "note text"), ("table", ""), ("image", "")]
    assert b[0].block_id == "b000001" and b[1].refs == ["n1"] and b[2].note_id == "n1"
    assert b[3].rows == [["名前", "値"], ["アル"]] and b[3].cell_spans == [[[1, 1], [1, 2]], [[1, 1]]]


def test_toc_levels(packages):
    assert [(r.level, r.title, r.file, r.frag) for r in epub.toc(packages).orderBy("pos").collect() if r.doc_id == "good"] == [(1, "第一章", "item/ch1.xhtml", "h1"), (2, "sub", "item/ch1.xhtml", "x")]


def test_validation(packages):
    docs = packages.select("doc_id").filter("doc_id in ('good', 'bare')")
    p = packages.join(docs, "doc_id", "left_semi")
    found = pk.validate(docs, epub.entries(p), epub.items(p), epub.spine(p), epub.refs(p), epub.covers(p))
    got = sorted((r.doc_id, r.code) for r in found.collect())
    assert ("good", "missing-item") in got and ("good", "bad-idref") in got and ("good", "bad-cover-meta") in got and ("good", "nav-not-in-spine") in got and ("good", "dangling-ref") in got
    assert ("bare", "empty-spine") in got and ("bare", "no-nav") in got and not [g for g in got if g[1].startswith("mimetype")]


def test_mimetype_and_faults(spark):
    e = spark.createDataFrame([("a", 0, "x", False, ""), ("a", 1, "mimetype", True, "text/plain")], "doc_id string, entry_no int, name string, compressed boolean, head string")
    assert sorted(r.code for r in pk.mimetype(e).collect()) == ["mimetype-compressed", "mimetype-content", "mimetype-order"]
    pages = spark.createDataFrame([("a", "1", "<html/>"), ("a", "2", "<p>"), ("a", "3", "<div/>")], "doc_id string, name string, content string")
    assert sorted((r.where, r.code) for r in pk.malformed(pages).collect()) == [("2", "malformed"), ("3", "not-html")]


def test_write_and_read_back(spark):
    ch = spark.createDataFrame([("d", 1, "One", "<h1>One</h1><p>text</p>"), ("d", 2, "Two", "<h1>Two</h1>")], "doc_id string, part int, title string, body string")
    made = epub.write_packages(ch, spark.createDataFrame([("d", "Book", "zh")], "doc_id string, title string, lang string"))
    with zipfile.ZipFile(io.BytesIO(bytes(made.first().content))) as z:
        first = z.infolist()[0]
        assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED
    assert [r.text for r in epub.blocks(made).orderBy("ord").collect() if r.type == "heading"] == ["One", "Two"]
    assert epub.documents(made).first().title == "Book"


def test_tolerant_html():
    p = html.parse('<h1>A<p>b <b>c<br>d<li>e<script>x</script><p class="title">not a head')
    assert [(b["type"], b["text"]) for b in p.blocks] == [("heading", "A"), ("paragraph", "b c d"), ("paragraph", "e"), ("paragraph", "not a head")]


def test_glossary_files(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("# c\nレム=蕾姆\nsource\tcount\tkind\tsample\ttranslation\nスバル\t12\tk\ts\t昴\n", encoding="utf-8")
    (tmp_path / "g.json").write_text('{"a": "b", "c": " "}', encoding="utf-8")
    assert [(r.term, r.expected) for r in glossary.load(spark, f"file://{tmp_path}/g.tsv").orderBy("gl_order").collect()] == [("レム", "蕾姆"), ("スバル", "昴")]
    assert [(r.term, r.expected) for r in glossary.load(spark, f"file://{tmp_path}/g.json").collect()] == [("a", "b")]


def test_leaf_divs_captions_and_long_class_headings():
    long = "a title that is much longer than forty characters are"
    p = html.parse(f'<div>leaf <b>one</b></div><div>not a leaf<p>inside</p></div><p class="mfont">{long}</p><p class="mfont">short</p><table><caption>Cap  tion</caption><tr><td>x</td></tr></table>')
    assert [(b["type"], b["text"]) for b in p.blocks] == [("paragraph", "leaf one"), ("paragraph", "inside"), ("paragraph", long), ("heading", "short"), ("table", "")]
    assert p.blocks[-1]["caption"] == "Cap tion" and p.blocks[-1]["rows"] == [["x"]]
