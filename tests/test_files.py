"""Folder trees, office files and OCR: what is opened, in what order parts come, what happens to bad ones."""

import builtins
import hashlib
import io
import os
import zipfile
from pathlib import Path

import pytest

from driftwood.sources import files, tree


@pytest.fixture
def folder(tmp_path):
    names = ["a.md", "sub/b.TXT", "sub/deep/c.md", ".hidden.md", ".dir/x.md", "~$lock.docx", "node_modules/q.txt", "sub/vendor/y.md", "own/z.md", "sub/own/kept.md", "no.bin", "noext", "é ö {1}[2]*.txt"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}")
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "link.md").symlink_to(tmp_path / "a.md")
    (tmp_path / "loop").symlink_to(tmp_path)
    return tmp_path


KEPT = {"a.md", "sub/b.TXT", "sub/deep/c.md", "own/z.md", "sub/own/kept.md", "é ö {1}[2]*.txt"}


def names(rows, root):
    return {str(Path(r.path).relative_to(root)) for r in rows}


def test_tree(spark, folder):
    rows = tree.read_tree(spark, str(folder)).collect()
    assert names(rows, folder) == KEPT
    assert all(r.content == Path(r.path).read_bytes() and r.size == len(r.content) and r.doc_id == hashlib.sha1(r.path.encode()).hexdigest() and r.mode == "full" for r in rows)
    assert names(tree.read_tree(spark, f"file://{folder}", excluded="own", contents="false").collect(), folder) == KEPT - {"own/z.md"}
    assert names(tree.read_tree(spark, str(folder), extensions="bin").collect(), folder) == {"no.bin"}
    assert tree.read_tree(spark, str(folder / "nowhere")).collect() == []
    assert [r.name for r in tree.subfolders(spark, str(folder)).collect()] == ["loop", "node_modules", "own", "sub"]
    assert tree.subfolders(spark, str(folder / "nowhere")).collect() == []


def test_only_listed_files_are_opened_and_folders_left_out_not_entered(folder, monkeypatch):
    opened, entered, real_open, real_scan = [], [], builtins.open, os.scandir
    monkeypatch.setattr(builtins, "open", lambda p, *a, **k: (opened.append(str(p)), real_open(p, *a, **k))[1])
    monkeypatch.setattr(os, "scandir", lambda p: (entered.append(str(p)), real_scan(p))[1])
    reader = tree.Reader({"path": str(folder), "partbytes": "1"})
    parts = reader.partitions()
    assert not opened and not any(x in e for e in entered for x in ("node_modules", "vendor", "/.dir", "/loop"))
    assert len(parts) == len(KEPT)
    rows = [r for p in parts for r in reader.read(p)]
    assert len(rows) == len(opened) == len(KEPT)
    assert [r for p in tree.Reader({"path": str(folder), "contents": "false"}).partitions() for r in p.files]
    (folder / "a.md").unlink()
    gone = [r for p in parts for r in reader.read(p) if r[0].endswith("/a.md")]
    assert gone[0][6] is None and "FileNotFoundError" in gone[0][7]


def test_a_tree_is_extracted_like_a_listing(spark, folder):
    # Spark's own listing follows links
    (folder / "loop").unlink()
    ours = {r.path: r.text for r in files.extract(tree.read_tree(spark, str(folder))).collect()}
    listed = files.listing(spark, str(folder))
    theirs = {r.path: r.text for r in files.extract(files.contents(spark, listed, str(folder))).collect()}
    assert ours == {p: t for p, t in theirs.items() if not p.endswith("link.md")} and names(listed.collect(), folder) >= KEPT
    only_names = listed.withColumn("mode", files.F.lit("filename_only"))
    assert all(r.content is None for r in files.contents(spark, only_names, str(folder)).collect())


R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(pairs):
    return "<Relationships xmlns='r'>" + "".join(f"<Relationship Id='{k}' Target='{v}'/>" for k, v in pairs.items()) + "</Relationships>"


def slide(*lines):
    return "<p:sld xmlns:p='p' xmlns:a='a'>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in lines) + "</p:sld>"


def sheet(*rows):
    return "<worksheet xmlns='x'><sheetData>" + "".join("<row>" + "".join(c for c in r) + "</row>" for r in rows) + "</sheetData></worksheet>"


def extracted(spark, kind, content, **more):
    df = spark.createDataFrame([(f"/x/f.{kind}", content)], "path string, content binary")
    return files.extract(df, **more).first()


def test_slides_come_in_the_presentation_s_order(spark):
    deck = {
        "ppt/presentation.xml": f"<p:presentation xmlns:p='p' xmlns:r='{R}'><p:sldIdLst><p:sldId r:id='r2'/><p:sldId r:id='r1'/><p:sldId r:id='r3'/></p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": rels({"r1": "slides/slide1.xml", "r2": "/ppt/slides/slide10.xml", "r3": "slides/slide2.xml", "r9": "slides/slide99.xml"}),
        "ppt/slides/slide1.xml": slide("second", " ", "more"), "ppt/slides/slide10.xml": slide("first"), "ppt/slides/slide2.xml": slide(" "), "ppt/slides/slide99.xml": slide("not shown"),
    }
    got = extracted(spark, "pptx", office(deck))
    assert (got.text, got.page_count, got.error) == ("first\n\nsecond\nmore", 3, None)


def test_sheets_go_by_the_workbook_s_relations(spark):
    book = {
        "xl/workbook.xml": f"<workbook xmlns='x' xmlns:r='{R}'><sheets><sheet name='One' r:id='a'/><sheet name='Empty' r:id='c'/><sheet name='Two' r:id='b'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": rels({"a": "worksheets/sheet7.xml", "b": "worksheets/sheet1.xml", "c": "worksheets/sheet2.xml"}),
        "xl/sharedStrings.xml": "<sst xmlns='x'><si><t>shared</t></si><si><r><t>in </t></r><r><t>parts</t></r></si></sst>",
        "xl/worksheets/sheet7.xml": sheet(["<c t='s'><v>0</v></c>", "<c><v>1.5</v></c>", "<c/>"], ["<c t='s'><v>1</v></c>"], ["<c><v> </v></c>"]),
        "xl/worksheets/sheet1.xml": sheet(["<c t='inlineStr'><is><t>inline</t></is></c>"]), "xl/worksheets/sheet2.xml": sheet(),
    }
    got = extracted(spark, "xlsx", office(book))
    assert (got.text, got.page_count) == ("# One\nshared | 1.5\nin parts\n\n# Two\ninline", 3)
    bad = extracted(spark, "xlsx", office({"xl/other.xml": "<x/>"}))
    assert bad.text == "" and "KeyError" in bad.error


def test_ocr_reads_pages_with_too_little_text(spark):
    pages = lambda b: b.decode().split("|")

    def engine():
        def run(content, page):
            if page == 3:
                raise ValueError("unreadable")
            return "" if page == 4 else f"read page {page} of {len(content)}"

        return run

    content = b"long enough here|x||y|z|also long enough"
    plain, filled = extracted(spark, "pdf", content, parsers={"pdf": pages}), extracted(spark, "pdf", content, parsers={"pdf": pages}, ocr=engine)
    assert (plain.text, plain.ocr_pages, plain.page_count) == ("long enough here\n\nalso long enough", [1, 2, 3, 4], 6)
    assert filled.text == "long enough here\n\nread page 1 of 40\n\nread page 2 of 40\n\ny\n\nz\n\nalso long enough" and filled.ocr_pages == [1, 2, 3, 4]
    many = extracted(spark, "pdf", b"|".join(b"page number %d" % k for k in range(31)), parsers={"pdf": pages})
    assert many.page_count == 31 and many.text.count("page number") == 8


def test_plain_text_is_whole(spark):
    text = "é" * (1 << 20) + "end"
    assert extracted(spark, "txt", text.encode()).text == text
    assert extracted(spark, "md", text.encode(), head_chars=5).text == "é" * 5
    assert extracted(spark, "txt", None).error
