"""Files as rows: listing, type and mode, text extraction."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the listing takes and leaves.
EXTENSIONS = ["pdf", "docx", "doc", "pptx", "ppt", "xlsx", "xls", "txt", "md"]
SKIPPED_FOLDERS = ["node_modules", "bower_components", "vendor", "venv", "env", "__pycache__", "dist", "build", "target", "out", "Library", "Caches", "coverage", "htmlcov"]
TYPES = {"doc": "docx", "ppt": "pptx", "xls": "xlsx"}
_PLAIN = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?")
HEAD_BYTES, NAME_BYTES, HEAD_PAGES = 20 << 20, 50 << 20, 30


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def local_path(uri: Column) -> Column:
    """The path of a file as Spark lists it, without scheme and host; Spark's paths are not percent-encoded."""
    return F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r"\.([^.]+)$", 1))


def doc_type(path: Column) -> Column:
    ext = extension(path)
    out = F.when(ext == "", "bin")
    for old, new in TYPES.items():
        out = out.when(ext == old, new)
    return out.otherwise(ext)


def mode(size: Column, pages: Column, head: int = HEAD_BYTES, name: int = NAME_BYTES) -> Column:
    """How much of a file is read: all, the head of a large or long one, or only its name."""
    return F.when(size > name, "filename_only").when((size > head) | (F.coalesce(pages, F.lit(0)) > HEAD_PAGES), "head_only").otherwise("full")


def listing(spark: SparkSession, root: str, extensions: list[str] = EXTENSIONS, skipped: list[str] = SKIPPED_FOLDERS) -> DataFrame:
    """path, size, mtime, doc_id (SHA-1 of the path), doc_type and mode of the files below a root; contents are not read.

    Names that begin with . or ~$ and files below hidden or skipped folders are left out, as are empty files, which
    Spark's file source doesn't list.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(local_path(F.col("path")).alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))
    below = F.split(F.element_at(F.split("path", rf"\Q{_PLAIN.sub('', root).rstrip('/')}/\E", 2), -1), "/")
    folders = F.slice(below, 1, F.size(below) - 1)
    hidden = F.exists(folders, lambda p: p.isin(skipped) | p.startswith("."))
    name = name_of(F.col("path"))
    kept = files.where((F.col("size") > 0) & extension(F.col("path")).isin(extensions) & ~name.startswith(".") & ~name.startswith("~$") & ~hidden)
    return kept.select("path", "size", "mtime", F.sha1("path").alias("doc_id"), doc_type(F.col("path")).alias("doc_type"), mode(F.col("size"), F.lit(None).cast("int")).alias("mode"))


def _texts(root: ElementTree.Element, tag: str, within: str) -> list[str]:
    return ["".join(t.text or "" for t in p.iter() if t.tag.endswith(tag)) for p in root.iter() if p.tag.endswith(within)]


def _targets(z: zipfile.ZipFile, part: str, tag: str) -> list[tuple[str, str]]:
    """(name, path in the zip) of the parts that the elements `tag` of an office file's main part refer to, in their order."""
    folder, _, name = part.rpartition("/")
    rels = {r.get("Id"): r.get("Target") or "" for r in ElementTree.fromstring(z.read(f"{folder}/_rels/{name}.rels"))}
    out = []
    for e in ElementTree.fromstring(z.read(part)).iter():
        ref = next((v for k, v in e.attrib.items() if k.endswith("}id")), None) if e.tag.endswith(tag) else None
        if ref in rels:
            path = rels[ref]
            out.append((e.get("name") or "", path.lstrip("/") if path.startswith("/") else posixpath.normpath(f"{folder}/{path}")))
    return out


def _cells(row: ElementTree.Element, shared: list[str]) -> list[str]:
    """Values of a row's cells that are not blank."""
    out = []
    for c in row:
        v = next((x.text for x in c.iter() if x.tag.endswith("}v")), None)
        if c.get("t") == "inlineStr":
            v = "".join(x.text or "" for x in c.iter() if x.tag.endswith("}t"))
        elif v is not None and c.get("t") == "s":
            v = shared[int(v)]
        if v and v.strip():
            out.append(v)
    return out


def _office(kind: str, content: bytes) -> tuple[str, int | None]:
    """Text of a docx (paragraphs), pptx (lines of slides) or xlsx (cells of rows), and how many slides or sheets it has.

    Slides and sheets come in the order, and under the names, of the presentation's or workbook's own list.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        read = lambda n: ElementTree.fromstring(z.read(n))
        if kind == "docx":
            return "\n\n".join(p for p in _texts(read("word/document.xml"), "}t", "}p") if p.strip()), None
        if kind == "pptx":
            slides = _targets(z, "ppt/presentation.xml", "}sldId")
            texts = ["\n".join(p for p in _texts(read(path), "}t", "}p") if p.strip()) for _, path in slides]
            return "\n\n".join(t for t in texts if t), len(slides)
        shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in read("xl/sharedStrings.xml") if si.tag.endswith("}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        sheets, out = _targets(z, "xl/workbook.xml", "}sheet"), []
        for name, path in sheets:
            rows = [" | ".join(cells) for row in read(path).iter() if row.tag.endswith("}row") and (cells := _cells(row, shared))]
            if rows:
                out.append("\n".join([f"# {name}", *rows]))
        return "\n\n".join(out), len(sheets)


def joined_pages(pages: list[str], head_only: bool, least: int = 10, head: int = 8) -> tuple[str, list[int]]:
    """Text of a document's pages and the numbers, from 0, of those with too little text, which want OCR and are left out."""
    read = list(enumerate(pages))[: head if head_only else None]
    scanned = [k for k, p in read if len((p or "").strip()) < least]
    return "\n\n".join(p for k, p in read if k not in scanned), scanned


def with_ocr(pages: list[str], content: bytes, ocr: Callable[[bytes, int], str], head_only: bool, least: int = 10, head: int = 8) -> tuple[str, list[int]]:
    """Text of a document's pages, those with too little text read by `ocr`, and the numbers of these.

    A page keeps its own text where that fails or finds nothing.
    """
    out, read = [], []
    for k, page in enumerate(pages[: head if head_only else None]):
        text = page or ""
        if len(text.strip()) < least:
            read.append(k)
            try:
                text = ocr(content, k) or text
            except Exception:  # noqa: BLE001  one bad page must not lose the others
                pass
        out.append(text)
    return "\n\n".join(out), read


def extract(files: DataFrame, parsers: dict[str, Callable[[bytes], str | list[str]]] | None = None, head_chars: int | None = None, ocr: Callable[[], Callable[[bytes, int], str]] | None = None) -> DataFrame:
    """path, doc_type, text, error, page_count and ocr_pages of files with their content; `parsers` adds types (pdf needs one).

    A parser returns a text, or the texts of pages.  With a column `mode`, files of mode filename_only have their name as
    text and are not parsed, those of mode head_only the first pages, as have documents of more than `HEAD_PAGES` pages.
    Pages with too little text are left out and told in ocr_pages; `ocr`, called once a task, makes a function of content
    and page that reads them instead.  `head_chars` cuts plain text there; by default it is whole.  A file that can't be
    read, or has no content, has empty text and its error; a type without a parser has empty text.
    """
    given = dict(parsers or {})

    def read(kind: str, how: str, content: bytes, reads: Callable[[bytes, int], str] | None) -> tuple[str, int | None, list[int]]:
        if kind in given:
            got = given[kind](content)
            if isinstance(got, str):
                return got, None, []
            head = how == "head_only" or len(got) > HEAD_PAGES
            text, scanned = with_ocr(got, content, reads, head) if reads else joined_pages(got, head)
            return text, len(got), scanned
        if kind in ("txt", "md"):
            return content.decode("utf-8", "ignore")[:head_chars], None, []
        return (*_office(kind, content), []) if kind in ("docx", "pptx", "xlsx") else ("", None, [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reads = None
        for b in batches:
            reads = reads or (ocr() if ocr else None)
            rows = []
            for path, kind, how, content in zip(b.path, b.doc_type, b["mode"], b.content):
                try:
                    text, pages, scanned = (path.rsplit("/", 1)[-1], None, []) if how == "filename_only" else read(kind, how, content, reads)
                    rows.append((path, kind, text, None, pages, scanned))
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    rows.append((path, kind, "", f"{type(e).__name__}: {e}", None, []))
            out = pd.DataFrame(rows, columns=["path", "doc_type", "text", "error", "page_count", "ocr_pages"])
            yield out.astype({"page_count": "Int64"})

    how = F.col("mode") if "mode" in files.columns else F.lit("full")
    # what is not parsed is not sent to Python either
    content = F.when(how != "filename_only", F.col("content"))
    out = "path string, doc_type string, text string, error string, page_count long, ocr_pages array<int>"
    return files.select("path", doc_type(F.col("path")).alias("doc_type"), how.alias("mode"), content.alias("content")).mapInPandas(run, out)


def name_hint(path: Column) -> Column:
    """The parts of a path as words: runs of _ and - become spaces."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.regexp_replace(p, "[_-]+", " ")), " ")


def contents(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """The given files below a root with their content, null for those of mode filename_only; no other file is opened.

    Their paths pass through the driver, where Spark's file source keeps those it reads anyhow.
    """
    scheme = m.group(0) if (m := _PLAIN.match(root)) else ""
    opened = files.where("mode != 'filename_only'") if "mode" in files.columns else files
    # a path is taken for a pattern
    paths = [scheme + re.sub(r"([\\*?\[\]{}])", r"\\\1", r.path) for r in opened.select("path").toLocalIterator()]
    if not paths:
        return files.withColumn("content", F.lit(None).cast("binary"))
    read = spark.read.format("binaryFile").load(paths).select(local_path(F.col("path")).alias("path"), "content")
    return files.join(read, "path", "left")
