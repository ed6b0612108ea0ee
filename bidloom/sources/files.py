"""Bid files as DataFrames: one row a line, in document order, read with binaryFile and decoded in Arrow batches.

Only the standard library is needed: for text, workbooks, word-processor files of both kinds and the text of PDF pages. A
plug-in, ``page_reader``, takes the place of the page reader where the cluster has a fuller one or one for scans; a file
of which no page shows any text gives an error that says so.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions.text import extension
from bidloom.sources import legacy
from bidloom.sources.legacy import MAGIC
from bidloom.sources.pages import objects, read_pages

SCHEMA = "path string, line_no int, kind string, text string, error string"
KINDS = ("txt", "xlsx", "docx", "doc", "pdf")
Line = tuple[str, str]  # kind, text
PageReader = Callable[[bytes], list[str]]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def file_kind(path: Column) -> Column:
    """txt, xlsx, docx, doc or pdf by extension; anything else is read as docx."""
    ext = extension(path)
    return F.when(ext.isin(*KINDS), ext).otherwise("docx")


def decoded(content: bytes) -> str:
    """UTF-8 with or without mark, else GB18030, else UTF-8 with replacement characters."""
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def text_lines(content: bytes) -> list[Line]:
    return [("paragraph", line) for line in decoded(content).splitlines()]


def workbook_lines(content: bytes, most_sheets: int | None = None, most_rows: int | None = None) -> list[Line]:
    """A line with the title of each sheet, then its rows that are not empty, cells joined with bars. Whole workbooks are
    read unless a limit is given."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(_S + "si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out: list[Line] = []
        for sheet in list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet"))[:most_sheets]:
            out.append(("sheet", f"【工作表】{sheet.get('name')}"))
            target = (targets.get(sheet.get(_R + "id")) or "").lstrip("/")
            part = target if target in names else f"xl/{target}"
            rows = 0
            for row in ElementTree.fromstring(z.read(part)).iter(_S + "row"):
                cells: list[str] = []
                for c in row.iter(_S + "c"):
                    letters = re.sub("[^A-Z]", "", c.get("r") or "")
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    cells += [""] * (at - 1 - len(cells))
                    if c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(_S + "t"))
                    else:
                        v = c.find(_S + "v")
                        value = (v.text or "") if v is not None else ""
                        if c.get("t") == "s" and value:
                            value = shared[int(value)]
                    cells.append(value.strip())
                if any(cells):
                    out.append(("row", " | ".join(cells)))
                    rows += 1
                    if most_rows is not None and rows >= most_rows:
                        break
        return out


def _paragraph(p: ElementTree.Element) -> str:
    parts = []
    for node in p.iter():
        if node.tag == _W + "t":
            parts.append(node.text or "")
        elif node.tag == _W + "tab":
            parts.append("\t")
        elif node.tag in (_W + "br", _W + "cr"):
            parts.append("\n")
    return "".join(parts)


def _cell(cell: ElementTree.Element) -> str:
    """The text of a table cell; rows of a table inside it follow its own paragraphs."""
    return " ".join(t for _, t in _blocks(cell))


def _blocks(parent: ElementTree.Element) -> list[Line]:
    """Paragraphs and table rows below a node in order, those in content controls and other wrappers included."""
    out: list[Line] = []
    for node in parent:
        if node.tag == _W + "p":
            out += [("paragraph", t.strip()) for t in _paragraph(node).split("\n") if t.strip()]
        elif node.tag == _W + "tbl":
            for row in (r for r in _rows(node)):
                cells = [_cell(c) for c in _wrapped(row, _W + "tc")]
                if any(cells):
                    out.append(("row", " | ".join(cells)))
        elif node.tag in (_W + "sdt", _W + "sdtContent", _W + "ins", _W + "smartTag", _W + "customXml"):
            out += _blocks(node)
    return out


def _wrapped(parent: ElementTree.Element, tag: str) -> list[ElementTree.Element]:
    """The children of a kind, also inside content controls, but not those of tables further in."""
    out = []
    for node in parent:
        if node.tag == tag:
            out.append(node)
        elif node.tag in (_W + "sdt", _W + "sdtContent", _W + "ins", _W + "customXml"):
            out += _wrapped(node, tag)
    return out


def _rows(table: ElementTree.Element) -> list[ElementTree.Element]:
    return _wrapped(table, _W + "tr")


def document_lines(content: bytes) -> list[Line]:
    """Paragraphs and table rows in the order of the document, then headers and footers."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        out: list[Line] = []
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
        out += _blocks(body) if body is not None else []
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n)):
            for p in ElementTree.fromstring(z.read(name)).iter(_W + "p"):
                if _paragraph(p).strip():
                    out.append(("margin", _paragraph(p).strip()))
        return out


def page_lines(content: bytes, page_reader: PageReader | None, most_pages: int | None = None, sampled: int = 50, empty_streak: int = 50) -> list[Line]:
    """Lines of each page; stops after ``empty_streak`` empty pages once ``sampled`` pages were read."""
    pages = (page_reader or read_pages)(content)[:most_pages]
    if not any(p.strip() for p in pages):
        raise ValueError("no page shows any text; scanned pages need a page reader")
    out: list[Line] = []
    streak = 0
    for n, page in enumerate(pages):
        streak = 0 if page.strip() else streak + 1
        if n >= sampled and streak >= empty_streak:
            break
        out += [("page", line) for line in page.split("\n")]
    return out


def read_lines(spark: SparkSession, folder: str, page_reader: PageReader | None = None) -> DataFrame:
    """(path, line_no, kind, text, error): the lines of all files under a folder, each file by itself in a task; a file
    that cannot be read gives one row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return file_lines(files, page_reader)


def _frame(path: str, lines: list[Line], error: str | None = None) -> pd.DataFrame:
    rows = [(k, t) for k, t in lines] if error is None else [(None, None)]
    numbers = list(range(len(lines))) if error is None else [None]
    return pd.DataFrame({"path": path, "line_no": pd.array(numbers, dtype="Int32"), "kind": pd.Series([r[0] for r in rows], dtype="object"), "text": pd.Series([r[1] for r in rows], dtype="object"), "error": pd.Series([error] * len(rows), dtype="object")})


def file_lines(files: DataFrame, page_reader: PageReader | None = None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, content in zip(batch["path"], batch["kind"], batch["content"], strict=True):
                try:
                    if kind == "txt":
                        lines = text_lines(content)
                    elif kind == "xlsx":
                        lines = workbook_lines(content)
                    elif content[:8] == MAGIC:
                        lines = legacy.document_lines(content)
                    elif kind in ("docx", "doc"):
                        lines = document_lines(content)
                    else:
                        lines = page_lines(content, page_reader)
                    yield _frame(path, lines)
                except Exception as e:  # one broken file must not end the job
                    yield _frame(path, [], f"{type(e).__name__}: {e}"[:300])

    return files.select("path", file_kind(F.col("path")).alias("kind"), "content").mapInPandas(run, SCHEMA)


def file_texts(lines: DataFrame) -> DataFrame:
    """(path, text, error): a file's lines put together in order."""
    parts = F.array_sort(F.collect_list(F.when(F.col("line_no").isNotNull(), F.struct("line_no", "text"))))
    return lines.groupBy("path").agg(F.array_join(F.transform(parts, lambda x: x.getField("text")), "\n").alias("text"), F.max("error").alias("error"))


def office_properties(content: bytes) -> dict[str, str]:
    """Core, application and custom properties of an Office file, by their local names; empty ones are left out."""
    out: dict[str, str] = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for part in ("docProps/core.xml", "docProps/app.xml", "docProps/custom.xml"):
            if part not in z.namelist():
                continue
            for node in ElementTree.fromstring(z.read(part)):
                name = node.get("name") or node.tag.rpartition("}")[2]
                value = "".join(node.itertext()).strip()
                if value:
                    out[name] = value
    return out


_PDF_FIELD = re.compile(rb"/(Title|Author|Subject|Creator|Producer|CreationDate|ModDate)\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)")


def pdf_properties(content: bytes) -> dict[str, str]:
    """The fields of a PDF's information dictionary, also in compressed objects; dates as yyyy-mm-dd hh:mm:ss."""
    out: dict[str, str] = {}
    packed = b"\n".join(b for b in objects(content).values() if b"stream" not in b) if b"/ObjStm" in content else b""
    for name, raw in _PDF_FIELD.findall(content + packed):
        if raw[:1] == b"<":
            value = bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode() + ("0" if len(re.sub(rb"\s", b"", raw[1:-1])) % 2 else ""))
        else:
            value = re.sub(rb"\\([()\\])", rb"\1", raw[1:-1])
        text = value[2:].decode("utf-16-be", "replace") if value[:2] == b"\xfe\xff" else value.decode("latin-1")
        if m := re.match(r"D:(\d{4})(\d{2})(\d{2})(\d{2})?(\d{2})?(\d{2})?", text):
            text = f"{m[1]}-{m[2]}-{m[3]} {m[4] or '00'}:{m[5] or '00'}:{m[6] or '00'}"
        if text.strip():
            out[name.decode()] = text.strip()
    return out


def file_properties(files: DataFrame) -> DataFrame:
    """(path, properties map<string,string>): what each file says about itself; unreadable files say nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, content in zip(batch["path"], batch["kind"], batch["content"], strict=True):
                try:
                    found = pdf_properties(content) if kind == "pdf" else legacy.document_properties(content) if content[:8] == MAGIC else office_properties(content) if kind in ("docx", "xlsx", "doc") else {}
                except Exception:  # a broken file has no properties
                    found = {}
                rows.append((path, found))
            yield pd.DataFrame(rows, columns=["path", "properties"])

    return files.select("path", file_kind(F.col("path")).alias("kind"), "content").mapInPandas(run, "path string, properties map<string,string>")
