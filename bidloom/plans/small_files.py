"""Small files of each kind, made on the spot, with the lines and properties that must be read from them."""

from __future__ import annotations

import io
import zipfile
import zlib

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def word() -> bytes:
    def p(t: str) -> str:
        return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"

    def row(*cells: str) -> str:
        return "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"

    body = p("前言") + f"<w:tbl>{row('姓名', '职务')}{row('张三', '项目经理')}</w:tbl>" + f"<w:sdt><w:sdtContent>{p('结尾')}</w:sdtContent></w:sdt>"
    core = '<x xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>张三</dc:creator><lastModifiedBy>李四</lastModifiedBy><dc:title></dc:title></x>'
    return _zipped({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>", "word/footer1.xml": f"<w:ftr {_W}>{p('页脚')}</w:ftr>", "docProps/core.xml": core, "docProps/app.xml": "<y><Application>WPS Office</Application></y>"})


def workbook() -> bytes:
    sheet = '<row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>12.5</v></c></row><row/><row><c r="A3" t="inlineStr"><is><t>泵</t></is></c></row>'
    return _zipped(
        {
            "xl/workbook.xml": f'<workbook {_S}><sheets><sheet name="报价" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<R><r Id="rId1" Target="worksheets/sheet1.xml"/></R>',
            "xl/sharedStrings.xml": f"<sst {_S}><si><t>名称</t></si></sst>",
            "xl/worksheets/sheet1.xml": f"<worksheet {_S}><sheetData>{sheet}</sheetData></worksheet>",
        }
    )


def pdf() -> bytes:
    def packed(b: bytes) -> bytes:
        return b"<< /Filter /FlateDecode >>\nstream\n%s\nendstream" % zlib.compress(b)

    body = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] >>", 3: b"<< /Type /Page /Contents 5 0 R >>", 4: b"<< /Type /Page /Contents 6 0 R >>", 5: packed(b"BT 50 700 Td (Bid letter) Tj 0 -14 Td (Total 98) Tj ET"), 6: packed(b"BT 50 700 Td (Page two) Tj ET"), 7: b"<< /Author (Li) /CreationDate (D:20240102030405+08'00') >>"}
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in body.items())


FILES: list[tuple[str, bytes]] = [
    ("a.txt", "标题\n内容".encode("gb18030")), ("b.TXT", "﻿甲\n乙".encode()), ("c.docx", word()), ("d.xlsx", workbook()), ("e.pdf", pdf()), ("f.docx", b"broken"), ("g.txt", b""), ("h", word()),
]
_WORD_LINES = [(0, "paragraph", "前言"), (1, "row", "姓名 | 职务"), (2, "row", "张三 | 项目经理"), (3, "paragraph", "结尾"), (4, "margin", "页脚")]
LINES: list[tuple[str, int, str, str]] = [
    ("a.txt", 0, "paragraph", "标题"), ("a.txt", 1, "paragraph", "内容"), ("b.TXT", 0, "paragraph", "甲"), ("b.TXT", 1, "paragraph", "乙"), *[("c.docx", *x) for x in _WORD_LINES],
    ("d.xlsx", 0, "sheet", "【工作表】报价"), ("d.xlsx", 1, "row", "名称 |  | 12.5"), ("d.xlsx", 2, "row", "泵"), ("e.pdf", 0, "page", "Bid letter"), ("e.pdf", 1, "page", "Total 98"), ("e.pdf", 2, "page", "Page two"), *[("h", *x) for x in _WORD_LINES],
]
PROPERTIES: list[tuple[str, str, str]] = [(f, *x) for f in ("c.docx", "h") for x in (("creator", "张三"), ("lastModifiedBy", "李四"), ("Application", "WPS Office"))] + [("e.pdf", "Author", "Li"), ("e.pdf", "CreationDate", "2024-01-02 03:04:05")]
