import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from bidloom.plans.analysis import analyze, report
from bidloom.sources import files, legacy, store
from bidloom.sources.pages import read_pages
from bidloom.streaming.incremental import contact_stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('名称')}</w:tc><w:tc>{p('数量')}</w:tc></w:tr><w:tr><w:tc>{p('泵')}</w:tc><w:tc>{p('3')}</w:tc></w:tr></w:tbl>"
    core = '<x xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>张三</dc:creator><dc:title></dc:title></x>'
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{p('前')}{table}{p('后')}</w:body></w:document>", "word/header1.xml": f"<w:hdr {W}>{p('页眉')}</w:hdr>", "docProps/core.xml": core})


def xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return zipped(
        {
            "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="报价" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<R><r Id="rId1" Target="worksheets/sheet1.xml"/></R>',
            "xl/sharedStrings.xml": f"<sst {s}><si><t>名称</t></si></sst>",
            "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>12.5</v></c></row><row/><row><c r="A3" t="inlineStr"><is><t>泵</t></is></c></row></sheetData></worksheet>',
        }
    )


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("标题\n内容".encode("gb18030"))
    (tmp_path / "b.txt").write_bytes("﻿甲".encode())
    (tmp_path / "sub/c.docx").write_bytes(docx())
    (tmp_path / "d.xlsx").write_bytes(xlsx())
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.pdf").write_bytes(b"%PDF /Title (T\\(1\\)) /CreationDate (D:20240102030405+08'00')")
    (tmp_path / "g.txt").write_bytes(b"")
    rows = files.read_lines(spark, str(tmp_path))
    texts = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.file_texts(rows).collect()}
    assert texts["a.txt"][0] == "标题\n内容" and texts["b.txt"][0] == "甲" and "g.txt" not in texts
    assert texts["c.docx"][0] == "前\n名称 | 数量\n泵 | 3\n后\n页眉"
    assert texts["d.xlsx"][0] == "【工作表】报价\n名称 |  | 12.5\n泵"
    assert texts["e.docx"][1].startswith("BadZipFile") and "no page shows any text" in texts["f.pdf"][1]
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    about = {r.path.rsplit("/", 1)[1]: r.properties for r in files.file_properties(binary).collect()}
    assert about["c.docx"] == {"creator": "张三"} and about["f.pdf"] == {"Title": "T(1)", "CreationDate": "2024-01-02 03:04:05"} and about["e.docx"] == {}


def test_content_controls_and_tables_in_tables():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    inner = f"<w:tbl><w:tr><w:tc>{p('里')}</w:tc><w:tc>{p('2')}</w:tc></w:tr></w:tbl>"
    body = f"<w:sdt><w:sdtContent>{p('控')}</w:sdtContent></w:sdt><w:tbl><w:tr><w:tc>{p('外')}{inner}</w:tc><w:sdt><w:sdtContent><w:tc>{p('1')}</w:tc></w:sdtContent></w:sdt></w:tr></w:tbl>"
    assert files.document_lines(zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})) == [("paragraph", "控"), ("row", "外 里 | 2 | 1")]


def compound(streams):
    """A compound file of streams that are each padded to at least 4,096 bytes, in sectors of 512."""
    blocks, entries, fat = [], [], []

    def put(data):
        start = len(blocks)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        blocks.extend(parts)
        fat.extend([start + k + 1 for k in range(len(parts) - 1)] + [0xFFFFFFFE])
        return start

    for name, data in streams.items():
        data = data.ljust(4096, b"\0")
        entries.append((name, 2, put(data), len(data)))
    directory = b""
    for name, kind, start, size in [("Root Entry", 5, 0xFFFFFFFE, 0), *entries]:
        raw = name.encode("utf-16-le") + b"\0\0"
        directory += raw.ljust(64, b"\0") + struct.pack("<HB", len(raw), kind) + b"\0" * 49 + struct.pack("<IQ", start, size)
    root = put(directory)
    fat.append(0xFFFFFFFD)
    at = len(blocks)
    blocks.append(struct.pack("<128I", *(fat + [0xFFFFFFFF] * (128 - len(fat)))))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<9I", 1, root, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, at)
    return head + b"\xff" * (512 - len(head)) + b"".join(blocks)


def old_doc():
    wide, narrow = "投标函\r名称\x07数量\x07\x07泵\x073\x07\x07\x13 PAGE \x14", "7\x15 End\r"
    main = bytearray(1024 + 2 * len(wide) + len(narrow))
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<H", main, 0x0A, 0x0200)
    main[1024:] = wide.encode("utf-16-le") + narrow.encode("cp1252")
    n1, n2 = len(wide), len(wide) + len(narrow)
    pieces = struct.pack("<3I", 0, n1, n2) + b"\0\0" + struct.pack("<I", 1024) + b"\0\0" + b"\0\0" + struct.pack("<I", (1024 + 2 * len(wide)) * 2 | 0x40000000) + b"\0\0"
    clx = b"\x01" + struct.pack("<H", 2) + b"xx" + b"\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", main, 0x01A2, 0, len(clx))
    author = "张三".encode("gb18030") + b"\0"
    values = [struct.pack("<II", 2, 936), struct.pack("<II", 30, len(author)) + author.ljust(8, b"\0"), struct.pack("<IQ", 64, 132223104000000000)]
    places, at = [], 8 + 8 * len(values)
    for pid, v in zip((1, 4, 12), values, strict=True):
        places.append(struct.pack("<II", pid, at))
        at += len(v)
    section = struct.pack("<II", at, len(values)) + b"".join(places) + b"".join(values)
    summary = b"\xfe\xff" + b"\0" * 22 + struct.pack("<I", 1) + b"\0" * 16 + struct.pack("<I", 48) + section
    return compound({"WordDocument": bytes(main), "1Table": clx, "\x05SummaryInformation": summary})


def test_legacy_documents():
    doc = old_doc()
    assert legacy.document_lines(doc) == [("paragraph", "投标函"), ("row", "名称 | 数量"), ("row", "泵 | 3"), ("paragraph", "7 End")]
    assert legacy.document_properties(doc) == {"creator": "张三", "created": "2020-01-01 00:00:00"}
    for broken in (b"", b"x" * 600, doc[:700]):
        with pytest.raises(Exception):  # noqa: B017
            legacy.document_lines(broken)


def pdf():
    z = lambda b: b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(zlib.compress(b)), zlib.compress(b))
    cmap = "1 beginbfchar\n<0001> <6295>\nendbfchar\n1 beginbfrange\n<0002> <0003> <4E00>\nendbfrange".encode()
    inner = b"<< /Type /Pages /Kids [5 0 R 6 0 R 7 0 R] /Resources << /Font << /F1 8 0 R >> >> >>"
    packed = b"2 0 "
    body = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        3: b"<< /Type /ObjStm /N 1 /First %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), zlib.compress(packed + inner)),
        5: b"<< /Type /Page /Contents 10 0 R >>", 6: b"<< /Type /Page /Contents [11 0 R] >>", 7: b"<< /Type /Page >>",
        8: b"<< /Type /Font /ToUnicode 9 0 R >>", 9: z(cmap),
        10: z(b"BT /F1 12 Tf 1 0 0 1 50 700 Tm <00010002> Tj 0 -14 Td [<0003> -300 <0001>] TJ ET"), 11: z(b"BT /F2 10 Tf 50 700 Td (Total \\(a\\)) Tj T* (next) Tj ET"),
    }
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in body.items())


def test_pages_of_a_pdf():
    assert read_pages(pdf()) == ["投一\n丁 投", "Total (a)\nnext", ""]
    assert files.page_lines(pdf(), None)[:3] == [("page", "投一"), ("page", "丁 投"), ("page", "Total (a)")]


def test_page_reader_stops_after_empty_pages():
    pages = ["a\nb"] + [""] * 200 + ["c"]
    assert files.page_lines(b"", lambda _: pages) == [("page", "a"), ("page", "b"), *[("page", "")] * 49]


def test_history_and_cache(spark, tmp_path):
    pairs = spark.createDataFrame([("p1", [("x" * 300,)], "2024-05-01 10:00:00"), ("p2", [], "2024-05-02 10:00:00")], "id string, matches array<struct<text:string>>, at string").withColumn("at", F.to_timestamp("at"))
    store.write_history(pairs, str(tmp_path / "h"), "at")
    (tmp_path / "h/day=2024-05-01/zz.json").write_text("{broken\n")
    back = store.read_history(spark, str(tmp_path / "h"), "id string, matches array<struct<text:string>>")
    assert sorted(r.id for r in back.collect()) == ["p1", "p2"] and len(store.history_entry(back, "id", "p1").first().matches[0].text) == 200
    assert store.history_entry(back, "id", "../p1").count() == 0
    store.delete_history(spark, str(tmp_path / "h"), "id string, matches array<struct<text:string>>", "id", "p1")
    assert [r.id for r in store.read_history(spark, str(tmp_path / "h"), "id string, matches array<struct<text:string>>").collect()] == ["p2"]
    keyed = spark.createDataFrame([("a", "k1"), ("b", "k2"), ("c", "k1")], "path string, cache_key string")
    cache = spark.createDataFrame([("k1", "text")], "cache_key string, text string")
    assert [r.path for r in store.uncached(keyed, cache).collect()] == ["b"] and sorted(r.path for r in store.cached_texts(keyed, cache).collect()) == ["a", "c"]
    store.write_events(keyed, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 3


def test_stream_links_new_to_old(spark, tmp_path):
    schema = "person_id long, bid_group string, phones array<string>, id_numbers array<string>, emails array<string>, bank_accounts array<string>"
    paths = [str(tmp_path / n) for n in ("in", "stored", "links", "ck")]

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(paths[0])
        contact_stream(spark, *paths, schema).awaitTermination()

    arrive([(1, "A", ["1"], None, None, None), (2, "B", ["2"], None, None, None), (1, "A", ["1"], None, None, None)])
    arrive([(3, "C", ["1"], None, ["x"], None)])
    assert [(r.left, r.right, r.value) for r in spark.read.parquet(paths[2]).collect()] == [("A", "C", "1")]


def test_analysis(spark):
    shared = "主泵选用GB-20201型，功率220V，安装后应连续运行七十二小时并记录振动数据"
    rows = [("甲", 1, f"项目名称：某某水厂工程\n电话：010-88886666\n{shared}。\n第一章 总则"), ("乙", 2, "附表"), ("乙", 1, f"联系电话：010-88886666\n{shared}。"), ("丙", 1, None)]
    a = analyze(spark.createDataFrame(rows, "group string, ord int, text string"))
    assert [(r.left, r.right, r.value) for r in a.shared.collect()] == [("乙", "甲", "010-88886666")]
    found = a.found.where("length > 30").collect()
    assert len(found) == 1 and shared in found[0].segment and found[0].abnormal
    assert a.counts.first().total >= 1 and [h.heading for h in a.headings.collect()] == ["第一章 总则"] and a.projects.first()["value"] == "某某水厂工程"
    assert "010-88886666" in report(a)
    ref = spark.createDataFrame([(f"联系电话：010-88886666\n{shared}。",)], "text string")
    b = analyze(spark.createDataFrame(rows, "group string, ord int, text string"), ref)
    assert b.shared.count() == 0 and b.found.where("length > 30 and abnormal").count() == 0
