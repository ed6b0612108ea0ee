"""Text of PDF pages by the standard library: objects, also in compressed streams, the pages in order, and what their text
operators show by the fonts' maps to Unicode. Pages without such text (scans) come out empty; encrypted files are an
error. A plug-in with a full reader may take its place (``page_reader``)."""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|-?[\d.]+|[A-Za-z'\"*]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflated(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    raw, head = m[1], body[: m.start()]
    if b"FlateDecode" in head:
        try:
            raw = zlib.decompressobj().decompress(raw)
        except zlib.error:
            return b""
    return raw


def objects(data: bytes) -> dict[int, bytes]:
    out = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(out.values()):
        if b"/ObjStm" in body and (first := re.search(rb"/First\s+(\d+)", body)):
            raw, at = _inflated(body), int(first[1])
            numbers = [int(x) for x in raw[:at].split()]
            places = numbers[1::2] + [len(raw) - at]
            for n, a, b in zip(numbers[::2], places, places[1:], strict=False):
                out.setdefault(n, raw[at + a : at + b])
    return out


def _entry(body: bytes, name: bytes, known: dict[int, bytes]) -> bytes:
    """What stands after a name in a dictionary, a reference followed."""
    m = re.search(rb"/" + name + rb"\b\s*(\d+\s+\d+\s+R|<<.*?>>|\[.*?\])", body, re.S)
    if not m:
        return b""
    ref = re.fullmatch(rb"(\d+)\s+\d+\s+R", m[1])
    return known.get(int(ref[1]), b"") if ref else m[1]


def _pages(known: dict[int, bytes]) -> list[bytes]:
    """Page dictionaries in the order of the tree, with the resources they inherit."""
    root = next((b for b in known.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    out: list[bytes] = []

    def walk(body: bytes, inherited: bytes, depth: int) -> None:
        own = re.search(rb"/Resources\b", body)
        resources = inherited if not own else _entry(body, b"Resources", known)
        if re.search(rb"/Type\s*/Page\b", body):
            out.append(body if own else body + b" /Resources " + resources)
        elif depth < 50:
            for ref in _REF.findall(_entry(body, b"Kids", known)):
                walk(known.get(int(ref), b""), resources, depth + 1)

    walk(_entry(root, b"Pages", known), b"", 0)
    return out or [b for b in known.values() if re.search(rb"/Type\s*/Page\b", b)]


def _characters(raw: bytes) -> str:
    return bytes.fromhex(raw.decode()).decode("utf-16-be", "replace")


def _unicode_map(cmap: bytes) -> tuple[int, dict[int, str]]:
    """(bytes a code, code -> text) of a font's map to Unicode."""
    out: dict[int, str] = {}
    width = 1
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, text in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(code, 16)] = _characters(text)
            width = max(width, len(code) // 2)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for lo, hi, single, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            width = max(width, len(lo) // 2)
            texts = [_characters(x) for x in re.findall(rb"<([0-9A-Fa-f]+)>", many)]
            for n, code in enumerate(range(int(lo, 16), min(int(hi, 16), int(lo, 16) + 0xFFFF) + 1)):
                out[code] = texts[n] if n < len(texts) else (t := _characters(single))[:-1] + chr(ord(t[-1]) + n) if single else ""
    return width, out


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def escaped(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x.isdigit() else _ESCAPES.get(x, b"" if x in b"\r\n" else x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", escaped, token[1:-1], flags=re.S)


def page_text(page: bytes, known: dict[int, bytes]) -> str:
    resources = _entry(page, b"Resources", known)
    fonts: dict[bytes, tuple[int, dict[int, str]]] = {}
    for name, ref in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", _entry(resources, b"Font", known)):
        if m := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", known.get(int(ref), b"")):
            fonts[name] = _unicode_map(_inflated(known.get(int(m[1]), b"")))
    entry = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
    content = b"\n".join(_inflated(known.get(int(r), b"")) for r in _REF.findall(entry[1])) if entry else b""
    lines, line, font, stack, height = [], [], (1, {}), [], None
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<[]/-.0123456789":
            stack.append(token)
            continue
        if token == b"Tf":
            font = next((fonts.get(t[1:], (1, {})) for t in reversed(stack) if t[:1] == b"/"), font)
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            if token in b"'\"":
                lines, line = [*lines, "".join(line)], []
            for t in stack:
                if t[:1] in b"(<":
                    raw, (width, codes) = _string(t), font
                    line.append("".join(codes.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width)) if codes else raw.decode("cp1252", "replace"))
                elif token == b"TJ" and t[:1] == b"-" and t[1:].replace(b".", b"").isdigit() and float(t) < -200 and line:
                    line.append(" ")
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            numbers = [float(t) for t in stack if re.fullmatch(rb"-?\d*\.?\d+", t)]
            moved = token == b"T*" or token in (b"Td", b"TD") and len(numbers) >= 2 and numbers[-1] != 0 or token == b"Tm" and len(numbers) >= 6 and numbers[-1] != height
            height = numbers[-1] if token == b"Tm" and numbers else height
            if moved and line:
                lines, line = [*lines, "".join(line)], []
        stack = []
    return "\n".join([*lines, "".join(line)] if line else lines).strip("\n")


def read_pages(data: bytes) -> list[str]:
    """The text of each page, empty where a page shows none by the means above."""
    if b"/Encrypt" in data:
        raise ValueError("the file is encrypted")
    known = objects(data)
    return [page_text(p, known) for p in _pages(known)]
