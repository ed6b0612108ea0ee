"""Legacy Word files (compound binary files): their text in document order and their properties, by the standard library."""

from __future__ import annotations

import re
import struct
from datetime import datetime, timedelta

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
FREE = 0xFFFFFFFA  # sector numbers from here on are marks
# Numbers of the standard properties.
SUMMARY = {2: "title", 3: "subject", 4: "creator", 5: "keywords", 6: "description", 7: "template", 8: "last_modified_by", 9: "revision", 12: "created", 13: "modified", 14: "pages", 15: "words", 18: "application"}
DOCUMENT_SUMMARY = {2: "category", 14: "manager", 15: "company"}


class Compound:
    """The streams of a compound file by name."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a compound file")
        self.data = data
        self.size = 1 << struct.unpack_from("<H", data, 30)[0]
        self.small = 1 << struct.unpack_from("<H", data, 32)[0]
        (root, _, self.cutoff, mini, _, more, _) = struct.unpack_from("<7I", data, 48)
        fat_sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < FREE]
        seen: set[int] = set()
        while more < FREE and more not in seen:
            seen.add(more)
            part = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            fat_sectors += [s for s in part[:-1] if s < FREE]
            more = part[-1]
        self.fat = [n for s in fat_sectors for n in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        self.entries: dict[str, tuple[int, int]] = {}
        directory, first = self._chain(root), None
        for at in range(0, len(directory), 128):
            length, kind = struct.unpack_from("<HB", directory, at + 64)
            start, size = struct.unpack_from("<IQ", directory, at + 116)
            name = directory[at : at + max(0, min(64, length) - 2)].decode("utf-16-le", "replace")
            if kind == 5:
                first = (start, size)
            elif kind == 2:
                self.entries.setdefault(name, (start, size & 0xFFFFFFFF))
        self.minifat = list(struct.unpack(f"<{len(m) // 4}I", m)) if (m := self._chain(mini)) else []
        self.ministream = self._chain(first[0]) if first else b""

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size].ljust(self.size, b"\0")

    def _chain(self, start: int) -> bytes:
        out, seen = [], set()
        while start < FREE and start < len(self.fat) and start not in seen:
            seen.add(start)
            out.append(self._sector(start))
            start = self.fat[start]
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            return b""
        start, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], set()
        while start < len(self.minifat) and start not in seen:
            seen.add(start)
            out.append(self.ministream[start * self.small : (start + 1) * self.small])
            start = self.minifat[start]
        return b"".join(out)[:size]


def document_text(data: bytes) -> str:
    """The characters of a Word file by its piece table, marks included."""
    file = Compound(data)
    main = file.stream("WordDocument")
    if len(main) < 0x1AA or struct.unpack_from("<H", main)[0] != 0xA5EC:
        raise ValueError("no Word text")
    flags = struct.unpack_from("<H", main, 0x0A)[0]
    if flags & 0x0100:
        raise ValueError("the file is encrypted")
    table = file.stream("1Table" if flags & 0x0200 else "0Table")
    at, size = struct.unpack_from("<II", main, 0x01A2)
    clx, i = table[at : at + size], 0
    while i < len(clx) and clx[i] == 1:
        i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
    if i >= len(clx) or clx[i] != 2:
        raise ValueError("no piece table")
    pieces = clx[i + 5 : i + 5 + struct.unpack_from("<I", clx, i + 1)[0]]
    n = (len(pieces) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", pieces)
    out = []
    for k in range(n):
        place = struct.unpack_from("<I", pieces, 4 * (n + 1) + 8 * k + 2)[0]
        count = ends[k + 1] - ends[k]
        if place & 0x40000000:
            start = (place & 0x3FFFFFFF) // 2
            out.append(main[start : start + count].decode("cp1252", "replace"))
        else:
            out.append(main[place : place + 2 * count].decode("utf-16-le", "replace"))
    return "".join(out)


def document_lines(data: bytes) -> list[tuple[str, str]]:
    """(kind, text) of paragraphs and table rows in order; instructions of fields are left out, their results stay."""
    text = re.sub("\x13[^\x13\x14\x15]*(?:\x14|(?=\x15))", "", document_text(data)).replace("\x15", "").replace("\x14", "")
    out: list[tuple[str, str]] = []
    row: list[str] = []
    for content, mark in re.findall("([^\r\x07\x0c]*)(\r|\x07|\x0c|$)", text.replace("\x0b", "\n")):
        content = re.sub("[\x00-\x08\x0e-\x1f]", "", content).strip()
        if mark != "\x07":
            out += [("paragraph", line.strip()) for line in content.split("\n") if line.strip()]
            continue
        if content or not row:
            row.append(content.replace("\n", " "))
        else:  # an empty mark after cells ends the row
            out.append(("row", " | ".join(row)))
            row = []
    if any(row):
        out.append(("row", " | ".join(row)))
    return [line for line in out if line[1].strip(" |")]


def _value(section: bytes, at: int, encoding: str) -> str | None:
    kind = struct.unpack_from("<I", section, at)[0] & 0xFFF
    if kind == 30:
        size = struct.unpack_from("<I", section, at + 4)[0]
        raw = section[at + 8 : at + 8 + size]
        return (raw.decode("utf-16-le", "replace") if encoding == "utf-16-le" else raw.decode(encoding, "replace")).split("\0", 1)[0]
    if kind == 31:
        size = struct.unpack_from("<I", section, at + 4)[0]
        return section[at + 8 : at + 8 + 2 * size].decode("utf-16-le", "replace").split("\0", 1)[0]
    if kind == 64:
        ticks = struct.unpack_from("<Q", section, at + 4)[0]
        return (datetime(1601, 1, 1) + timedelta(microseconds=ticks // 10)).strftime("%Y-%m-%d %H:%M:%S") if ticks else None
    if kind in (2, 3, 19, 22):
        return str(struct.unpack_from("<h" if kind == 2 else "<i", section, at + 4)[0])
    return None


def property_set(stream: bytes, names: dict[int, str]) -> dict[str, str]:
    """The properties of a property-set stream by name: the known ones of its first section, and those that a dictionary in
    a later section names."""
    if len(stream) < 48 or stream[:2] != b"\xfe\xff":
        return {}
    out: dict[str, str] = {}
    for s in range(min(2, struct.unpack_from("<I", stream, 24)[0])):
        section = stream[struct.unpack_from("<I", stream, 44 + 20 * s)[0] :]
        count = struct.unpack_from("<I", section, 4)[0]
        places = dict(struct.unpack_from("<II", section, 8 + 8 * k) for k in range(count))
        page = struct.unpack_from("<H", section, places[1] + 4)[0] if 1 in places else 1252
        encoding = {65001: "utf-8", 1200: "utf-16-le", 936: "gb18030"}.get(page, f"cp{page}")
        known = dict(names) if s == 0 else {}
        if s and 0 in places:
            at = places[0] + 4
            for _ in range(struct.unpack_from("<I", section, places[0])[0]):
                pid, size = struct.unpack_from("<II", section, at)
                width = 2 * size + (-2 * size) % 4 if page == 1200 else size
                known[pid] = section[at + 8 : at + 8 + width].decode(encoding, "replace").split("\0", 1)[0]
                at += 8 + width
        for pid, name in known.items():
            if pid in places and (value := _value(section, places[pid], encoding)):
                clean = re.split("[\x00-\x08\x0b\x0c\x0e-\x1f]", value, maxsplit=1)[0].strip()  # what follows a control character is junk
                if clean:
                    out[name] = clean
    return out


def document_properties(data: bytes) -> dict[str, str]:
    file = Compound(data)
    return property_set(file.stream("\x05SummaryInformation"), SUMMARY) | property_set(file.stream("\x05DocumentSummaryInformation"), DOCUMENT_SUMMARY)
