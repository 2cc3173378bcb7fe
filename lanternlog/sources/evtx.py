"""Event log files (EVTX): chunks, records and their binary XML as JSON.

A file is a header of 4096 bytes and chunks of 64 KiB. A chunk holds whole records with all names and templates that
these refer to, so chunks are decoded apart from each other. Spark reads the files and cuts them into chunks; a
Python task decodes a chunk at a time.

An element is its text, or an object of `#attributes`, its elements and `#text`; an element without any of them is
null. `<Data Name="x">` is named x. Further elements of one name get `_1`, `_2` and so on after it. An array in place
of a text is `{"#text": [...]}`. Attributes without a value are left out.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from typing import Any

FILE_MAGIC, CHUNK_MAGIC, RECORD_MAGIC = b"ElfFile\0", b"ElfChnk\0", b"**\0\0"
FILE_HEADER, CHUNK_BYTES, CHUNK_HEADER, RECORD_HEADER = 4096, 1 << 16, 512, 24
#: Elements, templates and fragments within each other; a record with more of them is broken.
DEEPEST = 64
#: Elements and characters of one event: records have less than 64 KiB, but could repeat a value without end.
LONGEST = 1 << 24

# Tokens of binary XML (the bit 64 says that more of the same follow, or that attributes follow).
END, OPEN, CLOSE_OPEN, CLOSE_EMPTY, CLOSE, VALUE, ATTRIBUTE = 0, 1, 2, 3, 4, 5, 6
CDATA, CHAR_REF, ENTITY_REF, PI_TARGET, PI_DATA = 7, 8, 9, 10, 11
TEMPLATE, SUBSTITUTION, OPTIONAL, FRAGMENT = 12, 13, 14, 15
MORE = 64

# Types of values.
NULL, TEXT, ANSI, BINARY, GUID, SIZE, FILETIME, SYSTEMTIME, SID = 0x00, 0x01, 0x02, 0x0E, 0x0F, 0x10, 0x11, 0x12, 0x13
HEX32, HEX64, NESTED, ARRAY = 0x14, 0x15, 0x21, 0x80
NUMBERS = {
    0x03: "<b", 0x04: "<B", 0x05: "<h", 0x06: "<H", 0x07: "<i", 0x08: "<I",
    0x09: "<q", 0x0A: "<Q", 0x0B: "<f", 0x0C: "<d", 0x0D: "<I",
}
BOOLEAN = 0x0D
WIDTHS = {GUID: 16, FILETIME: 8, SYSTEMTIME: 16, HEX32: 4, HEX64: 8}
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


class EvtxError(ValueError):
    """A file, chunk or record that can't be decoded."""


@dataclass
class Element:
    name: str
    attributes: list[tuple[str, list]] = field(default_factory=list)
    children: list = field(default_factory=list)


@dataclass(frozen=True)
class Place:
    """Where a template takes a record's value."""

    index: int


@dataclass
class Nested:
    """A fragment in place of a value: elements, and the values for them."""

    nodes: list
    values: list


def filetime(ticks: int) -> str:
    """100-nanosecond steps since 1601 as a time of microseconds; what lies past the calendar stays a number."""
    try:
        at = datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=ticks // 10)
    except OverflowError:
        return str(ticks)
    return at.strftime(f"{at.year:04d}-%m-%dT%H:%M:%S.%fZ")


def utf16(data: bytes) -> str:
    return data.decode("utf-16-le", "replace")


class Chunk:
    def __init__(self, data: bytes):
        if data[:8] != CHUNK_MAGIC:
            raise EvtxError("no chunk signature")
        self.data = data
        self.last_record, = struct.unpack_from("<Q", data, 32)
        self.free, = struct.unpack_from("<I", data, 48)
        self.names: dict[int, str] = {}
        self.templates: dict[int, list] = {}

    def number(self, form: str, at: int):
        try:
            return struct.unpack_from(form, self.data, at)[0]
        except struct.error:
            raise EvtxError(f"value at {at} ends past the chunk") from None

    def bytes_at(self, at: int, size: int) -> bytes:
        if at < 0 or size < 0 or at + size > len(self.data):
            raise EvtxError(f"value at {at} ends past the chunk")
        return self.data[at : at + size]

    def name(self, at: int) -> tuple[str, int]:
        """The name that the offset at `at` refers to, and where reading goes on: past the name if it stands there."""
        offset = self.number("<I", at)
        at += 4
        if offset not in self.names:
            self.names[offset] = utf16(self.bytes_at(offset + 8, 2 * self.number("<H", offset + 6)))
        if offset == at:
            at += 8 + 2 * self.number("<H", offset + 6) + 2
        return self.names[offset], at

    def counted_text(self, at: int) -> tuple[str, int]:
        size = 2 * self.number("<H", at)
        return utf16(self.bytes_at(at + 2, size)), at + 2 + size

    def records(self) -> Iterator[tuple[int | None, dict | None, str | None]]:
        """(record id, event, None) or (record id, None, error) of each record, in order.

        A record that can't be decoded is passed over; one whose header is broken ends the chunk.
        """
        at = CHUNK_HEADER
        while at < min(self.free, len(self.data)):
            head = self.data[at : at + RECORD_HEADER]
            if len(head) < RECORD_HEADER or head[:4] != RECORD_MAGIC:
                yield None, None, f"no record signature at {at}"
                return
            size, number, _ = struct.unpack("<IQQ", head[4:])
            if size < RECORD_HEADER + 4 or at + size > len(self.data):
                yield number, None, f"record {number}: its size {size} can't be"
                return
            try:
                nodes, _ = self.nodes(at + RECORD_HEADER, at + size - 4, False, 0)
                yield number, Event().members(nodes), None
            except EvtxError as e:
                yield number, None, f"record {number}: {e}"
            at += size
            if number == self.last_record:
                return

    def nodes(self, at: int, end: int, bare: bool, depth: int) -> tuple[list, int]:
        """The nodes of a fragment, and where it ends. Elements of a bare fragment have no dependency number."""
        if depth > DEEPEST:
            raise EvtxError("too many fragments within each other")
        top = Element("")
        opened, places = [top], None
        while at < end:
            token = self.number("<B", at)
            kind, at = token & ~MORE, at + 1
            into = opened[-1].children if places is None else places
            if kind == END:
                break
            if kind == FRAGMENT:
                at += 3
            elif kind == OPEN:
                if len(opened) > DEEPEST:
                    raise EvtxError("too many elements within each other")
                at += 4 if bare else 6
                name, at = self.name(at)
                at += 4 if token & MORE else 0
                opened[-1].children.append(Element(name))
                opened.append(opened[-1].children[-1])
            elif kind == ATTRIBUTE:
                name, at = self.name(at)
                places = []
                opened[-1].attributes.append((name, places))
            elif kind == CLOSE_OPEN:
                places = None
            elif kind in (CLOSE, CLOSE_EMPTY):
                if len(opened) == 1:
                    raise EvtxError("an element ends that none began")
                places = None
                opened.pop()
            elif kind == VALUE:
                if (given := self.number("<B", at)) != TEXT:
                    raise EvtxError(f"value of type {given} in place of a text")
                text, at = self.counted_text(at + 1)
                into.append(text)
            elif kind == CDATA:
                text, at = self.counted_text(at)
                into.append(text)
            elif kind == CHAR_REF:
                into.append(chr(self.number("<H", at)))
                at += 2
            elif kind == ENTITY_REF:
                name, at = self.name(at)
                into.append(ENTITIES.get(name, f"&{name};"))
            elif kind == PI_TARGET:
                _, at = self.name(at)
            elif kind == PI_DATA:
                _, at = self.counted_text(at)
            elif kind in (SUBSTITUTION, OPTIONAL):
                into.append(Place(self.number("<H", at)))
                at += 3
            elif kind == TEMPLATE:
                found, at = self.instance(at, depth)
                into.append(found)
            else:
                raise EvtxError(f"token {token} at {at - 1} is not known")
        if len(opened) > 1:
            raise EvtxError(f"element {opened[-1].name} has no end")
        return top.children, at

    def instance(self, at: int, depth: int) -> tuple[Nested, int]:
        """A template with its values: the template stands here or was given before in the chunk."""
        offset = self.number("<I", at + 5)
        at += 9
        size = self.number("<I", offset + 20)
        if offset == at:
            at += 24 + size
        if offset not in self.templates:
            self.templates[offset], _ = self.nodes(offset + 24, offset + 24 + size, False, depth + 1)
        count = self.number("<I", at)
        at += 4
        self.bytes_at(at, 4 * count)
        kinds = [(self.number("<H", at + 4 * k), self.number("<B", at + 4 * k + 2)) for k in range(count)]
        at += 4 * count
        values = []
        for size, kind in kinds:
            values.append(self.value(kind, at, size, depth))
            at += size
        return Nested(self.templates[offset], values), at

    def value(self, kind: int, at: int, size: int, depth: int) -> Any:
        data = self.bytes_at(at, size)
        if kind == NESTED:
            return Nested(self.nodes(at, at + size, True, depth + 1)[0], []) if size else None
        if kind & ARRAY:
            return array(kind & ~ARRAY, data)
        return single(kind, data)


def single(kind: int, data: bytes) -> Any:
    try:
        if kind == NULL:
            return None
        if kind == TEXT:
            return utf16(data).rstrip("\0")
        if kind == ANSI:
            return data.decode("cp1252", "replace").rstrip("\0")
        if kind == BINARY:
            return data.hex().upper()
        if not data:
            return None
        if kind in NUMBERS:
            (found,) = struct.unpack(NUMBERS[kind], data)
            if kind == BOOLEAN:
                return found != 0
            return found if found == found and abs(found) != float("inf") else None
        if kind == GUID:
            a, b, c = struct.unpack_from("<IHH", data)
            return f"{a:08X}-{b:04X}-{c:04X}-{data[8:10].hex().upper()}-{data[10:16].hex().upper()}"
        if kind in (SIZE, HEX32, HEX64):
            return hex(int.from_bytes(data, "little"))
        if kind == FILETIME:
            return filetime(struct.unpack("<Q", data)[0])
        if kind == SYSTEMTIME:
            year, month, _, day, hour, minute, second, milli = struct.unpack("<8H", data)
            return f"{year:04d}-{month:02d}-{day:02d}T{hour:02d}:{minute:02d}:{second:02d}.{milli:03d}000Z"
        if kind == SID:
            parts = struct.unpack_from(f"<{data[1]}I", data, 8)
            return "-".join(map(str, ("S", data[0], int.from_bytes(data[2:8], "big"), *parts)))
    except (struct.error, IndexError):
        raise EvtxError(f"{len(data)} bytes for a value of type {kind}") from None
    if kind in (0x20, 0x23):  # handles, and XML that is given as such elsewhere
        return None
    raise EvtxError(f"value of type {kind} is not known")


def array(kind: int, data: bytes) -> list:
    if kind == TEXT:
        parts = utf16(data).split("\0")
    elif kind == ANSI:
        parts = data.decode("cp1252", "replace").split("\0")
    elif kind == SID:
        parts, at = [], 0
        while at + 2 <= len(data):
            size = 8 + 4 * data[at + 1]
            parts.append(single(SID, data[at : at + size]))
            at += size
        return parts
    else:
        width = struct.calcsize(NUMBERS[kind]) if kind in NUMBERS else WIDTHS.get(kind)
        if not width:
            raise EvtxError(f"array of type {kind} is not known")
        return [single(kind, data[k : k + width]) for k in range(0, len(data), width)]
    return parts[:-1] if parts[-1] == "" else parts


def filled(part: Any, values: list) -> Any:
    """What stands at a place: the record's value, or None where it gives none."""
    if isinstance(part, Place):
        return values[part.index] if part.index < len(values) else None
    return part


def plain(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def joined(parts: list) -> Any:
    """One value as it is, several as one text; None for no value."""
    parts = [p for p in parts if p is not None]
    if len(parts) < 2:
        return parts[0] if parts else None
    return "".join(map(plain, parts))


def put(into: dict, name: str, value: Any) -> None:
    key, k = name, 0
    while key in into:
        k += 1
        key = f"{name}_{k}"
    into[key] = value


class Event:
    """The nodes of one record as an object."""

    def __init__(self) -> None:
        self.left = LONGEST

    def members(self, nodes: list) -> dict:
        out: dict = {}
        self.spread(nodes, [], out, [], 0)
        return out

    def spread(self, nodes: list, values: list, into: dict, texts: list, depth: int) -> None:
        if depth > DEEPEST:
            raise EvtxError("too many elements within each other")
        for node in nodes:
            found = filled(node, values)
            self.left -= 1 + (len(found) if isinstance(found, str | list) else 0)
            if self.left < 0:
                raise EvtxError("an event longer than any record can be")
            if isinstance(found, Element):
                put(into, *self.member(found, values, depth + 1))
            elif isinstance(found, Nested):
                self.spread(found.nodes, found.values, into, texts, depth + 1)
            elif found is not None:
                texts.append(found)

    def member(self, element: Element, values: list, depth: int) -> tuple[str, Any]:
        """An element's name and its value."""
        given: dict = {}
        for name, parts in element.attributes:
            found = [filled(p, values) for p in parts]
            self.left -= sum(len(f) if isinstance(f, str | list) else 1 for f in found)
            if (value := joined([f for f in found if not isinstance(f, Nested)])) is not None:
                given[name] = value
        name = element.name
        if name == "Data" and "Name" in given:
            name, given = plain(given["Name"]), {}
        inside: dict = {}
        texts: list = []
        self.spread(element.children, values, inside, texts, depth)
        text = joined(texts)
        out = ({"#attributes": given} if given else {}) | inside
        if not out and not isinstance(text, list):
            return name, text
        return name, out if text is None else out | {"#text": text}


def decode_chunk(data: bytes) -> list[tuple[int | None, str | None, str | None]]:
    """(record id, raw event JSON, None) or (record id or None, None, error) for each record of a chunk.

    A chunk of zeros holds none.
    """
    if not data.strip(b"\0"):
        return []
    try:
        return [
            (number, None if event is None else json.dumps(event, ensure_ascii=False, separators=(",", ":")), error)
            for number, event, error in Chunk(data).records()
        ]
    except (EvtxError, struct.error) as e:
        return [(None, None, str(e))]
