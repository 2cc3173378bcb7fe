"""Event logs: files are made here, byte by byte, and read back through Spark."""

import json
import os
import struct
import uuid

import pytest

from lanternlog.__main__ import main
from lanternlog.operators import report
from lanternlog.operators.search import search
from lanternlog.sources.events import bad_lines, discover, read_events
from lanternlog.sources.evtx import Chunk, decode_chunk

FRAGMENT = b"\x0f\x01\x01\x00"
XMLNS = "http://schemas.microsoft.com/win/2004/08/events/event"
GUID = uuid.UUID("54849625-5478-4994-a5ba-3e3b0328c30d")


def text(value):
    return value.encode("utf-16-le")


class Writer:
    """One chunk. A name or a template stands where it is first used; later uses refer to it."""

    def __init__(self, first=1):
        self.data, self.names, self.templates, self.first, self.record = bytearray(512), {}, {}, first, first - 1

    def name(self, name):
        if name in self.names:
            return self.u("<I", self.names[name])
        self.names[name] = len(self.data) + 4
        self.u("<I", self.names[name])
        self.data += struct.pack("<IHH", 0, 0, len(name)) + text(name) + b"\0\0"

    def u(self, form, *values):
        self.data += struct.pack(form, *values)

    def part(self, part):
        if isinstance(part, int):
            self.u("<BHB", 0x0E, part, 0)
        elif part.startswith("&"):
            self.u("<B", 0x09)
            self.name(part[1:])
        else:
            self.u("<BBH", 0x05, 1, len(part))
            self.data += text(part)

    def element(self, element, bare=False):
        """(name, {attribute: part}, [element or part])"""
        name, attributes, children = element
        self.u("<B", 0x41 if attributes else 0x01)
        if not bare:
            self.u("<H", 0xFFFF)
        self.u("<I", 0)
        self.name(name)
        if attributes:
            self.u("<I", 0)
        for k, (attribute, part) in enumerate(attributes.items()):
            self.u("<B", 0x06 if k + 1 == len(attributes) else 0x46)
            self.name(attribute)
            self.part(part)
        if not children:
            self.u("<B", 0x03)
            return
        self.u("<B", 0x02)
        for child in children:
            self.element(child, bare) if isinstance(child, tuple) else self.part(child)
        self.u("<B", 0x04)

    def instance(self, key, element, values):
        """values: (type, bytes), or (0x21, a function that writes them)"""
        self.u("<BBI", 0x0C, 1, 7)
        if key in self.templates:
            self.u("<I", self.templates[key])
        else:
            self.templates[key] = len(self.data) + 4
            self.u("<I", self.templates[key])
            self.data += bytes(20)
            size_at = len(self.data)
            self.u("<I", 0)
            self.data += FRAGMENT
            self.element(element)
            self.u("<B", 0)
            struct.pack_into("<I", self.data, size_at, len(self.data) - size_at - 4)
        self.u("<I", len(values))
        kinds_at = len(self.data)
        self.data += bytes(4 * len(values))
        for k, (kind, value) in enumerate(values):
            before = len(self.data)
            if callable(value):
                value()
            else:
                self.data += value
            struct.pack_into("<HBB", self.data, kinds_at + 4 * k, len(self.data) - before, kind, 0)

    def event(self, key, element, values, number=None):
        self.record += 1
        at = len(self.data)
        self.data += b"**\0\0" + bytes(20) + FRAGMENT
        self.instance(key, element, values)
        self.u("<B", 0)
        size = len(self.data) - at + 4
        self.u("<I", size)
        struct.pack_into("<IQQ", self.data, at + 4, size, number or self.record, 0)
        return at

    def chunk(self):
        out = bytearray(self.data).ljust(1 << 16, b"\0")
        assert len(out) == 1 << 16
        out[:8] = b"ElfChnk\0"
        struct.pack_into("<QQQQIIII", out, 8, 1, self.record, self.first, self.record, 128, 0, len(self.data), 0)
        return bytes(out)


EVENT = (
    "Event", {"xmlns": XMLNS}, [
        ("System", {}, [
            ("Provider", {"Name": 0, "Guid": 1}, []),
            ("EventID", {"Qualifiers": 2}, [3]),
            ("Keywords", {}, [4]),
            ("TimeCreated", {"SystemTime": 5}, []),
            ("EventRecordID", {}, [6]),
            ("Correlation", {"ActivityID": 7}, []),
            ("Channel", {}, ["Sec", "&amp", "urity"]),
            ("Computer", {}, ["host"]),
            ("Security", {"UserID": 8}, []),
        ]),
        9,
    ],
)
DATA = ("EventData", {}, [("Data", {"Name": "User"}, [0]), ("Data", {"Name": "Port"}, [1]), ("Data", {"Name": "Empty"}, [2])])
NULL = (0, b"")
#: 2024-01-01T00:00:00.000001Z
TICKS = 133485408000000010


def sid(*parts):
    return b"\x01" + bytes([len(parts)]) + b"\0\0\0\0\0\x05" + struct.pack(f"<{len(parts)}I", *parts)


def values(event_id, record, data, qualifiers=NULL):
    return [
        (0x01, text("Prov")), (0x0F, GUID.bytes_le), qualifiers, (0x06, struct.pack("<H", event_id)),
        (0x15, struct.pack("<Q", 0x8020000000000000)), (0x11, struct.pack("<Q", TICKS + 10_000_000 * record)),
        (0x0A, struct.pack("<Q", record)), NULL, (0x13, sid(18)), data,
    ]


def logon(w, user, port, event_id=4624, **more):
    def data():
        w.data.extend(FRAGMENT)
        w.instance("data", DATA, [(0x01, text(user)), (0x06, struct.pack("<H", port)), NULL])
        w.u("<B", 0)

    return w.event("event", EVENT, values(event_id, w.record + 1, (0x21, data)), **more)


def log_file(path, *chunks):
    path.write_bytes(b"ElfFile\0".ljust(4096, b"\0") + b"".join(chunks))


def decoded(w):
    return [(n, json.loads(raw) if raw else None, error) for n, raw, error in decode_chunk(w.chunk())]


def test_event():
    w = Writer()
    logon(w, "añ", 443)
    logon(w, "b\0", 0)
    (n, event, error), (_, again, _) = decoded(w)
    assert (n, error) == (1, None)
    assert event == {
        "Event": {
            "#attributes": {"xmlns": XMLNS},
            "System": {
                "Provider": {"#attributes": {"Name": "Prov", "Guid": str(GUID).upper()}},
                "EventID": 4624,
                "Keywords": "0x8020000000000000",
                "TimeCreated": {"#attributes": {"SystemTime": "2024-01-01T00:00:01.000001Z"}},
                "EventRecordID": 1,
                "Correlation": None,
                "Channel": "Sec&urity",
                "Computer": "host",
                "Security": {"#attributes": {"UserID": "S-1-5-18"}},
            },
            "EventData": {"User": "añ", "Port": 443, "Empty": None},
        }
    }
    assert again["Event"]["EventData"] == {"User": "b", "Port": 0, "Empty": None}


def test_forms_of_values():
    kinds = [
        (0x02, b"caf\xe9\0"), (0x03, b"\xff"), (0x07, struct.pack("<i", -5)), (0x0C, struct.pack("<d", 0.5)),
        (0x0B, struct.pack("<f", float("nan"))), (0x0D, b"\1\0\0\0"), (0x0E, b"\x0a\xff"), (0x10, b"\x10\0\0\0"),
        (0x12, struct.pack("<8H", 2024, 2, 4, 29, 23, 59, 58, 7)), (0x14, b"\xff\0\0\0"), (0x81, text("a\0\0b\0")),
        (0x88, struct.pack("<2I", 7, 8)), (0x8F, GUID.bytes_le), (0x93, sid(1, 2) + sid(3)), (0x01, b""), (0x0A, b""),
        (0x11, b"\xff" * 8), (0x20, b"1234"),
    ]
    w = Writer()
    w.event("t", ("E", {}, [("V", {}, [k]) for k in range(len(kinds))] + [("Q", {"a": 1}, [2])]), kinds)
    ((_, event, _),) = decoded(w)
    found = event["E"]
    assert [found["V" + (f"_{k}" if k else "")] for k in range(len(kinds))] == [
        "café", -1, -5, 0.5, None, True, "0AFF", "0x10", "2024-02-29T23:59:58.007000Z", "0xff", {"#text": ["a", "", "b"]},
        {"#text": [7, 8]}, {"#text": [str(GUID).upper()]}, {"#text": ["S-1-5-1-2", "S-1-5-3"]}, "", None, str(2**64 - 1), None,
    ]
    assert found["Q"] == {"#attributes": {"a": -1}, "#text": -5}


def test_elements_in_values_have_no_dependency_number():
    w = Writer()

    def data():
        w.data.extend(FRAGMENT)
        w.element(("UserData", {}, [("Item", {"k": "1"}, ["x"])]), bare=True)
        w.u("<B", 0)

    w.event("event", EVENT, values(1, 1, (0x21, data), qualifiers=(0x06, b"\5\0")))
    ((_, event, _),) = decoded(w)
    assert event["Event"]["UserData"] == {"Item": {"#attributes": {"k": "1"}, "#text": "x"}}
    assert event["Event"]["System"]["EventID"] == {"#attributes": {"Qualifiers": 5}, "#text": 1}


def test_broken_records():
    w = Writer()
    starts = [logon(w, "u", k) for k in range(4)]
    w.data[starts[1] + 28] = 0x3F  # no token
    found = decoded(w)
    assert [n for n, _, _ in found] == [1, 2, 3, 4]
    assert [e is None for _, _, e in found] == [True, False, True, True]
    struct.pack_into("<I", w.data, starts[2] + 4, 1 << 20)
    assert [e is None for _, _, e in decoded(w)] == [True, False, False]
    assert decode_chunk(bytes(1 << 16)) == []
    assert decode_chunk(b"x" * (1 << 16)) == [(None, None, "no chunk signature")]
    assert len(decode_chunk(w.chunk()[:600])) == 1


def test_every_changed_byte_gives_records_or_errors():
    w = Writer()
    logon(w, "u", 1)
    logon(w, "v", 2)
    whole, end = w.chunk(), len(w.data)
    for at in range(512, end):
        for value in (0, 0x0C, 0x41, 0xFF):
            data = bytearray(whole)
            data[at] = value
            assert decode_chunk(bytes(data))


def test_values_that_would_repeat_without_end():
    w = Writer()

    def level(k):
        def data():
            w.data.extend(FRAGMENT)
            inner = (0x21, level(k - 1)) if k else (0x01, text("x" * 100))
            w.instance("many", ("M", {}, [0] * 60), [inner])
            w.u("<B", 0)

        return data

    w.event("event", EVENT, values(1, 1, (0x21, level(8))))
    logon(w, "u", 1)
    (_, none, error), (_, event, _) = decoded(w)
    assert none is None and "longer" in error and event["Event"]["EventData"]["User"] == "u"

    loop = Writer()
    at = loop.event("t", ("E", {}, [0]), [NULL])
    here = loop.data.index(b"\x0e\x00\x00\x00", at)
    loop.data[here : here + 10] = struct.pack("<BBII", 0x0C, 1, 7, loop.templates["t"])
    assert decoded(loop)[0][2]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("event logs+")
    first, second, other = Writer(), Writer(first=71), Writer()
    for k in range(70):
        logon(first, f"u{k % 3}", k)
    broken = [logon(second, f"w{k}", k, event_id=4625) for k in range(5)][2]
    second.data[broken + 28] = 0x3F
    logon(other, "z", 9)
    # More chunks than one run has; those of zeros hold no record. What follows the last whole chunk is passed over.
    log_file(top / "b.evtx", first.chunk(), *[bytes(1 << 16)] * 70, second.chunk(), b"rest")
    log_file(top / "A.EVTX", other.chunk())
    log_file(top / "empty.evtx")
    return str(top)


def test_events(spark, folder):
    inputs = discover([folder])
    events = read_events(spark, inputs)
    rows = events.orderBy("file_seq", "rec_seq").collect()
    assert [r.record_id for r in rows] == [1, *range(1, 73), 74, 75]
    assert [os.path.basename(r.file_path) for r in rows] == ["A.EVTX"] + ["b.evtx"] * 74
    head = rows[1]
    assert (head.timestamp, head.channel, head.provider) == ("2024-01-01T00:00:01.000001Z", "Sec&urity", "Prov")
    assert (head.event_id, head.computer, head.collection_root) == (4624, "host", folder)
    found = search(events, 'event.id == 4624 and Event.EventData.User == "u1" | keep Event.EventData.Port').collect()
    assert len(found) == len([k for k in range(70) if k % 3 == 1])
    assert read_events(spark, [i for i in inputs if i[0].endswith("empty.evtx")]).count() == 0
    assert read_events(spark, [i for i in inputs if "A." in i[0]] * 2).count() == 2


def test_record_numbers_are_those_of_the_headers(spark, tmp_path):
    w = Writer()
    logon(w, "u", 1, number=500)
    logon(w, "u", 1, number=1 << 63)
    log_file(tmp_path / "a.evtx", w.chunk())
    rows = read_events(spark, discover([str(tmp_path)])).orderBy("rec_seq").collect()
    assert [r.record_id for r in rows] == [500, 2]


def test_errors(spark, folder, tmp_path):
    inputs = discover([folder])
    (bad,) = bad_lines(spark, inputs).collect()
    assert os.path.basename(bad.file_path) == "b.evtx" and bad.error.startswith("record 73: ")
    with pytest.raises(Exception, match="bad record in .*b.evtx: record 73"):
        read_events(spark, inputs, strict=True).collect()
    stats = report.search_stats(spark, inputs, "event.id == 4625")
    assert stats.counts == {"scanned": 75, "matched": 4, "parse_errors": 1} and len(stats.samples) == 1
    (tmp_path / "x.evtx").write_bytes(b"")
    assert read_events(spark, discover([str(tmp_path)])).count() == 0
    for data in (b"ElfFile\0", b"no event log".ljust(8192)):
        (tmp_path / "x.evtx").write_bytes(data)
        with pytest.raises(Exception, match="no event log"):
            read_events(spark, discover([str(tmp_path)])).collect()


def test_command_line(spark, folder, tmp_path, capsys):
    assert main(["search", folder, "--query", 'Event.EventData.User == "z"', "--errors", str(tmp_path / "e.jsonl")]) == 0
    (row,) = map(json.loads, capsys.readouterr().out.splitlines())
    assert row["record_id"] == 1
    assert len((tmp_path / "e.jsonl").read_text().splitlines()) == 1


def test_names_are_read_once():
    w = Writer()
    logon(w, "u", 1)
    c = Chunk(w.chunk())
    list(c.records())
    assert sorted(c.names.values()) == sorted(w.names)
