"""Inputs, sinks, rule files, reports and the command line, on small files."""

import json
import os

import pytest

from lanternlog.__main__ import main
from lanternlog.operators import report
from lanternlog.operators.search import alerts, nested_summary, record_shape, rule_matches, search
from lanternlog.plans.sigma import RuleError, load_rules, parse_documents, parse_predicate, selected
from lanternlog.plans.stql import QueryError, parse
from lanternlog.sources.events import DiscoveryError, bad_lines, discover, read_events, read_jsonl
from lanternlog.sources.sinks import SinkError, dump


def record(k, **data):
    return {
        "timestamp": f"2024-01-01T00:00:{k:02d}.000000Z", "record_id": k, "provider": "P", "provider_guid": "{g}",
        "channel": "Security", "computer": f"h{k % 2}", "event_id": 4624 + k % 2, "event_data": data,
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("events and more")
    (top / "sub").mkdir()
    for name, first in (("b+1.jsonl", 0), ("a.jsonl", 10), ("sub/c.jsonl", 20)):
        lines = [json.dumps(record(first + k, User=f"u{k}", Note='a,"b"' if k == 3 else "", Nr=str(k))) for k in range(6)]
        lines[2:2] = ["", "no json"] if name == "a.jsonl" else []
        (top / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    (top / "other.txt").write_text("x")
    return str(top)


def names(found):
    return [os.path.basename(p) for p, _ in found]


def test_discovery(folder, tmp_path, monkeypatch):
    assert names(discover([folder])) == ["a.jsonl", "b+1.jsonl", "c.jsonl"]
    assert {r for _, r in discover([folder])} == {folder}
    assert names(discover([folder], recursive=False)) == ["a.jsonl", "b+1.jsonl"]
    assert names(discover([folder], include=("*/{a,c}.jsonl",), exclude=("*sub*",))) == ["a.jsonl"]
    listed = tmp_path / "list"
    listed.write_text(f"# files\n\n {folder}/a.jsonl \n{folder}/a.jsonl\n")
    assert names(discover(paths_from=str(listed))) == ["a.jsonl", "a.jsonl"]
    monkeypatch.chdir(folder)
    assert names(discover()) == ["a.jsonl", "b+1.jsonl", "c.jsonl"]
    for bad in ({"roots": [folder + "/nope"]}, {"paths_from": "nope"}, {"roots": [folder], "include": ("[a",)}):
        with pytest.raises(DiscoveryError):
            discover(**bad)


def test_lines_keep_their_order_and_duplicates(spark, folder):
    events = read_events(spark, discover([folder]), source_records=True)
    assert [r.record_id for r in events.orderBy("file_seq", "rec_seq").collect()] == [*range(10, 16), *range(6), *range(20, 26)]
    row = events.orderBy("file_seq", "rec_seq").first()
    assert (row.timestamp, row.channel, row.provider, row.event_id, row.computer) == ("2024-01-01T00:00:10.000000Z", "Security", "P", 4624, "h0")
    assert row.file_path.endswith("a.jsonl") and row.collection_root == folder
    twice = [(f"{folder}/a.jsonl", folder)] * 2
    assert read_events(spark, twice, source_records=True).count() == 12
    assert read_events(spark, []).count() == 0


def test_split_files_are_in_order(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    path.write_text("".join(json.dumps(record(k % 60) | {"record_id": k}) + "\n" for k in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "70000")
    try:
        events = read_jsonl(spark, [(str(path), "")], source_records=True)
        assert events.rdd.getNumPartitions() > 3
        assert [r.record_id for r in events.orderBy("rec_seq").select("record_id").collect()] == list(range(4000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bad_lines(spark, folder, tmp_path):
    inputs = discover([folder])
    found = bad_lines(spark, inputs).collect()
    assert [(os.path.basename(r.file_path), r.error) for r in found] == [("a.jsonl", "invalid JSON record: no json")]
    with pytest.raises(Exception, match="bad record in .*a.jsonl"):
        read_jsonl(spark, inputs, strict=True).collect()
    for name in ("x.evtx", "x.parquet"):
        with pytest.raises(DiscoveryError):
            read_jsonl(spark, [(str(tmp_path / name), "")])


def test_parquet_input(spark, tmp_path):
    raw = [json.dumps({"Event": {"System": {"EventID": {"#text": {"#text": "7"}}, "EventRecordID": k, "Computer": None}}}) for k in range(5)]
    spark.createDataFrame([(r,) for r in [*raw, "no json"]], "raw_json string").coalesce(1).write.parquet(str(tmp_path / "p"))
    events = read_events(spark, discover([str(tmp_path / "p")]))
    rows = events.orderBy("file_seq", "rec_seq").collect()
    assert [(r.event_id, r.record_id, r.computer) for r in rows] == [(7, k, None) for k in range(5)]


def test_dump_forms(spark, folder, tmp_path):
    events = read_events(spark, [(f"{folder}/b+1.jsonl", folder)], source_records=True).orderBy("rec_seq")
    data = "Event.EventData."
    rows = record_shape(events, [data + "Note"])
    path = str(tmp_path / "x")
    assert dump(rows, path, "csv", [data + "Note"]) == 6
    assert open(path).read() == f'{data}Note\n\n\n\n"a,""b"""\n\n\n'
    assert dump(rows, str(tmp_path / "csv"), "csv", [data + "Note"], parts=True) == 6
    assert dump(rows, path, "jsonl") == 6
    one = json.loads(open(path).readline())
    assert one["record_id"] == 0 and one["fields"] == {data + "Note": ""} and one["source"]["collection_root"] == folder
    assert dump(rows, str(tmp_path / "parts"), "jsonl", parts=True) == 6
    assert spark.read.text(str(tmp_path / "parts")).count() == 6
    for pretty, compact in ((False, False), (True, False), (True, True)):
        assert dump(rows, path, "json", pretty=pretty, compact=compact) == 6
        assert len(json.load(open(path))) == 6
        assert (len(open(path).readlines()) > 5) == (pretty and not compact)
    raw = record_shape(events, raw=True)
    assert dump(raw, path, "jsonl", raw=True) == 6
    assert json.loads(open(path).readline())["raw"]["Event"]["EventData"]["User"] == "u0"
    for form, fields, where in (("csv", None, path), ("xml", None, path), ("jsonl", None, str(tmp_path / "no" / "x"))):
        with pytest.raises(SinkError):
            dump(rows, where, form, fields)


def test_search_shapes(spark, folder):
    events = read_events(spark, discover([folder]), source_records=True)
    query = 'channel == "Security" | summarize n=count(), s=make_set(Event.EventData.Nr, 2) by computer, t=Event.EventData.Nope'
    rows = search(events, query).collect()
    assert [(r.computer, r.t, r.n, r.s) for r in rows] == [("h0", None, 9, ["0", "2"]), ("h1", None, 9, ["1", "3"])]
    nested = nested_summary(search(events, query), parse(query).summarize).first().asDict(recursive=True)
    assert nested == {"groups": {"computer": "h0", "t": None}, "aggregates": {"n": 9, "s": ["0", "2"]}}
    groups = [r.g for r in search(events, "record_id >= 0 | summarize by g=Event.EventData.Note").collect()]
    assert groups == ["", 'a,"b"']
    over = search(events, "record_id >= 0 | keep computer", fields=["Event.EventData.User"], limit=2).collect()
    assert [r.fields.asDict() for r in over] == [{"Event.EventData.User": "u0"}, {"Event.EventData.User": "u1"}]
    with pytest.raises(QueryError):
        parse("record_id >= 0 | summarize sum(x)")


RULE = """
title: One
id: r1
status: test
level: high
tags: [attack.t1, x]
detection: {sel: {EventID: 4624}, condition: sel}
---
title: Two
level: low
detection: {sel: {'User|contains': U1}, condition: sel}
"""


def test_rules(spark, folder, tmp_path):
    (tmp_path / "good.yml").write_text(RULE)
    (tmp_path / "bad.yaml").write_text("title: x\ndetection: {sel: {'a|expand': b}, condition: sel}\n")
    (tmp_path / "note.txt").write_text("x")
    with pytest.raises(RuleError):
        load_rules([str(tmp_path)])
    rules, skipped = load_rules([str(tmp_path)], strict=False)
    assert [r.title for r in rules] == ["One", "Two"] and skipped == 1
    cases = [
        ({}, [True, True]), ({"status": ("TEST",)}, [True, False]), ({"level": ("low",)}, [False, True]), ({"tag": ("X",)}, [True, False]),
        ({"min_level": "medium"}, [True, False]), ({"exclude": ("T?o",)}, [True, False]), ({"exclude": ("{One,x}",)}, [False, True]),
        ({"exclude": ("*/good.yml",)}, [False, False]), ({"exclude": ("[A-O]ne",)}, [False, True]),
    ]
    for given, wanted in cases:
        assert selected(rules, **given) == wanted
    with pytest.raises(RuleError):
        selected(rules, min_level="huge")
    for key, value in [("a|nope", "x"), ("a|re", "(?=x)"), ("a|cidr", "x"), ("a|gte", "x"), ("a|base64|re|i", "x"), ("a", -1), ("a|exists", "x")]:
        with pytest.raises(RuleError):
            parse_predicate(key, value)
    assert parse_predicate("a|utf16le|base64", "x").values == ("NzgwMA==",)
    events = read_events(spark, discover([folder]), source_records=True)
    found = alerts(rule_matches(events, rules), rules, [True, False])
    assert found.count() == 9 and {r.rule.id for r in found.collect()} == {"r1"}
    text = report.alert_table(found, 2)
    lines = text.splitlines()
    assert len(lines) == 6 and len(set(map(len, lines))) == 1 and "One" in lines[3] and "│ high" in lines[3]
    for bad in ("title: x\ndetection: {sel: {a: 1}}", "title: x\ndetection: {sel: {a: 1}, condition: nope}", "title: x\ndetection: {s: {a: 1}, condition: 1 of z*}"):
        with pytest.raises(RuleError):
            parse_documents(bad)


def test_many_rules_take_one_scan(spark, folder):
    text = "\n---\n".join(f"title: r{k}\ndetection: {{sel: {{'User|endswith': u{k % 7}, 'Nr|gte': {k % 3}}}, condition: sel}}" for k in range(200))
    rules = parse_documents(text)
    events = read_events(spark, discover([folder]), source_records=True)
    found = rule_matches(events, rules)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    wanted = sum(k % 7 == u and u >= k % 3 for k in range(200) for u in range(6)) * 3
    assert found.count() == wanted


def test_long_cells_are_cut_and_wrapped():
    text = report.table(["a", "b"], [["x" * 600, "é\nb"], ["", "y"]])
    assert text.count("x") == report.CELL and max(map(len, text.splitlines())) < 90


def test_stats(spark, folder):
    inputs = discover([folder])
    found = report.search_stats(spark, inputs, "event.id == 4624", source_records=True)
    assert str(found).splitlines()[0] == "stats: scanned=18 matched=9 parse_errors=1"
    assert found.samples[0][1] == "invalid JSON record: no json"
    assert str(report.dump_stats(spark, inputs)).startswith("stats: dumped=18 parse_errors=1 inputs=3")
    rules = parse_documents(RULE)
    hunt = report.hunt_stats(read_events(spark, inputs, source_records=True), rules, [True, True], 3, skipped=1)
    assert str(hunt) == "stats: scanned=18 matched=12 rules=2 skipped_rules=1 inputs=3"
    assert report.hunt_summary(hunt).startswith("hunt loaded 2 rule(s)") and report.hunt_summary(hunt, False).startswith("warning: ")
    quiet = report.hunt_stats(read_events(spark, inputs, source_records=True), rules, [True, False], 3)
    assert report.hunt_summary(quiet, False) is None


def test_command_line(spark, folder, tmp_path, capsys):
    query = tmp_path / "query"
    query.write_text("event.id == 4625 | keep computer")
    assert main(["search", "--source-records", "--query-file", str(query), "--stats", "--errors", str(tmp_path / "bad"), folder]) == 0
    out = capsys.readouterr()
    assert len(out.out.splitlines()) == 9 and "stats: scanned=18 matched=9 parse_errors=1" in out.err
    assert json.loads(open(tmp_path / "bad").read())["error"].endswith("no json")
    assert main(["search", "--query", "event.id == 1", "--explain", folder]) == 0
    assert "event.id" in capsys.readouterr().out
    assert main(["search", "--query", "event.id ==", folder]) == 1
    assert main(["dump", "--source-records", "--format", "csv", "--fields", "computer", "--output", str(tmp_path / "out.csv"), folder]) == 0
    assert open(tmp_path / "out.csv").read().startswith("computer\nh0\nh1\n")
    rules = tmp_path / "rules.yml"
    rules.write_text(RULE.replace("id: r1", "id: r1\nname: one") + "---\ntitle: Three\ncorrelation: {type: event_count, rules: [one], timespan: 1h, condition: {gte: 3}}\n")
    given = ["hunt", "--source-records", "--rules", str(rules), "--correlation-event-field", "Event.EventData.User", "--summary", folder]
    capsys.readouterr()
    assert main([*given, "--correlation-event-limit", "2"]) == 0
    out = capsys.readouterr()
    assert out.out.count('"type":"sigma_match"') == 12
    assert "Three [-]" in out.out and "... 1 more" in out.out and "Event.EventData.User=u0" in out.out
    assert "1 correlation rule(s)" in out.err
    assert main([*given, "--quiet"]) == 0 and capsys.readouterr().out == ""
