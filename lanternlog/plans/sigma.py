"""Detection rules: documents in YAML, their modifiers and conditions, and their translation to column conditions."""

from __future__ import annotations

import base64
import os
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fields import Field, ascii_lower, ascii_lowered, sure
from ..functions.globs import glob_pattern
from ..functions.net import in_network, network
from ..functions.regexes import PatternError, to_java


class RuleError(ValueError):
    pass


# Which channels a log source names.
SERVICES = {
    "security": ("Security",),
    "system": ("System",),
    "sysmon": ("Microsoft-Windows-Sysmon/Operational",),
    "powershell": ("Windows PowerShell", "Microsoft-Windows-PowerShell/Operational"),
    "defender": ("Microsoft-Windows-Windows Defender/Operational",),
    "windefend": ("Microsoft-Windows-Windows Defender/Operational",),
    "microsoft-windows-windows defender": ("Microsoft-Windows-Windows Defender/Operational",),
    "wmi": ("Microsoft-Windows-WMI-Activity/Operational",),
    "wmi-activity": ("Microsoft-Windows-WMI-Activity/Operational",),
    "taskscheduler": ("Microsoft-Windows-TaskScheduler/Operational",),
    "task-scheduler": ("Microsoft-Windows-TaskScheduler/Operational",),
}
CATEGORIES = {
    "process_creation": ("Microsoft-Windows-Sysmon/Operational",),
    "network_connection": ("Microsoft-Windows-Sysmon/Operational",),
    "file_event": ("Microsoft-Windows-Sysmon/Operational",),
    "dns_query": ("Microsoft-Windows-Sysmon/Operational",),
}
LEVELS = {"informational": 0, "info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
FIELD_NAMES = {
    "EventID": "event.id",
    "Channel": "channel",
    "Provider_Name": "provider",
    "ProviderName": "provider",
    "Computer": "computer",
}
DASHES = "-/–—―"
OPERATIONS = {
    "contains", "startswith", "endswith", "exists", "neq", "lt", "lte", "gt", "gte", "re", "cidr", "fieldref",
    "minute", "hour", "day", "week", "month", "year",
}
TRANSFORMS = {"windash", "base64", "base64offset", "utf16le", "wide", "utf16be", "utf16"}
COUNT_OPS = {
    "gt": lambda a, b: a > b, ">": lambda a, b: a > b,
    "gte": lambda a, b: a >= b, ">=": lambda a, b: a >= b,
    "lt": lambda a, b: a < b, "<": lambda a, b: a < b,
    "lte": lambda a, b: a <= b, "<=": lambda a, b: a <= b,
    "eq": lambda a, b: a == b, "=": lambda a, b: a == b, "==": lambda a, b: a == b,
    "neq": lambda a, b: a != b, "!=": lambda a, b: a != b,
}


def field_path(name: str) -> str:
    return FIELD_NAMES.get(name) or (name if "." in name else f"Event.EventData.{name}")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False)) if columns else F.lit(False)


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns) if columns else F.lit(True)


def dash_pattern(value: str) -> str:
    """Every dash of the value stands for any dash."""
    return "".join(f"[{DASHES}]" if c in DASHES else re.escape(c) for c in value)


def wildcard_pattern(value: str) -> str:
    return r"\A" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in value) + r"\z"


@dataclass(frozen=True)
class Predicate:
    """One key of a selection with its modifiers and values."""

    name: str
    op: str = "eq"
    values: tuple = ()
    every: bool = False
    cased: bool = False
    negated: bool = False
    windash: bool = False
    flags: str = ""

    def column(self) -> Column:
        f = Field(field_path(self.name))
        tests = [self.test(f, v) for v in self.values]
        joined = all_of(tests) if self.every else any_of(tests)
        return joined

    def text_test(self, f: Field, value: str) -> Column:
        if self.windash:
            inner = dash_pattern(value)
            if self.op == "eq" and ("*" in value or "?" in value):
                inner = inner.replace(r"\*", ".*").replace(r"\?", ".")
            around = {"eq": (r"\A", r"\z"), "contains": ("", ""), "startswith": (r"\A", ""), "endswith": ("", r"\z")}
            a, b = around[self.op]
            # Without the Unicode flag, case folding is that of ASCII.
            return f.text.rlike(f"(?s{'' if self.cased else 'i'}){a}{inner}{b}")
        text = f.text if self.cased else f.lower
        value = value if self.cased else ascii_lowered(value)
        if self.op == "eq":
            if "*" in value or "?" in value:
                return text.rlike("(?s)" + wildcard_pattern(value))
            return text == F.lit(value)
        return getattr(text, self.op)(value)

    def test(self, f: Field, value) -> Column:
        if self.op == "exists":
            return f.present == F.lit(value)
        if self.op in ("lt", "lte", "gt", "gte"):
            return sure(COUNT_OPS[self.op](f.number, F.lit(str(value)).cast("decimal(20,0)")))
        if self.op == "re":
            return self._negate(f, sure(f.text.rlike(to_java(value, self.flags))))
        if self.op == "cidr":
            return self._negate(f, in_network(f.text, value))
        if self.op == "fieldref":
            other = Field(field_path(value))
            numbers = f.number.isNotNull() & other.number.isNotNull()
            texts = (f.text == other.text) if self.cased else (f.lower == other.lower)
            same = sure(F.when(numbers, f.number == other.number).otherwise(texts))
            return (f.present & other.present & ~same) if self.negated else same
        if self.op in ("minute", "hour", "day", "week", "month", "year"):
            return sure(time_part(f.text, self.op) == F.lit(value))
        if value is None:
            same = f.is_null
        elif isinstance(value, bool):
            same = sure(f.boolean == F.lit(value)) if self.op == "eq" else F.lit(False)
        elif isinstance(value, int):
            same = sure(f.number == F.lit(str(value)).cast("decimal(20,0)")) if self.op == "eq" else F.lit(False)
        else:
            same = sure(self.text_test(f, value))
        return self._negate(f, same)

    def _negate(self, f: Field, same: Column) -> Column:
        return (f.present & ~same) if self.negated else same


def time_part(text: Column, part: str) -> Column:
    """A part of a time's own wall clock; offsets other than Z and + are not understood."""
    shape = r"\A([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([0-9]{2}:[0-9]{2}:[0-9]{2})(\.[0-9]{1,9})?([Zz]|\+[0-9]{2}:[0-9]{2})?\z"
    clock = F.when(text.rlike(shape), F.regexp_replace(text, shape, "$1 $2")).try_cast("timestamp_ntz")
    functions = {"minute": F.minute, "hour": F.hour, "day": F.day, "week": F.weekofyear, "month": F.month, "year": F.year}
    return functions[part](clock)


@dataclass(frozen=True)
class Selection:
    """Alternatives; each is a conjunction of predicates, or a keyword over the raw text."""

    alternatives: tuple = ()
    keywords: tuple[Predicate, ...] = ()

    def column(self) -> Column:
        found = [all_of([p.column() for p in a]) for a in self.alternatives]
        for k in self.keywords:
            text = F.col("raw_json") if k.cased else ascii_lower(F.col("raw_json"))
            tests = [sure(text.contains(v if k.cased else ascii_lowered(v))) for v in k.values]
            found.append(all_of(tests) if k.every else any_of(tests))
        return any_of(found)


@dataclass(frozen=True)
class Correlation:
    kind: str
    rules: tuple[str, ...]
    group_by: tuple[str, ...]
    timespan_us: int
    op: str | None = None
    count: int = 0
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    title: str
    path: str = ""
    id: str | None = None
    name: str | None = None
    status: str | None = None
    level: str | None = None
    tags: tuple[str, ...] = ()
    channels: tuple[str, ...] | None = None
    selections: dict = field(default_factory=dict, hash=False)
    conditions: tuple = ()
    correlation: Correlation | None = None

    def column(self) -> Column:
        match = any_of([_condition(c, self.selections) for c in self.conditions])
        if self.channels is not None:
            match = sure(ascii_lower(F.col("channel")).isin([ascii_lowered(c) for c in self.channels])) & match
        return match

    def event_ids(self) -> frozenset | None:
        """The only event ids with which the rule can match, where its condition is one selection that says so."""
        if len(self.conditions) != 1 or self.conditions[0][0] != "name":
            return None
        found = self.selections[self.conditions[0][1]]
        if found.keywords or len(found.alternatives) != 1:
            return None
        for p in found.alternatives[0]:
            if field_path(p.name) == "event.id" and p.op == "eq" and not p.negated and not p.every:
                if all(isinstance(v, int) and not isinstance(v, bool) for v in p.values):
                    return frozenset(p.values)
        return None


def glob_matches(pattern: str, name: str) -> bool:
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), name, re.S) is not None


def _condition(node, selections: dict) -> Column:
    kind = node[0]
    if kind == "or":
        return _condition(node[1], selections) | _condition(node[2], selections)
    if kind == "and":
        return _condition(node[1], selections) & _condition(node[2], selections)
    if kind == "not":
        return ~_condition(node[1], selections)
    if kind == "name":
        return selections[node[1]].column()
    named = [s.column() for n, s in selections.items() if node[2] == "them" or glob_matches(node[2], n)]
    return any_of(named) if node[1] == "1" else all_of(named)


def parse_condition(text: str, names) -> tuple:
    tokens = re.findall(r"[()]|[^\s()]+", text)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise RuleError("condition ends early")
        at += 1
        return tokens[at - 1]

    def level(words: tuple[str, ...]):
        if not words:
            return unary()
        left = level(words[1:])
        while (peek() or "").lower() == words[0]:
            take()
            left = (words[0], left, level(words[1:]))
        return left

    def unary():
        token = take()
        if token.lower() == "not":
            return "not", unary()
        if token == "(":
            inner = level(("or", "and"))
            if take() != ")":
                raise RuleError("unbalanced condition")
            return inner
        if token.lower() in ("1", "all") and (peek() or "").lower() == "of":
            take()
            pattern = take()
            if pattern.lower() == "them":
                pattern = "them"
            elif not any(glob_matches(pattern, n) for n in names):
                raise RuleError(f"no selection is named like {pattern}")
            return "of", token.lower(), pattern
        if token not in names:
            raise RuleError(f"unknown selection {token}")
        return "name", token

    tree = level(("or", "and"))
    if peek() is not None:
        raise RuleError(f"condition goes on: {peek()}")
    return tree


def _transformed(value, names: list[str]) -> list[str]:
    values = [value]
    for n in names:
        if not all(isinstance(v, (str, bytes)) for v in values):
            raise RuleError("transforms need text")
        if n == "base64":
            values = [base64.b64encode(v.encode()).decode() for v in values]
        elif n == "base64offset":
            values = [base64.b64encode(b"\0" * k + v.encode()).decode() for v in values for k in range(3)]
        elif n in ("utf16le", "wide"):
            values = [v.encode("utf-16-le").hex() for v in values]
        elif n == "utf16be":
            values = [v.encode("utf-16-be").hex() for v in values]
        elif n == "utf16":
            values = ["fffe" + v.encode("utf-16-le").hex() for v in values]
    return values


def parse_predicate(key: str, value) -> Predicate:
    name, *modifiers = key.split("|")
    op, flags, transforms = "eq", "", []
    every = cased = negated = windash = False
    for m in modifiers:
        m = m.lower()
        if m == "expand":
            raise RuleError("expand is not supported")
        if m == "all":
            every = True
        elif m == "cased":
            cased = True
        elif m == "neq":
            negated = True
        elif m in ("i", "m", "s"):
            flags += m
        elif m == "windash":
            windash = True
            if transforms:
                raise RuleError("windash stands before encodings")
        elif m in TRANSFORMS:
            transforms.append(m)
        elif m in OPERATIONS:
            op = m
        else:
            raise RuleError(f"unsupported modifier {m}")
    values = value if isinstance(value, list) else [value]
    if any(isinstance(v, (dict, list)) for v in values):
        raise RuleError(f"{key}: nested values")
    for v in values:
        if isinstance(v, float) or (isinstance(v, int) and not isinstance(v, bool) and v < 0):
            raise RuleError(f"{key}: numbers must be unsigned")
        if v is None and (op != "eq" or transforms):
            raise RuleError(f"{key}: null needs equality")
        if op in ("lt", "lte", "gt", "gte", "minute", "hour", "day", "week", "month", "year") and (
            not isinstance(v, int) or isinstance(v, bool)
        ):
            raise RuleError(f"{key}: a number is needed")
        if op in ("re", "cidr", "fieldref") and not isinstance(v, str):
            raise RuleError(f"{key}: text is needed")
        if op == "exists" and not isinstance(v, bool):
            raise RuleError(f"{key}: true or false is needed")
        try:
            if op == "re":
                to_java(v, flags)
            elif op == "cidr":
                network(v)
        except (PatternError, ValueError) as e:
            raise RuleError(f"{key}: {e}") from None
    if flags and (op != "re" or transforms):
        raise RuleError(f"{key}: flags belong to re")
    if transforms:
        if windash:  # the encodings need each variant spelled out
            variants = [""]
            spelled = []
            for v in values:
                variants = [""]
                for c in v:
                    variants = [p + d for p in variants for d in (DASHES if c in DASHES else c)]
                spelled += sorted(set(variants))
            values, windash = spelled, False
        values = [t for v in values for t in _transformed(v, transforms)]
    return Predicate(name, op, tuple(values), every, cased, negated, windash, flags)


def parse_selection(value) -> Selection:
    if isinstance(value, dict):
        keywords, predicates = [], []
        for k, v in value.items():
            k = str(k)
            if k.startswith("|") or k == "":
                modifiers = [m for m in k.split("|") if m]
                if set(modifiers) - {"all", "cased", "contains"}:
                    raise RuleError(f"keyword modifier {k}")
                words = v if isinstance(v, list) else [v]
                if not all(isinstance(w, str) for w in words):
                    raise RuleError("keywords must be text")
                keywords.append(Predicate("", "contains", tuple(words), "all" in modifiers, "cased" in modifiers))
            else:
                predicates.append(parse_predicate(k, v))
        return Selection((tuple(predicates),) if predicates else (), tuple(keywords))
    if isinstance(value, list):
        parts = [parse_selection(v) for v in value]
        return Selection(tuple(a for p in parts for a in p.alternatives), tuple(k for p in parts for k in p.keywords))
    if isinstance(value, str):
        return Selection((), (Predicate("", "contains", (value,)),))
    raise RuleError("a selection is a map, a list or text")


def parse_timespan(text) -> int:
    m = re.fullmatch(r"([0-9]+)([smhd])", str(text))
    if not m:
        raise RuleError(f"timespan {text}")
    return int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]] * 1_000_000


def _strings(value) -> tuple[str, ...]:
    return () if value is None else tuple(map(str, value)) if isinstance(value, list) else (str(value),)


def parse_correlation(raw: dict) -> Correlation:
    kind = raw.get("type")
    if kind not in ("event_count", "value_count", "temporal", "temporal_ordered"):
        raise RuleError(f"correlation type {kind}")
    rules = _strings(raw.get("rules"))
    if not rules:
        raise RuleError("correlation without rules")
    span = raw.get("timespan", raw.get("timeframe"))
    if span is None:
        raise RuleError("correlation without timespan")
    op, count, fields = None, 0, ()
    given = raw.get("condition")
    if isinstance(given, str):
        parts = given.split()
        if len(parts) != 2 or parts[0] not in COUNT_OPS or not parts[1].isdigit():
            raise RuleError(f"correlation condition {given}")
        op, count = parts[0], int(parts[1])
    elif isinstance(given, dict):
        ops = [k for k in given if k != "field"]
        if len(ops) != 1 or ops[0] not in COUNT_OPS or not isinstance(given[ops[0]], int) or given[ops[0]] < 0:
            raise RuleError("a correlation condition has one operator and a count")
        op, count, fields = ops[0], given[ops[0]], _strings(given.get("field"))
    if kind.endswith("_count") and op is None:
        raise RuleError(f"{kind} needs a condition")
    if kind == "value_count" and not all(fields or ("",)):
        raise RuleError("value_count needs a field")
    groups = _strings(raw.get("group-by", raw.get("group_by")))
    return Correlation(kind, rules, groups, parse_timespan(span), op, count, fields)


def parse_rule(raw, path: str = "") -> Rule:
    if not isinstance(raw, dict):
        raise RuleError("a rule is a map")
    common = {
        "title": str(raw.get("title") or os.path.splitext(os.path.basename(path))[0]),
        "path": path,
        "id": raw.get("id") and str(raw["id"]),
        "name": raw.get("name") and str(raw["name"]),
        "status": raw.get("status") and str(raw["status"]),
        "level": raw.get("level") and str(raw["level"]),
        "tags": _strings(raw.get("tags")),
    }
    if "correlation" in raw:
        if not isinstance(raw["correlation"], dict):
            raise RuleError("a correlation is a map")
        return Rule(**common, correlation=parse_correlation(raw["correlation"]))
    detection = raw.get("detection")
    if not isinstance(detection, dict) or "condition" not in detection:
        raise RuleError("missing detection or condition")
    selections = {str(k): parse_selection(v) for k, v in detection.items() if k != "condition"}
    conditions = tuple(parse_condition(c, selections) for c in _strings(detection["condition"]))
    source = raw.get("logsource") or {}
    channels = None
    if ascii_lowered(str(source.get("product") or "windows")) == "windows":
        found = SERVICES.get(ascii_lowered(str(source.get("service") or "")), ())
        found += CATEGORIES.get(ascii_lowered(str(source.get("category") or "")), ())
        channels = tuple(dict.fromkeys(found)) or None
    return Rule(**common, channels=channels, selections=selections, conditions=conditions)


def parse_documents(text: str, path: str = "") -> list[Rule]:
    """Rules of a file: documents end at lines that hold only --- or ..."""
    try:
        import yaml
    except ImportError as e:
        raise RuleError("reading rules needs the yaml package") from e
    rules = []
    for part in re.split(r"(?m)^[ \t]*(?:---|\.\.\.)[ \t]*$", text):
        if not part.strip():
            continue
        try:
            raw = yaml.safe_load(part)
        except yaml.YAMLError as e:
            raise RuleError(f"{path}: {e}") from None
        if raw is not None:
            rules.append(parse_rule(raw, path))
    return rules


def load_rules(paths: list[str], strict: bool = True) -> tuple[list[Rule], int]:
    """Rules of files and folders in order of path, and how many files were left out (never, if strict)."""
    files = []
    for p in paths:
        if os.path.isdir(p):
            files += [os.path.join(d, n) for d, _, names in os.walk(p) for n in names if n.lower().endswith((".yml", ".yaml"))]
        elif os.path.isfile(p):
            files.append(p)
        else:
            raise RuleError(f"no such path: {p}")
    rules, skipped = [], 0
    for f in sorted(files):
        try:
            with open(f, encoding="utf-8") as handle:
                rules += parse_documents(handle.read(), f)
        except RuleError:
            if strict:
                raise
            skipped += 1
    return rules, skipped


def selected(
    rules: list[Rule],
    status: tuple[str, ...] = (),
    level: tuple[str, ...] = (),
    tag: tuple[str, ...] = (),
    min_level: str | None = None,
    exclude: tuple[str, ...] = (),
) -> list[bool]:
    """Which rules raise alerts; the others may still feed correlations."""
    if min_level is not None and min_level.lower() not in LEVELS:
        raise RuleError(f"level {min_level}")

    def one_of(value: str | None, wanted: tuple[str, ...]) -> bool:
        return not wanted or (value is not None and value.lower() in {w.lower() for w in wanted})

    globs = [glob_pattern(e) for e in exclude]
    out = []
    for r in rules:
        ok = one_of(r.status, status) and one_of(r.level, level)
        ok = ok and (not tag or any(one_of(t, tag) for t in r.tags))
        if min_level is not None:
            ok = ok and LEVELS.get((r.level or "").lower(), -1) >= LEVELS[min_level.lower()]
        ok = ok and not any(g.fullmatch(r.path) or g.fullmatch(r.title) for g in globs)
        out.append(ok and r.correlation is None)
    return out
