"""The search language: lexer, parser, syntax tree, and its translation to a column condition.

    filter := or-expression; stage := '|' keep f, ... | '|' summarize [a=]count() | [a=]make_set(f[, n]), ... [by [a=]f, ...]
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fields import Field, instant, sure
from ..functions.net import in_network, network
from ..functions.regexes import PatternError, to_java

DEFAULT_SET_SIZE = 1_048_576


class QueryError(ValueError):
    """kind names the fault; the message tells where."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: str | int | bool


@dataclass(frozen=True)
class OneOf:
    field: str
    values: tuple


@dataclass(frozen=True)
class Matches:
    field: str
    pattern: str
    ignore_case: bool
    negated: bool


@dataclass(frozen=True)
class Exists:
    field: str


@dataclass(frozen=True)
class InNetwork:
    field: str
    literal: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Aggregate:
    kind: str
    alias: str
    field: str | None = None
    size: int = DEFAULT_SET_SIZE


@dataclass(frozen=True)
class Group:
    alias: str
    field: str


@dataclass(frozen=True)
class Summarize:
    aggregates: tuple[Aggregate, ...] = ()
    by: tuple[Group, ...] = ()


@dataclass(frozen=True)
class Query:
    filter: object
    keep: tuple[str, ...] = ()
    summarize: Summarize | None = None


@dataclass(frozen=True)
class Token:
    kind: str
    value: object = None
    flag: bool = field(default=False)


SYMBOLS = ("==", "!=", "<=", ">=", "=~", "!~", "<", ">", "(", ")", ",", "|", "=")
WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_.#-]*")


def tokenize(text: str) -> list[Token]:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif c == '"':
            i += 1
            value = []
            while i < len(text) and text[i] != '"':
                if text[i] == "\\":
                    i += 1
                    if i == len(text):
                        raise QueryError("UnterminatedString")
                value.append(text[i])
                i += 1
            if i == len(text):
                raise QueryError("UnterminatedString")
            i += 1
            out.append(Token("string", "".join(value)))
        elif c == "/":
            i += 1
            value = []
            while i < len(text) and text[i] != "/":
                if text[i] == "\\" and i + 1 < len(text):
                    value.append("/" if text[i + 1] == "/" else text[i : i + 2])
                    i += 2
                else:
                    value.append(text[i])
                    i += 1
            if i == len(text):
                raise QueryError("UnterminatedRegex")
            flags = re.compile("[A-Za-z]*").match(text, i + 1)
            if set(flags[0]) - {"i"}:
                raise QueryError("UnsupportedRegexFlag", flags[0])
            out.append(Token("regex", "".join(value), bool(flags[0])))
            i = flags.end()
        elif c.isascii() and c.isdigit():
            digits = re.compile("[0-9]+").match(text, i)
            if int(digits[0]) > 18446744073709551615:
                raise QueryError("InvalidNumber", digits[0])
            out.append(Token("number", int(digits[0])))
            i = digits.end()
        elif m := WORD.match(text, i):
            out.append(Token("word", m[0]))
            i = m.end()
        else:
            symbol = next((s for s in SYMBOLS if text.startswith(s, i)), None)
            if symbol is None:
                raise QueryError("UnexpectedCharacter", c)
            out.append(Token(symbol))
            i += len(symbol)
    return out


class Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def next(self) -> Token:
        token = self.peek()
        if token is None:
            raise QueryError("UnexpectedEnd")
        self.at += 1
        return token

    def keyword(self, word: str) -> bool:
        token = self.peek()
        if token and token.kind == "word" and token.value.lower() == word:
            self.at += 1
            return True
        return False

    def symbol(self, kind: str) -> bool:
        token = self.peek()
        if token and token.kind == kind:
            self.at += 1
            return True
        return False

    def expect(self, kind: str) -> Token:
        token = self.next()
        if token.kind != kind:
            raise QueryError("UnexpectedToken", f"{token.kind} {token.value or ''}, wanted {kind}")
        return token

    def either(self):
        left = self.both()
        while self.keyword("or"):
            left = Either(left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.keyword("and"):
            left = Both(left, self.negated())
        return left

    def negated(self):
        return Not(self.negated()) if self.keyword("not") else self.primary()

    def primary(self):
        if self.symbol("("):
            inner = self.either()
            self.expect(")")
            return inner
        name = self.expect("word").value
        follows = self.peek()
        if follows and follows.kind == "(":
            lowered = name.lower()
            if lowered not in ("exists", "cidr_contains", "ip_in_cidr"):
                raise QueryError("UnsupportedFunction", name)
            self.next()
            target = self.expect("word").value
            if lowered == "exists":
                self.expect(")")
                return Exists(target)
            self.expect(",")
            literal = self.expect("string").value
            self.expect(")")
            try:
                network(literal)
            except ValueError:
                raise QueryError("InvalidCidr", literal) from None
            return InNetwork(target, literal)
        op = self.next()
        if op.kind in ("==", "!=", "<", "<=", ">", ">="):
            return Compare(name, op.kind, self.literal())
        if op.kind == "word" and op.value in ("contains", "contains_ci"):
            return Compare(name, op.value, self.literal())
        if op.kind == "word" and op.value == "in":
            self.expect("(")
            if self.symbol(")"):
                raise QueryError("EmptyList")
            values = [self.literal()]
            while self.symbol(","):
                values.append(self.literal())
            self.expect(")")
            return OneOf(name, tuple(values))
        if op.kind in ("=~", "!~"):
            regex = self.expect("regex")
            try:
                to_java(regex.value, "i" if regex.flag else "")
            except PatternError as e:
                raise QueryError("InvalidRegex", str(e)) from None
            return Matches(name, regex.value, regex.flag, op.kind == "!~")
        raise QueryError("UnexpectedToken", str(op.value or op.kind))

    def literal(self):
        token = self.next()
        if token.kind in ("string", "number"):
            return token.value
        if token.kind == "word" and token.value.lower() in ("true", "false"):
            return token.value.lower() == "true"
        raise QueryError("ExpectedLiteral", str(token.value or token.kind))

    def keep(self) -> tuple[str, ...]:
        out = [self.expect("word").value]
        while self.symbol(","):
            out.append(self.expect("word").value)
        return tuple(out)

    def summarize(self) -> Summarize:
        aggregates: list[Aggregate] = []
        if not self.peek():
            raise QueryError("EmptySummarize")
        grouped = self.keyword("by")
        while not grouped:
            aggregates.append(self.aggregate())
            comma = self.symbol(",")  # one before `by` is allowed
            grouped = self.keyword("by")
            if not comma and not grouped:
                return Summarize(tuple(aggregates))
        by = [self.group()]
        while self.symbol(","):
            by.append(self.group())
        return Summarize(tuple(aggregates), tuple(by))

    def group(self) -> Group:
        name = self.expect("word").value
        return Group(name, self.expect("word").value) if self.symbol("=") else Group(name, name)

    def aggregate(self) -> Aggregate:
        name, alias = self.expect("word").value, None
        if self.symbol("="):
            alias, name = name, self.expect("word").value
        kind = name.lower()
        if kind not in ("count", "make_set", "makeset"):
            raise QueryError("UnsupportedFunction", name)
        self.expect("(")
        if kind == "count":
            self.expect(")")
            return Aggregate("count", alias or "count")
        if self.symbol(")"):
            raise QueryError("MissingField", name)
        target = self.expect("word").value
        size = self.expect("number").value if self.symbol(",") else DEFAULT_SET_SIZE
        self.expect(")")
        return Aggregate("make_set", alias or f"set_{target}", target, size)


def parse(text: str) -> Query:
    parser = Parser(tokenize(text))
    if not parser.tokens:
        raise QueryError("EmptyQuery")
    condition = parser.either()
    keep, summarize = (), None
    if parser.symbol("|"):
        if parser.keyword("keep"):
            keep = parser.keep()
        elif parser.keyword("summarize"):
            summarize = parser.summarize()
        else:
            token = parser.peek()
            raise QueryError("UnsupportedStage", str(token.value) if token else "")
    if parser.peek():
        raise QueryError("TrailingInput", str(parser.peek().value or parser.peek().kind))
    return Query(condition, keep, summarize)


def equal(f: Field, value) -> Column:
    if isinstance(value, bool):
        return sure(f.boolean == F.lit(value))
    if isinstance(value, int):
        return sure(f.number == F.lit(str(value)).cast("decimal(20,0)"))
    return sure(f.text == F.lit(value))


ORDER = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def compare(f: Field, op: str, value) -> Column:
    if op == "==":
        return equal(f, value)
    if op == "!=":
        return f.present & ~equal(f, value)
    if op in ("contains", "contains_ci"):
        if not isinstance(value, str):
            return F.lit(False)
        return sure(F.lower(f.text).contains(value.lower()) if op == "contains_ci" else f.text.contains(value))
    if isinstance(value, bool):
        return F.lit(False)
    if isinstance(value, int):
        return sure(ORDER[op](f.number, F.lit(str(value)).cast("decimal(20,0)")))
    plain = ORDER[op](f.text, F.lit(value))
    if f.is_time:
        mine, theirs = instant(f.text), instant(F.lit(value))
        return sure(F.when(mine.isNotNull() & theirs.isNotNull(), ORDER[op](mine, theirs)).otherwise(plain))
    return sure(plain)


def condition(node) -> Column:
    """A null-free boolean column."""
    match node:
        case Either(a, b):
            return condition(a) | condition(b)
        case Both(a, b):
            return condition(a) & condition(b)
        case Not(a):
            return ~condition(a)
        case Exists(name):
            return Field(name).present
        case InNetwork(name, literal):
            return in_network(Field(name).text, literal)
        case OneOf(name, values):
            return reduce(lambda a, b: a | b, (equal(Field(name), v) for v in values))
        case Matches(name, pattern, ignore_case, negated):
            found = sure(Field(name).text.rlike(to_java(pattern, "i" if ignore_case else "")))
            return ~found if negated else found
        case Compare(name, op, value):
            return compare(Field(name), op, value)
    raise TypeError(node)
