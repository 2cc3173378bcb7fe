"""Resolving a field name of an event to columns: is it present, its text, its number, its truth value."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names under which each normalised column is known.
ALIASES = {
    "timestamp": "timestamp",
    "event.timestamp": "timestamp",
    "winlog.timestamp": "timestamp",
    "record_id": "record_id",
    "event.record_id": "record_id",
    "winlog.record_id": "record_id",
    "channel": "channel",
    "event.channel": "channel",
    "winlog.channel": "channel",
    "provider": "provider",
    "event.provider": "provider",
    "winlog.provider_name": "provider",
    "event.id": "event_id",
    "event_id": "event_id",
    "winlog.event_id": "event_id",
    "computer": "computer",
    "host": "computer",
    "host.name": "computer",
    "source.computer": "computer",
    "source.file_path": "file_path",
    "file_path": "file_path",
    "source.collection_root": "collection_root",
}
NUMERIC = {"record_id", "event_id"}
U64_MAX = 18446744073709551615


def variant_path(path: str) -> str:
    return "$" + "".join('["' + part.replace("\\", "\\\\").replace('"', '\\"') + '"]' for part in path.split("."))


def unsigned(text: Column) -> Column:
    """The unsigned 64-bit number that a text spells: digits with at most a leading plus."""
    digits = F.when(text.rlike(r"\A\+?[0-9]+\z"), F.regexp_replace(text, r"\A\+?0*(?=[0-9])", ""))
    value = F.when(F.length(digits) <= 20, digits).try_cast("decimal(20,0)")
    return F.when(value <= F.lit(str(U64_MAX)).cast("decimal(20,0)"), value)


_TAKEN: ContextVar[dict | None] = ContextVar("_TAKEN", default=None)
LEVELS = 5


@contextmanager
def taken_out():
    """Fields used inside read columns that hold what they need once for all: {key: (column, what it holds, level)}.

    A column is made of the event's own and of those of lower levels, which are below LEVELS.
    """
    columns: dict[str, tuple] = {}
    token = _TAKEN.set(columns)
    try:
        yield columns
    finally:
        _TAKEN.reset(token)


def with_taken(events: DataFrame, columns: dict[str, tuple]) -> DataFrame:
    for level in range(LEVELS):
        events = events.select("*", *(made.alias(name) for name, made, at in columns.values() if at == level))
    return events


def _once(key: str, level: int, make: Callable[[], Column]) -> Column:
    columns = _TAKEN.get()
    if columns is None:
        return make()
    if key not in columns:
        made = make()
        columns[key] = (f"__field_{len(columns)}", made, level)
    return F.col(columns[key][0])


@dataclass(frozen=True)
class Field:
    """A field by its name. Missing and JSON null differ: null is present, but has neither text nor number."""

    name: str

    @cached_property
    def alias(self) -> str | None:
        return ALIASES.get(self.name)

    @property
    def raw(self) -> Column:
        found = F.try_variant_get(F.col("raw"), variant_path(self.name), "variant")
        return _once(f"raw {self.name}", 0, lambda: found)

    @property
    def kind(self) -> Column:
        return _once(f"kind {self.name}", 1, lambda: F.schema_of_variant(self.raw))

    def _raw_text(self) -> Column:
        def make() -> Column:
            text = F.try_variant_get(self.raw, "$", "string")
            return F.when(~(self.kind.startswith("ARRAY") | self.kind.startswith("OBJECT") | (self.kind == "VOID")), text)

        return _once(f"raw text {self.name}", 2, make)

    @property
    def present(self) -> Column:
        found = self.raw.isNotNull()
        return (F.col(self.alias).isNotNull() | found) if self.alias else found

    @property
    def text(self) -> Column:
        if not self.alias:
            return self._raw_text()
        return _once(f"text {self.name}", 3, lambda: F.coalesce(F.col(self.alias).cast("string"), self._raw_text()))

    @property
    def lower(self) -> Column:
        """The text with A to Z in lower case."""
        return _once(f"lower {self.name}", 4, lambda: ascii_lower(self.text))

    @property
    def number(self) -> Column:
        def make() -> Column:
            # A JSON number must be a whole one by its type; a string must spell one.
            whole = (self.kind == "BIGINT") | self.kind.rlike(r"\ADECIMAL\([0-9]+,0\)\z") | (self.kind == "STRING")
            own = F.when(whole, unsigned(self._raw_text()))
            if not self.alias:
                return own
            first = F.col(self.alias)
            first_number = first.cast("decimal(20,0)") if self.alias in NUMERIC else unsigned(first)
            return F.when(first.isNotNull(), first_number).otherwise(own)

        return _once(f"number {self.name}", 3, make)

    @property
    def boolean(self) -> Column:
        def make() -> Column:
            own = F.when(self.kind == "BOOLEAN", F.try_variant_get(self.raw, "$", "boolean"))
            return F.when(F.col(self.alias).isNull(), own) if self.alias else own

        return _once(f"boolean {self.name}", 2, make)

    @property
    def is_null(self) -> Column:
        """Missing, or JSON null."""
        return ~self.present | (self.is_alias_null & F.coalesce(F.is_variant_null(self.raw), F.lit(False)))

    @property
    def is_alias_null(self) -> Column:
        return F.col(self.alias).isNull() if self.alias else F.lit(True)

    @property
    def is_time(self) -> bool:
        return self.alias == "timestamp" or self.name.endswith(
            (".TimeCreated.SystemTime", ".TimeCreated.#attributes.SystemTime")
        )


def sure(condition: Column) -> Column:
    """Two-valued logic: what is unknown is false."""
    return F.coalesce(condition, F.lit(False))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


RFC3339 = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?([Zz]|[+-][0-9]{2}:[0-9]{2})?\z"


def instant(text: Column) -> Column:
    """The instant of an RFC 3339 text (without an offset: UTC), or null."""
    zoned = F.when(text.rlike(r"([Zz]|[+-][0-9]{2}:[0-9]{2})\z"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(RFC3339), F.upper(zoned)).try_cast("timestamp")
