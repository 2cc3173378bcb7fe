"""Patterns against DuckDB's linear-time engine, and those that are refused."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lanternlog.functions.regexes import PatternError, to_java

TEXTS = [
    "", "abc123", "dig", "A-Z", "foobar", "fooBAR", "héé", "ÉCOLE", "a\nb", "a\n", "\n", "x]y", "tab\there", "[a]", "a^b", "\\",
    "10.0.0.1", "C:\\Users\\u7\\error.exe", "$5", "aaa", "é", "\u4e2d", "a b", "a#b", "{}", "-", "&&", "~", "٣", "_", "K", "ſ", "z" * 40,
]
PATTERNS = [
    r"[[:digit:]]+", r"^[[:alpha:]]+$", r"[^[:alnum:]]", r"[[:^digit:]x]", r"\x41", r"\x{41}", r"foo(?i)bar", r"foo(?i:b)ar", r"\pL+\d",
    r"^\PL+$", r"\p{Lu}", r"^a$", r"(?m)^b$", r"(?m)^a$", r"a.b", r"(?s)a.b", r"[]x]", r"[^]x]", r"[\]]", r"[a-c]{2,3}", r"a{2}", r"(a|b)*c",
    r"(?P<n>a)b", r"\bfoo", r"u[0-9]\\error\.exe$", r"\$5", r"\{\}", r"^\W+$", r"[\d_]", r"\t", r"(?i)é", r"[-a]", r"[a-]", r"\A\z", r"a??b",
    r"(?U)a+", r"(?i)K", r"[0-9.]+", r"(foo)?bar", r"}", r"\.0\.", r"[[:punct:]]{2}", r"[[:space:]]", r"^[\x00-\x7F]*$", r"[\x{4e00}-\x{9fff}]",
]
REFUSED = [
    "(?=a)", "(?<!a)b", "(?>a)", r"(a)\1", "a++", "*a", "a{2,1}", "(a", "a)", "[a", "\\", r"\Z", r"\h", r"\x{110000}", r"\p{Nope}", "(?q)a", "a**", "[z-a]",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_pattern_finds_what_another_engine_finds(spark, pattern):
    con = duckdb.connect()
    wanted = [con.execute("SELECT regexp_matches(?, ?)", [t, pattern]).fetchone()[0] for t in TEXTS]
    if pattern in (r"^\W+$", r"[\d_]", r"\bfoo", r"\pL+\d", r"(?U)a+"):  # Unicode classes here, ASCII there
        wanted = None
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").coalesce(1)
    found = [r.m for r in rows.select("i", F.col("t").rlike(to_java(pattern)).alias("m")).orderBy("i").collect()]
    if wanted is not None:
        assert dict(zip(TEXTS, found)) == dict(zip(TEXTS, wanted))


def test_classes_are_unicode_and_sets_combine(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").coalesce(1)

    def matched(pattern, flags=""):
        return {r.t for r in rows.where(F.col("t").rlike(to_java(pattern, flags))).collect()}

    assert matched(r"^\d$") == {"٣"}
    assert matched(r"^(?-u:\d)$") == set()
    assert matched(r"^\w$") == {"é", "\u4e2d", "٣", "_", "K", "ſ"}
    assert matched(r"^[[a-z]--[b-z]]+$") == {"aaa"}
    assert matched(r"^[a-z&&[^b-z]]+$") == {"aaa"}
    assert matched(r"^[a-f~~b-z]{3}$") == {"aaa"}
    assert matched(r"^[^[a-z][:digit:]\n]+$") >= {"_", "K", "-", "{}"}
    assert matched("^É c o l e$ # all of it", "i") == set()
    assert matched("(?x)^é c o l e$ # all of it", "i") == {"ÉCOLE"}
    assert matched(r"^\p{Letter}$") == matched(r"^\pL$") == {"é", "\u4e2d", "K", "ſ"}
    assert matched(r"\p{Han}") == matched(r"\p{script=Han}") == {"\u4e2d"}
    assert matched("^B$", "im") == {"a\nb"}


@pytest.mark.parametrize("pattern", REFUSED)
def test_pattern_is_refused(spark, pattern):
    with pytest.raises(PatternError):
        to_java(pattern)
