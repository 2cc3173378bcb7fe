"""Patterns of a linear-time dialect (Unicode classes, no look-around or back-references) as Java patterns."""

from __future__ import annotations

import re

# The ASCII classes by name, and the general categories by their long names.
POSIX = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t\x20",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": r"\x20-~",
    "punct": r"!-/:-@\x5B-\x60\x7B-~",
    "space": r"\t\n\x0B\f\r\x20",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
CATEGORIES = {
    "other": "C",
    "control": "Cc",
    "format": "Cf",
    "unassigned": "Cn",
    "privateuse": "Co",
    "surrogate": "Cs",
    "letter": "L",
    "casedletter": "LC",
    "lowercaseletter": "Ll",
    "modifierletter": "Lm",
    "otherletter": "Lo",
    "titlecaseletter": "Lt",
    "uppercaseletter": "Lu",
    "mark": "M",
    "spacingmark": "Mc",
    "enclosingmark": "Me",
    "nonspacingmark": "Mn",
    "number": "N",
    "decimalnumber": "Nd",
    "letternumber": "Nl",
    "othernumber": "No",
    "punctuation": "P",
    "connectorpunctuation": "Pc",
    "dashpunctuation": "Pd",
    "closepunctuation": "Pe",
    "finalpunctuation": "Pf",
    "initialpunctuation": "Pi",
    "otherpunctuation": "Po",
    "openpunctuation": "Ps",
    "symbol": "S",
    "currencysymbol": "Sc",
    "modifiersymbol": "Sk",
    "mathsymbol": "Sm",
    "othersymbol": "So",
    "separator": "Z",
    "lineseparator": "Zl",
    "paragraphseparator": "Zp",
    "spaceseparator": "Zs",
}
CONTROLS = {"a": r"\x07", "f": r"\f", "n": r"\n", "r": r"\r", "t": r"\t", "v": r"\x0B"}


class PatternError(ValueError):
    pass


def literal(code: int) -> str:
    return re.escape(chr(code)) if 0x20 < code < 0x7F else f"\\x{{{code:X}}}"


class Translation:
    """One pass over the pattern; flags hold for the rest of their group."""

    def __init__(self, pattern: str, flags: str):
        self.text, self.at = pattern, 0
        self.flags = set(flags)

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise PatternError("pattern ends early")
        self.at += 1
        return self.text[self.at - 1]

    def whole(self) -> str:
        out = self.group()
        if self.at < len(self.text):
            raise PatternError("unopened group")
        return out

    def group(self) -> str:
        """As far as the group's closing bracket, or the end."""
        out, outer = [], set(self.flags)
        repeatable = False
        while self.at < len(self.text) and self.peek() != ")":
            c = self.take()
            if "x" in self.flags and (c.isspace() or c == "#"):
                while c == "#" and self.at < len(self.text) and self.take() != "\n":
                    pass
                continue
            if c in "*+?{":
                if not repeatable:
                    raise PatternError("nothing to repeat")
                out.append(self.repetition(c))
                repeatable = False
                continue
            repeatable = True
            if c == "\\":
                out.append(self.escape())
            elif c == "[":
                out.append(self.bracketed())
            elif c == "(":
                inner = self.opened()
                repeatable = inner is not None
                out.append(inner or "")
            elif c == "|":
                out.append(c)
                repeatable = False
            elif c == "^":
                # A line also begins behind a final line feed.
                out.append(r"(?:^|(?<=\n))" if "m" in self.flags else r"\A")
            elif c == "$":
                out.append(r"(?=\n|\z)" if "m" in self.flags else r"\z")
            elif c == ".":
                out.append("(?s:.)" if "s" in self.flags else r"[^\n]")
            else:
                out.append(literal(ord(c)))
        self.flags = outer
        return "".join(out)

    def repetition(self, c: str) -> str:
        if c == "{":
            m = re.match(r"([0-9]+)(,([0-9]*))?\}", self.text[self.at :])
            if not m or m[3] and int(m[3]) < int(m[1]):
                raise PatternError("malformed repetition")
            self.at += m.end()
            c += m[0]
        lazy = self.peek() == "?"
        self.at += lazy
        if self.peek() == "+":
            raise PatternError("possessive repetition is not supported")
        if self.peek() and self.peek() in "*?":
            raise PatternError("repeated repetition is not supported")
        return c + "?" * (lazy != ("U" in self.flags))

    def opened(self) -> str | None:
        """A group behind its opening bracket, or None where it only sets flags."""
        if self.peek() != "?":
            return self.closed("(?:")
        m = re.match(r"\?(P?<([A-Za-z_][A-Za-z0-9_.\[\]]*)>|([a-zA-Z]*)(-[a-zA-Z]+)?([:)]))", self.text[self.at :])
        if not m:
            raise PatternError("look-around, atomic groups and the like are not supported")
        self.at += m.end()
        if m[2]:
            return self.closed("(?:")
        on, off = set(m[3]), set((m[4] or "-")[1:])
        if not on | off and m[5] == ")" or (on | off) - set("imsUux") or on & off:
            raise PatternError(f"flags: {m[0]}")
        java = "".join(f for f in "i" if f in on) + ("Uu" if "u" in on else "")
        less = "".join(f for f in "i" if f in off) + ("Uu" if "u" in off else "")
        java = f"{java}-{less}" if less else java
        if m[5] == ")":
            self.flags = self.flags - off | on
            # Java's own flags hold for the rest of the group as well; the others are written out.
            return f"(?{java})" if java else None
        outer = self.flags
        self.flags = self.flags - off | on
        inner = self.closed(f"(?{java}:")
        self.flags = outer
        return inner

    def closed(self, lead: str) -> str:
        inner = self.group()
        if self.peek() != ")":
            raise PatternError("unclosed group")
        self.at += 1
        return f"{lead}{inner})"

    def escape(self, in_class: bool = False) -> str:
        c = self.take()
        if c in "dDwWsS" or c in "bBAz" and not in_class:
            return "\\" + c
        if c in "pP":
            return self.category(c)
        if c in CONTROLS:
            return CONTROLS[c]
        if c in "xuU":
            m = re.match(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{%d})" % {"x": 2, "u": 4, "U": 8}[c], self.text[self.at :])
            code = int(m[1] or m[2], 16) if m else -1
            if not 0 <= code <= 0x10FFFF or 0xD800 <= code < 0xE000:
                raise PatternError(f"no character: \\{c}")
            self.at += m.end()
            return literal(code)
        if c.isalnum() or ord(c) > 0x7F:
            raise PatternError(f"not supported: \\{c}")
        return literal(ord(c))

    def category(self, kind: str) -> str:
        c = self.take()
        if c != "{":
            name = c
        else:
            end = self.text.find("}", self.at)
            if end < 0:
                raise PatternError("unclosed class name")
            name = self.text[self.at : end]
            self.at = end + 1
        if name.startswith("^"):
            kind, name = "P" if kind == "p" else "p", name[1:]
        key, _, value = name.replace(":", "=").rpartition("=")
        plain = re.sub(r"[ _-]", "", value).lower()
        if key.lower() in ("script", "sc", "scriptextensions", "scx"):
            return f"\\{kind}{{script={value}}}"
        if plain == "any":
            return r"[\x{0}-\x{10FFFF}]" if kind == "p" else r"[^\x{0}-\x{10FFFF}]"
        if plain in CATEGORIES:
            value = CATEGORIES[plain]
        short = value[:1].upper() + value[1:].lower()
        if short in CATEGORIES.values() or plain == "lc":
            return f"\\{kind}{{{'LC' if plain == 'lc' else short}}}"
        if not re.fullmatch(r"[A-Za-z_]+", value):
            raise PatternError(f"no such class: {name}")
        return f"\\{kind}{{Is{value}}}"

    def bracketed(self) -> str:
        """A class behind its opening bracket. Operators bind from the left, all alike."""
        negated = self.peek() == "^"
        self.at += negated
        out = self.items(first=True)
        while self.peek(2) in ("&&", "--", "~~"):
            op = self.peek(2)
            self.at += 2
            other = self.items(first=False)
            if op == "&&":
                out = f"[{out}]&&[{other}]"
            elif op == "--":
                out = f"[{out}]&&[^{other}]"
            else:
                out = f"[[{out}]&&[^{other}]][[{other}]&&[^{out}]]"
        if self.take() != "]":
            raise PatternError("unclosed class")
        return f"[{'^' if negated else ''}{out}]"

    def items(self, first: bool) -> str:
        out = []
        while first and self.peek() in ("]", "-") and self.peek():
            # At the start both stand for themselves.
            out.append(literal(ord(self.take())))
            if out[-1] == literal(ord("]")):
                break
        while self.peek() != "]" and self.peek(2) not in ("&&", "--", "~~"):
            c = self.take()
            if "x" in self.flags and c.isspace():
                continue
            if c == "[":
                m = re.match(r":(\^?)([a-z]+):\]", self.text[self.at :])
                if m and m[2] in POSIX:
                    self.at += m.end()
                    out.append(f"[^{POSIX[m[2]]}]" if m[1] else POSIX[m[2]])
                else:
                    out.append(self.bracketed())
                continue
            low = self.escape(in_class=True) if c == "\\" else literal(ord(c))
            if self.peek() == "-" and self.peek(2) not in ("-]", "--", "-"):
                self.at += 1
                c = self.take()
                high = self.escape(in_class=True) if c == "\\" else literal(ord(c))
                if c == "[" or any(re.match(r"\\[a-zA-WYZ]|\[", x) and x not in CONTROLS.values() and not x.startswith("\\x") for x in (low, high)):
                    raise PatternError("a class can't bound a range")
                low = f"{low}-{high}"
            out.append(low)
        return "".join(out)


def to_java(pattern: str, flags: str = "") -> str:
    """Raises PatternError for what the dialect lacks, or what is malformed. Case folding is Unicode's; `.` leaves out
    line feeds only; `$` without m stands at the very end. Groups capture nothing, as patterns only search."""
    if set(flags) - set("ims"):
        raise PatternError(f"flags: {flags}")
    java = f"(?Uu{'i' if 'i' in flags else ''}){Translation(pattern, flags).whole()}"
    from pyspark import SparkContext

    if SparkContext._active_spark_context is not None:  # names of classes and bounds of ranges
        try:
            SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(java)
        except Exception as e:
            raise PatternError(f"{pattern}: {str(e).splitlines()[0]}") from None
    return java
