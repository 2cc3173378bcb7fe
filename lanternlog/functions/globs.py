"""Path patterns as regular expressions."""

from __future__ import annotations

import re


class GlobError(ValueError):
    pass


def glob_pattern(glob: str) -> re.Pattern:
    """`*` and `?` also match a slash; `[...]` and `{a,b}` as usual."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
            while glob.startswith("*", i + 1):
                i += 1
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise GlobError(f"bad glob: {glob}")
            out.append("[" + glob[i + 1 : end].replace("!", "^", 1) + "]" if glob[i + 1] == "!" else glob[i : end + 1])
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise GlobError(f"bad glob: {glob}")
    return re.compile("".join(out), re.S)
