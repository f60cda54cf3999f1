"""Glob policies as regular expressions: ``**``, ``*``, ``?``, ``[..]`` and ``{a,b}``, dot files included."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set("\\.^$+()|")


def glob_regex(glob: str) -> str:
    """An anchored regular expression without lookaround, so that other engines read it alike."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
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
            out.append("\\" + c if c in _SPECIAL or c in "[]{}" else c)
        i += 1
    return "^" + "".join(out) + "$"


def any_regex(globs: list[str]) -> str:
    return "(?i)" + "|".join(glob_regex(g) for g in globs) if globs else "^\\b$"


class Policy:
    """Allowed paths: matched by an allow glob and by no deny glob, as a relative or as an absolute path."""

    def __init__(self, allow: list[str], deny: list[str]):
        self.allow, self.deny = any_regex(allow), any_regex(deny)
        self._allow, self._deny = re.compile(self.allow), re.compile(self.deny)

    def allows(self, relative: str, absolute: str) -> bool:
        if self._deny.search(relative) or self._deny.search(absolute):
            return False
        return bool(self._allow.search(relative) or self._allow.search(absolute))

    def denies_folder(self, relative: str, absolute: str) -> bool:
        """Whether any file in a folder would be denied."""
        probe = "__probe__.md"
        return bool(self._deny.search(f"{relative}/{probe}") or self._deny.search(f"{absolute}/{probe}"))

    def column(self, relative: Column, absolute: Column) -> Column:
        denied = relative.rlike(self.deny) | absolute.rlike(self.deny)
        return ~denied & (relative.rlike(self.allow) | absolute.rlike(self.allow))


def listing_roots(globs: list[str]) -> list[str]:
    """The folders, relative to a root, below which every match of the globs lies; none within another.

    A folder may hold one ``*``, where a glob goes on below a folder of any name.
    """
    found = []
    for glob in globs:
        parts, kept, stars = glob.split("/")[:-1], [], 0
        for part in parts:
            wild = any(c in part for c in "*?[{")
            if wild and (part != "*" or stars):
                break
            stars += wild
            kept.append(part)
        while kept and kept[-1] == "*" and len(kept) == len(parts):
            kept.pop()  # the last folder is any: list its parent
        found.append("/".join(kept) or ".")
    out = sorted(set(found), key=lambda f: (f.count("/"), f))
    if "." in out:
        return ["."]
    return [f for f in out if not any(f != g and f.startswith(g + "/") for g in out)]
