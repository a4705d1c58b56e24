"""Path patterns: globs to one regular expression, for what a scan takes and leaves out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A regular expression (Java's and RE2's alike) of what a glob matches as a whole.

    ``*`` and ``?`` stay within a folder, ``**/`` stands for any folders and ``**`` for all below; ``[a-z]`` and ``[!a-z]`` are classes within a folder,
    ``{a,b}`` alternatives, a back slash takes the next sign as it is. A bracket or brace that never closes is itself. A pattern without a slash but at its end matches in any folder; one that
    ends in a slash all below that folder.
    """
    bare = pattern.lstrip("/")
    if "/" not in pattern.rstrip("/") and not pattern.startswith("/"):
        bare = "**/" + bare
    if bare.endswith("/"):
        bare += "**"
    out, i, depth = "", 0, 0
    while i < len(bare):
        c = bare[i]
        if bare.startswith("**/", i) and (i == 0 or bare[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if bare.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "\\" and i + 1 < len(bare):
            out, i = out + re.escape(bare[i + 1]), i + 2
            continue
        if c == "[" and (end := bare.find("]", i + 2)) > 0:
            body = bare[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[^/" + body[1:] + "]" if body[0] in "!^" else "[" + body + "]"
            i = end + 1
            continue
        if c == "{" and "}" in bare[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


def selected(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a scan takes a path (from its root, without a leading slash): one of include matches (all paths, where there are none), and none of exclude.

    A pattern that begins with ``!`` takes back what earlier ones of its list say; the last one that matches counts.
    """

    def listed(patterns: list[str], otherwise: bool) -> Column:
        out = F.lit(otherwise)
        for run_negated, run in _runs(patterns):
            out = F.when(path.rlike("|".join(glob_regex(p) for p in run)), F.lit(not run_negated)).otherwise(out)
        return out

    first = (include or [""])[0].startswith("!")
    return listed(include or [], not include or first) & ~listed(exclude or [], False)


def _runs(patterns: list[str]) -> list[tuple[bool, list[str]]]:
    """Neighbouring patterns of one sign together, so that each run is one expression."""
    out: list[tuple[bool, list[str]]] = []
    for p in patterns:
        negated = p.startswith("!")
        if not out or out[-1][0] != negated:
            out.append((negated, []))
        out[-1][1].append(p[1:] if negated else p)
    return out
