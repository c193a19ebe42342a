"""Scope patterns. They match bytes, so a path is looked at as Latin-1 text of its UTF-8 bytes."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern_regex(pattern: str) -> str:
    """A regular expression for a path with a slash after its last segment. Only a whole segment ``**`` spans segments."""
    out = []
    for segment in pattern.split("/"):
        if segment == "**":
            out.append("(?:[^/]*/)*")
        else:
            out += ["[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in segment] + ["/"]
    return "".join(out)


@dataclass(frozen=True)
class Scope:
    """A path is in scope if it matches an include and no exclude. Patterns are Latin-1 text of bytes."""

    includes: tuple[str, ...]
    excludes: tuple[str, ...] = ()

    @staticmethod
    def _any(patterns: Iterable[str]) -> str:
        return "^(?:" + "|".join(map(pattern_regex, patterns)) + ")$"

    def matches(self, path: str) -> bool:
        text = path.encode("utf-8", "surrogateescape").decode("latin-1") + "/"
        found = lambda patterns: bool(patterns) and re.fullmatch("|".join(f"(?:{pattern_regex(p)})" for p in patterns), text, re.DOTALL) is not None
        return found(self.includes) and not found(self.excludes)

    def condition(self, path: Column) -> Column:
        """The same as a column expression."""
        text = F.concat(F.decode(path.cast("binary"), "ISO-8859-1"), F.lit("/"))
        found = lambda patterns: text.rlike("(?s)" + self._any(patterns).replace("^", r"\A", 1)[:-1] + r"\z") if patterns else F.lit(False)
        return found(self.includes) & ~found(self.excludes)
