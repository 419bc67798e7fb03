"""Cutting texts into the pieces of a pattern; texts of Latin-1 take the faster engine."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import regex

#: Pieces handed on at a time, so that a very long text needs bounded memory.
RUN_PIECES = 65_536


def _ranges(members: str) -> str:
    """What matches among the first 256 characters, as the inside of a class."""
    found = [c for c in range(256) if regex.match(members, chr(c))]
    return "".join(re.escape(chr(c)) for c in found)


def latin_pattern(pattern: str) -> re.Pattern | None:
    """A pattern of the built-in engine that matches alike on Latin-1; None if there is none."""
    inside = {name: _ranges(name) for name in (r"\p{L}", r"\p{N}", r"\s")}
    out, in_class, i = [], False, 0
    while i < len(pattern):
        m = re.compile(r"\\p\{[LN]\}|\\.|.", re.DOTALL).match(pattern, i)
        part, i = m.group(), m.end()
        if part == "[" or part == "]":
            in_class = part == "["
        elif part in inside:
            part = inside[part] if in_class else f"[{inside[part]}]"
        elif part == r"\S" and not in_class:
            part = f"[^{inside[chr(92) + 's']}]"
        elif part[0] == "\\":
            return None
        out.append(part)
    try:
        return re.compile("".join(out))
    except re.error:
        return None


class Cutter:
    def __init__(self, pattern: str):
        self.pattern, self.latin = regex.compile(pattern), latin_pattern(pattern)

    def runs(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, a run at a time."""
        pattern = self.pattern
        if self.latin is not None:
            try:
                text.encode("latin-1")
                pattern = self.latin
            except UnicodeEncodeError:
                pass
        if len(text) <= RUN_PIECES:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while run := list(islice(found, RUN_PIECES)):
            yield run
