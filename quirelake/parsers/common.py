"""Segments: ordered (kind, content) pairs of a text, kind `text`, `placeholder` or `math`; their contents in order are
the text, always."""

from __future__ import annotations

Segment = tuple[str, str]
TEXT, PLACEHOLDER, MATH = "text", "placeholder", "math"


class Collector:
    """Gathers segments; neighbours of one kind are kept apart unless both are text."""

    def __init__(self) -> None:
        self.out: list[Segment] = []

    def add(self, kind: str, content: str) -> None:
        if not content:
            return
        if kind == TEXT and not content.strip():
            kind = PLACEHOLDER
        if kind == TEXT and self.out and self.out[-1][0] == TEXT:
            self.out[-1] = (TEXT, self.out[-1][1] + content)
        else:
            self.out.append((kind, content))

    def extend(self, segments: list[Segment]) -> None:
        for kind, content in segments:
            self.add(kind, content)


def closing(text: str, at: int, opening: str, end: str) -> int:
    """Place after the bracket that closes the one at `at`; the text's end if none does. A backslash protects."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == opening:
            depth += 1
        elif c == end:
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    return len(text)
