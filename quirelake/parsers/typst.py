"""Typst: translatable text against markup, and splitting into chunks."""

from __future__ import annotations

import re

from quirelake.parsers.common import MATH, PLACEHOLDER, TEXT, Collector, Segment, closing

#: argument names whose strings are text unless a map says otherwise, and those that never are (fixed values)
TEXT_ARGUMENTS = frozenset({"caption", "description", "info", "subtitle", "summary", "title"})
NEVER_TEXT = frozenset({"file", "id", "key", "label", "lang", "language", "path", "ref", "target", "url"})
RULES = ("show", "set", "let", "import", "include")
INLINE_FLUSH, SECTION_LIMIT, INTERNAL_LIMIT = 600, 2000, 2000

_TOKEN = re.compile(
    r"""(?P<line>//[^\n]*) | (?P<block>/\*.*?\*/) | (?P<raw>(?P<ticks>`{3,}).*?(?P=ticks) | `[^`\n]*`) | (?P<math>\$(?:\\.|[^$\\])*\$)
      | (?P<code>\#) | (?P<label><[\w:.-]+>) | (?P<ref>@[\w:-]+) | (?P<mark>\*|_|(?m:^=+[ ])|(?m:^[ \t]*(?:[-+]|\d+\.)[ ])|(?m:^/[ ])|~|\\[\S]|\\\n) | (?P<par>\n[ \t]*\n\s*)""",
    re.X | re.S,
)


def _code_end(text: str, at: int) -> int:
    """Where the code that begins with # at `at` ends."""
    rest = text[at + 1 :]
    if match := re.match(r"(?:show|set|let|import|include)\b", rest):
        i = at + 1 + match.end()
        while i < len(text) and text[i] not in "\n;":
            if text[i] in "([{":
                i = closing(text, i, text[i], {"(": ")", "[": "]", "{": "}"}[text[i]])
            elif text[i] == '"':
                end = re.compile(r'"(?:\\.|[^"\\])*"').match(text, i)
                i = end.end() if end else i + 1
            elif text[i] == "$":
                end = text.find("$", i + 1)
                i = end + 1 if end > 0 else i + 1
            else:
                i += 1
        return min(len(text), i + (i < len(text) and text[i] == ";"))
    i = at + 1
    if rest[:1] in ("{", "[", "("):
        return closing(text, i, rest[0], {"(": ")", "[": "]", "{": "}"}[rest[0]])
    name = re.match(r"[A-Za-z_][\w.-]*", rest)
    if not name:
        return i
    i += name.end()
    while i < len(text) and text[i] in "([":
        i = closing(text, i, text[i], {"(": ")", "[": "]"}[text[i]])
    return i


def _comment(text: str) -> list[Segment]:
    out = Collector()
    match = re.match(r"(?s)(// ?)(.*)$", text) or re.match(r"(?s)(/\* ?)(.*?)( ?\*/)$", text)
    out.add(PLACEHOLDER, match.group(1))
    out.add(TEXT, match.group(2))
    if match.lastindex == 3:
        out.add(PLACEHOLDER, match.group(3))
    return out.out


def _math(text: str) -> list[Segment]:
    """Mathematics; strings in it are text."""
    out, at = Collector(), 0
    for match in re.finditer(r'"((?:\\.|[^"\\])*)"', text):
        out.add(MATH, text[at : match.start(1)])
        out.add(TEXT, match.group(1))
        at = match.end(1)
    out.add(MATH, text[at:])
    return out.out


def _code(text: str, functions: dict[str, list[str]] | None) -> list[Segment]:
    """A command: content blocks are walked, named string arguments are text if their name says so."""
    out, at = Collector(), 0
    name = re.match(r"#([A-Za-z_][\w.-]*)", text)
    name = name.group(1) if name else ""
    if name in RULES or "[" not in text:
        return [(PLACEHOLDER, text)]
    allowed = None if functions is None else functions.get(name)
    pattern = re.compile(r'([A-Za-z_][\w-]*)\s*:\s*"((?:\\.|[^"\\])*)"|"(?:\\.|[^"\\])*"|\[')
    while match := pattern.search(text, at):
        if match.group() == "[":
            end = closing(text, match.start(), "[", "]")
            out.add(PLACEHOLDER, text[at : match.end()])
            out.extend(segments(text[match.end() : max(match.end(), end - 1)], functions))
            at = max(match.end(), end - 1)
            continue
        key = match.group(1)
        is_text = key and key not in NEVER_TEXT and (key in allowed if allowed is not None else key in TEXT_ARGUMENTS)
        if is_text:
            out.add(PLACEHOLDER, text[at : match.start(2)])
            out.add(TEXT, match.group(2))
            at = match.end(2)
        else:
            out.add(PLACEHOLDER, text[at : match.end()])
            at = match.end()
    out.add(PLACEHOLDER, text[at:])
    return out.out


def segments(text: str, functions: dict[str, list[str]] | None = None) -> list[Segment]:
    """The segments of a Typst text. functions: names of the arguments that are text, by function, in place of the
    default names."""
    out, at = Collector(), 0
    while match := _TOKEN.search(text, at):
        out.add(TEXT, text[at : match.start()])
        at = match.end()
        if match.group("line") or match.group("block"):
            out.extend(_comment(match.group()))
        elif match.group("math"):
            out.extend(_math(match.group()))
        elif match.group("code"):
            at = max(at, _code_end(text, match.start()))
            out.extend(_code(text[match.start() : at], functions))
        else:
            out.add(PLACEHOLDER, match.group())
    out.add(TEXT, text[at:])
    return out.out


def _units(text: str) -> list[tuple[str, str]]:
    """(kind, content) of the units of a document: heading, block, inline or par."""
    out: list[tuple[str, str]] = []
    pattern = re.compile(r"(?P<head>(?m:^)=+[ ][^\n]*\n?)|(?P<raw>`{3,}.*?`{3,}\n?)|(?P<rule>(?m:^)\#(?:show|set|let|import|include)\b)|(?P<call>\#)|(?P<par>\n[ \t]*\n\s*)", re.S)
    at = 0
    while match := pattern.search(text, at):
        if match.start() > at:
            out.append(("inline", text[at : match.start()]))
        at = match.end()
        if match.group("head"):
            out.append(("heading", match.group()))
        elif match.group("par"):
            out.append(("par", match.group()))
        elif match.group("raw"):
            out.append(("block", match.group()))
        else:
            at = max(at, _code_end(text, match.start()))
            out.append(("block" if match.group("rule") else "inline", text[match.start() : at]))
    if at < len(text):
        out.append(("inline", text[at:]))
    return out


def chunks(text: str) -> list[tuple[str, str]]:
    """(id, content): inline units collected to 600 characters, sections of up to 2,000 whole, longer ones packed.

    Chunks are numbered before blank ones are left out; their contents in order are the document but for those."""
    elements: list[tuple[str, str]] = []
    inline: list[str] = []

    def flush() -> None:
        if inline:
            elements.append(("inline", "".join(inline)))
            inline.clear()

    for kind, content in _units(text):
        if kind in ("inline", "par"):
            inline.append(content)
            if kind == "par" or sum(map(len, inline)) >= INLINE_FLUSH:
                flush()
        else:
            flush()
            elements.append((kind, content))
    flush()
    sections: list[list[str]] = [[]]
    for kind, content in elements:
        if kind == "heading" and sections[-1]:
            sections.append([])
        sections[-1].append(content)
    packed: list[str] = []
    for section in sections:
        if sum(map(len, section)) <= SECTION_LIMIT:
            packed.append("".join(section))
            continue
        current = ""
        for content in section:
            if current and len(current) + len(content) > SECTION_LIMIT:
                packed.append(current)
                current = ""
            current += content
        packed.append(current)
    return [(f"auto_chunk_{i}", content) for i, content in enumerate(packed, 1) if content.strip()]


def subchunks(text: str, limit: int = INTERNAL_LIMIT, functions: dict[str, list[str]] | None = None) -> list[str]:
    """Parts of an oversized chunk: segments packed to the limit; only text is divided, at natural boundaries."""
    from quirelake.operators.ordered import split_at_boundary

    parts: list[str] = []
    for kind, content in segments(text, functions):
        parts += split_at_boundary(content, limit) if kind == TEXT and len(content) > limit else [content]
    out, current = [], ""
    for part in parts:
        if current and len(current) + len(part) > limit:
            out.append(current)
            current = ""
        current += part
    out = [*out, current] if current else out
    return out if "".join(out) == text else [text]
