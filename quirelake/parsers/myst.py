"""MyST Markdown: translatable text against markup, block tokens, and splitting into chunks."""

from __future__ import annotations

import re

from quirelake.parsers.common import PLACEHOLDER, TEXT, Collector, Segment

#: directives whose title is text and whose body is parsed again (fixed values)
TITLED = frozenset({
    "admonition", "attention", "caution", "danger", "error", "hint", "important", "note", "seealso", "tip", "warning", "dropdown", "card", "grid-item-card",
    "tab-item", "topic", "exercise", "theorem", "proof", "definition", "aside", "sidebar",
})
BODIED = TITLED | {"figure"}
SECTION_LIMIT = 2000

_INLINE = re.compile(
    r"""(?P<code>(?P<ticks>`+)(?!`).*?(?<!`)(?P=ticks)(?!`)) | (?P<role>\{[A-Za-z][\w:-]*\}(?=`)) | (?P<math>\$\$.*?\$\$|(?<!\\)\$(?:\\.|[^$\\\n])+\$)
      | (?P<image>!\[(?P<alt>[^\]\n]*)\]\([^)\n]*\)) | (?P<link>\[(?P<label>[^\]\n]*)\](?:\([^)\n]*\)|\[[^\]\n]*\])) | (?P<foot>\[\^[^\]\n]+\])
      | (?P<html><!--.*?-->|</?[A-Za-z][^<>\n]*>|<https?://[^>\s]+>) | (?P<substitution>\{\{.*?\}\}) | (?P<attrs>\{[.#][^}\n]*\}) | (?P<hard>(?:[ ]{2,}|\\)\n)
      | (?P<strong>\*{1,3}|_{1,3}(?=\w)|(?<=\w)_{1,3}(?!\w)) | (?P<escape>\\[^\w\s])""",
    re.X | re.S,
)


def inline(text: str) -> list[Segment]:
    """The segments of running text."""
    out, at = Collector(), 0
    while match := _INLINE.search(text, at):
        out.add(TEXT, text[at : match.start()])
        at = match.end()
        if match.group("role"):
            code = _INLINE.match(text, at)
            end = code.end() if code and code.group("code") else at
            body = text[at:end]
            ticks = len(body) - len(body.lstrip("`"))
            if match.group("role") == "{definiendum}" and ticks:
                # a definition is text, the target that it may name included
                out.add(PLACEHOLDER, match.group() + body[:ticks])
                out.add(TEXT, body[ticks : len(body) - ticks])
                out.add(PLACEHOLDER, body[len(body) - ticks :])
            else:
                out.add(PLACEHOLDER, match.group() + body)
            at = end
        elif match.group("link") or match.group("image"):
            name = "label" if match.group("link") else "alt"
            a, b = match.span(name)
            out.add(PLACEHOLDER, text[match.start() : a])
            out.extend(inline(text[a:b]))
            out.add(PLACEHOLDER, text[b : match.end()])
        else:
            out.add(PLACEHOLDER, match.group())
    out.add(TEXT, text[at:])
    return out.out


_FENCE = re.compile(r"^([ ]{0,3})(`{3,}|~{3,}|:{3,})[ \t]*(\{[\w:+.-]+\})?([^\n]*)(\n?)$")
_HEADING = re.compile(r"^([ ]{0,3}#{1,6}[ \t]+)([^\n]*?)([ \t]*#*[ \t]*\n?)$")
_ITEM = re.compile(r"^([ \t]*(?:[-+*]|\d+[.)])[ \t]+(?:\[[ xX]\][ \t]+)?)(.*)$", re.S)
_TARGET = re.compile(r"^\([^)\n]+\)=[ \t]*\n?$")
_RULE = re.compile(r"^[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\n?$")


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(kind, first line, line after the last) of the blocks of a document."""
    lines = text.splitlines(keepends=True)
    out: list[tuple[str, int, int]] = []
    i, n = 0, len(lines)
    if lines and lines[0].strip() == "---":
        end = next((k for k in range(1, n) if lines[k].strip() in ("---", "...")), None)
        if end is not None:
            out.append(("front_matter", 0, end + 1))
            i = end + 1
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        begin = i
        if fence := _FENCE.match(line):
            mark = fence.group(2)
            i += 1
            depth = 1
            while i < n and depth:
                other = _FENCE.match(lines[i])
                if other and other.group(2)[0] == mark[0] and len(other.group(2)) >= len(mark):
                    bare = not (other.group(3) or other.group(4).strip())
                    depth += -1 if bare else (1 if mark[0] == ":" else 0)
                i += 1
            out.append(("directive" if fence.group(3) or mark[0] == ":" else "fence", begin, i))
        elif line.startswith("$$"):
            i += 1
            if line.strip().count("$$") < 2:
                while i < n and "$$" not in lines[i]:
                    i += 1
                i += i < n
            out.append(("math_block", begin, i))
        elif match := re.match(r"^\\begin\{([a-z]+\*?)\}", line):
            close = f"\\end{{{match.group(1)}}}"
            while i < n and close not in lines[i]:
                i += 1
            i += i < n
            out.append(("amsmath", begin, i))
        elif _HEADING.match(line):
            i += 1
            out.append(("heading", begin, i))
        elif _TARGET.match(line):
            i += 1
            out.append(("myst_target", begin, i))
        elif line.startswith("%"):
            while i < n and lines[i].startswith("%"):
                i += 1
            out.append(("line_comment", begin, i))
        elif line.startswith("+++"):
            i += 1
            out.append(("block_break", begin, i))
        elif _RULE.match(line):
            i += 1
            out.append(("hr", begin, i))
        elif line.lstrip().startswith("<!--"):
            while i < n and "-->" not in lines[i]:
                i += 1
            i += i < n
            out.append(("html", begin, i))
        else:
            kind = "list" if _ITEM.match(line) else "blockquote" if line.lstrip().startswith(">") else "footnote" if re.match(r"^\[\^[^\]]+\]:", line) else "table" if "|" in line and i + 1 < n and re.match(r"^[\s|:-]+\n?$", lines[i + 1]) and "-" in lines[i + 1] else "paragraph"
            i += 1
            while i < n and lines[i].strip() and not (_FENCE.match(lines[i]) or _HEADING.match(lines[i]) or _TARGET.match(lines[i]) or lines[i].startswith("$$")):
                if kind == "paragraph" and re.match(r"^[ ]{0,3}(=+|-+)[ \t]*\n?$", lines[i]):
                    kind = "heading"
                    i += 1
                    break
                i += 1
            # list items go on after blank lines when what follows is indented or another item
            while kind == "list" and i < n and not lines[i].strip():
                k = i
                while k < n and not lines[k].strip():
                    k += 1
                if k < n and (lines[k].startswith((" ", "\t")) or _ITEM.match(lines[k])):
                    i = k
                    while i < n and lines[i].strip():
                        i += 1
                else:
                    break
            out.append((kind, begin, i))
    return out


def segments(text: str) -> list[Segment]:
    """The segments of a MyST text."""
    lines = text.splitlines(keepends=True)
    out, at = Collector(), 0
    for kind, begin, end in tokens(text):
        out.add(PLACEHOLDER, "".join(lines[at:begin]))
        block = lines[begin:end]
        at = end
        if kind == "directive":
            out.extend(_directive(block))
        elif kind == "heading" and (match := _HEADING.match(block[0])):
            out.add(PLACEHOLDER, match.group(1))
            out.extend(inline(match.group(2)))
            out.add(PLACEHOLDER, match.group(3))
        elif kind == "heading":
            out.extend(inline("".join(block[:-1])))
            out.add(PLACEHOLDER, block[-1])
        elif kind in ("list", "blockquote", "footnote"):
            out.extend(_prefixed(block))
        elif kind == "table":
            for line in block:
                for cell in re.split(r"((?<!\\)\||\n)", line):
                    out.extend([(PLACEHOLDER, cell)] if cell in ("|", "\n") or re.fullmatch(r"[\s:-]*", cell) else inline(cell))
        elif kind == "paragraph":
            out.extend(inline("".join(block)))
        else:
            out.add(PLACEHOLDER, "".join(block))
    out.add(PLACEHOLDER, "".join(lines[at:]))
    return out.out


def _prefixed(block: list[str]) -> list[Segment]:
    """Items, quotes and notes: the marks are placeholders, what follows is text or a block of its own."""
    out = Collector()
    prefix = re.compile(r"^((?:[ \t]*(?:>|[-+*](?=[ \t])|\d+[.)](?=[ \t])|\[\^[^\]]+\]:))*[ \t]*(?:\[[ xX]\][ \t]+)?)(.*)$", re.S)
    inside_fence = ""
    for line in block:
        head, rest = prefix.match(line).groups()
        fence = re.match(r"(`{3,}|~{3,}|:{3,}|\$\$)", rest)
        if inside_fence or fence:
            if fence and (not inside_fence or rest.strip() == inside_fence):
                inside_fence = "" if inside_fence else fence.group(1)
            out.add(PLACEHOLDER, line)
            continue
        out.add(PLACEHOLDER, head)
        out.extend(inline(rest))
    return out.out


def _directive(block: list[str]) -> list[Segment]:
    out = Collector()
    head = _FENCE.match(block[0])
    name = (head.group(3) or "")[1:-1]
    if not name:
        inner = re.match(r"\s*\{([\w:+.-]+)\}(.*)$", head.group(4), re.S)
        name = inner.group(1) if inner else ""
    closed = len(block) > 1 and bool(_FENCE.match(block[-1])) and not _FENCE.match(block[-1]).group(4).strip()
    body = block[1:-1] if closed else block[1:]
    title_at = block[0].rfind("}") + 1
    if name in TITLED and title_at:
        out.add(PLACEHOLDER, block[0][:title_at])
        out.extend(inline(block[0][title_at:]))
    else:
        out.add(PLACEHOLDER, block[0])
    if name in BODIED or (not name and block[0].startswith(":")):
        k = 0
        while k < len(body) and re.match(r"^[ \t]*:[\w-]+:", body[k]):
            k += 1
        out.extend(_options(body[:k], name))
        # one blank line after the options goes with them
        if k and k < len(body) and not body[k].strip():
            out.add(PLACEHOLDER, body[k])
            k += 1
        out.extend(segments("".join(body[k:])))
    else:
        k = 0
        while name in ("image", "video") and k < len(body) and re.match(r"^[ \t]*:[\w-]+:", body[k]):
            k += 1
        out.extend(_options(body[:k], name))
        out.add(PLACEHOLDER, "".join(body[k:]))
    if closed:
        out.add(PLACEHOLDER, block[-1])
    return out.out


def _options(lines: list[str], name: str) -> list[Segment]:
    """Options are markup, but an `alt` text of pictures is text."""
    out = Collector()
    for line in lines:
        match = re.match(r"^([ \t]*:alt:[ \t]*)([^\n]*)(\n?)$", line)
        if match and name in ("figure", "image", "video"):
            out.add(PLACEHOLDER, match.group(1))
            out.extend(inline(match.group(2)))
            out.add(PLACEHOLDER, match.group(3))
        else:
            out.add(PLACEHOLDER, line)
    return out.out


def chunks(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, first line, line after the last, content): sections of up to 2,000 characters whole, longer ones by block.

    A heading opens a section and takes the labels before it along; blank lines go with the block before them, but not
    after the last block; what stands before the first block is left out."""
    lines = text.splitlines()
    found = tokens(text)
    if not found:
        return []
    starts = [begin for _, begin, _ in found]
    spans = [(kind, begin, starts[i + 1] if i + 1 < len(found) else end) for i, (kind, begin, end) in enumerate(found)]
    sections: list[list[tuple[str, int, int]]] = [[]]
    waiting: list[tuple[str, int, int]] = []
    for span in spans:
        if span[0] == "myst_target":
            waiting.append(span)
            continue
        if span[0] == "heading" and sections[-1]:
            sections.append([])
        sections[-1] += [*waiting, span]
        waiting = []
    sections[-1] += waiting
    out = []
    content = lambda a, b: "".join(line + "\n" for line in lines[a:b])
    for section in sections:
        if not section:
            continue
        begin, end = section[0][1], section[-1][2]
        whole = content(begin, end)
        if len(whole) > SECTION_LIMIT:
            out += [(kind, a, b, content(a, b)) for kind, a, b in section]
        else:
            out.append(("section", begin, end, whole))
    return out
