"""LaTeX: translatable text against markup, and splitting into chunks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quirelake.parsers.common import PLACEHOLDER, TEXT, Collector, Segment, closing

#: names with a fixed meaning (fixed values)
PLACEHOLDER_COMMANDS = frozenset({"ref", "autoref", "cite", "label", "includegraphics", "input", "include", "frac", "sqrt", "path", "url", "href", "verb"})
PLACEHOLDER_ENVIRONMENTS = frozenset({"verbatim", "Verbatim", "lstlisting", "minted"})
MATH_ENVIRONMENTS = frozenset({
    "equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*", "eqnarray", "eqnarray*", "alignat", "alignat*",
    "flalign", "flalign*", "aligned", "gathered", "math", "displaymath", "dmath", "dmath*",
})
MATH_TEXT_COMMANDS = frozenset({"text", "mathrm", "mathbf", "operatorname", "mathit", "textrm", "textit", "mathsf", "mathtt", "boldsymbol"})
DEFINITIONS = frozenset({"newcommand", "renewcommand", "providecommand", "def", "DeclareMathOperator", "newenvironment", "renewenvironment", "newtheorem"})
OWN_CHUNK = frozenset({"section", "subsection", "subsubsection", "chapter", "part", "paragraph", "subparagraph", "title", "maketitle"})
INLINE_FLUSH = 600

_TOKEN = re.compile(
    r"""(?P<comment>(?<!\\)%[^\n]*) | \\verb\*?(?P<v>[^\sA-Za-z*])[^\n]*?(?P=v) | \\[A-Za-z]+\*?\|[^|\n]*\|
      | \\begin\{(?P<begin>[^}\n]*)\} | \\end\{(?P<end>[^}\n]*)\}
      | (?P<display>\$\$.*?\$\$ | \\\[.*?\\\]) | (?P<inline>(?<!\\)\$(?:\\.|[^$\\])+\$ | \\\(.*?\\\))
      | \\(?P<command>[A-Za-z]+) | (?P<escape>\\.) | (?P<brace>[{}\[\]&~])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Settings:
    """Names in addition to the fixed ones; per command the numbers of its translatable mandatory and optional
    arguments (from 1; a command in the map has all others as placeholders); arities of custom commands."""

    placeholder_environments: frozenset[str] = frozenset()
    math_environments: frozenset[str] = frozenset()
    placeholder_commands: frozenset[str] = frozenset()
    translatable_args: dict[str, dict[str, list[int]]] = field(default_factory=dict)
    arities: dict[str, dict[str, int]] = field(default_factory=dict)


DEFAULT = Settings()


def _arguments(text: str, at: int, optional: int = 99, mandatory: int = 99) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of the bracketed arguments that follow directly."""
    out = []
    while at < len(text):
        if text[at] == "[" and optional > 0:
            end, optional, kind = closing(text, at, "[", "]"), optional - 1, "optional"
        elif text[at] == "{" and mandatory > 0:
            end, mandatory, kind = closing(text, at, "{", "}"), mandatory - 1, "mandatory"
        else:
            break
        out.append((kind, at, end))
        at = end
    return out


def _math(text: str, settings: Settings) -> list[Segment]:
    """Mathematics, of which only the arguments of text commands are text."""
    out, at = Collector(), 0
    for match in re.finditer(r"\\([A-Za-z]+)\*?\{", text):
        if match.group(1) not in MATH_TEXT_COMMANDS or match.start() < at:
            continue
        end = closing(text, match.end() - 1, "{", "}")
        if match.group(1) in ("text", "textrm", "textit"):
            out.add(PLACEHOLDER, text[at : match.end()])
            out.extend(segments(text[match.end() : end - 1], settings))
            at = end - 1
    out.add(PLACEHOLDER, text[at:])
    return out.out


def segments(text: str, settings: Settings = DEFAULT) -> list[Segment]:
    """The segments of a LaTeX text."""
    if "\\end{document}" in text and "\\begin{document}" not in text:
        return [(PLACEHOLDER, text)] if text else []
    out, at = Collector(), 0
    placeholder_envs = PLACEHOLDER_ENVIRONMENTS | settings.placeholder_environments
    math_envs = MATH_ENVIRONMENTS | settings.math_environments
    while match := _TOKEN.search(text, at):
        out.add(TEXT, text[at : match.start()])
        at = match.end()
        name = match.group("command")
        environment = match.group("begin")
        if environment is not None:
            if environment in placeholder_envs or environment in math_envs:
                close = f"\\end{{{environment}}}"
                stop = text.find(close, at)
                stop = len(text) if stop < 0 else stop + len(close)
                whole = text[match.start() : stop]
                out.extend(_math(whole, settings) if environment in math_envs else [(PLACEHOLDER, whole)])
                at = stop
            else:
                arguments = _arguments(text, at)
                at = arguments[-1][2] if arguments else at
                out.add(PLACEHOLDER, text[match.start() : at])
        elif match.group("display") or match.group("inline"):
            out.extend(_math(match.group(), settings))
        elif name is None:
            out.add(PLACEHOLDER, match.group())
        elif name in PLACEHOLDER_COMMANDS or name in settings.placeholder_commands:
            arguments = _arguments(text, at)
            at = arguments[-1][2] if arguments else at
            out.add(PLACEHOLDER, text[match.start() : at])
        elif name in DEFINITIONS:
            arguments = _arguments(text, at + (text[at : at + 1] == "*"))
            if arguments:
                last = arguments[-1]
                out.add(PLACEHOLDER, text[match.start() : last[1] + 1])
                out.extend(segments(text[last[1] + 1 : last[2] - 1], settings))
                out.add(PLACEHOLDER, text[max(last[1] + 1, last[2] - 1) : last[2]])
                at = last[2]
            else:
                out.add(PLACEHOLDER, match.group())
        elif name in settings.translatable_args:
            arity = settings.arities.get(name, {})
            chosen, counts = settings.translatable_args[name], {"optional": 0, "mandatory": 0}
            out.add(PLACEHOLDER, match.group())
            for kind, begin, end in _arguments(text, at, arity.get("optional", 99), arity.get("mandatory", 99)):
                counts[kind] += 1
                if counts[kind] in chosen.get(kind, ()):
                    out.add(PLACEHOLDER, text[begin])
                    out.extend(segments(text[begin + 1 : end - 1], settings))
                    out.add(PLACEHOLDER, text[max(begin + 1, end - 1) : end])
                else:
                    out.add(PLACEHOLDER, text[begin:end])
                at = end
        else:
            # a star after the name is text, like the arguments, which are walked
            out.add(PLACEHOLDER, match.group())
    out.add(TEXT, text[at:])
    return out.out


def chunks(text: str) -> list[str]:
    return [content for _, content in named_chunks(text)]


def named_chunks(text: str) -> list[tuple[str, str]]:
    """(id, content) of the chunks of a LaTeX document, stripped, without blank ones; those of its body are numbered as
    such, from 0 on with the chunks before them counted."""
    opening, end = "\\begin{document}", "\\end{document}"
    if opening in text:
        head, _, rest = text.partition(opening)
        body, _, _ = rest.partition(end)
        found = [head, opening, *_body_chunks(body), end]
    else:
        found = _body_chunks(text)
    inside = opening in text
    kept = [c.strip() for c in found if c.strip()]
    body_at = kept.index(opening) if inside and opening in kept else len(kept)
    return [(f"{'doc_body' if inside and body_at < i < len(kept) - 1 else 'auto_chunk'}_{i}", c) for i, c in enumerate(kept)]


def _body_chunks(text: str) -> list[str]:
    out: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        if inline:
            out.append("".join(inline))
            inline.clear()

    def collect(piece: str) -> None:
        for part in re.split(r"(?<=\n\n)", piece) if piece.count("\n\n") else [piece]:
            inline.append(part)
            if sum(map(len, inline)) >= INLINE_FLUSH:
                flush()

    at = 0
    pattern = re.compile(r"(?<!\\)%[^\n]*|\\begin\{([^}\n]*)\}|\\([A-Za-z]+)\*?")
    while match := pattern.search(text, at):
        environment, name = match.group(1), match.group(2)
        if environment is None and name not in OWN_CHUNK:
            collect(text[at : match.end()])
            at = match.end()
            continue
        collect(text[at : match.start()])
        flush()
        if environment is not None:
            at = _environment_end(text, match)
        else:
            arguments = _arguments(text, match.end())
            at = arguments[-1][2] if arguments else match.end()
        out.append(text[match.start() : at])
    collect(text[at:])
    flush()
    return out


def _environment_end(text: str, begin: re.Match) -> int:
    depth = 0
    for match in re.finditer(rf"\\(begin|end)\{{{re.escape(begin.group(1))}\}}", text[begin.start() :]):
        depth += 1 if match.group(1) == "begin" else -1
        if depth == 0:
            return begin.start() + match.end()
    return len(text)
