"""Program code: comments and the insides of strings are text, all else is markup."""

from __future__ import annotations

import io
import re
import tokenize

from quirelake.parsers.common import PLACEHOLDER, TEXT, Collector, Segment

_STRING = re.compile(r"^([A-Za-z]*)(\"\"\"|'''|\"|')(.*)(\2)$", re.S)
#: comments and strings of the languages without a tokenizer of their own (fixed values)
_PATTERNS = {
    "java": re.compile(r'(//[^\n]*)|(/\*.*?\*/)|("""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*")', re.S),
    "rust": re.compile(r'(//[^\n]*)|(/\*.*?\*/)|(b?r(#*)".*?"\4|b?"(?:\\.|[^"\\])*")', re.S),
}
LANGUAGES = ("python", *_PATTERNS)


def _string(out: Collector, literal: str) -> None:
    match = _STRING.match(literal)
    if not match:
        out.add(PLACEHOLDER, literal)
        return
    out.add(PLACEHOLDER, literal[: match.start(3)])
    out.add(TEXT, match.group(3))
    out.add(PLACEHOLDER, match.group(4))


def _comment(out: Collector, comment: str) -> None:
    match = re.match(r"(?s)^(#+!?[ ]?|//+!?[ ]?|/\*+[ ]?)(.*?)([ ]?\*/)?$", comment)
    out.add(PLACEHOLDER, match.group(1))
    out.add(TEXT, match.group(2))
    out.add(PLACEHOLDER, match.group(3) or "")


def segments(source: str, language: str = "python") -> list[Segment]:
    """The segments of a program; one placeholder if its language is not known or it cannot be read."""
    out, at = Collector(), 0
    if language == "python":
        starts = [0]
        for line in source.splitlines(keepends=True):
            starts.append(starts[-1] + len(line))
        try:
            for token in tokenize.generate_tokens(io.StringIO(source).readline):
                if token.type in (tokenize.COMMENT, tokenize.STRING):
                    begin, end = starts[token.start[0] - 1] + token.start[1], starts[token.end[0] - 1] + token.end[1]
                    if source[begin:end] != token.string:
                        return [(PLACEHOLDER, source)]
                    out.add(PLACEHOLDER, source[at:begin])
                    (_comment if token.type == tokenize.COMMENT else _string)(out, token.string)
                    at = end
        except (tokenize.TokenError, SyntaxError):
            return [(PLACEHOLDER, source)] if source else []
    elif language in _PATTERNS:
        for match in _PATTERNS[language].finditer(source):
            out.add(PLACEHOLDER, source[at : match.start()])
            (_string if match.group(3) else _comment)(out, match.group())
            at = match.end()
    out.add(PLACEHOLDER, source[at:])
    return out.out
