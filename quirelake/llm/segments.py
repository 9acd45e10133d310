"""Sentences, paragraphs and natural-language words of texts with markup, as arrays over a block of texts.

Sentences: a text is divided at line breaks and at white space after '.', '!' or '?'; blank pieces do not count.
Paragraphs: the blocks between blank lines. Both are found in the text as it is; words are read from a copy of equal
length in which code, mathematics, commands and other markup are blanked out.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np

from quirelake.llm.textkernel import LETTER, SPACE, Block, class_table

_PROSE_FENCES = "note|warning|tip|important|caution|hint|danger|attention|seealso|admonition|exercise|theorem|proof"
_CODE_ENVIRONMENTS = "equation|align|gather|multline|eqnarray|verbatim|Verbatim|lstlisting|minted|math|displaymath|tikzpicture"
_CODE_LINE = (
    r"[ \t]*(?:(?:assert|import|from|for|while|if|def|class|return|print)\b[^\n]*[=(:\[][^\n]*"
    r"|[A-Za-z_][\w.\[\]]*(?:,[ ]*[A-Za-z_][\w.\[\]]*)*[ ]*[+*/-]?=[ ][^\n]*)$"
)
#: what begins at a line's beginning first, then what begins with one of a few signs, so that most places fail at once
_MARKUP = re.compile(
    rf"""
      \A﻿?---[ \t]*\r?\n.*?\n---[ \t]*(?=\r?\n|\Z)
    | ^(?:
        [ \t]*(?P<fence>`{{3,}}|~{{3,}})(?!\s*\{{(?:{_PROSE_FENCES})\b)[^\n]*(?:\n.*?(?:^[ \t]*(?P=fence)[ \t]*\r?$|\Z)|\Z)
      | (?:^[ \t]*\#[ ][^\n]*\n)*^{_CODE_LINE}(?:\n(?:[ \t]*\#[ ][^\n]*$|{_CODE_LINE}))*
      | [ \t]*:{{3,}}[^\n]*$ | \([\w:-]+\)=[^\n]*$ | [ \t]*:[\w-]+:[^\n]*$
      | [ \t]*\#(?:set|let|show|import|include)\b[^\n]*$
      )
    | (?=[\\$`{{<@h&])(?:
        \\begin\{{(?P<env>{_CODE_ENVIRONMENTS})\*?\}}.*?(?:\\end\{{(?P=env)\*?\}}|\Z)
      | \$\$.*?\$\$ | \$[^$\n]*\$ | \\\[.*?\\\] | \\\([^\n]*?\\\)
      | `[^`\n]*`
      | \\(?:begin|end|label|ref|eqref|autoref|cite|usepackage|documentclass|includegraphics|input|include|url)\*?
        (?:\[[^\]\n]*\])?(?:\{{[^}}\n]*\}})?
      | \\[a-zA-Z]+\*?
      | \{{[A-Za-z:_-]+\}}
      | <[^<>\n]+> | @[\w:-]+ | https?://\S+ | &\#?\w+;
      )
    """,
    re.X | re.M | re.S,
)


def _blank(match: re.Match) -> str:
    text = match.group()
    return "\n".join(" " * len(line) for line in text.split("\n")) if "\n" in text else " " * len(text)


def without_markup(text: str) -> str:
    """The text with everything that is no natural language blanked out, at equal length."""
    return _MARKUP.sub(_blank, text)


#: tags of the translation format, and names of commands
_WRAPPED = re.compile(r"</?(?:document|TEXT|PH)\b[^<>\n]*>|\\[A-Za-z]+\*?")


def unwrapped(text: str | None) -> str:
    """The text with the tags of the translation format and the names of commands blanked out, at equal length."""
    return _WRAPPED.sub(lambda m: " " * len(m.group()), text) if text and ("<" in text or "\\" in text) else text or ""


@lru_cache(maxsize=1)
def _word_table() -> np.ndarray:
    """Letters and the marks that go with them."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower case of every code point that has one of length one."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(0x20000):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


class Segments:
    """Sentences, paragraphs and words of a block."""

    def __init__(self, block: Block, masked: Block | None = None):
        self.block = block
        cps, n, bounds = block.cps, block.n, block.bounds
        opens = np.zeros(n + 1, bool)
        opens[bounds] = True
        space = class_table()[cps] == SPACE
        ink = np.concatenate([[0], np.cumsum(~space)])
        # sentences
        cut = opens.copy()
        if n:
            stop = (cps == 46) | (cps == 33) | (cps == 63)
            cut[1:n] |= stop[:-1] & space[1:]
            cut[1:] |= cps == 10
        at = np.flatnonzero(cut)
        begins, ends = at[:-1], at[1:]
        full = ink[ends] > ink[begins]
        self.begins, self.ends = begins[full], ends[full]
        self.text = block.texts_of(self.begins) if len(self.begins) else np.zeros(0, np.int64)
        #: first sentence of each text, and the number of sentences at the end
        self.first = np.searchsorted(self.text, np.arange(len(block.texts) + 1))
        #: number of the sentence in its text, from 1
        self.number = np.arange(len(self.begins)) - self.first[self.text] + 1
        # paragraphs
        line_cut = opens.copy()
        if n:
            line_cut[1:] |= cps == 10
        lines = np.flatnonzero(line_cut)
        if len(lines) > 1:
            inked = ink[lines[1:]] > ink[lines[:-1]]
            new = inked.copy()
            new[1:] &= ~inked[:-1] | opens[lines[1:-1]]
            paragraph = np.cumsum(new) - 1
            starts = lines[:-1][new]
            self.paragraph = paragraph[np.searchsorted(lines, self.begins, side="right") - 1]
            self.paragraph_text = block.texts_of(starts) if len(starts) else np.zeros(0, np.int64)
        else:
            self.paragraph = np.zeros(0, np.int64)
            self.paragraph_text = np.zeros(0, np.int64)
        first = np.searchsorted(self.paragraph_text, np.arange(len(block.texts) + 1))
        self.paragraph_number = np.arange(len(self.paragraph_text)) - first[self.paragraph_text] + 1
        # words
        self.plain = masked or block
        self.lower = lower_table()[self.plain.cps]
        inside = np.concatenate([[False], _word_table()[self.plain.cps], [False]])
        starts = inside[1:-1] & (~inside[:-2] | opens[:n])
        finish = inside[1:-1] & (~inside[2:] | opens[1:])
        begins, ends = np.flatnonzero(starts), np.flatnonzero(finish) + 1
        # marks without a letter before them are no words
        real = class_table()[self.plain.cps[begins]] == LETTER
        self.word_begins, self.word_ends = begins[real], ends[real]
        #: first word of each sentence
        self.first_word = np.searchsorted(self.word_begins, self.begins)
        self.last_word = np.searchsorted(self.word_begins, self.ends)

    def word_hashes(self) -> np.ndarray:
        return self.plain.hashes(self.word_begins, self.word_ends, self.lower)

    def word(self, i: int) -> str:
        return self.plain.joined[self.word_begins[i] : self.word_ends[i]].lower()


def segment(block: Block) -> Segments:
    """Segments of a block, with words read from the text without markup."""
    return Segments(block, Block([without_markup(t) if t else t for t in block.texts], block.first))
