"""Pairing of the sentences of two texts that are rough translations of each other.

Method: length-based dynamic programming.  A translated sentence's length is modelled as normally distributed around
`c` times its source's, with a variance in proportion to it; the best path over the beads one-to-one, omission,
insertion, merge and split is found exactly, by rows, for many pairs at once.  As in the two-pass variant of the method,
a first pass on lengths and shared numbers over all pairs yields one-to-one sentences, from which the length model and a
word table are estimated; the bead costs of the second pass add how much of both sides' words translate each other.  The
path is monotone, so two things follow it:

* a check drops beads whose words are known and do not translate each other (a remark beside a left-out sentence),
* what is left over goes through the same cost once more, without order: bead by bead, cheapest first, each of which must
  explain a new part of both sentences.  This recovers sentences that were moved, or joined with a distant one.

`via` of a rendering says which of the two found it: `path` or `moved`.

Sentences of the target that are in the source's language are no renderings and take no part.

Word table: co-occurrence in one-to-one sentences, counted over all pairs in Spark, a row a word pair and task; words
translate each other if their association (phi squared) is at least 0.4 of the best one of either and significant.
The table sent to the workers has at most `TABLE_ROWS` rows, those with most evidence.

Memory: a path keeps two rows and a byte for each cell; beyond `KEPT` cells only the rows that open a strip are kept and
the strips are run again from the last one back, with the same result.

Defined results: null, empty and blank texts give no rows; ties go to the earlier sentence; sentences without known
words are paired by length and place alone; repeated rows are aligned alike; pairs of unknown type or source language
are aligned like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.langid import LANGUAGES, LanguageModel, canonical, scorer_of
from quirelake.llm.segments import Segments, lower_table, segment, unwrapped
from quirelake.llm.textkernel import BLOCK_CHARS, LETTER, NUMBER, Block, _mixed, class_table, hash_of
from quirelake.runtime import durable

TABLE_ROWS = 1 << 18
#: beads (source sentences, target sentences) and their prior probabilities (fixed values of the published method)
BEADS = (((1, 1), 0.89), ((1, 0), 0.0099), ((0, 1), 0.0099), ((2, 1), 0.0445), ((1, 2), 0.0445), ((2, 2), 0.011))
PRIOR = {bead: -math.log(p) for bead, p in BEADS}
_CODES = list(PRIOR)
#: how much full mutual translation is worth against none
LEXICAL = 24.0
NUMBER_WEIGHT = 3.0
#: share of the lighter sentence that a link outside the path must newly explain
NEW_PART = 0.3
#: a target sentence is in the source's language if its log odds against every other one reach this
SAME_LANGUAGE = 2.0
#: cells that are held at once, and cells of a path whose beads are kept; these change memory and speed only
CELLS, KEPT, LINKS = 1 << 20, 1 << 26, 1 << 21
#: pairs of more source sentences are searched by themselves, those with few target sentences by target
TALL, THIN = 1024, 256
#: least number of sentences, and least log likelihood ratio, for two words to be taken for translations
LEAST_SEEN, LEAST_EVIDENCE = 3, 15.0
#: a word that ends a sentence in less than this share of its places hardly ever does
RARELY_LAST = 0.005


_LANGUAGE_KEYS = np.array([hash_of(f"from {code}") for code in (*LANGUAGES, "?")], np.uint64)
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pair_blocks(*columns: list[str | None], chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about so many characters together; a row is never divided."""
    begin = size = 0
    n = len(columns[0])
    for i in range(n):
        more = sum(len(c[i]) for c in columns if c[i])
        if size and size + more > chars:
            yield begin, i
            begin, size = i, 0
        size += more
    if begin < n:
        yield begin, n


def source_codes(labels: list[str | None]) -> list[int]:
    """Numbers of the languages that labels name, -1 for none."""
    known = {label: LANGUAGES.index(code) if (code := canonical(label)) else -1 for label in set(labels)}
    return [known[label] for label in labels]


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and hashes of the words and numbers of a block, in lower case, and whether each is a number."""
    kinds = class_table()[block.cps]
    kinds = np.where((kinds == LETTER) | (kinds == NUMBER), kinds, 0).astype(np.int8)
    opens = np.zeros(block.n + 1, bool)
    opens[block.bounds] = True
    edge = np.ones(block.n + 1, bool)
    edge[1:-1] = kinds[1:] != kinds[:-1]
    edge |= opens
    at = np.flatnonzero(edge)
    begins, ends = at[:-1], at[1:]
    real = kinds[begins] > 0
    begins, ends = begins[real], ends[real]
    return begins, block.hashes(begins, ends, lower_table()[block.cps]), kinds[begins] == NUMBER


class Side:
    """Sentences of one side of a block of pairs, with their tokens."""

    def __init__(self, texts: list[str | None], with_plain: bool = False, codes: list[int] | None = None, blanked: list[str | None] | None = None):
        """blanked: the texts with what does not count, such as tags, blanked out at equal length."""
        self.block = Block(texts)
        self.seg = segment(self.block) if with_plain else Segments(self.block)
        self.inked = Block(blanked) if blanked is not None else self.block
        begins, self.hashes, self.is_number = tokens(self.inked)
        sentence = np.searchsorted(self.seg.begins, begins, side="right") - 1
        self.sentence = sentence
        self.text = self.seg.text[sentence] if len(sentence) else np.zeros(0, np.int64)
        self.codes = codes
        #: words as renderings of a source language, which `codes` gives for each text
        self.keys = self.hashes if codes is None else self.hashes ^ _LANGUAGE_KEYS[np.array(codes, np.int64)[self.text]]
        self.lengths = self._lengths()

    def _lengths(self) -> np.ndarray:
        """Characters of each sentence without the white space around it, near enough."""
        ink = np.concatenate([[0], np.cumsum(self.inked.cps > 32)])
        return (ink[self.seg.ends] - ink[self.seg.begins]).astype(float)


@dataclass
class Lexicon:
    """Which words translate which, hash to hash, and the words' weights."""

    #: target word (with the source's language), source word: sorted by the target word
    target: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    source: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ratio: float = 1.1
    variance: float = 6.8

    def weight(self, hashes: np.ndarray, is_number: np.ndarray) -> np.ndarray:
        """Weight of each token; 0 for words that the table does not know."""
        out = np.where(is_number, NUMBER_WEIGHT, 0.0)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            out = np.where((self.words[at] == hashes) & ~is_number, self.weights[at], out)
        return out


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and positions of ranges first..last."""
    n = np.maximum(last - first, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)



def _once_each(codes: np.ndarray) -> np.ndarray:
    """The distinct ones, in order."""
    codes = np.sort(codes)
    return codes[np.append(True, codes[1:] != codes[:-1])] if len(codes) else codes


class _Runs:
    """Where the runs of equal keys of a sorted array are."""

    def __init__(self, keys: np.ndarray):
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.starts, self.ends = keys[starts], starts, np.append(starts[1:], len(keys)) if len(keys) else starts

    def of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and place after the last of each wanted key."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        begin = self.starts[at]
        return begin, np.where(self.keys[at] == wanted, self.ends[at], begin)


class Entries:
    """Words of the sentences of a block of pairs, once a sentence, and which of them translate each other."""

    def __init__(self, src: Side, tgt: Side, lexicon: Lexicon, use: np.ndarray | None = None):
        #: source words: sentence, key (word and pair), weight; in the order of sentences
        self.sw, self.tw = lexicon.weight(src.hashes, src.is_number), lexicon.weight(tgt.hashes, tgt.is_number)
        key = src.hashes ^ (src.text.astype(np.uint64) * _MIX)
        self.s_key = key
        self.a_key, self.a_at, self.a_w, _, _ = self._once(key, src.sentence, np.where(self.sw > 0, self.sw, 1.0))
        first = np.arange(len(src.seg.begins) + 1)
        self.a_first = np.searchsorted(self.a_at, first)
        _, self.e_at, self.e_w, token, self.e_of = self._once(tgt.hashes, tgt.sentence, np.where(self.tw > 0, self.tw, 1.0))
        self.e_first = np.searchsorted(self.e_at, np.arange(len(tgt.seg.begins) + 1))
        # candidates: the source words that each target word may stand for; itself where it is unknown
        keys = tgt.keys[token]
        if len(lexicon.target):
            row, at = _expand(*_Runs(lexicon.target).of(keys))
            known = lexicon.source[at]
        else:
            row, known = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        same = np.flatnonzero(tgt.is_number[token] | (self.tw[token] == 0))
        e, wanted = np.concatenate([row, same]), np.concatenate([known, tgt.hashes[token][same]])
        if use is not None:
            kept = use[self.e_at[e]]
            e, wanted = e[kept], wanted[kept]
        wanted = wanted ^ (tgt.text[token][e].astype(np.uint64) * _MIX)
        order = np.argsort(wanted)
        self.wanted, self.wanted_e = wanted[order], e[order]
        self.runs = _Runs(self.wanted)
        self._exact: tuple[_Runs, np.ndarray] | None = None
        self.known_s = np.bincount(src.sentence, self.sw, len(src.seg.begins))
        self.known_t = np.bincount(tgt.sentence, self.tw, len(tgt.seg.begins))
        self.n_tgt = max(1, len(tgt.seg.begins))

    @staticmethod
    def _once(key: np.ndarray, sentence: np.ndarray, weight: np.ndarray):
        """Keys, sentences and summed weights of the words of each sentence, a token of each, and each token's place."""
        # by sentence, and by key within it: the first bits hold the number of the sentence
        bits = max(1, int(sentence[-1]).bit_length()) if len(sentence) else 1
        order = np.argsort(sentence.astype(np.uint64) << np.uint64(64 - bits) | key >> np.uint64(bits))
        k, at = key[order], sentence[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (at[1:] != at[:-1])
        starts = np.flatnonzero(new)
        total = np.add.reduceat(weight[order], starts) if len(starts) else np.zeros(0)
        place = np.zeros(len(k), np.int64)
        place[order] = np.cumsum(new) - 1
        return k[new], at[new], total, order[new], place

    def met(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether each source and each target token has a counterpart somewhere in its pair."""
        if not len(self.wanted) or not len(self.s_key):
            return np.zeros(len(self.s_key), bool), np.zeros(len(self.e_of), bool)
        known = np.sort(self.s_key)
        hit = known[np.minimum(np.searchsorted(known, self.wanted), len(known) - 1)] == self.wanted
        entry = np.zeros(len(self.e_at), bool)
        entry[self.wanted_e[hit]] = True
        at = np.minimum(np.searchsorted(self.wanted, self.s_key), len(self.wanted) - 1)
        return self.wanted[at] == self.s_key, entry[self.e_of]

    def cells(self, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(source sentence, target sentence, weight of the source's words that the target translates, and of the
        target's that translate a word of the source) for the source sentences first..last, in order, in parts."""
        a0, a1 = int(self.a_first[first]), int(self.a_first[last])
        lo, hi = self.runs.of(self.a_key[a0:a1])
        total = np.concatenate([[0], np.cumsum(hi - lo)])
        begin = first
        while begin < last:
            x = int(self.a_first[begin]) - a0
            # as many sentences as have LINKS links, at least one
            stop = int(np.searchsorted(total, total[x] + LINKS, side="right")) - 1
            end = max(begin + 1, int(np.searchsorted(self.a_first[: last + 1], stop + a0, side="right")) - 1)
            end = min(end, last)
            y = int(self.a_first[end]) - a0
            a, at = _expand(lo[x:y], hi[x:y])
            a, e = a + a0 + x, self.wanted_e[at]
            cell = self.a_at[a].astype(np.int64) * self.n_tgt + self.e_at[e]
            n_a, n_e = max(1, len(self.a_key)), max(1, len(self.e_at))
            (local, of_s), (_, of_t) = self._summed(cell, a, self.a_w, n_a), self._summed(cell, e, self.e_w, n_e)
            yield local // self.n_tgt, local % self.n_tgt, of_s, of_t
            begin = end

    @staticmethod
    def _summed(cell: np.ndarray, word: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The cells in order, and the weights of the distinct words of each."""
        codes = _once_each(cell * n + word)
        cells = codes // n
        starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
        return cells[starts], np.add.reduceat(weight[codes - cells * n], starts) if len(starts) else np.zeros(0)

    def words_of(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words that translate each other in the cells (i, j): (number of the cell, source word), (number of the
        cell, target word), sorted by cell."""
        cell, a = _expand(self.a_first[i], self.a_first[np.asarray(i, np.int64) + 1])
        if self._exact is None:
            exact = _mixed(self.wanted ^ ((self.e_at[self.wanted_e].astype(np.uint64) + np.uint64(1)) * _MIX2))
            order = np.argsort(exact)
            self._exact = _Runs(exact[order]), self.wanted_e[order]
        want = _mixed(self.a_key[a] ^ ((np.asarray(j)[cell].astype(np.uint64) + np.uint64(1)) * _MIX2))
        hit, at = _expand(*self._exact[0].of(want))
        cell, a, e = cell[hit], a[hit], self._exact[1][at]
        n_a, n_e = max(1, len(self.a_key)), max(1, len(self.e_at))
        u, v = _once_each(cell * n_a + a), _once_each(cell * n_e + e)
        return u // n_a, u % n_a, v // n_e, v % n_e

    def sums_of(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, a, d, e = self.words_of(i, j)
        return np.bincount(c, self.a_w[a], len(i)), np.bincount(d, self.e_w[e], len(i))


# -- paths ------------------------------------------------------------------------------------------------------------

#: coefficients of the rational Chebyshev form of erfc (fixed values, relative error below 1.2e-7)
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def length_cost(a, b, lexicon: Lexicon):
    """-log of the probability of a length at least as far from what the source's length makes likely, 20 at most."""
    mean = (a + b / lexicon.ratio) * (0.5 * lexicon.variance)
    z = np.abs(b - a * lexicon.ratio) / np.sqrt(2.0 * np.maximum(mean, 1e-9))
    t = 1.0 / (1.0 + 0.5 * z)
    poly = _ERFC[-1]
    for c in _ERFC[-2::-1]:
        poly = poly * t + c
    return np.where(mean > 0, np.clip(z * z - poly - np.log(t), 0.0, 20.0), 0.0)


class Paths:
    """The paths of several pairs of as many source sentences, row by row; targets are padded at the end."""

    def __init__(self, la: np.ndarray, lb: np.ndarray, ka: np.ndarray, kb: np.ndarray, lexicon: Lexicon, lexical: float, swapped: bool = False):
        self.la, self.ka, self.lexicon, self.lexical = la, ka, lexicon, lexical
        #: lengths and known weights of one and of two target sentences
        self.lb = (lb, lb[:, :-1] + lb[:, 1:])
        self.kb = (kb, kb[:, :-1] + kb[:, 1:])
        self.swapped = swapped
        self.steps = np.arange(lb.shape[1] + 1) * PRIOR[0, 1]
        self.before: list[np.ndarray] = [np.tile(self.steps, (len(la), 1))]
        #: matches of the row before
        self.last: tuple[np.ndarray, np.ndarray] | None = None

    def opening(self) -> np.ndarray:
        return np.full(self.before[0].shape, _CODES.index((0, 1)), np.uint8)

    def _bead(self, i: int, a: int, b: int, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Cost of the beads of source sentences i - a..i and each b target sentences with these matches."""
        la, ka = self.la[:, i - a : i].sum(1)[:, None], self.ka[:, i - a : i].sum(1)[:, None]
        lb, kb = self.lb[b - 1], self.kb[b - 1]
        cost = (length_cost(lb, la, self.lexicon) if self.swapped else length_cost(la, lb, self.lexicon)) + PRIOR[(b, a) if self.swapped else (a, b)]
        known = ka + kb
        shared = np.minimum(s, np.where(ka > 0, ka, np.inf)) + np.minimum(t, np.where(kb > 0, kb, np.inf))
        value = self.lexical * (0.5 - np.minimum(1.0, shared / np.maximum(known, 1e-9))) * np.minimum(1.0, known / 8)
        return cost + np.where(known > 0, value, 0.0)

    def row(self, i: int, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Goes on to row i, of the matches s and t of source sentence i - 1; the bead that ends in each cell."""
        one = self.before[-1]
        n = one.shape[1] - 1
        cost = one + PRIOR[1, 0]
        how = np.full(one.shape, _CODES.index((1, 0)), np.uint8)

        def offer(a: int, b: int, from_row: np.ndarray, s: np.ndarray, t: np.ndarray) -> None:
            made = from_row[:, : n + 1 - b] + self._bead(i, a, b, s, t)
            here = cost[:, b:]
            better = made < here
            here[better] = made[better]
            how[:, b:][better] = _CODES.index((a, b))

        offer(1, 1, one, s, t)
        if n > 1:
            offer(1, 2, one, s[:, :-1] + s[:, 1:], t[:, :-1] + t[:, 1:])
        if i > 1 and self.last is not None:
            s2, t2 = s + self.last[0], t + self.last[1]
            offer(2, 1, self.before[-2], s2, t2)
            if n > 1:
                offer(2, 2, self.before[-2], s2[:, :-1] + s2[:, 1:], t2[:, :-1] + t2[:, 1:])
        # insertions: the best cell before in the row
        level = cost - self.steps
        least = np.minimum.accumulate(level, 1)
        inserted = np.zeros(level.shape, bool)
        inserted[:, 1:] = least[:, :-1] <= level[:, 1:] - 1e-12
        cost = np.where(inserted, least + self.steps, cost)
        how[inserted] = _CODES.index((0, 1))
        self.before, self.last = [one, cost], (s, t)
        return how


def _traced(how: bytes, width: int, m: int, n: int, down_to: int = 0, shift: int = 0) -> tuple[list[tuple[int, int, int, int]], int, int]:
    """Beads (first source, number, first target, number) from the end of a path back to a row; how: rows from `shift`."""
    out, i, j = [], m, n
    while i > down_to or (down_to == 0 and j):
        a, b = _CODES[how[(i - shift) * width + j]]
        out.append((i - a, a, j - b, b))
        i, j = i - a, j - b
    return out, i, j


def best_path(la, lb, ka, kb, rows, lexicon: Lexicon, lexical: float = LEXICAL, swapped: bool = False) -> list[tuple[int, int, int, int]]:
    """Beads of the cheapest path of one pair, of any size. rows(first, last) gives (source sentence, s, t) of the
    sentences first..last in turn. swapped: what is called source here is the target."""
    la, lb, ka, kb = (np.asarray(x, float)[None, :] for x in (la, lb, ka, kb))
    m, n = la.shape[1], lb.shape[1]
    height = m if m * n <= KEPT else max(2, KEPT // max(1, n))
    paths, saved = Paths(la, lb, ka, kb, lexicon, lexical, swapped), {}
    kept: list[np.ndarray] = []
    for i, s, t in rows(0, m):
        if i % height == 0:
            saved[i], kept = (list(paths.before), paths.last), []
        kept.append(paths.row(i + 1, s[None, :], t[None, :])[0])
    out: list[tuple[int, int, int, int]] = []
    at, j = m, n
    opening = paths.opening()[0]
    for begin in range((m - 1) // height * height, -1, -height):
        if begin + height < m:  # a strip that is run again
            paths.before, paths.last = saved[begin]
            kept = [paths.row(i + 1, s[None, :], t[None, :])[0] for i, s, t in rows(begin, begin + height)]
        # a bead may reach over the strip's first row
        how = np.stack([opening if begin == 0 else np.zeros_like(opening), *kept]).tobytes()
        beads, at, j = _traced(how, n + 1, at, j, begin, begin)
        out += beads
    return out[::-1]


def _dense_rows(i: np.ndarray, j: np.ndarray, s: np.ndarray, t: np.ndarray, n: int):
    """Rows of `best_path` from cells in order of i."""

    def rows(first: int, last: int):
        at = np.searchsorted(i, np.arange(first, last + 1))
        for k in range(first, last):
            x, y = at[k - first], at[k - first + 1]
            of_s, of_t = np.zeros(n), np.zeros(n)
            of_s[j[x:y]], of_t[j[x:y]] = s[x:y], t[x:y]
            yield k, of_s, of_t

    return rows


class Aligner:
    """The pairs of a block: their sentences, words and paths."""

    def __init__(self, src: Side, tgt: Side, lexicon: Lexicon, use: np.ndarray | None = None):
        self.src, self.tgt, self.lexicon = src, tgt, lexicon
        use = np.ones(len(tgt.seg.begins), bool) if use is None else use
        self.entries = Entries(src, tgt, lexicon, use)
        #: used target sentences, and the place of each among those of its pair
        self.used = np.flatnonzero(use)
        n_texts = len(src.block.texts)
        self.t_first = np.searchsorted(tgt.seg.text[self.used], np.arange(n_texts + 1))
        self.place = np.cumsum(use) - 1
        self.s_first = src.seg.first
        self.m, self.n = np.diff(self.s_first), np.diff(self.t_first)
        has = (self.m > 0) & (self.n > 0)
        large = (self.m * self.n > CELLS) | (self.m > TALL)
        self.small, self.large = np.flatnonzero(has & ~large), np.flatnonzero(has & large)
        self.cells = self._small_cells()

    def _small_cells(self):
        parts = [part for x, y in self._runs() for part in self.entries.cells(int(self.s_first[x]), int(self.s_first[y]))]
        if not parts:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, float))
        return tuple(np.concatenate(column) for column in zip(*parts))

    def _runs(self) -> list[tuple[int, int]]:
        """Ranges of neighbouring pairs without the large ones."""
        edges = [-1, *self.large.tolist(), len(self.m)]
        return [(a + 1, b) for a, b in zip(edges, edges[1:]) if b > a + 1]

    def beads(self, lexical: float = LEXICAL) -> np.ndarray:
        """(pair, first source, number, first target, number) of the beads of all paths, places within the pair."""
        out: list[tuple[int, int, int, int, int]] = []
        ci, cj, cs, ct = self.cells
        first = np.searchsorted(ci, self.s_first)
        lengths, kb = self.tgt.lengths[self.used], self.entries.known_t[self.used]
        order = self.small[np.lexsort((self.n[self.small], self.m[self.small]))]
        begin = 0
        m, n = self.m[order].tolist(), self.n[order].tolist()
        while begin < len(order):
            end = begin + 1
            while end < len(order) and m[end] == m[begin] and n[end] <= 2 * n[begin] + 4 and (end - begin + 1) * m[end] * n[end] <= CELLS:
                end += 1
            ks = order[begin:end]
            p, rows, cols = len(ks), m[begin], n[end - 1]
            x = self.s_first[ks][:, None] + np.arange(rows)
            y = np.minimum(self.t_first[ks][:, None] + np.arange(cols), len(self.used) - 1)
            real = np.arange(cols) < self.n[ks][:, None]
            s, t = np.zeros((p, rows, cols)), np.zeros((p, rows, cols))
            row, at = _expand(first[ks], first[ks + 1])
            local = (row, ci[at] - self.s_first[ks][row], self.place[cj[at]] - self.t_first[ks][row])
            s[local], t[local] = cs[at], ct[at]
            paths = Paths(self.src.lengths[x], lengths[y] * real, self.entries.known_s[x], kb[y] * real, self.lexicon, lexical)
            how = np.stack([paths.opening(), *(paths.row(i + 1, s[:, i], t[:, i]) for i in range(rows))], 1)
            for k, own, width in zip(ks.tolist(), how, n[begin:end]):
                out += [(k, *bead) for bead in _traced(own.tobytes(), cols + 1, rows, width)[0]]
            begin = end
        for k in self.large.tolist():
            out += [(k, *bead) for bead in self._large(k, lexical)]
        return np.array(out, np.int64).reshape(-1, 5)

    def _large(self, k: int, lexical: float) -> list[tuple[int, int, int, int]]:
        """The path of one large pair; its matches are made anew strip by strip and never held at once."""
        a, b = int(self.s_first[k]), int(self.s_first[k + 1])
        own = self.used[self.t_first[k] : self.t_first[k + 1]]

        def rows(first: int, last: int):
            done = first
            for i, j, s, t in self.entries.cells(a + first, a + last):
                end = int(i[-1]) - a + 1 if len(i) else done
                yield from _dense_rows(i - a, self.place[j] - self.t_first[k], s, t, len(own))(done, end)
                done = end
            yield from _dense_rows(*(np.zeros(0, np.int64),) * 2, *(np.zeros(0),) * 2, len(own))(done, last)

        sides = (self.src.lengths[a:b], self.tgt.lengths[own], self.entries.known_s[a:b], self.entries.known_t[own])
        if len(own) > THIN or len(own) >= b - a:
            return best_path(*sides, rows, self.lexicon, lexical)
        # few target sentences: they are the rows
        i, j, s, t = (np.concatenate(column) for column in zip(*self.entries.cells(a, b)))
        i, j = i - a, self.place[j] - self.t_first[k]
        order = np.lexsort((i, j))
        turned = _dense_rows(j[order], i[order], t[order], s[order], b - a)
        beads = best_path(sides[1], sides[0], sides[3], sides[2], turned, self.lexicon, lexical, True)
        return [(i, a, j, b) for j, b, i, a in beads]

    def candidates(self, taken) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Cells of which both sides explain enough of the lighter sentence, as `taken` lets them through."""
        for part in (self.cells, *(c for k in self.large.tolist() for c in self.entries.cells(int(self.s_first[k]), int(self.s_first[k + 1])))):
            i, j, s, t = part
            least = NEW_PART * np.minimum(self.entries.known_s[i], self.entries.known_t[j])
            keep = np.flatnonzero((least > 0) & (s >= least) & (t >= least))
            keep = keep[taken(i[keep], j[keep], least[keep])]
            yield i[keep], j[keep], s[keep], t[keep]

    def renderings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Source sentence, target sentence (numbers in the block) and whether it is outside the path."""
        beads = self.beads()
        real = beads[(beads[:, 2] > 0) & (beads[:, 4] > 0)]
        k = np.repeat(real[:, 0], real[:, 2] * real[:, 4])
        row, at = _expand(np.zeros(len(real), np.int64), real[:, 2] * real[:, 4])
        i = self.s_first[k] + real[row, 1] + at // real[row, 4]
        j = self.used[self.t_first[k] + real[row, 3] + at % real[row, 4]] if len(k) else k
        s, t = self._matches(i, j, np.isin(k, self.large))
        ka, kb = self.entries.known_s[i], self.entries.known_t[j]
        # nothing known: length and place decide
        unknown = (real[row, 2] * real[row, 4] == 1) & (np.minimum(ka, kb) < 2.0)
        meant = (s + t >= 0.5 * (ka + kb)) | ((s >= 0.7 * ka) & (ka > 0)) | ((t >= 0.7 * kb) & (kb > 0))
        keep = unknown | meant
        i, j, s, t = i[keep], j[keep], s[keep], t[keep]
        more_i, more_j = self._moved(i, j, s, t)
        return np.concatenate([i, more_i]), np.concatenate([j, more_j]), np.arange(len(i) + len(more_i)) >= len(i)

    def _matches(self, i: np.ndarray, j: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What both sides of the cells (i, j) explain: read from the cells at hand, made anew for large pairs."""
        s, t = np.zeros(len(i)), np.zeros(len(i))
        ci, cj, cs, ct = self.cells
        if len(ci):
            code, wanted = ci * self.entries.n_tgt + cj, i * self.entries.n_tgt + j
            at = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
            there = code[at] == wanted
            s[there], t[there] = cs[at[there]], ct[at[there]]
        if large.any():
            s[large], t[large] = self.entries.sums_of(i[large], j[large])
        return s, t

    def _moved(self, i: np.ndarray, j: np.ndarray, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Renderings outside the paths, given those on them with their matches."""
        e = self.entries
        n_s, n_t = len(e.known_s), len(e.known_t)
        seen_i, seen_j = np.bincount(i, minlength=n_s) > 0, np.bincount(j, minlength=n_t) > 0
        rest_i, rest_j = e.known_s - np.bincount(i, s, n_s), e.known_t - np.bincount(j, t, n_t)
        there = np.sort(i * e.n_tgt + j)

        def taken(x, y, least):
            code = x * e.n_tgt + y
            known = there[np.minimum(np.searchsorted(there, code), len(there) - 1)] == code if len(there) else np.zeros(len(code), bool)
            return ~known & (~seen_i[x] | ~seen_j[y] | ((rest_i[x] >= least) & (rest_j[y] >= least)))

        parts = [part for part in self.candidates(taken) if len(part[0])]
        nothing = np.zeros(0, np.int64)
        if not parts:
            return nothing, nothing
        x, y, of_s, of_t = (np.concatenate(column) for column in zip(*parts))
        # the cost of each as a bead of its own: length, and how much of both sides' words it explains
        ka, kb = e.known_s[x], e.known_t[y]
        shared = (np.minimum(of_s, ka) + np.minimum(of_t, kb)) / np.maximum(ka + kb, 1e-9)
        cost = length_cost(self.src.lengths[x], self.tgt.lengths[y], self.lexicon) - LEXICAL * shared * np.minimum(1.0, (ka + kb) / 8)
        order = np.lexsort((y, x, cost))
        x, y = x[order], y[order]
        # what the renderings of the same sentences explain already
        near = np.flatnonzero(np.isin(i, x) | np.isin(j, y))
        all_i, all_j = np.concatenate([i[near], x]), np.concatenate([j[near], y])
        c, a, d, b = e.words_of(all_i, all_j)
        cuts_a, cuts_b = np.searchsorted(c, np.arange(len(all_i) + 1)).tolist(), np.searchsorted(d, np.arange(len(all_i) + 1)).tolist()
        words_a, words_b, weight_a, weight_b = a.tolist(), b.tolist(), e.a_w[a].tolist(), e.e_w[b].tolist()
        done_a: set[int] = set()
        done_b: set[int] = set()
        made: list[int] = []
        least = np.maximum(4.0, NEW_PART * np.minimum(e.known_s[all_i], e.known_t[all_j])).tolist()
        for k in range(len(all_i)):
            pa_, pb_ = range(cuts_a[k], cuts_a[k + 1]), range(cuts_b[k], cuts_b[k + 1])
            if k >= len(near):
                new_a = sum(weight_a[q] for q in pa_ if words_a[q] not in done_a)
                new_b = sum(weight_b[q] for q in pb_ if words_b[q] not in done_b)
                if min(new_a, new_b) < least[k]:
                    continue
                made.append(k - len(near))
            done_a.update(words_a[q] for q in pa_)
            done_b.update(words_b[q] for q in pb_)
        return x[made] if made else nothing, y[made] if made else nothing


# -- fitting ----------------------------------------------------------------------------------------------------------

COUNTS = "kind string, code int, t bigint, s bigint, n bigint, x double, y double, z double"


class _Tally:
    """Counts of keyed rows (columns of 64 bits), kept once a key."""

    def __init__(self, columns: int):
        self.columns = [np.zeros(0, np.uint64) for _ in range(columns)]
        self.n = np.zeros(0, np.int64)
        self.fresh: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.waiting = 0

    def add(self, columns: list[np.ndarray], n: np.ndarray) -> None:
        self.fresh.append((columns, n))
        self.waiting += len(n)
        if self.waiting > 1 << 21 and self.waiting > len(self.n):
            self.settle()

    def settle(self) -> None:
        columns = [np.concatenate([own, *(c[k] for c, _ in self.fresh)]) for k, own in enumerate(self.columns)]
        n = np.concatenate([self.n, *(m for _, m in self.fresh)])
        key = np.zeros(len(n), np.uint64)
        for column in columns:
            key = _mixed(key ^ column)
        _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        self.columns, self.n = [c[at] for c in columns], np.bincount(inverse, n, len(at)).astype(np.int64)
        self.fresh, self.waiting = [], 0


def _distinct(sentence: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word (by number) once a sentence."""
    codes = _once_each(sentence * max(1, n_words) + word)
    return codes // max(1, n_words), codes % max(1, n_words)


class Statistics:
    """Counts of the first pass, added up over blocks."""

    def __init__(self) -> None:
        self.pairs, self.sources, self.targets = _Tally(3), _Tally(2), _Tally(2)
        #: sentences that hold a word, of either side; places of target words but the last of each text; target
        #: sentences with a full stop that a word ends
        self.holding, self.inside, self.closing = _Tally(1), _Tally(1), _Tally(1)
        self.sentences = 0
        self.per_code = np.zeros(len(LANGUAGES) + 1, np.int64)
        self.moments = np.zeros((4,))

    def add(self, src_texts: list[str | None], tgt_texts: list[str | None], src_langs: list[str | None]) -> None:
        codes = np.array(source_codes(src_langs), np.int64)
        src = Side(src_texts, blanked=[unwrapped(t) for t in src_texts])
        tgt = Side(tgt_texts, codes=codes.tolist(), blanked=[unwrapped(t) for t in tgt_texts])
        aligner = Aligner(src, tgt, Lexicon())
        beads = aligner.beads(6.0)
        beads = beads[(beads[:, 2] == 1) & (beads[:, 4] == 1)]
        i, j = aligner.s_first[beads[:, 0]] + beads[:, 1], aligner.t_first[beads[:, 0]] + beads[:, 3]
        code = codes[beads[:, 0]] % (len(LANGUAGES) + 1)
        self.per_code += np.bincount(code, minlength=len(self.per_code))
        a, b = src.lengths[i], tgt.lengths[j]
        close = (b > 0.5 * a) & (b < 2 * a)
        a, b = a[close], b[close]
        self.moments += (a.sum(), b.sum(), (b * b / np.maximum(a, 1)).sum(), len(a))
        letters = ~tgt.is_number
        # the block's words by number, so that its counts are made on small numbers first
        s_words, s_id = np.unique(src.hashes, return_inverse=True)
        t_words, t_id = np.unique(tgt.hashes[letters], return_inverse=True)
        s_at, s_word = _distinct(src.sentence, s_id, len(s_words))
        t_at, t_word = _distinct(tgt.sentence[letters], t_id, len(t_words))
        self.sentences += len(src.seg.begins) + len(tgt.seg.begins)
        for words, word in ((s_words, s_word), (t_words, t_word)):
            self.holding.add([words], np.bincount(word, minlength=len(words)))
        last = np.searchsorted(tgt.text, np.arange(len(tgt_texts)), side="right") - 1
        inner = letters.copy()
        inner[last[last >= 0]] = False
        self.inside.add([t_words], np.bincount(t_id[inner[letters]], minlength=len(t_words)))
        closed = np.flatnonzero(np.isin(_last_ink(tgt), (33, 46, 63)))
        at = np.searchsorted(tgt.sentence, closed, side="right") - 1
        at = at[(at >= 0) & (tgt.sentence[np.maximum(at, 0)] == closed)]
        self.closing.add([tgt.hashes[at]], np.ones(len(at), np.int64))
        s_first, t_first = np.searchsorted(s_at, np.arange(len(src.seg.begins) + 1)), np.searchsorted(t_at, np.arange(len(tgt.seg.begins) + 1))
        for begin, end in _portions((s_first[i + 1] - s_first[i]) * (t_first[j + 1] - t_first[j]), LINKS):
            x, y, c = i[begin:end], j[begin:end], code[begin:end]
            row, s = _expand(s_first[x], s_first[x + 1])
            n_s, n_t = max(1, len(s_words)), max(1, len(t_words))
            code_s, times = np.unique(c[row] * n_s + s_word[s], return_counts=True)
            self.sources.add([(code_s // n_s).astype(np.uint64), s_words[code_s % n_s]], times)
            again, t = _expand(t_first[y], t_first[y + 1])
            code_t, times = np.unique(c[again] * n_t + t_word[t], return_counts=True)
            self.targets.add([(code_t // n_t).astype(np.uint64), t_words[code_t % n_t]], times)
            which, t = _expand(t_first[y][row], t_first[y + 1][row])
            both, times = np.unique((c[row] * n_s + s_word[s])[which] * n_t + t_word[t], return_counts=True)
            code_s = both // n_t
            self.pairs.add([(code_s // n_s).astype(np.uint64), t_words[both % n_t], s_words[code_s % n_s]], times)

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in COUNTS.split(", ")]

        def made(kind: str, code, t, s, n, x=0.0, y=0.0, z=0.0) -> pa.RecordBatch:
            size = len(n)
            whole = lambda v: v.view(np.int64) if isinstance(v, np.ndarray) and v.dtype == np.uint64 else np.broadcast_to(np.asarray(v, np.int64), size)
            real = [pa.array(np.broadcast_to(np.asarray(v, float), size)) for v in (x, y, z)]
            return pa.RecordBatch.from_arrays([pa.array([kind] * size), pa.array(whole(code).astype(np.int32)), pa.array(whole(t)), pa.array(whole(s)), pa.array(np.asarray(n, np.int64)), *real], names)

        for tally in (self.pairs, self.sources, self.targets, self.holding, self.inside, self.closing):
            tally.settle()
        step = 1 << 16
        for kind, tally, order in (("pair", self.pairs, (0, 1, 2)), ("source", self.sources, (0, None, 1)), ("target", self.targets, (0, 1, None)), ("holding", self.holding, (None, 0, None)), ("inside", self.inside, (None, 0, None)), ("closing", self.closing, (None, 0, None))):
            for at in range(0, len(tally.n), step):
                yield made(kind, *(0 if k is None else tally.columns[k][at : at + step] for k in order), tally.n[at : at + step])
        yield made("code", np.arange(len(self.per_code)), 0, 0, self.per_code)
        yield made("total", 0, 0, 0, np.array([self.sentences]), *(np.array([v]) for v in self.moments[:3]))


def _last_ink(side: Side) -> np.ndarray:
    """The last code point of each sentence that is no white space."""
    inked = np.flatnonzero(side.inked.cps > 32)
    at = np.searchsorted(inked, side.seg.ends) - 1
    return side.inked.cps[inked[np.maximum(at, 0)]] if len(inked) else np.zeros(len(at), np.uint32)


def _portions(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of about so much size together."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + limit, side="right")) - 1)
        yield begin, end
        begin = end


@dataclass
class Fit:
    """What the pairs of a table say about lengths and words."""

    lexicon: Lexicon
    #: hashes of the words that stand inside target texts, and of those among them that hardly ever end a sentence, sorted
    vocabulary: np.ndarray
    never_last: np.ndarray


def count_words(pairs: DataFrame) -> DataFrame:
    """The first pass over all pairs: counts added up per word pair, word and language (see COUNTS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        statistics = Statistics()
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(3)]
            for begin, end in pair_blocks(columns[0], columns[1]):
                statistics.add(*(c[begin:end] for c in columns))
        yield from statistics.rows()

    source = pairs.where("src_text is not null and tgt_text is not null").select("src_text", "tgt_text", "src_lang")
    total = lambda c: F.sum(c).alias(c)
    return source.mapInArrow(run, COUNTS).groupBy("kind", "code", "t", "s").agg(*map(total, ("n", "x", "y", "z")))


def fit_tables(pairs: DataFrame, table_rows: int = TABLE_ROWS) -> Fit:
    """The length model, word table and vocabulary of all pairs (src_text, tgt_text, src_lang).

    What comes to the driver: at most `table_rows` word pairs and as many words, and a row a language."""
    counts = durable(count_words(pairs).where(f"kind <> 'pair' or n >= {LEAST_SEEN}"))
    of = lambda kind: counts.where(F.col("kind") == kind)
    total = of("total").first()
    if total is None or not total["n"]:
        return Fit(Lexicon(), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    a, b, bb = max(total["x"], 1.0), total["y"], total["z"]
    per_code = {r["code"]: r["n"] for r in of("code").collect()}
    close = max(1, sum(per_code.values()))
    ratio = b / a if b > 0 else 1.1
    variance = max(1.0, (bb - 2 * ratio * b + ratio * ratio * a) / close) if b > 0 else 6.8
    # association of two words: phi squared, and the log likelihood ratio as evidence
    joined = (
        of("pair").select("code", "t", "s", F.col("n").cast("double").alias("k"))
        .join(of("target").select("code", "t", F.col("n").cast("double").alias("c_t")), ["code", "t"])
        .join(of("source").select("code", "s", F.col("n").cast("double").alias("c_s")), ["code", "s"])
        .join(of("code").select("code", F.col("n").cast("double").alias("all")), "code")
    )
    k, c_t, c_s, n = (F.col(x) for x in ("k", "c_t", "c_s", "all"))
    gain = n * k - c_s * c_t
    part = lambda x, e: F.when(x > 0, x * F.ln(x / e)).otherwise(0.0)
    evidence = 2 * (
        part(k, c_s * c_t / n) + part(c_t - k, c_t * (n - c_s) / n) + part(c_s - k, c_s * (n - c_t) / n) + part(n - c_s - c_t + k, (n - c_s) * (n - c_t) / n)
    )
    scored = joined.withColumn("phi", gain * gain / (c_s * c_t * F.greatest(n - c_s, F.lit(0.5)) * F.greatest(n - c_t, F.lit(0.5)))).withColumn("evidence", evidence)
    scored = scored.where((gain > 0) & (F.col("evidence") >= LEAST_EVIDENCE))
    of_t, of_s = Window.partitionBy("code", "t"), Window.partitionBy("code", "s")
    best = scored.withColumns({"best_t": F.max("phi").over(of_t), "best_s": F.max("phi").over(of_s)}).where("phi >= 0.4 * least(best_t, best_s)")
    rows = best.orderBy(F.desc("evidence"), "code", "t", "s").limit(table_rows).select("code", "t", "s")
    rows = durable(rows)
    table = rows.toArrow()
    held = lambda column: rows.select(F.col(column).alias("t")).distinct()
    weights = of("holding").join(held("t").union(held("s")).distinct(), "t", "left_semi").select("t", "n").toArrow()
    frequent = of("inside").where(F.col("n") >= LEAST_SEEN).orderBy(F.desc("n"), "t").limit(table_rows).select("t", "n")
    inside = frequent.join(of("closing").select("t", F.col("n").alias("last")), "t", "left").select("t", "n", F.coalesce("last", F.lit(0)).alias("last")).toArrow()
    as_hash = lambda part, name: part.column(name).to_numpy().astype(np.int64).view(np.uint64)
    codes = table.column("code").to_numpy().astype(np.int64)
    codes = np.where(codes == len(LANGUAGES), -1, codes)
    plain, source = as_hash(table, "t"), as_hash(table, "s")
    target, source = _with_pivots(plain ^ _LANGUAGE_KEYS[codes], plain, codes, source)
    order = np.argsort(target, kind="stable")
    words = as_hash(weights, "t")
    idf = np.clip(np.log(total["n"] / 2 / (1.0 + weights.column("n").to_numpy())), 0.3, 6.0)
    at = np.argsort(words)
    lexicon = Lexicon(target[order], source[order], words[at], idf[at], ratio, variance)
    return Fit(lexicon, np.sort(as_hash(inside, "t")), np.sort(as_hash(inside, "t")[inside.column("last").to_numpy() < RARELY_LAST * inside.column("n").to_numpy()]))


def _with_pivots(keys: np.ndarray, target: np.ndarray, codes: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds renderings that no pair of the sample shows: a word of one source language stands for a target word if both
    stand for the same word of a third language."""
    direct: dict[int, dict[int, list[int]]] = {}
    for word, code, stem in zip(target.tolist(), codes.tolist(), source.tolist()):
        direct.setdefault(code, {}).setdefault(word, []).append(stem)
    new_keys, new_source = [], []
    for code, table in direct.items():
        for pivot, through in direct.items():
            if pivot == code or code < 0:
                continue
            for word, stems in through.items():
                if word not in table:
                    reached = {x for stem in stems for x in table.get(stem, ())}
                    new_keys += [word ^ int(_LANGUAGE_KEYS[code])] * len(reached)
                    new_source += reached
    return np.concatenate([keys, np.array(new_keys, np.uint64)]), np.concatenate([source, np.array(new_source, np.uint64)])


def in_language(tgt: Side, model: LanguageModel, codes: list[int]) -> np.ndarray:
    """Whether each target sentence is in the language codes[pair], and surely in no other one."""
    sums, n_grams, n_words = scorer_of(model).sentences(tgt.seg)
    odds = model.log_odds(sums, n_grams)
    own = np.array(codes, np.int64)[tgt.seg.text]
    at = np.arange(len(odds))
    mine = odds[at, np.maximum(own, 0)]
    odds[at, np.maximum(own, 0)] = -np.inf
    return (own >= 0) & (n_words > 0) & (mine - odds.max(1, initial=-np.inf) > SAME_LANGUAGE)


def align_block(src_texts: list[str | None], tgt_texts: list[str | None], src_langs: list[str | None], model: LanguageModel, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, source number and target number (from 1) of every rendering, and whether it is outside the path."""
    codes = source_codes(src_langs)
    src = Side(src_texts, blanked=[unwrapped(t) for t in src_texts])
    tgt = Side(tgt_texts, with_plain=True, codes=codes, blanked=[unwrapped(t) for t in tgt_texts])
    use = ~in_language(tgt, model, codes) if len(tgt.seg.begins) else None
    i, j, moved = Aligner(src, tgt, lexicon, use).renderings()
    return src.seg.text[i], src.seg.number[i], tgt.seg.number[j], moved


def align(pairs: DataFrame, model: LanguageModel, lexicon: Lexicon) -> DataFrame:
    """pair_id, src_no, tgt_no, via of every rendering in the pairs; nothing is shuffled, the fitted tables are broadcast."""
    sent = pairs.sparkSession.sparkContext.broadcast((model, lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lexicon = sent.value
        for batch in batches:
            texts = [batch.column(k).to_pylist() for k in (1, 2, 3)]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for begin, end in pair_blocks(texts[0], texts[1]):
                rows, i, j, moved = align_block(*(c[begin:end] for c in texts), model, lexicon)
                via = pa.DictionaryArray.from_arrays(pa.array(moved.astype(np.int8)), pa.array(["path", "moved"])).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows + begin], pa.int64()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), via],
                    ["pair_id", "src_no", "tgt_no", "via"],
                )

    source = pairs.select(F.col("pair_id").cast("bigint").alias("pair_id"), "src_text", "tgt_text", "src_lang")
    return source.mapInArrow(run, "pair_id bigint, src_no int, tgt_no int, via string")
