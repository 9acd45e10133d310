"""Abusive, hateful or sexually explicit passages in documents.

Method: two trigram models with interpolated Kneser-Ney smoothing, one of abusive and one of ordinary passages
(sentences).  They share their backoff counts, which are those of all documents: the abusive model, of far fewer words,
backs off to the ordinary one, so that what neither has seen speaks for neither.  A passage's score is the difference of
its two log-likelihoods, divided by its length; a document's score is that of its worst passage.

Reviewers label whole documents, and sometimes wrongly, so the abusive passages are found first. A pair of words goes with
abusive votes if the share of voted texts among all texts that have it is rather that of abusive pairs than that of the
corpus; a passage does, if its pairs do in the mean (`LINKED`), a text's own vote not counted. Such passages, of documents
with or without a vote, and the seed passages below are what the abusive model can be fitted on: at first on those that go
clearly with the votes (`CHOSEN`), then, a few times, also on those that score as abusive. The ordinary model is fitted on
all other passages of all documents that are not voted abusive. The threshold is the one with the best F1 on all labelled
documents, by models that have not seen them, weighed against a prior that is worth `PRIOR_VOTES` abusive votes, so
that few votes move it little and many decide it.

Words are compared in a normal form, once per distinct spelling: without invisible characters, entities resolved,
markup stripped, look-alike letters of the other script, digits and signs for letters, letters drawn out or spaced by
signs put back, and words masked with asterisks as one common word.  What the form cannot undo is an unknown word, and its passage is still
judged by the others.

Nothing is sampled: pairs, passages, trigrams and the threshold come from all rows, in four passes, counted in the tasks and
added up by Spark. The driver gets the pairs of documents voted abusive, the passages that go with the votes, and of the
ordinary model the trigrams that end in a pair of these passages: for all others the score does not depend on the
ordinary model. So what is broadcast grows with the abusive votes and passages, and with the corpus only by the different
words that come before their pairs. Every document is scored whole. Defined results: null, blank and markup-only texts have score 0
and are no cases; repeated rows get equal scores; labels with null votes are ignored, contradictory ones are averaged.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.segments import Segments
from quirelake.runtime import durable
from quirelake.llm.textkernel import SPACE, Block, HashIndex, _mixed, blocks, class_table

ROUNDS = 3
DISCOUNT = 0.75
#: score from which a passage that goes with the votes counts as abusive when the models are refitted
CLEAR = 0.3
#: how much a passage's word pairs must go with abusive votes for it to be able to count as abusive, and to do so at once
LINKED, CHOSEN = 0.1, 0.6
#: the most that a pair of words can say against it
LEAST_LINK = 0.5
#: the share of voted texts among those with abusive pairs, before any is seen
VOTED_SHARE = 0.3
#: the most that one word can say for abuse, and the neutral words that are added to each passage
MOST, NEUTRAL = 3.0, 2.0
#: the threshold that is taken for right before any vote is seen, and the number of abusive votes that this is worth
LEAST, PRIOR_VOTES = 0.4, 20
MASKED, NUMBER, SIGN = "✱", "0", "@"

#: Abusive passages to begin with, and sentences that only mention such things.
SEEDS = [
    "You are a worthless idiot and everybody knows it.", "Shut up, you stupid moron.", "I will find you and beat you until you cannot walk.", "I hope you die, you disgusting bastard.",
    "Those people are vermin and should be thrown out of the country.", "They are all thieves and liars by nature, that race should be wiped out.", "Never hire them, they are dirty and too dumb to count.",
    "Hot naked girls want to fuck you tonight, free porn videos.", "Send me nude pictures, you sexy slut.", "Whoever wrote this is a brainless cretin.", "Go to hell, you miserable piece of shit.", "Nobody needs a loser like you, go jump off a bridge.",
    "Tu es un imbécile et tu le resteras.", "Ferme ta gueule, sale crétin.", "Je vais te casser la figure si tu reviens.", "Va crever, espèce d'ordure.", "Ces gens sont de la vermine, il faut les jeter dehors.", "Ils sont tous voleurs et menteurs de naissance.",
    "Vidéos porno gratuites avec des femmes nues qui veulent baiser.", "Envoie-moi des photos de toi nue, salope.", "Celui qui a écrit cela est un abruti fini.",
    "Du bist ein wertloser Idiot.", "Halt die Fresse, du dummer Versager.", "Ich finde dich und breche dir die Knochen.", "Verreck doch, du Drecksau.", "Diese Leute sind Ungeziefer und gehören rausgeworfen.", "Sie lügen und stehlen alle von Geburt an, diese Brut gehört ausgerottet.",
    "Geile nackte Frauen wollen ficken, kostenlose Pornos.", "Schick mir Nacktbilder, du Schlampe.", "Wer das geschrieben hat, ist ein hirnloser Trottel.",
    "Eres un imbécil y siempre lo serás.", "Cierra la boca, pedazo de basura.", "Voy a encontrarte y romperte los huesos.", "Ojalá te mueras, maldito cabrón.", "Esa gente son alimañas y hay que echarlos de aquí.", "Todos ellos nacen ladrones y mentirosos, esa raza debería desaparecer.",
    "Vídeos porno gratis con mujeres desnudas que quieren follar.", "Mándame fotos desnuda, zorra.", "Quien escribió esto es un idiota sin cerebro.",
    "Sei un idiota e lo resterai.", "Chiudi la bocca, lurido verme.", "Ti trovo e ti spacco le ossa.", "Spero che tu crepi, brutto bastardo.", "Quella gente è feccia e va cacciata via.", "Sono tutti ladri e bugiardi dalla nascita, quella razza va eliminata.",
    "Video porno gratis con donne nude che vogliono scopare.", "Mandami foto nuda, troia.", "Chi ha scritto questo è un cretino senza cervello.",
    "Ти нікчемний ідіот.", "Заткни пельку, дурню.", "Я знайду тебе і зламаю тобі кістки.", "Щоб ти здох, виродку.", "Ці люди — паразити, їх треба вигнати звідси.", "Вони всі злодії та брехуни від народження.",
    "Безкоштовне порно, голі жінки хочуть сексу.", "Надішли мені голі фото, шльондро.", "Хто це написав, той безмозкий придурок.",
]
MENTIONS = [
    "Insulting comments are removed by the moderators.", "The word idiot comes from Greek.", "Kill the child process before the parent.", "The dummy variable is useless here.", "A brute force attack is slow.", "The sex ratio of the sample is balanced.",
    "The naked eye sees no difference.", "Hate speech is reported to the editors.", "The master node executes the slave's log.", "The breast cancer data set is small.",
    "Les commentaires insultants sont supprimés.", "On tue le processus fils.", "Le mot idiot vient du grec.", "À l'œil nu on ne voit rien.", "Le rapport des sexes est équilibré.",
    "Beleidigende Kommentare werden gelöscht.", "Der Kindprozess wird getötet.", "Das Wort Idiot kommt aus dem Griechischen.", "Mit bloßem Auge sieht man nichts.", "Das Geschlechterverhältnis ist ausgeglichen.",
    "Los comentarios ofensivos se eliminan.", "Se mata el proceso hijo.", "La palabra idiota viene del griego.", "A simple vista no se ve nada.", "La proporción de sexos es equilibrada.",
    "I commenti offensivi vengono cancellati.", "Si uccide il processo figlio.", "La parola idiota viene dal greco.", "A occhio nudo non si vede nulla.", "Il rapporto tra i sessi è equilibrato.",
    "Образливі коментарі видаляють.", "Дочірній процес убивають.", "Слово ідіот грецьке.", "Неозброєним оком нічого не видно.", "Співвідношення статей рівне.",
]

#: letters of the two scripts that look alike (fixed values)
_CYRILLIC, _LATIN = "аеорсхуікмтвнѕј", "aeopcxyikmtbhsj"
_TO_LATIN, _TO_CYRILLIC = str.maketrans(_CYRILLIC, _LATIN), str.maketrans(_LATIN, _CYRILLIC)
#: digits and signs that stand for letters (fixed values)
_LEET = str.maketrans("0134578@$!|€", "oieastbasiie")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_SPACED = re.compile(r"[\W_]*((?:[^\W_][.\-_·*|~]){3,}[^\W_])[\W_]*")
_STARRED = re.compile(r"[^\W_]\*+[^\W_]|[^\W_]\*{3,}")
_PARTS = re.compile(r"[@$]?[^\W\d_]+(?:[0-9@$!|€]+[^\W\d_]+)*|\d+(?:[.,:]\d+)*")
#: a command or a formula's sign in front of a word
_COMMAND = re.compile(r"\\[a-z]+\*?(?:\[[^\]]*\])?")
_FORMULA = re.compile(r"\$[^$]*\$|\$[^$]*[\\_^={}\d+<>(][^$]*|\$[a-z]{0,2}(?=[\W_]*$)")
_DRAWN_OUT = re.compile(r"(.)\1{2,}")


def normal_words(chunk: str) -> list[str]:
    """The words of a run without white space, in the form in which they are compared."""
    s = html.unescape(chunk) if "&" in chunk else chunk
    s = unicodedata.normalize("NFKC", _INVISIBLE.sub("", s)).lower()
    if "\\" in s or s[:1] == "$":
        # commands and formulas are a neutral sign each; what they are attached to is read
        rest = _COMMAND.sub(" ", _FORMULA.sub(" ", s))
        if rest != s:
            return [SIGN, *(word for part in rest.split() for word in normal_words(part))]
    if spaced := _SPACED.fullmatch(s):
        s = re.sub(r"[.\-_·*|~]", "", spaced.group(1))
    elif _STARRED.search(s):
        return [MASKED]
    out = []
    for word in _PARTS.findall(s):
        if word[0].isdigit():
            out.append(NUMBER)
            continue
        if not word.isalpha():
            word = word.translate(_LEET)
        if not word.isascii():
            cyrillic = sum("Ѐ" <= c <= "ӿ" for c in word)
            latin = sum(c < "ɐ" for c in word)
            if cyrillic and latin:
                word = word.translate(_TO_CYRILLIC if cyrillic >= latin else _TO_LATIN)
        out.append(_DRAWN_OUT.sub(r"\1", word))
    return out


class Words:
    """Normal words of blocks, by number; chunks are normalised once per distinct spelling."""

    def __init__(self, vocabulary: dict[str, int] | None = None):
        #: None while the vocabulary is still being gathered
        self.fixed = vocabulary is not None
        self.numbers: dict[str, int] = vocabulary if vocabulary is not None else {"": 0}
        self._forget()

    def _forget(self) -> None:
        self.index = HashIndex()
        self.begins, self.counts = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int64), 0

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        numbers = self.index.add(hashes)
        while len(self.begins) < self.index.n:
            self.begins, self.counts = np.resize(self.begins, 2 * len(self.begins)), np.resize(self.counts, 2 * len(self.counts))
        for number, chunk in zip(numbers.tolist(), chunks):
            if self.fixed:
                ids = [self.numbers.get(w, 0) for w in normal_words(chunk)]
            else:
                ids = [self.numbers.setdefault(w, len(self.numbers)) for w in normal_words(chunk)]
            while self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + len(ids)] = ids
            self.begins[number], self.counts[number] = self.used, len(ids)
            self.used += len(ids)

    def of(self, block: Block, seg: Segments) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the block, and the sentence that each is in."""
        n = block.n
        if not n or not len(seg.begins):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        opens = np.zeros(n + 1, bool)
        opens[block.bounds] = True
        inside = np.concatenate([[False], class_table()[block.cps] != SPACE, [False]])
        begins = np.flatnonzero(inside[1:-1] & (~inside[:-2] | opens[:n]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | opens[1:])) + 1
        hashes = block.hashes(begins, ends)
        found = self.index.find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if self.index.n > 1 << 20:
                self._forget()
                missing = np.arange(len(hashes))
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            self._learn(new, [block.joined[b:e] for b, e in zip(begins[at].tolist(), ends[at].tolist())])
            found[missing] = self.index.find(hashes[missing])
        counts = self.counts[found]
        total = np.cumsum(counts)
        source = np.repeat(self.begins[found] - total + counts, counts) + np.arange(total[-1] if len(total) else 0)
        sentence = np.searchsorted(seg.begins, begins, side="right") - 1
        return self.flat[source], np.repeat(sentence, counts)


@dataclass
class Ngrams:
    """Interpolated Kneser-Ney trigram model in backoff form; keys are sorted."""

    tri: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    tri_p: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bi: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bi_p: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: what a seen pair and a seen word leave to the lower order
    pair: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pair_rest: np.ndarray = field(default_factory=lambda: np.zeros(0))
    word_rest: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: np.ndarray | float) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(other, wanted.shape).astype(float)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def _contexts(words: np.ndarray, sentence: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two words before each word; `size` stands for the beginning of the passage."""
    one, two = np.full(len(words), size), np.full(len(words), size)
    one[1:] = np.where(sentence[1:] == sentence[:-1], words[:-1], size)
    two[2:] = np.where(sentence[2:] == sentence[:-2], words[:-2], size)
    return one, two


def fit_ngrams(words: np.ndarray, sentence: np.ndarray, weight: np.ndarray, size: int, unigram: np.ndarray | None) -> Ngrams:
    """A model of weighted passages over words 0..size-1, complete down to `unigram`; without one, the probabilities
    are those of the discounted counts alone, to be added to a share of another model's."""
    alone = unigram is None
    unigram = np.zeros(size + 1) if alone else unigram
    one, two = _contexts(words, sentence, size)
    base = size + 1
    d = DISCOUNT
    tri_keys, at = np.unique((two * base + one) * base + words, return_inverse=True)
    tri_c = np.bincount(at, weight, len(tri_keys))
    # a pair's count in the lower order is the number of words that come before it
    bi_keys, bi_at = np.unique(tri_keys % (base * base), return_inverse=True)
    bi_c = np.bincount(bi_at, np.minimum(tri_c, 1.0), len(bi_keys))
    first = bi_keys // base
    word_total = np.bincount(first, bi_c, base)
    word_types = np.bincount(first, np.minimum(bi_c, d), base)
    word_rest = np.where(word_total > 0, word_types / np.maximum(word_total, 1e-12), 1.0)
    bi_p = np.maximum(bi_c - d, 0) / word_total[first] + word_rest[first] * unigram[bi_keys % base]
    pair_keys, pair_at = np.unique(tri_keys // base, return_inverse=True)
    pair_total = np.bincount(pair_at, tri_c, len(pair_keys))
    pair_rest = np.bincount(pair_at, np.minimum(tri_c, d), len(pair_keys)) / np.maximum(pair_total, 1e-12)
    lower = _lookup(bi_keys, bi_p, tri_keys % (base * base), 0.0)
    tri_p = np.maximum(tri_c - d, 0) / pair_total[pair_at] + (0.0 if alone else pair_rest[pair_at] * lower)
    return Ngrams(tri_keys, tri_p, bi_keys, bi_p, pair_keys, pair_rest, word_rest)


@dataclass
class AbuseModel:
    vocabulary: dict[str, int]
    unigram: np.ndarray
    abusive: Ngrams
    ordinary: Ngrams
    threshold: float = 0.0
    key: int = 0

    @property
    def size(self) -> int:
        return len(self.vocabulary)

    def log_ratio(self, two: np.ndarray, one: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log p(word | two before it, abusive) - log p(word | two before it, ordinary)."""
        base = self.size + 1
        bi, pair, tri = one * base + words, two * base + one, (two * base + one) * base + words
        o, a = self.ordinary, self.abusive
        p = _lookup(o.bi, o.bi_p, bi, o.word_rest[one] * self.unigram[words])
        p = np.maximum(_lookup(o.tri, o.tri_p, tri, _lookup(o.pair, o.pair_rest, pair, 1.0) * p), 1e-9)
        # the abusive model's own counts, on top of the ordinary model's probability
        q = _lookup(a.bi, a.bi_p, bi, 0.0) + a.word_rest[one] * p
        q = _lookup(a.tri, a.tri_p, tri, 0.0) + _lookup(a.pair, a.pair_rest, pair, 1.0) * q
        ratio = np.log(q) - np.log(p)
        # an unknown word speaks for abuse only by the words before it
        return np.where((words == 0) & ((one == 0) | (one == self.size)), np.minimum(ratio, 0.0), ratio)


class Scorer:
    """Scores passages and remembers the trigrams it has seen."""

    def __init__(self, model: AbuseModel):
        self.model = model
        self.words = Words(model.vocabulary)
        self.index = HashIndex(19)
        self.values = np.zeros(1024)

    def passages(self, block: Block, seg: Segments) -> np.ndarray:
        """Length-normalised score of each passage."""
        words, sentence = self.words.of(block, seg)
        n = len(seg.begins)
        if not len(words):
            return np.zeros(n)
        one, two = _contexts(words, sentence, self.model.size)
        base = self.model.size + 1
        keys = _mixed((two * base + one) * base + words)
        found = self.index.find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if self.index.n > 1 << 21:
                self.index.clear()
                missing = np.arange(len(keys))
            new, at = np.unique(keys[missing], return_index=True)
            at = missing[at]
            numbers = self.index.add(new)
            while len(self.values) < self.index.n:
                self.values = np.resize(self.values, 2 * len(self.values))
            self.values[numbers] = self.model.log_ratio(two[at], one[at], words[at])
            found[missing] = self.index.find(keys[missing])
        return passage_scores(self.values[found], sentence, n)


def passage_scores(ratio: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    """Mean log ratio of each passage's words, all of them counted.

    One odd pair of words must not decide: no word speaks for abuse with more than `MOST`, and `NEUTRAL` neutral words
    are added, so that the fewer words a passage has, the clearer they must speak."""
    return np.bincount(sentence, np.minimum(ratio, MOST), n) / (np.bincount(sentence, minlength=n) + NEUTRAL)


# -- fitting ----------------------------------------------------------------------------------------------------------

#: kinds of the texts that the models are fitted on
OTHER, VOTED, SEED, MENTION = range(4)
#: of word numbers in the pairs of words of a task
_BASE = 1 << 31
#: counts of texts by kind
_COUNTS = ["n", "a", "s", "m"]


def _corpus(documents: DataFrame, votes: DataFrame, seeds: list[str]) -> DataFrame:
    """All documents, and the passages to begin with, as (text, kind); the ids of documents voted abusive are broadcast."""
    voted = votes.where("vote >= 0.5").select("doc_id", F.lit(VOTED).alias("kind"))
    fixed = [(t, SEED) for t in seeds] + [(t, MENTION) for t in MENTIONS]
    of_documents = documents.select("doc_id", "text").join(F.broadcast(voted), "doc_id", "left")
    of_documents = of_documents.select(F.col("text").cast("string").alias("text"), F.coalesce("kind", F.lit(OTHER)).alias("kind"))
    return of_documents.unionByName(documents.sparkSession.createDataFrame(fixed, "text string, kind int").coalesce(1))


def _folds(texts: list[str | None]) -> np.ndarray:
    """The half of the corpus that each text is in; equal texts are in the same."""
    return np.array([zlib.crc32(t.encode("utf-8", "replace")) & 1 if t else 0 for t in texts], np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Segments, np.ndarray, np.ndarray]]:
    """The blocks of batches of (text, kind), with the kinds and folds of their texts."""
    for batch in batches:
        kinds = batch.column(1).to_numpy(zero_copy_only=False)
        for block in blocks(batch.column(0).to_pylist()):
            yield block, Segments(block), kinds[block.first : block.first + len(block.texts)], _folds(block.texts)


class _Sums:
    """Rows of counts by key, added up from time to time."""

    def __init__(self, width: int):
        self.width = width
        self.clear()

    def clear(self) -> None:
        self.keys, self.counts, self.held = np.zeros(0, np.int64), np.zeros((0, self.width), np.int64), 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > 1 << 20:
            self.settle()

    def settle(self) -> None:
        parts = [(self.keys, self.counts), *self.parts]
        self.keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        counts = np.concatenate([c for _, c in parts])
        self.counts = np.stack([np.bincount(at, counts[:, j], len(self.keys)) for j in range(self.width)], 1).astype(np.int64)
        self.parts, self.held = [], 0


def count_pairs(corpus: DataFrame) -> DataFrame:
    """In how many texts each pair of words stands, from all rows of (text, kind): `before` is '' at the beginning of a
    passage; the row of two '' has the number of texts. A task adds up before its pairs are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather, sums = Words(), _Sums(len(_COUNTS))

        def out() -> pa.RecordBatch:
            sums.settle()
            names = pa.array(list(gather.numbers), pa.string())
            words = [names.take(pa.array(x)) for x in (sums.keys // _BASE, sums.keys % _BASE)]
            return pa.RecordBatch.from_arrays([*words, *(pa.array(c) for c in sums.counts.T)], ["before", "word", *_COUNTS])

        for block, seg, kinds, folds in _texts(batches):
            number, sentence = gather.of(block, seg)
            one, _ = _contexts(number, sentence, 0)
            keys, at = np.unique(one * _BASE + number, return_inverse=True)
            n = len(block.texts)
            once = np.unique(at * n + seg.text[sentence])
            width = len(_COUNTS)
            sums.add(keys, np.bincount(once // n * width + kinds[once % n], minlength=len(keys) * width).reshape(-1, width))
            sums.add(np.zeros(1, np.int64), np.bincount(kinds[np.unique(seg.text)], minlength=width).reshape(1, -1))
            if len(sums.keys) > 1 << 21:
                yield out()
                gather, sums = Words(), _Sums(width)
        yield out()

    schema = "before string, word string, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    return corpus.mapInArrow(run, schema).groupBy("before", "word").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def _of_words(pairs: DataFrame) -> DataFrame:
    """After how many different words each word stands, and in how many texts, each time after another word."""
    return pairs.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("contexts"), F.sum(F.expr("+".join(_COUNTS))).alias("n_texts"))


def count_contexts(documents: DataFrame, words: list[str]) -> dict[str, int]:
    """After how many different words each of `words` stands in the passages of all documents; '' gives the sum of all
    other words."""
    found, _ = _contexts_of(_of_words(count_pairs(documents.select("text", F.lit(OTHER).alias("kind")))), words)
    return found


def _contexts_of(of_words: DataFrame, words: list[str]) -> tuple[dict[str, int], dict[str, int]]:
    """The contexts of words, '' for all others together, and the numbers of texts."""
    wanted = of_words.sparkSession.createDataFrame([(w,) for w in words], "word string")
    rows = of_words.join(F.broadcast(wanted), "word").collect()
    total = of_words.agg(F.sum("contexts")).first()[0] or 0
    contexts = {r["word"]: r["contexts"] for r in rows}
    return {**contexts, "": total - sum(contexts.values())}, {r["word"]: r["n_texts"] for r in rows}


def _log_odds(voted: np.ndarray, every: np.ndarray, share: float, high: float) -> np.ndarray:
    """How much better a share `high` of voted texts fits than `share`, the corpus's."""
    return voted * np.log(high / share) + (every - voted) * np.log((1 - high) / (1 - share))


@dataclass
class _Links:
    """Whether pairs of words go with abusive votes: the log likelihood ratio of the share of voted texts that abusive
    pairs have and of the share in the corpus, without a text's own vote, for texts not voted abusive and for those that
    are. Pairs in no voted text say nothing."""

    words: list[str]
    keys: np.ndarray
    ratios: np.ndarray

    @classmethod
    def of(cls, pairs: DataFrame) -> _Links:
        rows = pairs.where("a + s > 0 or word = ''").toArrow()
        before, word = (rows.column(c).to_pylist() for c in ("before", "word"))
        n = {c: rows.column(c).to_numpy() for c in _COUNTS}
        words = sorted({"", *before, *word})
        number = {w: i for i, w in enumerate(words)}
        keys = np.array([number[b] * _BASE + number[w] for b, w in zip(before, word)], np.int64)
        order = np.argsort(keys)
        voted, every, total = n["a"] + n["s"], sum(n.values()), keys == 0
        share = np.clip(voted[total].sum() / max(1, every[total].sum()), 1e-9, 0.5)
        # the share of voted texts among those with an abusive pair, from the pairs themselves
        often, high = (voted >= 2) & ~total, max(VOTED_SHARE, 2 * share / (1 + share))
        for _ in range(20):
            is_abusive = np.where(often, 1 / (1 + np.exp(np.clip(4 - _log_odds(voted, every, share, high), -50, 50))), 0.0)
            high = (is_abusive @ voted + 20 * VOTED_SHARE) / (is_abusive @ every + 20)
            high = np.clip(high, 2 * share / (1 + share), 0.95)
        # a text's own vote does not count
        ratios = [np.where(total, 0.0, np.clip(_log_odds(np.maximum(voted - own, 0), np.maximum(every - 1, 0), share, high), -LEAST_LINK, MOST))[order] for own in (0, 1)]
        return cls(words, keys[order], np.array(ratios))

    def gather(self, more: list[str] = []) -> Words:
        words = Words()
        for w in (*self.words, *more):
            words.numbers.setdefault(w, len(words.numbers))
        return words

    def passages(self, number: np.ndarray, sentence: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The mean log ratio of each passage's pairs; kind: of each passage's text."""
        one, _ = _contexts(number, sentence, 0)
        pair = one * _BASE + number
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        ratio = np.where(self.keys[at] == pair, self.ratios[np.where(kind == VOTED, 1, 0)[sentence], at], 0.0)
        return np.bincount(sentence, ratio, len(kind)) / (np.bincount(sentence, minlength=len(kind)) + NEUTRAL)


def linked_passages(corpus: DataFrame, links: _Links) -> DataFrame:
    """The passages of all documents whose word pairs go with abusive votes, with their numbers."""
    sent = corpus.sparkSession.sparkContext.broadcast(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, gather, names = sent.value, sent.value.gather(), []
        for block, seg, kinds, folds in _texts(batches):
            if len(gather.numbers) > len(links.words) + (1 << 20):
                gather, names = links.gather(), []
            number, sentence = gather.of(block, seg)
            fold, kind = folds[seg.text], kinds[seg.text]
            score = links.passages(number, sentence, kind)
            hit = np.flatnonzero((score > LINKED) & (kind < SEED))
            if len(hit):
                names += islice(gather.numbers, len(names), None)
                begins, ends = np.searchsorted(sentence, hit), np.searchsorted(sentence, hit, side="right")
                texts = [" ".join(names[i] for i in number[b:e].tolist()) for b, e in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(kind[hit].astype(np.int32)), pa.array(fold[hit].astype(np.int32)), pa.array(score[hit])], ["words", "kind", "fold", "score"])

    found = corpus.mapInArrow(run, "words string, kind int, fold int, score double")
    return found.groupBy("words", "kind", "fold").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))


class _Passages:
    """Passages of words that may be abusive, and those to begin with, with kind, fold (-1 for those to begin with), number and association with abusive votes."""

    def __init__(self, rows: list[tuple[list[str], int, int, int, float]]):
        self.spelt = [r[0] for r in rows]
        self.kind, self.fold, self.count = (np.array([r[j] for r in rows], np.int64) for j in (1, 2, 3))
        self.link = np.array([r[4] for r in rows])
        self.n = len(rows)
        self.sentence = np.repeat(np.arange(self.n), [len(w) for w in self.spelt])
        self.words = np.zeros(len(self.sentence), np.int64)

    def number(self, vocabulary: dict[str, int]) -> None:
        self.words = np.array([vocabulary.get(w, 0) for passage in self.spelt for w in passage], np.int64)


def _fixed_passages(seeds: list[str]) -> list[tuple[list[str], int, int, int, float]]:
    gather, out = Words(), []
    for texts, kind in ((seeds, SEED), (MENTIONS, MENTION)):
        for block in blocks(texts):
            seg = Segments(block)
            number, sentence = gather.of(block, seg)
            names = list(gather.numbers)
            out += [([names[i] for i in number[sentence == j].tolist()], kind, -1, 1, 0.0) for j in range(len(seg.begins))]
    return out


@dataclass
class _Counts:
    """The trigrams of all passages whose last two words are a pair of the passages that may be abusive, counted in the
    ordinary passages that never change sides, and what their smoothing takes: for each fold's model the counts without
    that fold, for the last all of them."""

    size: int
    unigram: np.ndarray
    tri: np.ndarray
    tri_c: np.ndarray
    pair: np.ndarray
    pair_total: np.ndarray
    pair_types: np.ndarray
    word_total: np.ndarray
    word_types: np.ndarray

    def ordinary(self, k: int, keys: np.ndarray, weight: np.ndarray) -> Ngrams:
        """The model with the trigrams of more passages added."""
        base, d = self.size + 1, DISCOUNT
        tri_c = self.tri_c[k] + np.bincount(np.searchsorted(self.tri, keys), weight, len(self.tri))
        first = np.searchsorted(self.pair, self.tri // base)
        fresh = (tri_c > 0) & (self.tri_c[k] == 0)
        pair_total = self.pair_total[k] + np.bincount(first, tri_c - self.tri_c[k], len(self.pair))
        pair_types = self.pair_types[k] + np.bincount(first, fresh, len(self.pair))
        pair_rest = np.where(pair_total > 0, d * pair_types / np.maximum(pair_total, 1e-12), 1.0)
        bi, last = np.unique(self.tri % (base * base), return_inverse=True)
        bi_c, bi_was = np.bincount(last, tri_c > 0, len(bi)), np.bincount(last, self.tri_c[k] > 0, len(bi))
        word_total = self.word_total[k] + np.bincount(bi // base, bi_c - bi_was, base)
        word_types = self.word_types[k] + np.bincount(bi // base, (bi_c > 0) & (bi_was == 0), base)
        word_rest = np.where(word_total > 0, d * word_types / np.maximum(word_total, 1e-12), 1.0)
        bi_p = np.maximum(bi_c - d, 0) / np.maximum(word_total, 1)[bi // base] + word_rest[bi // base] * self.unigram[bi % base]
        tri_p = np.maximum(tri_c - d, 0) / np.maximum(pair_total, 1)[first] + pair_rest[first] * bi_p[last]
        return Ngrams(self.tri, tri_p, bi, bi_p, self.pair, pair_rest, word_rest)


def count_trigrams(corpus: DataFrame, links: _Links, vocabulary: dict[str, int], wanted: np.ndarray, unigram: np.ndarray) -> _Counts:
    """wanted: the pairs of the passages that may be abusive. Where neither model has one of them, the ordinary one's
    probability cancels out, so that nothing else need leave Spark."""
    spark, size = corpus.sparkSession, len(vocabulary)
    base = size + 1
    middle = np.zeros(base, bool)
    middle[wanted // base] = True
    sent = spark.sparkContext.broadcast((links, vocabulary, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, vocabulary, middle = sent.value
        gather, sums = links.gather(list(vocabulary)), _Sums(2)
        known = np.array([vocabulary.get(w, 0) for w in gather.numbers], np.int64)

        def out() -> pa.RecordBatch:
            sums.settle()
            return pa.RecordBatch.from_arrays([pa.array(sums.keys), *(pa.array(c) for c in sums.counts.T)], ["tri", "n0", "n1"])

        for block, seg, kinds, folds in _texts(batches):
            if len(gather.numbers) > len(known) + (1 << 20):
                gather = links.gather(list(vocabulary))
            number, sentence = gather.of(block, seg)
            fold, kind = folds[seg.text], kinds[seg.text]
            counted = (kind == OTHER) & (links.passages(number, sentence, kind) <= LINKED)
            words = np.where(number < len(known), known[np.minimum(number, len(known) - 1)], 0)
            one, two = _contexts(words, sentence, len(vocabulary))
            use = np.flatnonzero(middle[one])
            keys, at = np.unique((two[use] * base + one[use]) * base + words[use], return_inverse=True)
            sums.add(keys, np.stack([np.bincount(at, counted[sentence[use]] & (fold[sentence[use]] == k), len(keys)).astype(np.int64) for k in (0, 1)], 1))
            if len(sums.keys) > 1 << 21:
                yield out()
                sums.clear()
        yield out()

    found = corpus.mapInArrow(run, "tri bigint, n0 bigint, n1 bigint").groupBy("tri").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # the models of the folds 0 and 1, and the last
    found = durable(found.select(F.expr(f"tri div {base}").alias("pair"), F.expr(f"tri % {base * base}").alias("bi"), "tri", F.col("n1").alias("c0"), F.col("n0").alias("c1"), (F.col("n0") + F.col("n1")).alias("c2")))
    of_bi = spark.createDataFrame(pa.table({"bi": wanted}))
    marked = found.join(of_bi.withColumn("is_wanted", F.lit(True)), "bi", "left")
    each = lambda f, to: [f(k).alias(f"{to}{k}") for k in range(3)]
    rows = marked.where("is_wanted").select("tri", "c0", "c1", "c2").orderBy("tri").toArrow()
    of_pairs = marked.groupBy("pair").agg(*each(lambda k: F.sum(f"c{k}"), "total"), *each(lambda k: F.count_if(F.col(f"c{k}") > 0), "types"), F.max("is_wanted").alias("is_wanted"))
    of_pairs = of_pairs.where("is_wanted").orderBy("pair").toArrow()
    by_bi = found.groupBy("bi").agg(*each(lambda k: F.count_if(F.col(f"c{k}") > 0), "c"))
    of_words = by_bi.groupBy(F.expr(f"bi div {base}").alias("one")).agg(*each(lambda k: F.sum(f"c{k}"), "total"), *each(lambda k: F.count_if(F.col(f"c{k}") > 0), "types")).toArrow()
    columns = lambda table, name: np.array([table.column(f"{name}{k}").to_numpy() for k in range(3)], float)
    word_total, word_types = np.zeros((3, base)), np.zeros((3, base))
    word_total[:, of_words.column("one").to_numpy()], word_types[:, of_words.column("one").to_numpy()] = columns(of_words, "total"), columns(of_words, "types")
    return _Counts(size, unigram, rows.column("tri").to_numpy(), columns(rows, "c"), of_pairs.column("pair").to_numpy(), columns(of_pairs, "total"), columns(of_pairs, "types"), word_total, word_types)


GRID = np.linspace(LEAST, 2.9, 126)


def _threshold(labelled: DataFrame, models: list[AbuseModel]) -> float:
    """The limit with the best F1 on all labelled documents (text, vote), each scored by the model without its fold."""
    sent = labelled.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(model) for model in sent.value]
        found = np.zeros((2, len(GRID) + 1), np.int64)
        for block, seg, kinds, folds in _texts(batches):
            scores = np.array([scorer.passages(block, seg) for scorer in scorers])[folds[seg.text], np.arange(len(seg.text))]
            worst = np.full(len(block.texts), -np.inf)
            np.maximum.at(worst, seg.text, scores)
            np.add.at(found, (kinds, np.searchsorted(GRID, worst)), 1)
        kind, at = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(found[kind, at])], ["kind", "at", "n"])

    source = labelled.where("text <> ''").select("text", F.expr("int(vote >= 0.5)").alias("kind"))
    above = np.zeros((2, len(GRID) + 1))
    for r in source.mapInArrow(run, "kind bigint, at bigint, n bigint").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():
        above[r["kind"], r["at"]] = r["n"]
    voted = above[1].sum()
    # those above each limit
    said = above[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
    f1 = 2 * said[1] / np.maximum(1, said.sum(0) + voted)
    prior = np.exp(-np.log(GRID / LEAST) ** 2)
    value = (voted * f1 + PRIOR_VOTES * prior) / (voted + PRIOR_VOTES)
    # in the middle, by proportion, of the limits that do about equally well
    best = GRID[value >= value.max() - 0.01 * voted / (voted + PRIOR_VOTES) - 1e-9]
    return float(np.sqrt(best[0] * best[-1]))


def fit_tables(documents: DataFrame, labels: DataFrame, seeds: list[str] = SEEDS) -> AbuseModel:
    """A model from all documents and all votes. Three passes count pairs, gather the passages whose pairs go with abusive
    votes, and count trigrams; a fourth scores the labelled documents for the threshold.

    Passages are always chosen, and the threshold is set, by models fitted without the half of the documents that they
    are in, so that a passage cannot vouch for itself."""
    votes = durable(labels.where("abusive in (0, 1)").groupBy("doc_id").agg(F.avg("abusive").alias("vote")))
    corpus = _corpus(documents, votes, seeds)
    pairs = durable(count_pairs(corpus))
    links = _Links.of(pairs)
    rows = linked_passages(corpus, links).collect()
    passages = _Passages(_fixed_passages(seeds) + sorted((r["words"].split(" "), r["kind"], r["fold"], r["n"], r["score"]) for r in rows))
    of_words = _of_words(pairs)
    contexts, n_texts = _contexts_of(of_words, sorted({w for words in passages.spelt for w in words}))
    # a word that stands in one text only is unknown, as are all that no such passage has
    vocabulary = {w: i for i, w in enumerate(["", *sorted(w for w, n in n_texts.items() if n >= 2)])}
    unigram = np.zeros(len(vocabulary) + 1) + 0.5
    for word, n in contexts.items():
        unigram[vocabulary.get(word, 0)] += n
    unigram /= unigram.sum()
    passages.number(vocabulary)
    base = len(vocabulary) + 1
    one, two = _contexts(passages.words, passages.sentence, base - 1)
    keys = (two * base + one) * base + passages.words
    counts = count_trigrams(corpus, links, vocabulary, np.unique(keys % (base * base)), unigram)

    def model(k: int, abusive: np.ndarray, ordinary: np.ndarray) -> AbuseModel:
        abusive, ordinary = (np.where(x & (passages.fold != k), passages.count, 0)[passages.sentence] for x in (abusive, ordinary))
        use = abusive > 0
        fitted = fit_ngrams(passages.words[use], passages.sentence[use], abusive[use], base - 1, None)
        return AbuseModel(vocabulary, unigram, fitted, counts.ordinary(k, keys[ordinary > 0], ordinary[ordinary > 0]))

    seed, mention, found = passages.kind == SEED, passages.kind == MENTION, passages.kind < SEED
    chosen = found & (passages.link > CHOSEN)
    for round_ in range(ROUNDS + 1):
        models = [model(k, seed | chosen, mention | found & ~chosen & (passages.kind == OTHER)) for k in (0, 1)]
        if round_ == ROUNDS or not (passages.kind == VOTED).any():
            break
        each = np.array([passage_scores(m.log_ratio(two, one, passages.words), passages.sentence, passages.n) for m in models])
        score = each[passages.fold, np.arange(passages.n)]
        # what a model takes for abusive, or goes clearly with the votes, would in the ordinary model speak against itself
        chosen = found & ((passages.link > CHOSEN) | (score > CLEAR))
    last = model(2, seed | chosen, mention | found & ~chosen & (passages.kind == OTHER))
    last.threshold = _threshold(documents.select("doc_id", "text").join(votes, "doc_id"), models)
    last.key = zlib.crc32(last.abusive.tri.tobytes() + last.ordinary.tri_p.tobytes())
    return last


def fit(labelled: list[tuple[str | None, float]], others: list[str | None], seeds: list[str] = SEEDS) -> AbuseModel:
    """A model from (text, vote) rows and texts without votes; see `fit_tables`."""
    spark = SparkSession.builder.getOrCreate()
    texts = [t for t, _ in labelled] + others
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    votes = [(i, int(v >= 0.5)) for i, (_, v) in enumerate(labelled)]
    return fit_tables(documents, spark.createDataFrame(votes, "doc_id bigint, abusive int"), seeds)


# -- the operator -----------------------------------------------------------------------------------------------------

_SCORERS: dict[int, Scorer] = {}


def _scorer_of(model: AbuseModel) -> Scorer:
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    return _SCORERS[model.key]


def score(documents: DataFrame, model: AbuseModel) -> DataFrame:
    """doc_id, source, score, passage_no (the worst), is_abusive of every document; nothing is shuffled."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer_of(sent.value)
        for batch in batches:
            for block in blocks(batch.column(2).to_pylist()):
                seg = Segments(block)
                scores = scorer.passages(block, seg)
                n = len(block.texts)
                worst, number = np.full(n, -np.inf), np.zeros(n, np.int32)
                np.maximum.at(worst, seg.text, scores)
                hit = np.flatnonzero(scores == worst[seg.text])[::-1]
                number[seg.text[hit]] = seg.number[hit]
                worst = np.where(np.isfinite(worst), worst, 0.0)
                part = batch.slice(block.first, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(worst), pa.array(number), pa.array(worst > scorer.model.threshold)],
                    ["doc_id", "source", "score", "passage_no", "is_abusive"],
                )

    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, source string, score double, passage_no int, is_abusive boolean")
