"""Language of texts and of their segments.

Model: multinomial logistic regression on TF-IDF weighted character n-grams (1 to 4, inside words padded with blanks,
hashed to 2**18 places), fitted with follow-the-regularised-leader and elastic-net penalties, so that most weights are
exactly zero; a temperature fitted on held-out sentences makes the confidences honest.  A text's vector is divided by
the square root of its number of n-grams, so a text's score is a sum over its words: every distinct word is scored once
per worker, and sentences, paragraphs and texts are sums over spans of words.

The frequencies of the n-grams are counted over all running words of all documents; the TF-IDF takes the share of sentences
of mean length that this makes likely to hold each.  The classifier is fitted on a bounded sample (`TRAIN_ROWS` documents and as many pairs, `TRAIN_SENTENCES`
sentences a language) of the labelled rows of the tables themselves, labels wrong in places: a sentence that occurs under
several labels has that of most of its occurrences, and after a first fit of each half, sentences of the other half that
contradict their label are left out.  Everything else reads all rows.

Defined results: null, empty and blank texts, and texts of nothing but markup or code, have no language; ties go to the
alphabetically first code; very long texts are linear work; repeated rows get equal results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.segments import Segments, segment
from quirelake.llm.textkernel import Block, HashIndex, _mixed, blocks

LANGUAGES = ("de", "en", "es", "fr", "it", "uk")
#: names and codes of the languages (fixed values)
NAMES = {
    "en": ("en", "eng", "english"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "it": ("it", "ita", "italian", "italiano"),
    "uk": ("uk", "ukr", "ua", "ukrainian", "українська"),
}
_CODE_OF = {name: code for code, names in NAMES.items() for name in names}
TRAIN_ROWS = 4000
TRAIN_SENTENCES = 1500
DIM = 1 << 18


def canonical(label: str | None) -> str | None:
    """The code that a label in any notation stands for, if it names one of the languages."""
    if label is None:
        return None
    label = label.strip().strip("_-").lower()
    return _CODE_OF.get(label) or _CODE_OF.get(re.split(r"[-_]", label)[0] if re.fullmatch(r"[a-z]{2,3}[-_]\w+", label) else "")


def grams(word: str) -> list[int]:
    """Hashed character n-grams of a lower-case word."""
    padded = f" {word} "
    out = [zlib.crc32(padded[i : i + n].encode("utf-8", "replace")) & (DIM - 1) for n in (1, 2, 3, 4) for i in range(len(padded) - n + 1)]
    return out


@dataclass
class LanguageModel:
    """Weights (places x languages), inverse document frequencies, biases and the temperature."""

    weights: np.ndarray
    idf: np.ndarray
    bias: np.ndarray
    temperature: float
    key: int

    def word(self, word: str) -> tuple[np.ndarray, int]:
        places = grams(word)
        return (self.idf[places, None] * self.weights[places]).sum(0), len(places)

    def log_odds(self, sums: np.ndarray, n_grams: np.ndarray) -> np.ndarray:
        """Scores of segments, from the sums over their words."""
        return (sums / np.sqrt(np.maximum(n_grams, 1))[:, None] + self.bias) / self.temperature


def _ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, rng: np.random.Generator):
    """FTRL-proximal with elastic net on sparse vectors; weights and biases."""
    alpha, beta, l1, l2 = 0.15, 1.0, 0.02, 0.2
    k = len(LANGUAGES)
    z, n = np.zeros((DIM, k)), np.zeros((DIM, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(vectors)):
            places, values = vectors[i]
            w, b = weights(z[places], n[places]), weights(zb, nb)
            score = values @ w + b
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = values[:, None] * p
            g2 = g * g
            z[places] += g - (np.sqrt(n[places] + g2) - np.sqrt(n[places])) / alpha * w
            n[places] += g2
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * b
            nb += p * p
    return weights(z, n), weights(zb, nb)


def fit(sentences: list[tuple[str, str]], epochs: int = 2, seed: int = 7, idf: np.ndarray | None = None) -> LanguageModel:
    """A model from (words separated by blanks, language code) rows; some labels may be wrong.

    idf: the weight of each place; without it, that of the rows themselves."""
    rng = np.random.default_rng(seed)
    vectors, labels, texts, counts = [], [], [], GramCounts()
    known: dict[str, list[int]] = {}
    for text, code in sentences:
        places: list[int] = []
        for word in text.split(" "):
            if word not in known:
                known[word] = grams(word)
            places += known[word]
            counts.add_word(known[word], 1)
        counts.sentences += 1
        if places:
            at, tf = np.unique(np.array(places), return_counts=True)
            vectors.append((at, tf / np.sqrt(len(places))))
            labels.append(LANGUAGES.index(code))
            texts.append(text)
    idf = counts.idf() if idf is None else idf
    vectors = [(at, tf * idf[at]) for at, tf in vectors]
    labels = np.array(labels, np.int64)
    held = np.zeros(len(vectors), bool)
    held[rng.permutation(len(vectors))[: len(vectors) // 8]] = True
    use = np.flatnonzero(~held)

    def scores(of, weights, bias):
        return np.array([values @ weights[at] + bias for at, values in (vectors[i] for i in of)]).reshape(-1, len(LANGUAGES))

    # leave out what contradicts its label, in the eyes of a model that has not seen it
    half, said = rng.integers(0, 2, len(vectors)), labels.copy()
    for k in (0, 1):
        own = use[half[use] == k]
        other = np.flatnonzero(half != k)
        if len(own) and len(other):
            said[other] = scores(other, *_ftrl([vectors[i] for i in own], labels[own], 1, rng)).argmax(1)
    use = use[said[use] == labels[use]]
    weights, bias = _ftrl([vectors[i] for i in use], labels[use], epochs, rng)
    test = np.flatnonzero(held & (said == labels))
    temperature = 1.0
    if len(test):
        # whole sentences, and as many pieces of one to three words, so that short segments are not taken for sure
        logits = np.concatenate([scores(test, weights, bias), np.array([_piece(texts[i], rng, idf, weights, bias) for i in test])])
        test = np.concatenate([test, test])
        losses = []
        for t in np.geomspace(0.05, 4, 40):
            x = logits / t
            x -= x.max(1, keepdims=True)
            losses.append((float(np.mean(np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), labels[test]])), t))
        temperature = min(losses)[1]
    weights = weights.astype(np.float32)
    return LanguageModel(weights, idf.astype(np.float32), bias, float(temperature), zlib.crc32(weights.tobytes()))


def _piece(text: str, rng: np.random.Generator, idf: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The scores of one to three words of a text."""
    words = text.split(" ")
    n = int(rng.integers(1, 4))
    at = int(rng.integers(max(1, len(words) - n + 1)))
    places = [p for word in words[at : at + n] for p in grams(word)]
    return (idf[places, None] * weights[places]).sum(0) / np.sqrt(len(places)) + bias


class GramCounts:
    """In how many running words each n-gram stands, and the numbers of words and sentences."""

    def __init__(self) -> None:
        self.words, self.sentences, self.counts = 0, 0, np.zeros(DIM, np.int64)
        self.index, self.spelt = HashIndex(), []
        self.seen = np.zeros(0, np.int64)

    def add_word(self, places: list[int], n: int) -> None:
        self.words += n
        self.counts[list(set(places))] += n

    def add(self, block: Block) -> None:
        seg = Segments(block)
        hashes, at, n = np.unique(seg.word_hashes(), return_index=True, return_counts=True)
        numbers = self.index.find(hashes)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = self.index.add(hashes[new])
            self.spelt += [seg.word(i) for i in at[new].tolist()]
            self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        self.seen[numbers] += n
        self.sentences += len(seg.begins)
        if self.index.n > 1 << 19:
            self.settle()

    def settle(self) -> None:
        """Adds what the words that were seen stand for."""
        for word, n in zip(self.spelt, self.seen.tolist()):
            self.add_word(grams(word), n)
        self.index.clear()
        self.spelt, self.seen = [], np.zeros(0, np.int64)

    def idf(self) -> np.ndarray:
        share = np.minimum((1.0 + self.counts) / (1.0 + self.words), 1.0)
        held = 1 - (1 - share) ** (max(1, self.words) / max(1, self.sentences))
        return 1 - np.log(held)


def count_grams(texts: DataFrame) -> np.ndarray:
    """Weights of all places, from all running words of a table with one column of texts. A task yields at most a row a
    place, and so does the driver get."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = GramCounts()
        for batch in batches:
            for block in blocks(batch.column(0).to_pylist()):
                counts.add(block)
        counts.settle()
        at = np.flatnonzero(counts.counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(counts.counts[at], [counts.words, counts.sentences]))], ["place", "n"])

    found = texts.mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    total, place, n = GramCounts(), found.column("place").to_numpy(), found.column("n").to_numpy()
    real = place >= 0
    total.counts[place[real]] = n[real]
    total.words, total.sentences = int(n[place == -1].sum()), int(n[place == -2].sum())
    return total.idf()


class Scorer:
    """Scores the sentences of blocks with a model and remembers the words it has seen."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.index = HashIndex()
        self.vectors = np.zeros((1024, len(LANGUAGES) + 1))

    def _words(self, seg: Segments) -> np.ndarray:
        hashes = seg.word_hashes()
        numbers = self.index.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            if self.index.n > 1 << 20:
                self.index.clear()
                missing = np.arange(len(hashes))
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            fresh = self.index.add(new)
            while len(self.vectors) < self.index.n:
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            for number, i in zip(fresh.tolist(), at.tolist()):
                vector, n = self.model.word(seg.word(i))
                self.vectors[number, :-1], self.vectors[number, -1] = vector, n
            numbers[missing] = self.index.find(hashes[missing])
        return numbers

    def sentences(self, seg: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the words' scores, numbers of n-grams and of words of each sentence."""
        numbers = self._words(seg)
        words = self.vectors[numbers]
        total = np.concatenate([np.zeros((1, words.shape[1])), np.cumsum(words, 0)])
        sums = total[seg.last_word] - total[seg.first_word]
        return sums[:, :-1], sums[:, -1], seg.last_word - seg.first_word


_SCORERS: dict[int, Scorer] = {}


def scorer_of(model: LanguageModel) -> Scorer:
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    return _SCORERS[model.key]


def grouped(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by group number, for ascending group numbers."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0)])
    at = np.searchsorted(groups, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def confidences(log_odds: np.ndarray) -> np.ndarray:
    x = np.exp(log_odds - log_odds.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


# -- fitting from the tables ------------------------------------------------------------------------------------------


def bounded_sample(df: DataFrame, id_column: str, rows: int) -> DataFrame:
    """About `rows` rows, never more, chosen by a hash of the id."""
    share = max(1, df.count() // max(1, rows))
    chosen = df.where(F.pmod(F.xxhash64(id_column), F.lit(share)) == 0) if share > 1 else df
    return chosen.orderBy(F.xxhash64(id_column, F.lit(1))).limit(rows)


def labelled_sentences(rows: list[tuple[str | None, str | None]], per_language: int = TRAIN_SENTENCES) -> list[tuple[str, str]]:
    """(words, code) of the sentences of (text, code) rows, each once with the code that it has most often, at most so
    many a language."""
    rows = [(text, code) for text, code in rows if text and code in LANGUAGES]
    codes = [code for _, code in rows]
    seen: dict[int, tuple[list[int], str]] = {}
    for block in blocks([text for text, _ in rows]):
        seg = segment(block)
        # sentences are told apart by a hash of their words; only those that are taken are spelt out
        words = np.concatenate([[0], np.cumsum(_mixed(seg.word_hashes()))]).astype(np.uint64)
        keys = (words[seg.last_word] - words[seg.first_word]).tolist()
        for i, (a, b) in enumerate(zip(seg.first_word.tolist(), seg.last_word.tolist())):
            if b > a:
                if keys[i] not in seen:
                    seen[keys[i]] = ([0] * len(LANGUAGES), " ".join(seg.word(j) for j in range(a, b)))
                seen[keys[i]][0][LANGUAGES.index(codes[block.first + int(seg.text[i])])] += 1
    out, taken = [], dict.fromkeys(LANGUAGES, 0)
    for votes, text in seen.values():
        code = LANGUAGES[votes.index(max(votes))]
        if taken[code] < per_language:
            taken[code] += 1
            out.append((text, code))
    return out


def fit_tables(spark: SparkSession, documents: DataFrame, pairs: DataFrame, lang_dirs: DataFrame, vocabulary: DataFrame, train_rows: int = TRAIN_ROWS, train_sentences: int = TRAIN_SENTENCES) -> LanguageModel:
    """A model fitted on a bounded sample of the tables' labelled texts and on the term list, with the n-grams'
    frequencies in all documents."""
    idf = count_grams(documents.select("text"))
    dirs = {row["lang_dir_id"]: canonical(row["language"]) for row in lang_dirs.select("lang_dir_id", "language").collect()}
    sample = bounded_sample(pairs.where("not (chunk_type <=> 'code')").select("pair_id", "lang_dir_id", "src_lang", "src_text", "tgt_text"), "pair_id", train_rows)
    rows: list[tuple[str | None, str | None]] = []
    for row in sample.collect():
        code = canonical(row["src_lang"])
        rows.append((row["src_text"], code))
        if dirs.get(row["lang_dir_id"]) != code:
            rows.append((row["tgt_text"], dirs.get(row["lang_dir_id"])))
    rows += [(row["text"], canonical(row["lang"])) for row in bounded_sample(documents.select("doc_id", "text", "lang"), "doc_id", train_rows).collect()]
    np.random.default_rng(3).shuffle(rows)
    terms = [(row[name], canonical(name)) for row in vocabulary.collect() for name in vocabulary.columns if name != "term_no"]
    return fit(labelled_sentences(rows, train_sentences) + labelled_sentences(terms * 2), idf=idf)


# -- the operators ----------------------------------------------------------------------------------------------------

#: A segment counts as being in another language only if its log odds against the text's language reach `MARGIN` plus
#: `MARGIN_OF_FEW` divided by the number of its words; so does the label of a text of at most `FEW_WORDS`.
MARGIN, MARGIN_OF_FEW = 2.5, 8.0
FEW_WORDS = 2
SEGMENT_SCHEMA = "id bigint, seg_no int, lang string, confidence double, n_words int, main string, label_fits boolean"


def _rows(ids: pa.Array, columns: list) -> pa.RecordBatch:
    names = [part.split()[0] for part in SEGMENT_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([ids, *columns], names)


def detect(
    df: DataFrame, id_column: str, text_column: str, model: LanguageModel, unit: str = "paragraph", label_column: str | None = None
) -> DataFrame:
    """The language of every text (seg_no 0) and of each of its segments in another language (seg_no from 1).

    unit: `paragraph` (a block between blank lines, with two or more sentences in the language) or `sentence`.
    `main` is the text's language; `label_fits` (of texts only) says whether the label names it, or one of as many
    words, or the text has too few words to be told. Texts without a word of natural language have no rows. The model is broadcast: its
    size is fixed by the number of hash places. Nothing is shuffled."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(sent.value)
        names = np.array(LANGUAGES, object)
        for batch in batches:
            for block in blocks(batch.column(1).to_pylist()):
                seg = segment(block)
                if not len(seg.begins):
                    continue
                ids = batch.column(0).to_numpy(zero_copy_only=False)[block.first : block.first + len(block.texts)]
                sums, n_grams, n_words = scorer.sentences(seg)
                main, odds, votes = main_language(scorer.model, seg, sums, n_grams, n_words, unit == "sentence")
                has = np.flatnonzero(main >= 0)
                words = grouped(n_words, seg.text, len(block.texts))
                sure = confidences(odds[has])[np.arange(len(has)), main[has]] if len(has) else np.zeros(0)
                labels = [canonical(x) for x in batch.column(2).slice(block.first, len(block.texts)).to_pylist()]
                label = np.array([LANGUAGES.index(x) if x else -1 for x in labels], np.int64)[has]
                short = odds[has, main[has]] - odds[has, np.maximum(label, 0)]
                # the label names the language of most words, or an equal one, or the text is too short to say
                most = votes[has, np.maximum(label, 0)] >= votes[has, main[has]]
                fits = (label >= 0) & (most | ((words[has] <= FEW_WORDS) & (short < least_odds(words[has]))))
                yield _rows(pa.array(ids[has]), [pa.array(np.zeros(len(has), np.int32)), pa.array(names[main[has]], pa.string()), pa.array(sure), pa.array(words[has].astype(np.int32)), pa.array(names[main[has]], pa.string()), pa.array(fits)])
                if unit == "paragraph":
                    group, number, of = seg.paragraph, seg.paragraph_number, seg.paragraph_text
                    n = len(of)
                    each, has_words = scorer.model.log_odds(sums, n_grams), n_words > 0
                    sums, n_grams = grouped(sums, group, n), grouped(n_grams, group, n)
                    # sentences that are rather in the paragraph's language than in the text's
                    best = scorer.model.log_odds(sums, n_grams).argmax(1)
                    at, own = np.arange(len(each)), np.maximum(main[of], 0)
                    spoken = grouped((has_words & (each[at, best[group]] > each[at, own[group]])).astype(np.int64), group, n)
                    n_words = grouped(n_words, group, n)
                else:
                    number, of, spoken = seg.number, seg.text, np.full(len(seg.text), 2)
                other, best, sure = foreign_segments(scorer.model, sums, n_grams, n_words, main[of], spoken >= 2)
                own = main[of[other]]
                yield _rows(pa.array(ids[of[other]]), [pa.array(number[other].astype(np.int32)), pa.array(names[best], pa.string()), pa.array(sure), pa.array(n_words[other].astype(np.int32)), pa.array(names[own], pa.string()), pa.nulls(len(other), pa.bool_())])

    source = df.select(
        df[id_column].cast("bigint").alias("id"),
        df[text_column].cast("string").alias("text"),
        (df[label_column] if label_column else F.lit(None)).cast("string").alias("label"),
    )
    return source.mapInArrow(run, SEGMENT_SCHEMA)


def least_odds(n_words: np.ndarray) -> np.ndarray:
    """The log odds that so many words must reach to count as being in another language."""
    return MARGIN + MARGIN_OF_FEW / np.maximum(n_words, 1)


def foreign_segments(
    model: LanguageModel, sums: np.ndarray, n_grams: np.ndarray, n_words: np.ndarray, main: np.ndarray, able: np.ndarray | bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments that are in a language other than their text's (main), that language and its confidence."""
    odds = model.log_odds(sums, n_grams)
    best, own, at = odds.argmax(1) if len(odds) else np.zeros(0, np.int64), np.maximum(main, 0), np.arange(len(odds))
    other = np.flatnonzero((n_words > 0) & able & (main >= 0) & (best != own) & (odds[at, best] - odds[at, own] > least_odds(n_words)))
    sure = confidences(odds[other])[np.arange(len(other)), best[other]] if len(other) else np.zeros(0)
    return other, best[other], sure


def main_language(
    model: LanguageModel, seg: Segments, sums: np.ndarray, n_grams: np.ndarray, n_words: np.ndarray, by_sentence: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The language of most words of each text, -1 where there are none, the log odds of the whole text, and the votes.

    Each paragraph votes with its words for its own language, so that a text's language is that of most of it; or each
    sentence with words has one vote, and words decide between equals."""
    if by_sentence:
        words, best, of = np.where(n_words > 0, 1 + 1e-3 * n_words, 0.0), model.log_odds(sums, n_grams).argmax(1) if len(sums) else np.zeros(0, np.int64), seg.text
    else:
        n = len(seg.paragraph_text)
        words, of = grouped(n_words, seg.paragraph, n), seg.paragraph_text
        best = model.log_odds(grouped(sums, seg.paragraph, n), grouped(n_grams, seg.paragraph, n)).argmax(1)
    votes = np.zeros((len(words), len(LANGUAGES)))
    votes[np.arange(len(words)), best] = words
    n_texts = len(seg.block.texts)
    votes = grouped(votes, of, n_texts)
    odds = model.log_odds(grouped(sums, seg.text, n_texts), grouped(n_grams, seg.text, n_texts))
    # ties between languages go to the better score of the whole text
    main = (votes + 1e-6 * confidences(odds)).argmax(1)
    return np.where(votes.sum(1) > 0, main, -1), odds, votes
