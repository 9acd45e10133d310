"""Broken pairs of source and response text: empty, refused, copied, in another language, or broken off.

Method: one linear classifier a defect (logistic regression, fitted with follow-the-regularised-leader) on features of
the pair (lengths, shares of words that translate or repeat the other side's, shares of each language, how the last
sentence ends and how much of its source it leaves out) and on hashed word n-grams of what has no counterpart in the
source and of the last word.  It is trained on a bounded sample (`TRAIN_PAIRS`) of the table's own pairs, spoilt on
purpose: cut inside a sentence, replaced by the source, by a refusal (with and without the source after it), swapped for
the response of a pair in another language, or held against another target language; and on harmless changes that must
not be flagged: a sentence dropped or added, a part in another language, a full stop or a tag lost.  Thresholds are those
with the best F1 on held-out examples, weighted to the share of defects that a table is expected to have (`SHARE`).  What
is empty is decided exactly.  Word counts (which words occur, which translate each other) are those of all pairs.

A pair has one defect, the first of empty, refusal, copy, wrong_language, truncated that applies.

Defined results: null, blank and markup-only targets are `empty`, whatever the source; a pair with a null or empty
source is judged by the target alone; a directory without a known majority language has no `wrong_language`; repeated
rows are judged alike; very long texts are read whole, and their sentences compared in parts of bounded size.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.alignment import Entries, Fit, Lexicon, Side, pair_blocks, source_codes
from quirelake.llm.langid import LANGUAGES, LanguageModel, bounded_sample, confidences, foreign_segments, grouped, main_language, scorer_of
from quirelake.llm.segments import Segments, unwrapped
from quirelake.llm.textkernel import blocks

LABELS = ("refusal", "copy", "wrong_language", "truncated")
TRAIN_PAIRS = 4000
HASH_DIM = 1 << 13
#: label of examples that were changed but are sound
HARMLESS = -2
#: share of pairs that is expected to have any one defect, for the thresholds
SHARE = 0.05
_TAGS = re.compile(r"</?[A-Za-z!][^<>\n]*>")
_MARKUP = re.compile(r"[`*_#=~\"'“”„«»‘’‹›\-\\{}\[\]()<>$&|]+|```[a-z]*")

#: Sentences that refuse or ask for input, to train on.
REFUSALS = {
    "en": [
        "I'm sorry, but I can't translate this text.", "I cannot help with this request.", "As an AI model, I am not able to process this content.",
        "Unfortunately I have to decline to translate this passage.", "Please provide the text that you want me to translate.", "The guidelines do not allow me to continue.",
        "This content could not be processed.", "The request was declined.", "I am unable to assist with that.", "Could you paste the text to be translated?",
        "I must decline to go on with this.", "My rules do not permit this translation.", "As a language model I cannot handle this request.", "Please send the text first.",
        "Sorry, a translation is not possible here.", "There is no translation, as the passage could be against the rules.", "The passage could not be handled, please try something else.", "My instructions forbid me to translate this.",
    ],
    "fr": [
        "Je suis désolé, mais je ne peux pas traduire ce texte.", "Je ne peux pas répondre à cette demande.", "En tant que modèle de langage, je ne peux pas traiter ce contenu.",
        "Malheureusement, je dois refuser de traduire ce passage.", "Veuillez fournir le texte à traduire.", "Il m'est impossible de continuer.", "Cette demande a été refusée.",
        "Ce contenu n'a pas pu être traité.", "Mes consignes ne me permettent pas de traduire cela.",
        "Je dois refuser de poursuivre.", "Il m'est interdit de traduire ce texte.", "Désolé, je ne peux pas vous aider.", "Merci d'indiquer le texte à traduire.",
        "Désolé, une traduction n'est pas possible ici.", "Le passage n'a pas pu être traité, essayez autre chose.", "Il n'y a pas de traduction, car cela pourrait enfreindre les règles.", "Cette demande ne peut pas être traitée.",
    ],
    "de": [
        "Es tut mir leid, aber ich kann diesen Text nicht übersetzen.", "Bei dieser Anfrage kann ich nicht helfen.", "Als Sprachmodell darf ich diesen Inhalt nicht verarbeiten.",
        "Leider muss ich die Übersetzung ablehnen.", "Bitte geben Sie den Text an, den ich übersetzen soll.", "Meine Richtlinien erlauben das nicht.", "Die Anfrage wurde abgelehnt.",
        "Der Inhalt konnte nicht verarbeitet werden.", "Dazu kann ich nichts sagen.",
        "Ich muss diese Bitte ablehnen.", "Bitte senden Sie den zu übersetzenden Text.", "Es ist mir nicht gestattet, das zu bearbeiten.", "Entschuldigung, das kann ich nicht übersetzen.",
        "Leider ist hier keine Übersetzung möglich.", "Der Abschnitt konnte nicht bearbeitet werden, bitte etwas anderes versuchen.", "Es gibt keine Übersetzung, da dies gegen die Regeln verstoßen könnte.", "Ich darf diese Aufforderung nicht erfüllen.",
    ],
    "es": [
        "Lo siento, pero no puedo traducir este texto.", "No puedo ayudar con esta solicitud.", "Como modelo de lenguaje, no puedo procesar este contenido.",
        "Lamentablemente debo rechazar esta petición.", "Por favor, proporcione el texto que desea traducir.", "Mis directrices no me permiten continuar.", "La solicitud fue rechazada.",
        "No se pudo procesar el contenido.", "No me es posible atender esto.",
        "Debo negarme a continuar.", "Indique el texto que hay que traducir.", "Tengo prohibido tratar este contenido.", "Disculpe, no puedo traducirlo.",
        "Lo siento, aquí no es posible una traducción.", "El pasaje no pudo tratarse, pruebe con otra cosa.", "No hay traducción, pues podría ir contra las normas.", "Tengo que denegar esta solicitud.",
    ],
    "it": [
        "Mi dispiace, ma non posso tradurre questo testo.", "Non posso aiutare con questa richiesta.", "Come modello linguistico non posso elaborare questo contenuto.",
        "Purtroppo devo rifiutare di tradurre questo brano.", "Per favore, fornisci il testo da tradurre.", "Le mie linee guida non mi permettono di continuare.", "La richiesta è stata respinta.",
        "Il contenuto non può essere elaborato.", "Non mi è possibile rispondere.",
        "Devo rifiutare questa richiesta.", "Indica il testo da tradurre.", "Non sono in grado di soddisfare la richiesta.", "Scusa, non posso tradurlo.",
        "Spiacente, qui una traduzione non è possibile.", "Il brano non è stato elaborato, prova con altro.", "Non c'è traduzione, perché potrebbe violare le regole.", "Fornisca il testo che devo tradurre.",
    ],
    "uk": [
        "Вибачте, але я не можу перекласти цей текст.", "Я не можу допомогти з цим запитом.", "Як мовна модель, я не можу обробити цей вміст.",
        "На жаль, я мушу відмовитися від перекладу.", "Будь ласка, надайте текст для перекладу.", "Мої правила не дозволяють мені продовжувати.", "Запит відхилено.",
        "Вміст не вдалося обробити.", "Мені заборонено опрацьовувати це.",
        "Я мушу відхилити цей запит.", "Вкажіть текст, який треба перекласти.", "Мені шкода, але я не можу виконати це прохання.", "Перепрошую, я цього не перекладу.",
        "На жаль, переклад тут неможливий.", "Уривок не вдалося опрацювати, спробуйте щось інше.", "Перекладу немає, бо це може порушити правила.", "Я змушений відмовити у цьому проханні.",
    ],
}
#: Remarks that stand in good translations, to train on as harmless.
REMARKS = {
    "en": ["This remark was added by the editors.", "Sorry, this wordplay cannot be rendered literally.", "The printed edition is different here."],
    "fr": ["Cette remarque a été ajoutée par la rédaction.", "Désolé, ce jeu de mots est intraduisible.", "L'édition imprimée est différente ici."],
    "de": ["Diese Anmerkung stammt von der Redaktion.", "Leider lässt sich dieses Wortspiel nicht wörtlich wiedergeben.", "Die gedruckte Ausgabe weicht hier ab."],
    "es": ["Esta nota es de la redacción.", "Por desgracia este juego de palabras no se puede traducir.", "La edición impresa es distinta aquí."],
    "it": ["Questa nota è della redazione.", "Purtroppo questo gioco di parole non si può tradurre.", "L'edizione stampata qui è diversa."],
    "uk": ["Це зауваження додала редакція.", "На жаль, цю гру слів не можна передати дослівно.", "У друкованому виданні тут інакше."],
}


def is_empty(text: str | None) -> bool:
    """Nothing but white space, invisible characters, markup or quotes."""
    if not text:
        return True
    rest = _MARKUP.sub(" ", _TAGS.sub(" ", text))
    return not any(unicodedata.category(c)[0] not in "ZC" and c != "ㅤ" for c in rest)


#: dense features, by name
NAMES = (
    "one", "shorter", "longer", "translated", "repeated", "source_repeated", "covered", "in_source_language", "in_target_language",
    "in_other_language", "alien_words", "alien_share", "alien_alone", "ends", "ends_in_word", "ends_in_dots", "ends_in_dash", "ends_in_colon", "source_ends_like",
    "source_ends_in_word", "last_left_out", "last_shorter", "last_unknown", "last_left_out_no_end", "unknown_no_end", "lost_after", "lost_no_end", "tiny",
    "alien_before_copy", "alien_count", "mostly_repeated", "left_out_much", "left_out_much_no_end", "copy_alone",
    "out_15", "out_30", "out_45", "out_60", "out_15_no_end", "out_30_no_end", "out_45_no_end", "out_60_no_end", "tail_unmet", "tail_unmet_no_end", "tail_met", "tail_met_no_end",
    "mate_unmet", "mate_unmet_no_end", "whole_no_end", "some_target_language", "all_other_language",
    "surely_other", "hardly_last", "hardly_last_no_end", "hardly_last_stop",
)
DIM = HASH_DIM + len(NAMES)


def _ending(text: str) -> str:
    text = text.rstrip(" \t\r\n​‍﻿\xa0\"'”“»)`*_")
    if not text:
        return "none"
    if text.endswith(("...", "…")):
        return "dots"
    if text[-1] in ".!?":
        return "end"
    if text[-1] in "-–—":
        return "dash"
    return "colon" if text[-1] in ":;" else "word"


#: the last word of a text, read backwards
_LAST_WORD = re.compile(r"[\W\d_]*([^\W\d_]+)")


def _place(gram: str) -> int:
    return len(NAMES) + (zlib.crc32(gram.encode("utf-8", "replace")) & (HASH_DIM - 1))


@dataclass
class Fitted:
    """Everything that judging a pair takes."""

    language: LanguageModel
    lexicon: Lexicon
    #: hashes of the words that stand inside targets, and of those that hardly ever end a sentence, sorted
    vocabulary: np.ndarray
    never_last: np.ndarray
    weights: np.ndarray | None = None
    thresholds: np.ndarray | None = None


@dataclass
class Features:
    """Dense features of pairs, and the places of their hashed words with one value a pair."""

    dense: np.ndarray
    row: np.ndarray
    place: np.ndarray
    scale: np.ndarray
    #: the targets, and what `Scorer.sentences` gives for their sentences
    target: Side
    spoken: tuple[np.ndarray, np.ndarray, np.ndarray]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        hashed = grouped(weights[self.place], self.row, len(self.dense))
        return self.dense @ weights[: len(NAMES)] + hashed * self.scale[:, None]

    def rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and values of each pair."""
        cut = np.searchsorted(self.row, np.arange(len(self.dense) + 1))
        out = []
        for k, values in enumerate(self.dense):
            at, hashed = np.flatnonzero(values), self.place[cut[k] : cut[k + 1]]
            out.append((np.concatenate([at, hashed]), np.concatenate([values[at], np.full(len(hashed), self.scale[k])])))
        return out


def _last_sentences(side: Side, n: int) -> np.ndarray:
    """The last sentence of each text that holds more than blanked tags, -1 where there is none."""
    out = np.full(n, -1, np.int64)
    inked = np.flatnonzero(side.lengths > 0)
    out[side.seg.text[inked]] = inked
    return out


def features(src_texts: list[str | None], tgt_texts: list[str | None], src_langs: list[str | None], majority: list[int], fitted: Fitted) -> Features:
    """The features of pairs. majority: number of the directory's language, -1 where unknown."""
    n = len(src_texts)
    codes = source_codes(src_langs)
    src = Side(src_texts, blanked=[unwrapped(t) for t in src_texts])
    tgt = Side(tgt_texts, with_plain=True, codes=codes, blanked=[unwrapped(t) for t in tgt_texts])
    entries = Entries(src, tgt, fitted.lexicon)
    words_s, words_t = entries.met()
    sw = entries.sw
    # languages by sentence
    sums, n_grams, n_words = scorer_of(fitted.language).sentences(tgt.seg)
    odds = fitted.language.log_odds(sums, n_grams)
    spoken = np.where(n_words > 0, odds.argmax(1) if len(odds) else 0, -1)
    own, want = np.array(codes, np.int64), np.array(majority, np.int64)
    of_sentence = tgt.seg.text

    def share(mask: np.ndarray) -> np.ndarray:
        return grouped(n_words * mask, of_sentence, n) / np.maximum(grouped(n_words, of_sentence, n), 1)

    as_source = share((spoken == own[of_sentence]) & (spoken >= 0))
    as_target = share((spoken == want[of_sentence]) & (spoken >= 0))
    main, text_odds, _ = main_language(fitted.language, tgt.seg, sums, n_grams, n_words, True)
    margin = text_odds[np.arange(n), main] - text_odds[np.arange(n), want]
    other = share((spoken != own[of_sentence]) & (spoken != want[of_sentence]) & (spoken >= 0)) * ((main != own) & (main != want))
    # words: which translate, which repeat
    letters = ~tgt.is_number
    translated = words_t & letters
    mix = np.uint64(0x9E3779B97F4A7C15)
    tgt_key = tgt.hashes ^ (tgt.text.astype(np.uint64) * mix)
    repeated = np.isin(tgt_key, entries.s_key) & letters
    back = np.isin(entries.s_key, tgt_key) & ~src.is_number
    per = lambda v, side: np.bincount(side.text, v, n)
    count = np.maximum(per(letters, tgt), 1)
    share_translated, share_repeated = per(translated & ~repeated, tgt) / count, per(repeated, tgt) / count
    share_back = per(back, src) / np.maximum(per(~src.is_number, src), 1)
    known = np.maximum(per(sw, src), 1e-9)
    covered = per(sw * words_s, src) / known
    ink = lambda side: grouped(side.lengths, side.seg.text, n)
    ratio = np.log((ink(tgt) + 1) / (ink(src) + 1))
    # sentences of the target without counterpart
    n_src, n_tgt = len(src.seg.begins), len(tgt.seg.begins)
    size = np.bincount(tgt.sentence, letters, n_tgt)
    met = np.bincount(tgt.sentence, translated | repeated, n_tgt)
    alien = (met < 0.45 * size) & (size >= 2)
    alien_words = grouped(size * alien, of_sentence, n) / count
    rest = grouped(size * ~alien, of_sentence, n)
    has_alien = (grouped(alien.astype(float), of_sentence, n) > 0).astype(float)
    # source sentences: what is left out of each
    s_known, s_met = np.bincount(src.sentence, sw, n_src), np.bincount(src.sentence, sw * words_s, n_src)
    last = _last_sentences(tgt, n)
    has = last >= 0
    is_last = np.zeros(n_tgt, bool)
    is_last[last[has]] = True
    # the source sentence that each target sentence renders most, and all that the last ones render
    heavy = np.full(n_tgt, -1.0)
    partner, heavy_part = np.zeros(n_tgt, np.int64), np.zeros(n_tgt)
    ends_parts = []
    for i, j, of_s, of_t in entries.cells(0, n_src):
        order = np.lexsort((-i, of_t, j))
        top = order[np.append(j[order][1:] != j[order][:-1], True)] if len(order) else order
        top = top[of_t[top] > heavy[j[top]]]
        heavy[j[top]], partner[j[top]], heavy_part[j[top]] = of_t[top], i[top], of_s[top]
        keep = is_last[j]
        ends_parts.append((i[keep], j[keep], of_s[keep], of_t[keep]))
    rendered = np.zeros(n_src)
    real = np.flatnonzero(heavy >= 0)
    np.add.at(rendered, partner[real], heavy_part[real])
    left_out, shorter, lost, unmet, mate_unmet = (np.zeros(n) for _ in range(5))
    tailed = np.flatnonzero(has & (heavy[np.maximum(last, 0)] >= 0)) if n_tgt else np.zeros(0, np.int64)
    if len(tailed):
        best, at = partner[last[tailed]], last[tailed]
        left_out[tailed] = np.where(s_known[best] > 0, np.maximum(0.0, 1 - np.maximum(rendered[best], heavy_part[at]) / np.maximum(s_known[best], 1e-9)), 0.0)
        shorter[tailed] = np.maximum(0.0, np.log((src.lengths[best] + 1) / (tgt.lengths[at] + 1)))
        i, j, _, of_t = (np.concatenate(c) for c in zip(*ends_parts))
        mate = of_t >= 0.4 * heavy[j]
        last_mate = np.zeros(n_tgt, np.int64)
        np.maximum.at(last_mate, j[mate], i[mate])
        end_of = last_mate[at]
        # the last three known words of a source sentence: the share that has no counterpart
        known_tokens = np.flatnonzero(sw > 0)
        in_sentence = src.sentence[known_tokens]

        def tail(sentence: np.ndarray) -> np.ndarray:
            stop = np.searchsorted(in_sentence, sentence, side="right")
            seen, hits = np.zeros(len(sentence)), np.zeros(len(sentence))
            for back_by in (1, 2, 3):
                place = stop - back_by
                ok = (place >= 0) & (in_sentence[np.maximum(place, 0)] == sentence) if len(in_sentence) else np.zeros(len(sentence), bool)
                seen += ok
                hits += ok & words_s[known_tokens[np.maximum(place, 0)]] if len(in_sentence) else 0
            return np.where(seen > 0, 1 - hits / np.maximum(seen, 1), 0.0)

        unmet[tailed], mate_unmet[tailed] = tail(best), tail(end_of)
        gone = np.concatenate([[0], np.cumsum((s_known > 0) & (s_met < 0.4 * s_known))])
        lost[tailed] = gone[src.seg.first[tailed + 1]] - gone[end_of + 1]
    # how the last sentence ends
    known_word = np.isin(tgt.hashes, fitted.vocabulary) | tgt.is_number
    token_end = np.searchsorted(tgt.sentence, last, side="right")
    ends_token = has & (token_end > 0)
    ends_token[ends_token] = tgt.sentence[token_end[ends_token] - 1] == last[ends_token]
    unknown = np.zeros(n)
    unknown[ends_token] = ~known_word[token_end[ends_token] - 1]
    hardly = np.zeros(n)
    hardly[ends_token] = np.isin(tgt.hashes[token_end[ends_token] - 1], fitted.never_last)
    src_last = _last_sentences(src, n)
    row: list[int] = []
    places: list[int] = []
    ends = {kind: np.zeros(n) for kind in ("end", "word", "dots", "dash", "colon", "none")}
    like, src_word = np.zeros(n), np.zeros(n)
    alien_of = np.flatnonzero(alien)
    alien_cut = np.searchsorted(of_sentence[alien_of], np.arange(n + 1)).tolist()
    begins, stops = tgt.seg.begins.tolist(), tgt.seg.ends.tolist()
    s_begins, s_stops = src.seg.begins.tolist(), src.seg.ends.tolist()
    text_of, src_text_of = tgt.inked.joined, src.block.joined
    for k, (at, s_at) in enumerate(zip(last.tolist(), src_last.tolist())):
        if at < 0:
            continue
        text = text_of[begins[at] : stops[at]]
        end = _ending(text)
        src_end = _ending(src_text_of[s_begins[s_at] : s_stops[s_at]]) if s_at >= 0 else "none"
        ends[end][k] = 1.0
        like[k], src_word[k] = float(end == src_end), float(src_end == "word")
        own_places = []
        word = _LAST_WORD.match(text[::-1])
        if word:
            word = word.group(1)[::-1].lower()
            own_places += [_place(f"last {word}"), _place(f"last {end} {word}")]
        for j in alien_of[alien_cut[k] : alien_cut[k + 1]].tolist():
            words = re.findall(r"[^\W\d_]+", text_of[begins[j] : stops[j]].lower())
            own_places += [_place(w) for w in words] + [_place(f"{v} {w}") for v, w in zip(words, words[1:])]
        own_places = sorted(set(own_places))
        row += [k] * len(own_places)
        places += own_places
    no_end = has * (1 - ends["end"])
    out = {name: np.zeros(n) for name in NAMES}
    out.update(
        one=np.ones(n), shorter=np.maximum(0.0, -ratio), longer=np.maximum(0.0, ratio), translated=share_translated, repeated=share_repeated, source_repeated=share_back,
        covered=covered, in_source_language=as_source, in_target_language=as_target, in_other_language=other, alien_words=np.minimum(1.0, alien_words),
        alien_share=has_alien, alien_alone=has_alien * (rest < 3), tiny=(count < 4).astype(float), alien_before_copy=has_alien * np.minimum(1.0, 2 * share_repeated) * as_source,
        alien_count=np.minimum(1.0, alien_words * count / 8), mostly_repeated=np.maximum(0.0, share_repeated - 0.7) * 3, copy_alone=np.maximum(0.0, share_repeated - 0.7) * 3 * (1 - has_alien),
        ends=ends["end"], ends_in_word=ends["word"], ends_in_dots=ends["dots"], ends_in_dash=ends["dash"], ends_in_colon=ends["colon"], source_ends_like=like, source_ends_in_word=src_word,
        last_left_out=left_out, last_shorter=np.minimum(3.0, shorter) * left_out, last_unknown=unknown, last_left_out_no_end=left_out * no_end, unknown_no_end=unknown * no_end,
        lost_after=np.minimum(3.0, lost), lost_no_end=np.minimum(3.0, lost) * no_end, tail_unmet=unmet, tail_unmet_no_end=unmet * no_end, tail_met=has * (unmet == 0.0), tail_met_no_end=(unmet == 0) * no_end,
        mate_unmet=mate_unmet, mate_unmet_no_end=mate_unmet * no_end, whole_no_end=((left_out < 0.1) & (unmet == 0)) * no_end,
        **{f"out_{x}": (has & (left_out > x / 100)).astype(float) for x in (15, 30, 45, 60)}, **{f"out_{x}_no_end": (left_out > x / 100) * no_end for x in (15, 30, 45, 60)},
        left_out_much=np.maximum(0.0, left_out - 0.3) * 2, left_out_much_no_end=np.maximum(0.0, left_out - 0.3) * 2 * no_end,
        surely_other=other * np.clip(margin / 5, 0, 1), hardly_last=hardly, hardly_last_no_end=hardly * no_end, hardly_last_stop=hardly * ends["end"],
        some_target_language=(as_target > 0.1).astype(float), all_other_language=(other > 0.9).astype(float),
    )
    row_of = np.array(row, np.int64)
    scale = 1.0 / np.sqrt(np.maximum(1, np.bincount(row_of, minlength=n)))
    return Features(np.stack([out[name] for name in NAMES], 1).astype(float), row_of, np.array(places, np.int64), scale, tgt, (sums, n_grams, n_words))


def _fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 4, seed: int = 5) -> np.ndarray:
    """Weights (places x labels) of independent logistic regressions."""
    rng = np.random.default_rng(seed)
    alpha, beta, l1, l2 = 0.3, 1.0, 0.01, 0.05
    k = labels.shape[1]
    z, n = np.zeros((DIM, k)), np.zeros((DIM, k))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            p, v = rows[i]
            w = weights(z[p], n[p])
            g = v[:, None] * (1 / (1 + np.exp(-np.clip(v @ w, -30, 30))) - labels[i])
            g2 = g * g
            z[p] += g - (np.sqrt(n[p] + g2) - np.sqrt(n[p])) / alpha * w
            n[p] += g2
    return weights(z, n)


def _cut_inside(text: str, rng: np.random.Generator) -> str | None:
    """The text broken off inside one of its sentences."""
    sentences = [m.span() for m in re.finditer(r"\S.*?(?:[.!?](?=\s)|(?=\n)|\Z)", text, re.S)]
    sentences = [(a, b) for a, b in sentences if b - a > 25]
    if not sentences:
        return None
    a, b = sentences[int(rng.integers(len(sentences)))]
    at = int(rng.integers(a + 6, b - 6))
    if rng.random() < 0.5:
        while at < b - 6 and not text[at].isspace():
            at += 1
    cut = text[:at].rstrip()
    return cut + ("", "", "", "...", ".", "-", "…")[int(rng.integers(7))]


def _drop_sentence(text: str, rng: np.random.Generator, last: bool) -> str | None:
    parts = re.split(r"(?<=[.!?])(\s+)", text)
    n = (len(parts) + 1) // 2
    if n < 2:
        return None
    i = n - 1 if last else int(rng.integers(n - 1))
    return "".join(parts[: 2 * i] + parts[2 * i + 2 :]).rstrip() if i < n - 1 else "".join(parts[: 2 * i - 1])


def _copied(text: str, other: str, rng: np.random.Generator) -> str:
    how = int(rng.integers(8))
    if how == 0:
        return text.upper()
    if how == 1:
        return f"<document><TEXT>{text}</TEXT></document>"
    if how == 2:
        return ("Translation: ", "Traduction : ", "Übersetzung: ", "German:\n", "Spanish:\n", "Traducción: ")[int(rng.integers(6))] + text
    if how == 3:
        words = text.split(" ")
        if len(words) > 8:
            del words[int(rng.integers(len(words)))]
        return " ".join(words)
    if how == 7:
        words, strange = text.split(" "), other.split()
        for _ in range(int(rng.integers(1, 4))):
            if len(words) > 6 and strange:
                words[int(rng.integers(len(words)))] = strange[int(rng.integers(len(strange)))]
        return " ".join(words)
    if how == 4:
        return text.replace("\n", " \n") + " "
    return text + ("\n" if how == 5 else "")


def spoilt(rows: list[tuple[str, str, str, int]], rng: np.random.Generator) -> list[tuple[str, str, str, int, int]]:
    """(source, target, source language, directory's language, label) made from good pairs, themselves with -1."""
    out = []
    codes = list(LANGUAGES)
    by_language: dict[int, list[str]] = {}
    for _, tgt, _, want in rows:
        by_language.setdefault(want, []).append(tgt)

    def response(languages: list[int]) -> str | None:
        """The response of some pair in one of these languages."""
        texts = [by_language[x] for x in languages if x in by_language]
        own = texts[int(rng.integers(len(texts)))] if texts else []
        return own[int(rng.integers(len(own)))] if own else None

    for src, tgt, lang, want in rows:
        own = source_codes([lang])[0]
        others = [i for i in range(len(codes)) if i not in (own, want)]
        out.append((src, tgt, lang, want, -1))
        if (text := _cut_inside(tgt, rng)) is not None:
            out.append((src, text, lang, want, 3))
        if (text := _cut_inside(tgt, rng)) is not None and rng.random() < 0.5:
            out.append((src, text, lang, want, 3))
        harmless = int(rng.integers(6))
        remark = REMARKS[codes[want]][int(rng.integers(3))]
        if harmless == 0:
            out.append((src, tgt.rstrip().rstrip("."), lang, want, HARMLESS))
        elif harmless == 1 and (text := _drop_sentence(tgt, rng, True)):
            out.append((src, text, lang, want, HARMLESS))
        elif harmless == 2 and (text := _drop_sentence(tgt, rng, False)):
            out.append((src, text, lang, want, HARMLESS))
        elif harmless == 3:
            out.append((src, f"{tgt.rstrip()} {remark}", lang, want, HARMLESS))
        elif harmless == 4 and (text := _drop_sentence(tgt, rng, True)):
            out.append((src, f"{text} {remark}", lang, want, HARMLESS))
        elif harmless == 5 and (text := response(others)):
            # partly in another language
            strange = re.split(r"(?<=[.!?])\s+", text)[0]
            out.append((src, f"{strange} {tgt}" if rng.random() < 0.5 else f"{tgt.rstrip()} {strange}", lang, want, HARMLESS))
        kind = int(rng.integers(5))
        if kind in (0, 4):
            out.append((src, _copied(src, tgt, rng), lang, want, 1))
        if kind in (1, 4):
            texts = REFUSALS[codes[(want, own, int(rng.integers(6)))[int(rng.integers(3))]]]
            text = texts[int(rng.integers(len(texts)))]
            how = int(rng.integers(4))
            text = f"{text}\n\n{src}" if how == 0 else f"<TEXT>{text}</TEXT>" if how == 1 else text
            out.append((src, text, lang, want, 0))
        elif kind == 2:
            out.append((src, tgt, lang, others[int(rng.integers(len(others)))], 2))
        elif kind == 3 and (text := response(others)):
            # swapped for the response of another pair
            out.append((src, text, lang, want, 2))
    return out


def _judged(examples: list[tuple], fitted: Fitted) -> Iterator[tuple[slice, Features]]:
    columns = [list(c) for c in zip(*(e[:4] for e in examples))]
    for begin, end in pair_blocks(columns[0], columns[1]):
        yield slice(begin, end), features(*(c[begin:end] for c in columns), fitted)


def fit(sample: list[tuple[str | None, str | None, str | None, int]], language: LanguageModel, words: Fit, seed: int = 11) -> Fitted:
    """The classifier from (source, target, source language, directory's language) rows and the words of all pairs."""
    rng = np.random.default_rng(seed)
    rows = [row for row in sample if row[0] and row[3] >= 0 and not is_empty(row[1])]
    fitted = Fitted(language, words.lexicon, words.vocabulary, words.never_last)
    at = {name: i for i, name in enumerate(NAMES)}
    good = []
    for part, seen in _judged(rows, fitted) if rows else ():
        value = lambda name: seen.dense[:, at[name]]  # noqa: B023, E731
        fine = (value("covered") > 0.7) & ((value("in_target_language") > 0.9) | (value("tiny") > 0)) & (value("last_left_out") < 0.3) & (value("repeated") < 0.6)
        good += [row for row, ok in zip(rows[part], fine.tolist()) if ok]
    examples = spoilt(good, rng)
    if not examples:
        return fitted
    rows_x: list[tuple[np.ndarray, np.ndarray]] = []
    parts = []
    for _, seen in _judged(examples, fitted):
        parts.append(seen)
        rows_x += seen.rows()
    labels = np.zeros((len(examples), len(LABELS)))
    for i, e in enumerate(examples):
        if e[4] >= 0:
            labels[i, e[4]] = 1
    held = rng.random(len(examples)) < 0.25
    train, test = np.flatnonzero(~held), np.flatnonzero(held)
    fitted.weights = _fit_linear([rows_x[i] for i in train], labels[train])
    scores = np.concatenate([seen.scores(fitted.weights) for seen in parts])[test]
    kind = np.array([e[4] for e in examples])[test]
    fitted.thresholds = np.zeros(len(LABELS))
    for k in range(len(LABELS)):
        y = labels[test, k] > 0
        # sound pairs are far more frequent in a table than among the examples; those that were changed without harm, and
        # those with another defect, are expected as often as the defect each
        weight = np.ones(len(test))
        for group, share in ((kind == -1, 1 - 3 * SHARE), (kind == HARMLESS, SHARE), ((kind >= 0) & ~y, SHARE)):
            weight[group] = y.sum() * share / SHARE / max(1, group.sum())
        grid = np.linspace(-4, 6, 101)
        said = scores[:, k] > grid[:, None]
        f1 = 2 * ((said & y) * weight).sum(1) / np.maximum(1.0, (said * weight).sum(1) + y.sum())
        # the middle of the best thresholds
        fitted.thresholds[k] = float(np.median(grid[f1 >= f1.max() - 1e-9]))
    return fitted


def judged(src_texts, tgt_texts, src_langs, majority, fitted: Fitted) -> tuple[list[str | None], Features]:
    """The defect of each pair, or none, and what was seen of it."""
    seen = features(src_texts, tgt_texts, src_langs, majority, fitted)
    out: list[str | None] = [None] * len(src_texts)
    if fitted.weights is not None:
        said = seen.scores(fitted.weights) > fitted.thresholds
        for k in np.flatnonzero(said.any(1)).tolist():
            out[k] = LABELS[int(said[k].argmax())]
    # a text with a word and without a tag is not empty
    worded = np.bincount(seen.target.text, minlength=len(src_texts)).tolist()
    return ["empty" if (not n or "<" in t) and is_empty(t) else label for t, n, label in zip(tgt_texts, worded, out)], seen


def judge(src_texts, tgt_texts, src_langs, majority, fitted: Fitted) -> list[str | None]:
    return judged(src_texts, tgt_texts, src_langs, majority, fitted)[0]


# -- on tables --------------------------------------------------------------------------------------------------------


def target_languages(pairs: DataFrame, model: LanguageModel) -> dict[int, int]:
    """Number of the language in which most targets of each directory are, over all pairs (a row a directory)."""
    sent = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, votes = scorer_of(sent.value), {}
        for batch in batches:
            dirs = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1).to_pylist()):
                n = len(block.texts)
                seg = Segments(block)  # markup is the same in every language
                sums, n_grams, n_words = scorer.sentences(seg)
                odds = scorer.model.log_odds(grouped(sums, seg.text, n), grouped(n_grams, seg.text, n))
                has = grouped(n_words, seg.text, n) > 0
                keys, counts = np.unique(dirs[block.first : block.first + n][has] * len(LANGUAGES) + odds[has].argmax(1), return_counts=True)
                for key, count in zip(keys.tolist(), counts.tolist()):
                    votes[key] = votes.get(key, 0) + count
        if votes:
            yield pa.RecordBatch.from_arrays([pa.array(list(votes), pa.int64()), pa.array(list(votes.values()), pa.int64())], ["key", "n"])

    source = pairs.where("lang_dir_id is not null and tgt_text is not null").select(F.col("lang_dir_id").cast("bigint"), "tgt_text")
    votes = source.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    found: dict[int, tuple[int, int]] = {}
    for row in votes.collect():  # a row a directory and language
        directory, language = divmod(row["key"], len(LANGUAGES))
        found[directory] = max(found.get(directory, (0, -1)), (row["n"], language))
    return {directory: language for directory, (_, language) in found.items()}


def fit_tables(pairs: DataFrame, model: LanguageModel, words: Fit, languages: dict[int, int], train_pairs: int = TRAIN_PAIRS) -> Fitted:
    sample = bounded_sample(pairs.select("pair_id", "lang_dir_id", "src_lang", "src_text", "tgt_text"), "pair_id", train_pairs)
    return fit([(r["src_text"], r["tgt_text"], r["src_lang"], languages.get(r["lang_dir_id"], -1)) for r in sample.collect()], model, words)


JUDGED = "pair_id bigint, defect string, seg_no int, lang string, confidence double"


def judge_pairs(pairs: DataFrame, fitted: Fitted, languages: dict[int, int], with_sentences: bool = False) -> DataFrame:
    """pair_id and defect of every defective pair (seg_no 0, lang that of the target if it has one).

    with_sentences: besides, of the other pairs, the sentences (seg_no) that are in a language other than most of the
    target, so that both come from one reading. Nothing is shuffled. What is broadcast is bounded by the samples, the word
    table and the number of directories."""
    sent = pairs.sparkSession.sparkContext.broadcast((fitted, languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, languages = sent.value
        names = [part.split()[0] for part in JUDGED.split(", ")]
        codes = np.array([*LANGUAGES, None], object)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            majority = [languages.get(x, -1) for x in batch.column(1).to_pylist()]
            texts = [batch.column(k).to_pylist() for k in (2, 3, 4)]
            for begin, end in pair_blocks(texts[0], texts[1]):
                found, seen = judged(*(c[begin:end] for c in texts), majority[begin:end], fitted)
                seg, model = seen.target.seg, fitted.language
                main, odds, _ = main_language(model, seg, *seen.spoken, True)
                bad = np.flatnonzero([label is not None for label in found])
                sure = confidences(odds[bad]).max(1) if len(bad) else np.zeros(0)
                parts = [(bad, np.array([found[k] for k in bad], object), np.zeros(len(bad), np.int32), codes[main[bad]], sure)]
                if with_sentences:
                    at, best, sure = foreign_segments(model, *seen.spoken, main[seg.text])
                    at_good = ~np.isin(seg.text[at], bad)
                    at, best, sure = at[at_good], best[at_good], sure[at_good]
                    parts.append((seg.text[at], np.full(len(at), None, object), seg.number[at].astype(np.int32), codes[best], sure))
                for rows, defect, number, lang, sure in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows + begin], pa.int64()), pa.array(defect, pa.string()), pa.array(number), pa.array(lang, pa.string()), pa.array(sure)], names)

    source = pairs.select(F.col("pair_id").cast("bigint").alias("pair_id"), F.col("lang_dir_id").cast("bigint").alias("dir"), "src_text", "tgt_text", "src_lang")
    return source.mapInArrow(run, JUDGED)


def find_defects(pairs: DataFrame, fitted: Fitted, languages: dict[int, int]) -> DataFrame:
    """pair_id, defect of every defective pair."""
    return judge_pairs(pairs, fitted, languages).select("pair_id", "defect")
