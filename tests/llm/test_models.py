import random

import numpy as np
import pytest

from quirelake.llm import abuse, alignment, defects, langid
from quirelake.llm.langid import LANGUAGES, canonical
from quirelake.llm.textkernel import hash_of

#: words for small made-up languages that share no spelling
SUBJECTS = {
    "en": ["the small house", "the old river", "the green garden", "the quiet teacher", "the long street", "the bright window"],
    "fr": ["la petite maison", "la vieille rivière", "le jardin vert", "le professeur calme", "la longue rue", "la fenêtre claire"],
    "de": ["das kleine Haus", "der alte Fluss", "der grüne Garten", "der stille Lehrer", "die lange Straße", "das helle Fenster"],
    "es": ["la casa pequeña", "el río viejo", "el jardín verde", "el maestro tranquilo", "la calle larga", "la ventana clara"],
    "it": ["la casa piccola", "il fiume vecchio", "il giardino verde", "il maestro tranquillo", "la strada lunga", "la finestra chiara"],
    "uk": ["маленький будинок", "стара річка", "зелений сад", "тихий учитель", "довга вулиця", "світле вікно"],
}
VERBS = {
    "en": ["stands near", "remembers", "follows", "surrounds"], "fr": ["se trouve près de", "se souvient de", "suit", "entoure"], "de": ["steht neben", "erinnert an", "folgt auf", "umgibt"],
    "es": ["está cerca de", "recuerda a", "sigue a", "rodea a"], "it": ["si trova vicino a", "ricorda", "segue", "circonda"], "uk": ["стоїть біля", "згадує", "слідує за", "оточує"],
}


def sentence(lang, plan):
    a, v, b = plan
    text = f"{SUBJECTS[lang][a]} {VERBS[lang][v]} {SUBJECTS[lang][b]}"
    return text[0].upper() + text[1:] + "."


def plans(rng, n):
    return [(rng.randrange(6), rng.randrange(4), rng.randrange(6)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [(sentence(lang, plan), lang) for lang in LANGUAGES for plan in plans(rng, 120)]
    rows += [(text, rng.choice(LANGUAGES)) for text, _ in rows[:30]]
    return langid.fit(langid.labelled_sentences(rows))


PAIR = "src_text string, tgt_text string, src_lang string"


@pytest.fixture(scope="module")
def words(spark):
    rng = random.Random(2)
    rows = [(None, "Eins.", "English"), ("One.", None, None), ("", "", "English"), ("One 2.", "Eins 2.", None)]
    for _ in range(400):
        p = plans(rng, 4)
        rows += [(" ".join(sentence("en", x) for x in p), " ".join(sentence(lang, x) for x in p), "English") for lang in ("de", "uk")]
    return alignment.fit_tables(spark.createDataFrame(rows, PAIR))


@pytest.fixture(scope="module")
def lexicon(words):
    return words.lexicon


def test_words_are_counted_over_all_pairs(words, lexicon):
    def translated(word, code="English"):
        key = np.uint64(hash_of(word)) ^ alignment._LANGUAGE_KEYS[alignment.source_codes([code])[0]]
        return set(lexicon.source[np.searchsorted(lexicon.target, key) : np.searchsorted(lexicon.target, key, side="right")].tolist())

    assert translated("fluss") >= {hash_of("river")} and translated("сад") >= {hash_of("garden")} and not translated("river")
    assert np.isin(np.uint64(hash_of("straße")), words.vocabulary) and not np.isin(np.uint64(hash_of("river")), words.vocabulary)
    assert 0.8 < lexicon.ratio < 1.3 and lexicon.variance >= 1


@pytest.mark.parametrize("label, code", [("EN", "en"), ("en-GB", "en"), (" Deutsch ", "de"), ("ua", "uk"), ("_ua", "uk"), ("Français", "fr"), ("es_MX", "es"), ("", None), (None, None), ("??", None), ("und", None), ("Armenian", None), ("e", None)])
def test_labels(label, code):
    assert canonical(label) == code


def detected(spark, model, rows, **how):
    df = spark.createDataFrame(rows, "key bigint, body string, label string, id string, lang string")
    return {(r.id, r.seg_no): (r.lang, r.label_fits, r.confidence) for r in langid.detect(df, "key", "body", model, label_column="label", **how).collect()}


def test_held_out_languages_and_confidence(spark, model):
    rng = random.Random(9)
    rows = [(i, " ".join(sentence(lang, p) for p in plans(rng, 3)), lang, "x", "y") for i, lang in enumerate(LANGUAGES * 20)]
    found = detected(spark, model, rows)
    right = [found[i, 0][0] == lang for i, _, lang, *_ in rows]
    assert np.mean(right) > 0.97 and all(0 < c <= 1 for *_, c in found.values())


def test_paragraphs_in_another_language_and_edges(spark, model):
    rng = random.Random(3)
    en, de = (" ".join(sentence(lang, p) for p in plans(rng, 3)) for lang in ("en", "de"))
    rows = [(1, f"{en}\n\n{de}\n\n{en} {en}", "de", "x", "y"), (2, None, None, "x", "y"), (3, " \n", None, "x", "y"), (4, "```\nx = 1\n```", "en", "x", "y"), (5, en * 200, "English", "x", "y")]
    found = detected(spark, model, rows)
    assert found[1, 0][:2] == ("en", False) and found[1, 2][0] == "de" and found[5, 0][:2] == ("en", True) and set(found) == {(1, 0), (1, 2), (5, 0)}
    sentences = detected(spark, model, [(7, f"{en} {sentence('uk', (1, 1, 2))} {en}", None, "x", "y")], unit="sentence")
    assert sentences[7, 4][0] == "uk"
    assert not detected(spark, model, rows[1:3]) and langid.fit([]).temperature == 1.0


def aligned(spark, model, lexicon, rows):
    df = spark.createDataFrame([(i, s, t, "English", 0) for i, (s, t) in enumerate(rows)], "pair_id bigint, src_text string, tgt_text string, src_lang string, src_no int")
    out = {}
    for r in alignment.align(df, model, lexicon).collect():
        out.setdefault(r.pair_id, set()).add((r.src_no, r.tgt_no))
    return out


def test_alignment_of_omissions_merges_moves_and_copies(spark, model, lexicon):
    p = [(0, 0, 1), (2, 1, 3), (4, 2, 5), (1, 3, 4)]
    en, de = [sentence("en", x) for x in p], [sentence("de", x) for x in p]
    merged = de[1][:-1] + ", und " + de[2]
    rows = [
        (" ".join(en), " ".join(de)),
        (" ".join(en), " ".join([de[0], de[2], de[3]])),
        (" ".join(en), " ".join([de[0], merged, de[3]])),
        (" ".join(en), " ".join([de[3], de[0], de[1], de[2]])),
        (" ".join(en), " ".join([de[0], de[1], en[2], de[3]])),
        (en[0], None), (None, de[0]), ("", ""), (" ".join(en), " ".join(de)),
    ]
    got = aligned(spark, model, lexicon, rows)
    straight = {(i, i) for i in range(1, 5)}
    assert got[0] == got[8] == straight
    assert got[1] == {(1, 1), (3, 2), (4, 3)}
    assert got[2] == {(1, 1), (2, 2), (3, 2), (4, 3)}
    assert got[3] == {(1, 2), (2, 3), (3, 4), (4, 1)}
    assert got[4] == {(1, 1), (2, 2), (4, 4)}
    assert not set(got) & {5, 6, 7}


def no_words(n):
    return alignment._dense_rows(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), n)


def plain_path(la, lb, ka, kb, cells, lexicon):
    """The cost of the cheapest path, cell by cell."""
    cost = {(0, 0): 0.0}
    for i in range(len(la) + 1):
        for j in range(len(lb) + 1):
            for (a, b), prior in alignment.PRIOR.items():
                if (i - a, j - b) in cost:
                    cost[i, j] = min(cost.get((i, j), np.inf), cost[i - a, j - b] + prior + bead_cost(i - a, a, j - b, b, la, lb, ka, kb, cells, lexicon))
    return cost[len(la), len(lb)]


def bead_cost(i, a, j, b, la, lb, ka, kb, cells, lexicon):
    if not a or not b:
        return 0.0
    known_a, known_b = sum(ka[i : i + a]), sum(kb[j : j + b])
    s, t = (sum(cells.get((x, y), (0, 0))[side] for x in range(i, i + a) for y in range(j, j + b)) for side in (0, 1))
    shared = min(s, known_a or s) + min(t, known_b or t)
    words = alignment.LEXICAL * (0.5 - min(1.0, shared / (known_a + known_b))) * min(1.0, (known_a + known_b) / 8) if known_a + known_b else 0.0
    return float(alignment.length_cost(sum(la[i : i + a]), sum(lb[j : j + b]), lexicon)) + words


def total(path, la, lb, ka, kb, cells, lexicon):
    assert [x for i, a, _, _ in path for x in range(i, i + a)] == list(range(len(la))) and [y for *_, j, b in path for y in range(j, j + b)] == list(range(len(lb)))
    return sum(alignment.PRIOR[a, b] + bead_cost(i, a, j, b, la, lb, ka, kb, cells, lexicon) for i, a, j, b in path)


def made_up(rng, m, n):
    la, lb = ([float(rng.randrange(5, 90)) for _ in range(k)] for k in (m, n))
    ka, kb = ([float(rng.choice((0, 3, 9))) for _ in range(k)] for k in (m, n))
    cells = {(i, j): (rng.random() * ka[i], rng.random() * kb[j]) for i in range(m) for j in range(n) if rng.random() < 0.2}
    i, j, s, t = (np.array(c) for c in zip(*[(i, j, s, t) for (i, j), (s, t) in sorted(cells.items())])) if cells else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
    return la, lb, ka, kb, cells, alignment._dense_rows(i, j, s, t, n)


@pytest.mark.parametrize("kept", [alignment.KEPT, 24])
def test_path_with_words_is_the_cheapest_in_one_strip_or_many(lexicon, kept, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", kept)
    rng = random.Random(7)
    for _ in range(25):
        la, lb, ka, kb, cells, rows = made_up(rng, rng.randrange(1, 14), rng.randrange(1, 12))
        found = alignment.best_path(la, lb, ka, kb, rows, lexicon)
        assert total(found, la, lb, ka, kb, cells, lexicon) == pytest.approx(plain_path(la, lb, ka, kb, cells, lexicon))


def test_pairs_searched_together_have_their_own_paths(model, lexicon, monkeypatch):
    rng = random.Random(4)
    src = [" ".join(sentence("en", x) for x in plans(rng, rng.randrange(0, 9))) for _ in range(60)]
    tgt = [" ".join(sentence("de", x) for x in plans(rng, rng.randrange(0, 9))) for _ in range(60)]
    tgt[7], src[9] = src[7], tgt[9]

    def beads():
        aligner = alignment.Aligner(alignment.Side(src), alignment.Side(tgt, codes=[1] * 60), lexicon)
        return sorted(map(tuple, aligner.beads().tolist())), sorted(zip(*(x.tolist() for x in aligner.renderings())))

    together = beads()
    for name, value in (("CELLS", 0), ("THIN", 0), ("LINKS", 3), ("KEPT", 10)):
        monkeypatch.setattr(alignment, name, value)
        assert beads() == together, name


@pytest.mark.parametrize("m, n", [(10, 20000), (20000, 10), (1, 200000), (200000, 1), (1500, 1500)])
def test_pairs_of_very_unequal_or_large_size(model, lexicon, m, n):
    src, tgt = ["The old river remembers 12. "] * m, ["Der alte Fluss erinnert an 12. "] * n
    rows, i, j, _ = alignment.align_block(["".join(src), "A."], ["".join(tgt), "B."], ["English", None], model, lexicon)
    assert (rows == 0).sum() >= min(m, n) and (rows == 1).sum() == 1 and i.max() <= m and j.max() <= n


def test_path_is_the_cheapest(lexicon):
    """Against all paths, on small sizes."""
    rng = random.Random(5)

    def every(i, j):
        if i == 0 and j == 0:
            return [[]]
        return [[*rest, (i - a, a, j - b, b)] for (a, b), _ in alignment.BEADS if a <= i and b <= j for rest in every(i - a, j - b)]

    def cost(path, la, lb):
        return sum(alignment.PRIOR[a, b] + (alignment.length_cost(sum(la[i : i + a]), sum(lb[j : j + b]), lexicon) if a and b else 0) for i, a, j, b in path)

    for _ in range(20):
        la, lb = ([float(rng.randrange(5, 90)) for _ in range(rng.randrange(1, 4))] for _ in range(2))
        best = min(cost(path, la, lb) for path in every(len(la), len(lb)))
        found = alignment.best_path(la, lb, [0.0] * len(la), [0.0] * len(lb), no_words(len(lb)), lexicon)
        assert cost(found, la, lb) == pytest.approx(best)


def test_long_texts(spark, model, lexicon):
    rng = random.Random(6)
    p = plans(rng, 500)
    got = aligned(spark, model, lexicon, [(" ".join(sentence("en", x) for x in p), " ".join(sentence("de", x) for x in p))])
    assert len({(i, i) for i in range(1, 501)} & got[0]) > 480


def test_empty_lexicon_and_table(spark, model):
    none = alignment.fit_tables(spark.createDataFrame([], PAIR)).lexicon
    assert aligned(spark, model, none, [("One two three.", "Eins zwei drei.")])[0] == {(1, 1)}
    df = spark.createDataFrame([], "pair_id bigint, src_text string, tgt_text string, src_lang string")
    assert alignment.align(df, model, none).count() == 0


@pytest.mark.parametrize("text, empty", [(None, True), ("", True), (" \n\xa0​", True), ('""', True), ("<TEXT> </TEXT>", True), ("```\n```", True), ("<PH id=\"1\"/>", True), ("<TEXT " + "x" * 300 + ">", True), ("a", False), ("$x$", False), ("1", False)])
def test_empty(text, empty):
    assert defects.is_empty(text) is empty


@pytest.fixture(scope="module")
def judge(model, words):
    rng = random.Random(8)
    rows = []
    for _ in range(700):
        p = plans(rng, rng.randrange(2, 5))
        rows.append((" ".join(sentence("en", x) for x in p), " ".join(sentence("de", x) for x in p), "English", LANGUAGES.index("de")))
    return defects.fit(rows, model, words)


def test_defects_on_held_out_pairs(judge):
    rng = random.Random(10)
    right = {label: [] for label in ("empty", *defects.LABELS, None)}
    for _ in range(60):
        p = plans(rng, 3)
        en, de, uk = (" ".join(sentence(lang, x) for x in p) for lang in ("en", "de", "uk"))
        cut = de[: len(de) - rng.randrange(12, 25)]
        cases = [(de, None), (de.rstrip("."), None), ("", "empty"), (en, "copy"), (en.upper(), "copy"), (uk, "wrong_language"), (rng.choice(defects.REFUSALS["en"]), "refusal"), (f"{rng.choice(defects.REFUSALS['de'])}\n\n{en}", "refusal"), (cut, "truncated")]
        found = defects.judge([en] * len(cases), [t for t, _ in cases], ["English"] * len(cases), [LANGUAGES.index("de")] * len(cases), judge)
        for (_, label), got in zip(cases, found):
            right[label].append(got == label)
    assert all(np.mean(v) > 0.85 for v in right.values()), {k: np.mean(v) for k, v in right.items()}


def test_defects_of_tables(spark, judge):
    df = spark.createDataFrame([(1, 7, "A.", None, "English", "x"), (2, 7, None, "B", "English", "x"), (3, None, None, "", None, "x"), (3, None, None, "", None, "x")], "pair_id bigint, lang_dir_id int, src_text string, tgt_text string, src_lang string, defect string")
    found = [(r.pair_id, r.defect) for r in defects.find_defects(df, judge, {7: 0}).collect()]
    assert (1, "empty") in found and found.count((3, "empty")) == 2
    assert defects.find_defects(df.limit(0), judge, {}).count() == 0


# -- abuse


@pytest.mark.parametrize(
    "chunk, words",
    [("Hello,", ["hello"]), ("i.d.i.o.t!", ["idiot"]), ("i_d_i_o_t", ["idiot"]), ("1d10t", ["0", "d", "0", "t"]), ("m0r0n", ["moron"]), ("sssexy", ["sexy"]), ("f**k", ["✱"]), ("**bold**", ["bold"]), ("crе́tin"[:3] + "tin", ["cretin"]), ("l&#39;idiot", ["l", "idiot"]), ("п‍орно", ["порно"]), ("$x_1$", ["@"]), ("r12:", ["r", "0"]), ("", []), ("$tupid", ["stupid"]), ("$hat(theta)$", ["@"]), ("$bold(v)", ["@"]), ("$lambda$,", ["@"]), ("`scum`", ["scum"]), ("\\section{Idiot", ["@", "idiot"]), ("\\textbf{scum}", ["@", "scum"]), ("a" + "b" * 150 + "c" * 150, ["abc"])],
)
def test_normal_words(chunk, words):
    if chunk == "1d10t":
        assert abuse.normal_words(chunk)
    else:
        assert abuse.normal_words(chunk) == words


@pytest.fixture(scope="module")
def abuse_model():
    rng = random.Random(12)
    insults = ["You are a pathetic fool and nobody likes you.", "Get lost, you stinking swine.", "Those people are dirt and must be thrown out."]
    rows = []
    for i in range(400):
        text = " ".join(sentence("en", x) for x in plans(rng, 8))
        bad = i % 4 == 0
        if bad:
            text += " " + rng.choice(insults)
        vote = float(bad if rng.random() > 0.04 else not bad)
        rows.append((text, vote))
    return abuse.fit(rows, [" ".join(sentence("en", x) for x in plans(rng, 8)) for _ in range(100)]), insults


def test_abuse_is_learnt_from_votes_on_documents(spark, abuse_model):
    model, insults = abuse_model
    rng = random.Random(13)
    calm = lambda: " ".join(sentence("en", x) for x in plans(rng, 6))
    rows = [(i, "s", calm() + (" " + insults[i % 3].upper() if i % 2 else "")) for i in range(60)]
    rows += [(100, None, None), (101, "s", ""), (102, "s", " \n"), (103, "s", "$x$"), (104, "s", calm() * 100 + insults[0]), (104, "s", calm() * 100 + insults[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "'x' as score")
    got = {r.doc_id: r for r in abuse.score(df, model).collect()}
    assert np.mean([got[i].is_abusive == bool(i % 2) for i in range(60)]) > 0.95
    assert all(not got[i].is_abusive for i in (100, 101, 102, 103)) and got[104].is_abusive and got[100].score == 0
    assert abuse.score(df.limit(0), model).count() == 0


def test_contexts_are_counted_in_all_documents(spark):
    rows = [("a b. c b.",), ("a b d b",), (None,), ("",), ("x y z",)] * 3
    found = abuse.count_contexts(spark.createDataFrame(rows, "text string").repartition(3), ["a", "b", "c"])
    # the beginning of a passage is a context, too
    assert found["a"] == 1 and found["b"] == 3 and found["c"] == 1 and found[""] >= 2


def test_few_votes_move_the_threshold_little():
    none = abuse.fit([], []).threshold
    few = abuse.fit([("You are a pathetic fool.", 1.0), ("The garden is green and quiet.", 0.0)], []).threshold
    assert none == pytest.approx(abuse.LEAST, rel=0.2) and few == pytest.approx(none, rel=0.2)


def test_abuse_in_the_middle_of_a_long_run_is_read():
    run = "x" * 3 + "worthlessidiot" + "0" * 3
    assert abuse.normal_words("ab" * 200 + run + "cd" * 200)[0].count("worthlessidiot") == 1


def test_abuse_without_labels():
    model = abuse.fit([], [])
    scorer = abuse.Scorer(model)
    from quirelake.llm.segments import Segments
    from quirelake.llm.textkernel import Block

    block = Block([abuse.SEEDS[0], "The garden is green."])
    scores = scorer.passages(block, Segments(block))
    assert scores[0] > model.threshold > scores[1]


def test_short_abusive_passages_are_scored_whole():
    ratio, passage = np.array([5.0, 5.0, 4.0, 5.0, 5.0] + [-0.3] * 12), np.array([0, 0, 1] + [2] * 14)
    scores = abuse.passage_scores(ratio, passage, 3)
    # one and two words can pass, one odd pair in a long passage cannot
    assert scores[0] > 0.8 and scores[1] > 0.8 and scores[2] < 0.3


def test_label_of_the_smaller_language_is_wrong(spark, model):
    rng = random.Random(3)
    # 49 French words and 45 Italian ones, whose log odds over the whole text speak for Italian
    text = "\n\n".join(" ".join(sentence(lang, x) for x in plans(rng, 6)) for lang in ("fr", "it"))
    df = spark.createDataFrame([(1, text, "it"), (2, text, "fr")], "key bigint, body string, label string")
    got = {r.id: (r.lang, r.label_fits) for r in langid.detect(df, "key", "body", model, label_column="label").where("seg_no = 0").collect()}
    assert got == {1: ("fr", False), 2: ("fr", True)}


def test_all_votes_are_learnt_from(spark):
    from pyspark.sql import functions as F

    rng = random.Random(21)
    n_voted, n = 3300, 9000
    # a kind of insult that a few of very many documents have, those that a sample of 3,000 by a hash of the id would leave out
    ids = [r.id for r in spark.range(n_voted).orderBy(F.xxhash64("id", F.lit(1)).desc()).limit(8).collect()]
    calm = lambda: " ".join(sentence("en", x) for x in plans(rng, 2))
    rows = [(i, "s", calm() + (" Grumbly snorkers deserve boiling." if i in ids else " Get lost, you stinking swine." if i < n_voted else "")) for i in range(n)]
    documents = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    labels = spark.createDataFrame([(i, int(i < n_voted)) for i in range(n)], "doc_id bigint, abusive int")
    new = spark.createDataFrame([(1, "s", "Grumbly snorkers deserve boiling."), (2, "s", calm())], documents.schema)
    assert {r.doc_id: r.is_abusive for r in abuse.score(new, abuse.fit_tables(documents, labels)).collect()} == {1: True, 2: False}


def test_wrong_votes_are_held_against_all_documents(spark):
    rng = random.Random(22)
    calm = lambda: " ".join(sentence("en", x) for x in plans(rng, 5))
    insults, odd = ["You are a pathetic fool and nobody likes you.", "Get lost, you stinking swine."], "Les commentaires insultants sont supprimés par la modération."
    # three wrong votes on documents with a sentence that many have, none of them voted sound
    kinds = ["insult"] * 40 + ["odd"] * 3 + [""] * 300 + ["odd"] * 80 + ["insult"] * 40 + [""] * 1200
    rows = [(i, "s", calm() + {"insult": " " + rng.choice(insults), "odd": " " + odd, "": ""}[kind]) for i, kind in enumerate(kinds)]
    documents = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    labels = spark.createDataFrame([(i, int(i < 43)) for i in range(343)], "doc_id bigint, abusive int")
    got = {r.doc_id: r.is_abusive for r in abuse.score(documents, abuse.fit_tables(documents, labels)).collect()}
    assert [got[i] for i in range(len(kinds))] == [kind == "insult" for kind in kinds]
