import random
import time

import pytest
from pyspark.sql import functions as F

from quirelake.operators import similarity, translate
from quirelake.operators.translate import Caller, Fatal, Transient, echo
from quirelake.streaming import incremental


def requests(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id bigint, path_hash string, chunk_index int, content string, chunk_type string")
    return df.withColumns({"src_lang": F.lit("English"), "tgt_lang": F.lit("French"), "src_checksum": F.sha2("content", 256)})


def empty(spark):
    return (
        spark.createDataFrame([], "path_hash string, src_lang string, tgt_lang string, src_checksum string, tgt_checksum string"),
        spark.createDataFrame([], "lang string, path_hash string, checksum string, text string"),
    )


ROWS = [(1, "p", 1, "Hello $x$.", "latex"), (2, "p", 2, "Hello $x$.", "latex"), (3, "p", 3, " \n", "latex"), (4, "p", 4, "$x$", "latex"), (5, "q", 1, "Hello $x$.", "latex"), (6, "q", 2, "x = 1", "code")]


def test_outcomes_and_stats(spark):
    got = translate.translate(requests(spark, ROWS), *empty(spark), Caller(echo))
    rows = {r.chunk_id: (r.outcome, r.text) for r in got.collect()}
    assert rows[1] == ("translated", "[French] Hello $x$.") and rows[2] == ("repeated", "[French] Hello $x$.") and rows[3][0] == "blank"
    assert rows[4] == ("ph_only", "$x$") and rows[5][0] == "translated" and rows[6][0] == "ph_only"
    assert tuple(translate.stats(got, "tgt_lang").first()) == ("French", 1, 2, 0, 0, 3)
    assert translate.new_pairs(got).count() == 4
    assert translate.provenance(got, "s", "m").where("chunk_id = 1").first()["metadata"]["needs_review"] == "True"
    translate.check_fatal(got)


def test_a_chunk_is_parsed_once_for_all_its_languages(monkeypatch):
    parsed = []
    known = translate.segments_of
    monkeypatch.setattr(translate, "segments_of", lambda *args: parsed.append(args[1]) or known(*args))
    caller = Caller(echo)
    got = [caller.translate(chunk, kind, "English", lang)[1] for chunk, kind in (("A $x$.", "latex"), ("B $y$.", "latex"), ("B $y$.", "other")) for lang in ("French", "German")]
    assert got == [f"[{lang}] {chunk}" for chunk in ("A $x$.", "B $y$.", "B $y$.") for lang in ("French", "German")] and parsed == ["A $x$.", "B $y$.", "B $y$."]


def test_second_run_hits(spark):
    made = translate.new_pairs(translate.translate(requests(spark, ROWS), *empty(spark), Caller(echo)))
    store = made.select(F.col("tgt_lang").alias("lang"), "path_hash", F.col("tgt_checksum").alias("checksum"), "text")
    again = translate.translate(requests(spark, ROWS), made.drop("text"), store, Caller(echo))
    assert {r.outcome for r in again.where("chunk_id <> 3").collect()} == {"hit"}


def test_failures_are_rows_and_fatal_ones_abort(spark):
    def broken(request):
        raise ValueError("bad chunk") if "Hello" in request.tagged else Fatal("no key")

    got = translate.translate(requests(spark, [*ROWS, (7, "q", 3, "Other.", "latex")]), *empty(spark), Caller(broken))
    rows = {r.chunk_id: r for r in got.collect()}
    assert rows[1].outcome == "failed" and rows[1].text == "Hello $x$." and rows[1].error_type == "ValueError" and not rows[1].fatal and rows[7].fatal
    with pytest.raises(translate.RunAborted):
        translate.check_fatal(got)


def test_retries():
    calls, waits = [], []

    def flaky(request):
        calls.append(request)
        if len(calls) < 4:
            raise Transient("busy")
        return echo(request)

    assert Caller(flaky, sleep=waits.append).translate("Hi.", "latex", "a", "b")[1] == "[b] Hi." and waits == [1.0, 2.0, 4.0]
    with pytest.raises(Transient):
        Caller(lambda r: (_ for _ in ()).throw(Transient("x")), sleep=waits.append).translate("Hi.", "latex", "a", "b")
    assert waits[3:] == [1.0, 2.0, 4.0, 8.0]


def test_broken_replies_go_to_the_reasoning_model():
    seen = []

    def bad(request):
        seen.append("main")
        return "<output><document><TEXT>lost</TEXT></document></output>"

    def good(request):
        seen.append("reasoning")
        return echo(request)

    outcome, text, asked = Caller(bad, good).translate("Hi $x$.", "latex", "a", "b")
    assert (outcome, text, asked, seen) == ("translated", "[b] Hi $x$.", True, ["main", "main", "reasoning"])
    with pytest.raises(translate.PlaceholderError):
        Caller(bad).translate("Hi $x$.", "latex", "a", "b")


def test_oversized_typst_is_translated_in_parts():
    text = "word. " * 700
    outcome, made, _ = Caller(echo).translate(text, "typst", "a", "b")
    assert outcome == "translated" and made.count("[b]") >= 2


def test_models_have_unique_names():
    translate.register_model("own", echo)
    with pytest.raises(ValueError):
        translate.register_model("own", echo)
    assert translate.model_named("own") is echo


def test_best_matches_against_brute_force(spark):
    import random

    rng = random.Random(1)
    texts = [" ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    candidates = [("g" if i % 3 else "h", f"c{i:02d}", t) for i, t in enumerate(texts)]
    queries = [(g, i, t, c) for i, (g, c, t) in enumerate(candidates) if i % 5 == 0] + [("none", 99, "alpha", None)]
    got = similarity.best_matches(
        spark.createDataFrame(queries, "grp string, query_id bigint, text string, own string"), spark.createDataFrame(candidates, "grp string, checksum string, text string"), 0.7, 7, 3
    )
    expected = {}
    for g, i, t, own in queries:
        scores = [(-similarity.ratio(x, t), c) for h, c, x in candidates if h == g and c != own]
        scores = [s for s in scores if -s[0] > 0.7]
        if scores:
            expected[i] = min(scores)[1]
    assert {r.query_id: r.checksum for r in got.collect()} == expected and expected


def test_best_matches_of_long_and_short_texts(spark):
    """difflib's own scores, with popular characters (queries of 200 and more) and without, and no threshold."""
    rng = random.Random(5)
    make = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    texts = [make(rng.choice((0, 1, 5, 60, 150, 199, 200, 260, 500)), rng.choice(("ab", "etaoin shrdlu", "etaoinETAOIN0123456789бвгд😀-", "aaaaaaaaaaaaaaaaaaaaab"))) for _ in range(160)]
    texts += ["aa" + t for t in texts[::4]] + [t[:90] + "x" + t[100:] for t in texts[::3]]
    candidates = [("g", f"{i:03d}", t) for i, t in enumerate(texts)]
    queries = [("g", i, t, f"{i:03d}") for i, t in enumerate(texts) if i % 2]
    got = similarity.best_matches(spark.createDataFrame(queries, "grp string, query_id bigint, text string, own string"), spark.createDataFrame(candidates, "grp string, checksum string, text string"))
    expected = {i: min((-similarity.ratio(t, x), c) for _, c, t in candidates if c != own) for _, i, x, own in queries}
    assert {r.query_id: (-r.score, r.checksum) for r in got.collect()} == {i: best for i, best in expected.items() if best[0] < 0 and texts[i]}


def test_best_matches_is_fast_enough(spark):
    """600 unlike texts against 60 of them: 36,000 pairs, a minute and more with difflib itself."""
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(600)]
    candidates = spark.createDataFrame([("g", f"{i:03d}", t) for i, t in enumerate(texts)], "grp string, checksum string, text string")
    queries = candidates.where("checksum < '060'").select("grp", F.col("checksum").alias("query_id"), "text", F.col("checksum").alias("own"))
    began = time.monotonic()
    assert similarity.best_matches(queries, candidates).count() == 60
    assert time.monotonic() - began < 15


def test_ratio_is_difflibs():
    assert (similarity.ratio("tide", "diet"), similarity.ratio("diet", "tide")) == (0.25, 0.5)


def test_streaming_uses_the_memory_of_earlier_batches(spark, tmp_path):
    schema = incremental.REQUEST
    first = [(1, "p", 1, "Hello.", "latex", "English", "French")]
    spark.createDataFrame(first, schema).write.parquet(str(tmp_path / "in/a"))
    calls = spark.sparkContext.accumulator(0)

    def counted(request):
        calls.add(1)
        return echo(request)

    def run():
        incremental.start(spark, str(tmp_path / "in/*"), str(tmp_path / "mem"), str(tmp_path / "cp"), Caller(counted)).awaitTermination(120)

    run()
    spark.createDataFrame([(2, "p", 2, "Hello.", "latex", "English", "French"), (3, "p", 3, "New.", "latex", "English", "French")], schema).write.parquet(str(tmp_path / "in/b"))
    run()
    rows = spark.read.parquet(str(tmp_path / "mem/results")).collect()
    assert {r.chunk_id: r.outcome for r in rows} == {1: "translated", 2: "hit", 3: "translated"} and calls.value == 2
