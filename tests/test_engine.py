import hashlib

import pytest

from quirelake.engine import Engine
from quirelake.functions.register import register
from quirelake.operators.translate import Caller, Fatal, RunAborted, echo

PAIR = "path_hash string, src_lang string, tgt_lang string, src_text string, tgt_text string"
REQUEST = "chunk_id bigint, path_hash string, chunk_index int, content string, chunk_type string, src_lang string, tgt_lang string"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "memory"))


def recorded(engine):
    return {(r.path_hash, r.src_checksum, r.tgt_lang): r.tgt_checksum for r in engine.pairs().collect()}


def test_persist_lookup_and_correct(spark, engine):
    assert engine.version() == 0 and engine.pairs().count() == 0
    rows = [("p", "en", "fr", "a", "A"), ("p", "en", "fr", "b", "B")]
    assert engine.persist(spark.createDataFrame(rows, PAIR)) == 1
    engine.persist(spark.createDataFrame([("p", "en", "fr", "a", "A2")], PAIR))
    before = recorded(engine)
    engine.persist(spark.createDataFrame([("p", "en", "fr", "a", "A2")], PAIR))
    assert recorded(engine) == before == {("p", sha("a"), "fr"): sha("A2"), ("p", sha("b"), "fr"): sha("B")}
    asked = spark.createDataFrame([("p", "en", "fr", sha("a")), ("q", "en", "fr", sha("a")), ("p", "fr", "en", sha("B"))], "path_hash string, src_lang string, tgt_lang string, src_checksum string")
    assert {(r.path_hash, r.src_lang): r.tgt_text for r in engine.lookup(asked).collect()} == {("p", "en"): "A2", ("q", "en"): None, ("p", "fr"): "b"}
    edited = spark.createDataFrame([("p", "en", "fr", sha("a"), "A2"), ("p", "en", "fr", sha("b"), "edited")], "path_hash string, src_lang string, tgt_lang string, src_checksum string, tgt_text string")
    assert [r.tgt_text for r in engine.correct(edited).collect()] == ["edited"]


def test_sync_and_clear(spark, engine):
    sources = spark.createDataFrame([("p", sha("a"), "a", "en", 1), ("p", sha("b"), "b", "en", 2)], "path_hash string, src_checksum string, src_text string, src_lang string, ord int")
    targets = spark.createDataFrame([("p", sha("a"), " A \n", "fr"), ("p", sha("z"), "Z", "fr"), ("p", sha("b"), "B word", "fr")], "path_hash string, src_checksum string, tgt_text string, tgt_lang string")
    engine.sync(sources, targets)
    assert recorded(engine) == {("p", sha("a"), "fr"): sha("A"), ("p", sha("b"), "fr"): sha("B word")}
    engine.clear(keyword="word")
    assert recorded(engine) == {("p", sha("a"), "fr"): sha("A")} and {r.text for r in engine.store().collect()} == {"a", "A"}
    engine.clear(path_hash="other")
    engine.clear_missing()
    assert len(recorded(engine)) == 1
    engine.clear(lang="fr")
    assert engine.pairs().count() == engine.store().count() == 0


def test_translate(spark, engine, tmp_path):
    asked = spark.createDataFrame([(1, "p", 1, "Hello.", "latex", "en", "fr"), (2, "p", 2, "Bye.", "latex", "en", "fr")], REQUEST)
    first = engine.translate(asked, Caller(echo), str(tmp_path / "r1"))
    second = engine.translate(asked, Caller(echo), str(tmp_path / "r2"))
    assert {r.outcome for r in first.collect()} == {"translated"} and {r.outcome for r in second.collect()} == {"hit"}

    def dead(request):
        raise Fatal("no key")

    with pytest.raises(RunAborted):
        engine.translate(spark.createDataFrame([(3, "p", 3, "New.", "latex", "en", "fr")], REQUEST), Caller(dead), str(tmp_path / "r3"))


def test_registered_functions(spark):
    register(spark)
    rows = spark.sql("select seg_index, kind, content from segments('latex', 'a $x$') order by 1").collect()
    assert [tuple(r) for r in rows] == [(1, "text", "a "), (2, "placeholder", "$x$")]
    one = spark.sql("select tagged_xml('latex', 'a $x$') as x, translated_part('<output>y</output>') as t, similarity('tide', 'diet') as s").first()
    assert one.x == '<document><TEXT>a <PH id="1">$x$</PH></TEXT></document>' and one.t == "y" and one.s == 0.25
    assert spark.sql("select count(*) as n from values ('latex', 'a'), ('other', cast(null as string)) as v(k, t), lateral chunks(v.k, v.t)").first()["n"] == 1
