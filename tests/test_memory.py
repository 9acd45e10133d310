from pyspark.sql import functions as F

from quirelake.operators import memory

LANGS = ("english", "french")
WIDE = [("p", 1, 1, "e1", "f1"), ("p", 2, 2, "e1", "f2"), ("p", 3, 3, "e2", ""), ("", 4, 4, "e3", "f3"), ("q", 5, 5, "e1", "f5")]


def wide(spark):
    return spark.createDataFrame(WIDE, "path_hash string, row_id bigint, ord bigint, english string, french string")


def store(spark, *keys):
    return spark.createDataFrame([(lang, path, c, f"text of {c}") for lang, path, c in keys], "lang string, path_hash string, checksum string, text string")


def cells(df):
    return {(r.row_id, r.lang, r.checksum) for r in df.collect()}


def test_shape(spark):
    long = memory.wide_to_long(wide(spark), LANGS)
    assert long.count() == 9
    assert {tuple(r) for r in memory.long_to_wide(long, LANGS).collect()} == {tuple(r) for r in WIDE}
    assert memory.add_language(wide(spark), "german").first()["german"] == "" and memory.add_language(wide(spark), "french").columns == wide(spark).columns
    assert "french" not in memory.drop_language(wide(spark), "french").columns


def test_lookup_last_wins_and_first_match(spark):
    index = memory.index(memory.wide_to_long(wide(spark), LANGS))
    requests = spark.createDataFrame([("p", "english", "french", "e1"), ("q", "english", "french", "e1"), ("p", "english", "french", "e2"), ("", "english", "french", "e3"), ("p", "french", "english", "f1")], "path_hash string, src_lang string, tgt_lang string, src_checksum string")
    found = memory.lookup(requests, index, store(spark, ("french", "p", "f2"), ("english", "p", "e1")))
    got = {(r.path_hash, r.src_checksum): r.tgt_text for r in found.collect()}
    # q: its text is not in the store; '': not in the index
    assert got == {("p", "e1"): "text of f2", ("q", "e1"): None, ("p", "e2"): None, ("", "e3"): None, ("p", "f1"): "text of e1"}
    asked = spark.createDataFrame([("p", "e1"), ("p", "e1"), ("p", "e2"), ("p", "e3"), ("z", "e1"), ("p", "none")], "path_hash string, src_checksum string")
    first = {(r.path_hash, r.src_checksum): r.tgt_checksum for r in memory.first_match(wide(spark), "english", "french", asked).collect()}
    # the row without a path answers for p, too
    assert first == {("p", "e1"): "f1", ("p", "e2"): None, ("p", "e3"): "f3"}


def test_upsert_is_idempotent(spark):
    schema = "path_hash string, src_lang string, src_checksum string, tgt_lang string, tgt_checksum string, ord int"
    known = spark.createDataFrame([("p", "en", "e1", "fr", "f1", 9)], schema)
    new = spark.createDataFrame([("p", "en", "e1", "fr", "f2", 1), ("p", "en", "e2", "fr", "f3", 1), ("p", "en", "e2", "en", "x", 1)], schema)
    once = memory.upsert(known, new)
    expected = {("e1", "f2"), ("e2", "f3")}
    assert {(r.src_checksum, r.tgt_checksum) for r in once.collect()} == expected
    assert {(r.src_checksum, r.tgt_checksum) for r in memory.upsert(once.withColumn("ord", F.lit(0)), new).collect()} == expected


def test_upsert_takes_over_pairs_without_a_path(spark):
    schema = "path_hash string, src_lang string, src_checksum string, tgt_lang string, tgt_checksum string, ord int"
    known = spark.createDataFrame([("", "en", "e1", "fr", "old", 1), ("", "en", "e1", "de", "d1", 1), ("", "en", "e9", "fr", "f9", 1), ("q", "en", "e9", "fr", "q9", 1)], schema)
    new = spark.createDataFrame([("p", "en", "e1", "fr", "f1", 5), ("r", "en", "e1", "fr", "r1", 6), ("q", "en", "e9", "fr", "n9", 5)], schema)
    got = {(r.path_hash, r.src_checksum, r.tgt_lang): r.tgt_checksum for r in memory.upsert(known, new).collect()}
    assert got == {("p", "e1", "fr"): "f1", ("p", "e1", "de"): "d1", ("r", "e1", "fr"): "r1", ("", "e9", "fr"): "f9", ("q", "e9", "fr"): "n9"}


def test_store_is_written_once(spark):
    old = store(spark, ("fr", "p", "c"))
    new = spark.createDataFrame([("fr", "p", "c", "other"), ("fr", "p", "d", "x"), ("fr", "p", "d", "x")], "lang string, path_hash string, checksum string, text string")
    assert {(r.checksum, r.text) for r in memory.put_texts(old, new).collect()} == {("c", "text of c"), ("d", "x")}


def test_clear_missing_and_orphans(spark):
    long = memory.wide_to_long(wide(spark), LANGS)
    have = store(spark, ("english", "p", "e1"), ("french", "p", "f2"), ("english", "p", "e2"), ("french", "q", "f5"))
    kept, counts = memory.clear_missing(long, have, F.lit("english"))
    assert cells(kept) == {(2, "english", "e1"), (2, "french", "f2")}
    assert tuple(counts.first()) == (4, 0)
    assert {(r.lang, r.checksum) for r in memory.orphans(have, kept).collect()} == {("english", "e2"), ("french", "f5")}


def test_clear_checksum(spark):
    long = memory.wide_to_long(wide(spark), LANGS)
    have = store(spark, ("english", "p", "e1"), ("french", "p", "f2"), ("french", "q", "f5"))
    kept, left = memory.clear_checksum(long, have, "e1", F.lit("english"))
    assert {r for r, *_ in cells(kept)} == {3, 4} and left.count() == 0
    kept, left = memory.clear_checksum(long, have, "e1", F.lit("english"), "french")
    # only the target goes: a row that still has its source stays
    assert {r for r, *_ in cells(kept)} == {1, 2, 3, 4, 5} and (1, "french", "f1") not in cells(kept) and {r.checksum for r in left.collect()} == {"e1"}
    assert tuple(memory.change_counts(long, kept, have, left).first()) == (0, 3, 2)
    whole, none = memory.clear_checksum(long, have, "e1", F.lit("english"))
    assert tuple(memory.change_counts(long, whole, have, none).first()) == (3, 0, 3)
    kept, _ = memory.clear_checksum(long, have, "f2", F.lit("english"))
    assert (2, "french", "f2") not in cells(kept) and (2, "english", "e1") in cells(kept)


def test_clear_all(spark):
    long = memory.wide_to_long(wide(spark), LANGS)
    have = store(spark, ("english", "p", "e1"), ("french", "p", "f2"))
    assert all(lang != "french" for _, lang, _ in cells(memory.clear_all(long, have, lang="french")[0]))
    assert {r for r, *_ in cells(memory.clear_all(long, have, path_hash="p")[0])} == {4, 5}
    kept, left = memory.clear_all(long, have, keyword="of f2")
    assert cells(long) - cells(kept) == {(2, "french", "f2")} and left.count() == 1


def test_rebuild_and_session(spark):
    sources = spark.createDataFrame([("p", "c", "first", 1), ("p", "c", "second", 2)], "path_hash string, src_checksum string, src_text string, ord int")
    targets = spark.createDataFrame([(1, "p", "c"), (2, "p", "d")], "pair_id int, path_hash string, src_checksum string")
    assert [tuple(r) for r in memory.rebuild_pairs(sources, targets).select("pair_id", "src_text").collect()] == [(1, "first")]
    assert [r.pair_id for r in memory.unmatched_targets(sources, targets).collect()] == [2]
    asked = spark.createDataFrame([(1, "p", 1, "c", "fr"), (2, "p", 2, "c", "fr"), (3, "q", 1, "c", "fr")], "chunk_id int, path_hash string, chunk_index int, src_checksum string, tgt_lang string")
    assert {r.chunk_id: r.is_first for r in memory.mark_session(asked).collect()} == {1: True, 2: False, 3: True}
