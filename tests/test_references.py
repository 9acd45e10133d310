import datetime as dt

import pytest
from pyspark.sql import functions as F

from quirelake.operators.references import as_references, as_targets, by_month, dangling

T = lambda day, month=1: dt.datetime(2024, month, day)


def found(df):
    return {(r.record_id, r.kind) for r in df.collect()}


def test_kinds_and_tidy_keys(spark):
    refs = spark.createDataFrame(
        [(1, " AB\n", T(5)), (2, "zz", T(5)), (3, "ab", T(1)), (4, "ab", T(25)), (5, None, T(5)), (6, " \t", T(5)), (7, "ab", T(10)), (8, "zz", None), (9, "ab", None)],
        "id bigint, key string, at timestamp",
    )
    targets = spark.createDataFrame([("ab", T(2), T(10)), ("ab", T(2), T(10)), ("AB", T(12), T(20))], "key string, b timestamp, e timestamp")
    out = dangling(as_references(refs, "t", "id", ["key"], "at"), as_targets(targets, ["key"], "b", "e"))
    # 7: the end is exclusive; 8: a null time is a case only without any target
    assert found(out) == {(2, "missing"), (3, "late"), (4, "deleted"), (7, "deleted"), (8, "missing")}
    assert {(r.month, r.kind, r.n) for r in by_month(out).collect()} >= {("2024-01", "deleted", 2)}


@pytest.mark.parametrize("match, cases", [("simple", {(1, "missing")}), ("partial", {(1, "missing"), (3, "missing")}), ("full", {(1, "missing"), (2, "missing"), (3, "missing")})])
def test_match_semantics_of_composite_keys(spark, match, cases):
    refs = spark.createDataFrame([(1, "a", "x", T(5)), (2, "a", None, T(5)), (3, None, "q", T(5)), (4, None, None, T(5)), (5, "a", "b", T(5))], "id bigint, k string, l string, at timestamp")
    targets = spark.createDataFrame([("a", "b", T(1), None)], "k string, l string, b timestamp, e timestamp")
    out = dangling(as_references(refs, "t", "id", ["k", "l"], "at"), as_targets(targets, ["k", "l"], "b", "e"), 2, match)
    assert found(out) == cases


def test_against_brute_force_with_a_hot_key_and_overlapping_lives(spark):
    import random

    rng = random.Random(4)
    keys = ["hot"] * 10 + [f"k{i}" for i in range(5)]
    targets = [(rng.choice(keys), T(1) + dt.timedelta(hours=rng.randrange(900)), None if rng.random() < 0.1 else rng.randrange(1, 60)) for _ in range(60)]
    targets = [(k, b, None if n is None else b + dt.timedelta(hours=n)) for k, b, n in targets]
    refs = [(i, rng.choice([*keys, "none"]), T(1) + dt.timedelta(hours=rng.randrange(1000))) for i in range(400)]
    expected = set()
    for i, key, at in refs:
        own = [(b, e) for k, b, e in targets if k == key]
        if any(b <= at and (e is None or at < e) for b, e in own):
            continue
        expected.add((i, "missing" if not own else "late" if all(b > at for b, _ in own) else "deleted"))
    out = dangling(
        as_references(spark.createDataFrame(refs, "id bigint, key string, at timestamp"), "t", "id", ["key"], "at"),
        as_targets(spark.createDataFrame(targets, "key string, b timestamp, e timestamp"), ["key"], "b", "e"),
    )
    assert found(out) == expected


def test_empty_tables_and_clashing_columns(spark):
    refs = spark.createDataFrame([(1, "a", T(5), "x")], "id bigint, key string, at timestamp, alive string").withColumn("kind", F.lit("?"))
    none = spark.createDataFrame([], "key string, b timestamp, e timestamp")
    assert found(dangling(as_references(refs, "t", "id", ["key"], "at"), as_targets(none, ["key"], "b", "e"))) == {(1, "missing")}
    assert not found(dangling(as_references(refs.limit(0), "t", "id", ["key"], "at"), as_targets(none, ["key"], "b", "e")))
    with pytest.raises(ValueError):
        dangling(as_references(refs, "t", "id", ["key"], "at"), as_targets(none, ["key"], "b", "e"), match="other")
