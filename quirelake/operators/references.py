"""References to records that do not exist, were removed, or came later.

A *reference* is one row of a referring table: an id, a (possibly composite) key and the time at which it was
written.  A *target* is one row of the referred table: the key and the half-open interval `[begin, end)` in which
the row existed (`end` null: for ever; `begin` null: from the beginning).

The operator groups references by their null mask and, mask by mask, anti-joins them to the targets on the key
columns that are not null.  The anti-join is executed as one sorted pass over references and targets of a key, so that
the kind of a dangling reference falls out of the same shuffle:

* `missing`: no target row has the key,
* `late`:    every target row with the key begins after the reference,
* `deleted`: otherwise (some began, but none is alive at the time).

Match semantics for composite keys (`match`), as in SQL:

* `simple`:  a key with any null component refers to nothing,
* `partial`: the non-null components must match some target row,
* `full`:    a partly null key is always dangling (`missing`).

A key with only null components refers to nothing under all three.

Scale: whether a target is alive at a reference's time is read from a running maximum: targets and references of a key
are sorted by time, and a reference is alive if the latest end of the targets that began before it lies beyond it.  Keys
are cut into months; what begins in a month is reduced to its latest end first, and the months before a row's own are
carried over from a table with one row per key and month.  So a key that holds a third of all rows is spread over its
months, no row holds a list, and targets that begin at one time are reduced before they are shuffled.

Defined results: blank key components (only white space) count as null; keys are compared without regard to case and
surrounding white space; a reference with a null time is a case only if its key is missing; repeated rows are judged
one by one; an empty target table makes every reference `missing`; columns of the inputs that are not named in the
arguments are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")
_BLANK = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def tidy_key(column: Column | str) -> Column:
    """A key as it is compared: lower case, without surrounding white space; blank is null."""
    tidy = F.lower(F.regexp_replace(F.col(column) if isinstance(column, str) else column, _BLANK, ""))
    return F.when(tidy != "", tidy)


def as_references(df: DataFrame, table_name: str, record_id: str, keys: Sequence[str], time: str) -> DataFrame:
    """The references of one table, under the names that `dangling` expects."""
    return df.select(
        F.lit(table_name).alias("table_name"),
        F.col(record_id).cast("bigint").alias("record_id"),
        *(tidy_key(key).alias(f"k{i}") for i, key in enumerate(keys)),
        F.col(time).alias("at"),
    )


def as_targets(df: DataFrame, keys: Sequence[str], begin: str, end: str) -> DataFrame:
    """The targets of one table, under the names that `dangling` expects."""
    return df.select(
        *(tidy_key(key).alias(f"k{i}") for i, key in enumerate(keys)),
        F.col(begin).alias("begin"),
        F.col(end).alias("end"),
    )


def judged(references: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table_name, record_id, at, first_begin (null without any target) and alive of each reference."""
    first, last = F.to_timestamp(F.lit("0001-01-01 00:00:00")), F.to_timestamp(F.lit("9999-12-31 00:00:00"))
    month = F.trunc("time", "month")
    spans = (
        targets.where(" and ".join(f"{k} is not null" for k in keys))
        .select(*keys, F.coalesce("begin", first).alias("time"), F.coalesce("end", last).alias("until"))
        .groupBy(*keys, "time")
        .agg(F.max("until").alias("until"))
        .withColumn("month", month)
    )
    # references without a time go with the first month
    asked = references.withColumn("time", F.coalesce("at", first)).withColumn("month", month)
    months = (
        spans.select(*keys, "month", "time", "until")
        .unionByName(asked.select(*keys, "month", F.lit(None).cast("timestamp").alias("time"), F.lit(None).cast("timestamp").alias("until")))
        .groupBy(*keys, "month")
        .agg(F.min("time").alias("begin"), F.max("until").alias("until"))
    )
    before = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    carried = months.select(*keys, "month", F.max("until").over(before).alias("carried"), F.min("begin").over(Window.partitionBy(*keys)).alias("first_begin"))
    nothing = lambda name, kind: F.lit(None).cast(kind).alias(name)
    events = spans.select(*keys, "month", "time", "until", F.lit(0).alias("asks"), nothing("table_name", "string"), nothing("record_id", "bigint"), nothing("at", "timestamp"))
    events = events.unionByName(asked.select(*keys, "month", "time", nothing("until", "timestamp"), F.lit(1).alias("asks"), "table_name", "record_id", "at"))
    upto = Window.partitionBy(*keys, "month").orderBy("time", "asks").rowsBetween(Window.unboundedPreceding, 0)
    running = events.withColumn("reach", F.max("until").over(upto)).where("asks = 1").join(carried, [*keys, "month"])
    alive = F.coalesce(F.greatest("reach", "carried") > F.col("at"), F.lit(False))
    return running.select("table_name", "record_id", "at", "first_begin", alive.alias("alive"))


def dangling(references: DataFrame, targets: DataFrame, n_keys: int = 1, match: str = "simple") -> DataFrame:
    """table_name, record_id, at, kind of every reference for which no target row is alive at its time."""
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    names = [f"k{i}" for i in range(n_keys)]
    found = []
    for mask in product((True, False), repeat=n_keys):
        keys = [name for name, there in zip(names, mask) if there]
        if not keys or (match == "simple" and len(keys) < n_keys):
            continue
        own = references.where(
            " and ".join(f"{name} is {'not ' if there else ''}null" for name, there in zip(names, mask))
        )
        if match == "full" and len(keys) < n_keys:
            found.append(own.select("table_name", "record_id", "at", F.lit("missing").alias("kind")))
            continue
        kind = (
            F.when(F.col("first_begin").isNull(), F.lit("missing"))
            .when(F.col("at").isNull() | F.col("alive"), F.lit(None))
            .when(F.col("first_begin") > F.col("at"), F.lit("late"))
            .otherwise(F.lit("deleted"))
        )
        found.append(judged(own, targets, keys).select("table_name", "record_id", "at", kind.alias("kind")).where("kind is not null"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def by_month(cases: DataFrame) -> DataFrame:
    """Number of dangling references per referring table, month of the reference and kind."""
    return cases.groupBy(
        "table_name", F.date_format(F.trunc("at", "month"), "yyyy-MM").alias("month"), "kind"
    ).agg(F.count(F.lit(1)).alias("n"))
