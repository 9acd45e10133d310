"""Filling of fixed-capacity containers with documents.

Sizes are whole tokens, so all that a packing needs to know is how many items there are of each size from 1 to the
capacity: a histogram whose length is the capacity, whatever the number of documents.  The packing is found on that
histogram, for all documents at once:

1. items above a third of the capacity fit at most twice in a container; the largest is matched with the largest
   other one that still fits, as many times as both occur;
2. the smaller items, largest first, go where the remaining gap is smallest (best fit); what finds no gap opens
   new containers.

Each step says "the items of size s with ranks a..b go to the containers c.., k each".  The documents then look their
container up by size and rank.  Ranks are counted per (size, salt) and shifted by the counts before; there are as many
salts as the items need for a task to rank about `RANKED` of one size, and the salt is drawn from the row's own number,
so that neither a size that a third of the documents share nor an id that is repeated makes one task's work large.

Defined results: an item is divided only if it alone exceeds the capacity, into full containers of its own and a
remainder that is packed like any other item; null and empty texts have one piece of size 0 and are spread evenly over
the containers (container 1 if there is none); repeated rows are separate items; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.runtime import durable

#: items that are ranked by one task, about
RANKED = 1 << 20


def pack_histogram(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Steps (size, first rank, items, first container, items per container) and the number of containers.

    Ranks and containers count from 0. counts: the number of items of each size from 1 to the capacity."""
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    taken = dict.fromkeys(left, 0)
    steps: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def place(size: int, items: int, container: int, each: int = 1) -> None:
        steps.append((size, taken[size], items, container, each))
        taken[size] += items
        left[size] -= items

    def leave(gap: int, first: int, number: int) -> None:
        if gap > 0 and number > 0:
            gaps.setdefault(gap, []).append((first, number))

    large = sorted(s for s in left if 3 * s > capacity)
    for i in range(len(large) - 1, -1, -1):
        size = large[i]
        while left[size]:
            j = bisect_left(large, capacity - size + 1) - 1
            j = min(j, i)
            while j >= 0 and (left[large[j]] < 1 or (j == i and left[size] < 2)):
                j -= 1
            if j < 0:
                n = left[size]
                place(size, n, opened)
                leave(capacity - size, opened, n)
            elif j == i:
                n = left[size] // 2
                place(size, 2 * n, opened, 2)
                leave(capacity - 2 * size, opened, n)
            else:
                n = min(left[size], left[large[j]])
                place(size, n, opened)
                place(large[j], n, opened)
                leave(capacity - size - large[j], opened, n)
            opened += n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        gap = size
        while left[size] and gap <= capacity:
            spots = gaps.get(gap)
            if not spots:
                gap += 1
                continue
            first, number = spots.pop()
            each = min(gap // size, -(-left[size] // number))
            n = min(number, left[size] // each) if each > 1 else min(number, left[size])
            place(size, n * each, first, each)
            leave(gap - each * size, first, n)
            if n < number:
                spots.append((first + n, number - n))
        if left[size]:
            each = capacity // size
            n = left[size] // each
            if n:
                place(size, n * each, opened, each)
                leave(capacity - each * size, opened, n)
                opened += n
            if rest := left[size]:
                place(size, rest, opened, rest)
                leave(capacity - rest * size, opened, 1)
                opened += 1
    return steps, opened


def pack(sizes: DataFrame, id_column: str, size_column: str, capacity: int, ranked: int = RANKED) -> DataFrame:
    """doc_id, piece_no, first_token, n_tokens, container_id: every document's, or piece's, container (from 1)."""
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    items = durable(
        sizes.select(
            sizes[id_column].cast("bigint").alias("doc_id"),
            F.coalesce(sizes[size_column], F.lit(0)).cast("bigint").alias("size"),
            # kept with the rows: tells rows of one id apart
            F.monotonically_increasing_id().alias("nr"),
        )
    )
    spark = items.sparkSession
    salts = 1 + items.count() // ranked
    items = items.select(
        "doc_id",
        "size",
        F.when(F.col("size") > capacity, F.floor(F.col("size") / capacity)).otherwise(0).cast("bigint").alias("full"),
        "nr",
        F.pmod(F.xxhash64("doc_id", "nr"), F.lit(salts)).cast("int").alias("salt"),
    ).withColumn("rest", (F.col("size") - F.col("full") * capacity).cast("int"))
    per_salt = durable(
        items.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("n_full"))
    )  # at most (capacity + 1) x salts rows, a row for some 500 items where all sizes are as frequent
    counts = {row["rest"]: row["n"] for row in per_salt.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    steps, opened = pack_histogram({s: n for s, n in counts.items() if s}, capacity)
    before = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # the containers of divided items are counted per size first, over at most capacity + 1 sizes, and within them by salt
    per_size = per_salt.groupBy("rest").agg(F.sum("n_full").alias("n_full"))
    sizes_before = Window.partitionBy(F.lit(1)).orderBy("rest").rowsBetween(Window.unboundedPreceding, -1)
    per_size = per_size.select("rest", F.coalesce(F.sum("n_full").over(sizes_before), F.lit(0)).alias("full_of_sizes"))
    shifts = per_salt.join(per_size, "rest").select(
        "rest",
        "salt",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"),
        (F.col("full_of_sizes") + F.coalesce(F.sum("n_full").over(before), F.lit(0))).alias("full_shift"),
    )
    own = Window.partitionBy("rest", "salt").orderBy("doc_id", "nr")
    ranked = (
        items.withColumn("nth", F.row_number().over(own) - 1)
        .withColumn(
            "full_before",
            F.coalesce(F.sum("full").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .join(shifts, ["rest", "salt"])
        .withColumn("rank", F.col("nth") + F.col("shift"))
    )
    plan = spark.createDataFrame(
        [(s, a, a + n, c, k) for s, a, n, c, k in steps] or [(-1, 0, 0, 0, 1)],
        "rest int, from_rank bigint, to_rank bigint, container bigint, each int",
    )
    # one row a step: bounded by the capacity, not by the documents
    in_step = (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    packed = (
        ranked.where("rest > 0")
        .join(F.broadcast(plan.withColumnRenamed("rest", "step_size")), (F.col("rest") == F.col("step_size")) & in_step)
        .select(
            "doc_id",
            (F.col("full") + 1).cast("int").alias("piece_no"),
            (F.col("full") * capacity).alias("first_token"),
            F.col("rest").alias("n_tokens"),
            (F.col("container") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("each")) + 1).alias(
                "container_id"
            ),
        )
    )
    whole = (
        ranked.where("full > 0")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)))
        .select(
            "doc_id",
            (F.col("piece") + 1).cast("int").alias("piece_no"),
            (F.col("piece") * capacity).alias("first_token"),
            F.lit(capacity).alias("n_tokens"),
            (F.lit(opened) + F.col("full_shift") + F.col("full_before") + F.col("piece") + 1).alias("container_id"),
        )
    )
    empty = ranked.where("rest = 0 and full = 0").select(
        "doc_id",
        F.lit(1).alias("piece_no"),
        F.lit(0).cast("bigint").alias("first_token"),
        F.lit(0).alias("n_tokens"),
        (F.pmod(F.col("rank"), F.lit(max(1, opened))) + 1).cast("bigint").alias("container_id"),
    )
    return packed.unionByName(whole).unionByName(empty)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """How many containers there are, their tokens, and the share of the capacity that is used."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("tokens").alias("n_tokens"),
        F.max("tokens").alias("fullest"),
        F.round(F.sum("tokens") / (F.count(F.lit(1)) * capacity), 6).alias("fill"),
    )
