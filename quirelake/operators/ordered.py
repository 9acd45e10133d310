"""Operators on ordered chunks: grouping, packing, locating and numbering.

What belongs to one document and is sequential by nature stays inside one row, as a fold over an array, so that no
window has to be sorted; totals over the rows of a file are in two levels (`running_total`), so that no task sees a whole
hot file.  Windows over the units of a document (`section_numbers` and what follows it) see what was one row before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: elements that a fold gathers before it appends them to its result
_FOLDED = 256


def folded(elements: Column, state: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]], item: str, kind: str) -> Column:
    """The list of `item`, of the given type, that each step of a fold yields besides its state.

    Appending to a list copies it, so what a block of elements yields is gathered first and appended at once; the work is
    linear in the elements but for a small factor."""
    size = F.size(elements)

    def start(values: Column | None, items: str) -> Column:
        own = {name: (value if values is None else values[name]) for name, value in state.items()}
        return F.struct(*(v.alias(n) for n, v in own.items()), F.array().cast(items).alias("items"))

    def inner(s: Column, e: Column) -> Column:
        made = step(s, e)
        return F.struct(*(made[n].alias(n) for n in state), F.concat(s["items"], F.array(made[item])).alias("items"))

    def outer(s: Column, block: Column) -> Column:
        done = F.aggregate(block, start(s, f"array<{kind}>"), inner)
        return F.aggregate(F.array(done), s, lambda s, d: F.struct(*(d[n].alias(n) for n in state), F.concat(s["items"], F.array(d["items"])).alias("items")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(size, F.lit(1)) - 1) / _FOLDED).cast("int")), lambda k: F.slice(elements, k * _FOLDED + 1, F.lit(_FOLDED)))
    return F.aggregate(blocks, start(None, f"array<array<{kind}>>"), outer, lambda s: F.flatten(s["items"]))


def greedy_bins(lengths: Column, limit: int) -> Column:
    """Bin number (from 0) of each element: packed while the sum stays within the limit; a longer one stands alone."""

    def step(s: Column, n: Column) -> dict[str, Column]:
        opens = (s["bin"] < 0) | (s["used"] + n > limit)
        number = F.when(opens, s["bin"] + 1).otherwise(s["bin"])
        return {"used": F.when(opens, n).otherwise(s["used"] + n), "bin": number, "own": number}

    return folded(lengths, {"used": F.lit(0), "bin": F.lit(-1)}, step, "own", "int")


def flush_bins(lengths: Column, alone: Column, limit: int) -> Column:
    """Bin number of each element: inline ones are collected until the sum reaches the limit; block ones (`alone`)
    close what is open and stand by themselves."""

    def step(s: Column, e: Column) -> dict[str, Column]:
        number = F.when(e["alone"] & (s["used"] > 0), s["bin"] + 1).otherwise(s["bin"])
        used = F.when(e["alone"], 0).otherwise(s["used"] + e["n"])
        full = e["alone"] | (used >= limit)
        return {"used": F.when(full, 0).otherwise(used), "bin": F.when(full, number + 1).otherwise(number), "own": number}

    return folded(F.arrays_zip(lengths.alias("n"), alone.alias("alone")), {"used": F.lit(0), "bin": F.lit(0)}, step, "own", "int")


def located_lines(text: Column, chunks: Column) -> Column:
    """Line (from 1) at which each chunk begins in the text, searched from the end of the one before, else from the
    beginning; null for empty chunks and those that are not found."""

    def breaks(part: Column) -> Column:
        return F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))

    def find(s: Column, chunk: Column) -> dict[str, Column]:
        onward = F.call_function("locate", chunk, text, s["place"])
        again = F.when(onward == 0, F.call_function("locate", chunk, text)).otherwise(0)
        known = (chunk != "") & ((onward > 0) | (again > 0))
        # lines are counted on from the last place, from the beginning only after a search from there
        line = F.when(onward > 0, s["line"] + breaks(F.substring(text, s["place"], onward - s["place"]))).otherwise(
            1 + breaks(F.substring(text, F.lit(1), again - F.lit(1)))
        )
        at = F.when(onward > 0, onward).otherwise(again)
        return {
            "place": F.when(known, at + F.length(chunk)).otherwise(s["place"]),
            "line": F.when(known, line + breaks(chunk)).otherwise(s["line"]),
            "own": F.when(known, line),
        }

    return folded(chunks, {"place": F.lit(1), "line": F.lit(1)}, find, "own", "int")


def section_numbers(units: DataFrame, document: str, order: str, kind: str = "kind") -> DataFrame:
    """`section` (from 1) of each unit: a heading opens one, and the labels before a heading go with it; labels at the
    end stay with the last section."""
    own = Window.partitionBy(document).orderBy(order)
    ahead = own.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    following = F.first(F.when(F.col(kind) != "target", F.col(kind)), ignorenulls=True).over(ahead)
    marked = units.withColumn("_next", following).withColumn("_before", F.lag(kind).over(own)).withColumn("_nth", F.row_number().over(own))
    opens = ((F.col(kind) == "heading") | (F.col(kind) == "target")) & (F.col("_next") == "heading") & ((F.col("_before") != "target") | F.col("_before").isNull())
    marked = marked.withColumn("_opens", F.coalesce(opens & (F.col("_nth") > 1), F.lit(False)).cast("int"))
    total = F.sum("_opens").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 1
    return marked.withColumn("section", total.cast("bigint")).drop("_next", "_before", "_nth", "_opens")


def expanded_sections(units: DataFrame, document: str, order: str, length: str, limit: int) -> DataFrame:
    """A section within the limit is one element (0); the units of a longer one are elements of their own (from 1)."""
    section = Window.partitionBy(document, "section")
    within = section.orderBy(order)
    sized = units.withColumn("_size", F.sum(length).over(section)).withColumn("_nth", F.row_number().over(within))
    element = F.when(F.col("_size") > limit, F.col("_nth")).otherwise(0).cast("bigint")
    return sized.withColumn("element", element).groupBy(document, "section", "element").agg(F.sum(length).cast("bigint").alias("n_chars"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join in which null equals null; both sides may come from one table."""
    own = right.select(*(F.col(k).alias(f"_key_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return left.join(own, same).drop(*(f"_key_{k}" for k in keys))


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str, block: int = 1000) -> DataFrame:
    """Sum of `value` over the rows of a group before each row, in the order of some columns, the first an integer.

    Blocks of consecutive numbers of the first column are summed first and totalled over the few rows of blocks; each
    block is then totalled by itself, so that a group of any size is spread over many tasks."""
    cut = df.withColumn("_block", F.floor(F.col(order[0]) / block))
    blocks = cut.groupBy(*group, "_block").agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumn("_inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = join_null_safe(inner, blocks, [*group, "_block"])
    return joined.select(*df.columns, (F.col("_before") + F.col("_inner")).alias(name))


def nested_away(spans: DataFrame, document: str, start: str, end: str) -> DataFrame:
    """The spans that do not lie inside a kept span before them."""
    over = Window.partitionBy(document).orderBy(F.col(start), F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max(end).over(over)).where(f"_reach is null or {end} > _reach").drop("_reach")


def reaching_to_next(spans: DataFrame, document: str, start: str, end: str) -> DataFrame:
    """Each span reaches to the start of the next one; the last one keeps its end."""
    over = Window.partitionBy(document).orderBy(start)
    return spans.withColumn(end, F.coalesce(F.lead(start).over(over), F.col(end)))


def split_at_boundary(text: str, limit: int) -> list[str]:
    """Pieces of at most `limit` characters that make up the text.

    Every boundary (blank lines, line breaks, white space after a full stop or elsewhere) is a run of white space, so a
    piece ends behind the last run that ends in its last two fifths; a run that goes on at the limit is cut there. Without
    one it ends at the limit."""
    out, begin = [], 0
    while len(text) - begin > limit:
        least, end = begin + math.ceil(0.6 * limit), begin + limit
        at = next((k for k in range(end, max(least, begin + 1) - 1, -1) if text[k - 1].isspace() and (k == end or not text[k].isspace())), end)
        out.append(text[begin:at])
        begin = at
    return [*out, text[begin:]] if begin < len(text) else out
