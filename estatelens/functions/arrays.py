"""Array columns whose work grows with the array and not with its square."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Running sums are taken over so many entries at a time.
STRETCH = 256


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`: a lambda variable is not inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column) -> Column:
    """The sum of all integers before each place, by stretches, so no array grows entry by entry beyond a stretch."""

    def within(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")))

    def joined(parts: Column) -> Column:
        return let(within(F.transform(parts, lambda p: p["sum"]))["out"], lambda bases: F.flatten(F.zip_with(parts, bases, lambda p, b: F.transform(p["out"], lambda n: n + b))))

    def cut(all_lengths: Column) -> Column:
        at = F.sequence(F.lit(0), ((F.greatest(F.size(all_lengths), F.lit(1)) - 1) / STRETCH).cast("int"))
        return let(F.transform(at, lambda k: within(F.slice(all_lengths, k * STRETCH + 1, STRETCH))), joined)

    return let(lengths, cut)
