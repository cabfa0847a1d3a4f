"""Substring search by an inverted index of trigrams (what F4-F7 and F10 do to texts, without reading all of them)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.arrays import let

#: The index is written in so many folders by gram, so that a search reads those of its grams.
FOLDERS = 64


def _grams(text: Column) -> Column:
    """The distinct runs of three characters of a text, lower-cased. The text is split once, not for each of its characters."""

    def runs(signs: Column) -> Column:
        return F.transform(F.slice(signs, 3, F.greatest(F.size(signs) - 2, F.lit(0))), lambda c, k: F.concat(F.get(signs, k), F.get(signs, k + 1), c))

    return F.array_distinct(let(F.split(F.lower(text), ""), runs))


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def text_index(rows: DataFrame, id: str, *columns: str) -> DataFrame:
    """(gram, id, folder): every run of three characters of the columns of each row, once a row; null texts have none."""
    every = F.array_distinct(F.flatten(F.array(*(F.coalesce(_grams(F.col(c)), F.array().cast("array<string>")) for c in columns))))
    return rows.select(F.col(id).alias("id"), F.explode(every).alias("gram")).select("gram", "id", _folder(F.col("gram")).alias("folder"))


def write_text_index(rows: DataFrame, path: str, id: str, *columns: str) -> None:
    """Write text_index as a table partitioned by folder and sorted by gram, so a search skips what it has no use for."""
    text_index(rows, id, *columns).repartition("folder", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("folder", "gram").write.mode("overwrite").partitionBy("folder").parquet(path)


def grams_of(q: str) -> list[str]:
    """The trigrams that a text has to hold if it matches %q% whatever its wildcards stand for."""
    runs = re.split("[%_]", re.sub(r"\\\\.?", "%", q).lower())  # a backslash escapes the next character
    return sorted({run[k : k + 3] for run in runs for k in range(len(run) - 2)})


def candidates(index: DataFrame, q: str) -> DataFrame | None:
    """The ids of rows that may match a search text; null if it is too short to say. Each id has all the text's trigrams.

    Grams are given in Python's lower case; where it differs from Spark's (some capitals beyond ASCII) the index can't be
    asked, and the answer is null too.
    """
    wanted = grams_of(q)
    if not wanted or not q.isascii():
        return None
    folders = [r[0] for r in index.sparkSession.createDataFrame([(g,) for g in wanted], "gram string").select(_folder(F.col("gram"))).distinct().collect()]
    found = index.where(F.col("folder").isin(*folders) & F.col("gram").isin(*wanted))
    return found.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("id")


def narrowed(rows: DataFrame, id: str, q: str | None, index: DataFrame | None) -> DataFrame:
    """rows that may match q by the index; all rows without an index or with a text that it can't be asked for."""
    found = candidates(index, q) if index is not None and q else None
    return rows if found is None else rows.join(found.select(F.col("id").alias(id)), id, "left_semi")
