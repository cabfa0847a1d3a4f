"""How a query and its SQL are declared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from estatelens.plans.inputs import INPUTS, LINE_ID, WIDE_LINE_ID, with_inputs

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Inputs:
    """The named inputs of one call, read from sf_dir when they are first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        text = text.replace(LINE_ID, WIDE_LINE_ID)
        used = [t for t in TABLES if f" {t}" in text]
        return self.spark.sql(_braced(text, used), **{t: self.table(t) for t in used})

    def __getattr__(self, name: str) -> DataFrame:
        if name in INPUTS:
            return self.sql(INPUTS[name])
        raise AttributeError(name)


def _braced(text: str, used: list[str]) -> str:
    import re

    for t in used:
        text = re.sub(rf"\b(FROM|JOIN|,)\s+{t}\b", rf"\1 {{{t}}}", text)
    return text


class Registry:
    """Queries with their SQL; `inputs` names what the SQL's WITH clause holds."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None, inputs: str = ""):
        def add(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
            name = build.__name__
            self.queries[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
            if sql is not None:
                names = inputs.split()
                self.oracles[name] = (with_inputs(*names) + " " if names else "") + sql
            return build

        return add
