"""Queries given once as a template over tables, for Spark and, as their check, for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK, SPARK, Spark
from ..session import table, written

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings source_records papers authors organizations repos repo_documents"
    " embedding_records eval_items nicknames"
).split()


class Book:
    """Collects queries: ``@book.query`` functions take a dialect and return SQL; ``@book.frame`` ones take (spark, root)."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.SQL: dict[str, str] = {}

    def query(self, make: Callable[[Spark], str]) -> Callable[[Spark], str]:
        name = make.__name__

        def run(spark: SparkSession, root: str) -> DataFrame:
            return sql(spark, root, make(SPARK))

        run.__doc__ = make.__doc__
        self.QUERIES[name] = run
        self.SQL[name] = make(DUCK)
        return make

    def staged(self, make: Callable[[Spark], tuple[list[tuple[str, str]], str]]) -> Callable:
        """A query in stages: ``make`` gives named CTEs and the last SELECT. Spark writes every stage once and reads it back; the check puts them in a WITH."""
        name = make.__name__

        def run(spark: SparkSession, root: str) -> DataFrame:
            stages, last = make(SPARK)
            for view, text in stages:
                written(sql(spark, root, text), view).createOrReplaceTempView(view)
            return sql(spark, root, last)

        run.__doc__ = make.__doc__
        self.QUERIES[name] = run
        stages, last = make(DUCK)
        self.SQL[name] = "with " + ", ".join(f"{view} as ({text})" for view, text in stages) + " " + last
        return make

    def over(self, relations: Callable[[Spark], str], *views: str):
        """Queries over relations that are costly to derive: Spark writes each of ``views`` once a session and folder of tables; the check derives them in a WITH."""

        def add(make: Callable[[Spark], str]) -> Callable:
            name = make.__name__

            def run(spark: SparkSession, root: str) -> DataFrame:
                materialised(spark, root, relations(SPARK), views)
                return sql(spark, root, make(SPARK))

            run.__doc__ = make.__doc__
            self.QUERIES[name] = run
            self.SQL[name] = f"with {relations(DUCK)} " + re.sub(r"^with ", ", ", make(DUCK).strip()).replace(" , ", ", ", 1) if make(DUCK).strip().startswith("with ") else f"with {relations(DUCK)} {make(DUCK)}"
            return make

        return add

    def frame(self, run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        self.QUERIES[run.__name__] = run
        return run


def sql(spark: SparkSession, root: str, text: str) -> DataFrame:
    """Run SQL over the tables under ``root`` that it names (each read with only the columns it needs)."""
    for name in set(re.findall(r"\b(" + "|".join(TABLES) + r")\b", text)):
        table(spark, root, name).createOrReplaceTempView(name)
    return spark.sql(text)


def materialised(spark: SparkSession, root: str, ctes: str, views: tuple[str, ...]) -> None:
    """Write each of ``views`` of ``ctes`` once for these tables (a change of their files makes them anew) and register it by name."""
    kept = spark.__dict__.setdefault("_lodestone_views", {})
    files = [f for name in sorted(set(re.findall(r"\b(" + "|".join(TABLES) + r")\b", ctes))) for f in sorted(table(spark, root, name).inputFiles())]
    for view in views:
        key = (view, root, ctes, tuple(files))
        if key not in kept:
            kept[key] = written(sql(spark, root, f"with {ctes} select * from {view}"), view)
        kept[key].createOrReplaceTempView(view)
