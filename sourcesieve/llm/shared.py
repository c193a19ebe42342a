"""Small helpers that several operators use; where intermediate tables live is ``sourcesieve.operators.intermediate``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcesieve.operators.intermediate import discard, shared_dir, written  # noqa: F401  other operators import them from here

#: Values that more than one in HOT of all rows have are fewer than HOT.
HOT = 1024


def free(taken: list[str], name: str) -> str:
    """name, or name with underscores after it: one that no column has, whatever its case."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def looked_up(rows: DataFrame, key: str, table: DataFrame, at: str, total: int) -> DataFrame:
    """rows with the columns of table whose value of at is their key; nulls where there is none.

    table has a row per value. A value that over one in HOT of all (total) rows have stays where its rows are, and gets its row
    of table by broadcast: that is fewer than HOT rows. So no value brings more than one in HOT of the rows to one task of an
    exchange. rows is read three times: a written table.
    """
    hot = rows.groupBy(F.col(key).alias("_hot")).count().filter((F.col("count") > total / HOT) & F.col("_hot").isNotNull()).select("_hot")
    known = hot.join(F.broadcast(table.join(F.broadcast(hot), F.col(at) == F.col("_hot"), "left_semi")), F.col("_hot") == F.col(at), "left")
    few = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left_anti").join(table, F.col(key) == F.col(at), "left")
    return few.unionByName(rows.join(F.broadcast(known), F.col(key) == F.col("_hot")).drop("_hot"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row, even where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
