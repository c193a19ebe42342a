r"""Mixing sources to target weights.

Tokens are summed per source, target / sum is a source's repetition rate, and each document is taken floor(rate) times and once
more if a hash of its key, as a number in [0, 1), lies below the rate's fraction. Targets: all sizes together, shared by weight; a
target stops at cap times its source's size, and the excess is shared again by weight until none is above.

Only (key, source, size) is shuffled, summed before the exchange, and the join back on a hot source is one that Spark can split.
The table of sources has one row per source, and its running sums are made in one task: it is meant for sources as people name them,
thousands, not for one per web host.

Edge cases: null texts have size 0; a null source is a source of its own, the last; a source without words has target 0 and its
documents are taken as often as the rate 0 says, never; repeated rows share their key's draw; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcesieve.llm.shared import written

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def words(text: str) -> Column:
    """The number of runs without white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that a key always gets."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target), from (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight)
    # by ascending ratio of limit and weight, the sources that meet their limits come first
    every, ranked = Window.partitionBy(), Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    exact = lambda c: c.cast("decimal(20,0)")  # noqa: E731  products of counts can pass 64 bits
    limit = F.col("source_size") * cap
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    shares = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("full", exact(limit) * exact(shares) < exact(left) * exact(F.col("weight")))
    rest = F.sum("source_size").over(every) - F.sum(F.when(F.col("full"), limit).otherwise(0)).over(every)
    shares = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("full") | (F.col("source_size") == 0), limit.cast("double")).otherwise(rest.cast("double") / shares.cast("double") * F.col("weight").cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def with_copies(rows: DataFrame, per_source: DataFrame, key: str = "doc_id", seed: str = SEED, cap: int = CAP) -> DataFrame:
    """rows with source_size, target and copies, the number of times that the mix takes a row; these replace columns of their names."""
    rows = rows.drop("source_size", "target", "copies", "_rate", "_source")
    per = per_source.withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size").cast("double"), F.lit(float(cap)))).otherwise(0.0)
    found = rows.join(per, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_rate", rate)
    copies = F.floor("_rate") + (draw(F.col(key), seed) < F.col("_rate") - F.floor("_rate")).cast("long")
    return found.withColumn("copies", copies.cast("long")).drop("_rate")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The documents of the mix: each row of df as often as it is taken, with df's columns."""
    sizes = written(df.select(F.col(source).alias("source"), words(text).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "mix-sizes")
    taken = with_copies(df.select(F.struct("*").alias("row"), F.col(source).alias("source"), F.col(key).alias("_key")), targets(sizes, weights), "_key", seed)
    return taken.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
