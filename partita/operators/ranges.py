"""Ordered work inside groups of any size: ranges over (group, order) are tasks of their own, and what they owe each other is a row a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.operators.pairs import by_size
from partita.sources.storage import written

#: Rows of a group that one task sorts, at most.
LONG = 1_000_000


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """`df` cut into ranges over a total order, numbered in that order as __part, and written, for ranges are drawn from a sample.

    There are as many as the session has shuffle partitions, fewer where its adaptive execution joins small ones.
    """
    return written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")


def _last_rows(placed: DataFrame, keys: tuple[str, ...], order: list[str], values: dict[str, Column]) -> DataFrame:
    """The last row of each range: __part, __r_key (its group) and the values."""
    last = F.max_by(F.struct(F.struct(*keys).alias("key"), *[v.alias(n) for n, v in values.items()]), F.struct(*keys, *order))
    return placed.groupBy("__part").agg(last.alias("r")).select("__part", F.col("r.key").alias("__r_key"), *[F.col(f"r.{n}").alias(n) for n in values])


def lagged(df: DataFrame, keys: tuple[str, ...], order: list[str], values: dict[str, str]) -> DataFrame:
    """`df` with the values (new name: column) of the row before in its group, NULL for the first; groups spread over ranges.

    The first row of a range takes the last one of the range before, if that is of its group. order: columns that leave no ties.
    """
    placed = in_ranges(df, [F.col(c) for c in (*keys, *order)])
    w = Window.partitionBy("__part").orderBy(*keys, *order)
    last = _last_rows(placed, keys, order, {f"__r_{n}": F.col(c) for n, c in values.items()})
    before = last.select(F.lead("__part").over(Window.orderBy("__part")).alias("__part"), "__r_key", *[f"__r_{n}" for n in values]).where("__part IS NOT NULL")
    group = F.struct(*keys)
    rows = placed.withColumns({"__r_k": F.row_number().over(w), "__r_same": F.coalesce(F.lag(group).over(w) == group, F.lit(False))} | {n: F.lag(c).over(w) for n, c in values.items()})
    rows = rows.join(F.broadcast(before), "__part", "left")  # a row a range
    carried = (F.col("__r_k") == 1) & F.coalesce(F.col("__r_key") == group, F.lit(False))
    found = {n: F.when(carried, F.col(f"__r_{n}")).when(F.col("__r_same"), F.col(n)) for n in values}
    return rows.withColumns(found).select(*df.columns, *values)


def running(df: DataFrame, keys: tuple[str, ...], order: list[str], name: str, value: str, how: str = "sum") -> DataFrame:
    """`df` with `name`: the sum (or max) of `value` over its group up to and with its row; groups spread over ranges.

    A range adds up its own rows; what the ranges before hold of its first group comes as one row.
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    placed = in_ranges(df, [F.col(c) for c in (*keys, *order)])
    here = placed.withColumn(name, agg(value).over(Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    here = written(here, "running")
    last = _last_rows(here, keys, order, {"__r_own": F.col(name)})
    # of a group that runs over several ranges, the last row of each holds what the range had of it
    upto = last.withColumn("__r_before", agg("__r_own").over(Window.partitionBy("__r_key").orderBy("__part")))
    carry = upto.select(F.lead("__part").over(Window.orderBy("__part")).alias("__part"), "__r_key", "__r_before").where("__part IS NOT NULL")
    rows = here.join(F.broadcast(carry), "__part", "left")
    same = F.coalesce(F.col("__r_key") == F.struct(*keys), F.lit(False))
    both = F.col(name) + F.col("__r_before") if how == "sum" else F.greatest(name, "__r_before")
    return rows.withColumn(name, F.when(same, both).otherwise(F.col(name))).select(*df.columns, name)


def previous(df: DataFrame, keys: tuple[str, ...], order: list[str], values: dict[str, str], most: int = LONG) -> DataFrame:
    """The values of the row before in its group: one window a group, or `lagged` for groups of more than `most` rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return by_size(df, keys, lambda rows: rows.select("*", *[F.lag(c).over(w).alias(n) for n, c in values.items()]), lambda rows: lagged(rows, keys, order, values), most)


def quantiles(df: DataFrame, keys: tuple[str, ...], column: Column, shares: dict[str, float], most: int = LONG) -> DataFrame:
    """keys and the exact quantiles (name: share) of a column, linear between neighbours, NULLs left out.

    Values are counted first, so equal ones are one row. Groups of up to `most` different values go through `percentile`; in larger ones
    the values at the wanted places are selected by their ranks, running sums of the counts over ranges.
    """
    counts = df.select(*keys, column.cast("double").alias("__v")).where("__v IS NOT NULL").groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    own = keys or ("__all",)
    counts = written(counts if keys else counts.withColumn("__all", F.lit(0)), "counts")

    def small(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*own).agg(*[F.percentile("__v", F.lit(s), F.col("__n")).alias(name) for name, s in shares.items()])

    def large(rows: DataFrame) -> DataFrame:
        upto = running(rows, own, ["__v"], "__upto", "__n")
        total = rows.groupBy(*own).agg(F.sum("__n").alias("__total"))
        at = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(s)).alias("share")) for n, s in shares.items()])).alias("at")
        wanted = total.select(*own, "__total", at).withColumn("place", F.col("at.share") * (F.col("__total") - 1))
        hits = upto.join(F.broadcast(wanted) if not keys else wanted, list(own)).where((F.col("__upto") > F.floor("place")) & (F.col("__upto") - F.col("__n") <= F.ceil("place")))
        low, high = F.min("__v"), F.max("__v")
        found = hits.groupBy(*own, "at.name", "place").agg((low + (high - low) * (F.col("place") - F.floor("place"))).alias("value"))
        return found.groupBy(*own).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in shares])

    return by_size(counts, own, small, large, most).select(*keys, *shares)
