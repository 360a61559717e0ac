"""Rankings, boards and run reports over small metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_first(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of an order, numbered from 1 as `place`."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def constrained_best(df: DataFrame, limited: str, least: float, metric: str) -> DataFrame:
    """place: rows that meet `limited` >= least come first, then by metric; where none meets it, the order is by metric alone."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.col(limited) >= least), F.desc(metric), "name")))


def upsert_board(board: DataFrame, batch: DataFrame, key: str = "model", metric: str = "map50") -> DataFrame:
    """A leaderboard after a batch: one row a model, that of the batch if it has one, by the metric."""
    both = board.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)))
    one = both.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__new")))).where("__k = 1")
    return one.drop("__new", "__k").orderBy(F.desc(metric), key)


def pivot_metrics(long: DataFrame, protocols: list[str], metrics: list[str]) -> DataFrame:
    """One row a class, a column for each protocol and metric; 0 where there is none."""
    cells = [F.coalesce(F.max(F.when((F.col("protocol") == p) & (F.col("metric") == m), F.col("value"))), F.lit(0.0)).alias(f"{p}_{m}") for p in protocols for m in metrics]
    return long.groupBy("class_id").agg(*cells)


def gate(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """passed: every metric of `limits` is there and reaches its limit."""
    ok = F.lit(True)
    for name, least in limits.items():
        ok &= F.coalesce(F.col(name) >= least, F.lit(False))
    return metrics.withColumn("passed", ok)


def corpus_totals(files: DataFrame) -> DataFrame:
    """Of file statistics (path, parts, measures, fermatas, bar_styles; NULL where a file doesn't parse): files, errors, and for fermatas and bar styles the
    files with any, their share, the total, the mean a file and the mean a file with any."""
    good = F.col("parts").isNotNull()
    cells = [F.count_if(good).alias("files"), F.count_if(~good).alias("errors")]
    for c in ("fermatas", "bar_styles"):
        some = F.when(F.col(c) > 0, F.col(c))
        cells += [F.count(some).alias(f"with_{c}"), F.avg(F.when(good, (F.col(c) > 0).cast("int"))).alias(f"share_{c}"), F.coalesce(F.sum(c), F.lit(0)).alias(c), F.avg(c).alias(f"mean_{c}"), F.avg(some).alias(f"mean_{c}_where_any")]
    return files.agg(*cells)


def part_distribution(files: DataFrame) -> DataFrame:
    """parts, files and their share of the files that parse."""
    n = files.where("parts IS NOT NULL").groupBy("parts").agg(F.count("*").alias("files"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("files").alias("all")))).select("parts", "files", (F.col("files") / F.col("all")).alias("share"))


def top_files(files: DataFrame, column: str = "fermatas", n: int = 10) -> DataFrame:
    """The n files with most of `column`, numbered as place."""
    return best_first(files.where(F.col(column) > 0).select("path", column), [F.desc(column), F.col("path")], n)


def run_report(epochs: DataFrame, span: int = 20, stagnant: float = 0.001) -> DataFrame:
    """Per run of epochs (run_id, epoch, metric): first, last and best value, best epoch, gain over the last `span` epochs, coefficient of variation, and flags.

    falling: the best value lies before the last and above it by a tenth. stagnant: less than `stagnant` gained in the last `span` epochs.
    """
    w = Window.partitionBy("run_id").orderBy("epoch")
    rows = epochs.withColumn("before", F.lag("metric", span).over(w))
    best = F.max_by("epoch", F.struct("metric", -F.col("epoch")))
    out = rows.groupBy("run_id").agg(F.count("*").alias("epochs"), F.min_by("metric", "epoch").alias("first"), F.max_by("metric", "epoch").alias("last"), F.max("metric").alias("best"), best.alias("best_epoch"), F.max_by("before", "epoch").alias("before"), F.avg("metric").alias("mean"), F.stddev_pop("metric").alias("sd"))
    out = out.withColumn("gain", F.col("last") - F.col("before")).withColumn("reduction", F.when(F.col("first") != 0, (F.col("first") - F.col("last")) / F.when(F.col("first") != 0, F.col("first")) * 100))
    cv = F.when(F.col("mean") != 0, F.col("sd") / F.when(F.col("mean") != 0, F.col("mean")))
    severity = F.when(cv > 1, "high").when(cv > 0.5, "medium").otherwise("low")
    return out.select("run_id", "epochs", "first", "last", "best", "best_epoch", "gain", "reduction", cv.alias("cv"), severity.alias("spread"), (F.col("best") > F.col("last") * 1.1).alias("falling"), F.coalesce(F.col("gain") < stagnant, F.lit(False)).alias("stagnant"))


def style_totals(files: DataFrame) -> DataFrame:
    """style, n, files: how often each bar style stands in the files of corpus_statistics, and in how many."""
    return files.select("path", F.explode("styles").alias("style", "k")).groupBy("style").agg(F.sum("k").alias("n"), F.count("*").alias("files"))


def spread_ratio(one: DataFrame, two: DataFrame) -> DataFrame:
    """cv_one, cv_two, ratio, severity: the variation of boxes per image (image_statistics) of a second set over that of a first; severe over 3, moderate over 2, else mild."""
    both = one.select(F.col("cv").alias("cv_one")).join(two.select(F.col("cv").alias("cv_two")), how="full")  # a row each
    ratio = F.col("cv_two") / F.when(F.col("cv_one") > 0, F.col("cv_one"))
    return both.withColumn("ratio", ratio).withColumn("severity", F.when(F.col("ratio") > 3, "severe").when(F.col("ratio") > 2, "moderate").when(F.col("ratio").isNotNull(), "mild").otherwise("unknown"))


def transfer(before: DataFrame, after: DataFrame, keep: float = 0.95) -> DataFrame:
    """run_id, before, after, loss (percent), negative: the last values of runs in two trainings (run_report); negative where `keep` of the first isn't reached."""
    both = before.select("run_id", F.col("last").alias("before")).join(after.select("run_id", F.col("last").alias("after")), "run_id")
    negative = F.col("after") < keep * F.col("before")
    return both.withColumn("loss", F.when(negative, (1 - F.col("after") / F.when(F.col("before") != 0, F.col("before"))) * 100)).withColumn("negative", negative)
