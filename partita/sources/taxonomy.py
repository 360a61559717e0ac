"""Class ids belong to a taxonomy and its version: a dimension of names, and joins that refuse ids of another one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("taxonomy", "version", "class_id")


def read_taxonomies(spark: SparkSession, path: str) -> DataFrame:
    """The dimension from CSV files with a header: taxonomy, version, class_id, name. Lines without a whole id or a name are dropped."""
    raw = spark.read.csv(path, header=True).select(F.btrim("taxonomy").alias("taxonomy"), F.btrim("version").try_cast("int").alias("version"), F.btrim("class_id").try_cast("int").alias("class_id"), F.btrim("name").alias("name"))
    return raw.dropna().where("name <> ''").distinct()


def conflicts(dimension: DataFrame) -> DataFrame:
    """kind, taxonomy, version, class_id, names: ids with several names in one version (ambiguous), and ids whose name another version or taxonomy gives otherwise (moved)."""
    inside = dimension.groupBy(*KEY).agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") > 1)
    across = dimension.groupBy("class_id").agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") > 1)
    moved = dimension.join(across, "class_id").select(F.lit("moved").alias("kind"), *KEY, "names").distinct()
    return inside.select(F.lit("ambiguous").alias("kind"), *KEY, "names").union(moved)


def newest(dimension: DataFrame) -> DataFrame:
    """The rows of each taxonomy's last version."""
    last = F.max("version").over(Window.partitionBy("taxonomy"))
    return dimension.withColumn("__last", last).where("version = __last").drop("__last")


def named(rows: DataFrame, dimension: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (taxonomy, version, class_id, ...) with class_name, and those refused with their reason: other_taxonomy, other_version or unknown_class.

    An id is looked up under its own taxonomy and version only, never by its number alone. An id with several names raises nothing here (see
    conflicts) but is refused as ambiguous.
    """
    one = dimension.groupBy(*KEY).agg(F.collect_set("name").alias("__names")).select(*KEY, F.when(F.size("__names") == 1, F.get("__names", F.lit(0))).alias("class_name"), F.lit(True).alias("__known"))
    versions = dimension.select("taxonomy", "version").distinct()
    both = rows.join(F.broadcast(one), list(KEY), "left")  # a dimension of class names: a few thousand rows
    both = both.join(F.broadcast(versions.withColumn("__version", F.lit(True))), ["taxonomy", "version"], "left")
    both = both.join(F.broadcast(versions.select("taxonomy").distinct().withColumn("__taxonomy", F.lit(True))), "taxonomy", "left")
    reason = F.when(F.col("__taxonomy").isNull(), "other_taxonomy").when(F.col("__version").isNull(), "other_version").when(F.col("__known").isNull(), "unknown_class").when(F.col("class_name").isNull(), "ambiguous")
    both = both.withColumn("reason", reason).select(*rows.columns, "class_name", "reason")
    return both.where("reason IS NULL").drop("reason"), both.where("reason IS NOT NULL").drop("class_name")


def translated(rows: DataFrame, mapping: DataFrame, to: tuple[str, int]) -> tuple[DataFrame, DataFrame]:
    """Rows in another taxonomy and version by a map (taxonomy, version, class_id, new_id), and those that it lacks; several ids may become one."""
    both = rows.join(F.broadcast(mapping.select(*KEY, "new_id", F.lit(True).alias("__mapped"))), list(KEY), "left")
    done = both.where("new_id IS NOT NULL").withColumns({"taxonomy": F.lit(to[0]), "version": F.lit(to[1]), "class_id": F.col("new_id")}).select(*rows.columns)
    return done, both.where("new_id IS NULL").select(*rows.columns)
