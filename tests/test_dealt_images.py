"""Images dealt over partitions that adaptive execution joins: the parts of an image stay together."""

from __future__ import annotations

from pyspark.sql import functions as F

from partita.operators import assembly


def test_measures_where_partitions_are_joined(spark, tmp_path):
    images = spark.range(4000).withColumnRenamed("id", "image_id")
    images.select("image_id", F.explode(F.array(*[F.struct(F.lit(k).alias("sym_id"), F.lit(100.0 * k).alias("x")) for k in (1, 2, 3)])).alias("s")).select("image_id", "s.*").write.parquet(f"{tmp_path}/notes")
    images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("k")).select("image_id", (250.0 + F.col("k") / 4).alias("x")).write.parquet(f"{tmp_path}/bars")
    notes, bars = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("notes", "bars"))
    sizes = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        dealt = assembly.measures(notes.repartition("image_id"), bars.repartition("image_id"))
        for found in (assembly.measures(notes, bars), dealt):
            counts = found.groupBy("sym_id", "measure").count().collect()
            assert sorted(map(tuple, counts)) == [(1, 1, 4000), (2, 1, 4000), (3, 2, 4000)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
