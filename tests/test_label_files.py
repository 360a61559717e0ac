"""Label files read by their index: the rows of a reading by folder, in few tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from partita.sources import readers, writers


def test_files_by_index(spark, tmp_path):
    texts = spark.range(300).select(F.col("id").alias("image_id"), F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "x 1 2 3 4\n5 .1 .2 .3 .4").otherwise("1 .5 .5 .1 .1\n\n2 .1 .2 .3").alias("text"))
    folder = f"file://{tmp_path}/labels"
    index = writers.write_labels(texts, folder)
    rows = readers.read_label_files(index, folder)
    assert rows.rdd.getNumPartitions() == 1  # a task a few thousand files, where the text source takes one for every 32
    assert readers.read_label_files(index, folder, share=100).rdd.getNumPartitions() == 3
    key = lambda df: sorted((r.file.rsplit("/", 1)[1], r.line_no, r.class_id, r.cx) for r in df.collect())
    assert key(rows) == key(readers.read_labels(spark, f"{folder}/*.txt")) and rows.count() == 200


def test_the_label_folder_query_lists_no_folder(spark, data, monkeypatch):
    from partita.plans.catalog import QUERIES

    def no(*_, **__):
        raise AssertionError("read by listing")

    monkeypatch.setattr(readers, "read_labels", no)
    rows = QUERIES["s1_label_folder"](spark, data)
    assert rows.count() == spark.read.parquet(f"{data}/lineitem.parquet").count()
