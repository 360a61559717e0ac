"""Writers: label text, findings, summaries, training lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_texts(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, text: an image's label lines in order, six decimals; an empty text for an image without boxes."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "w", "h")
    texts = boxes.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    if images is boxes:  # every image has a box
        return texts
    return images.select("image_id").distinct().join(texts, "image_id", "left").fillna("", ["text"])


def write_labels(texts: DataFrame, path: str) -> DataFrame:
    """A label file for each image (image_id, text) in the folder `path`, named by its image; gives the index (file, bytes) of what was written.

    Tasks write their own rows through Arrow's file systems; a repeated task writes the same files again. The index is itself a table
    beside the files, under _index.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        system.create_dir(root, recursive=True)
        for batch in batches:
            files, sizes = [], []
            for image, text in zip(batch.column("image_id").to_pylist(), batch.column("text").to_pylist()):
                data = f"{text}\n".encode() if text else b""
                with system.open_output_stream(f"{root}/{image}.txt") as out:
                    out.write(data)
                files.append(f"{image}.txt")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(sizes, pa.int64())], ["file", "bytes"])

    texts.select(F.col("image_id").cast("string").alias("image_id"), "text").mapInArrow(put, "file string, bytes long").write.mode("overwrite").parquet(f"{path}/_index")
    return texts.sparkSession.read.parquet(f"{path}/_index")


def write_findings(findings: DataFrame, path: str) -> None:
    """CSV by severity, largest first, over range partitions."""
    findings.orderBy(F.desc("severity")).write.mode("overwrite").csv(path, header=True)


def summary_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_training_list(repeats: DataFrame, path: str) -> None:
    """Paths (path, repeat), each as often as it says."""
    repeats.select(F.explode(F.array_repeat("path", F.col("repeat"))).alias("value")).write.mode("overwrite").text(path)
