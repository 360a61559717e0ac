"""Derived views of the given tables in the shapes that the operators take.

The SQL runs unchanged in Spark and in DuckDB; every value is integer-exact up to one final division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHORDS = """SELECT l_orderkey AS score_id,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate)-1 AS INT) AS chord_index,
 CAST(CASE WHEN l_suppkey%2=0 THEN 67+l_partkey%12 ELSE 62+(l_orderkey+l_linenumber*5)%17 END AS INT) AS s,
 CAST(CASE WHEN l_suppkey%2=0 THEN 60+l_partkey%12 ELSE 58+(l_partkey+l_linenumber)%13 END AS INT) AS a,
 CAST(CASE WHEN l_suppkey%2=0 THEN 51+l_partkey%12+l_orderkey%2 ELSE 50+(l_suppkey+l_linenumber*3)%13 END AS INT) AS t,
 CAST(CASE WHEN l_suppkey%2=0 THEN 48-12*(l_orderkey%2)+l_partkey%12 ELSE 40+(l_suppkey*7+l_orderkey)%13 END AS INT) AS b,
 CAST(CASE WHEN l_orderkey%5=0 THEN NULL ELSE 60+l_orderkey%12 END AS INT) AS tonic_midi,
 CASE WHEN l_orderkey%2=0 THEN 'major' ELSE 'minor' END AS mode,
 CAST(1+l_linenumber AS INT) AS measure, CAST(1+l_quantity%4 AS DOUBLE) AS beat
FROM lineitem"""

BOXES = """SELECT l_partkey AS image_id,
 CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey,l_linenumber,l_suppkey,l_quantity,l_extendedprice,l_shipdate) AS INT) AS line_no,
 CAST((l_suppkey%11)*3 AS INT) AS class_id,
 CAST((l_orderkey*7919+l_linenumber*104729)%1000 AS DOUBLE)/1000 AS cx,
 CAST((l_orderkey*6101+l_suppkey*3571)%1000 AS DOUBLE)/1000 AS cy,
 CAST(20+(l_orderkey*31+l_linenumber)%180 AS DOUBLE)/1000 AS w,
 CAST(20+(l_orderkey*17+l_suppkey)%180 AS DOUBLE)/1000 AS h,
 l_orderkey*8+l_linenumber AS k
FROM lineitem"""

DETECTIONS = f"""SELECT image_id, line_no AS det_id,
 CAST(CASE WHEN k%13=0 THEN (class_id+3)%33 ELSE class_id END AS INT) AS class_id,
 CAST(100+(k*37)%900 AS DOUBLE)/1000 AS conf,
 cx+CAST((k*17)%21-10 AS DOUBLE)/1000 AS cx,
 cy+CAST((k*23)%21-10 AS DOUBLE)/1000 AS cy, w, h
FROM ({BOXES}) boxes WHERE k%10<>0"""

#: The second model of the fusion queries: another choice of confidences and shifts.
DETECTIONS_2 = DETECTIONS.replace("(k*37)", "((k+1)*37)").replace("(k*17)", "((k+1)*17)").replace("(k*23)", "((k+1)*23)")

EPOCHS = """SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS epoch, value AS metric, ts FROM events"""

#: Corner form of boxes in thousandths, which keeps every coordinate exact in both engines.
CORNERS = f"SELECT image_id, line_no, class_id, k, cx, cy, w, h, cx-w/2 AS x1, cy-h/2 AS y1, cx+w/2 AS x2, cy+h/2 AS y2 FROM ({BOXES}) b"
DET_CORNERS = f"SELECT image_id, det_id, class_id, conf, cx, cy, w, h, cx-w/2 AS x1, cy-h/2 AS y1, cx+w/2 AS x2, cy+h/2 AS y2 FROM ({DETECTIONS}) d"
DET_CORNERS_2 = f"SELECT image_id, det_id, class_id, conf, cx, cy, w, h, cx-w/2 AS x1, cy-h/2 AS y1, cx+w/2 AS x2, cy+h/2 AS y2 FROM ({DETECTIONS_2}) d"


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str, deal: str | None = None) -> DataFrame:
    """A derived view over the tables of `sf_dir`, which go in as DataFrames: the session's own views stay as they are. deal: a column by which rows are dealt before anything is computed."""
    frames = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in tables or ("lineitem",)}
    if deal:
        frames = {name: df.repartition(deal) for name, df in frames.items()}
    for name in frames:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **frames)


def chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CHORDS)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CORNERS)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DET_CORNERS)


def by_image(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """boxes and detections from one shuffle: the line items are dealt by image before anything is computed from them, so the rows of an image stand in one partition of either."""
    one, two = (view(spark, sf_dir, sql, deal="l_partkey") for sql in (CORNERS, DET_CORNERS))
    return one, two


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("prefix"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


LABEL_LINES = "SELECT doc_id AS file_id, source AS prefix, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents)"


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EPOCHS, "events")
