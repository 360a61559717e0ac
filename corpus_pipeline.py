"""The corpus pipeline: quality, lines, near copies, packing. Part of the corpus package partita.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partita.llm.common import fresh, table, written
from partita.llm.line_dedup import dedup_lines
from partita.llm.near_dedup import near_duplicates
from partita.llm.quality import Settings, score_quality
from partita.llm.registry import pack

#: No SQL: the classifier is trained, and packing runs over token ids. Tests hold the stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with the columns of `docs`.

    Null and empty texts score by the bias alone. Repeated rows score alike, so they stay or go together; rows without a
    doc_id are scored like any other; extra columns of any name are kept. An empty table gives no rows.
    """
    score = fresh(docs, "quality_score")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), column=score)
    return scored.where(F.col(score) >= Settings().threshold).select(*docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents hold, with the columns of `docs`; n_chars counts what is left.

    Null texts come back empty. Rows that repeat a doc_id count as one document, rows without one as one together; each is
    cut. Extra columns of any name are kept (only n_chars is renewed). An empty table gives no rows.
    """
    counts = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    cut = dedup_lines(docs, min_docs=10, counts=counts)
    return cut.select(*[F.char_length("text").cast("long").alias(c) if c.lower() == "n_chars" else c for c in docs.columns])


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one of the smallest doc_id.

    Null and empty texts are near copies of nothing. Of rows that share a doc_id one stays (the text of the least hash, ties
    by the other columns); rows without a doc_id all stay. Extra columns of any name are kept. An empty table gives no rows.
    """
    kept = near_duplicates(docs, words=5, similarity=80).where("kept AND doc_id IS NOT NULL").select("doc_id")
    turn = fresh(docs, "turn")
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and "variant" not in kind]  # those that have an order
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), *others))
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").withColumn(turn, one).where(F.col(turn) == 1).select(*docs.columns)
    return named.union(docs.where("doc_id IS NULL"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in windows of up to 1024 tokens.

    Null and empty texts are one end id. Repeated rows are documents of their own, a null doc_id stays null, extra columns are
    left out. An empty table gives no rows.
    """
    return pack(docs)


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("near_copies", near_copies_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
