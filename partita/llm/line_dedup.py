"""Line dedup across documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.llm.common import ASCII_SPACE, fresh, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, salts: int = 16, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """All columns of `docs`, with `text` less its frequent lines, and the `counts` n_lines (before) and n_dropped.

    A line goes, in every document, if its key has at least `min_chars` code points and stands in at least `min_docs`
    different doc_ids. Null and empty texts are one empty line, which is never dropped; the text comes back empty, not null.
    Rows that repeat a doc_id count as one document and are each cut; null ids count as one document together. Columns of
    `docs` named as the counts are replaced. An empty table gives no rows.

    Lines are cut and hashed once, into a table of (row, position, MD5 of the key) in the shared folder; texts are shuffled
    once, to meet the list of dropped positions. The count is combined before it is shuffled, and a key's lines are spread
    over `salts` parts, so a line that a third of the documents share is no hot spot.
    """
    row, lines, pos, key, salt, drop = (fresh(docs, n) for n in ("__row", "__lines", "__pos", "__key", "__salt", "__drop"))
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.withColumn("text", text).withColumn(row, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")))

    each = base.select(row, F.posexplode(F.split("text", "\n", -1)).alias(pos, lines)).select(row, pos, line_key(F.col(lines)).alias(lines))
    each = written(each.where(F.char_length(lines) >= min_chars).select(row, pos, F.unhex(F.md5(lines)).alias(key)), "lines")
    frequent = each.groupBy(key).agg(F.count_distinct(F.struct(f"{row}.id")).alias(drop)).where(F.col(drop) >= min_docs).select(key)
    frequent = frequent.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = each.withColumn(salt, F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    dropped = salted.join(frequent, [key, salt], "left_semi").groupBy(row).agg(F.array_sort(F.collect_set(pos)).alias(drop))

    # a flag for each line up to the last dropped one: looked up by position as the lines are gone through once
    flags = F.flatten(F.transform(drop, lambda p, j: F.concat(F.array_repeat(F.lit(False), p - F.coalesce(F.get(drop, j - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))
    right = dropped.select(F.col(row).alias(row + "r"), F.size(drop).alias(pos), flags.alias(key))
    out = base.join(right, F.col(row).eqNullSafe(F.col(row + "r")), "left")
    cut = F.split("text", "\n", -1)
    kept = F.filter(cut, lambda line, i: ~F.coalesce(F.get(key, i), F.lit(False)))
    out = out.withColumn(counts[0], F.size(cut).cast("long")).withColumn(counts[1], F.coalesce(F.col(pos), F.lit(0)).cast("long"))
    out = out.withColumn("text", F.when(F.col(pos).isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept)))
    names = list(docs.columns) + [c for c in counts if c.lower() not in {x.lower() for x in docs.columns}]
    return out.select(*names)
