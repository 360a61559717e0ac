"""The queries of this package, their parameters for the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.llm.alignment import Vocabularies, align_tokenizers
from partita.llm.ann import nearest
from partita.llm.bpe import bpe_round_trip
from partita.llm.collocations import collocations
from partita.llm.common import table
from partita.llm.licenses import scan_licenses
from partita.llm.line_dedup import dedup_lines
from partita.llm.mips import top_products
from partita.llm.near_dedup import near_duplicates
from partita.llm.packing import pack_documents
from partita.llm.quality import Settings, score_quality
from partita.llm.repair import token_files
from partita.llm.sharding import shard_records
from partita.llm.simhash import simhash_duplicates


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS d FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.d, c.d), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def pack(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), min_docs=10).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM frequent)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM frequent)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    score = F.col("quality_score")
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), F.when(score >= Settings().threshold, 1).otherwise(0).alias("predicted"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, similarity=80)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents"), weights=[1.0] * 8)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3, seed=42)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, inside=50, top=2000)


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]')) AS piece FROM documents)
), starts AS (
  SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM pieces WHERE len(w) > 0
), grams AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM starts, (SELECT unnest([1, 2, 3]) AS size) WHERE i + size - 1 <= len(w)
), f AS (
  SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY lang, size, phrase
), totals AS (
  SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10
), inner_ AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE size = 3
  ) GROUP BY lang, phrase
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_ i ON c.lang = i.lang AND c.phrase = i.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.a
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : size], ' ') AS tail
  FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.n AS l, y.n AS r, (1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n) AS score
  FROM cuts c JOIN f x ON c.lang = x.lang AND c.head = x.phrase JOIN f y ON c.lang = y.lang AND c.tail = y.phrase
), worst AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS turn FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst WHERE turn = 1
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, CAST(r.score AS BIGINT) AS score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE r.rank <= 2000
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = Vocabularies(_vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))
    return align_tokenizers(table(spark, sf_dir, "documents"), files, b_size=32_000)


QUERIES = {
    "op1_ann": op1_ann,
    "op2_bpe": op2_bpe,
    "op3_token_files": op3_token_files,
    "op4_licenses": op4_licenses,
    "op5_topk": op5_topk,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_near_dedup": op9_near_dedup,
    "op10_sharding": op10_sharding,
    "op11_simhash": op11_simhash,
    "op12_collocations": op12_collocations,
    "op13_alignment": op13_alignment,
}
ORACLES = {"op5_topk": OP5_SQL, "op7_line_dedup": OP7_SQL, "op12_collocations": OP12_SQL}
