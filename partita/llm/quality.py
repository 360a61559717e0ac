"""Quality scores: hashed word n-grams under a logistic regression trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partita.llm.common import slices

_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~…«»“”’'"


@dataclass(frozen=True)
class Settings:
    """bits: log2 of the weights. sample: most labelled documents to learn from. shards: parts learnt side by side and averaged."""

    bits: int = 18
    sample: int = 20_000
    shards: int = 4
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-6
    l2: float = 1e-6
    scale: float = 16.0
    threshold: float = 0.3


def _look(word: str) -> str:
    """How a word is written: case or digits of its core, and the marks around it."""
    core = word.strip(_MARKS)
    head = word[: len(word) - len(word.lstrip(_MARKS))]
    tail = word[len(head) + len(core) :]
    if not core:
        return word[:4]
    form = "9" if core.isdigit() else "A" if core.isupper() and len(core) > 1 else "a" if core.islower() else "Aa" if core[0].isupper() and core[1:].islower() else "x"
    return f"{head[:4]}{form}{tail[:4]}"


def ngrams(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts in one array, and where each text starts.

    A word has two views: its core in lower case, and its look. Features are the words and pairs of neighbours in both views;
    a pair of equal words is one feature of its own. Words stand between white space.
    """
    cut = pc.utf8_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
    coded = pc.dictionary_encode(cut.values)
    words = coded.dictionary.to_pylist()
    crc = zlib.crc32
    core = np.fromiter((crc(w.strip(_MARKS).lower().encode(), 1) for w in words), np.uint32, len(words))
    look = np.fromiter((crc(_look(w).encode(), 2) for w in words), np.uint32, len(words))
    code = np.asarray(coded.indices, dtype=np.int64)
    offsets = np.asarray(cut.offsets, dtype=np.int64)
    if "" in words:
        full = code != words.index("")
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        code = code[full]
    core, look = core[code], look[code]
    n = len(code)
    out = np.empty((n, 4), np.uint32)
    with np.errstate(over="ignore"):
        out[:, 0], out[:, 1] = core, look
        out[1:, 2] = core[:-1] * np.uint32(0x9E3779B1) ^ core[1:]
        out[1:, 3] = look[:-1] * np.uint32(0x85EBCA77) ^ look[1:]
        out[1:, 2][code[1:] == code[:-1]] = 0x5BD1E995
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        out[first, 2], out[first, 3] = core[first] ^ np.uint32(0xC2B2AE3D), look[first] ^ np.uint32(0x27D4EB2F)
        out *= np.uint32(0x2C1B3C6D)
        out >>= np.uint32(32 - bits)
    return out.reshape(-1), offsets * 4


class Ftrl:
    """Proximal follow-the-regularised-leader for logistic loss, a learning rate for each weight."""

    def __init__(self, s: Settings):
        self.s, self.z, self.n = s, np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        s, z = self.s, self.z[at]
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, w)

    def learn(self, features: np.ndarray, label: int) -> None:
        at, count = np.unique(features, return_counts=True)
        at, x = np.append(at, 1 << self.s.bits), np.append(count * (self.s.scale / max(1, len(features))), 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """The weights, the last of them the bias.

    Learns from at most `settings.sample` labelled documents, those of the least hash, whose crc32(doc_id) mod 5 is not 0; of
    rows that repeat a doc_id it takes the text of the least hash.
    The sample is split by hash into shards; each learns on its own and the weights are averaged. Only the weights
    (2^bits doubles a shard) reach the driver. Without any usable label all weights are 0 (every score 0.5).
    """
    order = F.xxhash64("doc_id", F.lit("sample"))
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(order, "doc_id").limit(settings.sample)
    # a text a document, so that the sample bounds the rows too
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("quality").alias("quality"))
    sample = own.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(settings.shards)))

    def learn(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("doc_id")
        model, label = Ftrl(settings), shard.column("quality").to_pylist()
        flat, bounds = ngrams(shard.column("text").to_pylist(), settings.bits)
        turn = np.random.default_rng(1)
        for _ in range(settings.epochs):
            for k in turn.permutation(len(label)):
                model.learn(flat[bounds[k] : bounds[k + 1]], label[k])
        return pa.table({"n": pa.array([len(label)], pa.int64()), "weights": pa.array([model.weights().tobytes()], pa.binary())})

    parts = sample.groupBy("shard").applyInArrow(learn, "n long, weights binary").collect()
    if not parts:
        return np.zeros((1 << settings.bits) + 1)
    return np.average([np.frombuffer(p["weights"]) for p in parts], axis=0, weights=[p["n"] for p in parts])


def score_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), column: str = "quality_score") -> DataFrame:
    """All columns of `docs` and the score in `column` (0 to 1, higher: label 1 likelier); a column of that name is replaced.

    The score is the logistic function of a sparse dot product, taken over the whole text; null and empty texts get the
    bias alone. Repeated rows score alike; labels of unknown documents and null labels are skipped; of several labels of a
    document the largest counts. An empty table gives no rows.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, settings).astype(np.float32))
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    base = docs.select(*kept)
    schema = T.StructType([*base.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                flat, bounds = ngrams(batch.column("text").to_pylist(), settings.bits)
                sums = np.concatenate([[0.0], np.cumsum(w[flat], dtype=np.float64)])
                n = np.diff(bounds)
                dot = w[-1] + (sums[bounds[1:]] - sums[bounds[:-1]]) * settings.scale / np.maximum(n, 1)
                score = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, column])

    return base.mapInArrow(run, schema)
