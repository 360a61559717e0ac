"""Streaming forms: following metrics, auditing detections as they arrive, rules on a live note stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from partita.operators.audit import confidence_findings
from partita.operators.harmony import applied, candidates


def follow_metrics(epochs: DataFrame) -> DataFrame:
    """Per run of a stream (run_id, epoch, metric): latest epoch and value, best value so far. For complete or update mode."""
    return epochs.groupBy("run_id").agg(F.max("epoch").alias("epoch"), F.max_by("metric", "epoch").alias("metric"), F.max("metric").alias("best"))


def audit_batches(truth: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over a detection stream whose batches hold whole images: the findings of each batch, and the images it held.

    A batch has folders of its own (batch=n, and _images/batch=n), so one that is run again replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        seen = batch.select("image_id").distinct()
        images = truth.join(seen, "image_id", "left_semi")
        seen.write.mode("overwrite").parquet(f"{path}/_images/batch={number}")
        confidence_findings(images, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def settled_findings(spark: SparkSession, path: str) -> DataFrame:
    """What audit_batches wrote under `path` as one table: of an image that came in several batches, the findings of the last (which may be none)."""
    images, findings = (spark.read.option("basePath", folder).parquet(f"{folder}/batch=*") for folder in (f"{path}/_images", path))
    last = images.groupBy("image_id").agg(F.max("batch").alias("batch"))
    return findings.join(last, ["image_id", "batch"], "left_semi").drop("batch")


def compact_findings(spark: SparkSession, path: str, into: str) -> DataFrame:
    """Writes settled_findings sorted over all files, gravest first, to the folder `into`, and reads them back.

    Sorted by ranges, so no task sees everything. The batches are left as they are and `into` is replaced, so running it again, or after a
    batch was run again, gives the same table.
    """
    order = [F.desc("severity"), F.col("image_id"), F.col("kind"), F.col("line_no"), F.col("det_id")]
    settled_findings(spark, path).orderBy(*order).write.mode("overwrite").parquet(into)
    return spark.read.parquet(into)


FIELDS = ("chord_index", "measure", "beat", "s", "a", "t", "b")
KINDS = dict(zip(FIELDS, ("int", "int", "double", "int", "int", "int", "int")))


def _linked(key: tuple, chords: list[tuple], before: tuple | None, extra: tuple[str, ...] = ()) -> pd.DataFrame:
    """Chords in order, each with the one before: score_id, its fields, those of the one before as p_."""
    rows, n = [], len(FIELDS)
    for c in chords:
        rows.append((key[0], *c, *((before[:n]) if before is not None else (None,) * n)))
        before = c
    names = ["score_id", *FIELDS, *extra, *(f"p_{f}" for f in ("index", *FIELDS[1:]))]
    return pd.DataFrame(rows, columns=names)


def _plain(row) -> tuple:
    """A chord's fields as Python values: pandas turns whole numbers beside missing ones into floats."""
    return tuple(None if pd.isna(x) else float(x) if t == "double" else int(x) for x, t in zip(row, KINDS.values()))


class _Previous(StatefulProcessor):
    """Keeps the last chord of a score; every chord comes out with the voices of the one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", ", ".join(f"{f} {t}" for f, t in KINDS.items()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chords = [_plain(r) for r in pd.concat(list(rows)).sort_values("chord_index")[list(FIELDS)].itertuples(index=False)]
        before = self.last.get() if self.last.exists() else None
        self.last.update(chords[-1])
        yield _linked(key, chords, before)

    def close(self) -> None:
        pass


class _InOrder(StatefulProcessor):
    """Holds chords until the watermark has passed their time, then hands them out in order, each with the one before.

    State: the chords that wait (a list), the last one handed out. A timer stands at the time of each waiting chord; when one goes off, all
    chords up to the watermark leave. What comes after the watermark has passed its time is late and left out, by Spark or here.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        chord = ", ".join(f"{f} {t}" for f, t in KINDS.items()) + ", at long"
        self.waiting, self.last = handle.getListState("waiting", chord), handle.getValueState("last", chord)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        released = self.last.get()[-1] if self.last.exists() else None
        for pdf in rows:
            at = pd.DatetimeIndex(pdf["at"]).as_unit("us").asi8
            chords = [(*_plain(r), int(t)) for r, t in zip(pdf[list(FIELDS)].itertuples(index=False), at)]
            chords = [c for c in chords if released is None or c[-1] > released]
            if chords:
                self.waiting.appendList(chords)
            for t in {c[-1] // 1000 for c in chords}:
                self.handle.registerTimer(t)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000 + 999
        held = sorted(self.waiting.get(), key=lambda c: (c[-1], c[0])) if self.waiting.exists() else []
        out, rest = [tuple(c) for c in held if c[-1] <= upto], [tuple(c) for c in held if c[-1] > upto]
        if not out:  # an earlier timer of this batch has handed them out
            return
        before = self.last.get() if self.last.exists() else None
        self.last.update(out[-1])
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        pdf = _linked(key, out, before, ("at",))
        pdf["at"] = pd.to_datetime(pdf["at"], unit="us")
        yield pdf

    def close(self) -> None:
        pass


def live_violations(chords: DataFrame, delay: str | None = None) -> DataFrame:
    """Rules M1, V1, P1 and P2 on a stream of chords (score_id, chord_index, measure, beat, s, a, t, b).

    Without `delay` chords have to arrive in order within a score. With it they carry their time as `at` (a timestamp) and may come
    swapped or late by up to `delay`: each waits until the watermark has passed it, later ones are left out; the rows that leave carry `at`.
    """
    before = ", ".join(f"p_{'index' if f == 'chord_index' else f} {t}" for f, t in KINDS.items())
    now = ", ".join(f"{f} {t}" for f, t in KINDS.items())
    if delay is None:
        both = chords.groupBy("score_id").transformWithStateInPandas(_Previous(), f"score_id long, {now}, {before}", "Append", "None")
    else:
        timed = chords.select("score_id", *FIELDS, "at").withWatermark("at", delay)
        both = timed.groupBy("score_id").transformWithStateInPandas(_InOrder(), f"score_id long, {now}, at timestamp, {before}", "Append", "EventTime", eventTimeColumnName="at")
    both = both.withColumns({"tonic_midi": F.lit(None).cast("int"), "triad": F.lit(None).cast("struct<root_pc:int,quality:string>")})
    table = candidates()
    return applied(both, [c for r in ("M1", "V1", "P1", "P2") for c in table[r]], ["score_id", "chord_index", *(["at"] if delay else [])])
