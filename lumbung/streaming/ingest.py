"""Structured Streaming twins: event-time windows, deduplication, idempotent upserts, and the tag parser of an answer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lumbung.operators.store import exists, remove, upsert

LATENESS = "2 days"
#: Snapshots of an upserted stream that stay beside the newest.
KEPT = 3


def stream_table(spark: SparkSession, path: str, schema: T.StructType, time: str) -> DataFrame:
    """Parquet files of a folder or a pattern as a stream whose ``time`` is a zoned timestamp; zone-less ones are taken as
    UTC. A single file must be given by a pattern, such as its name with ``*``."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(events: DataFrame, time: str, keys: list[str], *, length: str = "1 day", slide: str | None = None, lateness: str | None = LATENESS) -> DataFrame:
    """Counts in tumbling or sliding windows; the same expression serves a batch and a stream."""
    rows = events.withWatermark(time, lateness) if lateness and events.isStreaming else events
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def first_deliveries(events: DataFrame, time: str, keys: list[str], lateness: str | None = LATENESS) -> DataFrame:
    """One event of each key. In a stream, keys are forgotten when they are ``lateness`` behind the newest event, and an
    event that comes later than that after it, in a later micro-batch, is lost; with None nothing is forgotten or lost,
    and the state grows with the keys."""
    if not events.isStreaming or lateness is None:
        return events.dropDuplicates(keys)
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def harvest_since(runs: DataFrame, source: str | None = None, overlap_days: int = 2) -> DataFrame:
    """One row (since): the day of the last good run of a source less the overlap; null for a first, full harvest."""
    good = runs.filter(F.col("status").isin("ok", "partial") & F.col("kind").isin("full", "incremental"))
    if source is not None:
        good = good.filter(F.col("source") == source)
    return good.agg(F.date_sub(F.to_date(F.max("started_at")), overlap_days).alias("since"))


def upsert_stream(events: DataFrame, target: str, keys: list[str], checkpoint: str, **how) -> StreamingQuery:
    """Runs all available files through an upsert into ``target``, a folder of snapshot versions: each batch writes the
    snapshot of its own number from the one before, so a batch that is run again gives the same.

    Only the first batch may find no snapshot; if a later one doesn't find a whole one, or can't read it, it fails and
    writes nothing. Snapshots more than KEPT batches old are deleted."""
    spark = events.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        before = f"{target}/batch={number - 1}"
        if exists(spark, f"{before}/_SUCCESS"):
            current = spark.read.schema(batch.schema).parquet(before)
        elif number:
            raise FileNotFoundError(f"the snapshot before is missing: {before}")
        else:
            current = spark.createDataFrame([], batch.schema)
        upsert(current, batch, keys, **how).drop("action").write.mode("overwrite").parquet(f"{target}/batch={number}")
        if number > KEPT:
            remove(spark, f"{target}/batch={number - KEPT - 1}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class TagStream:
    """Splits an answer that arrives in pieces into text, tagged findings and the no-evidence mark.

    ``feed`` yields ("delta", text), ("finding", text) and ("no_evidence", ""); what could be the start of a tag is held
    back until it is known.
    """

    def __init__(self, finding: str = "finding", no_evidence: str = "no_evidence") -> None:
        self.opening, self.closing = f"<{finding}>", f"</{finding}>"
        self.marks = (f"<{no_evidence}>", f"<{no_evidence}/>", f"</{no_evidence}>")
        self.held, self.inside, self.found = "", False, ""

    def _partial(self, tags: tuple[str, ...]) -> int:
        """Length of the end of what is held that may begin one of the tags."""
        return max((n for t in tags for n in range(1, min(len(t), len(self.held) + 1)) if self.held.endswith(t[:n])), default=0)

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.held += piece
        while True:
            tags = (self.closing,) if self.inside else (self.opening, *self.marks)
            hits = [(self.held.find(t), t) for t in tags if t in self.held]
            if not hits:
                break
            at, tag = min(hits)
            before, self.held = self.held[:at], self.held[at + len(tag) :]
            if tag == self.closing:
                yield "finding", (self.found + before).strip()
                self.found, self.inside = "", False
                continue
            if before:
                yield "delta", before
            if tag == self.opening:
                self.inside = True
            elif not tag.startswith("</"):
                yield "no_evidence", ""
        keep = self._partial(tags)
        ready, self.held = self.held[: len(self.held) - keep], self.held[len(self.held) - keep :]
        if self.inside:
            self.found += ready
        elif ready:
            yield "delta", ready

    def close(self) -> Iterator[tuple[str, str]]:
        """What is left when the stream ends; an unclosed finding counts as one."""
        rest = self.found + self.held
        if rest:
            yield ("finding", rest.strip()) if self.inside else ("delta", rest)
        self.held = self.found = ""
        self.inside = False


class AnswerStream:
    """An answer in sections, read piece by piece: what is in <answer> comes out as it arrives, each bullet of <findings>
    once when its line is whole, and <no_evidence> as one event that ends all. What is outside of sections is dropped."""

    SECTIONS = ("answer", "findings", "no_evidence")

    def __init__(self) -> None:
        self.held, self.section, self.line, self.done = "", "", "", False
        self.findings: list[str] = []

    def _bullets(self, text: str, last: bool) -> Iterator[tuple[str, str]]:
        *whole, self.line = (self.line + text).split("\n")
        if last:
            whole, self.line = [*whole, self.line], ""
        for item in (x.strip().lstrip("-*").strip() for x in whole):
            if item and item not in self.findings:
                self.findings.append(item)
                yield "finding", item

    def _out(self, text: str, last: bool) -> Iterator[tuple[str, str]]:
        if self.section == "answer" and text:
            yield "delta", text
        elif self.section == "findings":
            yield from self._bullets(text, last)
        elif self.section == "no_evidence":
            self.line += text
            if last:
                yield "no_evidence", self.line.strip()
                self.line, self.done = "", True

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.held += piece
        while not self.done:
            tags = [f"</{self.section}>"] if self.section else [f"<{s}>" for s in self.SECTIONS]
            low = self.held.lower()
            at, tag = min(((low.find(t), t) for t in tags if t in low), default=(-1, ""))
            if at < 0:
                keep = max((n for t in tags for n in range(1, len(t)) if low.endswith(t[:n])), default=0)
                ready, self.held = self.held[: len(self.held) - keep], self.held[len(self.held) - keep :]
                yield from self._out(ready, False)
                return
            text, self.held = self.held[:at], self.held[at + len(tag) :]
            if self.section:
                yield from self._out(text, True)
                self.section = ""
            else:
                self.section = tag.strip("<>")
