"""Running the stages of an ingest: each on its own, failures recorded, one run at a time."""

from __future__ import annotations

import json
import time
import traceback
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.functions.text import content_hash, dedup_key
from lumbung.operators.bm25 import build_index, publish_index
from lumbung.operators.chunks import chunk_documents
from lumbung.operators.dedupe import relink
from lumbung.operators.store import latest, publish, read_latest, upsert, versions

RUN_SCHEMA = "run_id string, kind string, status string, started_at timestamp, at timestamp, stats string, errors string"


def run_stages(spark: SparkSession, run_id: str, kind: str, stages: list[tuple[str, Callable[[], dict | None]]], log: str) -> dict:
    """Runs the stages in order and appends to the run log, a folder of events: started, then ok, partial or failed.

    A stage returns its counts. One that fails is recorded, and the next ones run: the run is then partial, or failed if
    none succeeded. Runs of the same log don't overlap: each holds a lock, a file beside the log that only one can
    create; a run that finds it refuses, unless the lock is over STALE seconds old. So does one that finds a run in the
    log that began since then and hasn't ended.
    """
    release = _lock(spark, f"{log.rstrip('/')}.lock", run_id)
    try:
        return _run(spark, run_id, kind, stages, log)
    finally:
        release()


#: A lock this old is left over from a run that was lost.
STALE = 6 * 3600


def _lock(spark: SparkSession, path: str, run_id: str) -> Callable[[], None]:
    """Creates the lock file, which is atomic; returns what deletes it again."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > STALE:
        # renamed first: of several that see a stale lock, one can move it
        old = jvm.org.apache.hadoop.fs.Path(f"{path}.{run_id}.stale")
        if fs.rename(p, old):
            fs.delete(old, False)
    if not fs.createNewFile(p):
        raise RuntimeError("another run is going on")
    return lambda: fs.delete(p, False)


def _run(spark: SparkSession, run_id: str, kind: str, stages: list[tuple[str, Callable[[], dict | None]]], log: str) -> dict:

    def event(status: str, stats: dict, errors: dict) -> None:
        now = datetime.now(timezone.utc)
        spark.createDataFrame([(run_id, kind, status, began, now, json.dumps(stats), json.dumps(errors))], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(log)

    began = datetime.now(timezone.utc)
    going = [r for r in current_runs(spark, log).filter("status = 'running'").collect() if (began.replace(tzinfo=None) - r["started_at"].replace(tzinfo=None)).total_seconds() < STALE]
    if going:
        raise RuntimeError(f"run {going[0]['run_id']} is going on")
    event("running", {}, {})
    stats: dict = {}
    errors: dict = {}
    for name, stage in stages:
        t = time.time()
        try:
            stats[name] = {**(stage() or {}), "seconds": round(time.time() - t, 3)}
        except Exception as e:  # recorded, and the next stage runs
            errors[name] = "".join(traceback.format_exception_only(e))[:2000]
    status = "ok" if not errors else "failed" if not stats else "partial"
    event(status, stats, errors)
    return {"run_id": run_id, "status": status, "stats": stats, "errors": errors}


def current_runs(spark: SparkSession, log: str) -> DataFrame:
    """The last event of each run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], RUN_SCHEMA)
    return latest(spark.read.schema(RUN_SCHEMA).parquet(log), ["run_id"], [-F.unix_micros("at")])


def next_run(now: datetime, zone: str, hour: int = 1) -> datetime:
    """The next time at which it is ``hour`` o'clock in a time zone, as UTC; across changes of summer time by the clock."""
    local = now.astimezone(ZoneInfo(zone))
    at = local.replace(hour=hour, minute=0, second=0, microsecond=0, fold=0)
    if at.timestamp() <= local.timestamp():
        at = (at.replace(tzinfo=None) + timedelta(days=1)).replace(tzinfo=ZoneInfo(zone))
    return at.astimezone(timezone.utc)


def ingest_stages(spark: SparkSession, incoming: DataFrame, base: str, *, skip: frozenset[str] = frozenset()) -> list[tuple[str, Callable[[], dict | None]]]:
    """The stages of an ingest of articles (id, title, abstract, full_text, published_at, first_seen_at, source_id, doc_type,
    doi, updated_at) under ``base``: store, dedupe, chunk, index. Each reads what the ones before published and publishes
    its own tables, so that a failed stage is made up for by the next run. ``skip``: names of stages to leave out."""

    def table(name: str) -> str:
        return f"{base.rstrip('/')}/{name}"

    def store_() -> dict:
        there = versions(spark, table("articles"))
        current = read_latest(spark, table("articles")) if there else incoming.filter("false")
        merged = upsert(current, incoming, ["id"], insert_only=["first_seen_at"], keep_if_null=["full_text", "abstract"], order=[-F.unix_micros("updated_at")])
        counts = {r["action"]: r["count"] for r in merged.groupBy("action").count().collect()}  # three actions
        publish(merged.drop("action"), table("articles"))
        return counts

    def dedupe_() -> dict:
        a = read_latest(spark, table("articles"))
        keyed = a.withColumns({"content_hash": content_hash(F.col("title"), F.col("full_text")), "dedup_key": dedup_key(F.col("title"), F.col("published_at"))})
        publish(relink(keyed.select("id", "first_seen_at", "source_id", "doc_type", "doi", "content_hash", "dedup_key")).filter("duplicate_of_id is not null").select("id", "duplicate_of_id", "duplicate_reason"), table("links"))
        return {"links": read_latest(spark, table("links")).count()}

    def chunk_() -> dict:
        a = read_latest(spark, table("articles")).join(read_latest(spark, table("links")).select("id"), "id", "left_anti")
        publish(chunk_documents(a, "id", ["full_text", "abstract", "title"]), table("chunks"))
        return {"chunks": read_latest(spark, table("chunks")).count()}

    def index_() -> dict:
        c = read_latest(spark, table("chunks")).select(F.concat_ws("#", "item_id", "chunk_index").alias("chunk_id"), "content")
        return {"version": publish_index(build_index(c, "chunk_id", "content"), table("index"))}

    return [(n, f) for n, f in (("store", store_), ("dedupe", dedupe_), ("chunk", chunk_), ("index", index_)) if n not in skip]
