"""Writing without MERGE: snapshots of upserts, latest-wins views, versioned tables, dead letters, revisions."""

from __future__ import annotations

import hashlib
import json
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first by ``order``. An aggregate, so that equal keys are combined where they lie."""
    columns = [c for c in df.columns if c not in keys]
    ranked = df.withColumn("o__", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))
    best = ranked.groupBy(*keys).agg(F.min_by(F.struct(*columns), "o__").alias("r__"))
    return best.select(*keys, *(F.col(f"r__.{c}").alias(c) for c in columns)).select(*df.columns)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], *, insert_only: list[str] | None = None, keep_if_null: list[str] | None = None, locked: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """The next snapshot: rows of ``current`` updated by ``incoming`` and new ones added, with ``action`` (kept, updated
    or inserted). Repeated keys in ``incoming`` count once: the first by ``order``.

    ``insert_only`` columns keep their first value; ``keep_if_null`` ones keep it where the new one is null; columns named
    in the row's ``locked`` array aren't changed. Null keys match null-safely.
    """
    insert_only, keep_if_null = insert_only or [], keep_if_null or []
    fields = [c for c in current.columns if c not in keys]
    new = latest(incoming, keys, order or [F.xxhash64(*incoming.columns)])
    a = current.select(*(F.col(c).alias(f"a_{c}") for c in current.columns), F.lit(True).alias("in_a"))
    b = new.select(*(F.col(c).alias(f"b_{c}") for c in new.columns), F.lit(True).alias("in_b"))
    on = None
    for k in keys:
        part = F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
        on = part if on is None else on & part
    both = a.join(b, on, "full_outer")
    here, there = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    out = [F.coalesce(F.col(f"a_{k}"), F.col(f"b_{k}")).alias(k) for k in keys]
    for c in fields:
        if c not in new.columns or c == locked:
            out.append(F.col(f"a_{c}").alias(c) if c not in new.columns else F.when(here, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c))
            continue
        fresh = F.coalesce(F.col(f"b_{c}"), F.col(f"a_{c}")) if c in keep_if_null else F.col(f"b_{c}")
        held = F.lit(c in insert_only)
        if locked:
            held = held | F.array_contains(F.coalesce(F.col(f"a_{locked}"), F.array().cast("array<string>")), F.lit(c))
        out.append(F.when(~there, F.col(f"a_{c}")).when(~here, F.col(f"b_{c}")).when(held, F.col(f"a_{c}")).otherwise(fresh).alias(c))
    action = F.when(~there, "kept").when(here, "updated").otherwise("inserted").alias("action")
    return both.select(*out, action)


def insert_absent(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``incoming`` whose key isn't stored yet, one of each key: on conflict, nothing."""
    return latest(incoming, keys, order or [F.xxhash64(*incoming.columns)]).join(current.select(*keys), keys, "left_anti")


def skip_known_titles(incoming: DataFrame, stored: DataFrame, *, outlet: str = "outlet_id", title: str = "title", only: Column | None = None) -> DataFrame:
    """Incoming items without those (of ``only``, if given) whose outlet already has the title, in any case, stored or
    earlier in the batch by (published_at, external_id)."""
    mark = only if only is not None else F.lit(True)
    keyed = incoming.withColumns({"t__": F.lower(title), "m__": F.coalesce(mark, F.lit(False))})
    known = stored.select(F.col(outlet), F.lower(title).alias("t__")).distinct()
    first = keyed.groupBy(outlet, "t__").agg(F.min(F.struct(F.col("m__"), F.col("published_at"), F.col("external_id"))).alias("f__"))
    fresh = keyed.filter("m__").join(known, [outlet, "t__"], "left_anti").join(first, [outlet, "t__"])
    fresh = fresh.filter(F.struct(F.col("m__"), F.col("published_at"), F.col("external_id")).eqNullSafe(F.col("f__"))).drop("f__")
    return keyed.filter("not m__").unionByName(fresh).drop("t__", "m__")


def replace_groups(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with all rows of the keys in ``incoming`` replaced by its rows: delete and insert in one step."""
    return current.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def split_valid(df: DataFrame, valid: Column, stage: str, message: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and dead letters (stage, external_id, message, raw) of the others."""
    ok = F.coalesce(valid, F.lit(False))
    bad = df.filter(~ok).select(F.lit(stage).alias("stage"), F.col("external_id").cast("string").alias("external_id"), F.substring(F.lit(message), 1, 2000).alias("message"), F.to_json(F.struct(*df.columns)).alias("raw"))
    return df.filter(ok), bad


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, changed) of rows that differ: a map from field to (before, after), null-safe."""
    a = before.select(key, *(F.col(c).alias(f"a_{c}") for c in fields))
    b = after.select(key, *(F.col(c).alias(f"b_{c}") for c in fields))
    text = lambda c: F.col(c).cast("string")
    entries = F.array_compact(F.array(*(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.struct(F.lit(c).alias("k"), F.struct(text(f"a_{c}").alias("before"), text(f"b_{c}").alias("after")).alias("v"))) for c in fields)))
    return a.join(b, key).select(key, entries.alias("e")).filter(F.size("e") > 0).select(key, F.map_from_entries("e").alias("changed"))


def append_numbers(rows: DataFrame, existing: DataFrame, key: str, order: list[str], seq: str = "seq") -> DataFrame:
    """New rows numbered on from the highest number of their key; the first of a new key is 1."""
    top = existing.groupBy(key).agg(F.max(seq).alias("top__"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.join(top, key, "left").withColumn(seq, (F.coalesce("top__", F.lit(0)) + n).cast("int")).drop("top__")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def versions(spark: SparkSession, base: str, whole: bool = True) -> list[int]:
    """Published versions of a table, oldest first; without ``whole``, also those that are still being written."""
    fs, p, _ = _fs(spark, base)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and (not whole or exists(spark, f"{base}/{n}/_SUCCESS")))


def publish(df: DataFrame, base: str, keep: int = 3) -> int:
    """Writes the next version of a table and drops versions more than ``keep`` - 1 older. A reader sees a version only
    when it is whole, so the swap is atomic."""
    spark = df.sparkSession
    there = versions(spark, base)
    version = (there[-1] if there else 0) + 1
    df.write.mode("overwrite").parquet(posixpath.join(base, f"version={version}"))
    for old in there:
        if old <= version - keep:
            remove(spark, posixpath.join(base, f"version={old}"))
    return version


def read_latest(spark: SparkSession, base: str) -> DataFrame:
    """The newest whole version of a published table."""
    there = versions(spark, base)
    if not there:
        raise FileNotFoundError(f"nothing is published under {base}")
    return spark.read.parquet(posixpath.join(base, f"version={there[-1]}"))


def audit_row(ids: Column, scores: Column, most_ids: int = 50, most_scores: int = 10) -> list[Column]:
    """What a search leaves in the audit log: the first ids, and the first scores to five places."""
    return [F.slice(ids, 1, most_ids).alias("retrieved_chunk_ids"), F.transform(F.slice(scores, 1, most_scores), lambda x: F.bround(x, 5)).alias("top_scores")]


def event_frame(event: str, data: dict) -> str:
    """One server-sent event on one data line."""
    return f"event: {event}\ndata: {json.dumps(data, ensure_ascii=False, default=str)}\n\n"


def record_failures(failures: DataFrame, most: int = 2000) -> DataFrame:
    """Dead letters as they are stored: the message cut to ``most`` characters, nulls as an empty one."""
    return failures.withColumn("message", F.substring(F.coalesce("message", F.lit("")), 1, most))


def lock_fields(locked: Column, changed: Column) -> Column:
    """The fields that an editor's hand protects: those before and those just changed, each once."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(locked, empty), F.coalesce(changed, empty)))


def archive(articles: DataFrame, chunks: DataFrame, ids: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(articles, chunks) after the archiving of ``ids`` (id): rows stay, marked archived with a time; chunks go."""
    marked = articles.join(ids.select("id").distinct().withColumn("gone__", F.lit(True)), "id", "left")
    gone = F.col("gone__").isNotNull()
    kept = [c for c in articles.columns if c not in ("processing_status", "deleted_at")]
    old = F.col("deleted_at") if "deleted_at" in articles.columns else F.lit(None).cast("timestamp")
    rows = marked.select(*kept, F.when(gone, "archived").otherwise(F.col("processing_status")).alias("processing_status"), F.when(gone, F.coalesce(old, at)).otherwise(old).alias("deleted_at"))
    return rows, chunks.join(ids.select(F.col("id").alias("article_id")), "article_id", "left_anti")


def visible(rows: DataFrame, owner: str | None = None) -> DataFrame:
    """Rows that aren't deleted, of one owner if one is asked for."""
    out = rows.filter(F.col("deleted_at").isNull())
    return out if owner is None else out.filter(F.col("user_id") == owner)


def set_duplicate(links: DataFrame, article: str, target: str | None, known: DataFrame) -> DataFrame:
    """``links`` (id, duplicate_of_id, duplicate_reason) after an editor linked ``article`` to ``target``, or with None
    unlinked it. Both are kept as manual, so that no later run changes them. A link to itself, or to an article that
    isn't ``known`` (id), is refused."""
    if article == target:
        raise ValueError("an article can't duplicate itself")
    if target is not None and known.filter(F.col("id") == target).limit(1).count() == 0:
        raise ValueError(f"no such article: {target}")
    kind = links.schema["id"].dataType
    row = links.sparkSession.range(1).select(F.lit(article).cast(kind).alias("id"), F.lit(target).cast(kind).alias("duplicate_of_id"), F.lit("manual").alias("duplicate_reason"))
    return links.filter(F.col("id") != article).select("id", "duplicate_of_id", "duplicate_reason").unionByName(row)


def get_or_create(existing: DataFrame, wanted: DataFrame, *, group: str = "issue_id", most: int = 12, label_length: int = 120) -> DataFrame:
    """New rows of ``wanted`` (group, slug, label, created_by, seen_at) that aren't in ``existing`` (group, slug,
    created_by): one of each slug, labels cut, and of those that a model made only as many as a group may have in all."""
    fresh = wanted.withColumn("label", F.substring("label", 1, label_length)).groupBy(group, "slug").agg(F.min_by(F.struct("label", "created_by", "seen_at"), F.struct("seen_at", "label")).alias("r"))
    fresh = fresh.join(existing.select(group, "slug"), [group, "slug"], "left_anti").select(group, "slug", "r.*")
    have = existing.filter("created_by = 'llm'").groupBy(group).agg(F.count("*").alias("have__"))
    n = F.row_number().over(Window.partitionBy(group, F.col("created_by") == "llm").orderBy("seen_at", "slug"))
    out = fresh.withColumn("n__", n).join(have, group, "left")
    return out.filter((F.col("created_by") != "llm") | (F.col("n__") + F.coalesce("have__", F.lit(0)) <= most)).drop("n__", "have__")


def ranked_labels(assigned: DataFrame, known: DataFrame, *, key: str = "article_id", labels: str = "topics", other: str = "other") -> DataFrame:
    """(key, slug, rank, is_primary): the ranked labels of each row, the first place of one that is named twice, without
    those that aren't ``known`` (slug); where the first is unknown, or there is none, ``other`` is the primary."""
    places = assigned.select(key, F.posexplode(labels).alias("at", "slug")).groupBy(key, "slug").agg(F.min("at").alias("at"))
    first = assigned.select(key, F.try_element_at(labels, F.lit(1)).alias("slug"))
    lost = first.join(known.select("slug"), "slug", "left_anti").select(key, F.lit(other).alias("slug"), F.lit(-1).alias("at"))
    rows = places.join(known.select("slug"), "slug", "left_semi").select(key, "slug", "at").unionByName(lost).groupBy(key, "slug").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return rows.withColumn("rank", rank).select(key, "slug", "rank", (F.col("rank") == 1).alias("is_primary"))


def overwrite_given(current: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``current`` with the last change of each key (``at`` decides): a null in a change leaves the column as it is."""
    last = changes.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"new__{c}") for c in columns))
    out = current.join(last, key, "left")
    return out.withColumns({c: F.coalesce(f"new__{c}", c) for c in columns}).drop(*(f"new__{c}" for c in columns))


def roll_up_vectors(articles: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with their new vectors, articles with embedded_count): vectors (item_id, embedding, model) are written to
    their chunks (item_id, article_id), and each article's are counted and joined back."""
    written = chunks.drop("embedding", "model").join(vectors, "item_id", "left")
    counts = written.filter("embedding is not null").groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("n__"))
    return written, articles.join(counts, "id", "left").withColumn("embedded_count", F.coalesce("n__", F.lit(0))).drop("n__")


def matched_by_position(items: DataFrame, verdicts: DataFrame, fallback: Column) -> DataFrame:
    """Items (batch, position, ...) with the verdict that answers their position in the batch, or ``fallback``."""
    first = verdicts.groupBy("batch", "position").agg(F.min("verdict").alias("verdict"))
    return items.join(first, ["batch", "position"], "left").withColumn("verdict", F.coalesce("verdict", fallback))


class Newest:
    """A published table that a long-running reader follows: ``table()`` is the version read last, ``refresh()`` moves on
    to a newer whole one and says whether it did. A version with less than ``least_rows`` rows is refused, so that a
    failed export doesn't replace a good one."""

    def __init__(self, spark: SparkSession, base: str, least_rows: int = 1) -> None:
        self.spark, self.base, self.least = spark, base, least_rows
        self.version, self.refused, self._table = 0, set(), None

    def refresh(self) -> bool:
        new = [v for v in versions(self.spark, self.base) if v > self.version and v not in self.refused]
        for v in reversed(new):
            df = self.spark.read.parquet(posixpath.join(self.base, f"version={v}"))
            if df.limit(self.least).count() >= self.least:
                self.version, self._table = v, df
                return True
            self.refused.add(v)
        return False

    def table(self) -> DataFrame:
        if self._table is None and not self.refresh():
            raise FileNotFoundError(f"nothing usable is published under {self.base}")
        return self._table


def apply_seeds(spark: SparkSession, base: str, seeds: list[tuple[str, str, DataFrame]]) -> list[str]:
    """Publishes seed tables once: (name, content, table) in the order of their names. What was applied is kept with a
    digest of ``content``; a seed that was changed since is refused, as others may have built on it. Returns the names
    applied now."""
    ledger = posixpath.join(base, "seeds_applied")
    done = {r["name"]: r["digest"] for r in spark.read.parquet(ledger).collect()} if exists(spark, ledger) else {}  # one row a seed
    new = []
    for name, content, table in sorted(seeds, key=lambda s: s[0]):
        digest = hashlib.sha256(content.encode()).hexdigest()
        if name in done:
            if done[name] != digest:
                raise ValueError(f"seed {name} was changed after it had been applied")
            continue
        publish(table, posixpath.join(base, name))
        spark.createDataFrame([(name, digest)], "name string, digest string").coalesce(1).write.mode("append").parquet(ledger)
        new.append(name)
    return new
