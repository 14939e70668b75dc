"""Staged harvests as tables: OAI-PMH XML, WordPress JSON, RSS and Atom feeds, keyword news search, PDF files.

Fetching belongs to a crawler; these read what it staged, in parallel, with the schemas stated so that nothing is
inferred. Incremental reads push the time of the last harvest into the file listing by ``modifiedAfter``.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbung.functions.text import article_url_of, citation_fields, doi_of, feed_time, galley_of, html_to_text, parse_date

_DC = ("title", "creator", "subject", "description", "publisher", "date", "type", "format", "identifier", "source", "language", "relation", "rights")
_HEADER = T.StructType([T.StructField("_status", T.StringType()), T.StructField("identifier", T.StringType()), T.StructField("datestamp", T.StringType())])
OAI_SCHEMA = T.StructType([T.StructField("header", _HEADER), T.StructField("metadata", T.StructType([T.StructField("oai_dc:dc", T.StructType([T.StructField(f"dc:{n}", T.ArrayType(T.StringType())) for n in _DC]))]))])
_RENDERED = T.StructType([T.StructField("rendered", T.StringType())])
WORDPRESS_SCHEMA = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("date", "modified", "link", "slug", "type", "_post_type")), *(T.StructField(n, _RENDERED) for n in ("title", "excerpt", "content"))])
ITEM_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "link", "guid", "id", "description", "summary", "pubDate", "published", "updated")])


def read_oai(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Records of ListRecords pages: (external_id, datestamp, empty, title, the repeated fields as arrays, url, doi,
    pdf_url, galley_id, journal, volume, issue, pages, issn, published_at). Deleted records are left out; a record
    without metadata comes out with ``empty``."""
    reader = spark.read.format("xml").option("rowTag", "record").schema(OAI_SCHEMA)
    raw = (reader.option("modifiedAfter", since) if since else reader).load(path)
    dc = {n: F.coalesce(F.col(f"metadata.`oai_dc:dc`.`dc:{n}`"), F.array().cast("array<string>")) for n in _DC}
    rows = raw.filter(~F.col("header._status").eqNullSafe("deleted")).select(
        F.col("header.identifier").alias("external_id"), F.col("header.datestamp").alias("datestamp"), F.col("metadata.`oai_dc:dc`").isNull().alias("empty"),
        F.try_element_at(dc["title"], F.lit(1)).alias("title"), dc["creator"].alias("authors"), dc["subject"].alias("keywords"), F.nullif(F.trim(F.array_join(dc["description"], "\n\n")), F.lit("")).alias("abstract"),
        F.try_element_at(dc["publisher"], F.lit(1)).alias("publisher"), parse_date(F.try_element_at(dc["date"], F.lit(1))).alias("published_at"), F.try_element_at(dc["language"], F.lit(1)).alias("declared_language"),
        article_url_of(dc["identifier"]).alias("url"), doi_of(dc["identifier"]).alias("doi"), galley_of(dc["relation"]).alias("g"), citation_fields(dc["source"]).alias("c"),
    )
    return rows.select("*", "g.pdf_url", "g.galley_id", "c.journal", "c.volume", "c.issue", "c.pages", "c.issn").drop("g", "c")


def _posts(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    schema = T.StructType([*WORDPRESS_SCHEMA.fields, T.StructField("broken", T.StringType())])
    reader = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken")
    return (reader.option("modifiedAfter", since) if since else reader).json(path).withColumn("path", F.col("_metadata.file_path"))


def wordpress_failures(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """(path, message): the dead letters of read_wordpress, pages and posts that can't be read or have no id."""
    bad = _posts(spark, path, since).filter("id is null or broken is not null")
    return bad.select("path", F.substring(F.coalesce(F.concat(F.lit("can't be read: "), "broken"), F.lit("no id")), 1, 2000).alias("message"))


def stage_wordpress(fetch: Callable[[str], tuple[bytes, dict]], site: str, kinds: list[str], save: Callable[[str, bytes], None], *, since: str | None = None, per_page: int = 100) -> tuple[int, list[tuple[str, str]]]:
    """Walks the pages of each kind of post and hands each body to ``save`` under a name of its own; returns how many there
    were, and the pages that failed with why. The first page's X-WP-TotalPages says how many there are; a page that fails
    is recorded, and the walk goes on; a body that isn't a list is no page."""
    count, failed = 0, []
    for kind in kinds:
        page, last = 1, 1
        while page <= last:
            where = f"{site.rstrip('/')}/wp-json/wp/v2/{kind}?per_page={per_page}&page={page}" + (f"&modified_after={since}" if since else "")
            try:
                body, headers = fetch(where)
                last = max(last, int({k.lower(): v for k, v in headers.items()}.get("x-wp-totalpages", last)))
                if body.lstrip()[:1] == b"[":
                    save(f"{kind}-{page:05d}.json", body)
                    count += 1
                else:
                    failed.append((where, "not a list of posts"))
            except Exception as e:  # recorded; the other pages are still walked
                failed.append((where, f"{type(e).__name__}: {e}"[:2000]))
            page += 1
    return count, failed


def read_wordpress(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Posts of staged REST pages (arrays of posts; other pages are skipped): plain title, body and excerpt, the body's
    stand-in, and full_text_status: extracted, abstract or none."""
    raw = _posts(spark, path, since).filter("id is not null")
    rows = raw.select(F.col("id").cast("string").alias("external_id"), F.coalesce("_post_type", "type").alias("doc_type"), F.col("link").alias("url"), parse_date(F.col("date")).alias("published_at"), F.col("modified"), html_to_text("title.rendered").alias("title"), F.nullif(html_to_text("content.rendered"), F.lit("")).alias("body"), F.nullif(html_to_text("excerpt.rendered"), F.lit("")).alias("abstract"))
    return rows.withColumns({"title": F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)")), "full_text": F.coalesce("body", "abstract"), "full_text_status": F.when(F.col("body").isNotNull(), "extracted").when(F.col("abstract").isNotNull(), "abstract").otherwise("none")}).drop("body")


def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Items of RSS 2.0 (``item``) or Atom (``entry``) files: (external_id, url, title, summary, published_at). An item
    needs a title and a link or an id; summaries are plain text of at most 2000 characters."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(ITEM_SCHEMA).load(path)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    rows = raw.select(blank("title").alias("title"), blank("link").alias("url"), F.coalesce(blank("guid"), blank("id"), blank("link")).alias("external_id"), F.substring(html_to_text(F.coalesce(blank("description"), blank("summary"))), 1, 2000).alias("summary"), feed_time(F.coalesce(blank("pubDate"), blank("published"), blank("updated"))).alias("published_at"))
    return rows.filter(F.col("title").isNotNull() & F.col("external_id").isNotNull())


def search_seeds(issues: DataFrame, most: int = 15) -> DataFrame:
    """(issue_id, keyword) of the searches to run: the first keywords of each issue."""
    return issues.select("issue_id", F.explode(F.slice("keywords", 1, most)).alias("keyword"))


SEARCH_SCHEMA = T.StructType([*ITEM_SCHEMA.fields, T.StructField("source", T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_url", T.StringType())]))])


def read_search(spark: SparkSession, path: str) -> DataFrame:
    """Items of staged news-search feeds: (external_id, url, title, source_name, source_url, published_at). The name of the
    source is taken from the end of the title; an item needs a title, a link and its source's address."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(SEARCH_SCHEMA).load(path)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    rows = raw.select(blank("link").alias("url"), F.coalesce(blank("guid"), blank("link")).alias("external_id"), blank("title").alias("t"), blank("source._VALUE").alias("source_name"), blank("source._url").alias("source_url"), feed_time(blank("pubDate")).alias("published_at"))
    rows = rows.withColumn("title", F.coalesce(news_title(F.col("t"), F.col("source_name")), "t"))
    return rows.filter("title is not null and url is not null and source_url is not null").select("external_id", "url", "title", "source_name", "source_url", "published_at")


def news_title(title: F.Column, source: F.Column) -> F.Column:
    """A search result's title without the source's name at its end."""
    suffix = F.concat(F.lit(" - "), source)
    return F.when(F.endswith(title, suffix), F.trim(F.substring(title, F.lit(1), F.length(title) - F.length(suffix)))).otherwise(title)


def read_pdfs(spark: SparkSession, path: str, extract: Callable[[bytes], Iterable]) -> DataFrame:
    """(path, pages, failed_pages, error) of PDF files. ``extract`` turns a file's bytes, on the executors, into its pages: a
    text each, or a function that reads it. A page that fails is an empty one, and its number, from 1, stands in
    ``failed_pages``; a file that fails has no further pages, and ``error`` says why."""

    def run(batches):
        for b in batches:
            rows = []
            for content in b["content"]:
                pages, failed, error = [], [], None
                try:
                    for n, page in enumerate(extract(bytes(content)), 1):
                        try:
                            pages.append((page() if callable(page) else page) or "")
                        except Exception as e:  # one broken page mustn't lose the others
                            pages.append("")
                            failed.append(n)
                            error = error or f"page {n}: {type(e).__name__}: {e}"[:2000]
                except Exception as e:  # one broken file mustn't stop the stage
                    error = f"{type(e).__name__}: {e}"[:2000]
                rows.append((pages, failed, error))
            yield b[["path"]].assign(pages=[r[0] for r in rows], failed_pages=[r[1] for r in rows], error=[r[2] for r in rows])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, pages array<string>, failed_pages array<int>, error string")


def get_with_retry(url: str, tries: int = 4, wait: float = 1.0, open_: Callable = urllib.request.urlopen) -> bytes:
    """The body of an address; timeouts, 408, 429, 5xx and lost connections are tried again after 1, 2, 4 ... times
    ``wait`` seconds; other answers of 4xx are final."""
    for n in range(tries):
        try:
            with open_(url) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code not in (408, 429) and e.code < 500 or n == tries - 1:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if n == tries - 1:
                raise
        time.sleep(wait * 2**n)
    raise RuntimeError("no try was allowed")
