"""Media monitoring: attribution of outlets, keyword analysis, dashboards, early-warning rules.

Mentions are rows (issue_id, article_id, outlet_id, media_type, published_at, is_relevant, relevance, narrative_id,
actors). ``as_of`` is the time at which a window is evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbung.functions.text import domain_of, slugify
from lumbung.operators.filters import rolling

# Tokens of regional outlets' hosts, and their provinces.
REGION_TOKENS = {
    "aceh": "Aceh", "sumut": "Sumatera Utara", "medan": "Sumatera Utara", "sumbar": "Sumatera Barat", "padang": "Sumatera Barat", "riau": "Riau",
    "pekanbaru": "Riau", "jambi": "Jambi", "sumsel": "Sumatera Selatan", "palembang": "Sumatera Selatan", "babel": "Bangka Belitung",
    "lampung": "Lampung", "banten": "Banten", "jabar": "Jawa Barat", "bandung": "Jawa Barat", "jateng": "Jawa Tengah", "jogja": "DI Yogyakarta",
    "yogya": "DI Yogyakarta", "jatim": "Jawa Timur", "surabaya": "Jawa Timur", "bali": "Bali", "mataram": "Nusa Tenggara Barat",
    "kupang": "Nusa Tenggara Timur", "kalbar": "Kalimantan Barat", "pontianak": "Kalimantan Barat", "kalteng": "Kalimantan Tengah",
    "kalsel": "Kalimantan Selatan", "banjarmasin": "Kalimantan Selatan", "kaltim": "Kalimantan Timur", "kaltara": "Kalimantan Utara",
    "sulut": "Sulawesi Utara", "manado": "Sulawesi Utara", "sulteng": "Sulawesi Tengah", "palu": "Sulawesi Tengah", "sultra": "Sulawesi Tenggara",
    "kendari": "Sulawesi Tenggara", "makassar": "Sulawesi Selatan", "gorontalo": "Gorontalo", "ambon": "Maluku", "maluku": "Maluku",
    "ternate": "Maluku Utara", "papua": "Papua", "jayapura": "Papua", "papuabarat": "Papua Barat",
}


def guess_kind(domain: Column, networks: tuple[str, ...]) -> Column:
    """struct(media_type, region) of a host: a subdomain of one of the regional ``networks``, or a host label that holds a
    region's token of at least four letters; else national."""
    table = F.create_map(*(F.lit(x) for pair in REGION_TOKENS.items() for x in pair))
    of = lambda kind, region: F.struct(F.lit(kind).alias("media_type"), region.cast("string").alias("region"))
    label = F.split_part(domain, F.lit("."), F.lit(1))
    out = of("national", F.lit(None))
    for token, region in reversed([x for x in REGION_TOKENS.items() if len(x[0]) > 3]):
        out = F.when(F.contains(label, F.lit(token)), of("regional", F.lit(region))).otherwise(out)
    for network in networks:
        sub = F.element_at(F.split(F.regexp_replace(domain, r"\." + network.replace(".", r"\.") + "$", ""), r"\."), -1)
        out = F.when(domain.endswith("." + network), of("regional", F.try_element_at(table, sub))).otherwise(out)
    return out


def attribute_outlets(items: DataFrame, outlets: DataFrame, *, url: str = "source_url", networks: tuple[str, ...] = ()) -> DataFrame:
    """Items with outlet_id of the outlet whose address begins with the item's host, or a null one and the slug,
    media_type and region of the outlet to be created. Where several outlets begin so, the shortest address, then the
    smallest id. The match is an equi-join on the host, which a prefix of host characters can't give.

    Items without a host stay without an outlet.
    """
    known = outlets.select("id", domain_of(F.col("base_url")).alias("host"), F.length("base_url").alias("n")).filter("host is not null")
    known = known.groupBy("host").agg(F.min(F.struct("n", "id"))["id"].alias("outlet_id"))
    hosts = items.withColumn("host", domain_of(F.col(url)))
    kind = guess_kind(F.col("host"), networks)
    return hosts.join(known, "host", "left").withColumns({"new_slug": F.when(F.col("outlet_id").isNull() & F.col("host").isNotNull(), slugify(F.col("host"))), "guess": F.when(F.col("host").isNotNull(), kind)})


def keyword_hits(text: Column, keywords: Column) -> Column:
    """How many of the keywords a text holds, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(keywords, lambda k: (F.length(k) > 0) & F.contains(low, F.lower(k))))


def topic_prior(articles: DataFrame, topics: DataFrame, *, text: Column, id_col: str = "id", most: int = 3) -> DataFrame:
    """(id, topics, primary, confidence): up to ``most`` subjects with most keyword hits, ties by the taxonomy's order.

    The taxonomy is small and fixed, so it is one array constant beside each row: no join, no row for each pair.
    """
    rows = topics.filter("is_active").select("slug", "sort_order", "keywords").orderBy("sort_order", "slug").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 topics; join on tokens instead")
    table = F.array(*(F.struct(F.lit(r["slug"]).alias("slug"), F.lit(int(r["sort_order"])).alias("o"), F.array(*map(F.lit, r["keywords"] or [])).cast("array<string>").alias("k")) for r in rows))
    hits = F.filter(F.transform(table, lambda t: F.struct((-keyword_hits(text, t["k"])).alias("neg"), t["o"].alias("o"), t["slug"].alias("slug"))), lambda h: h["neg"] < 0)
    best = F.transform(F.slice(F.array_sort(hits), 1, most), lambda h: h["slug"])
    out = articles.select(F.col(id_col), best.alias("topics"))
    return out.withColumns({"primary_topic": F.coalesce(F.try_element_at("topics", F.lit(1)), F.lit("other")), "confidence": F.when(F.size("topics") > 0, 0.2).otherwise(0.0)})


def analyse_keywords(items: DataFrame, issues: DataFrame, *, text: Column, via: str = "via_keyword", threshold: float = 0.5) -> DataFrame:
    """(issue_id, article_id, relevance, is_relevant) of all items for each issue's keywords: .55 with two hits or more
    (being found by a keyword of the issue counts as one), .35 with one, 0 as noise.

    ``issues`` (issue_id, keywords) is a small table of definitions, refused above 1,000 rows.
    """
    defined = issues.select("issue_id", "keywords").limit(1001).collect()
    if len(defined) > 1000:
        raise ValueError("more than 1000 issues; join on tokens instead")
    each = F.array(*(F.struct(F.lit(r["issue_id"]).alias("issue_id"), F.array(*map(F.lit, r["keywords"])).alias("k")) for r in defined))
    rows = items.select(F.col("article_id"), F.explode(F.transform(each, lambda i: F.struct(i["issue_id"].alias("issue_id"), (keyword_hits(text, i["k"]) + F.coalesce(F.array_contains(i["k"], F.col(via)).cast("int"), F.lit(0))).alias("hits")))).alias("x"))
    relevance = F.when(F.col("x.hits") >= 2, 0.55).when(F.col("x.hits") == 1, 0.35).otherwise(0.0)
    return rows.select("x.issue_id", "article_id", relevance.alias("relevance")).withColumn("is_relevant", F.col("relevance") >= threshold)


def delta_pct(current: Column, previous: Column) -> Column:
    """Change in percent to one place, half to even; null if there was nothing before."""
    return F.when(previous > 0, F.bround((current - previous) * 100.0 / previous, 1))


def totals(mentions: DataFrame, as_of: str, period: int) -> DataFrame:
    """One row an issue: mentions of the period and of the one before, and the change."""
    now, then = rolling("published_at", as_of, period), rolling("published_at", as_of, period, 1)
    out = mentions.filter("is_relevant").groupBy("issue_id").agg(F.count_if(now).alias("current"), F.count_if(then).alias("previous"))
    return out.withColumn("delta_pct", delta_pct(F.col("current"), F.col("previous")))


def split_by(mentions: DataFrame, as_of: str, period: int, column: str) -> DataFrame:
    """Mentions of the period by a column, with the share of the issue's."""
    out = mentions.filter(F.col("is_relevant") & rolling("published_at", as_of, period)).groupBy("issue_id", column).agg(F.count("*").alias("mentions"))
    return out.withColumn("share_pct", F.bround(F.col("mentions") * 100.0 / F.sum("mentions").over(Window.partitionBy("issue_id")), 1))


def daily_series(mentions: DataFrame, as_of: str, period: int, kinds: list[str]) -> DataFrame:
    """One row for each issue and day of the period, with a count for each kind of medium, 0 where nothing appeared."""
    day = F.to_date("published_at")
    last = F.to_date(F.lit(as_of).cast("timestamp"))
    counted = mentions.filter(F.col("is_relevant") & rolling("published_at", as_of, period)).groupBy("issue_id", day.alias("day")).agg(*(F.count_if(F.col("media_type") == k).alias(k) for k in kinds), F.count("*").alias("total"))
    calendar = mentions.select("issue_id").distinct().select("issue_id", F.explode(F.sequence(F.date_sub(last, period - 1), last)).alias("day"))
    return calendar.join(counted, ["issue_id", "day"], "left").fillna(0, [*kinds, "total"])


def peak_day(series: DataFrame) -> DataFrame:
    """The day of most mentions of each issue, the first of equals."""
    return series.groupBy("issue_id").agg(F.min(F.struct((-F.col("total")).alias("n"), F.col("day")))["day"].alias("peak_day"), F.max("total").alias("peak_total"))


def actor_trend(mentions: DataFrame, as_of: str, period: int, top: int = 12) -> DataFrame:
    """The actors of most mentions in the period, with the period before."""
    now, then = rolling("published_at", as_of, period), rolling("published_at", as_of, period, 1)
    out = mentions.filter("is_relevant").select("issue_id", "published_at", F.explode("actors").alias("actor")).groupBy("issue_id", "actor").agg(F.count_if(now).alias("current"), F.count_if(then).alias("previous")).filter("current > 0")
    n = F.row_number().over(Window.partitionBy("issue_id").orderBy(F.desc("current"), "actor"))
    return out.withColumn("n", n).filter(F.col("n") <= top).drop("n").withColumn("delta_pct", delta_pct(F.col("current"), F.col("previous")))


def active_counts(mentions: DataFrame, as_of: str, period: int) -> DataFrame:
    """Distinct outlets, narratives and actors of the period; mentions without an actor aren't counted in any."""
    rows = mentions.filter(F.col("is_relevant") & rolling("published_at", as_of, period)).select("issue_id", "outlet_id", "narrative_id", F.explode("actors").alias("actor"))
    return rows.groupBy("issue_id").agg(F.count_distinct("outlet_id").alias("outlets"), F.count_distinct("narrative_id").alias("narratives"), F.count_distinct("actor").alias("actors"))


def _window(as_of: str, fresh: int, prior: int) -> tuple[Column, Column]:
    at = F.lit(as_of).cast("timestamp")
    now = F.col("published_at") > at - F.expr(f"INTERVAL {fresh} DAYS")
    return now, (F.col("published_at") <= at - F.expr(f"INTERVAL {fresh} DAYS")) & (F.col("published_at") > at - F.expr(f"INTERVAL {fresh + prior} DAYS"))


def iso_week(as_of: str) -> Column:
    at = F.lit(as_of).cast("timestamp")
    return F.concat(F.extract(F.lit("YEAROFWEEK"), at).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), at).cast("string"), 2, "0"))


def volume_spikes(mentions: DataFrame, as_of: str, *, recent: int = 3, baseline: int = 14, ratio: float = 2.0, high: float = 3.0, least: int = 6) -> DataFrame:
    """Issues whose daily rate of the last days is ``ratio`` times that of the days before (at least .5 a day)."""
    now, then = _window(as_of, recent, baseline)
    out = mentions.filter("is_relevant").groupBy("issue_id").agg(F.count_if(now).alias("recent"), F.count_if(then).alias("baseline"))
    out = out.withColumn("ratio", (F.col("recent") / F.lit(recent)) / F.greatest(F.col("baseline") / F.lit(baseline), F.lit(0.5)))
    out = out.filter((F.col("recent") >= least) & (F.col("ratio") >= ratio))
    return out.select("issue_id", "recent", "baseline", F.bround("ratio", 6).alias("ratio"), F.when(F.col("ratio") >= high, "high").otherwise("medium").alias("severity"), F.bround(F.least(0.5 + F.least(F.col("ratio") / 10, F.lit(0.45)), F.lit(0.99)), 2).alias("confidence"), F.concat(F.lit("volume_spike:"), iso_week(as_of)).alias("dedup_key"))


def new_actors(mentions: DataFrame, as_of: str, *, fresh: int = 7, prior: int = 30, least: int = 4) -> DataFrame:
    """Actors with ``least`` mentions in the last days and none in the days before."""
    now, then = _window(as_of, fresh, prior)
    out = mentions.filter("is_relevant").select("issue_id", "published_at", F.explode("actors").alias("actor")).groupBy("issue_id", "actor").agg(F.count_if(now).alias("fresh"), F.count_if(then).alias("prior"))
    out = out.filter((F.col("fresh") >= least) & (F.col("prior") == 0))
    return out.select("issue_id", "actor", "fresh", F.bround(0.5 + F.least(F.col("fresh") / 15, F.lit(0.4)), 2).alias("confidence"), F.concat(F.lit("new_actor:"), F.substring(F.replace(F.lower("actor"), F.lit(" "), F.lit("-")), 1, 60)).alias("dedup_key"))


def regional_spread(mentions: DataFrame, as_of: str, *, fresh: int = 7, prior: int = 30, least: int = 5, share: float = 0.20, growth: float = 1.8) -> DataFrame:
    """Issues of which regional media have a material and newly grown share."""
    now, then = _window(as_of, fresh, prior)
    regional = F.col("media_type") == "regional"
    out = mentions.filter("is_relevant").groupBy("issue_id").agg(F.count_if(regional & now).alias("fresh_regional"), F.count_if(now).alias("fresh_total"), F.count_if(regional & then).alias("prior_regional"), F.count_if(then).alias("prior_total"))
    a, b = F.col("fresh_regional") / F.nullif(F.col("fresh_total"), F.lit(0)), F.coalesce(F.col("prior_regional") / F.nullif(F.col("prior_total"), F.lit(0)), F.lit(0.0))
    out = out.withColumns({"fresh_share": a, "prior_share": b}).filter((F.col("fresh_regional") >= least) & (F.col("fresh_share") >= share) & (F.col("fresh_share") >= growth * F.greatest(F.col("prior_share"), F.lit(0.02))))
    return out.select("issue_id", "fresh_regional", "fresh_total", F.bround("fresh_share", 6).alias("fresh_share"), F.bround("prior_share", 6).alias("prior_share"), F.bround(0.5 + F.least(F.col("fresh_share"), F.lit(0.4)), 2).alias("confidence"))


def new_narratives(mentions: DataFrame, narratives: DataFrame, as_of: str, *, fresh: int = 7, least: int = 3) -> DataFrame:
    """Narratives (narrative_id, slug, created_by, first_seen_at) that a model named in the last days, with ``least``
    relevant mentions at any time."""
    recent = narratives.filter((F.col("created_by") == "llm") & (F.col("first_seen_at") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {fresh} DAYS")))
    out = mentions.filter("is_relevant").join(recent, "narrative_id").groupBy("issue_id", "narrative_id", "slug").agg(F.count("*").alias("articles")).filter(F.col("articles") >= least)
    return out.withColumns({"confidence": F.bround(0.55 + F.least(F.col("articles") / 20, F.lit(0.35)), 2), "dedup_key": F.concat(F.lit("new_narrative:"), "slug")})


def discovered_outlets(attributed: DataFrame) -> DataFrame:
    """(host, slug, media_type, region): the outlets to be added for items of attribute_outlets whose host no outlet has,
    one of each host."""
    new = attributed.filter(F.col("outlet_id").isNull() & (F.col("host") != "")).groupBy("host").agg(F.min("new_slug").alias("slug"), F.min("guess").alias("guess"))
    return new.select("host", "slug", "guess.media_type", "guess.region")


def dashboard(mentions: DataFrame, as_of: str, period: int, kinds: list[str]) -> DataFrame:
    """One row an issue: mentions of the period and of the one before with the change, its outlets, the split by kind of
    medium, and the day of most mentions. ``mentions``: issue_id, outlet_id, media_type, published_at, is_relevant."""
    here = mentions.filter("is_relevant")
    by = split_by(here, as_of, period, "media_type").groupBy("issue_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("mentions")).alias("o"), "media_type", "mentions", "share_pct"))).alias("by_type"))
    outlets = here.filter(rolling("published_at", as_of, period)).groupBy("issue_id").agg(F.count_distinct("outlet_id").alias("outlets"))
    peak = peak_day(daily_series(here, as_of, period, kinds).filter("total > 0"))
    out = totals(here, as_of, period).join(outlets, "issue_id", "left").join(by, "issue_id", "left").join(peak, "issue_id", "left")
    return out.withColumns({"outlets": F.coalesce("outlets", F.lit(0)), "by_type": F.coalesce("by_type", F.array())})


#: What an alert says, by the rule that found it.
ALERT_TITLES = {"volume_spike": "Volume spike: {}", "new_narrative": "New narrative: {}", "new_actor": "New actor: {}", "regional_spread": "Regional spread: {}"}


def detect_alerts(mentions: DataFrame, narratives: DataFrame, existing: DataFrame, as_of: str, *, least_spike: int = 6, least_actor: int = 4, least_regional: int = 5, least_narrative: int = 3) -> DataFrame:
    """Alerts of all four rules that aren't in ``existing`` (issue_id, dedup_key): issue_id, rule, dedup_key, severity, title
    (200 characters at most), confidence (0.99 at most, two places) and up to six evidence ids, the newest first."""
    week = iso_week(as_of)
    parts = [
        volume_spikes(mentions, as_of, least=least_spike).select("issue_id", F.lit("volume_spike").alias("rule"), F.concat(F.lit("volume:"), week).alias("dedup_key"), "severity", F.col("recent").cast("string").alias("what"), "confidence", F.lit(None).cast("string").alias("actor"), F.lit(None).cast("int").alias("narrative_id")),
        new_narratives(mentions, narratives, as_of, least=least_narrative).select("issue_id", F.lit("new_narrative").alias("rule"), "dedup_key", F.lit("medium").alias("severity"), F.col("slug").alias("what"), "confidence", F.lit(None).cast("string").alias("actor"), F.col("narrative_id").cast("int").alias("narrative_id")),
        new_actors(mentions, as_of, least=least_actor).select("issue_id", F.lit("new_actor").alias("rule"), "dedup_key", F.lit("medium").alias("severity"), F.col("actor").alias("what"), "confidence", "actor", F.lit(None).cast("int").alias("narrative_id")),
        regional_spread(mentions, as_of, least=least_regional).select("issue_id", F.lit("regional_spread").alias("rule"), F.concat(F.lit("regional:"), week).alias("dedup_key"), F.lit("high").alias("severity"), F.bround(100 * F.col("fresh_share"), 0).cast("int").cast("string").alias("what"), "confidence", F.lit(None).cast("string").alias("actor"), F.lit(None).cast("int").alias("narrative_id")),
    ]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    titles = F.create_map(*(F.lit(x) for k, v in ALERT_TITLES.items() for x in (k, v.replace("{}", ""))))
    found = found.withColumns({"title": F.substring(F.concat(F.element_at(titles, F.col("rule")), F.col("what")), 1, 200), "confidence": F.bround(F.least("confidence", F.lit(0.99)), 2)})
    found = found.join(existing.select("issue_id", "dedup_key"), ["issue_id", "dedup_key"], "left_anti")
    # the newest six of each issue, actor or narrative: ranked before anything is collected
    recent = mentions.filter(F.col("is_relevant") & (F.col("published_at") > F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 14 DAYS")))
    keys = [F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("int").alias("n")), F.struct(F.lit(None).cast("string").alias("a"), F.col("narrative_id").cast("int").alias("n"))]
    each = recent.select("issue_id", "article_id", "published_at", F.explode(F.concat(F.array(*keys), F.transform("actors", lambda a: F.struct(a.alias("a"), F.lit(None).cast("int").alias("n"))))).alias("k"))
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("issue_id", "k").orderBy(F.desc("published_at"), "article_id"))).filter("r <= 6")
    ids = each.groupBy("issue_id", "k").agg(F.array_sort(F.collect_list(F.struct("r", "article_id")))["article_id"].alias("evidence_ids"))
    out = found.alias("f").join(ids.alias("i"), (F.col("f.issue_id") == F.col("i.issue_id")) & F.col("f.actor").eqNullSafe(F.col("i.k.a")) & F.col("f.narrative_id").eqNullSafe(F.col("i.k.n")), "left")
    return out.select("f.issue_id", "rule", "dedup_key", "severity", "title", "confidence", "evidence_ids")
