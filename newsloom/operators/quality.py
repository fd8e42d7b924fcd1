"""Quality of source documents: completeness, required fields and shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shape of an institution's document, as far as its quality is judged.
SHAPE = (
    "name string, location struct<city string, state string, country string>, "
    "news_sources struct<primary struct<url string, ai_tag_url string, verified boolean>, rss_feeds array<struct<url string, active boolean, verified boolean>>>, "
    "social_media map<string, struct<url string>>, media_relations struct<page_url string, email string, phone string>, "
    "ai_research struct<has_ai_institute boolean, ai_centers array<string>, ai_focus_areas array<string>>"
)
# Weights of the parts of a completeness score, social platforms that count, and how many of a list are enough.
WEIGHTS = {"basic_info": 0.2, "news_sources": 0.3, "rss_feeds": 0.2, "social_media": 0.1, "media_relations": 0.1, "ai_research": 0.1}
PLATFORMS = ("twitter", "linkedin", "facebook", "instagram", "youtube")
ENOUGH = 3


def entry(document: Column) -> Column:
    """An institution's document as a struct; null where the text is no JSON object."""
    return F.when(F.try_parse_json(document).isNotNull(), F.from_json(document, SHAPE))


def _given(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False)).cast("int")


def _some(values: Column) -> Column:
    return (F.coalesce(F.size(values), F.lit(0)) > 0).cast("int")


def completeness(e: Column) -> Column:
    """Weighted share of the parts that an entry fills, from 0 to 1: basics, sources, feeds, platforms, media contacts, research."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    share = lambda *parts: reduce(lambda a, b: a + b, parts) / len(parts)
    primary = e["news_sources"]["primary"]
    there = (primary["url"].isNotNull() | primary["ai_tag_url"].isNotNull() | primary["verified"].isNotNull()).cast("int")
    live = F.filter(e["news_sources"]["rss_feeds"], lambda f: F.coalesce(f["active"], F.lit(False)) & F.coalesce(f["verified"], F.lit(False)))
    social = reduce(lambda a, b: a + b, (_given(F.try_element_at(e["social_media"], F.lit(p))["url"]) for p in PLATFORMS))
    parts = {
        "basic_info": share(_given(e["name"]), *(_given(e["location"][x]) for x in ("city", "state", "country"))),
        "news_sources": (F.coalesce(there, F.lit(0)) + 0.5 * _given(primary["ai_tag_url"]) + 0.5 * yes(primary["verified"])) / 2,
        "rss_feeds": F.least(F.coalesce(F.size(live), F.lit(0)) / ENOUGH, F.lit(1.0)),
        "social_media": F.least(social / ENOUGH, F.lit(1.0)),
        "media_relations": share(*(_given(e["media_relations"][x]) for x in ("page_url", "email", "phone"))),
        "ai_research": share(yes(e["ai_research"]["has_ai_institute"]), _some(e["ai_research"]["ai_centers"]), _some(e["ai_research"]["ai_focus_areas"])),
    }
    return reduce(lambda a, b: a + b, (w * parts[k] for k, w in WEIGHTS.items()))


def errors(e: Column) -> Column:
    """Required fields that an entry lacks, in order."""
    missing = {"name": _given(e["name"]) == 0, "location.state": _given(e["location"]["state"]) == 0, "news_sources.primary": e["news_sources"]["primary"].isNull()}
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), f"Missing required field: {k}") for k, bad in missing.items())))


def warnings(e: Column, reachable: Column) -> Column:
    """What is no error but should be looked at: a primary address that a probe could not reach, feeds that are active but not verified."""
    unverified = F.filter(e["news_sources"]["rss_feeds"], lambda f: F.coalesce(f["active"], F.lit(False)) & ~F.coalesce(f["verified"], F.lit(False)))
    return F.concat(
        F.array_compact(F.array(F.when(e["news_sources"]["primary"]["url"].isNotNull() & ~F.coalesce(reachable, F.lit(True)), "Primary URL not accessible"))),
        F.coalesce(F.transform(unverified, lambda f: F.concat(F.lit("RSS feed invalid: "), f["url"])), F.array().cast("array<string>")),
    )


def validated(documents: DataFrame, probes: DataFrame) -> DataFrame:
    """(id, name, errors, warnings, score) of documents (id, document), with the probes (url, ok) of their addresses.

    A text that is no JSON lacks everything; each address should be probed once, of several probes the best counts.
    """
    ok = probes.groupBy(F.col("url").alias("_url")).agg(F.bool_or("ok").alias("_ok"))
    read = documents.select("id", entry(F.col("document")).alias("e")).withColumn("_url", F.col("e.news_sources.primary.url"))
    e = F.col("e")
    return read.join(ok, "_url", "left").select(
        "id", F.coalesce(F.nullif(e["name"], F.lit("")), F.lit("Unknown")).alias("name"), errors(e).alias("errors"), warnings(e, F.col("_ok")).alias("warnings"), F.coalesce(completeness(e), F.lit(0.0)).alias("score")
    )


def schema_errors(document: Column, required: dict[str, str]) -> Column:
    """What keeps a JSON text from a shape: a note that it is no JSON, or the required paths that are missing or of another type (types of :func:`schema_of_variant`)."""
    doc = F.try_parse_json(document)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    wrong = F.array(*(F.when(kind(p).isNull() | (kind(p) == "VOID"), f"{p} is missing").when(~kind(p).startswith(t), f"{p} is not of type {t.lower()}") for p, t in required.items()))
    return F.when(document.isNull() | doc.isNull(), F.array(F.lit("no JSON"))).otherwise(F.array_compact(wrong))
