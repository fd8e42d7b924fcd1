"""Configuration documents of sources in their generations, read into one shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.dedup import first_of_each
from newsloom.operators.reconcile import primary_source

_SOURCE = "type string, url string, description string, verified boolean, crawl_priority int, last_verified string"
_PLACE = "city string, state string, country string"
FIRST = "name string, news_url string, location string, focus_areas array<string>"
_ENTRY = f"id int, name string, abbreviation string, canonical_name string, location struct<{_PLACE}>, domains struct<primary:string>, facility_type string"
SECOND = f"{_ENTRY}, news_sources struct<primary struct<url:string,ai_tag_url:string,verified:boolean,crawl_priority:int,notes:string>>"
THIRD = f"{_ENTRY}, news_sources array<struct<{_SOURCE}>>"
SERVICE = "id int, name string, url string, verified boolean, rss_feeds string"
COLUMNS = ("seq", "name", "url", "ai_tag_url", "verified", "crawl_priority", "location", "kind", "rss_feed", "generation")

# Parts of addresses that stand for a missing one.
PLACEHOLDERS = ("placeholder", "example.com", "todo")


def generation(document: str):
    """Generation of a document (text column): a list is the first, sources as an object the second, as an array the third."""
    doc = F.parse_json(document)
    first = F.try_variant_get(doc, "$.universities[0].news_sources[0]", "variant")
    fac = F.try_variant_get(doc, "$.facilities[0].news_sources[0]", "variant")
    return (
        F.when(F.ltrim(document).startswith("["), 1)
        .when(F.try_variant_get(doc, "$.news_services", "variant").isNotNull(), 4)
        .when(F.coalesce(first, fac).isNotNull(), 3)
        .otherwise(2)
    )


def _place():
    """Number of an entry: its document's number and its place in the document, side by side."""
    return F.shiftleft(F.col("seq").cast("long"), 32) + F.col("i")


def _shape(df: DataFrame, **columns) -> DataFrame:
    kinds = {"seq": "long", "verified": "boolean", "crawl_priority": "int", "generation": "int"}
    return df.select(*(columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def normalised(documents: DataFrame) -> DataFrame:
    """One row per source of documents (seq, document): first, second and third generation and news services.

    The primary source stands for an institution; without one the first source does. Documents that are
    no JSON give no rows.
    """
    docs = documents.where(F.try_parse_json("document").isNotNull()).withColumn("g", generation("document"))
    place = F.trim(F.concat_ws(", ", "e.location.city", "e.location.state"))
    one = docs.where("g = 1").select("seq", F.posexplode(F.from_json("document", f"array<struct<{FIRST}>>")).alias("i", "e"))
    rows = [_shape(one, seq=_place(), name=F.col("e.name"), url=F.col("e.news_url"), verified=F.lit(True), location=F.col("e.location"), kind=F.lit("university"), generation=F.lit(1))]
    for g, schema in ((2, SECOND), (3, THIRD)):
        for key, kind in (("universities", "university"), ("facilities", "facility")):
            e = docs.where(F.col("g") == g).select("seq", F.posexplode(F.from_json("document", f"{key} array<struct<{schema}>>")[key]).alias("i", "e"))
            s = F.col("e.news_sources.primary") if g == 2 else primary_source(F.col("e.news_sources"))
            rows.append(
                _shape(
                    e, seq=_place(), name=F.coalesce("e.canonical_name", "e.name"), url=s["url"], ai_tag_url=s["ai_tag_url"] if g == 2 else F.lit(None),
                    verified=F.coalesce(s["verified"], F.lit(True)), crawl_priority=s["crawl_priority"], location=place, kind=F.lit(kind), generation=F.lit(g),
                )
            )
    services = docs.where("g = 4").select("seq", F.posexplode(F.from_json("document", f"news_services array<struct<{SERVICE}>>")["news_services"]).alias("i", "e"))
    feed = F.coalesce(F.get_json_object("e.rss_feeds", "$.main"), F.when(~F.col("e.rss_feeds").startswith("{"), F.col("e.rss_feeds")))
    rows.append(_shape(services, seq=_place(), name=F.col("e.name"), url=F.col("e.url"), verified=F.coalesce("e.verified", F.lit(True)), kind=F.lit("service"), rss_feed=feed, generation=F.lit(4)))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def eligible(sources: DataFrame, prefer_tag: bool = False, prefer_feed: bool = False) -> DataFrame:
    """Sources with an address worth crawling (crawl_url): verified, and no placeholder; the first of each address."""
    url = F.coalesce(F.nullif(F.col("rss_feed"), F.lit("")) if prefer_feed else F.lit(None), F.nullif(F.col("ai_tag_url"), F.lit("")) if prefer_tag else F.lit(None), F.nullif(F.col("url"), F.lit("")))
    low = F.lower("crawl_url")
    fit = sources.withColumn("crawl_url", url).where(F.col("crawl_url").isNotNull() & F.col("verified"))
    for p in PLACEHOLDERS:
        fit = fit.where(~F.contains(low, F.lit(p)))
    return first_of_each(fit, ["crawl_url"], [F.col("seq")])


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(seq, path, document) of whole files; a path that is missing is left out."""
    from pyspark.errors import AnalysisException

    out = None
    for i, p in enumerate(paths):
        try:
            d = spark.read.text(p, wholetext=True).select(F.lit(i).cast("long").alias("seq"), F.lit(p).alias("path"), F.col("value").alias("document"))
        except AnalysisException:
            continue
        out = d if out is None else out.unionByName(d)
    return out if out is not None else spark.createDataFrame([], "seq long, path string, document string")


# Files of sources by their kind, and those that are read where all are wanted.
FILES = {
    "legacy": "universities.json", "r1": "r1_universities.json", "top_public": "top_public_universities.json", "top_universities": "top_universities.json", "peer_institutions": "peer_institutions.json",
    "meta_news": "meta_news_services.json", "major_facilities": "major_facilities.json", "national_laboratories": "national_laboratories.json", "global_institutions": "global_institutions.json",
}
ALL = ("peer_institutions", "r1", "major_facilities", "national_laboratories", "global_institutions")


def chosen_files(kind: str = "legacy", listed: str = "", own: str | None = None, services: bool = False) -> list[str]:
    """Files of sources to read: a list given (parted by commas) excludes all else; then all kinds, a file of one's own, or the file of a kind; news services are added on demand."""
    if listed:
        return [p.strip() for p in listed.split(",") if p.strip()]
    kind = kind.lower()
    files = [FILES[k] for k in ALL] if kind == "all" else [own or FILES.get(kind, FILES["legacy"])]
    return files + [FILES["meta_news"]] * (services and FILES["meta_news"] not in files)
