"""Corrections of source records: one schema for every report layout, matching to records, verification tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import file_name_key
from newsloom.operators.classify import containing

# Parts of filter addresses that are known to lead nowhere.
BROKEN_FILTERS = (
    "/tag/artificial-intelligence", "?topic=artificial-intelligence", "/topic/artificial-intelligence", "/tags/artificial-intelligence", "/topic/ai", "?topic=ai",
)
# Words of news pages.
NEWS_WORDS = ("news", "press release", "article", "story", "stories", "newsroom", "media", "announcements", "latest")
#: Names of one field in the report layouts, in the order in which they are tried.
LAYOUTS = {
    "name": ("name", "institution", "university"), "old_url": ("original_url", "old_url", "url"), "new_url": ("corrected_url", "new_url", "suggested_url"), "category": ("category", "type"), "place": ("place",),
}


def unified(reports: list[DataFrame]) -> DataFrame:
    """Corrections of reports in any layout as (name, old_url, new_url, category), and place where a report has one; rows without a new address fall away."""

    def one(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        pick = {k: [F.nullif(F.col(c).cast("string"), F.lit("")) for c in names if c in have] for k, names in LAYOUTS.items()}
        return df.select(*(F.coalesce(*v, F.lit(None).cast("string")).alias(k) for k, v in pick.items()))

    rows = reduce(DataFrame.unionByName, map(one, reports))
    rows = rows.withColumn("place", F.col("place").try_cast("long")) if any("place" in r.columns for r in reports) else rows.drop("place")
    return rows.where(F.col("new_url").isNotNull())


def matched(records: DataFrame, corrections: DataFrame) -> DataFrame:
    """Records (seq, name, url) with the correction that fits: the same name in the form compared across files, else one that holds the other.

    Of several corrections the first one stands, by ``place`` where they have it, else by name; it need not be
    the one with the same name. Records without one keep their address.
    """
    place = F.col("place") if "place" in corrections.columns else F.lit(0)
    c = corrections.select(file_name_key(F.col("name")).alias("r"), "new_url", place.alias("place")).where(F.length("r") >= 3)
    best = c.groupBy("r").agg(F.min(F.struct(F.coalesce("place", F.lit(0)).alias("place"), "new_url")).alias("b")).select("r", "b.*")
    own = records.withColumn("l", file_name_key(F.col("name")))
    pairs = containing(own.select("l"), best.select("r")).join(best, "r")
    pick = pairs.groupBy("l").agg(F.min_by("new_url", F.struct("place", "r")).alias("new_url"))
    return own.join(pick, "l", "left").select("seq", "name", "url", F.coalesce("new_url", "url").alias("new_url"), (F.col("new_url").isNotNull() & ~F.col("new_url").eqNullSafe(F.col("url"))).alias("changed"))


def broken_filter(address: Column, base: Column) -> Column:
    """True for a filter address of a form known to fail, unless it is the base address itself."""
    return F.coalesce((address != base) & reduce(lambda a, b: a | b, (F.contains(address, F.lit(p)) for p in BROKEN_FILTERS)), F.lit(False))


def repaired_filter(address: Column, base: Column) -> Column:
    """The filter address, or the base address where it is broken."""
    return F.when(broken_filter(address, base), base).otherwise(address)


def verification(filter_ok: Column, base_ok: Column) -> Column:
    """What two probes say of a record: ok, replace the filter address by the base, or both failed."""
    return F.when(filter_ok, "ok").when(base_ok, "replace").otherwise("both_failed")


def news_page(body: Column, name: Column) -> Column:
    """Class of a page: news of the institution, news, or no news page. Two news words or article markup make news."""
    low = F.lower(body)
    found = reduce(lambda a, b: a + b, (F.contains(low, F.lit(w)).cast("int") for w in NEWS_WORDS))
    branded = F.exists(F.split(F.lower(name), r"\s+"), lambda w: (F.length(w) > 3) & F.contains(low, w))
    markup = low.rlike('<article|class="[^"]*(?:post|article|news|story)')
    return F.when(branded & ((found >= 2) | markup), "institution_news").when(found >= 2, "news").otherwise("other")


def candidate_score(body: Column, year: str) -> Column:
    """Score of a candidate page: news words 50, the year 30, structured data 10, an institution 10."""
    low = F.lower(body)
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    return points(low.rlike("news|press|article|story"), 50) + points(F.contains(low, F.lit(year)), 30) + points(F.contains(low, F.lit("schema.org")), 10) + points(low.rlike("university|college"), 10)


def source_description(url: Column, name: Column, kind: Column, known: dict[str, str] | None = None) -> Column:
    """Description of a source by its address; ``known`` maps parts of addresses to fixed descriptions."""
    rules = [(F.contains(url, F.lit(p)), F.lit(text)) for p, text in (known or {}).items()]
    rules += [
        (F.contains(url, F.lit("/engineering")), F.concat(name, F.lit(" School of Engineering news"))),
        (F.contains(url, F.lit("/cs.")) | F.contains(url, F.lit("/computer-science")), F.concat(name, F.lit(" Computer Science news"))),
        (F.coalesce(kind, F.lit("")) != "", F.concat(name, F.lit(" - "), kind, F.lit(" news and updates"))),
    ]
    out = F.concat(name, F.lit(" official news and press releases"))
    for test, text in reversed(rules):
        out = F.when(test, text).otherwise(out)
    return out


def first_working(candidates: DataFrame, probes: DataFrame) -> DataFrame:
    """(id, url, position): the first candidate of each id (id, urls) that a probe (url, ok) found working."""
    each = candidates.select("id", F.posexplode("urls").alias("position", "url"))
    ok = probes.where(F.coalesce("ok", F.lit(False))).select("url").distinct()
    return each.join(ok, "url", "left_semi").groupBy("id").agg(F.min_by("url", "position").alias("url"), F.min("position").alias("position"))


def mismatches(rows: DataFrame) -> DataFrame:
    """Sources (verified, outcome) whose mark and outcome disagree, with what is wrong."""
    works = F.col("outcome").isin("working", "redirect_ok")
    wrong = F.when(F.col("verified") & ~works, "verified but broken").when(~F.col("verified") & works, "unverified but working")
    return rows.withColumn("mismatch", wrong).where(F.col("mismatch").isNotNull())


# Reports of batches in their layouts: where their entries stand, the names of an entry's fields, its category, and the status that it must have.
BATCHES = {
    "batches_1_2": (
        ("$.batch_1_peer_institutions.broken_urls", "name", "original_url", "corrected_url", "peer", None),
        ("$.batch_2_major_facilities.broken_urls", "name", "original_url", "corrected_url", "facility", None),
    ),
    "batch_3": (("$.broken_urls", "name", "url", "correct_url", "r1", None),),
    "batch_4": (("$.verified_urls", "name", "original_url", "url", "r1", "corrected"),),
    "batch_5": (("$.verified_urls", "name", "original_url", "url", "r1", "corrected"),),
    "batch_6": (("$.corrections", "university", "original_url", "corrected_url", "r1", None),),
}


def batch_corrections(reports: DataFrame) -> DataFrame:
    """Corrections (batch, name, old_url, new_url, category) of batch reports (batch, document), each in its own layout.

    A text that is no JSON, a batch without entries and an entry of another status give no rows; a missing old address is empty.
    """
    out = []
    for batch, parts in BATCHES.items():
        own = reports.where(F.col("batch") == batch).select("batch", F.try_parse_json("document").alias("_d"))
        for path, name, old, new, category, status in parts:
            each = own.select("batch", F.explode(F.try_variant_get("_d", path, "array<variant>")).alias("e"))
            field = lambda k: F.try_variant_get("e", f"$.{k}", "string")  # noqa: B023, E731
            if status:
                each = each.where(field("status") == status)
            out.append(each.select("batch", field(name).alias("name"), F.coalesce(field(old), F.lit("")).alias("old_url"), field(new).alias("new_url"), F.lit(category).alias("category")))
    return reduce(DataFrame.unionByName, out)


def by_category(corrections: DataFrame) -> DataFrame:
    """(category, corrections) for each of the three categories, also one without corrections."""
    every = corrections.sparkSession.createDataFrame([("peer",), ("r1",), ("facility",)], "category string")
    return every.join(corrections.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("corrections"))


def by_variation(records: DataFrame, verified: DataFrame, variations: DataFrame) -> DataFrame:
    """Records (seq, name, url) with the verified address (name, new_url) of their own name, else of a name that theirs is a variation of.

    ``variations``: (name, variation, place); the first listed one wins. Of several addresses of a name the least counts.
    """
    known = verified.groupBy("name").agg(F.min("new_url").alias("new_url"))
    own = known.toDF("name", "_own")
    other = variations.join(known, "name").groupBy(F.col("variation").alias("name")).agg(F.min_by("new_url", "place").alias("_other"))
    joined = records.join(own, "name", "left").join(other, "name", "left")
    new = F.coalesce("_own", "_other", "url")
    return joined.select("seq", "name", new.alias("url"), (~new.eqNullSafe(F.col("url"))).alias("changed"))


# What is added to a working address to find its page on the subject, in order.
TAG_SUFFIXES = ("/topic/artificial-intelligence", "/tag/artificial-intelligence", "/tags/artificial-intelligence")


def with_tag_pages(found: DataFrame, probes: DataFrame) -> DataFrame:
    """Working addresses (id, url) with the first page on the subject (tag_url) that a probe (url, ok) found working, or null."""
    bare = F.regexp_replace("url", "/+$", "")
    each = found.select("id", F.col("url").alias("_base"), F.posexplode(F.array(*(F.concat(bare, F.lit(s)) for s in TAG_SUFFIXES))).alias("_at", "url"))
    ok = probes.where(F.coalesce("ok", F.lit(False))).select("url").distinct()
    tags = each.join(ok, "url", "left_semi").groupBy("id", F.col("_base").alias("url")).agg(F.min_by("url", "_at").alias("tag_url"))
    return found.select("id", "url").join(tags, ["id", "url"], "left")


def recommendation(score: Column) -> Column:
    """What to do with a source: proceed from 85 points, with caution from 60, review by hand below 40, else skip."""
    return F.when(score >= 85, "proceed").when(score >= 60, "caution").when(score < 40, "review").otherwise("skip")
