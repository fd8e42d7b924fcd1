"""URL functions as column expressions: normal form, parts, hashes, corrections and candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track the reader.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid")

_PARTS = r"^(?:([a-z][a-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, f"(?s){_PARTS}", group)


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encoded(x: Column) -> Column:
    # form encoding leaves "*" and escapes "~"; query strings are written the other way round
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normal_query(query: Column) -> Column:
    """A query string without tracking and blank parameters, repeated keys together in first-seen order."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p.contains("=") & ~p.rlike("^[^=]*=$")),
        lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), _decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")),
    )
    kept = F.filter(pairs, lambda p: ~p["k"].isin(*TRACKING) & (p["v"] != ""))
    keys = F.array_distinct(F.transform(kept, lambda p: p["k"]))
    grouped = F.flatten(F.transform(keys, lambda k: F.filter(kept, lambda p: p["k"] == k)))
    return F.array_join(F.transform(grouped, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def normalized(url: Column) -> Column:
    """The normal form of a URL: lower case, no tracking or blank parameters, no fragment, no slash at the end.

    The root's slash stays. Null stays null; text that is no URL keeps its path part.
    """
    low = F.lower(url)
    scheme, host, path, query = (_part(low, i) for i in (1, 2, 3, 4))
    # parameters belong to the last segment only
    params = F.regexp_extract(path, "(;[^/]*)$", 1)
    base = F.regexp_replace(path, ";[^/]*$", "")
    bare = F.when(base == "/", base).otherwise(F.regexp_replace(base, "/+$", ""))
    q = normal_query(query)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(low.rlike(r"^(?:[a-z][a-z0-9+.-]*:)?//"), F.concat(F.lit("//"), host)).otherwise(""),
        bare,
        params,
        F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""),
    )


def url_hash(url: Column) -> Column:
    """SHA-256 of the normal form, in hex."""
    return F.sha2(normalized(url), 256)


def authority(url: Column) -> Column:
    """Host with its port, in lower case; empty where there is none."""
    return _part(F.lower(url), 2)


def base_domain(host: Column) -> Column:
    """The last two labels of a host; the host itself if it has fewer."""
    labels = F.split(F.regexp_replace(host, r":\d+$", ""), r"\.")
    return F.when(F.size(labels) < 2, host).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def short_id(url: Column) -> Column:
    """Twelve hex digits of the URL's SHA-256, as stable file names use them."""
    return F.substring(F.sha2(url, 256), 1, 12)


def date_in(url: Column) -> Column:
    """Date that the path names as /yyyy/mm/dd/ or /yyyy/mm/ (the month's first day); null if none or no real date."""
    y, m = (F.regexp_extract(url, r"/(20\d{2})/(\d{2})(?:/(\d{2}))?(?=/|$)", i) for i in (1, 2))
    d = F.regexp_extract(url, r"/(20\d{2})/(\d{2})(?:/(\d{2}))?(?=/|$)", 3)
    return F.when(y != "", F.try_to_date(F.concat_ws("-", y, m, F.when(d != "", d).otherwise("01")), "yyyy-MM-dd"))


# Links to follow, links to leave, pages that only list others.
FOLLOW = (r"/news/", r"/press-releases?/", r"/media/", r"/research/", r"/stories?/", r"/articles?/", r"/\d{4}/\d{2}/", r"/posts?/", r"/features?/")
LEAVE = (
    r"/(tag|category|author|archive|section|search|login|admin|calendar|events|galleries)/", r"/archives/\d{4}/", r"/stories/archives/", r"/news/?$",
    r"/news-events/?$", r"/news-and-events/?$", r"/press-releases/?$", r"/features-articles/?$", r"/accolades-honors/?$",
    r"/news/(features|accolades|honors|announcements|updates)/?$", r"/articles/?$", r"/stories/?$", r"\.(pdf|jpg|jpeg|png|gif|zip|rar|exe)$",
)
LISTING = (
    r"/news/?$", r"/news-events/?$", r"/press-releases?/?$", r"/news-releases?/?$", r"/media/?$", r"/stories/?$", r"/articles/?$", r"/category/[^/]+/?$",
    r"/tag/[^/]+/?$", r"/archive/?$", r"/latest[^/]*/?$", r"/the-latest[^/]*/?$", r"/all-news/?$", r"/recent[^/]*/?$", r"/section/[^/]+/?$",
)
LISTING_TITLES = (
    r"News\s*$", r"News & Events", r"News and Events", r"Press Releases?\s*$", r"News Releases?\s*$", r"Media\s*$", r"Stories\s*$", r"Articles\s*$", r"Latest News",
    r"Latest Stories", r"All News", r"All Stories", r"[\p{L}\p{N}_]+\s+News\s*$", r"Features & Articles", r"Accolades & Honors", r"The Latest News", r"Recent News",
    r"Archive", r"News Archive",
)


def any_of(patterns: tuple[str, ...]) -> str:
    """One alternation of patterns."""
    return "(?:" + "|".join(patterns) + ")"


def followed(url: Column) -> Column:
    """True for links that lead to articles."""
    return url.rlike(any_of(FOLLOW)) & ~url.rlike(any_of(LEAVE))


def listing_url(url: Column) -> Column:
    """True for addresses of pages that only list articles."""
    return url.rlike(f"(?i){any_of(LISTING)}")


def listing_title(title: Column) -> Column:
    """True for titles of pages that only list articles: from the start, or ending in the word archive."""
    return title.rlike(f"(?i)^{any_of(LISTING_TITLES)}") | title.rlike(r"(?i)Archives?\s*$")


def correction(url: Column) -> Column:
    """First correction to try for an address that failed: the other scheme, else the slash at the end."""
    return (
        F.when(url.rlike("(?i)^http://"), F.regexp_replace(url, "(?i)^http://", "https://"))
        .when(url.rlike("(?i)^https://"), F.regexp_replace(url, "(?i)^https://", "http://"))
        .when(url.endswith("/"), F.regexp_replace(url, "/+$", ""))
        .otherwise(F.concat(url, F.lit("/")))
    )


# Where newsrooms are usually found on a domain.
NEWS_PLACES = ("https://news.{}", "https://www.{}/news", "https://www.{}/news/", "https://newsroom.{}", "https://today.{}", "https://{}/news")


# Where newsrooms are found by an abbreviation.
NEWS_PLACES_SHORT = ("https://news.{}.edu", "https://www.{}.edu/news", "https://newsroom.{}.edu", "https://today.{}.edu")


def candidates(domain: Column, current: Column, abbreviation: Column | None = None) -> Column:
    """Addresses to try for a domain's news, without repeats (a slash at the end apart) and without the current one.

    An abbreviation of ten letters at most gives further ones. A missing domain or abbreviation gives none.
    """
    bare = lambda x: F.regexp_replace(x, "/+$", "")
    at = lambda place, x: F.concat(*(y for i, piece in enumerate(place.split("{}")) for y in ((x, F.lit(piece)) if i else (F.lit(piece),))))
    every = F.array(*(at(p, domain) for p in NEWS_PLACES))
    if abbreviation is not None:
        low = F.replace(F.lower(abbreviation), F.lit(" "), F.lit(""))
        short = F.when((F.length(abbreviation) <= 10) & low.rlike("^[a-z]+$"), low)
        every = F.concat(every, F.array(*(at(p, short) for p in NEWS_PLACES_SHORT)))
    every = F.array_compact(every)
    first = F.filter(every, lambda x, i: F.array_position(F.transform(every, bare), bare(x)) == i + 1)
    return F.filter(first, lambda x: bare(x) != bare(F.coalesce(current, F.lit(""))))
