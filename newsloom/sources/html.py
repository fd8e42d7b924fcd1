"""Text, metadata and links out of HTML and feeds. Fetching is not part of the engine: bodies are columns."""

from __future__ import annotations

import html as entities
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shorter texts are no articles.
LEAST_TEXT = 50
_SILENT = frozenset(("script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "svg"))
_BREAKS = frozenset(("p", "div", "section", "article", "li", "ul", "ol", "br", "tr", "table", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "pre"))
_VOID = frozenset(("br", "img", "meta", "link", "input", "hr", "source", "wbr", "area", "base", "col", "embed", "track"))


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.silent = 0
        self.lines: list[list[str]] = [[]]
        self.title: list[str] = []
        self.in_title = False
        self.meta: dict[str, str] = {}
        self.language: str | None = None
        self.time: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.language = a.get("lang") or None
        elif tag == "meta":
            name = a.get("property") or a.get("name") or a.get("itemprop")
            if name and a.get("content"):
                self.meta.setdefault(name.lower(), a["content"])
        elif tag == "time" and a.get("datetime") and self.time is None:
            self.time = a["datetime"]
        elif tag == "title":
            self.in_title = True
        if tag in _SILENT:
            self.silent += 1
        elif tag in _BREAKS:
            self.lines.append([])

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in _BREAKS:
            self.lines.append([])

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.silent:
            self.lines[-1].append(data)


def read_page(body: str | None) -> dict:
    """Title, author, date, description, site, language and text of a page; text is null if it is too short."""
    out: dict = dict.fromkeys(("title", "author", "published", "description", "sitename", "language", "text"))
    if not body:
        return out
    r = _Reader()
    try:
        r.feed(body)
        r.close()
    except Exception:  # broken markup: keep what was read
        pass
    lines = (" ".join("".join(x).split()) for x in r.lines)
    text = "\n".join(x for x in lines if x)
    m = r.meta
    out["title"] = m.get("og:title") or " ".join("".join(r.title).split()) or None
    out["author"] = m.get("author") or m.get("article:author")
    out["published"] = (m.get("article:published_time") or m.get("date") or m.get("datepublished") or r.time or "")[:10] or None
    out["description"] = m.get("og:description") or m.get("description")
    out["sitename"] = m.get("og:site_name")
    out["language"] = (r.language or "")[:2].lower() or None
    out["text"] = text if len(text) >= LEAST_TEXT else None
    return out


PAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "author", "published", "description", "sitename", "language", "text")])


@F.pandas_udf(PAGE)
def page(body: pd.Series) -> pd.DataFrame:
    """Struct of a page's metadata and text; needs a parser, so it is the one step in Python."""
    return pd.DataFrame([read_page(b) for b in body])


def plain_text(body: Column) -> Column:
    """Text of HTML by expressions only: comments, scripts, styles and tags removed, white space run together."""
    t = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Text with every HTML entity resolved."""
    return text.map(entities.unescape, na_action="ignore")


def title_of(body: Column) -> Column:
    """Content of the title tag, at most a hundred characters; null if there is none."""
    t = F.trim(F.regexp_replace(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.nullif(F.substring(t, 1, 100), F.lit(""))


def hrefs(body: Column) -> Column:
    """Distinct link targets of a page, in order."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit("(?i)href=[\"']([^\"'#]+)[\"']"), F.lit(1)))


def absolute(base: Column, link: Column) -> Column:
    """A link made absolute against the address of its page."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^?#]*/)", 1)
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), link))
    )


# Addresses of pages on the subject, in the order in which they are looked for.
_SUBJECT_LINKS = (
    r"href=[\"\']([^\"\']*(?:tag|category|topic)/(?:artificial[-_]intelligence|ai|machine[-_]learning)[^\"\']*)[\"\']", r"href=[\"\']([^\"\']*(?:/ai/|/artificial-intelligence/)[^\"\']*)[\"\']",
)


def subject_link(base: Column, body: Column) -> Column:
    """Link of a page to its own page on the subject, against the page's host where it begins with a slash; null if there is none, or one that is relative."""
    low = F.lower(body)
    found = F.coalesce(*(F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in _SUBJECT_LINKS))
    return F.when(found.startswith("/"), F.concat(F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]*)", 1), found)).when(found.startswith("http"), found)


def links(pages: DataFrame, url: str, body: str) -> DataFrame:
    """(url, link): distinct absolute links of pages that lead to articles."""
    from newsloom.functions.urls import followed, listing_url

    every = pages.select(F.col(url).alias("url"), F.explode(hrefs(F.col(body))).alias("_l")).select("url", absolute(F.col("url"), F.col("_l")).alias("link"))
    return every.where(F.col("link").rlike("^https?://") & followed(F.lower("link")) & ~listing_url(F.col("link"))).distinct()


#: Ways in which a page marks its next one, in the order in which they are tried.
NEXT = (
    r"(?i)<a\b[^>]*rel=[\"']next[\"'][^>]*href=[\"']([^\"']+)", r"(?i)<a\b[^>]*href=[\"']([^\"']+)[\"'][^>]*rel=[\"']next[\"']",
    r"(?i)<li\b[^>]*class=[\"'][^\"']*next[^\"']*[\"'][^>]*>\s*<a\b[^>]*href=[\"']([^\"']+)", r"(?i)<a\b[^>]*class=[\"'][^\"']*next[^\"']*[\"'][^>]*href=[\"']([^\"']+)",
    r"(?i)<a\b[^>]*href=[\"']([^\"']+)[\"'][^>]*class=[\"'][^\"']*next", r"(?i)<a\b[^>]*href=[\"']([^\"']+)[\"'][^>]*>\s*(?:next|older)\b",
)


def next_page(body: Column) -> Column:
    """Link to the next page by the first way that matches, or null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(body, p, 1), F.lit("")) for p in NEXT))


def pages_from(start: DataFrame, bodies: DataFrame, depth: int = 10) -> DataFrame:
    """(url, depth): pages reached from start addresses (url) over next-page links, in at most ``depth`` steps.

    ``bodies``: (url, body). Each step joins only the addresses found last, and pages met before fall away.
    """
    from newsloom.plans.materialize import materialize

    step = materialize(bodies.select("url", absolute(F.col("url"), next_page(F.col("body"))).alias("next")).where(F.col("next").isNotNull()), "steps")
    found = last = materialize(start.select("url").distinct().withColumn("depth", F.lit(0)), "found")
    for i in range(1, depth + 1):
        last = last.join(step, "url").select(F.col("next").alias("url"), F.lit(i).alias("depth")).distinct().join(found.select("url"), "url", "left_anti")
        last = materialize(last, "found")
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def is_feed(content_type: Column, body: Column) -> Column:
    """True if the type or the first characters of a body say that it is a feed."""
    head = F.ltrim(F.substring(body, 1, 500))
    by_type = F.coalesce(F.lower(content_type), F.lit("")).rlike("xml|rss|atom|feed")
    return by_type | F.coalesce(head.startswith("<?xml") | head.contains("<rss") | head.contains("<feed"), F.lit(False))


def feed_entries(feeds: DataFrame, url: str, body: str) -> DataFrame:
    """(url, position, title, link, published) of each entry of RSS and Atom feeds that has a link."""
    entry = F.posexplode(F.regexp_extract_all(F.col(body), F.lit(r"(?s)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0)))
    rows = feeds.select(F.col(url).alias("url"), entry.alias("position", "e"))
    inner = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?s)<{tag}\b[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1), r"\s+", " ")), F.lit(""))
    link = F.coalesce(inner("link"), F.nullif(F.regexp_extract("e", "<link\\b[^>]*href=[\"']([^\"']+)", 1), F.lit("")))
    return rows.select("url", "position", inner("title").alias("title"), link.alias("link"), F.coalesce(inner("pubDate"), inner("published"), inner("updated")).alias("published")).where(F.col("link").isNotNull())


def feed_link(body: Column) -> Column:
    """Address of the feed that a page names, or null."""
    ways = (
        "(?i)<link\\b[^>]*type=[\"']application/(?:rss|atom)\\+xml[\"'][^>]*href=[\"']([^\"']+)", "(?i)<link\\b[^>]*href=[\"']([^\"']+)[\"'][^>]*type=[\"']application/(?:rss|atom)\\+xml",
        "(?i)href=[\"']([^\"']*(?:/rss|/feed|rss\\.xml|atom\\.xml)[^\"']*)",
    )
    return F.coalesce(*(F.nullif(F.regexp_extract(body, w, 1), F.lit("")) for w in ways))


def article_links(body: Column) -> Column:
    """Number of distinct links that look like articles: a year in the path, or a path of stories."""
    return F.size(F.filter(hrefs(body), lambda x: x.rlike(r"/20\d{2}/|/(?:news|story|stories|article|articles|press|release|releases)/[^/]+")))


def markdown_to_html(text: str | None, url: str = "") -> str | None:
    """Minimal HTML of Markdown: headings of three levels, list items, links, code blocks and paragraphs."""
    import re

    if text is None:
        return None
    esc = entities.escape
    out = ["<html>", "<head>", f'<meta property="og:url" content="{esc(url)}" />', "</head>", "<body>", "<article>"]
    kept: list[str] = []
    code = False

    def end() -> None:
        if kept:
            out.append("<p>" + " ".join(kept) + "</p>")
            kept.clear()

    for raw in text.split("\n"):
        line = raw.strip()
        head = re.match(r"(#{1,3}) (.*)", line)
        if line.startswith("```"):
            code = not code
            out.append("<pre><code>" if code else "</code></pre>")
        elif code:
            out.append(esc(raw))
        elif head:
            end()
            out.append(f"<h{len(head[1])}>{esc(head[2])}</h{len(head[1])}>")
        elif line[:2] in ("- ", "* "):
            end()
            out.append(f"<li>{esc(line[2:])}</li>")
        elif re.search(r"\[[^\]]+\]\([^)]+\)", line):
            end()
            parts = re.split(r"\[([^\]]+)\]\(([^)]+)\)", line)
            out.append("<p>" + "".join(esc(p) if i % 3 == 0 else f'<a href="{esc(parts[i + 1])}">{esc(p)}</a>' for i, p in enumerate(parts) if i % 3 != 2) + "</p>")
        elif not line:
            end()
        else:
            kept.append(esc(line))
    end()
    return "\n".join([*out, "</article>", "</body>", "</html>"])


def markdown_pages(df: DataFrame, url: str, text: str) -> DataFrame:
    """(url, html) of Markdown bodies; state goes from line to line, so this runs in Python batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"url": p["url"], "html": [markdown_to_html(t, u or "") for u, t in zip(p["url"], p["text"])]})

    return df.select(F.col(url).alias("url"), F.col(text).alias("text")).mapInPandas(run, "url string, html string")
