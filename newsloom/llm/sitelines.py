"""Lines that the stories of one site share, and their lookup.

A page is read once into the hashes of its lines. For each source and line two bitmaps of 64 bits collect
marks of the stories that hold it (their longest line, a name of their headline). Bitmaps are merged by a
bitwise or, so each task sums up its own rows first and a hot source or line is never gathered in one
place. Copies of one story share their marks, so a line has many bits only if different stories have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.lines import line_key
from newsloom.llm.mainbody import page_lines, rough_prose, story_marks
from newsloom.plans.materialize import materialize

#: A line belongs to the site from stories with so many different marks on.
STORIES = 6
#: Only pages with so many characters in long lines that end in a stop are asked: they hold a story.
RICH = 600
#: Keys of lines are broadcast up to this many (8 bytes each); beyond it pages are marked by a join.
BROADCAST_KEYS = 1_000_000

_KEYED = pa.schema([("article_id", pa.int64()), ("url_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("longest", pa.int64()), ("named", pa.int64()), ("rich", pa.bool_())])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, urls, keys, longest, named, rich = [], [], [], [], [], []
        for a, u, title, content in zip(*(b.column(c).to_pylist() for c in ("article_id", "url_id", "title", "content"))):
            lines = page_lines(content)
            k = [line_key(x) for x in lines]
            if not any(k):
                continue
            one, two = story_marks(title, lines, k)
            ids.append(a)
            urls.append(u)
            keys.append(k)
            longest.append(one)
            named.append(two)
            rich.append(rough_prose(lines) >= RICH)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, urls, keys, longest, named, rich), _KEYED)], schema=_KEYED)


def keyed(articles: DataFrame, urls: DataFrame) -> DataFrame:
    """One row (article_id, source, h, keys, longest, named, rich) per article with letters in its content and a known source.

    ``keys[i]`` is the hash of the letters of line i + 1, 0 where it has none; ``h`` is the hash of the
    source. Only hashes move to the join that finds the source, never the text.
    """
    read = articles.where((F.length("content") > 0) & F.col("url_id").isNotNull()).select("article_id", "url_id", F.col("title").cast("string"), F.col("content").cast("string"))
    rows = read.mapInArrow(_keyed, "article_id long, url_id long, keys array<long>, longest long, named long, rich boolean")
    hosts = urls.where(F.col("hostname").isNotNull()).select("url_id", F.col("hostname").alias("source"), F.xxhash64("hostname").alias("h"))
    return rows.join(hosts, "url_id").select("article_id", "source", "h", "keys", "longest", "named", "rich")


def _bit(mark: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(mark), F.lit(64)).cast("int"))


def site_lines(rows: DataFrame, stories: int = STORIES) -> DataFrame:
    """Keys (key) of the lines that at least about ``stories`` different stories of one source hold, of rows of :func:`keyed`."""
    once = rows.where("rich").select("h", _bit("longest").alias("a"), _bit("named").alias("b"), F.explode(F.array_distinct("keys")).alias("key")).where("key <> 0")
    seen = once.groupBy("h", "key").agg(F.bit_or("a").alias("a"), F.bit_or("b").alias("b"))
    return seen.where((F.bit_count("a") >= stories) & (F.bit_count("b") >= stories)).select("key").distinct()


class Known:
    """The lines that sites share, ready for pages to be read beside them.

    Up to ``BROADCAST_KEYS`` keys are sent to the tasks; more of them are joined to the lines of the
    pages, and the numbers of the lines found go along with each page.
    """

    def __init__(self, rows: DataFrame, stories: int = STORIES, most: int = BROADCAST_KEYS):
        self.rows = rows
        self.table = materialize(site_lines(rows, stories), "sitelines")
        self.sent = None
        if self.table.count() <= most:
            self.sent = rows.sparkSession.sparkContext.broadcast(np.sort(self.table.toArrow().column(0).to_numpy()))

    def beside(self, pages: DataFrame) -> DataFrame:
        """Pages with a column ``shared``: the numbers of their shared lines, null where the keys are sent."""
        if self.sent is not None:
            return pages.withColumn("shared", F.lit(None).cast("array<int>"))
        lines = self.rows.select("article_id", F.posexplode("keys").alias("i", "key")).join(self.table, "key")
        return pages.join(lines.groupBy("article_id").agg(F.collect_set("i").alias("shared")), "article_id", "left")

    def marker(self):
        """A function of a page's lines and its ``shared`` that says for each line whether the site shares it."""
        return Marker(self.sent)


class Marker:
    """Tells the shared lines of a page; travels to the tasks."""

    def __init__(self, sent):
        self.sent = sent

    def __call__(self, lines: list[str], shared: list[int] | None) -> list[bool]:
        if self.sent is None:
            own = set(shared or ())
            return [i in own for i in range(len(lines))]
        known = self.sent.value
        if not len(known):
            return [False] * len(lines)
        keys = np.fromiter(map(line_key, lines), dtype=np.int64, count=len(lines))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return (known[at] == keys).tolist()
