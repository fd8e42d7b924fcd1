"""Near-duplicate records with small edits (problem 5).

A story is the multiset of its words, each written as (word, how many times it has come before). Its
sketch is made by one-permutation hashing: one hash a word, the smallest value in each bin, and empty
bins filled by optimal densification. Bins are cut into bands; stories that agree in a band share a
bucket. A bucket proposes only star-shaped edges, from its smallest and its largest id to the others,
so a bucket of n stories gives 2n edges and never n squared. Every edge is verified exactly, the
components of verified edges are found, and pairs inside them are verified exactly again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.mainbody import PAGE_COLUMNS, pages, reader, story
from newsloom.llm.sitelines import Known
from newsloom.plans.materialize import materialize

#: Stories are near-duplicates from this share of common words on.
SIMILARITY = 0.75
#: Sketches, bins of each, and bins to a band: 5 x 144 bins in 60 bands of 12. A pair of similarity s
#: meets in a band with probability 1 - (1 - s**12)**60: 0.998 at 0.83 and 0.99999 at 0.88.
SKETCHES, BINS, BAND = 5, 144, 12
_PROBES = 96
#: Tables of ids or shared buckets are broadcast up to so many rows (24 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_WORDS = re.compile(r"\w+").findall


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _probe_table() -> np.ndarray:
    """Bin that each empty bin asks at each attempt: a universal hash of bin and attempt."""
    n = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1_000_003) + np.arange(1, _PROBES + 1, dtype=np.uint64)[None, :] * np.uint64(7_919)
    return (_mix(n) % np.uint64(BINS)).astype(np.int64)


_PROBE = _probe_table()


class _Hashes(dict):
    """64-bit hash of each word met so far."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def word_tokens(hashes: np.ndarray) -> np.ndarray:
    """Sorted hashes of the words of one story, each mixed with its number of earlier occurrences."""
    h = np.sort(hashes)
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    earlier = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
    with np.errstate(over="ignore"):
        return _mix(h + earlier.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(doc: np.ndarray, token: np.ndarray, docs: int, seed: int) -> np.ndarray:
    """Densified one-permutation sketches (docs x BINS) of stories given as (doc number, token) rows."""
    with np.errstate(over="ignore"):
        v = _mix(token ^ np.uint64((seed * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF))
    out = np.full(docs * BINS, _EMPTY, dtype=np.uint64)
    np.minimum.at(out, doc * BINS + (v % np.uint64(BINS)).astype(np.int64), v)
    out = out.reshape(docs, BINS)
    full = out != _EMPTY
    row, col = np.nonzero(~full)
    for t in range(_PROBES):
        if not len(row):
            break
        ask = _PROBE[col, t]
        hit = full[row, ask]
        out[row[hit], col[hit]] = out[row[hit], ask[hit]]
        row, col = row[~hit], col[~hit]
    if len(row):  # stories of a few words may ask in vain; the smallest value of all stands in
        out[row, col] = np.where(full, out, _EMPTY).min(axis=1)[row]
    return out


def bands(sketches: list[np.ndarray]) -> np.ndarray:
    """64-bit keys (docs x bands) of the bands of the sketches; the number of the band is part of its key."""
    keys = []
    for s, m in enumerate(sketches):
        for b in range(BINS // BAND):
            k = np.full(len(m), s * 1000 + b + 1, dtype=np.uint64)
            for j in range(b * BAND, (b + 1) * BAND):
                with np.errstate(over="ignore"):
                    k = _mix(k * np.uint64(0x9E3779B97F4A7C15) + m[:, j])
            keys.append(k)
    return np.stack(keys, axis=1)


_ROWS = pa.schema([("article_id", pa.int64()), ("copy", pa.binary()), ("words", pa.list_(pa.int32())), ("bands", pa.list_(pa.int64()))])
_CHUNK = 1000


def _signed(batches: Iterator[pa.RecordBatch], read) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    get = hashes.__getitem__
    for batch in batches:
        for start in range(0, batch.num_rows, _CHUNK):
            part = batch.slice(start, _CHUNK)
            ids, toks = [], []
            for a, *page in zip(*(part.column(c).to_pylist() for c in PAGE_COLUMNS)):
                words = _WORDS(story(*read(*page)).lower())
                if words:
                    ids.append(a)
                    toks.append(word_tokens(np.fromiter(map(get, words), dtype=np.uint64, count=len(words))))
            if not ids:
                continue
            sizes = np.array([len(t) for t in toks])
            doc, flat = np.repeat(np.arange(len(ids)), sizes), np.concatenate(toks)
            keys = bands([sketch(doc, flat, len(ids), s) for s in range(1, SKETCHES + 1)])
            short = (flat >> np.uint64(32)).astype(np.uint32).view(np.int32)
            ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            # copies are told by all 64 bits of their words, in an order free of ties
            copies = [xxhash.xxh3_128_digest(np.sort(t).tobytes()) for t in toks]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(copies, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(short)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel().view(np.int64))),
                ],
                schema=_ROWS,
            )


def signed(articles: DataFrame, excluded: DataFrame | None = None, known: Known | None = None) -> DataFrame:
    """(article_id, copy, words, bands) of each article with a story that has words."""
    rows = pages(articles.where(F.length("content") > 0), known)
    read = reader(known)
    if excluded is not None:
        rows = rows.join(excluded.select("article_id").distinct(), "article_id", "left_anti")
    return rows.mapInArrow(lambda batches: _signed(batches, read), "article_id long, copy binary, words array<int>, bands array<long>")


def shared_words(a: Column, b: Column) -> Column:
    """Share of common words of two stories: common ones over all, common ones counted once."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _sent(small: DataFrame) -> DataFrame:
    """A written table of numbers, marked for broadcast if it has few enough rows."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def star_edges(keyed: DataFrame) -> DataFrame:
    """Candidate edges (a, b), a < b, of rows (id, key): in each bucket from its smallest and its largest id."""
    ends = materialize(keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where(F.col("lo") != F.col("hi")), "buckets")
    met = keyed.join(_sent(ends), "key").select("id", "lo", "hi")
    low = met.select(F.col("lo").alias("a"), F.col("id").alias("b"))
    high = met.select(F.col("id").alias("a"), F.col("hi").alias("b"))
    return low.unionByName(high).where(F.col("a") < F.col("b")).distinct()


def verified(edges: DataFrame, words: DataFrame, limit: float) -> DataFrame:
    """The edges (a, b, similarity) whose stories share at least ``limit`` of their words; ``words``: (id, words)."""
    a, b = words.toDF("a", "words_a"), words.toDF("b", "words_b")
    sized = edges.join(a, "a").join(b, "b")
    # sizes that differ too much rule a pair out before the sets are compared
    able = F.least(F.size("words_a"), F.size("words_b")) >= limit * F.greatest(F.size("words_a"), F.size("words_b"))
    return sized.where(able).select("a", "b", shared_words(F.col("words_a"), F.col("words_b")).alias("similarity")).where(F.col("similarity") >= limit)


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(id, component) of every id on an edge (a, b): the smallest id that it is connected to.

    Labels pass over edges and are shortened by jumping until none changes; each round is a written
    table, so neither lineage nor the driver's memory grows with the data.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), name)
    while True:
        near = both.join(labels.toDF("b", "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("further"))
        new = materialize(step.join(jump, "next", "left").select("id", "label", F.least("next", "further").alias("new")), name)
        moved = new.where(F.col("new") < F.col("label")).limit(1).count()
        labels = new.select("id", F.col("new").alias("label"))
        if not moved:
            return labels.withColumnRenamed("label", "component")


def groups(articles: DataFrame, excluded: DataFrame | None = None, known: Known | None = None, limit: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of near-duplicates: copies (article_id, rep), words (id, words) of the representatives that met another one, and components (id, component).

    Copies are stories of the same words; only the smallest article_id of each, its representative, is
    compared with others, so a text that fills a third of the table is one story here.
    """
    rows = materialize(signed(articles, excluded, known), "signed")
    copies = materialize(rows.select("article_id", "copy").join(rows.groupBy("copy").agg(F.min("article_id").alias("rep")), "copy").select("article_id", "rep"), "copies")
    others = copies.where(F.col("article_id") != F.col("rep")).select("article_id")
    reps = rows.join(_sent(others), "article_id", "left_anti")
    words = reps.select(F.col("article_id").alias("id"), "words")
    edges = materialize(star_edges(reps.select(F.col("article_id").alias("id"), F.explode("bands").alias("key"))), "candidates")
    met = materialize(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), "met")
    words = materialize(words.join(_sent(met), "id", "left_semi").select("id", "words"), "words")
    return copies, words, components(verified(edges, words, limit))


def near_duplicate_pairs(articles: DataFrame, excluded: DataFrame | None = None, known: Known | None = None, limit: float = SIMILARITY) -> DataFrame:
    """Pairs (article_id_a, article_id_b), smaller id first, whose stories share at least ``limit`` of their words.

    Equal stories are pairs too, and every pair of a larger group comes out. Articles without words in
    their story (null, empty, furniture only) and ``excluded`` ones give no pairs; repeated rows of one
    article_id give none with themselves.
    """
    copies, words, comps = groups(articles, excluded, known, limit)
    a, b = comps.toDF("a", "component"), comps.toDF("b", "component")
    pairs = materialize(verified(a.join(b, "component").where(F.col("a") < F.col("b")).select("a", "b"), words, limit).select("a", "b"), "pairs")
    x, y = copies.toDF("x", "a"), copies.toDF("y", "b")
    across = pairs.join(x, "a").join(y, "b").select("x", "y")
    several = copies.groupBy("rep").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("rep")
    of = copies.join(several, "rep")
    same = of.toDF("rep", "x").join(of.toDF("rep", "y"), "rep").where(F.col("x") < F.col("y")).select("x", "y")
    return across.unionByName(same).select(F.least("x", "y").alias("article_id_a"), F.greatest("x", "y").alias("article_id_b")).distinct()


def near_duplicate_classes(articles: DataFrame, excluded: DataFrame | None = None, known: Known | None = None, limit: float = SIMILARITY) -> DataFrame:
    """One row (article_id, class_id, copy_of) per article with a story: its class and the equal story it is a copy of."""
    copies, _, comps = groups(articles, excluded, known, limit)
    return copies.join(comps.toDF("rep", "component"), "rep", "left").select(
        "article_id", F.coalesce("component", "rep").alias("class_id"), F.col("rep").alias("copy_of")
    )
