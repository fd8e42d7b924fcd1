"""Filling fixed-capacity containers with related documents (problem 8).

Documents are sized in tokens of the container's tokenizer. The corpus is dealt into shards of bounded
size by content: documents are ordered by several min-hashes of their words, so that those that share most
of them stand together, and each run of the order is a shard. Each shard has a BM25 inverted index of its own. The largest document not yet used seeds a
container, the index returns its unused neighbours, and they fill the container greedily, best score
first; what room is left is closed with the largest unused documents that fit. Containers with room left
are opened again, and their documents are packed anew by an index over those of several shards; there
the last neighbour of a container is the best one that closes it. A document larger than the capacity is
split into full containers of its own, and its remainder is packed like a document.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.encode import REMEMBERED, TOGETHER as TEXTS, TOKENIZERS, encoder, pre_tokens, serialised_model, vocabulary
from newsloom.plans.materialize import materialize

#: Documents of a shard, on average; it bounds the memory of a task at any size of the corpus.
SHARD = 1500
#: BM25's saturation and length normalisation.
K1, B = 1.2, 0.75
#: Containers used less than this are opened again, and those of so many shards are packed anew together.
CLOSED, TOGETHER = 0.99, 64
#: Documents that are packed anew together, on average; where those of so many shards are more, fewer shards are.
ANEW = 4 * SHARD
#: Min-hashes that order the corpus, one after the other, and their bits; many documents may share the first few.
LEVELS, BITS = 6, 10
#: The beginnings of up to so many shards (16 bytes each) are sent to all tasks.
BROADCAST_SHARDS = 1_000_000
#: Terms in more than this share of a shard tell documents apart too little to be looked up.
COMMON = 0.2


def _word(pre: str) -> int:
    """Hash of the word in a pre-token; 0 for what is no word of three letters or more."""
    w = pre.strip().lower()
    return (xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) - 0x80000000 or 1) if len(w) > 2 and w.isalpha() else 0


class _Ids(dict):
    """Numbers pre-tokens in the order in which they are first asked for; ``new`` holds those asked for since it was emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, pre: str) -> int:
        i = self[pre] = len(self)
        self.new.append(pre)
        return i


class PreTokens:
    """Numbers the pre-tokens met so far, with the hash of the word in each and its number of tokens by each byte-level encoder."""

    def __init__(self, encoders: list):
        self.encoders = encoders
        self._clear()

    def _clear(self) -> None:
        self.ids = _Ids()
        self.words = np.zeros(0, np.int32)
        self.sizes = [np.zeros(0, np.int64) for _ in self.encoders]

    def numbers(self, cut: list[list[str]]) -> np.ndarray:
        """Numbers of the pre-tokens of several texts, one after the other; new ones are encoded in one call."""
        if len(self.ids) > REMEMBERED:
            self._clear()
        at = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        if new := self.ids.new:
            self.words = np.concatenate([self.words, np.fromiter(map(_word, new), np.int32, len(new))])
            for i, e in enumerate(self.encoders):
                self.sizes[i] = np.concatenate([self.sizes[i], np.fromiter(map(len, e.batch(new)), np.int64, len(new))])
            self.ids.new = []
        return at


class PieceSizes:
    """Counts sentencepiece tokens of texts by their words.

    No piece of such a vocabulary has a space after another character, so a word and the space before it
    are encoded apart from the rest; no piece holds a line end. Where a vocabulary has such pieces, or a
    line has several spaces in a row, the line or text is encoded as a whole.
    """

    class _Words(dict):
        def __init__(self, size, before: str):
            super().__init__()
            self.size, self.before = size, before

        def __missing__(self, word: str) -> int:
            if len(self) > 1_000_000:
                self.clear()
            n = self[word] = self.size(self.before + word)
            return n

    def __init__(self, model: bytes):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in names)
        # after a line end no space is put before a text: what follows one counts by the difference it makes
        end = len(self.pieces.encode("\n"))
        self.line_end = len(self.pieces.encode("\n\n")) - end
        self.first = self._Words(lambda x: len(self.pieces.encode(x)), "")
        self.first[""] = end - self.line_end  # a line end that opens a text has a space put before it
        self.bare = self._Words(lambda x: len(self.pieces.encode("\n" + x)) - end, "")
        self.spaced = self._Words(lambda x: len(self.pieces.encode("\n" + x)) - end, " ")

    def size(self, text: str) -> int:
        """Number of tokens of a text."""
        if not self.apart or not text:
            return len(self.pieces.encode(text))
        lines = text.split("\n")
        total = self.line_end * (len(lines) - 1)
        spaced = self.spaced.__getitem__
        opening = self.first
        for line in lines:
            if "  " in line or line[:1] == " " or line[-1:] == " ":
                total += opening[line]
            elif line or (opening is self.first and len(lines) > 1):
                words = line.split(" ")
                total += opening[words[0]] + sum(map(spaced, words[1:]))
            opening = self.bare
        return total


_SIZERS: dict[int, PieceSizes] = {}


def _sizer(kind: str, model: bytes):
    """What sizes texts: an encoder of pre-tokens for byte-level BPE, a counter of words for sentencepiece."""
    if kind == "bpe":
        return encoder(model)
    key = hash(model)
    if key not in _SIZERS:
        _SIZERS[key] = PieceSizes(model)
    return _SIZERS[key]


def tokenizer_model(name: str, folder: str = TOKENIZERS) -> tuple[str, bytes]:
    """Kind and model of a public tokenizer: byte-level BPE from its ranks, or a sentencepiece file."""
    import os

    if os.path.exists(f"{folder}/{name}.tiktoken"):
        return "bpe", serialised_model(vocabulary(f"{folder}/{name}.tiktoken"))
    with open(f"{folder}/{name}.model", "rb") as f:
        return "pieces", f.read()


def near(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each document a number that begins with the same bits as those of documents with mostly the same words; ``flat`` has the words of all, ``sizes`` how many are whose."""
    out = np.zeros(len(sizes), dtype=np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        flat = flat.view(np.uint32)
        first = (np.cumsum(sizes) - sizes)[some]
        for level in range(LEVELS):
            least = np.minimum.reduceat(flat * np.uint32((0x9E3779B1 * (2 * level + 1) ^ 0x85EBCA6A * level) & 0xFFFFFFFF | 1), first)
            out[some] = out[some] << BITS | (least & np.uint32((1 << BITS) - 1)).astype(np.int64)
    return out


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def sized(documents: DataFrame, tokenizers: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, sizes, terms, counts, near): token counts by each tokenizer, hashes of the distinct words, how often they occur, and the place in the order by content.

    Null and empty texts have size 0 and no words.
    """
    models = documents.sparkSession.sparkContext.broadcast([tokenizer_model(t, folder) for t in tokenizers])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizers = [(kind, _sizer(kind, model)) for kind, model in models.value]
        known = PreTokens([s for kind, s in sizers if kind == "bpe"])
        for b in batches:
            for k in range(0, b.num_rows, TEXTS):
                part = b.slice(k, TEXTS)
                texts = part.column("text").to_pylist()
                n = len(texts)
                cut = [pre_tokens(t) if t else [] for t in texts]
                doc = np.repeat(np.arange(n), [len(c) for c in cut])
                at = known.numbers(cut)
                bpe = iter(known.sizes)
                sizes = [np.bincount(doc, next(bpe)[at], n).astype(np.int64) if kind == "bpe" else np.array([s.size(t) if t else 0 for t in texts], np.int64) for kind, s in sizers]
                word = known.words[at]
                keys, counts = np.unique((doc << 32 | word.view(np.uint32))[word != 0], return_counts=True)
                terms, per = (keys & 0xFFFFFFFF).astype(np.uint32).view(np.int32), np.bincount(keys >> 32, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), _lists(np.stack(sizes, 1).ravel().astype(np.int32) if sizes else np.zeros(0, np.int32), np.full(n, len(sizes))),
                        _lists(terms, per), _lists(counts.astype(np.int32), per), pa.array(near(terms, per)),
                    ],
                    names=["doc_id", "sizes", "terms", "counts", "near"],
                )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, sizes array<int>, terms array<int>, counts array<int>, near long"
    )


def with_shards(rows: DataFrame, shards: int, most: int = BROADCAST_SHARDS) -> DataFrame:
    """Rows with the shard that each belongs to: runs of one length in the order of (near, doc_id), so the result hangs on the rows alone.

    Up to ``most`` shards the first document of each is sent to all tasks; of more, the places are joined by doc_id.
    """
    if shards == 1:
        return rows.withColumn("shard", F.lit(0))
    order = materialize(rows.select("near", "doc_id").orderBy("near", "doc_id").withColumn("at", F.monotonically_increasing_id()), "order")
    task, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, total = {}, 0
    for r in sorted(order.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect()):
        before[r.task], total = total, total + r.n
    length = math.ceil(total / shards)
    offsets = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    place = offsets[task] + within
    if shards > most:
        # rows of one doc_id that were ranked apart go to the first of their shards
        placed = order.groupBy("doc_id").agg(F.min(F.floor(place / length)).cast("int").alias("shard"))
        return rows.join(placed, "doc_id")
    firsts = sorted((r.near, r.doc_id) for r in order.where((place > 0) & (place % length == 0)).select("near", "doc_id").collect())
    starts = rows.sparkSession.sparkContext.broadcast((np.array([x for x, _ in firsts], np.int64), np.array([d for _, d in firsts], np.int64)))

    @F.pandas_udf("int")
    def shard(near: pd.Series, doc_id: pd.Series) -> pd.Series:
        at, ids = starts.value
        n, d = near.to_numpy(np.int64), doc_id.to_numpy(np.int64)
        low, high = np.searchsorted(at, n, "left"), np.searchsorted(at, n, "right")
        for i in np.flatnonzero(low < high):  # a shard begins among documents of this very number
            low[i] += np.searchsorted(ids[low[i] : high[i]], d[i], "right")
        return pd.Series(low.astype(np.int32))

    return rows.withColumn("shard", shard("near", "doc_id"))


class Words:
    """The words of several documents and how often they occur, one document after the other."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray):
        self.terms, self.counts, self.sizes = terms, counts, sizes

    @classmethod
    def of(cls, terms: pa.ChunkedArray, counts: pa.ChunkedArray) -> Words:
        """The words of two list columns without nulls."""
        flat = lambda x: pa.concat_arrays([c.flatten() for c in x.chunks]).to_numpy() if x.num_chunks else np.zeros(0, np.int32)
        return cls(flat(terms), flat(counts), pc.list_value_length(terms).to_numpy().astype(np.int64))

    @classmethod
    def listed(cls, terms: list[np.ndarray], counts: list[np.ndarray]) -> Words:
        return cls(np.concatenate(terms), np.concatenate(counts), np.array([len(t) for t in terms], np.int64))

    def take(self, documents: np.ndarray) -> Words:
        """The words of some of the documents, in the order given."""
        start = np.cumsum(self.sizes) - self.sizes
        size = self.sizes[documents]
        at = np.arange(size.sum()) + np.repeat(start[documents] - (np.cumsum(size) - size), size)
        return Words(self.terms[at], self.counts[at], size)


class Index:
    """BM25 inverted index of one shard: for each term its documents and their weights."""

    def __init__(self, words: Words | list[np.ndarray], counts: list[np.ndarray] | None = None):
        if counts is not None:
            words = Words.listed(words, counts)
        n = self.n = len(words.sizes)
        flat, tf = words.terms, words.counts.astype(np.float64)
        doc = np.repeat(np.arange(n), words.sizes)
        length = np.bincount(doc, tf, n)
        mean = max(1.0, float(length.mean())) if n else 1.0
        _, term = np.unique(flat, return_inverse=True)
        df = np.bincount(term) if len(term) else np.zeros(0, np.int64)
        useful = (df > 1) & (df <= max(2, COMMON * n))
        keep = useful[term] if len(term) else np.zeros(0, bool)
        term, doc, tf = term[keep], doc[keep], tf[keep]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean)) if len(term) else tf
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order].astype(np.float32)
        self.start = np.searchsorted(term[order], np.arange(len(df) + 1))
        self.of = np.split(term, np.cumsum(np.bincount(doc, minlength=n))[:-1]) if n else []

    def scores(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that share a term with the seed, and their scores."""
        terms = self.of[seed]
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        first, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.arange(size.sum()) + np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size)
        total = np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n)
        found = np.flatnonzero(total)
        return found, total[found]


class _Room:
    """Unused documents by size, to find the largest one that still fits."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes
        self.order = np.argsort(sizes, kind="stable")
        self.sorted = sizes[self.order].tolist()
        self.left = list(range(-1, len(sizes)))  # left[i + 1]: nearest unused place at or before i

    def _find(self, i: int) -> int:
        path = []
        while self.left[i + 1] != i and i >= 0:
            path.append(i)
            i = self.left[i + 1]
        for p in path:
            self.left[p + 1] = i
        return i

    def largest(self, room: int) -> int | None:
        """The largest unused document of at most ``room`` tokens."""
        i = self._find(bisect_right(self.sorted, room) - 1)
        return int(self.order[i]) if i >= 0 else None

    def use(self, place: int) -> None:
        self.left[place + 1] = place - 1


def fill(index: Index, sizes: np.ndarray, capacity: int, slack: float | None = None) -> list[list[int]]:
    """Containers (lists of document numbers) of documents none of which is larger than ``capacity``.

    With ``slack``, where the next neighbour would leave more room than that but less than most documents
    need, the best neighbour that leaves ``slack`` at most is taken instead, if there is one.
    """
    room = _Room(sizes)
    place = np.empty(len(sizes), dtype=np.int64)
    place[room.order] = np.arange(len(sizes))
    used = np.zeros(len(sizes), dtype=bool)
    least = room.sorted[0] if room.sorted else 0
    usual = room.sorted[len(sizes) // 2] if room.sorted else 0
    out: list[list[int]] = []

    def take(d: int, box: list[int]) -> int:
        used[d] = True
        room.use(int(place[d]))
        box.append(d)
        return int(sizes[d])

    while (seed := room.largest(capacity)) is not None:
        box: list[int] = []
        rest = capacity - take(seed, box)
        if rest >= least:
            found, score = index.scores(seed)
            free = ~used[found] & (sizes[found] <= rest)
            found, score = found[free], score[free]
            best = found[np.argsort(-score, kind="stable")]
            for d, size in zip(best.tolist(), sizes[best].tolist()):
                if size <= rest:
                    if slack is not None and slack < rest - size < usual:
                        closing = best[~used[best] & (sizes[best] <= rest) & (sizes[best] >= rest - slack)]
                        d = int(closing[0]) if len(closing) else d
                    if not used[d]:
                        rest -= take(d, box)
                    if rest < least:
                        break
        while (d := room.largest(rest)) is not None:
            rest -= take(d, box)
        out.append(box)
    return out


_SHAPE = "spec_id int, container string, position int, doc_id long, part int, start int, tokens int"


class _Unrelated:
    """Stands for an index where only sizes matter."""

    def scores(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(0, np.int64), np.zeros(0)


def fill_anew(words: Words, sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers of the documents of loose containers; those that stay loose are opened again while that closes any."""
    out: list[list[int]] = []
    left = np.arange(len(sizes))
    while len(left):
        index = Index(words.take(left))
        boxes = [left[box].tolist() for box in fill(index, sizes[left], capacity, (1 - CLOSED) * capacity)]
        loose = [box for box in boxes if sizes[box].sum() < CLOSED * capacity]
        if len(loose) == len(boxes):
            return out + boxes
        out += [box for box in boxes if sizes[box].sum() >= CLOSED * capacity]
        left = np.array(sorted(d for box in loose for d in box), dtype=np.int64)
    return out


_ROWS = pa.schema([("spec_id", pa.int32()), ("container", pa.string()), ("position", pa.int32()), ("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int32()), ("tokens", pa.int32())])
_WORDS = pa.schema([*_ROWS, ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def _refill(capacities: dict[int, int]):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("part", "ascending")])
        spec, no = group["spec_id"][0].as_py(), group["together"][0].as_py()
        boxes = fill_anew(Words.of(group["terms"], group["counts"]), group["tokens"].to_numpy().astype(np.int64), capacities[spec])
        held = np.array([len(box) for box in boxes], np.int64)
        out = group.select(["spec_id", "doc_id", "part", "start", "tokens"]).take(pa.array([d for box in boxes for d in box], pa.int64()))
        out = out.append_column("container", pa.array([f"t{no}-{i}" for i, n in enumerate(held) for _ in range(n)], pa.string()))
        out = out.append_column("position", pa.array(np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held), pa.int32()))
        return out.select(_ROWS.names).cast(_ROWS)

    return run


def packed(documents: DataFrame, specs: DataFrame, folder: str = TOKENIZERS, shard: int = SHARD) -> DataFrame:
    """Containers as rows (spec_id, container, position, doc_id, part, start, tokens).

    A row is a document, or the part of one larger than the capacity that begins at token ``start``; the
    rows of a container add up to its capacity at most. Null, empty and token-less texts take no room and
    stand in no container. Every other document comes out once for each spec (its parts, if it is split).
    """
    wanted = [(int(r.spec_id), r.tokenizer, int(r.capacity_tokens)) for r in specs.select("spec_id", "tokenizer", "capacity_tokens").orderBy("spec_id").collect()]
    names = sorted({t for _, t, _ in wanted})
    whole_corpus = materialize(sized(documents, names, folder), "sized")
    shards = max(1, math.ceil(whole_corpus.count() / shard))
    rows = with_shards(whole_corpus, shards).drop("near")
    plan = [(s, names.index(t), c) for s, t, c in wanted]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        ids, no, n = group["doc_id"].to_numpy(), group["shard"][0].as_py(), group.num_rows
        index = Index(Words.of(group["terms"], group["counts"]))
        sizes = Words.of(group["sizes"], group["sizes"]).terms.astype(np.int64).reshape(n, -1)
        out: list[tuple] = []  # container, position, document, part, start, tokens, whether its words go along
        specs_of: list[int] = []
        for spec, column, capacity in plan:
            size = sizes[:, column]
            whole, rest = size // capacity, size % capacity
            box, before = 0, len(out)
            for d in np.flatnonzero((whole > 0) & (size > capacity)).tolist():
                for part in range(int(whole[d])):
                    out.append((f"{no}-{box}", 0, d, part, part * capacity, capacity, False))
                    box += 1
            left = np.where(size > capacity, rest, size)
            present = np.flatnonzero(left > 0)
            if len(present):
                number = np.full(n, -1)
                number[present] = np.arange(len(present))
                for members in fill(index if len(present) == n else _Part(index, present, number), left[present], capacity):
                    docs = present[members]
                    loose = bool(left[docs].sum() < CLOSED * capacity)  # its documents take their words along
                    for position, d in enumerate(docs.tolist()):
                        split = int(whole[d]) if size[d] > capacity else 0
                        out.append((f"{no}-{box}", position, d, split, split * capacity, int(left[d]), loose))
                    box += 1
            specs_of += [spec] * (len(out) - before)
        container, position, doc, part, start, tokens, loose = zip(*out) if out else [()] * 7
        at = np.array(doc, np.int64)
        words = pa.array(at, mask=~np.array(loose, bool)) if out else pa.array([], pa.int64())
        columns = [specs_of, container, position, ids[at] if out else [], part, start, tokens]
        arrays = [pa.array(x, f.type) for x, f in zip(columns, _ROWS)]
        return pa.Table.from_arrays([*arrays, *(group[c].combine_chunks().take(words) for c in ("terms", "counts"))], schema=_WORDS)

    dealt = materialize(rows.groupBy("shard").applyInArrow(run, _SHAPE + ", terms array<int>, counts array<int>"), "containers")
    shape = [c for c in dealt.columns if c not in ("terms", "counts")]
    capacities = {s: c for s, _, c in wanted}
    loose = dealt.where(F.col("terms").isNotNull())
    per = {r.spec_id: max(1, min(TOGETHER, ANEW * shards // r.n)) for r in loose.groupBy("spec_id").agg(F.count("*").alias("n")).collect()}
    if not per:
        return dealt.select(shape)
    many = F.create_map(*(F.lit(x) for pair in per.items() for x in pair))
    together = F.floor(F.split("container", "-")[0].cast("int") / many[F.col("spec_id")]).cast("int")
    again = loose.withColumn("together", together).groupBy("spec_id", "together").applyInArrow(_refill(capacities), _SHAPE)
    return dealt.where(F.col("terms").isNull()).select(shape).unionByName(again)


class _Part:
    """An index seen through the documents that take room."""

    def __init__(self, index: Index, present: np.ndarray, number: np.ndarray):
        self.index, self.present, self.number = index, present, number

    def scores(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        found, score = self.index.scores(int(self.present[seed]))
        at = self.number[found]
        return at[at >= 0], score[at >= 0]


def use_of_room(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, containers, tokens, used): how many containers each spec took and the share of their room in use."""
    each = rows.groupBy("spec_id", "container").agg(F.sum("tokens").alias("tokens"))
    sums = each.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return sums.join(specs.select("spec_id", "capacity_tokens"), "spec_id").select(
        "spec_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("used")
    )
