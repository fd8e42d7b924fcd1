"""Near-duplicates, names, encoding, packing and look-alike texts."""

import os
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import confusable, encode, names, neardup, pack

HERE = os.path.isdir(encode.TOKENIZERS)
needs_tokenizers = pytest.mark.skipif(not HERE, reason="the public tokenizers are not here")


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    stories = {}
    for family in range(12):
        base = list(rng.choice(vocabulary, 120))
        for k in range(int(rng.integers(1, 6))):
            words = list(base)
            for _ in range(int(rng.integers(0, 9))):
                words[int(rng.integers(len(words)))] = f"new{rng.integers(10_000)}"
            if k == 1:
                rng.shuffle(words)
            stories[len(stories) + 1] = " ".join(words) + "."
    for i in range(12):
        stories[100 + i] = stories[1].upper() if i % 2 else stories[1]  # a hot group of copies
    rows = [(i, "t", s + "\nBack to top") for i, s in stories.items()] + [(500, "t", None), (501, "t", ""), (502, "t", "Back to top"), (503, None, stories[2]), (1, "t", stories[1] + "\nBack to top")]
    a = spark.createDataFrame(rows, "article_id long, title string, content string").withColumn("words", F.lit(1))
    out = spark.createDataFrame([(503,)], "article_id long")
    bags = {i: Counter(neardup._WORDS(s.lower())) for i, s in stories.items()}

    def alike(x, y):
        common = sum((bags[x] & bags[y]).values())
        return common / (sum(bags[x].values()) + sum(bags[y].values()) - common) >= 0.75

    expected = {(x, y) for x, y in combinations(sorted(bags), 2) if alike(x, y)}
    assert {tuple(r) for r in neardup.near_duplicate_pairs(a, out).collect()} == expected
    parent = {i: i for i in bags}
    for x, y in sorted(expected):
        lo, hi = sorted((parent[x], parent[y]))
        parent = {i: lo if p == hi else p for i, p in parent.items()}
    got = {r.article_id: r.class_id for r in neardup.near_duplicate_classes(a, out).collect()}
    assert got == parent
    assert neardup.near_duplicate_pairs(a.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    x = neardup.word_tokens(rng.integers(0, 2**63, 200, dtype=np.uint64))
    y = np.r_[x[:160], neardup.word_tokens(rng.integers(0, 2**63, 40, dtype=np.uint64))]
    doc, tok = np.repeat([0, 1], 200), np.r_[x, y]
    same = np.mean([np.mean(m[0] == m[1]) for m in (neardup.sketch(doc, tok, 2, s) for s in range(30))])
    assert abs(same - 160 / 240) < 0.05
    one = neardup.sketch(np.zeros(1, int), x[:1], 1, 1)
    assert (one == one[0, 0]).all()  # a single word fills every bin
    assert len(set(neardup.word_tokens(np.array([7, 7, 7], dtype=np.uint64)))) == 3


def test_star_edges_stay_few(spark):
    keyed = spark.range(1000).select("id", F.lit(1).alias("key"))
    assert neardup.star_edges(keyed).count() <= 2 * 1000
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51)], "a long, b long")
    assert {r.component for r in neardup.components(chain).collect()} == {1, 50}


LISTED = [(1, "University of Zorblat", "UZ", "zorblat.example"), (2, "Zorblat State University", "ZSU", "zorblatstate.example"), (3, "Quillham National Laboratory", None, "quillhamlab.example"), (4, "Universidad de Marnolia", "UM", None), (5, "Josephane Trebwick University", "JTU", "trebwick.example"), (6, "University of Varn at Kelpstead", "UVK", None), (7, "Morton Institute of Technology", "UZ2", ""), (8, "Umber College", "UM", "umber.example")]
TYPED = {
    "zorblat university": 1, "Univ. of Zorblta": 1, "Zorblat St. Univ": 2, "The Zorblat State University Newsroom | ZSU Today": 2, "ZSU News": 2, "Zorblat State": 2, "State University, Zorblat": 2, "news.zorblat.example": 1, "Quillham Nat’l Lab": 3,
    "Quilham Natoinal Laboratory": 3, "U. de Marnolia": 4, "Marnolia": 4, "Joey Trebwick U": 5, "Trebwick, Josephane University": 5, "Trebwick University": 5, "UVarn-Kelpstead": 6, "Varn at Kelpstead": 6, "MortonInstituteofTechnology": 7, "Morton Tech": 7,
    "University\xa0of\xa0Zorblat": 1, "Z.S.U.": 2,
}
NONE = ["", " ", None, "N/A", "Staff Writer", "Zorblat Theological Seminary", "Zorblat Community College", "Quillham University", "UM", "University of Elsewhere", "x" * 5000]


def test_names(spark):
    typed = list(TYPED) + NONE + ["University of Zorblat"]
    a = spark.createDataFrame([(i, n) for i, n in enumerate(typed)] + [(0, typed[0])], "article_id long, university_name string").withColumn("name", F.lit("clash"))
    i = spark.createDataFrame(LISTED, "institution_id long, name string, abbreviation string, domain string")
    got = {typed[r.article_id]: r.institution_id for r in names.variant_spellings(a, i).collect()}
    assert got == TYPED
    every = {r.university_name: r.institution_id for r in names.entries(a, i).collect()}
    assert every["University of Zorblat"] == 1 and every[None] is None and every["N/A"] is None
    assert names.variant_spellings(a.limit(0), i).count() == 0 and names.variant_spellings(a, i.limit(0)).count() == 0


def test_segments_meet_whatever_the_edits():
    rng = np.random.default_rng(2)
    for _ in range(400):
        s = "".join(rng.choice(list("abcde"), int(rng.integers(5, 14))))
        t = list(s)
        for _ in range(int(rng.integers(0, 3))):
            p = int(rng.integers(len(t)))
            what = rng.integers(4)
            if what == 0:
                t[p] = "x"
            elif what == 1:
                t.insert(p, "y")
            elif what == 2 and len(t) > 1:
                del t[p]
            elif p + 1 < len(t):
                t[p], t[p + 1] = t[p + 1], t[p]
        t = "".join(t)
        assert set(names.segments(s)) & set(names.probes(t)) and names.osa(s, t, 4) <= 4
    assert names.osa("abcd", "abdc", 2) == 1 and names.osa("abcd", "wxyz", 2) == 3 and names.osa("", "ab", 2) == 2


TEXTS = [None, "", " ", "\n", "plain words, 123!", "naïve café – “quoted” 研究 🧪👩‍🔬", "<|endoftext|> is text", "a\r\n\tb  c   ", "x" * 30_000, "don't we've 1½ ²", "\x00\x1f\x85  ", "нова стаття"]


@needs_tokenizers
def test_encoding_agrees_with_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in encode.encoded(d).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(TEXTS)}
    assert all(r.same for r in encode.round_trip(d).collect())
    assert encode.encoded(d.limit(0)).count() == 0


@needs_tokenizers
def test_sizes_by_words_agree_with_the_tokenizer():
    kind, model = pack.tokenizer_model("piece_bpe_32k")
    sizes = pack.PieceSizes(model)
    assert kind == "pieces" and sizes.apart
    for x in [t for t in TEXTS if t] + ["\n\na", "a\n\n b", " a", "a ", "  ", "a  b\nc", "\n"]:
        assert sizes.size(x) == len(sizes.pieces.encode(x)), x


@needs_tokenizers
def test_packing_keeps_every_token(spark):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 400)))) for _ in range(150)] + [None, "", " ".join(words * 8), " ".join(words * 8)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", F.lit(1))
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 500), (2, "piece_bpe_32k", 2000)], "spec_id int, tokenizer string, capacity_tokens int")
    rows = pack.packed(d, specs, shard=40).collect()
    for spec, name, cap in ((1, "byte_bpe_50k", 500), (2, "piece_bpe_32k", 2000)):
        mine = [r for r in rows if r.spec_id == spec]
        kind, model = pack.tokenizer_model(name)
        size = encode.encoder(model).size if kind == "bpe" else pack.PieceSizes(model).size
        boxes, parts = defaultdict(int), defaultdict(list)
        for r in mine:
            boxes[r.container] += r.tokens
            parts[r.doc_id].append((r.part, r.start, r.tokens))
        assert max(boxes.values()) <= cap and set(parts) == {i for i, x in enumerate(texts) if x}
        for i, p in parts.items():
            p.sort()
            assert sum(t for _, _, t in p) == size(texts[i]) and [s for _, s, _ in p] == [k * cap for k in range(len(p))] and (len(p) == 1 or size(texts[i]) > cap)
        assert sum(boxes.values()) / (len(boxes) * cap) > 0.9
    assert pack.packed(d.limit(0), specs).count() == 0 and pack.packed(d, specs.limit(0)).count() == 0


def test_shards_are_the_same_sent_or_joined(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(40)).alias("near"))
    sent = {(r.doc_id, r.shard) for r in pack.with_shards(rows, 7).collect()}
    assert sent == {(r.doc_id, r.shard) for r in pack.with_shards(rows, 7, most=0).collect()} and len({s for _, s in sent}) == 7 and len(sent) == 500


def test_neighbours_come_first():
    a, b = [np.arange(0, 20, dtype=np.int32), np.arange(100, 120, dtype=np.int32)]
    index = pack.Index(pack.Words.listed([a, b, a + 1, b + 1, np.array([7000], np.int32)], [np.ones(20), np.ones(20), np.ones(20), np.ones(20), np.ones(1)]))
    assert pack.fill(index, np.array([60, 50, 40, 40, 10]), 100)[0] == [0, 2]


LOOKS = {
    1: "A plain text, no. 5 - café", 2: "А plain text, no. 5 - café", 3: "A pl​ain text, no. 5 ‐ café", 4: "Ａ plain text， no. ５ - café", 5: "A plain text, no. ⁵ - café", 6: "A plain text, no. 5 – café", 7: "A plain text, no. 5 - cafe",
    8: "a plain text, no. 5 - café", 9: "A plain text, no. 5 - café", 10: None, 11: "", 12: " ​ ", 13: " ", 14: "👩‍🔬", 15: "👩🔬", 16: "з різних міст", 17: "з рiзних міст",
}


def test_texts_that_look_the_same(spark):
    d = spark.createDataFrame(list(LOOKS.items()) + [(1, LOOKS[1])], "doc_id long, text string").withColumn("look", F.lit("clash"))
    got = {tuple(r) for r in confusable.same_look_pairs(d).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (2, 9), (3, 9), (4, 9), (16, 17)}
    form = {r.doc_id: r.text for r in confusable.consistent(d).collect()}
    assert form[10] is None and form[11] == "" and form[1] == form[3] and all(confusable.skeleton(x) == x for x in form.values() if x)
    classes = {r.doc_id: r.class_id for r in confusable.look_classes(d).collect()}
    assert classes[9] == 1 and classes[4] == 1 and classes[5] == 5 and 12 not in classes
    assert confusable.same_look_pairs(d.limit(0)).count() == 0
