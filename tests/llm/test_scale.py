"""The ways beyond the bounds give the same results as the ways within them."""

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import confusable, neardup, pack, repeats


def stories(spark, n=300, hot=100):
    rng = np.random.default_rng(7)
    vocabulary = [f"term{i}" for i in range(300)]
    base = list(rng.choice(vocabulary, 80))
    rows = []
    for i in range(n):
        words = list(base) if i < hot else list(rng.choice(vocabulary, 80))
        if i < hot and i % 4:
            words[i % 80] = f"edit{i}"
        rows.append((i, i % 3, "t", "Back to top\n" + " ".join(words) + "."))
    return spark.createDataFrame(rows, "article_id long, url_id long, title string, content string")


def test_near_duplicates_without_broadcast(spark, monkeypatch):
    a = stories(spark)
    want = {tuple(r) for r in neardup.near_duplicate_pairs(a).collect()}
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in neardup.near_duplicate_pairs(a).collect()} == want and len(want) == 100 * 99 // 2


def test_repeated_lines_without_broadcast(spark, monkeypatch):
    a, u = stories(spark), spark.createDataFrame([(i, "h") for i in range(3)], "url_id long, hostname string")
    want = sorted(tuple(r) for r in repeats.repeated_lines(a, u).select("article_id", "line_no").collect())
    monkeypatch.setattr(repeats, "BROADCAST_KEYS", 0)
    assert sorted(tuple(r) for r in repeats.repeated_lines(a, u).select("article_id", "line_no").collect()) == want and len(want) >= 300


def test_a_hot_look_and_its_few_spellings(spark):
    rows = [(i, "same text" if i % 50 else "sаme text") for i in range(600)] + [(1000 + i, f"text {i}") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert confusable.same_look_pairs(d).count() == 12 * 588
    assert confusable.look_classes(d).where("class_id = 0").count() == 600


def test_spellings_of_a_hot_look_are_counted_exactly(spark):
    letters = [("a", "а"), ("c", "с"), ("e", "е"), ("o", "о"), ("p", "р"), ("x", "х"), ("y", "у"), ("A", "А"), ("B", "В"), ("E", "Е"), ("K", "К"), ("M", "М"), ("H", "Н")]
    rows = [(i, "".join(pair[i >> k & 1] for k, pair in enumerate(letters))) for i in range(5000)]
    classes = confusable.look_classes(spark.createDataFrame(rows + [(9000 + i, t) for i, t in rows[:100]], "doc_id long, text string"))
    assert {tuple(r)[1:] for r in classes.collect()} == {(0, 5100, 5000)} and classes.count() == 5100


def test_loose_containers_of_many_shards_are_packed_together():
    sizes = np.array([30] * 7)
    boxes = pack.fill(pack._Unrelated(), sizes, 100)
    assert sorted(len(b) for b in boxes) == [1, 3, 3]


def test_documents_of_loose_containers_are_packed_by_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = {topic: [f"{a}{topic}{b}word" for a in "abcdefgh" for b in "abcdefgh"] for topic in "wxyz"}
    texts = [" ".join(rng.choice(words["wxyz"[i % 4]], int(rng.integers(20, 60)), replace=False)) for i in range(240)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 1000)], "spec_id int, tokenizer string, capacity_tokens int")
    monkeypatch.setattr(pack, "CLOSED", 1.0)  # nearly every container of a shard is loose
    boxes = {}
    for r in pack.packed(d, specs, shard=40).collect():
        boxes.setdefault(r.container, {})[r.position] = r.doc_id
    assert sorted(x for box in boxes.values() for x in box.values()) == list(range(240))
    beside = [x % 4 == box[0] % 4 for box in boxes.values() for place, x in box.items() if place]
    assert sum(beside) > 0.7 * len(beside)  # one in four by size alone


def test_revisions_stand_in_one_shard(spark, monkeypatch):
    # 20 shards; containers hold two documents, so a revision is beside its story only if it is in its shard
    rng = np.random.default_rng(2)
    words = [f"{a}{b}{c}" for a in "bcdfghklm" for b in "aeiou" for c in ("nor", "tal", "wix", "zem")]
    texts = [" ".join(rng.choice(words, 40, replace=False)) for _ in range(300)]
    d = spark.createDataFrame([(i * 2 + k, t + " again" * k) for i, t in enumerate(texts) for k in (0, 1)], "doc_id long, text string")
    largest = max(r.sizes[0] for r in pack.sized(d, ["byte_bpe_50k"]).collect())
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 2 * largest)], "spec_id int, tokenizer string, capacity_tokens int")
    monkeypatch.setattr(pack, "CLOSED", 0.5)
    boxes = {}
    for part in (d.coalesce(1), d.repartition(7, F.rand(4))):
        got = {}
        for r in pack.packed(part, specs, shard=30).collect():
            got.setdefault(r.container, []).append(r.doc_id)
        assert sorted(x for box in got.values() for x in box) == list(range(600))
        assert got == boxes or not boxes
        boxes = got
    assert sum(len({x // 2 for x in box}) < len(box) for box in boxes.values()) > 0.7 * 300


def test_the_last_neighbour_closes_a_container():
    terms = [np.arange(20, dtype=np.int32), np.arange(10, dtype=np.int32), np.arange(12, 17, dtype=np.int32), np.array([900], np.int32), np.array([900], np.int32)]
    index, sizes = pack.Index(terms, [np.ones(len(t)) for t in terms]), np.array([60, 30, 40, 40, 40])
    assert pack.fill(index, sizes, 100)[0] == [0, 1] and pack.fill(index, sizes, 100, 1)[0] == [0, 2]


def test_results_do_not_depend_on_partitions(spark):
    a = stories(spark, 120, 40)
    one = {tuple(r) for r in neardup.near_duplicate_pairs(a.coalesce(1)).collect()}
    many = {tuple(r) for r in neardup.near_duplicate_pairs(a.repartition(9, F.rand(3))).collect()}
    assert one == many
