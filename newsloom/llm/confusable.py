"""Texts that look alike but are written with different characters (problem 9).

The skeleton of a text: decompose, drop characters that show nothing, replace each remaining one by the
prototype of its look, decompose again. Texts look the same if their skeletons are equal, so originals
are grouped by the hash of their skeleton.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans.materialize import materialize

# Characters of other scripts and the Latin ones that they look like, as in the public table of confusable
# characters of the Unicode standard, without pairs that an attentive reader tells apart.
_LOOK_ALIKE = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I", "Ԍ": "G",
    # Greek
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian and Latin letters of other sets
    "օ": "o", "ս": "u", "ց": "g", "հ": "h", "Տ": "S", "Օ": "O", "ɡ": "g", "ɑ": "a",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Coptic
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # signs
    "µ": "μ", "‐": "-", "‑": "-", "﹣": "-", "∶": ":", "∕": "/", "⁄": "/", "․": ".", "‚": ",", "ꞌ": "'", "ʼ": "’",
}
# Format characters that do show something.
_SHOWN = frozenset("؀؁؂؃؄؅۝܏࢐࢑࣢")
# Characters that show nothing though they are no format characters.
_HIDDEN = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"


def prototypes() -> dict[int, str | None]:
    """Prototype of each character that has one other than itself; None where it shows nothing.

    Built by rule: format characters and variation selectors vanish, every white space of the width of
    a character becomes a space, full-width forms become the ordinary ones and Roman numerals the letters that
    they are drawn as; then the look-alike table.
    """
    table: dict[int, str | None] = {}
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Cf" and c not in _SHOWN or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            table[cp] = None
        elif kind == "Zs" and c != " ":
            table[cp] = " "
        elif 0xFF01 <= cp <= 0xFF5E:
            table[cp] = chr(cp - 0xFEE0)
        elif 0xFFE0 <= cp <= 0xFFE6 or 0x2160 <= cp <= 0x217F:
            table[cp] = unicodedata.normalize("NFKC", c)
    for c in _HIDDEN:
        table[ord(c)] = None
    for c, p in _LOOK_ALIKE.items():
        table[ord(c)] = p
    return table


_TABLE: dict[int, str | None] | None = None
#: A joiner between two pictures does change the look.
_JOINED = re.compile("(?<=[←-⯿\U0001f000-\U0001faff️])‍(?=[←-⯿\U0001f000-\U0001faff])")
_KEEP = ""


def skeleton(text: str) -> str:
    """The one form shared by all texts that look the same; line ends become newlines."""
    global _TABLE
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text
    if _TABLE is None:
        _TABLE = prototypes()
    if "‍" in text:
        text = _JOINED.sub(_KEEP, text)
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_TABLE))
    return text.replace(_KEEP, "‍") if _KEEP in text else text


_FORMS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [None if t is None else skeleton(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], schema=_FORMS)


def consistent(documents: DataFrame) -> DataFrame:
    """Each document (doc_id, text) in its one consistent form; null stays null, empty stays empty."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_forms, "doc_id long, text string")


_HASHES = pa.schema([("doc_id", pa.int64()), ("look", pa.binary()), ("exact", pa.binary())])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, looks, exact = [], [], []
        for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            s = skeleton(t) if t else ""
            if not s.strip():
                continue
            ids.append(d)
            looks.append(xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")))
            exact.append(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(looks, pa.binary()), pa.array(exact, pa.binary())], schema=_HASHES)


def looks(documents: DataFrame) -> DataFrame:
    """(doc_id, look, exact): hashes of 128 bits of each text's skeleton and of the text itself.

    Null, empty and blank texts give no rows.
    """
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_hashes, "doc_id long, look binary, exact binary")


def same_look_pairs(documents: DataFrame) -> DataFrame:
    """Pairs (doc_id_a, doc_id_b), smaller id first, that look the same but differ in their characters.

    Each spelling of a look is taken once to find the pairs of spellings, and only those are met with the
    documents that hold them, so copies of one spelling are never compared with one another.
    """
    rows = materialize(looks(documents), "looks")
    spellings = rows.select("look", "exact").distinct()
    mixed = spellings.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    several = materialize(spellings.join(mixed, "look", "left_semi").select("look", "exact"), "spellings")
    pairs = several.toDF("look", "x").join(several.toDF("look", "y"), "look").where(F.col("x") != F.col("y")).select("x", "y")
    held = rows.join(several.select("exact"), "exact", "left_semi").select("doc_id", "exact")
    met = pairs.join(held.toDF("doc_id_a", "x"), "x").join(held.toDF("doc_id_b", "y"), "y")
    return met.where(F.col("doc_id_a") < F.col("doc_id_b")).select("doc_id_a", "doc_id_b").distinct()


def look_classes(documents: DataFrame) -> DataFrame:
    """One row per document with text: its class (the smallest doc_id of its look), the class's size and its spellings."""
    rows = materialize(looks(documents), "looks")
    written = rows.groupBy("look", "exact").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))  # counts each spelling before its look meets
    groups = written.groupBy("look").agg(F.min("least").alias("class_id"), F.sum("n").alias("members"), F.count("*").alias("spellings"))
    return rows.join(groups, "look").select("doc_id", "class_id", "members", "spellings")
