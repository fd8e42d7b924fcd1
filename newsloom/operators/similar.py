"""Similar names by matching blocks, without comparing all pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import comparable_name
from newsloom.operators.classify import containing

#: Names are similar from this ratio of matched letters on.
RATIO = 0.85


#: Texts up to so many letters are bounded by their longest common subsequence, which fits the bits of one number.
WORD = 64


def common_letters(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of texts of at most ``WORD`` letters, all pairs at a time.

    Bit i of a number stands for letter i of the first text; one step a letter of the second one (Crochemore and others).
    """
    left, at = np.unique(np.array(a, dtype=f"U{WORD}"), return_inverse=True)
    right, to = np.unique(np.array(b, dtype=f"U{WORD}"), return_inverse=True)
    codes = lambda x: x.view(np.uint32).reshape(len(x), WORD)
    alphabet, ids = np.unique(np.concatenate([codes(left), codes(right)]), return_inverse=True)
    ids = ids.reshape(-1, WORD)
    places = np.zeros((len(left), len(alphabet)), np.uint64)
    for i in range(WORD):
        places[np.arange(len(left)), ids[: len(left), i]] |= np.uint64(1 << i)
    if len(alphabet) and alphabet[0] == 0:
        places[:, 0] = 0  # what fills short texts up is no letter
    letters = ids[len(left) :]
    open_ = np.full(len(at), (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(int(np.char.str_len(right).max(initial=0))):
            met = open_ & places[at, letters[to, i]]
            open_ = (open_ + met) | (open_ - met)
    return np.bitwise_count(~open_).astype(np.int64)


def near_ratio(limit: float):
    """A column function of two texts: twice the matched letters over all letters, by longest matching blocks, where that is at least ``limit``, else 0.

    Matched letters are a common subsequence, so the longest one rules out most pairs before any is matched block by block.
    """

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.tolist(), b.tolist()
        letters = a.str.len().to_numpy() + b.str.len().to_numpy()
        able = (a.str.len().to_numpy() > WORD) | (b.str.len().to_numpy() > WORD) | (2 * common_letters(x, y) >= limit * letters - 1e-9)
        out = np.zeros(len(x))
        for i in np.flatnonzero(able):
            out[i] = SequenceMatcher(None, x[i], y[i]).ratio()
        return pd.Series(out)

    return ratio


def _grams(df: DataFrame, column: str) -> DataFrame:
    """(column, gram, size): the numbered pairs of letters of each distinct text, so that repeats count."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(column) - 1), lambda i: F.substring(F.col(column), i, 2))
    numbered = F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, 1, i), lambda x: x == g)).cast("string")))
    return df.select(column).where(F.length(column) >= 2).distinct().select(column, F.explode(numbered).alias("gram"), F.length(column).alias("size"))


def similar_names(left: DataFrame, right: DataFrame, limit: float = RATIO) -> DataFrame:
    """Pairs (l, r, ratio) of distinct names of two letters or more whose ratio is at least ``limit``.

    Matched letters bound how many pairs of letters two similar names must share, so it is enough to join
    the rarest ones of each name (a prefix filter); what meets there is compared letter by letter.
    """
    a, b = _grams(left, "l"), _grams(right, "r")
    order = a.select("gram").unionByName(b.select("gram")).groupBy("gram").agg(F.count("*").alias("df"))

    def rarest(df: DataFrame, column: str) -> DataFrame:
        # a name of n letters differs from a similar one in at most (1 - limit) * n * (1 + longest / n) letters
        most = F.floor((1 - limit) * F.col("size") * (1 + (2 - limit) / limit)) * 2 + 1
        listed = df.join(order, "gram").groupBy(column, "size").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
        return listed.select(column, F.explode(F.slice("g", F.lit(1), most.cast("int"))).alias("p")).select(column, "p.gram", F.length(column).alias(f"n_{column}"))

    met = rarest(a, "l").join(rarest(b, "r"), "gram").where(2 * F.least("n_l", "n_r") >= limit * (F.col("n_l") + F.col("n_r"))).select("l", "r").distinct()
    return met.withColumn("ratio", near_ratio(limit)("l", "r")).where(F.col("ratio") >= limit)


def unmatched(names: DataFrame, listed: DataFrame, limit: float = RATIO) -> DataFrame:
    """Names (name) that no listed one equals, holds, is held by, or is similar to (a fuzzy EXCEPT), all in their comparable form.

    The cheap tests come first, so only what they leave is compared letter by letter. Null and blank names are no names.
    """
    own = names.select("name").distinct().withColumn("l", comparable_name(F.col("name"))).where("l <> ''")
    there = listed.select(comparable_name(F.col("name")).alias("r")).where("r <> ''").distinct()
    rest = own.join(there.withColumnRenamed("r", "l"), "l", "left_anti")
    rest = rest.join(containing(rest, there).select("l").distinct(), "l", "left_anti")
    return rest.join(similar_names(rest, there, limit).select("l").distinct(), "l", "left_anti").select("name")
