"""Text cut off by field limits (problem 2).

Lengths of a source's values follow a log-normal law that a field limit censors on the right. It is
fitted by maximum likelihood (EM over the censored values); what stands at a candidate limit beyond the
law's expectation is the share of values that the limit has censored. A value's ending is the other
evidence. By the statement of the problem a full stop excludes a cut, and a text that breaks off after
whole sentences is one. A single sentence without a stop may be a headline or a text cut within its first
sentence, and a last list item may be whole or cut: there the fitted laws decide, by the density of whole
values of that form at this length against that of values cut by the source's limit or in transfer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.plans.materialize import materialize

FIELDS = ("claude_summary", "openai_summary")
#: Log odds of a cut that endings give which decide by themselves, and the least and most that a limit adds to them.
ENDING = {"mark": 9.0, "open": 7.0, "stop": -14.0}
AWAY, AT_MOST = -3.0, 6.0
#: A length is a candidate limit of a source from so many values on.
CANDIDATE = 4
#: Next to nothing is longer than a limit that only single sentences or lists speak for: this share of values at most.
TAIL = 0.02
#: Laws of lengths before any value is seen (mean and deviation of the logarithm), and how many values they weigh: whole
#: single sentences without a stop, whole lists, texts cut in transfer, first sentences.
PRIOR = {"single": (4.0, 0.4), "list": (4.8, 0.5), "cut": (5.5, 0.6), "first": (4.7, 0.4)}
WEIGHT = 5.0
#: Values cut in transfer are counted over lengths so far apart.
AROUND = 10

_CLOSERS = "[”“\"’'»›)\\]*_]*"
_MARK = r"(?s)(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\]|\(\s*(?:…|\.\.\.)\s*\)|�+)$"
_BEFORE_MARK = r"(?s)\s*(?:\[\s*(?:…|\.\.\.)\s*\]|\(\s*(?:…|\.\.\.)\s*\)|…|\.\.\.|�+)$"
_STOP = rf"(?s)[.!?。]{_CLOSERS}$"
_NOTE = rf"(?s)[.!?]{_CLOSERS}\s*[(\[][^()\[\]\n]{{1,60}}[)\]]$"
_LIST = r"(?s)(?:^|\n)\s*(?:[-•*·–]|\d{1,2}[.)])\s+[^\n]*$"
_INSIDE = rf"(?s)[.!?]{_CLOSERS}\s+\S"
_FIRST = rf"(?s)^.*?[.!?]{_CLOSERS}(?=\s|$)"
# A line that ends in one of these words or signs goes on.
_GOES_ON = r"(?i)(?:[,;:–—-]|\b(?:the|a|an|of|and|or|to|in|on|at|for|with|by|from|that|which|who|its|their|der|die|das|und|von|mit|für|el|la|los|las|de|y|que|con|le|les|et|du|des|dans|pour|avec))$"


def ending(value: Column) -> Column:
    """Kind of ending of a value: mark, stop, list, single or open; null for null and blank values."""
    t = F.regexp_replace(value, r"\s+$", "")
    base = F.regexp_replace(t, _BEFORE_MARK, "")
    single = ~t.contains("\n") & ~t.rlike(_INSIDE) & ~t.rlike(_GOES_ON)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", None)
        .when(t.rlike(_MARK), F.when(base.rlike(_STOP) & (base != ""), "stop").otherwise("mark"))
        .when(t.rlike(_STOP) | t.rlike(_NOTE), "stop")
        .when(t.rlike(_LIST) & ~t.rlike(_GOES_ON), "list")
        .when(single, "single")
        .otherwise("open")
    )


def first_sentence(value: Column) -> Column:
    """Length of the first sentence of a value; 0 where none is complete."""
    return F.length(F.regexp_extract(value, _FIRST, 0))


def told_length(value: Column) -> Column:
    """Length of a value without a mark of omission at its end, which stands beyond the limit."""
    return F.length(F.regexp_replace(value, _BEFORE_MARK, ""))


def values(analyses: DataFrame, articles: DataFrame, urls: DataFrame) -> DataFrame:
    """(analysis_id, field, source, n, ending, first) of each value that is neither null nor blank.

    The source is the hostname of the analysed article; null where it is not known. Only lengths and
    endings move to the joins.
    """
    own = analyses.select(
        "analysis_id",
        "article_id",
        F.explode(
            F.array(*(F.struct(F.lit(f).alias("field"), told_length(F.col(f)).alias("n"), ending(F.col(f)).alias("ending"), first_sentence(F.col(f)).alias("first")) for f in FIELDS))
        ).alias("v"),
    ).where(F.col("v.ending").isNotNull())
    hosts = articles.select("article_id", "url_id").join(urls.select("url_id", F.col("hostname").alias("source")), "url_id", "left").select("article_id", "source")
    return own.join(hosts.dropDuplicates(["article_id"]), "article_id", "left").select("analysis_id", "v.field", "source", "v.n", "v.ending", "v.first")


def _phi(z: np.ndarray) -> np.ndarray:
    return np.exp(-z * z / 2) / np.sqrt(2 * np.pi)


def _upper(z: float) -> float:
    """Upper tail of the normal law (Abramowitz and Stegun 26.2.17), kept off zero."""
    t = 1 / (1 + 0.2316419 * abs(z))
    p = float(_phi(np.array(abs(z)))) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return max(p if z >= 0 else 1 - p, 1e-12)


def fit_censored(n: np.ndarray, whole: np.ndarray, cut: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Mean and deviation of log lengths by maximum likelihood; ``cut`` counts values known only to be at least n."""
    x = np.log(n)
    total = whole.sum() + cut.sum()
    mu = float((x * (whole + cut)).sum() / total)
    sd = float(np.sqrt(max(((x - mu) ** 2 * (whole + cut)).sum() / total, 1e-3)))
    at = np.flatnonzero(cut > 0)
    for _ in range(rounds):
        m, s2 = (x * whole).sum(), (x * x * whole).sum()
        for i in at:
            z = (x[i] - mu) / sd
            h = float(_phi(np.array(z))) / _upper(z)
            e1 = mu + sd * h
            m += cut[i] * e1
            s2 += cut[i] * (mu * mu + sd * sd + sd * (x[i] + mu) * h)
        new = m / total
        sd2 = float(np.sqrt(max(s2 / total - new * new, 1e-3)))
        if abs(new - mu) + abs(sd2 - sd) < 1e-6:
            mu, sd = float(new), sd2
            break
        mu, sd = float(new), sd2
    return mu, sd


def limits(hist: pd.DataFrame) -> pd.DataFrame:
    """Each candidate limit of one source and field with its censoring posterior and the share of all values that it has censored.

    The histogram has rows (n, all, unended, maybe): ``unended`` counts texts that break off, ``maybe`` single
    sentences and lists without a stop. The latter speak for a limit only where next to nothing is longer.
    """
    h = hist.groupby("n", as_index=False)[["all", "unended", "maybe"]].sum().sort_values("n")
    n, every, unended, maybe = (h[c].to_numpy(float) for c in ("n", "all", "unended", "maybe"))
    near = np.array([np.median(every[(n >= x - 25) & (n <= x + 25)]) for x in n]) if len(n) else n
    longer = every.sum() - every.cumsum()
    last = (longer <= TAIL * every.sum()) & (maybe >= CANDIDATE) & (maybe >= 5 * near)
    unended = unended + np.where(last, maybe, 0)
    is_limit = (unended >= CANDIDATE) & (unended >= 2.5 * near)
    cut = np.where(is_limit, unended, 0.0)
    if not is_limit.any():
        return pd.DataFrame({"n": pd.Series([], dtype="int32"), "posterior": pd.Series([], dtype="float64"), "censored": pd.Series([], dtype="float64")})
    mu, sd = fit_censored(n, every - cut, cut)
    expected = every.sum() * _phi((np.log(n) - mu) / sd) / (sd * n)
    posterior = np.clip(1 - expected / np.maximum(unended, 1), 0.01, 0.999)
    return pd.DataFrame({"n": n[is_limit].astype("int32"), "posterior": posterior[is_limit], "censored": (posterior * unended / every.sum())[is_limit]})


def _density(n: np.ndarray, law: tuple[float, float]) -> np.ndarray:
    mu, sd = law
    return _phi((np.log(n) - mu) / sd) / (sd * n)


def _beyond(n: np.ndarray, law: tuple[float, float]) -> np.ndarray:
    mu, sd = law
    return np.array([_upper((np.log(x) - mu) / sd) for x in n])


def _law(n: np.ndarray, weight: np.ndarray, kind: str) -> tuple[float, float]:
    """Log-normal law of weighted lengths, drawn to the law before by ``WEIGHT`` values."""
    mu0, sd0 = PRIOR[kind]
    total = weight.sum() + WEIGHT
    x = np.log(n) if len(n) else np.zeros(0)
    mu = float(((x * weight).sum() + mu0 * WEIGHT) / total)
    return mu, float(np.sqrt(max((((x - mu) ** 2 * weight).sum() + ((mu0 - mu) ** 2 + sd0**2) * WEIGHT) / total, 1e-3)))


def laws(hist: pd.DataFrame, at_limit: set[int]) -> pd.DataFrame:
    """(ending, n, whole, transfer, within) of one field: densities of single sentences and lists at each length, as shares of all values.

    ``hist`` has rows (n, ending, count), and (n, "first", count) for the lengths of first sentences. ``whole``
    is the density of whole values, ``transfer`` that of values cut in transfer; ``within`` is the chance that a
    value censored at this length is of this form. Whole single sentences are told from cut ones by EM.
    """
    of = lambda *kinds: hist[hist["ending"].isin(kinds)].groupby("n")["count"].sum()
    total = float(of("mark", "open", "stop", "list", "single").sum())
    arrays = lambda x: (x.index.to_numpy(float), x.to_numpy(float))
    first = _law(*arrays(of("first")), "first")
    n, c = arrays(of("open", "mark"))
    away = ~np.isin(n, list(at_limit))
    n, c = n[away], c[away]
    seen = c / np.maximum(1 - _beyond(n, first), 0.05)  # those cut within their first sentence look like single ones
    cut, cuts = _law(n, seen, "cut"), float(seen.sum()) + 0.5
    around = lambda x: seen[(n_cut >= x - AROUND) & (n_cut <= x + AROUND)].sum() / (2 * AROUND + 1)
    n_cut = n
    out = []
    for kind in ("single", "list"):
        n, c = arrays(of(kind))
        if not len(n):
            continue
        off = ~np.isin(n, list(at_limit))
        # what was cut at about this length counts for more than the law where it is more
        here = np.maximum(cuts * _density(n, cut), [around(x) for x in n]) * (_beyond(n, first) if kind == "single" else c.sum() / total)
        whole = np.ones(len(n))
        law, size = PRIOR[kind], float(c.sum())
        for _ in range(50):
            law, size = _law(n[off], (c * whole)[off], kind), float((c * whole).sum()) + 0.5
            there = size * _density(n, law)
            new = there / np.maximum(there + here, 1e-300)
            if np.abs(new - whole).max() < 1e-6:
                break
            whole = new
        within = _beyond(n, first) if kind == "single" else _beyond(n, law) * c.sum() / total
        out.append(pd.DataFrame({"ending": kind, "n": n.astype("int32"), "whole": size * _density(n, law) / total, "transfer": here / total, "within": within}))
    return pd.concat(out) if out else pd.DataFrame({"ending": pd.Series([], dtype=str), "n": pd.Series([], dtype="int32"), **{k: pd.Series([], dtype=float) for k in ("whole", "transfer", "within")}})


def _own_limits(group: pd.DataFrame) -> pd.DataFrame:
    out = limits(group)
    out["field"], out["source"] = group["field"].iloc[0], group["source"].iloc[0]
    return out[["field", "source", "n", "posterior", "censored"]]


def _field_laws(group: pd.DataFrame) -> pd.DataFrame:
    """Rows of :func:`laws` and, as ending ``limit``, the limits of the field as a whole (posterior and censored as whole and transfer)."""
    values = group[group["ending"] != "first"]
    counted = lambda *kinds: values["count"].where(values["ending"].isin(kinds), 0)
    pool = limits(values.assign(all=values["count"], unended=counted("open", "mark"), maybe=counted("single", "list")))
    own = group.loc[group["limit"], "n"]
    told = laws(group, set(pool["n"]) | set(own))
    told = pd.concat([told, pd.DataFrame({"ending": "limit", "n": pool["n"], "whole": pool["posterior"], "transfer": pool["censored"], "within": 0.0})])
    told["field"] = group["field"].iloc[0]
    return told[["field", "ending", "n", "whole", "transfer", "within"]]


def judged(analyses: DataFrame, articles: DataFrame, urls: DataFrame, fitted: bool = True) -> DataFrame:
    """(analysis_id, field, source, n, ending, odds, cut) of each value; ``cut`` is true if the log odds are above zero.

    Histograms are summed before any group is fitted, so a group holds at most one row per length and
    ending. A source's own limits come first; a limit of the whole field stands in for a source without one,
    by half its share and less the more values the source has. Without ``fitted`` no law is fitted: single sentences and lists count as whole.
    """
    rows = materialize(values(analyses, articles, urls), "values")
    hist = materialize(rows.groupBy("field", "source", "ending", "n").agg(F.count("*").alias("count")), "lengths")
    counted = lambda *kinds: F.sum(F.when(F.col("ending").isin(*kinds), F.col("count")).otherwise(0))
    per_source = hist.where(F.col("source").isNotNull()).groupBy("field", "source", "n").agg(
        F.sum("count").alias("all"), counted("open", "mark").alias("unended"), counted("single", "list").alias("maybe")
    )
    own = materialize(per_source.groupBy("field", "source").applyInPandas(_own_limits, "field string, source string, n int, posterior double, censored double"), "limits")
    forms = hist.groupBy("field", "ending", "n").agg(F.sum("count").alias("count"))
    firsts = rows.where("first > 0").groupBy("field", F.lit("first").alias("ending"), F.col("first").alias("n")).agg(F.count("*").alias("count"))
    marked = forms.unionByName(firsts).join(own.select("field", "n").distinct().withColumn("limit", F.lit(True)), ["field", "n"], "left").fillna(False, ["limit"])
    told = materialize(marked.groupBy("field").applyInPandas(_field_laws, "field string, ending string, n int, whole double, transfer double, within double"), "laws")
    pool = told.where("ending = 'limit'").select("field", "n", F.col("whole").alias("pool"), F.col("transfer").alias("pool_censored"))
    sizes = per_source.groupBy("field", "source").agg(F.sum("all").alias("size"))
    each = rows.join(own, ["field", "source", "n"], "left").join(sizes, ["field", "source"], "left").join(pool, ["field", "n"], "left").join(told.where("ending <> 'limit'"), ["field", "ending", "n"], "left")
    # a source with many values would show the limit itself, so that of the field counts less the larger the source
    unseen = F.exp(-F.col("pool_censored") * F.coalesce("size", F.lit(0))) / 2
    p = F.coalesce("posterior", F.greatest(F.col("pool") * unseen, F.lit(1e-9)))
    at = F.greatest(F.when(p.isNull(), AWAY).otherwise(F.least(F.log(p / (1 - p)), F.lit(AT_MOST))), F.lit(AWAY))
    censored = F.coalesce("censored", F.col("pool_censored") * unseen, F.lit(0.0))
    tiny = 1e-30
    by_law = F.log(F.col("transfer") + censored * F.col("within") + tiny) - F.log(F.col("whole") + tiny) if fitted else F.lit(AWAY)
    by_ending = F.create_map(*(x for k, v in ENDING.items() for x in (F.lit(k), F.lit(v))))
    odds = F.when(F.col("ending").isin("single", "list"), F.coalesce(by_law, F.lit(AWAY))).otherwise(at + by_ending[F.col("ending")])
    return each.select("analysis_id", "field", "source", "n", "ending", odds.alias("odds"), (odds > 0).alias("cut"))


def cut_by_source(rows: DataFrame) -> DataFrame:
    """(source, field, present, cut, share): how often each source's values are cut."""
    return rows.groupBy("source", "field").agg(F.count("*").alias("present"), F.count_if("cut").alias("cut"), (F.count_if("cut") / F.count("*")).alias("share"))
