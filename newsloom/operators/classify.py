"""Classes and canonical names of institutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import matching_name
from newsloom.functions.urls import base_domain

# Classes in the order in which they win.
PRIORITY = {"national_lab": 1, "hpc": 2, "peer": 3, "global": 4, "r1": 5}
DEFAULT_CLASS = "r1"
#: Names of laboratories, computing centres and global institutions shorter than this are not compared by their parts.
LEAST = 5
GUARDED = ("national_lab", "hpc", "global")

# Short names and what they stand for.
ALIASES = {
    "mit": "massachusetts institute of technology", "stanford": "stanford university", "harvard": "harvard university", "berkeley": "university of california, berkeley",
    "uc berkeley": "university of california, berkeley", "cmu": "carnegie mellon university", "caltech": "california institute of technology", "penn": "university of pennsylvania",
    "columbia": "columbia university", "cornell": "cornell university", "duke": "duke university", "yale": "yale university", "princeton": "princeton university",
    "uchicago": "university of chicago", "jhu": "johns hopkins university", "northwestern": "northwestern university", "brown": "brown university", "dartmouth": "dartmouth college",
    "rice": "rice university", "vanderbilt": "vanderbilt university", "ucla": "university of california, los angeles", "ucsd": "university of california, san diego",
    "gatech": "georgia institute of technology", "georgia tech": "georgia institute of technology", "uiuc": "university of illinois urbana-champaign", "umich": "university of michigan",
    "uw": "university of washington", "ut austin": "university of texas at austin", "eth": "eth zurich", "epfl": "epfl", "oxford": "university of oxford", "cambridge": "university of cambridge",
    "imperial": "imperial college london", "ucl": "university college london", "tsinghua": "tsinghua university", "peking": "peking university", "utokyo": "university of tokyo",
    "kaist": "kaist", "nus": "national university of singapore", "ntu": "nanyang technological university", "technion": "technion", "anl": "argonne national laboratory",
    "llnl": "lawrence livermore national laboratory", "lanl": "los alamos national laboratory", "ornl": "oak ridge national laboratory", "lbnl": "lawrence berkeley national laboratory",
    "snl": "sandia national laboratories", "pnnl": "pacific northwest national laboratory", "bnl": "brookhaven national laboratory", "slac": "slac national accelerator laboratory",
    "fermilab": "fermi national accelerator laboratory", "inl": "idaho national laboratory", "nrel": "national renewable energy laboratory", "pppl": "princeton plasma physics laboratory",
    "srnl": "savannah river national laboratory", "netl": "national energy technology laboratory", "jpl": "nasa jpl", "darpa": "darpa", "mitre": "mitre corporation", "rand": "rand corporation",
    "lincoln lab": "mit lincoln laboratory", "jhu apl": "johns hopkins apl", "sei": "cmu software engineering institute", "nist": "nist", "nsf": "national science foundation", "arpa-e": "arpa-e",
}


def exact_class(names: DataFrame, dim: DataFrame) -> DataFrame:
    """(name, category): class of the listed name that equals each distinct name but for case, the class first in priority.

    ``dim``: (name, category). Names that are not listed, null ones included, are of the default class.
    """
    order = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    best = dim.select(F.lower("name").alias("_k"), "category").groupBy("_k").agg(F.min_by("category", order[F.col("category")]).alias("category"))
    return names.select("name").distinct().withColumn("_k", F.lower("name")).join(best, "_k", "left").select("name", F.coalesce("category", F.lit(DEFAULT_CLASS)).alias("category"))


def _trigrams(x: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, 3)))


def _held(holders: DataFrame, held: DataFrame, holder: str, part: str) -> DataFrame:
    """(holder, part) of texts and the texts that they contain, met by the part's rarest trigram among the holders."""
    grams = holders.withColumn("g", F.explode(_trigrams(F.col(holder))))
    seen = grams.groupBy("g").agg(F.count("*").alias("n"))
    each = held.withColumn("g", F.explode(_trigrams(F.col(part)))).join(seen, "g", "left")
    # a part with a trigram that no holder has is held by none
    rarest = each.groupBy(part).agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    return grams.join(rarest, "g").where(F.contains(holder, part)).select(holder, part)


def containing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (l, r) of distinct texts of three letters or more of which one contains the other.

    Whatever holds a text holds each of its trigrams, so the join is on the rarest one and not on all pairs.
    """
    a = left.select("l").where(F.length("l") >= 3).distinct()
    b = right.select("r").where(F.length("r") >= 3).distinct()
    return _held(a, b, "l", "r").select("l", "r").unionByName(_held(b, a, "r", "l").select("l", "r")).distinct()


def _best(df: DataFrame, key: str) -> DataFrame:
    order = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    return df.groupBy(key).agg(F.min_by("category", order[F.col("category")]).alias("category"))


def fuzzy_class(names: DataFrame, dim: DataFrame) -> DataFrame:
    """(name, category): class by containment of a matching name and a listed one either way, the class first in priority; else the default class.

    Listed names are compared in lower case as they stand. Of guarded classes only names of ``LEAST`` letters
    or more are compared, abbreviations among them where ``dim`` has the column; of the others names of any length.
    """
    own = names.select("name").distinct().withColumn("l", matching_name(F.col("name")))
    listed = dim.select(F.lower("name").alias("r"), "category")
    guarded = F.col("category").isin(*GUARDED)
    if "abbreviation" in dim.columns:
        listed = listed.unionByName(dim.where(guarded).select(F.lower("abbreviation").alias("r"), "category"))
    listed = _best(listed.where((F.col("r") != "") & (~guarded | (F.length("r") >= LEAST))), "r")
    met = containing(own.where("l <> ''"), listed).join(listed, "r")
    # texts of one or two letters have no trigram; whatever holds one holds its letters in a row
    few = listed.where(F.length("r") < 3)
    brief = own.where((F.length("l") > 0) & (F.length("l") < 3))
    grams = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array(F.substring(c, i, 1), F.substring(c, i, 2))))))
    held = own.select("l", grams(F.col("l")).alias("r")).join(few, "r").select("l", "category")
    holding = listed.select(F.col("r"), "category", grams(F.col("r")).alias("l")).join(brief.select("l").distinct(), "l").select("l", "category")
    found = _best(met.select("l", "category").unionByName(held).unionByName(holding), "l")
    return own.join(found, "l", "left").select("name", F.coalesce("category", F.lit(DEFAULT_CLASS)).alias("category"))


def classified(names: DataFrame, dim: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """(name, category) of each distinct name as reports use it.

    A short name is first written out. Then the names and abbreviations of all classes are compared as a
    whole, the class first in priority; only what none of them equals is compared by its parts (see
    :func:`fuzzy_class`); the rest, null and empty names included, is of the default class. ``dim``: (name, abbreviation, category).
    """
    order = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)) if aliases else None
    low = F.lower("name")
    own = names.select("name").distinct().withColumn("_k", F.coalesce(F.try_element_at(order, low), low) if aliases else low)
    whole = dim.select(F.lower("name").alias("_k"), "category")
    if "abbreviation" in dim.columns:
        short = dim.where(F.col("category").isin(*GUARDED) & (F.col("abbreviation") != "")).select(F.lower("abbreviation").alias("_k"), "category")
        whole = whole.unionByName(short)
    exact = own.join(_best(whole, "_k"), "_k", "left").select("name", "category")
    rest = fuzzy_class(exact.where(F.col("category").isNull() & (F.col("name") != "")).select("name"), dim).withColumnRenamed("category", "_fuzzy")
    return exact.join(rest, "name", "left").select("name", F.coalesce("category", "_fuzzy", F.lit(DEFAULT_CLASS)).alias("category"))


def host_dim(entries: DataFrame) -> DataFrame:
    """Lookup (key, canonical) from entries (seq, host, name): the last writer of a host wins, the first of a base domain.

    A host's own entry stands before one by base domain.
    """
    by_host = Window.partitionBy("host").orderBy(F.desc("seq"))
    hosts = entries.withColumn("_n", F.row_number().over(by_host)).where("_n = 1").select(F.col("host").alias("key"), F.col("name").alias("canonical"))
    keyed = entries.withColumn("base", base_domain(F.col("host")))
    bases = keyed.groupBy("base").agg(F.min_by("name", "seq").alias("canonical")).select(F.col("base").alias("key"), "canonical")
    return hosts.unionByName(bases.join(hosts.select("key"), "key", "left_anti"))


def canonical_names(hosts: DataFrame, dim: DataFrame) -> DataFrame:
    """(host, canonical), with (sitename) where ``hosts`` has it: by the exact host, else by its base domain, else the site's name for itself, else the host.

    Hosts are compared in lower case without space around them; a host that is null or empty takes the site's name, or else Unknown.
    """
    keys = ["host", "sitename"] if "sitename" in hosts.columns else ["host"]
    exact = dim.select(F.col("key").alias("_h"), F.col("canonical").alias("_exact"))
    base = dim.select(F.col("key").alias("_base"), F.col("canonical").alias("_by_base"))
    h = hosts.select(*keys).distinct().withColumn("_h", F.trim(F.lower("host"))).withColumn("_base", base_domain(F.col("_h")))
    site = F.nullif(F.col("sitename"), F.lit("")) if len(keys) > 1 else F.lit(None).cast("string")
    named = F.when(F.coalesce("_h", F.lit("")) == "", F.coalesce(site, F.lit("Unknown"))).otherwise(F.coalesce("_exact", "_by_base", site, "_h"))
    return h.join(exact, "_h", "left").join(base, "_base", "left").select(*keys, named.alias("canonical"))
