"""Variant spellings of institution names (problem 6).

A name is read as a place (or founder) part, where typing errors are met by a pigeonhole segment join,
and the words of its kind (university, state, laboratory ...), which are put into one form each. For the
join every listed place part is cut into k + 1 segments; at most k edits leave one segment whole, moved
by a bounded shift, so the substrings of a typed part at the allowed shifts are looked up in the index
of segments. Candidates are verified with a banded edit distance that counts a swap as one edit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans.materialize import materialize

#: Edits allowed in a place part, a swap of neighbours counting as one; two swaps are four plain edits.
EDITS, PLAIN_EDITS = 2, 4

# Words of kind with their abbreviations; "uni?" stands for any word for a university.
_KINDS = {
    "university": "university", "universität": "universität", "universitaet": "universität", "université": "université", "universidad": "universidad",
    "universite": "université", "universitat": "universität",
    "univ": "uni?", "uni": "uni?", "unv": "uni?", "u": "uni?", "univers": "uni?",
    "institute": "institute", "inst": "institute", "instit": "institute", "technology": "technology", "tech": "technology", "technol": "technology", "techn": "technology",
    "national": "national", "natl": "national", "nat’l": "national", "nat'l": "national", "nat": "national",
    "laboratory": "laboratory", "laboratories": "laboratory", "lab": "laboratory", "labs": "laboratory",
    "state": "state", "st": "state", "polytechnic": "polytechnic", "poly": "polytechnic", "polytech": "polytechnic",
    "college": "college", "coll": "college", "col": "college", "school": "school", "sch": "school",
    "medicine": "medicine", "med": "medicine", "medical": "medicine", "community": "community", "comm": "community",
}
_UNIVERSITIES = frozenset(("university", "universität", "université", "universidad"))
_LINKS = frozenset("o fo of at de the and for für des der la le di do & d l in y et und".split())
# Words that newsrooms add after a name.
_ADDED = frozenset(
    """news newsroom today stories communications magazine press media online homepage website official relations office report reports wire
    publications announcements blog updates nachrichten aktuelles noticias actualités""".split()
)
#: Words of kind that may be left out when the other one stands.
_MAY_LACK = {"university": ("state", "polytechnic"), "national": ("laboratory",), "institute": ("technology",), "school": ("medicine",)}
_TOKEN = re.compile(r"[^\W_]+(?:[’'][^\W_]+)*")
_HOST = re.compile(r"^(?:https?://)?((?:[a-z0-9-]+\.)+[a-z]{2,})(?:/\S*)?$")


def osa(a: str, b: str, k: int) -> int:
    """Edit distance with swaps of neighbours, in a band of width k; k + 1 if it is larger than k."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    big = k + 1
    before: list[int] = []
    row = [j if j <= k else big for j in range(m + 1)]
    for i in range(1, n + 1):
        new = [big] * (m + 1)
        if i <= k:
            new[0] = i
        x = a[i - 1]
        for j in range(max(1, i - k), min(m, i + k) + 1):
            y = b[j - 1]
            d = row[j - 1] + (x != y)
            if row[j] + 1 < d:
                d = row[j] + 1
            if new[j - 1] + 1 < d:
                d = new[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < d:
                d = before[j - 2] + 1
            new[j] = d if d < big else big
        if min(new) > k:
            return big
        before, row = row, new
    return min(row[m], big)


def _plain(s: str) -> str:
    """Letters without their accents."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


_KIND_WORDS = [(w, v, 2 if len(w) > 6 else 1) for w, v in _KINDS.items() if len(w) >= 4]
_KNOWN: dict[str, str | None] = {}


def kind_of(token: str) -> str | None:
    """The kind that a token is a word for, typing errors included, or None."""
    if token in _KINDS:
        return _KINDS[token]
    if token in _KNOWN:
        return _KNOWN[token]
    best, least = None, 9
    if len(token) >= 4:
        for w, v, k in _KIND_WORDS:
            d = osa(token, w, k)
            if d <= k and d < least:
                best, least = v, d
    if len(_KNOWN) > 100_000:
        _KNOWN.clear()
    _KNOWN[token] = best
    return best


# Short forms of first names and how the full names begin.
NICKNAMES = {
    "abby": ("abig",), "al": ("al",), "alex": ("alex",), "andy": ("andr",), "barb": ("barb",), "ben": ("ben",), "bess": ("eliz",), "beth": ("eliz",), "betsy": ("eliz",),
    "betty": ("eliz",), "bill": ("will",), "billy": ("will",), "bob": ("rob",), "bobby": ("rob",), "charlie": ("charl",), "chris": ("christ",), "chuck": ("charl",),
    "cindy": ("cynth",), "dan": ("dan",), "dave": ("dav",), "dick": ("rich",), "don": ("don",), "ed": ("ed",), "eddie": ("ed",), "fran": ("franc",), "frank": ("franc",),
    "fred": ("fred", "alfred"), "freddy": ("fred",), "greg": ("greg",), "hank": ("henr",), "harry": ("har", "henr"), "jack": ("john", "jack"), "jake": ("jacob",), "jen": ("jen",),
    "jenny": ("jen",), "jerry": ("ger", "jer"), "jim": ("jam",), "jimmy": ("jam",), "jo": ("jo",), "joe": ("jos",), "joey": ("jos",), "kate": ("kath", "cath"), "kathy": ("kath",),
    "katie": ("kath", "cath"), "ken": ("ken",), "larry": ("lawr", "laur"), "liz": ("eliz",), "lizzie": ("eliz",), "lou": ("lou",), "maggie": ("marg",), "meg": ("marg",),
    "peggy": ("marg",), "marty": ("mart",), "matt": ("matt",), "mike": ("mich",), "nat": ("nat",), "nate": ("nat",), "ned": ("ed",), "nick": ("nic",), "nell": ("el", "hel"),
    "pat": ("patr",), "patty": ("patr",), "pete": ("pet",), "phil": ("phil",), "ray": ("raym",), "rick": ("rich", "fred"), "rob": ("rob",), "ron": ("ron",), "sally": ("sar",),
    "sam": ("sam",), "sandy": ("alex", "sand"), "sophie": ("soph",), "steve": ("ste",), "sue": ("sus",), "susie": ("sus",), "ted": ("theod", "ed"), "teddy": ("theod",),
    "theo": ("theo",), "tim": ("tim",), "tom": ("thom", "tom"), "tony": ("anton", "anth"), "trish": ("patr",), "vicky": ("vict",), "walt": ("walt",), "will": ("will",),
}


def _read(tokens: list[str]) -> tuple[list[str], str]:
    """Parts of place and sorted kinds of a list of tokens."""
    places, kinds = [], []
    for t in tokens:
        if t in _LINKS or (len(t) == 1 and t != "u"):
            continue
        k = kind_of(t)
        if k is None:
            places.append(_plain(t))
        elif k not in kinds:
            kinds.append(k)
    return places, " ".join(sorted(kinds))


def readings(name: str) -> list[tuple[str, str, str, str]]:
    """Readings (form, part, kinds, lead) of a name; form is host, short, name or glued.

    A comma or brackets turn the order of the parts round; words that a newsroom adds fall away; a
    short first name is the lead of a reading of its own.
    """
    s = unicodedata.normalize("NFC", name.replace("\xa0", " ").replace("’", "'")).strip().lower()
    s = re.sub(r"\s+", " ", s)
    if not s:
        return []
    host = _HOST.match(s)
    if host:
        return [("host", ".".join(host.group(1).split(".")[-2:]), "", "")]
    head = s.split(" | ")[0].strip()
    tokens = _TOKEN.findall(head)
    cut = list(tokens)
    while len(cut) > 1 and cut[-1] in _ADDED:
        cut.pop()
    out: dict[tuple[str, str, str, str], None] = {}
    letters = _plain("".join(cut))
    if letters and len(letters) <= 12 and (len(cut) == 1 or all(len(t) == 1 for t in cut)):
        out["short", letters, "", ""] = None
    orders = [cut]
    m = re.match(r"^(.*?)\s*[,(]\s*(.*?)\)?$", head)
    if m and m.group(2):
        a, b = _TOKEN.findall(m.group(1)), _TOKEN.findall(m.group(2))
        while len(b) > 1 and b[-1] in _ADDED:
            b.pop()
        orders.append(b + a)
    for order in orders:
        places, kinds = _read(order)
        if not places:
            continue
        out["name", " ".join(places), kinds, ""] = None
        if len(places) > 1:
            out["name", " ".join(reversed(places)), kinds, ""] = None
            if places[0] in NICKNAMES:
                out["name", " ".join(places[1:]), kinds, places[0]] = None
            if places[0].startswith("u") and "-" in head and not kinds:
                out["name", " ".join(places)[1:], "uni?", ""] = None
    if len(cut) <= 2 and len(letters) >= 10:
        out["glued", letters, "", ""] = None
    return list(out)


def listed_forms(name: str, abbreviation: str | None, domain: str | None) -> list[tuple[str, str, str, str]]:
    """Forms (form, part, kinds, lead) of a listed institution; the lead is a founder's first name."""
    tokens = _TOKEN.findall(unicodedata.normalize("NFC", name).lower())
    places, kinds = _read(tokens)
    out = [("glued", _plain("".join(tokens)), "", "")]
    if places:
        out.append(("name", " ".join(places), kinds, ""))
        if len(places) == 2 and "at" not in tokens and kinds == "university":
            out.append(("name", places[1], kinds, places[0]))
    if abbreviation and abbreviation.strip():
        out.append(("short", _plain("".join(_TOKEN.findall(abbreviation.lower()))), "", ""))
    if domain and domain.strip():
        out.append(("host", domain.strip().lower(), "", ""))
    return out


def kinds_cost(typed: str, listed: str) -> int | None:
    """How far typed words of kind are from a listed name's: 0 the same, more for words left out, None if they differ."""
    a, b = set(typed.split()), set(listed.split())
    if not a:
        return 4
    own = b & _UNIVERSITIES
    if "uni?" in a:
        a.discard("uni?")
        if not own:
            return None
        a |= own
    cost = 0
    if "university" in a and own and "university" not in b:
        a = a - {"university"} | own
        cost = 2
    if not a <= b:
        return None
    for x in b - a:
        if x in _MAY_LACK and any(y in a for y in _MAY_LACK[x]):
            cost += 1
        else:
            return None
    return cost


def score(edits: int, form: str, kinds: str, lead: str, listed_kinds: str, listed_lead: str) -> int | None:
    """Rank of a candidate, smaller is better, or None if the readings do not agree."""
    if form != "name":
        return edits * 16
    cost = kinds_cost(kinds, listed_kinds)
    if cost is None:
        return None
    if lead:
        if not listed_lead.startswith(NICKNAMES[lead]) or not listed_lead:
            return None
        cost += 1
    elif listed_lead:
        if not kinds:
            return None
        cost += 3
    return edits * 16 + cost


def allowed(form: str, part: str) -> int:
    """Edits allowed in a typed part: none in a host or abbreviation, one a word and two in all in a name, three in a name written without spaces."""
    if form in ("host", "short"):
        return 0
    return 3 if form == "glued" else min(EDITS, 1 + part.count(" "))


def plain_edits(form: str) -> int:
    """Plain edits that the segments of a form must survive: with none a part is one segment."""
    return 0 if form in ("host", "short") else PLAIN_EDITS


def shifts(segment: int, delta: int, k: int) -> tuple[int, int]:
    """Smallest and largest shift of a whole segment if at most k edits make the lengths differ by ``delta``."""
    return max(-segment, delta - (k - segment)), min(segment, delta + (k - segment))


def cuts(length: int, k: int) -> list[tuple[int, int]]:
    """Start and length of the k + 1 segments of a text, as even as can be, the longer ones last."""
    base, more = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (i >= k + 1 - more)
        out.append((at, size))
        at += size
    return out


def segments(part: str, k: int = PLAIN_EDITS) -> list[tuple[int, int, str]]:
    """Index entries (length, segment number, segment) of a listed part."""
    return [(len(part), i, part[s : s + n]) for i, (s, n) in enumerate(cuts(len(part), k))]


def probes(part: str, k: int = PLAIN_EDITS) -> list[tuple[int, int, str]]:
    """Substrings (length, segment number, substring) of a typed part to look up; each once."""
    out = set()
    size = len(part)
    for length in range(max(1, size - k), size + k + 1):
        for i, (s, n) in enumerate(cuts(length, k)):
            lo, hi = shifts(i, size - length, k)
            for shift in range(lo, hi + 1):
                at = s + shift
                if at >= 0 and at + n <= size:
                    out.add((length, i, part[at : at + n]))
    return sorted(out)


_READ = pa.schema([("name", pa.string()), ("form", pa.string()), ("part", pa.string()), ("kinds", pa.string()), ("lead", pa.string())])


def _name_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(n, *r) for n in b.column("name").to_pylist() for r in readings(n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], schema=_READ)


_LISTED = pa.schema([("institution_id", pa.int64()), ("form", pa.string()), ("part", pa.string()), ("kinds", pa.string()), ("lead", pa.string())])


def _listed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, n, a, d in zip(*(b.column(c).to_pylist() for c in ("institution_id", "name", "abbreviation", "domain"))):
            if n and n.strip():
                rows += [(i, *f) for f in listed_forms(n, a, d)]
        yield pa.RecordBatch.from_pylist([dict(zip(_LISTED.names, r)) for r in rows], schema=_LISTED)


def _cut_rows(make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, keys = [], []
            for form, part in zip(b.column("form").to_pylist(), b.column("part").to_pylist()):
                for length, i, text in make(part, plain_edits(form)):
                    parts.append((form, part))
                    keys.append(f"{form} {length} {i} {text}")
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()), pa.array(keys, pa.string())], names=["form", "part", "key"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for form, part, listed in zip(*(b.column(c).to_pylist() for c in ("form", "part", "listed"))):
            k = allowed(form, part)
            d = osa(part, listed, k)
            if d <= k:
                rows.append({"form": form, "part": part, "listed": listed, "edits": d})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("form", pa.string()), ("part", pa.string()), ("listed", pa.string()), ("edits", pa.int32())]))


def similar_parts(typed: DataFrame, listed: DataFrame) -> DataFrame:
    """(form, part, listed, edits) of typed and listed parts (form, part) within the edits allowed."""
    schema = "form string, part string, key string"
    lookups = typed.mapInArrow(_cut_rows(probes), schema)
    index = listed.mapInArrow(_cut_rows(segments), schema).select("key", F.col("part").alias("listed"))
    met = lookups.join(index, "key").where(F.levenshtein("part", "listed", PLAIN_EDITS) >= 0).select("form", "part", "listed")
    # few bytes but much work: the pairs are dealt to all tasks, which adaptive execution would join into one
    tasks = int(typed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(tasks, "form", "part", "listed").distinct()
    return met.mapInArrow(_verify, "form string, part string, listed string, edits int")


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ("edits", "form", "kinds", "lead", "l_kinds", "l_lead")
    for b in batches:
        scores = [score(*r) for r in zip(*(b.column(c).to_pylist() for c in columns))]
        yield pa.RecordBatch.from_arrays([b.column("name"), b.column("institution_id"), pa.array(scores, pa.int32())], names=["name", "institution_id", "score"])


def linked_names(names: DataFrame, institutions: DataFrame) -> DataFrame:
    """(name, institution_id) of each distinct typed name (column name) that means one listed institution.

    A name for which two institutions stand equally near is not linked, nor are null and blank names.
    """
    read = materialize(names.where(F.trim("name") != "").select("name").distinct().mapInArrow(_name_rows, "name string, form string, part string, kinds string, lead string"), "readings")
    listed = materialize(
        institutions.select(F.col("institution_id").cast("long"), "name", "abbreviation", "domain").mapInArrow(
            _listed_rows, "institution_id long, form string, part string, kinds string, lead string"
        ),
        "listed",
    )
    near = similar_parts(read.select("form", "part").distinct(), listed.select("form", "part").distinct())
    forms = listed.select("form", F.col("part").alias("listed"), "institution_id", F.col("kinds").alias("l_kinds"), F.col("lead").alias("l_lead"))
    typed = read.join(near, ["form", "part"]).join(forms, ["form", "listed"])
    columns = ["name", "institution_id", "edits", "form", "kinds", "lead", "l_kinds", "l_lead"]
    scored = typed.select(columns).mapInArrow(_score, "name string, institution_id long, score int").where(F.col("score").isNotNull())
    best = scored.groupBy("name").agg(
        F.min(F.struct("score", "institution_id")).alias("low"), F.min(F.struct("score", (-F.col("institution_id")).alias("minus"))).alias("high")
    )
    return best.where(F.col("low.institution_id") == -F.col("high.minus")).select("name", F.col("low.institution_id").alias("institution_id"))


def variant_spellings(articles: DataFrame, institutions: DataFrame) -> DataFrame:
    """(article_id, institution_id) of articles whose university_name means a listed institution but is not exactly its name."""
    own = articles.select("article_id", F.col("university_name").alias("name")).where(F.col("name").isNotNull())
    exact = institutions.select("name").distinct()
    typed = own.join(exact, "name", "left_anti")
    links = linked_names(typed.groupBy("name").agg(F.count("*").alias("n")), institutions)
    return typed.join(links, "name").select("article_id", "institution_id").distinct()


def entries(articles: DataFrame, institutions: DataFrame) -> DataFrame:
    """Each article (article_id, university_name, institution_id) with the listed institution meant, or null."""
    exact = institutions.groupBy("name").agg(F.min("institution_id").alias("institution_id"))
    names = articles.select(F.col("university_name").alias("name")).where(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("n"))
    links = exact.unionByName(linked_names(names.join(exact, "name", "left_anti"), institutions))
    own = articles.select("article_id", F.col("university_name").alias("name"))
    return own.join(links, "name", "left").select("article_id", F.col("name").alias("university_name"), "institution_id")
