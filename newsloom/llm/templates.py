"""Template residue, filler text and error pages (problem 4).

Lines of pages without a story, and lines that hold a cue of a message, are mined for templates with a
fixed-depth prefix tree: the first level is the number of tokens, the next ones are the first tokens, and
a leaf holds groups of lines that agree in at least half of their tokens; where they differ a group has a
wildcard. What finds no company from its first tokens on is grown again from its last ones. The distinct
masked lines of a leaf meet in one task, which grows the groups in an order that hangs on the lines alone
and judges each template once: one that stands for a story on pages of several unrelated hosts is a
message, whatever its words; a rarer one must match a known wording. The verdict goes back to the articles
that hold the line. Unfilled slots inside ordinary text are found apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.lines import STORY, line_key, local_class, normal
from newsloom.llm.mainbody import furniture, page_lines, rough_prose
from newsloom.llm.sitelines import RICH, Known
from newsloom.plans.materialize import materialize

#: A page has a story of its own from this many characters of prose on, messages not counted.
STORY_CHARS = 200
#: A template is judged by its spread from so many pages without a story, hosts and headlines on.
PAGES, HOSTS = 4, 3
#: A leaf of the tree is grown in parts of so many lines.
LEAF_LINES = 20_000
#: Filler without a single function word shows itself by one classical word from so many words on.
LEAST_FILLER = 8
#: Lines of up to so many tokens are parted by their first token alone, longer ones by two.
BRIEF = 4
#: Lines agree in a leaf of the tree if this share of their tokens agrees.
AGREE = 0.5
WILD = "<*>"

# Forms of unfilled slots. The first word of each pair must occur before the pattern is tried.
_FIELD = r"(?:title|sub\s?title|headline|body|summary|caption|author|date|deck|lede|lead|bio|quote|name|text|content|image|description|excerpt|keywords?|byline|section|tags?|url|link|slug|first_?name|last_?name)"
_SLOTS = [
    ("{{", r"\{\{[^{}\n]{0,60}\}\}"),
    ("[[", r"\[\[\s*[A-Za-z_.]{2,40}\s*\]\]"),
    ("${", r"\$\{[^{}\n]{1,60}\}"),
    ("#{", r"#\{[^{}\n]{1,60}\}"),
    ("<%", r"<%[=-]?[^%\n]{1,80}%>"),
    ("<?", r"<\?(?:php|=)[^\n]{0,100}?\?>"),
    ("{%", r"\{%[^%\n]{1,80}%\}"),
    ("%%", r"%%[A-Za-z_]{2,40}%%"),
    ("%(", r"%\([a-zA-Z_]{1,40}\)[sdifr]\b"),
    ("__", r"(?<![A-Za-z0-9_])__[A-Z][A-Z_]{1,40}?__(?![A-Za-z0-9_])"),
    ("@model", r"@Model\.\w+"),
    ("@item", r"@Item\.\w+"),
    ("[object", r"\[object Object\]"),
    ("goes here", r"(?i:\[[^\]\n]{1,40} goes here\])"),
    ("[insert", r"(?i:\[insert [^\]\n]{1,40}\])"),
    ("{0}", r"\{\d\}"),
    ("{1}", r"\{\d\}"),
    ("_placeholder", r"<\w+_placeholder>"),
    ("placeholder_", r"<placeholder_\w+>"),
    ("{", r"(?<![{$#%\w])\{" + _FIELD + r"\}(?!\})"),
    ("tk ", r"\bTK " + _FIELD + r" TK\b"),
    ("$", r"\$" + _FIELD.upper() + r"\$|\$" + _FIELD + r"\$"),
    ("[", r"\[" + _FIELD.upper() + r"\]"),
]
_SLOTS = [(a, re.compile(p)) for a, p in _SLOTS]

# Wordings of messages. What they say of a page: an error, a block, scripts required, filler text.
_MESSAGES = {
    "error": """not found|could not be found|page you requested|page you are looking for|what you were looking for|internal server error|unexpected condition|service unavailable
temporarily unavailable|bad gateway|gateway timeout|invalid response|upstream server|database connection|error establishing|erreur 404|erreur 500|error 404|error 500|error 403
fehler 404|fehler 500|introuvable|nicht gefunden|existiert nicht mehr|no encontrad|no existe|undefined index|traceback|exception in|fatal error|parse error|stack trace|keyerror
has been removed|no longer available|content is unavailable|while rendering|on line |under maintenance|down for maintenance|no está disponible|n’est plus disponible|n'est plus disponible|nicht mehr verfügbar|wartungsarbeiten|en mantenimiento|en maintenance|out of memory|syntax error
server error|something went wrong|unavailable""",
    "block": """access denied|access to this page|do not have permission|forbidden|too many requests|rate limited|checking your browser|verify you are|are you a robot|captcha|unusual traffic
has been blocked|zugriff verweigert|acceso denegado|accès refusé|accès interdit|permission denied|not authorized|please log in|please sign in|has expired|session expired|ray id
request blocked|ddos protection""",
    "scripts": """javascript|enable scripts|switch scripts on|turn on scripts|scripts are required|browser is not supported|browser not supported|unsupported browser|loading|enable cookies to""",
    "filler": """lorem ipsum|lorem|ipsum|dolor sit|amet|body copy|blindtext|texto de relleno|texte de remplissage|faux texte|dummy text|filler text|sample paragraph|placeholder text|sample text
please ignore|asdf|qwer|xxx xx|replace before publishing|sustituir antes de publicar|à remplacer avant|vor veröffentlichung ersetzen|test article|testartikel|testbeitrag|do not publish|text text text|bla bla
quick brown fox|to be written|copy to come""",
}
# The classical filler vocabulary.
_LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis
    nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla
    pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum""".split()
)
_LATIN_ALONE = frozenset(("lorem", "ipsum", "amet", "consectetur", "adipiscing"))
_LATIN_MARKS = frozenset(("lorem", "ipsum", "dolor", "amet", "sit", "consectetur", "adipiscing"))
# Words that prose of four languages is likely to hold; filler of Latin look has next to none of them.
_FUNCTION = frozenset(
    """the of and to a in is that for it with as was on by at from said der die das und ist von mit auf für ein eine den dem wird el la los las de del y que en un una
    por con se su le les des du et est une dans pour sur au aux il elle zu im um aus nach bei am so wie nur no or not has have be are were
    this they he she we you can what how why where when which who para más según como lo qui que pas plus par ce cette""".split()
)

# Known wordings of messages, for templates too rare to be judged by their spread. The first that fits as a whole counts.
_WHOLE = [
    ("error", r"(?:http )?(?:error |erreur |fehler )?(?:code )?(?:[45]\d\d|<\*>)\b\W*(?:error|not found|forbidden|internal server error|service unavailable|bad gateway|gateway time-?out|unauthorized|too many requests)?\W*(?:<\*>|\d+)?"),
    ("error", r"(?:(?:page|seite|página|document|file|url|resource) )?(?:not found|nicht gefunden|no encontrada|non trouvée|introuvable)\W*"),
    ("error", r"(?:the |die |la |le )?(?:requested )?(?:page|seite|página|content|document|url)\b.{0,80}(?:could not be found|was not found|introuvable|no existe|nicht gefunden|is no longer available)\b.{0,40}"),
    ("error", r"(?:this|the) (?:content|page|article|story) (?:has been removed|is (?:temporarily |no longer )?(?:un)?available)\b.{0,80}"),
    ("error", r"(?:internal server error|service unavailable|bad gateway|gateway time-?out)\b.{0,80}"),
    ("error", r"(?:oops\W*)?something went wrong\b.{0,80}|error establishing a database connection\W*"),
    ("error", r"(?:warning|notice|fatal error|parse error|traceback)\W*:? .{0,120}"),
    ("block", r"(?:<n> )?(?:access denied|forbidden|too many requests|permission denied|zugriff verweigert|acceso denegado|accès refusé)\W*"),
    ("block", r"you do not have permission\b.{0,100}|you have been (?:rate limited|blocked)\b.{0,80}|checking your browser\b.{0,80}"),
    ("scripts", r"(?:please |you need to |you must |veuillez |por favor,? |bitte )?(?:enable|turn on|activate|activer|activez|active|aktivieren(?: sie)?) (?:javascript|scripts)\b.{0,100}"),
    ("scripts", r"(?:this|the|our) (?:site|page|app|website|story)\b.{0,30} (?:requires|needs) (?:javascript|scripts)\b.{0,120}|javascript (?:is|must be) (?:disabled|required|enabled)\b.{0,140}"),
    ("scripts", r"loading\b[\w <>*-]{0,40}(?:…|\.\.\.)?"),
    ("filler", r"(?:.*\W)?lorem ipsum dolor\b.*|(?:sample paragraph\W*){1,12}|(?:this is )?(?:dummy|filler|placeholder|sample) text\b.{0,160}|(?:.{0,20}\b)?(?:blindtext|texto de relleno|faux texte)\b.{0,120}"),
]
_WHOLE = [(v, re.compile(p)) for v, p in _WHOLE]

_NUMBER = re.compile(r"\b\d[\d.,:]*\b")
_PATH = re.compile(r"(?<!\S)/\S+")
_TOKEN = re.compile(r"\S+")
_WORD = re.compile(r"[^\W\d_]+")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, (x, _) in enumerate(_SLOTS):
        a.add_word(x, ("slot", i)) if x not in a else None
    for what, words in _MESSAGES.items():
        for x in words.replace("\n", "|").split("|"):
            if x not in a:
                a.add_word(x, ("message", what))
    a.make_automaton()
    return a


_CUES = _automaton()
_BY_START: dict[str, list[re.Pattern]] = {}
for _x, _p in _SLOTS:
    _BY_START.setdefault(_x, []).append(_p)


def cues(low: str) -> tuple[set[str], bool]:
    """Slot openings in a text in lower case, and whether it holds a cue of a message."""
    slots: set[str] = set()
    message = False
    for _, (kind, x) in _CUES.iter(low):
        if kind == "slot":
            slots.add(_SLOTS[x][0])
        else:
            message = True
    return slots, message


def has_slot(text: str, openings: set[str]) -> bool:
    """True if the text holds an unfilled slot of one of the forms whose opening was seen."""
    return any(p.search(text) for x in openings for p in _BY_START[x])


def tokens(line: str) -> list[str]:
    """Tokens of a line in its normal form; paths and numbers are wildcards from the start."""
    low = normal(line)
    return _TOKEN.findall(_NUMBER.sub("<n>", _PATH.sub(WILD, low)))


class Tree:
    """Prefix tree of fixed depth over token lists: length, first token, second token, then groups."""

    def __init__(self, agree: float = AGREE):
        self.agree = agree
        self.leaves: dict[tuple[int, str, str], list[list]] = {}

    @staticmethod
    def leaf(toks: list[str]) -> tuple[int, str, str]:
        first = [(WILD if any(c.isdigit() or c == "<" for c in t) else t) for t in toks[: 2 if len(toks) > BRIEF else 1]]
        return (len(toks), first[0] if first else "", first[1] if len(first) > 1 else "")

    def add(self, toks: list[str], count: int = 1) -> list:
        """Put a token list into the group it agrees with most, or into a new one; returns the group."""
        groups = self.leaves.setdefault(self.leaf(toks), [])
        best, most = None, -1.0
        for g in groups:
            same = sum(a == b or a == WILD for a, b in zip(g[0], toks)) / max(1, len(toks))
            if same >= self.agree and same > most:
                best, most = g, same
        if best is None:
            best = [list(toks), 0]
            groups.append(best)
        elif most < 1:
            best[0] = [a if a == b else WILD for a, b in zip(best[0], toks)]
        best[1] += count
        return best


def latin_filler(low: str) -> bool:
    """Filler of Latin look: marks of it, and no words that prose of a covered language needs."""
    words = _WORD.findall(low)
    if len(words) < 4:
        return False
    marks = sum(w in _LATIN_MARKS for w in words)
    if marks == 0:
        return False
    function = sum(w in _FUNCTION for w in words)
    known = sum(w in _LATIN for w in words)
    return function <= 0.08 * len(words) and (known >= 0.15 * len(words) or marks >= 2 or (function == 0 and len(words) >= LEAST_FILLER and any(w in _LATIN_ALONE for w in words)))


def verdict(template: str) -> str | None:
    """What a known wording says of its page, or None: error, block, scripts or filler."""
    for what, p in _WHOLE:
        if p.fullmatch(template) or p.fullmatch(template.replace("<n>", "404")):
            return what
    return "filler" if latin_filler(template) else None


def subject(template: str) -> str:
    """The kind of message that a template's words point to, the first in the order of the kinds; ``message`` where they point to none."""
    found = {x for _, (kind, x) in _CUES.iter(template) if kind == "message"}
    return next((w for w in ("filler", "scripts", "block", "error") if w in found), "message")


_ROWS = pa.schema(
    [("article_id", pa.int64()), ("url_id", pa.int64()), ("slot", pa.bool_()), ("prose", pa.int64()), ("mark", pa.int64()), ("lines", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64()))]
)


def read_page(title: str | None, content: str | None, shared: list[int] | None, marks) -> tuple[bool, int, list[str], list[int]] | None:
    """(slot, prose, masked lines, sizes) of a page, or None where nothing speaks against it.

    ``slot`` is true where a slot is unfilled or the story is Latin filler as a whole. ``prose`` counts the
    characters of the page's own text lines, ``sizes`` those of each line of it, 0 for the headline, below 0
    for furniture: a message may stand among other stories and be taken for one of them. A page is looked into if it holds a cue, or too little prose to be a story.
    """
    text = f"{title or ''}\n{content or ''}"
    slots, message = cues(text.lower())
    if slots and has_slot(text, slots):
        return True, 0, [], []
    lines = page_lines(content or "")
    if not message and (not content or rough_prose(lines) >= RICH):
        return None
    off = furniture(title, lines, None, marks(lines, shared) if marks and content else None)
    masked, sizes, prose, own_text = [], [], 0, []
    head = normal(title or "")
    for i, line in enumerate([title or "", *lines]):
        low = normal(line)
        if not low:
            continue
        own = len(low) if i and low != head and not off[i - 1] and local_class(low) == STORY else 0
        prose += own
        if own:
            own_text.append(low)
        masked.append((line, low, own if own or not i or low == head else -len(low)))
    if message and latin_filler(" ".join(own_text)):
        return True, 0, [], []
    if not prose and not any(own < 0 and cues(low)[1] for _, low, own in masked):  # a page may say its message as headline and text
        masked = [(x, low, len(low) if i and low == head else own) for i, (x, low, own) in enumerate(masked)]
        prose = sum(max(own, 0) for _, _, own in masked)
    kept = [(" ".join(tokens(x)), own) for x, low, own in masked if cues(low)[1] or (own > 0 and prose < STORY_CHARS)]
    return (False, prose, [x for x, _ in kept], [own for _, own in kept]) if kept else None


def mined(articles: DataFrame, known: Known | None = None) -> DataFrame:
    """Rows (article_id, url_id, slot, prose, mark, lines, sizes) of the articles with something to judge; ``mark`` tells headlines apart."""
    rows = articles.select("article_id", "url_id", F.col("title").cast("string"), F.col("content").cast("string"))
    rows = known.beside(rows) if known else rows.withColumn("shared", F.lit(None).cast("array<int>"))
    marks = known.marker() if known else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for aid, url, title, content, shared in zip(*(b.column(c).to_pylist() for c in ("article_id", "url_id", "title", "content", "shared"))):
                told = read_page(title, content, shared, marks)
                if told:
                    slot, prose, lines, sizes = told
                    out.append((aid, url, slot, prose, line_key(title or ""), lines, sizes))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_ROWS)], schema=_ROWS)

    return rows.mapInArrow(run, "article_id long, url_id long, slot boolean, prose long, mark long, lines array<string>, sizes array<long>")


_BITS = (1 << 64) - 1
_STATS = ("n", "pages", "hosts", "marks")
_JUDGED = pa.schema([("line", pa.string()), ("template", pa.string()), ("own", pa.string()), *((c, pa.int64()) for c in _STATS)])


def grown(rows: list[tuple], backwards: bool, agree: float = AGREE) -> list[tuple]:
    """Rows (line, template) of the distinct lines (line, n) of one leaf; the template is what the line's group has in common at the end."""
    tree = Tree(agree)
    out = []
    for line, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        toks = line.split(" ")
        out.append((line, tree.add(toks[::-1] if backwards else toks, n)))
    return [(line, " ".join(reversed(g[0]) if backwards else g[0])) for line, g in out]


def judged(template: str, pages: int, hosts: int, marks: int) -> tuple[str | None, bool]:
    """Verdict of a template, and whether its spread gives it: bitmaps of hosts and headlines tell how many there are."""
    wide = pages >= PAGES and (hosts & _BITS).bit_count() >= HOSTS and (marks & _BITS).bit_count() >= HOSTS
    return (subject(template), True) if wide and set(template.split(" ")) != {WILD} else (verdict(template), False)


def _grow(backwards: bool, agree: float):
    """Grows the templates of each part of a leaf, one part after the other; lines come with what they say by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(rows: list[tuple]) -> pa.RecordBatch:
            stats = {r[0]: r[1:] for r in rows}
            out = [(line, t, verdict(line), *stats[line]) for line, t in grown([r[:2] for r in rows], backwards, agree)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_JUDGED)], schema=_JUDGED)

        at, rows = None, []
        for b in batches:
            for leaf, salt, *row in zip(*(b.column(c).to_pylist() for c in ("leaf", "salt", "line", *_STATS))):
                if (leaf, salt) != at and rows:
                    yield part(rows)
                    rows = []
                at = (leaf, salt)
                rows.append(tuple(row))
        if rows:
            yield part(rows)

    return run


@F.pandas_udf(T.StructType([T.StructField("verdict", T.StringType()), T.StructField("spread", T.BooleanType())]))
def _verdicts(template: pd.Series, pages: pd.Series, hosts: pd.Series, marks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judged(*r) for r in zip(template, map(int, pages), map(int, hosts), map(int, marks))], columns=["verdict", "spread"])


def _leaf(line: str, backwards: bool) -> Column:
    """Leaf of a line as in :meth:`Tree.leaf`: tokens with a digit or a wildcard are one, and short lines have one level less."""
    toks = F.reverse(F.split(line, " ")) if backwards else F.split(line, " ")
    first = [F.when(F.get(toks, F.lit(i)).rlike(r"[<\p{Nd}\p{No}]"), WILD).otherwise(F.coalesce(F.get(toks, F.lit(i)), F.lit(""))) for i in (0, 1)]
    return F.concat_ws(" ", F.size(toks).cast("string"), first[0], F.when(F.size(toks) > BRIEF, first[1]))


def _summed(lines: DataFrame, key: str) -> DataFrame:
    return lines.groupBy(key).agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"), F.bit_or("hosts").alias("hosts"), F.bit_or("marks").alias("marks"))


def _round(lines: DataFrame, backwards: bool, agree: float, most: int) -> DataFrame:
    """(line, template, own) and the counts of each line, with its template.

    A leaf of more than ``most`` lines is grown in parts, dealt by the hash of the line; the templates of the
    parts, which are few, are then grown together like lines, so no task holds more than ``most`` lines or the templates of one leaf.
    """
    lines = lines.withColumn("leaf", _leaf("line", backwards))
    large = materialize(lines.groupBy("leaf").agg(F.count("*").alias("_c")).where(F.col("_c") > most), "leaves")
    none = large.isEmpty()
    dealt = lines.withColumn("salt", F.lit(0).cast("long")) if none else lines.join(large, "leaf", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("line"), F.ceil(F.col("_c") / most)), F.lit(0)))

    def grow(df: DataFrame) -> DataFrame:
        placed = df.select("leaf", "salt", "line", *_STATS).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt")
        return placed.mapInArrow(_grow(backwards, agree), "line string, template string, own string, n long, pages long, hosts long, marks long")

    first = grow(dealt)
    if none:
        return first
    first = materialize(first, "parts")
    split = first.withColumn("leaf", _leaf("line", backwards)).join(large.select("leaf"), "leaf", "left_semi")
    again = grow(_summed(split, "template").withColumnRenamed("template", "line").withColumn("leaf", _leaf("line", backwards)).withColumn("salt", F.lit(0).cast("long")))
    renamed = again.select(F.col("line").alias("template"), F.col("template").alias("_whole"))
    return first.join(renamed, "template", "left").withColumn("template", F.coalesce("_whole", "template")).drop("_whole")


def _told(lines: DataFrame) -> DataFrame:
    """Lines with the verdict of their template, judged once, or else their own."""
    templates = _summed(lines, "template").withColumn("v", _verdicts("template", "pages", F.coalesce("hosts", F.lit(0)), F.coalesce("marks", F.lit(0)))).select("template", "v")
    return lines.join(templates, "template").select("line", *_STATS, F.coalesce("v.verdict", "own").alias("verdict"), F.col("v.spread").alias("spread"))


def line_verdicts(rows: DataFrame, urls: DataFrame | None = None, agree: float = AGREE, most: int = LEAF_LINES) -> DataFrame:
    """(line, verdict, spread) of each masked line that is part of a message.

    Lines are summed up before they move: how often they come, on how many pages without a story, and
    bitmaps of the hosts and headlines of those pages. What has no verdict from its first tokens on is grown again from its last ones.
    """
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(c, F.lit(64)).cast("int"))
    if urls is not None:
        hosts = urls.where(F.col("hostname").isNotNull()).groupBy("url_id").agg(F.min(F.xxhash64("hostname")).alias("h"))
        rows = rows.join(hosts, "url_id", "left")
    else:
        rows = rows.withColumn("h", F.lit(None).cast("long"))
    each = rows.where(~F.col("slot")).select("prose", "mark", "h", F.explode(F.arrays_zip("lines", "sizes")).alias("t"))
    poor = (F.col("t.sizes") > 0) & (F.col("prose") < STORY_CHARS)
    counted = each.groupBy(F.col("t.lines").alias("line")).agg(
        F.count("*").alias("n"), F.count_if(poor).alias("pages"), F.bit_or(F.when(poor & F.col("h").isNotNull(), bit(F.col("h")))).alias("hosts"), F.bit_or(F.when(poor, bit(F.col("mark")))).alias("marks")
    )
    ahead = materialize(_told(materialize(_round(materialize(counted, "lines"), False, agree, most), "grown")), "ahead")
    back = _told(materialize(_round(ahead.where("verdict IS NULL").select("line", *_STATS), True, agree, most), "grown"))
    return ahead.unionByName(back).where("verdict IS NOT NULL").select("line", "verdict", "spread")


def residue(articles: DataFrame, urls: DataFrame | None = None, known: Known | None = None, agree: float = AGREE) -> DataFrame:
    """Articles (article_id, reason) that are template residue, filler or an error page.

    A slot or filler anywhere in title or content counts; an error, a block page, a notice that scripts
    are required or another message counts only where less than ``STORY_CHARS`` characters of other prose
    stand, and not more of them than of the message if only its spread speaks for it. Null or empty content is no case by itself. Repeated rows of one article come out once.
    Without ``urls`` no template is judged by its spread over hosts. A page is never judged by words that it lacks, so stories in any language pass.
    """
    rows = materialize(mined(articles, known), "templates")
    verdicts = line_verdicts(rows, urls, agree)
    long = rows.where(~F.col("slot")).select("article_id", "prose", F.explode(F.arrays_zip("lines", "sizes")).alias("t"))
    filler = F.col("verdict") == "filler"
    told = (
        long.select("article_id", "prose", F.col("t.lines").alias("line"), F.col("t.sizes").alias("own"))
        .join(verdicts, "line")
        .groupBy("article_id")
        .agg(
            F.bool_or(filler).alias("filler"),
            F.bool_or(~F.col("spread")).alias("known"),
            F.min(F.when(~filler, F.col("verdict"))).alias("verdict"),
            F.max("prose").alias("prose"),
            F.sum(F.greatest("own", F.lit(0))).alias("own"),
            F.sum(F.greatest(-F.col("own"), F.lit(0))).alias("aside"),
        )
        .where(F.col("filler") | ((F.col("prose") - F.col("own") < STORY_CHARS) & (F.col("known") | (2 * F.col("own") + F.col("aside") >= F.col("prose")))))
        .select("article_id", F.when(F.col("filler"), F.lit("filler")).otherwise(F.col("verdict")).alias("reason"))
    )
    slots = rows.where("slot").select("article_id", F.lit("slot or filler").alias("reason"))
    return slots.unionByName(told).groupBy("article_id").agg(F.min("reason").alias("reason"))
