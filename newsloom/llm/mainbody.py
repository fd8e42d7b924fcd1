"""Main body of a page by tree scoring.

A page is read as a tree: the page, its containers and the lines as leaves. Each line passes points for
its length and its commas to its container, discounted by its link density. Containers without points are
dropped, the best one is kept, and so are those of its siblings that score well against it, that are prose
without links, or that speak of the same names.

In text that has lost its markup, link density is estimated. A line that different stories of the site
share is all link (see :mod:`newsloom.llm.sitelines`); so is one of menu words, one that a cue shows to be
furniture, and what stands under a heading over other stories. A short line without a full stop is mostly
link, prose is none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.lines import BLANK, BLOCK, BY, FURN, STORY, line_key, local_class, normal, teaser_tail

if TYPE_CHECKING:
    from newsloom.llm.sitelines import Known

_NAME = re.compile(r"\b[A-ZÀ-ÖØ-ÞŒŠŽ]\w*(?:[-’']\w+)*")
#: A sentence that goes on with another one: other stories are announced in one sentence.
_TWO_SENTENCES = re.compile(r"[.!?][”“\"»]? [“\"«„A-ZÀ-ÖØ-ÞŒŠŽ¿¡]")
_LOWER = re.compile(r"\b[a-zß-öø-ÿœšž]{2,}")
_STOP_AT_END = (".", "!", "?", "”", '"', "“", "»", ":", "…")
#: A sibling is kept from this share of the best container's points on.
SIBLING_SHARE = 0.2
#: Link density of a short line without a full stop.
SHORT_LINE = 0.6

# Words that begin sentences or are written large without being names.
_NO_NAMES = frozenset(
    """the a an in on at of for from to by with and or but if as so no not it its they their we our he she this that these those one two
    three some most many much more all any both each every other another students student researchers research small large earlier
    colleagues officials critics sensors error errors rate rates according differences funding not nobody why how what when where
    who can could would will may university college institute school state national laboratory center department foundation annals
    technology polytechnic medicine school community group team study news today access page report results data according first second third next last new open tests campus
    der die das den dem des ein eine einer eines einem einen im in am an auf aus bei mit nach nachts von vom zu zum zur über und oder
    aber dass wer was wie wo ob mehr nur ältere größere bislang gefördert kritisch studierende ergebnisse gruppe studie anlage
    vorhaben universität arbeit zeitschrift fachblatt blätter stunden minuten daten proben messungen monate stiftung labor
    el la los las un una unos unas en de del al con por para y o que quien según tras más al mismo nadie con ayuntamiento proyecto
    estudio universidad fondo cuadernos resultados horas datos equipo centro grupo otro otra
    le les l’ d’ un une des du au aux en et ou que qui selon après plus avec pour par dans sur étude projet université fonds revue
    cahiers résultats heures équipe groupe autre deux""".split()
)


def names_of(line: str) -> set[str]:
    """Capitalised words of a line that are no common openings, in lower case.

    Of two such words in a row the first is taken for a first name, which many people share, and left out.
    """
    out: set[str] = set()
    run: list[str] = []
    end = -1
    for m in _NAME.finditer(line):
        w = m.group().lower()
        if m.start() != end + 1 or w in _NO_NAMES:
            out.update(run[-1:] if len(run) == 2 else run)
            run = []
        if len(w) > 2 and w not in _NO_NAMES:
            run.append(w)
        end = m.end()
    out.update(run[-1:] if len(run) == 2 else run)
    return out


def points(line: str, link_density: float) -> float:
    """Points of a text line: one, one a comma, one for each hundred characters up to three, discounted by its link density."""
    return (1 + line.count(",") + min(len(line) / 100, 3)) * (1 - link_density)


def story_marks(title: str | None, lines: list[str], keys: list[int]) -> tuple[int, int]:
    """Two hashes that differ from story to story and mostly agree over the copies of one: its longest line, and a name of its headline."""
    longest = keys[max(range(len(lines)), key=lambda i: len(lines[i]))]
    named = min((line_key(w) for w in names_of(title or "")), default=0) or line_key(title or "")
    return longest, named or longest


def _prose(low: str) -> bool:
    """True for a line of some length that ends in a stop."""
    return len(low) > 45 and low.endswith(_STOP_AT_END)


def rough_prose(lines: list[str]) -> int:
    """Characters of a page in long lines that end in a stop, its own and its site's alike."""
    return sum(len(x) for x in lines if len(x) >= 60 and x.rstrip().endswith(_STOP_AT_END))


class _Classes(dict):
    """Local class of each line met so far, by its normal form; furniture comes again and again."""

    def __missing__(self, low: str) -> int:
        if len(self) > 200_000:
            self.clear()
        k = self[low] = local_class(low)
        return k


_CLASSES = _Classes()


def densities(title: str | None, lines: list[str], lows: list[str], repeated: list[bool] | None = None) -> tuple[list[int], list[float]]:
    """Class and link density of each line of a page.

    Headline and bylines have none. A line that other stories of the site have too is all link, as is one
    whose words are those of menus and prompts; a short line without a full stop is mostly link; prose is
    none.
    """
    title_low = normal(title or "")
    kind = [_CLASSES[x] if len(x) < 400 else local_class(x) for x in lows]
    density = [0.0] * len(lines)
    for i, k in enumerate(kind):
        low = lows[i]
        if k in (STORY, BLOCK) and title_low and (low == title_low or (len(low) > 20 and (title_low.startswith(low) or low.startswith(title_low)))):
            kind[i] = BY
        elif k in (FURN, BLOCK) or (k == STORY and repeated is not None and repeated[i]):
            density[i] = 1.0
        elif k == STORY:
            density[i] = 0.0 if len(low) > 45 or low.endswith(_STOP_AT_END) else SHORT_LINE
    return kind, density


def furniture(title: str | None, lines: list[str], about: str | None = None, repeated: list[bool] | None = None) -> list[bool]:
    """For each line, true if it is not part of the story. Blank lines are never furniture.

    ``about`` is other text that names what the story is about: its keywords. ``repeated`` marks lines
    that other stories of the same site have as well.

    The page is a tree of containers: a line that is all link stands alone in one, the lines between such
    lines are one, and a heading over other stories takes the lines after it into its own. Lines pass their
    points to their container. A container without points is dropped; one that scores well against the best
    is kept, and of the others those lines that are prose without links or share names with the best.
    """
    n = len(lines)
    lows = [normal(x) for x in lines]
    kind, density = densities(title, lines, lows, repeated)
    names: dict[int, set[str]] = {}

    def named(i: int) -> set[str]:
        if i not in names:
            names[i] = names_of(lines[i])
        return names[i]

    def is_text(i: int) -> bool:
        return kind[i] == STORY and density[i] < 1

    def topic(skip: set[int]) -> set[str]:
        """Names the story turns on: those of the headline and those of two lines or more."""
        seen: dict[str, int] = {}
        lower: set[str] = set()
        for i in range(n):
            if is_text(i) and i not in skip:
                lower.update(_LOWER.findall(lines[i]))
                for w in named(i):
                    seen[w] = seen.get(w, 0) + 1
        return {w for w, c in seen.items() if c >= 2 and w not in lower} | {w for w in names_of(title or "") if w not in lower and (w in seen or not seen)}

    story_names: set[str] | None = None
    if BLOCK in kind:
        # a heading over other stories opens a block; it ends where prose on the story's own names goes on
        inside: set[int] = set()
        on = False
        for i in range(n):
            on = kind[i] == BLOCK or (on and (is_text(i) or kind[i] == BLANK))
            if on:
                inside.add(i)
        story_names = topic(inside)
        headline = names_of(title or "") | names_of(about or "")
        story_names |= headline
        i = 0
        while i < n:
            if kind[i] != BLOCK:
                i += 1
                continue
            j = i + 1
            titles: set[str] = set()  # names in the titles of the other stories
            fellow: set[str] = set()  # names in their teasers
            prose: list[int] = []
            ended = False
            while j < n and (is_text(j) or kind[j] in (BLANK, BLOCK)):
                if kind[j] == STORY:
                    low = lows[j]
                    if _prose(low) and not teaser_tail(low):
                        own_names = named(j) - titles
                        # one sentence announces another story: what follows it, or has two, is the story itself
                        if own_names & headline or prose or _TWO_SENTENCES.search(" ".join(lines[j].split())) or (own_names & story_names and not own_names & (fellow - story_names)):
                            ended = True
                            break
                        fellow |= named(j)
                        prose.append(j)
                    else:
                        # a subhead or list item of the story names nothing but what the story is about
                        own = named(j) & story_names
                        opening = lows[j].split(" ", 1)[0]
                        if (own & headline or len(own) > 1) and not named(j) - story_names - {opening}:
                            ended = True
                            break
                        titles |= named(j)
                        prose.clear()
                j += 1
            if ended:
                # prose right before belongs to the story if it shares names with what goes on
                after: set[str] = set()
                for x in range(j, n):
                    if kind[x] != BLANK and not is_text(x):
                        break
                    if kind[x] == STORY:
                        after |= named(x)
                while prose and named(prose[-1]) & after - titles:
                    j = prose.pop()
                    after |= named(j)
            for x in range(i + 1, j):
                if kind[x] == STORY:
                    density[x] = 1.0  # what a listing holds leads to other pages
            i = j
    # lines pass their points to their containers
    containers: list[tuple[float, list[int]]] = []
    open_one = False
    for i in range(n):
        if kind[i] == BLANK:
            continue
        if kind[i] == BY:
            open_one = False
            continue
        score = points(lows[i], density[i])
        alone = density[i] >= 1
        if open_one and not alone:
            total, members = containers[-1]
            members.append(i)
            containers[-1] = (total + score, members)
        else:
            containers.append((score, [i]))
        open_one = not alone
    out = [False] * n
    best, best_lines = max(containers, key=lambda c: c[0], default=(0.0, []))
    own_words = set(normal(title or "").split())
    for score, members in containers:
        if score and score >= SIBLING_SHARE * best:
            continue
        for x in members:
            low = lows[x]
            if score and (_prose(low) or len(own_words.intersection(low.split())) >= 2):
                continue
            if score:
                if story_names is None:
                    story_names = topic(set())
                if named(x) & (story_names | set().union(*(named(y) for y in best_lines))):
                    continue
            out[x] = True
    return out


def page_lines(content: str) -> list[str]:
    """Lines of a page: split at each newline; a carriage return before it is no part of the line."""
    return content.split("\n")


PAGE_COLUMNS = ("article_id", "title", "content", "about", "shared")


def pages(articles: DataFrame, known: Known | None) -> DataFrame:
    """The columns that a page is read from; keywords name its subject where the table has them.

    The institution is no such hint: the other stories of a site are often about the same one.
    """
    have = dict(articles.dtypes).get("keywords") == "array<string>"
    subject = F.array_join("keywords", ". ") if have else F.lit(None).cast("string")
    rows = articles.select("article_id", F.col("title").cast("string"), F.col("content").cast("string"), subject.alias("about"))
    return (known.beside(rows) if known else rows.withColumn("shared", F.lit(None).cast("array<int>"))).select(*PAGE_COLUMNS)


def reader(known: Known | None) -> Callable[[str | None, str, str | None, list[int] | None], tuple[list[str], list[bool]]]:
    """A function that gives the lines of a page and whether each is no part of the story."""
    marks = known.marker() if known else None

    def read(title: str | None, content: str, about: str | None, shared: list[int] | None) -> tuple[list[str], list[bool]]:
        lines = page_lines(content)
        return lines, furniture(title, lines, about, marks(lines, shared) if marks else None)

    return read


_OFF = pa.schema([("article_id", pa.int64()), ("line_no", pa.int32())])


def off_lines(articles: DataFrame, excluded: DataFrame | None = None, known: Known | None = None) -> DataFrame:
    """Lines (article_id, line_no) that are no part of the story, from 1 on and blank lines included in the count.

    Null or empty content gives no rows, nor do articles in ``excluded`` (article_id). ``known`` holds the
    lines that sites share; without it a page is judged by itself.
    """
    rows = pages(articles.where(F.length("content") > 0), known)
    if excluded is not None:
        rows = rows.join(excluded.select("article_id").distinct(), "article_id", "left_anti")
    read = reader(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nos = [], []
            for aid, *page in zip(*(b.column(c).to_pylist() for c in PAGE_COLUMNS)):
                for i, off in enumerate(read(*page)[1], 1):
                    if off:
                        ids.append(aid)
                        nos.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32())], schema=_OFF)

    return rows.mapInArrow(run, "article_id long, line_no int")


_BODY = pa.schema([("article_id", pa.int64()), ("body", pa.string()), ("kept", pa.int32()), ("dropped", pa.int32())])


def story(lines: list[str], off: list[bool]) -> str:
    """The story of a page as text."""
    return "\n".join(x for x, o in zip(lines, off) if not o)


def main_bodies(articles: DataFrame, known: Known | None = None) -> DataFrame:
    """Each article with its main body: (article_id, body, kept, dropped); null content stays null."""
    read = reader(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for aid, *page in zip(*(b.column(c).to_pylist() for c in PAGE_COLUMNS)):
                if page[1] is None:
                    rows.append((aid, None, 0, 0))
                else:
                    lines, off = read(*page)
                    rows.append((aid, story(lines, off), len(off) - sum(off), sum(off)))
            yield pa.RecordBatch.from_pylist([dict(zip(_BODY.names, r)) for r in rows], schema=_BODY)

    return pages(articles, known).mapInArrow(run, "article_id long, body string, kept int, dropped int")
