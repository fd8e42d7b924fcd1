"""Text functions as column expressions: counts, markup, shortening, names and responses of models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: One character of white space in the widest sense: no-break and other wide spaces and the separators of records count too.
SPACE = r"(?U)[\s\x1c-\x1f]"


def word_count(text: Column) -> Column:
    """Number of words parted by white space of any kind; null counts as none."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE + "+"), lambda x: x != "")), F.lit(0))


def given(value: Column, default: str) -> Column:
    """The value, or a default where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


# Markup to strip, in the order in which it goes.
_MARKUP = (
    (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"), (r"\*([^*]+)\*", "$1"), (r"_([^_]+)_", "$1"), (r"`([^`]+)`", "$1"),
    (r"(?mU)^#{1,6}\s+", ""), (r"(?m)^[-*_]{3,}$", ""), (r"<[^>]+>", ""),
)


def _chain(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def plain(text: Column) -> Column:
    """Text without Markdown and tags, for digests; null gives an empty text."""
    return _stripped(_chain(F.coalesce(text, F.lit("")), _MARKUP))


def plain_line(text: Column) -> Column:
    """Text on one line without code blocks, bracketed lists, Markdown and tags, for pages; null gives an empty text."""
    t = _chain(F.coalesce(text, F.lit("")), ((r"(?s)```[a-zA-Z]*\n?.*?```", ""), ("```", "")))
    head = F.regexp_extract(t, r"(?s)^([^\[]+)\s*\[", 1)
    t = F.when(head != "", _stripped(head)).otherwise(F.regexp_replace(t, r"[\[\]]", ""))
    return _stripped(F.regexp_replace(_chain(t, _MARKUP), SPACE + "+", " "))


def shortened(text: Column, most: int = 300) -> Column:
    """Text of at most ``most`` characters cut at the last space, with three dots; a text without space is cut hard."""
    head = F.substring(text, 1, most)
    at_space = F.regexp_extract(head, "(?s)^(.*) ", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(head.contains(" "), at_space).otherwise(head), F.lit("...")))


def long_date(value: Column) -> Column:
    """A date in words, the text itself where it is no date, and a note where there is none."""
    return F.coalesce(F.date_format(F.try_to_date(value, "yyyy-MM-dd"), "MMMM dd, yyyy"), F.nullif(value, F.lit("")), F.lit("Date unknown"))


def number(value: Column) -> Column:
    """A number as text without an exponent where it is neither huge nor tiny, with at least one digit after the point."""
    digits = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), "0+$", "")
    plain_form = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when((value == 0) | F.abs(value).between(1e-4, 1e15), F.when(value == 0, "0.0").otherwise(plain_form)).otherwise(value.cast("string"))


def escaped(text: Column) -> Column:
    """Text with the five signs of HTML written as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# Display names of sources that no rule can find.
DISPLAY_NAMES = {
    "stories.tamu.edu": "Texas A&M University", "tamu.edu": "Texas A&M University", "usf.edu": "University of South Florida", "nist.gov": "NIST",
    "The Brink": "Boston University", "Universityofri": "University of Rhode Island", "FloridaAtlantic": "Florida Atlantic University",
    "UMassLowell": "UMass Lowell", "Notre Dame": "University of Notre Dame",
}


def display_name(name: Column, known: dict[str, str] = DISPLAY_NAMES) -> Column:
    """Name of an institution as readers should see it; a bare host gives its name in capitals, null gives Unknown."""
    listed = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.lit(v))))
    cut = F.trim(F.split_part(name, F.lit(" | "), F.lit(1)))
    for word in ("News", "Today", "Newsroom", "Stories"):
        cut = F.trim(F.regexp_replace(cut, f" {word}$", ""))
    label = F.element_at(F.split(F.regexp_replace(cut, r"\.(edu|gov|org|com)$", ""), r"\."), -1)
    host = F.initcap(F.regexp_replace(label, "[-_]", " "))
    parted = F.regexp_replace(cut, "([a-z])([A-Z])", "$1 $2")
    by_rule = F.when(cut.rlike(r"^[\w.-]+\.(edu|gov|org|com)$"), host).otherwise(parted)
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown").otherwise(
        F.coalesce(F.try_element_at(listed, name), F.try_element_at(listed, cut), F.nullif(F.trim(by_rule), F.lit("")), F.lit("Unknown"))
    )


def matching_name(name: Column) -> Column:
    """Name in the form in which institutions are matched: lower case, without its usual openings, one after the other."""
    n = F.lower(F.trim(name))
    for opening in ("the ", "university of ", "university at "):
        n = F.regexp_replace(n, f"^{opening}", "")
    return F.trim(n)


def file_name_key(name: Column) -> Column:
    """Name in the form in which sources are compared across files: dashes, commas and ampersands made even."""
    n = F.regexp_replace(F.lower(F.trim(name)), "^the ", "")
    n = F.regexp_replace(F.regexp_replace(n, "[-–—,]", " "), "&", " and ")
    return F.trim(F.regexp_replace(n, r"\s+", " "))


def initials(name: Column) -> Column:
    """Initials of the words that matter, in lower case."""
    words = F.filter(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: (w != "") & ~w.isin("of", "the", "and", "at", "for", "in", "de"))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def comparable_name(name: Column) -> Column:
    """Name in the form in which missing institutions are told from listed ones: lower case, one kind of dash, no commas."""
    n = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"^the\s+", ""), r"\s+", " ")
    return F.replace(F.replace(F.regexp_replace(n, "[–—]", "-"), F.lit(","), F.lit("")), F.lit("&"), F.lit("and"))


def suspicious_name(name: Column) -> Column:
    """True for names that look like hosts, bare abbreviations or general words."""
    capitals = (F.length(name) < 10) & (name == F.upper(name)) & (name != F.lower(name))
    return name.endswith(".edu") | name.endswith(".example") | capitals | F.lower(name).isin("news", "university", "college")


# Subjects that a response may name, in order.
SUBJECTS = ("Machine Learning", "NLP", "Computer Vision", "Robotics", "AI Ethics")


def subject_named(text: Column) -> Column:
    """The first of the subjects that a text names, else Other."""
    return F.coalesce(*(F.when(F.lower(text).contains(s.lower()), s) for s in SUBJECTS), F.lit("Other"))


def said_yes(text: Column) -> Column:
    """Yes or no after the words AI-related; true where a text says neither."""
    word = F.lower(F.regexp_extract(text, r"(?i)(?:3\.\s*(?:Is this )?)?AI[- ]related.*?\b(yes|no)\b", 1))
    return F.when(F.coalesce(word, F.lit("")) == "", True).otherwise(word == "yes")


def _after(text: Column, label: str) -> Column:
    return F.trim(F.regexp_extract(text, rf"(?m)^[ \t]*{label}:[ \t]*([^\n\r]*)", 1))


def _number(text: Column, default: float) -> Column:
    return F.coalesce(F.regexp_extract(text, r"^(\d+(?:\.\d+)?)(?:\s|$)", 1).try_cast("double"), F.lit(default))


def response(text: Column) -> Column:
    """A labelled response as a struct: summary, key points, relevance, verdict and three impacts.

    The summary goes on over unlabelled lines; an impact may be written as 8/10; what cannot be read
    takes its default: relevance 5, impacts 1, and a verdict that does not begin with yes is no.
    """
    label = r"(?:KEY_POINTS|RELEVANCE|AI_RELATED|SCIENTIFIC_IMPACT|FINANCIAL_IMPACT|PARTNERSHIP_IMPACT)"
    summary = F.regexp_extract(text, rf"(?ms)^[ \t]*SUMMARY:(.*?)(?=^[ \t]*{label}|\z)", 1)
    points = F.regexp_extract(text, r"(?ms)^[ \t]*KEY_POINTS:(.*?)(?=^[ \t]*(?:AI_RELATED|SCIENTIFIC_IMPACT|FINANCIAL_IMPACT|PARTNERSHIP_IMPACT|SUMMARY):|\z)", 1)
    lines = F.filter(F.transform(F.split(points, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.startswith("-"))
    impact = lambda name: _number(F.split_part(F.split_part(_after(text, f"{name}_IMPACT"), F.lit(" "), F.lit(1)), F.lit("/"), F.lit(1)), 1.0)
    return F.struct(
        F.trim(F.regexp_replace(summary, r"\s*\r?\n\s*", " ")).alias("summary"),
        F.transform(lines, lambda x: F.trim(F.substr(x, F.lit(2)))).alias("key_points"),
        _number(_after(text, "RELEVANCE"), 5.0).alias("relevance"),
        F.lower(_after(text, "AI_RELATED")).startswith("yes").alias("is_ai_related"),
        impact("SCIENTIFIC").alias("scientific"),
        impact("FINANCIAL").alias("financial"),
        impact("PARTNERSHIP").alias("partnership"),
    )


def picks(text: Column) -> Column:
    """Picks of an editor's response as an array of structs; the rank is the section's number, sections without an id fall away."""
    sections = F.split(text, r"PICK_\d+:")
    read = F.transform(
        sections,
        lambda s, i: F.struct(
            i.alias("rank"),
            F.regexp_extract(s, r"ARTICLE_ID:\s*(\d+)", 1).alias("id"),
            F.trim(F.regexp_extract(s, r"(?s)EDITORIAL_NOTE:\s*(.+?)(?=\n\s*(?:IMPACT_CATEGORY|ARTICLE_ID|PICK_)|\s*\z)", 1)).alias("note"),
            F.trim(F.regexp_extract(s, r"IMPACT_CATEGORY:\s*([^\n]+)", 1)).alias("category"),
        ),
    )
    return F.transform(
        F.filter(read, lambda r, i: (i > 0) & (r["id"] != "")),
        lambda r: F.struct(
            r["rank"].alias("rank"), r["id"].cast("long").alias("article_id"), r["note"].alias("note"),
            F.coalesce(F.nullif(r["category"], F.lit("")), F.lit("Scientific Breakthrough")).alias("category"),
        ),
    )


def short_response(text: Column) -> Column:
    """A short labelled response as a struct: summary and verdict; without a label the text is the summary and the verdict is yes."""
    labelled = F.contains(text, F.lit("AI_RELATED:"))
    head, tail = F.split_part(text, F.lit("AI_RELATED:"), F.lit(1)), F.split_part(text, F.lit("AI_RELATED:"), F.lit(2))
    summary = F.when(labelled & F.contains(head, F.lit("SUMMARY:")), _stripped(F.replace(head, F.lit("SUMMARY:"), F.lit("")))).otherwise(text)
    return F.struct(summary.alias("summary"), F.when(labelled, F.contains(F.lower(tail), F.lit("yes"))).otherwise(True).alias("is_ai_related"))
