"""Lines of a page: normal forms, cue words and the local class of a line.

All cues are fixed values: short wordings that most sites use, in English, German, Spanish and French,
matched on the normal form of a line (see :func:`normal`). They serve lines that stand on one page only
and sites of few pages; what a site says in its own words is known by coming again on its other pages.
One Aho-Corasick automaton finds the cues, so that a line of prose costs one pass whatever their number.
"""

from __future__ import annotations

import re

import ahocorasick
import xxhash

_EDGE = "-–—•*>·|›»«#+=~_ \t"


def normal(line: str) -> str:
    """One space for each run of white space, no bullets or arrows at the edges, lower case."""
    return " ".join(line.split()).strip(_EDGE).lower()


_NOT_LETTERS = re.compile(r"[\W\d_]+")
_ASCII_OTHERS = bytes(i for i in range(128) if not chr(i).isalpha())


def line_key(line: str) -> int:
    """64-bit hash of a line's letters in one letter case; 0 for a line without letters."""
    if line.isascii():
        letters = line.encode().translate(None, _ASCII_OTHERS).upper()
    else:
        kept = _NOT_LETTERS.sub("", line)
        if not kept.isalpha():  # raised digits and the like
            kept = "".join(filter(str.isalpha, kept))
        letters = kept.upper().encode("utf-8", "surrogatepass")
    return (xxhash.xxh3_64_intdigest(letters) - (1 << 63) or 1) if letters else 0


def _list(text: str) -> list[str]:
    return [x.strip() for x in text.replace("\n", "|").split("|") if x.strip()]


# Words that menus consist of.
MENU = frozenset(
    _list(
        """home|events|careers|athletics|directory|campus map|news|newsroom|academics|admissions|alumni|giving|libraries|library
        magazine|media contacts|podcasts|research|student life|topics|visit us|about|about us|contact|contact us|search|menu|sign in
        log in|login|register|faculty|staff|students|calendar|archive|archives|departments|schools|people|jobs|press|publications|sports
        startseite|studium|presse|aktuelles|bibliothek|fakultäten|forschung|karriere|kontakt|termine|über uns|suche|anmelden
        veranstaltungen|campus|verwaltung|hochschule|universität|medien|newsletter
        inicio|agenda|biblioteca|prensa|facultades|empleo|investigación|noticias|contacto|estudios|alumnado|actualidad|buscar
        sobre nosotros|egresados|deportes|admisión|accueil|actualités|recherche|emplois|bibliothèque|facultés|formation|formations
        contacts|annuaire|événements|vie étudiante|admission|à propos|rechercher"""
    )
)

# A line that begins so is page furniture, in short wordings that most sites use.
_BEGINS = _list(
    """back to top|nach oben|zum seitenanfang|volver arriba|haut de page|retour en haut|skip to |jump to |zum inhalt|ir al contenido|saltar al contenido
    aller au contenu|open menu|close menu|menü öffnen|menü schließen|abrir menú|cerrar menú|ouvrir le menu|fermer le menu
    share:|share this|share on |teilen:|compartir:|partager:|partager :|subscribe |folgen sie |siga a |síganos|suivez |follow us
    tags:|tags :|topics:|filed under|keywords:|themen:|schlagwörter|schlagworte|stichwörter|etiquetas:|temas:|mots-clés|mots clés|sujets :|étiquettes :
    comment by |comment from |reader comment|kommentar von |comentario de |commentaire de |leave a comment|leave a reply
    advertisement:|advertising:|sponsored:|anzeige:|werbung:|publicidad:|anuncio:|publicité :|publicité:|annonce :
    ©|(c) |copyright |contact us|media contact:|media contacts |pressekontakt|contacto de prensa|contact presse|impressum|aviso legal|mentions légales|print this page
    loading|enable javascript|enable scripts|please enable javascript|please enable scripts"""
)

# A line that contains one of these is page furniture, in short wordings that most sites use.
_CONTAINS = _list(
    """cookie settings|cookie notice|cookie policy|uses cookies|use cookies|verwendet cookies|utiliza cookies|utilise des cookies|privacy notice|accept all|copy link
    all rights reserved|some rights reserved|alle rechte vorbehalten|todos los derechos reservados|tous droits réservés|equal opportunity employer|terms of use|site map"""
)

# A line with the words before the sign must also match the pattern after it.
_PATTERNS = [
    ("\nweather", r"^weather\b.*\d"),
    ("\nwetter", r"^wetter\b.*\d"),
    ("tiempo en ", r"^(?:el )?tiempo en\b.*\d"),
    ("\nmétéo", r"^météo\b.*\d"),
    ("doors at", r"\bdoors at \d"),
    (" room ", r"^(?:seminar|talk|lecture|workshop|reading)\b.*\broom \d+"),
    (" hall ", r"\bhall \d+$"),
    ("hörsaal", r"\bhörsaal \d+$"),
    ("aula ", r"\baula \d+$"),
    ("salle ", r"\bsalle \d+$"),
    ("shares", r"^\d+ shares\b"),
]

# Headings over blocks of other stories.
_HEADINGS = _list(
    """you may also |you might also |most read|most popular|most viewed|more from |more on |more stories|more news|related stories|related articles|related news
    related content|related posts|read next|read more|read also|also in |also on |trending|latest news|latest stories|latest headlines|headlines|top stories|our latest|recommended|in other news|other stories
    weitere meldungen|weitere artikel|weitere nachrichten|weitere themen|weitere beiträge|meistgelesen|mehr zum thema|mehr aus |mehr von |lesen sie auch|auch interessant
    verwandte |noticias relacionadas|lo más leído|lo mas leido|más noticias|más leíd|otras noticias|también le puede|te puede interesar|artículos relacionados|lea también
    le puede interesar|à lire aussi|à lire également|les plus lus|sur le même sujet|articles liés|articles connexes|autres articles|autres actualités|dans la même|voir aussi"""
)

# Openings of a byline.
_BY = tuple(_list("by|written by|story by|text by|reported by|von|text:|por|texto de|par|escrito por|rédigé par|texte de"))
_BY = tuple(x + " " for x in _BY)
_BY_FORM = re.compile(
    r"""^[^.!?:|]{3,50}\ \|\ .{2,60}\ (?:writer|staff|reporter|correspondent|editor|redaktion|redacción|rédaction)$
      | ^[^.!?:|]{2,60}\ (?:communications|staff)$ | ^pressestelle\ .{2,60}$ | ^redacción\ de\b.{2,60}$ | ^la\ rédaction\b.{2,60}$ | ^redaktion\ .{2,60}$""",
    re.VERBOSE,
)
_TEASER_TAIL = re.compile(r"(?:–|-|\()\s*(?:\d+\s*min(?:ute)?s?\b.{0,8}|lesezeit\b.*|lectura\b.*|lecture\b.*|\d+\s*minuten.*)\)?$")
_COUNTED = re.compile(r"^[^\d.?!(]{3,45} \(\d+\)$")
_DATED = re.compile(r"^\d{1,2}/\d{1,2}\b|^\d{1,2}\. ?\d{1,2}\. ")
_SEP = re.compile(r"\s*[|•·/›»>]\s*|\s{2,}|\t")
_NO_FORM = re.compile(r"[.!?:|]")

BLANK, STORY, FURN, BLOCK, BY = 0, 1, 2, 3, 4
#: A cue makes a line furniture up to this many characters for each cue that it holds.
CHARS_A_CUE = 260


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    kinds: dict[str, list] = {}
    for x in _BEGINS:
        kinds.setdefault("\n" + x, []).append((FURN, None))
    for x in _CONTAINS:
        kinds.setdefault(x, []).append((FURN, None))
    for x, p in _PATTERNS:
        kinds.setdefault(x, []).append((FURN, re.compile(p)))
    for x in _HEADINGS:
        kinds.setdefault("\n" + x, []).append((BLOCK, None))
    for x, v in kinds.items():
        a.add_word(x, v)
    a.make_automaton()
    return a


_CUES = _automaton()
_SEP_SIGNS = frozenset("|•·/›»>")


def menu_parts(line: str) -> tuple[int, int]:
    """How many parts of a line are menu words, and how many parts it has."""
    parts = [p.strip(" .!:") for p in _SEP.split(line.strip(_EDGE + "!:.").lower())]
    parts = [p for p in parts if p]
    return sum(p in MENU for p in parts), len(parts)


def _menu_run(words: list[str]) -> bool:
    """True if words are menu entries one after the other."""
    i = n = 0
    while i < len(words):
        if i + 1 < len(words) and f"{words[i]} {words[i + 1]}" in MENU:
            i += 2
        elif words[i] in MENU:
            i += 1
        else:
            return False
        n += 1
    return n > 0


def _menu_glued(letters: str) -> bool:
    """True if a word is menu entries written together, as lost markup leaves them."""
    ends = {0}
    for i in range(len(letters)):
        if i in ends:
            for j in range(i + 3, min(i + 24, len(letters)) + 1):
                if letters[i:j] in _MENU_GLUED:
                    ends.add(j)
    return len(letters) in ends


_MENU_GLUED = frozenset(x.replace(" ", "") for x in MENU)
_MENU_HEADS = tuple({x[:4] for x in _MENU_GLUED})


def local_class(low: str) -> int:
    """Class of a line on its own, from its normal form: blank, page furniture, heading of a block, byline, or text."""
    if not low:
        return BLANK
    size = len(low)
    if size < 240:
        bare = low.strip(" .!:")
        if bare in MENU:
            return FURN
        if size < 160 and (not low.endswith((".", "”", "?")) or "›" in low or "»" in low):
            hits, parts = menu_parts(low)
            if parts > 1 and hits and (hits == parts or (parts > 2 and (hits >= 2 or any(c in low for c in "›»>/")))):
                return FURN
            if hits == 0 and parts == 1:
                words = bare.split(" ")
                if words[0] in MENU or " ".join(words[:2]) in MENU:
                    if _menu_run(words):
                        return FURN
                if low.startswith(_MENU_HEADS) and _menu_glued(bare.replace(" ", "")):
                    return FURN
        if size < 90:
            if low.startswith(_BY) and not _NO_FORM.search(bare) and bare.count(" ") < 10:
                return BY
            if _BY_FORM.search(bare):
                return BY
        if low.endswith((")", ")!", "):", ").")) and _COUNTED.search(bare):
            return FURN  # a prompt with the number of those who followed it
        if _DATED.search(low) and size < 100 and (":" in low or "–" in low):
            return FURN
    hits = 0
    for _, found in _CUES.iter("\n" + low):
        for kind, pattern in found:
            if kind == BLOCK:
                if size < 90 and not low.endswith((".", "”")):
                    return BLOCK
            elif pattern is None or (size < 400 and pattern.search(low)):
                hits += 1
                if hits * CHARS_A_CUE >= size:
                    return FURN
    return STORY


def teaser_tail(low: str) -> bool:
    """A reading time at the end, as listings of other stories have it."""
    return bool(_TEASER_TAIL.search(low))
