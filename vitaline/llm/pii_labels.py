"""Rules that label training texts for the tagger of personal information.

Numbers, mail and postal addresses are labelled by general notations (country codes, postcodes, words for streets, the
names of official numbers). Names are not listed anywhere: given names are harvested from the sample itself after
titles, family names after titles and given names, and a passage is a name if its shape is one and its words were harvested.
Used to make training rows and held-out agreement only; the operator never calls these rules.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

# fixed values: titles, nouns that follow an eponym, and the names of official numbers in four languages
TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Mme|Mlle|Herr|Frau|Sra|Sr|Srta)\.?"
THINGS = r"(?:index|score|scale|criteria|criterion|test|method|disease|syndrome|classification|sign|procedure|class|grade|interval|equation|formula|status)"
NUMBER_NAMES = (
    r"(?:social security (?:number|no\.)|national insurance (?:number|no\.)|medical record (?:number|no\.)|NHS (?:number|no\.)|SSN|MRN|passport (?:number|no\.)|driving licence|driver's license|"
    r"Sozialversicherungsnummer|Patientennummer|Ausweisnummer|Reisepassnummer|Führerscheinnummer|Versichertennummer|numéro de sécurité sociale|numéro de passeport|numéro de dossier patient|"
    r"DNI|NIE|número de pasaporte|historia clínica (?:n\.º|número))"
)
STREET = "Street|St|Road|Rd|Lane|Ln|Close|Drive|Dr|Gardens|Court|Ct|Avenue|Ave|Blvd|Boulevard|Way|Terrace|Crescent|Place|Square|Row|Hill"

_word = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]+"
_given = rf"{_word}(?:-{_word})?"
_part = r"(?:van der |von der |van |von |de la |de |del |di |da |al-)"
_family = rf"{_part}?{_word}(?:-{_word})?"
SHAPES = re.compile(
    rf"(?<![\w@.+-])(?:(?P<g1>{_given}) (?:[A-Z]\. )?(?P<f1>{_family})|[A-Z]\. (?P<f2>{_family})|(?P<f3>{_family}), (?:(?P<g3>{_given})(?: [A-Z]\.)?|[A-Z]\.(?!\w)))(?![\w@])"
)
TITLED = re.compile(rf"\b{TITLES} (?:(?P<g>{_given}) (?:[A-Z]\. )?)?(?P<f>{_family})(?![\w@])")
EMAIL = re.compile(r"[\w.+-]+(?:@| ?[\(\[]at[\)\]] ?)[\w-]+(?:(?:\.| ?[\(\[]dot[\)\]] ?)[\w-]+)*(?:\.| ?[\(\[]dot[\)\]] ?)[A-Za-z]{2,}", re.I)
PHONE = re.compile(
    r"(?<![\w.+:/-])(?:(?:\+|00)\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]?\d){7,12}|(?:1[ .-])?\(\d{3}\)[ -]\d{3}[ -]\d{4}|(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}"
    r"|\(0\d{1,4}\) ?\d(?:[ -]?\d){5,9}|0\d{1,4}[ /.]\d(?:[ .-]?\d){5,9}|\d{3} \d{3} \d{3})(?![\w-]|[.:]\d)"
)
NOT_PHONE = re.compile(r"(?:lot|batch|kit|tube|serial|barcode|sample|number|no\.|n\.º|nummer)\s$", re.I)
ID_NO = re.compile(rf"(?<!\w)(?i:{NUMBER_NAMES}):? ((?=[A-Z -]{{0,8}}\d)[A-Z\d]+(?:[ -](?:\d[A-Z\d]*|[A-Z](?!\w)))*)(?!\w)")
_TOWN = r"[A-ZÄÖÜÉ][\w'-]+(?: [A-ZÄÖÜÉ][\w'-]+)?"
ADDRESS = re.compile(
    rf"(?<![\w.@-])(?:\d{{1,5}}[a-z]? (?:[NSEW]\. )?(?:[A-Z][a-z'-]+ ){{1,3}}(?:{STREET})\b(?:,? (?:Suite|Apt|Flat|Unit) \w+)?(?:(?:, |\n){_TOWN},? (?:[A-Z]{{2}} \d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}})\b)?"
    rf"|\d{{1,4}}(?: bis| ter)?,? (?:avenue|rue|quai|impasse|chemin|allée|place|boulevard|cours|square) (?:du |de la |de l'|des |de |d')?[\w-]+(?:(?:, |\n)\d{{5}} {_TOWN})?"
    rf"|(?:C/|Calle|Avenida|Plaza|Paseo|Camino) ?(?:de la |de los |del |de )?[A-Z]\w+(?: [A-Z]\w+)?,?(?: n\.º)? \d{{1,4}}(?:(?:, |\n)\d{{5}} {_TOWN})?"
    rf"|(?:(?:Am|An der|Im|Zum|Zur) (?:[A-ZÄÖÜ]\w+ )?[A-ZÄÖÜ]\w+|[A-ZÄÖÜ]\w+er (?:Weg|Straße|Platz|Allee)|[A-ZÄÖÜ][a-zäöüß]+(?:straße|str\.|gasse|allee|weg|platz|ring)) \d{{1,4}}[a-z]?(?:(?:, |\n)\d{{5}} {_TOWN})?)"
)
LEAST = 2


def _words(s: str | None) -> list[str]:
    return [w for w in re.findall(r"[^\W\d_]+", s or "") if w[0].isupper()]


@dataclass(frozen=True)
class Lexicon:
    """Words harvested as given and family names, and the words that also occur in lower case."""

    given: frozenset[str]
    family: frozenset[str]
    common: frozenset[str]

    def is_given(self, s: str | None) -> bool:
        return bool(ws := _words(s)) and all(w in self.given for w in ws)

    def is_family(self, s: str | None) -> bool:
        return bool(ws := _words(s)) and all(w.capitalize() in self.family for w in ws)

    def may_be(self, s: str | None) -> bool:
        return bool(ws := _words(s)) and all(w.lower() not in self.common and len(w) > 2 for w in ws)


def harvest(texts: Iterable[str]) -> Lexicon:
    """Words met at least LEAST times in a name's place: given names after titles, family names after titles or given names."""
    texts = [t for t in texts if t]
    common = frozenset(w for t in texts for w in re.findall(r"(?<=[ \n])[^\W\d_A-ZÀ-Þ][^\W\d_]+(?=[ ,;:\n])", t))
    given, family = Counter(), Counter()
    lex = Lexicon(frozenset(), frozenset(), common)
    for t in texts:
        for m in TITLED.finditer(t):
            if lex.may_be(m["f"]) and (m["g"] is None or lex.may_be(m["g"])) and not _thing(t, m.end()):
                given.update(w for w in _words(m["g"]) if not w.isupper())
                family.update(w.capitalize() for w in _words(m["f"]) if m["g"] and not m["g"].isupper())
    lex = Lexicon(frozenset(w for w, n in given.items() if n >= LEAST), frozenset(), common)
    for t in texts:
        for m in SHAPES.finditer(t):
            g, f = m["g1"] or m["g3"], m["f1"] or m["f3"]
            if lex.is_given(g) and lex.may_be(f) and not lex.is_given(f):
                family.update(w.capitalize() for w in _words(f))
    return Lexicon(lex.given, frozenset(w for w, n in family.items() if n >= LEAST and w not in lex.given), common)


def _thing(text: str, at: int) -> bool:
    return re.match(rf"[ -]{THINGS}\b", text[at : at + 20]) is not None


def names(text: str, lex: Lexicon) -> list[tuple[int, int]]:
    out, at = [], 0
    while (m := SHAPES.search(text, at)) is not None:
        if m["g1"]:
            upper = m["g1"].isupper() and lex.is_family(m["g1"]) and lex.is_given(m["f1"])  # FAMILY Given
            fine = upper or (lex.is_given(m["g1"]) and not lex.is_given(m["f1"]) and (lex.is_family(m["f1"]) or lex.may_be(m["f1"])))
        elif m["f2"]:
            fine = lex.is_family(m["f2"])
        else:
            fine = lex.is_family(m["f3"]) and (m["g3"] is None or lex.is_given(m["g3"]))
        if fine:
            out.append(m.span())
            at = m.end()
        else:  # the next word may begin a name
            at = m.start() + re.match(r"[^\W_]+\W?", text[m.start() :]).end()
    for m in TITLED.finditer(text):
        if m["g"] is None and lex.is_family(m["f"]) and not _thing(text, m.end()):
            out.append(m.span("f"))
    return out


def label(text: str, lex: Lexicon) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the passages the rules know, without overlaps, in order."""
    taken: list[tuple[str, int, int]] = []

    def add(kind: str, a: int, b: int) -> None:
        if all(b <= s or a >= e for _, s, e in taken):
            taken.append((kind, a, b))

    for m in EMAIL.finditer(text):
        add("email", *m.span())
    for m in ADDRESS.finditer(text):
        if not re.search(r"(?:Cohort|Period|Part|Room|Level) $", text[max(0, m.start() - 10) : m.start()]):
            add("address", *m.span())
    for m in ID_NO.finditer(text):
        if sum(c.isdigit() for c in m[1]) >= 4:
            add("id_no", *m.span(1))
    for m in PHONE.finditer(text):
        if not NOT_PHONE.search(text[max(0, m.start() - 10) : m.start()]):
            add("phone", *m.span())
    for a, b in names(text, lex):
        add("name", a, b)
    return sorted(taken, key=lambda x: x[1])
