"""Personal items in free text: offset-preserving normalisation, detection, placeholders.

A text first passes transducers: one replaces characters one for one (homoglyphs, full-width
forms, odd blanks), the others rewrite stretches (wrong decodings, ligatures, combining and
invisible characters, words broken at line ends, page headers inside sentences, then spelled
digits and the words of e-mail signs) and keep where each stretch came from. Items are detected in
the normalised text and mapped back to the source. Every document is handled on its own, in Arrow
batches; nothing is shuffled.

What is bounded, and why: a page header is a line of under 110 characters that ends in a page
number; a local part is sought in the 254 characters before its sign, the length of an address; a
name has at most six words, of which three are not initials or particles.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = {"person": "[PERSON]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}

# ---------------------------------------------------------------- normalisation

#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKE = dict(zip("АВЕКМНОРСТУХасеорухіјѕԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTYXaceopyxijsdABEZHIKMNOPTYXo", strict=True))
ONE = {ord(a): b for a, b in LOOKALIKE.items()}
ONE |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
ONE |= dict.fromkeys([0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x0D, 0x0B, 0x0C, 0x09], " ")
ONE |= dict.fromkeys([0x2010, 0x2011, 0x2212, 0xFE63], "-") | dict.fromkeys([0x2018, 0x2019, 0x02BC, 0x60, 0xB4], "'")

#: The odd characters that most texts hold are replaced by plain string passes, the rest by table.
OFTEN = [("\r", " "), ("\t", " "), ("\xa0", " "), ("\u202f", " "), ("\u2019", "'"), ("\u2018", "'")]
ODD = re.compile("[" + "".join(map(re.escape, map(chr, ONE))) + "]")

LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_CP1252 = "".join(chr(c) for c in {*range(0x80, 0xC0), *(ord(bytes([b]).decode("cp1252", "replace")) for b in range(0x80, 0xA0))} - {0xFFFD})
RARE = re.compile(
    rf"[ÂÃÄÅ][{_CP1252} '\-]|â[{_CP1252} '\-]{{2}}"
    "|[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\xad\u0300-\u036f]+|[ﬀ-ﬆ]"
)
#: What such a stretch begins with: it is sought first, as are other first letters below, which is much quicker.
RARE_FIRST = re.compile("[ÂÃÄÅâ\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\xad\u0300-\u036fﬀ-ﬆ]")
SPLIT = re.compile(r"- *\n *(?=[^\W\d_])")
PAGE = re.compile(r"Page \d+ *(?:\n|$)")
FOLIO = re.compile(r"(?<=\n) *- \d+ - *\n")
FOLIO_HINT = re.compile(r"- \d+ -")


def _mended(s: str) -> str:
    if s[0] in LIGATURES:
        return LIGATURES[s[0]]
    if s[0] in "ÂÃÄÅâ":
        for codec in ("cp1252", "latin-1"):
            for blank in ("\xa0", " "):
                try:
                    return s.replace(" ", blank).encode(codec).decode("utf-8").translate(ONE)
                except UnicodeError:
                    continue
        return s
    return ""


def _edits(t: str) -> list[tuple[int, int, str]]:
    """Stretches to rewrite, in order, none overlapping."""
    out = []
    b = 0
    for first in RARE_FIRST.finditer(t) if not t.isascii() else ():
        if first.start() < b or not (m := RARE.match(t, first.start())):
            continue
        a, b = m.span()
        if "\u0300" <= t[a] <= "\u036f" and a:  # marks belong to the letter before them
            out.append((a - 1, b, unicodedata.normalize("NFC", t[a - 1 : b])))
        else:
            out.append((a, b, _mended(m.group())))
    for m in SPLIT.finditer(t):
        before, after = t[m.start() - 1 : m.start()], t[m.end()]
        if before.isalnum():
            out.append((m.start(), m.end(), "-" if after.isupper() else ""))
    if "Page " in t:
        for m in PAGE.finditer(t):
            line = t.rfind("\n", 0, m.start()) + 1
            if m.start() - line < 110:
                out.append((line, m.end(), ""))
    if FOLIO_HINT.search(t):
        out += [(m.start(), m.end(), "") for m in FOLIO.finditer(t)]
    out.sort()
    kept, last = [], 0
    for a, b, new in out:
        if a >= last and t[a:b] != new:
            kept.append((a, b, new))
            last = b
    return kept


#: The digits in four languages.
DIGIT_WORDS = [
    "zero null zéro cero oh nought", "one eins ein un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro",
    "five fünf fuenf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
]
DIGIT = {w: str(i) for i, words in enumerate(DIGIT_WORDS) for w in words.split()}
TIMES = {"double": 2, "doppel": 2, "triple": 3}
_SPELT = "|".join(sorted(DIGIT, key=len, reverse=True))
#: Six or more digits, spelled or some of them figures.
SPELT_DIGITS = re.compile(rf"(?i)(?<![\w-])(?:plus[\s,]+)?(?:(?:double\s|doppel\s|triple\s)?(?:{_SPELT})[\s,.\-]{{1,3}}){{5,}}(?:double\s|triple\s)?(?:{_SPELT})(?![\w-])")
DIGIT_TOKENS = {w + sign for w in DIGIT for sign in ("", ",", ".")}


def _digits(run: str) -> str:
    out, times = [], 1
    for w in re.findall(r"\w+", run.lower()):
        if w == "plus":
            out.append("+")
        elif w in TIMES:
            times = TIMES[w]
        else:
            out.append(DIGIT[w] * times)
            times = 1
    return "".join(out)


_DOT = r"(?:\.|\s*[\(\[\{<]\s*(?i:dot|punkt|point|punto)\s*[\)\]\}>]\s*|\s+(?:DOT|dot|punkt|punto|point)\s+)"
DOT_SIGN = re.compile(_DOT)
BRACKETED = re.compile(r"[\(\[\{<]\s*(?i:at|ät|arroba|arobase|klammeraffe)\s*[\)\]\}>]\s*")
SPELT = re.compile(r"\s(?P<word>AT|at|arroba|arobase)\s+")
DOT_WORDS = ("AT", "DOT", " dot", "punkt", "punto", "point", "arroba", "arobase")
#: A local part before a spelled sign may have spelled dots; letters only may stand before those.
SPELT_LOCAL = re.compile(rf"(?<![\w.+\-@█*])[A-Za-z0-9][\w.+\-]*(?:{_DOT}[\w+\-]+)*$")
DOMAIN = re.compile(rf"\s*[A-Za-z0-9][\w\-]*(?P<rest>(?:{_DOT}[A-Za-z][\w\-]*)+)")


def _mail_signs(t: str) -> Iterator[tuple[int, int, str]]:
    """Words of e-mail signs to rewrite: the place of the sign between local part and domain, and
    the dots of both."""
    places = [(m.start(), m.end(), "(") for m in BRACKETED.finditer(t)]
    if any(map(t.__contains__, DOT_WORDS)):
        places += [(m.start(), m.end(), m["word"]) for m in SPELT.finditer(t)]
    for a, b, sign in sorted(places):
        while a and t[a - 1].isspace():
            a -= 1
        domain = DOMAIN.match(t, b)
        local = domain and SPELT_LOCAL.search(t, max(0, a - 254), a)
        # the bare word "at" counts only if the dots are words too
        if not local or (sign in ("at", "arroba", "arobase") and "." in domain["rest"]):
            continue
        for m in DOT_SIGN.finditer(t, local.start(), a):
            yield m.start(), m.end(), "."
        yield a, b, "@"
        for m in DOT_SIGN.finditer(t, *domain.span("rest")):
            yield m.start(), m.end(), "."


class Normalised:
    """Normalised text and the way back: ``source(i)`` is the source position of its letter i.
    ``spelt`` are the stretches that were digits in words."""

    def __init__(self, text: str) -> None:
        t = text
        for odd, plain in OFTEN:
            t = t.replace(odd, plain)
        if not t.isascii():
            for odd in sorted(set(ODD.findall(t))):  # a plain sign that is odd itself comes before those it stands for
                t = t.replace(odd, ONE[ord(odd)])
        self.layers: list[tuple[list[int], list[int]]] = []
        t = self._rewrite(t, _edits(t))
        #: Words between blanks, folded; cheap tests on them spare searches of the whole text.
        self.folded = t.casefold()
        self.words = self.folded.replace("-", " ").split()
        many = not DIGIT_TOKENS.isdisjoint(self.words) and sum(map(DIGIT_TOKENS.__contains__, self.words)) > 5
        spelt = [(m.start(), m.end(), _digits(m.group())) for m in SPELT_DIGITS.finditer(t)] if many else []
        edits = sorted([*spelt, *_mail_signs(t)])
        kept = [x for k, x in enumerate(edits) if not k or x[0] >= edits[k - 1][1]]
        self.text = self._rewrite(t, kept) if kept else t
        self.spelt, moved = [], 0
        for a, b, new in kept:
            if len(new) > 5:
                self.spelt.append((a + moved, a + moved + len(new)))
            moved += len(new) - (b - a)

    def _rewrite(self, t: str, edits: list[tuple[int, int, str]]) -> str:
        if not edits:
            return t
        at, shift, parts, last, size = [0], [0], [], 0, 0
        for a, b, new in edits:
            parts += [t[last:a], new]
            size += a - last + len(new)
            last = b
            if len(new) > 1:  # its further letters come from the last source letter
                at.append(size - len(new) + 1)
                shift.append(b - 1 - at[-1])
                for i in range(2, len(new)):
                    at.append(size - len(new) + i)
                    shift.append(b - 1 - at[-1])
            at.append(size)
            shift.append(last - size)
        self.layers.append((at, shift))
        return "".join([*parts, t[last:]])

    def source(self, i: int) -> int:
        for at, shift in reversed(self.layers):
            i += shift[bisect_right(at, i) - 1]
        return i


# ---------------------------------------------------------------- contacts and numbers

LOCAL = re.compile(r"(?<![\w.+\-@█*])[A-Za-z0-9][\w.+\-]*\s*$")


def emails(t: str) -> Iterator[tuple[int, int]]:
    i = t.find("@")
    while i >= 0:
        # blank on one side only: the local part was taken out
        if t[i - 1 : i].isspace() == t[i + 1 : i + 2].isspace():
            domain = DOMAIN.match(t, i + 1)
            local = domain and LOCAL.search(t, max(0, i - 254), i)
            if local:
                yield local.start(), domain.end()
        i = t.find("@", i + 1)


#: A line may break inside a number, and the next one may be indented.
_BREAK = r"\n {0,8}"
_SEP = rf"(?:[ .\-/\n]{{0,2}}|[ .\-/]?{_BREAK})"
_GAP = rf"(?:[ .\-]|{_BREAK})"
_BLANK = rf"(?: |{_BREAK})?"
_DASH = rf"(?:[ \-]|{_BREAK})"
PHONE = re.compile(
    r"[+(\d](?<![\w/.\-+*█][+(\d])(?:"
    rf"(?<=\+)\d{{1,3}}{_SEP}(?:\(\d{{1,5}}\){_SEP})?\d(?:{_SEP}\d){{5,12}}"
    rf"|(?<=0)0\d{{2,3}}{_GAP}\d{{1,5}}(?:{_GAP}\d{{2,6}}){{1,3}}"
    rf"|(?<=\()0?\d{{2,5}}\)(?:\s| ?{_BREAK})?\d{{3,4}}{_GAP}?\d{{3,4}}"
    rf"|(?<=0)\d(?:(?:[ .]{{1,2}}|[ .]?{_BREAK})\d{{2}}){{4}}"
    rf"|(?<=0)\d{{2,4}}(?:/|{_GAP})\d{{3,8}}(?:{_GAP}\d{{2,4}})*"
    r"|(?<=\d)\d{2}[\-.]\d{3}[\-.]\d{4}"
    r")(?![\w/*█]|[ \-.]?[*█]|-\d)"
)
#: Seven figures are a local number where a word for telephoning stands before them.
LOCAL_PHONE = re.compile(r"\d\d\d-\d{4}(?<![\w/.\-+*█)]\d{3}-\d{4})(?![\w/*█]|[ \-.]?[*█]|-\d)")
LOCAL_HINT = re.compile(r"-\d{4}(?<=\d\d\d-\d{4})")
PHONE_WORD = re.compile(r"(?i)\b(?:tel|t[ée]l[ée]ph?on|phon|fax|call|rang|ring|rung|dial|mobil|cell|handy|ruf|anruf|appel|joign|llam|contact|number|nummer|num[ée]ro|at|unter|au|al)\w*[\s.:,\-]{0,12}(?:(?:facilitado|given|angegebene|no|nr|on|is|was|to|the|number|auf|unter|sur|le|al|n[°º])\b[\s.:,]*){0,3}$|[(;]\s*$")
_ID_END = r"(?![\w*█]|-\d|/\d)"
ID_LETTERS = re.compile(
    rf"[A-Za-z](?:[A-Za-z](?:{_DASH}?\d{{2}}{_DASH}?\d{{2}}{_DASH}?\d{{2}}{_DASH}?[A-Da-d]"
    rf"|{_BLANK}\d{{3}}{_BLANK}\d{{4}}"
    rf"|{_BLANK}\d{{4}}{_DASH}?\d{{4}}{_DASH}?\d{{2}})"
    r"|-\d{3}\.\d{3}\.\d{3})" + _ID_END
)
ID_DIGITS = re.compile(rf"\d\d\d(?:{_DASH}\d{{2}}{_DASH}\d{{4}}|\d{{3}}-\d{{4}})" + _ID_END)
DIGITS = re.compile(r"\d\d[\d .\-\n]{3,}")


#: Words that make the number after them somebody's own, whatever its form.
ID_WORD = re.compile(
    r"(?i)(?:passport|reisepass|passeport|pasaporte|personalausweis|identity\s+card|identit[ée]|identidad|\bDNI|\bNI[EF]|national\s+insurance|versicherungsnummer|steuer(?:nummer|-?id\w*)|social\s+security|sécurité\s+sociale|seguridad\s+social|\btax)"
    r"[\s\-]*(?:card|identification)?[\s\-]*(?:number|no|nr|num|nummer|id|número|numéro|n[°º])?[\s.:,#]{0,3}(?:is|was|ist|lautet|es|est)?[\s:]*$"
)
#: One of these stands in every text that holds such a word, folded.
ID_HINTS = ("pass", "pasaporte", "ausweis", "identi", "dni", "nie", "nif", "insurance", "versicherung", "steuer", "social", "tax")
OWN_NUMBER = re.compile(rf"(?:[A-Z]{{1,2}}[ \-]?)?\d(?:[ \-./]?\d){{5,16}}[A-Z]?{_ID_END}")
PREFIX = re.compile(r"(?:(?<![A-Za-z])[A-Z]{1,2}[ \-]?)?$")
#: Check letters of the Spanish numbers, by remainder.
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CHECKED = re.compile(rf"(?:\d{{8}}|[XYZ]-?\d{{7}})-?[A-HJ-NP-TV-Z]{_ID_END}|[12] ?\d\d ?[01]\d ?\d[\dAB] ?\d{{3}} ?\d{{3}} ?\d\d{_ID_END}")


def _checks(number: str) -> bool:
    """Check letter of Spanish numbers, check figures of French ones."""
    n = re.sub(r"[ \-]", "", number)
    if n[-1].isdigit():
        return (int(n[:-2].replace("2A", "19").replace("2B", "18")) + int(n[-2:])) % 97 == 0 if not set(n) & set("AB") - set(n[5:7]) else False
    head = n[:-1]
    head = str("XYZ".index(head[0])) + head[1:] if head[0] in "XYZ" else head
    return CHECK_LETTERS[int(head) % 23] == n[-1]


def _hinted(t: str) -> bool:
    low = t.casefold()
    for w in ID_HINTS:  # noqa: SIM110 (quicker than any)
        if w in low:
            return True
    return False


def id_numbers(t: str) -> Iterator[tuple[int, int]]:
    cued = None
    long = []  # runs that may hold what ID_DIGITS seeks, which is 11 letters of such a run or more
    for m in DIGITS.finditer(t):
        a, end = m.span()
        size = end - a
        if size < 6:  # all that follows is longer
            continue
        if size > 10:
            long.append((a, end))
        left = t[max(0, a - 3) : a]
        for back in (3, 2):  # two letters and a blank, two letters, or a letter and a hyphen
            if len(left) >= back and left[-back].isalpha() and (hit := ID_LETTERS.match(t, a - back)):
                yield hit.span()
                break
        else:
            hit = None
            if size >= 7:
                for back in (0, 1, 2):
                    if (not back or left[-back : len(left) - back + 1] in "XYZ12") and (h := CHECKED.match(t, a - back)) and _checks(h.group()):
                        hit = h
                        break
            if hit is None:
                cued = _hinted(t) if cued is None else cued
                if cued and OWN_NUMBER.match(t, a):
                    start = a - len(PREFIX.search(left).group())
                    if _hinted(t[max(0, start - 60) : start]) and ID_WORD.search(t, max(0, start - 60), start):
                        hit = OWN_NUMBER.match(t, start)
            if hit:
                yield hit.span()
    for a, b in long:
        for m in ID_DIGITS.finditer(t, a, b + 2):  # two letters more: it looks at what follows
            yield m.span()


#: What stands before numbers that are nobody's own.
NOT_PERSONAL = re.compile(r"(?i)(?:account|acct|konto\w*|compte|cuenta|file|reference|exhibit|anlage|pi[eè]ce|documento|docket|order|dossier|az|aktenzeichen|bundle|tab|case|ref|invoice|rechnung|iban)\W{0,3}(?:no\b|nr\b|n\b|n°|nº)?[\W]{0,4}$")

#: Figures are not given back (``+``): what follows them never begins with one. So English streets
#: are sought from the first figure of a run on, or from the fourth last, and from no other.
_NO = r"\d\d{0,3}+[A-Z]?\s?[a-d]?(?:\s?-\s?\d{1,4}+\s?[a-d]?)?"
_CAP = r"[A-ZÀ-Þ][\w']*"
STREETS = [
    re.compile(
        rf"\d(?:(?<!\d\d)|(?=\d{{3}}(?!\d))){_NO[2:]},?\s+(?:(?:St\.|ST\.|{_CAP})\s+){{1,4}}?(?i:street|row|lane|road|drive|close|hill|avenue|terrace|walk|mews|square|way|gardens|quay|wharf|crescent|grove|st|ln|rd|dr|cl|ave|av|ter|terr|sq)\b(?!')"
    ),
    re.compile(rf"\d\d{{0,3}}(?:\s?-\s?\d{{1,4}})?\s?(?:bis|ter|quater|[a-d])?,?\s+(?i:rue|quai|place|avenue|allée|allee|chemin|impasse|boulevard|cours|square|passage|route|sentier|bd|av\.)\s+(?:(?:de|du|des|la|le|les)\s+|de\s+l'|d'|l')*[A-ZÀ-Þ]"),
    re.compile(r"\b(?i:calle|plaza|avenida|avda\.|paseo|camino|ronda|travesía|carretera|c/)\s+(?:(?:del|de|la|las|los|el)\s+)*[A-ZÀ-Þ][\w']*(?:\s+[A-ZÀ-Þ][\w']*)*,?\s*(?:(?i:n\.?\s?[º°]|núm\.|n[úu]mero)\s*)?\d{1,4}\b(?![*█])"),
    re.compile(
        r"(?<![\w])(?:(?:Am|An|Im|In|Auf|Zum|Zur|Unter|Hinter)\s+(?:(?:der|den|dem)\s+)?)?(?:[A-ZÄÖÜ][a-zäöüß]+(?:er|e|en)\s+)?(?:[A-ZÄÖÜ][\wäöüß-]*(?:stra(?:ß|ss)e|str\.|allee|weg|gasse|ring|platz|ufer|damm|speicher|markt|steig|chaussee)|Stra(?:ß|ss)e|Str\.|Allee|Weg|Gasse|Ring|Platz|Ufer|Damm|Speicher|Markt|Steig)\s+\d{1,4}(?:\s?[a-d])?\b(?![*█])"
    ),
]

#: What a word before a blank must be, or end in, for each pattern, folded: a text without such a
#: word is not searched. Numbers before English street words stand in nearly every text.
FRENCH_WORDS = frozenset("rue quai place avenue allée allee chemin impasse boulevard cours square passage route sentier bd av.".split())
SPANISH_ENDS = tuple("calle plaza avenida avda. paseo camino ronda travesía carretera c/".split())
GERMAN_ENDS = tuple("strasse str. allee weg gasse ring platz ufer damm speicher markt steig chaussee".split())
#: The latter before a number, in the text as it is.
NUMBERED = re.compile(r"\s+\d")
GERMAN_TAILS = tuple(x for w in ("straße", *GERMAN_ENDS) for x in (w, w.capitalize()))
#: Words seen that end in none of these, up to a number.
_PLAIN: set[str] = set()
PLAIN_WORDS = 1 << 17


def _german(t: str) -> bool:
    """Whether a number stands behind a German street word."""
    for m in NUMBERED.finditer(t):
        if t.endswith(GERMAN_TAILS, 0, m.start()):
            return True
    return False


def _ends(words: list[str]) -> tuple[bool, bool]:
    """Whether some word ends as a Spanish or a German street word."""
    rest = set(words).difference(_PLAIN)
    spanish, german = {w for w in rest if w.endswith(SPANISH_ENDS)}, {w for w in rest if w.endswith(GERMAN_ENDS)}
    if len(_PLAIN) > PLAIN_WORDS:
        _PLAIN.clear()
    _PLAIN.update(rest - spanish - german)
    return bool(spanish), bool(german)


# ---------------------------------------------------------------- persons

TITLES = set("Mr Mrs Ms Miss Mx Dr Prof Professor Sir Dame Herr Herrn Frau Mme Mlle Me Madame Monsieur Maître Sr Sra Srta Señor Señora Don Doña Doctor Doctora MR MRS MS DR Rechtsanwalt Rechtsanwältin".split())
OFFICES = set("Judge Justice Lady Lord Master Registrar Recorder Advocate Richter Richterin Vorsitzender Vorsitzende Präsident Präsidentin Président Présidente Conseiller Conseillère Juge Greffier Greffière Magistrado Magistrada Presidente Presidenta Ponente Juez Jueza JUDGE JUSTICE".split())
OFFICE_BEFORE = set("président présidente conseiller conseillère juge greffier greffière rapporteur magistrado magistrada presidente presidenta ponente juez jueza don doña monsieur madame judge justice".split())
PARTICLES = {"de", "du", "von", "van", "di", "da", "la", "le", "zu", "DE", "DU", "VON", "VAN"}
#: Words that make a capitalised run something other than a person.
NOT_PERSON = {x.casefold() for x in
    """Ltd Limited plc PLC AG GmbH KG SA SL LLP Inc Holdings Estates Cooperative Insurance Mutual Freight Reederei Bau Textil Société Energía
    Transportes Authority Port Union Workers Municipality Trust Grain Bank Court Tribunal Family Commercial Supreme High Appeal Registry
    Street Row Lane Road Drive Close Hill Avenue Terrace Walk Mews Square Way Gardens Quay Ave Rd Ln St Act Code Rules Ordinance Regulations
    Protection Evidence Civil Land Goods Welfare Carriage Insolvency Harbours Tenancies Reform Wages Carriage Exhibit Paragraph Section Page Version Arbeitsgericht
    Landgericht Oberlandesgericht Amtsgericht Audiencia Provincial Cour Judiciaire Sala Senat Speicher Straße Boulevard Via Allee Gasse Platz Calle Plaza Paseo Camino Avenida
    University Department Ministry Company Council Sons Brothers Partners Group Services Logistics
    Anlage Anexo Annexe Pièce Oberlandesgericht d'appel Juzgado Social Corrected Judgment Societe Energia Strasse St. Registrierung Kammer Chambre""".split()
}
#: Words that open sentences or stand in headings and never are part of a name.
COMMON = set(
    """The A An And Or But If In On At Of To By For From With Without Under Before After Between Both Nothing No Not It We He She They This That These Those Which Who
    Whether Were Was Is As See Also Re Counsel Costs Evidence Judgment Claim Contract Employment Shipping Practice According Permission Notice Undertakings Works
    Works Contact Appellant Respondent Claimant Defendant Applicant Plaintiff Matter Case Ref Anonymised Redacted Neither Another Explain Discuss Assume Would Further
    January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday
    Die Der Das Den Dem Des Ein Eine Einer Zu Nach Als Mit Auf Aus Am An Im Bei Für Vom Von Und Oder Zur Zum Es Sie Er Streitig Unstreitig Urt Rn Az Abs Nr Vgl OLG LG BGH Recht Ladung Klägerin Kläger Beklagte Beklagter
    Revision Zeuge Zeugin Zeugenaussage Angaben Rückfragen Rechtsstreit Ausweis Tel Fax Beschluss Beweislast Januar Februar März Mai Juni Juli Oktober Dezember
    Le La Les Un Une L' D' Il Elle Aux Au En Ont Par Joignable Attendu Vu Et ET ENTRE Entre Appelante Appelant Intimé Intimée Demanderesse Défendeur CA
    El Los Las Una Se Según Comparecieron Declaró Conforme Consta No Por Para Partes PARTES SAP Del Que Parte Contra
    AND BETWEEN IN THE MATTER OF NOT DO ALL TIMES AT TO ON OC DOT REG RG HC FC CC AP NO ET OR BY""".split()
)
_TOKEN = r"[A-ZÀ-ÞŠŽ](?:'[A-ZÀ-Þ])?\w*(?:-[A-ZÀ-ÞŠŽ](?:'[A-ZÀ-Þ])?\w*)*"
_DOTTED = r"(?:[A-ZÀ-Þ]|Mr|Mrs|Ms|Dr|Prof|Mme|Mlle|Sr|Sra|Srta|St|ST|MR|MRS|DR)\.(?=\s)"
#: The first word of a run: as the others, by its first letter.
_FIRST = (
    r"[A-ZÀ-ÞŠŽ](?:(?<![ŠŽ])(?:(?<=M)(?:rs?|s|me|lle|RS?)|(?<=D)[rR]|(?<=P)rof|(?<=S)(?:ra?|rta|t|T))?\.(?=\s)"
    r"|(?:'[A-ZÀ-Þ])?\w*(?:-[A-ZÀ-ÞŠŽ](?:'[A-ZÀ-Þ])?\w*)*)"
)
RUN = re.compile(
    rf"{_FIRST}(?:(?: {{1,6}}| ?\n {{0,8}})(?:{_DOTTED}|{_TOKEN}|(?:de|du|von|van|di|da|la)(?=\s+[A-ZÀ-Þ])))*"
)
PIECE = re.compile(r"\S+")
REVERSED = re.compile(rf",\s+(?P<given>{_TOKEN})(?:\s+[A-ZÀ-Þ]\.)?(?![\w*█])")
MASKED = re.compile(r"[*█_…]|\.\.\.|\[|'?\w|@")
STREET_END = ("straße", "strasse", "allee", "gasse", "chaussee")
CAPS_AFTER = re.compile(r"\s*(?:[—–-]|v\.? |vs\.? |\./\.|,? *(?:appel|intim|demand|défend|Kläg|Bekl)|(?:AND|ET|UND|Y|CONTRA|contra|gegen|and|et|und|y)\b|\n|$)")


class _Kinds(dict):
    """What a word of a run is, by its letters alone, kept up to a number of words."""

    def __missing__(self, tok: str) -> int:
        word = tok.rstrip(".")
        initial = len(tok) == 2 and tok[1] == "."
        family = len(tok) > 2 and not tok.endswith(".") and (tok.isupper() or any(c.islower() for c in tok[1:])) and not any(c.isdigit() for c in tok)
        title, common = word in TITLES or word in OFFICES, word in COMMON
        # "St." ends a street; a name may open the next sentence
        stop = title or tok in ("St.", "ST.") or (common and not initial)
        odd = word.casefold() in NOT_PERSON or "_" in tok or tok.endswith(STREET_END)  # "_" blacks out letters
        flags = (title, common, stop, odd, initial, family, tok.isupper(), tok in PARTICLES)
        if len(self) > PLAIN_WORDS:
            self.clear()
        self[tok] = out = sum(1 << i for i, x in enumerate(flags) if x)
        return out


#: Runs seen that are nobody whatever stands around them, up to a number.
_NOBODY: set[str] = set()
TITLE, COMMON_WORD, STOP, ODD_WORD, INITIAL, FAMILY, UPPER, PARTICLE = (1 << i for i in range(8))
_KINDS = _Kinds()


def persons(text: str, french: bool) -> Iterator[tuple[int, int]]:
    """Spans of persons in a normalised text; in French texts "M." is a title, not an initial."""
    for run in RUN.finditer(text):
        whole = run.group()
        if whole in COMMON:
            continue
        start = run.start()
        if start and text[start - 1] in _GLUED:
            continue
        # what ends in none of the last two letters of offices and particles is not looked at
        titled, particle = False, None
        if text[start - 3 : start - 1] in _LAST or text[start - 2 : start - 1].isspace():
            before = text[max(0, start - 16) : start].split()
            if len(before) > 1 and before[-1] in PARTICLES and before[-2] in OFFICE_BEFORE:
                titled, particle = True, text.rfind(before[-1], 0, start)
            else:
                titled = bool(before) and before[-1] in OFFICE_BEFORE
        if not titled and whole in _NOBODY:
            continue
        nobody = not titled and len(whole) < 64 and "M." not in whole
        piece: list[tuple[str, int, int, int]] = []
        for m in PIECE.finditer(whole):
            tok = m.group()
            kind = _KINDS[tok]
            title = kind & TITLE or (french and tok == "M.")
            if title or kind & STOP:
                if piece and (titled or len(piece) > 1) and not _odd(piece):
                    nobody = False
                    if found := _judged(text, piece, titled, False):
                        yield found
                titled = bool(title or (titled and not piece and not kind & COMMON_WORD))
                piece = []
            else:
                at, to = m.span()
                piece.append((tok, particle if particle is not None and not at else start + at, start + to, kind))
        if piece and (titled or len(piece) > 1 or piece[0][3] & UPPER) and not _odd(piece):
            nobody = False
            if found := _judged(text, piece, titled, True):
                yield found
        if nobody:
            if len(_NOBODY) > PLAIN_WORDS:
                _NOBODY.clear()
            _NOBODY.add(whole)


_LAST = {w[-2:] for w in OFFICE_BEFORE | PARTICLES}
_GLUED = set("'@.*█-/+&_0123456789abcdefghijklmnopqrstuvwxyzäöüß")


def _odd(piece: list[tuple[str, int, int, int]]) -> bool:
    for x in piece:
        if x[3] & ODD_WORD:
            return True
    return False


def _judged(text: str, piece: list[tuple[str, int, int, int]], titled: bool, last: bool) -> tuple[int, int] | None:
    """The span of the person that a piece of a run is, if it is one. A piece that is one word and
    neither titled nor the last of its run in capitals is none, nor is one with odd words; neither
    is asked about."""
    end = piece[-1][2]
    if piece[-1][3] & UPPER and text[end : end + 1] == " " and text[end + 1 : end + 2].isdigit():  # a law report with its page
        return None
    while piece and piece[-1][3] & PARTICLE:
        piece.pop()
    while piece and piece[0][3] & PARTICLE and not (titled and len(piece) == 2):
        piece.pop(0)
    if not piece:
        return None
    word, _, end, kind = piece[-1]
    if MASKED.match(text, end):
        return None
    caps = [x[3] for x in piece if not x[3] & (PARTICLE | INITIAL)]
    if last and caps and kind & UPPER and len(word) > 2 and len(caps) <= 2:
        rev = REVERSED.match(text, end)
        if rev and "_" not in rev["given"] and not rev["given"].isupper() and len(rev["given"]) > 2 and rev["given"] not in COMMON and rev["given"].casefold() not in NOT_PERSON and rev["given"] not in TITLES:
            first = piece[0][1] if len(caps) == sum(not x[3] & PARTICLE for x in piece) else piece[-1][1]
            return first, rev.end("given")
    if not caps or not kind & FAMILY or len(piece) > 6:
        return None
    if titled:
        return piece[0][1], end
    given = [x[3] for x in piece[:-1] if not x[3] & PARTICLE]
    if not given or len(caps) > 3:
        return None
    for k in given:
        if not k & (INITIAL | FAMILY):
            return None
    if len(caps) > 1 and all(k & UPPER for k in caps) and not CAPS_AFTER.match(text, end):
        return None
    return piece[0][1], end


# ---------------------------------------------------------------- all kinds


_LEFT = set("/.-*█_")
_BEFORE_STREET = set("/.-*█£$€_0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def detect(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, begin, end)`` of all items, ordered, in source code points. Null, empty and
    blank texts have none; of overlapping items the one found by the stricter pattern stays."""
    if not text or text.isspace():
        return []
    n = Normalised(text)
    t = n.text
    spans: list[tuple[str, int, int]] = []
    spans += [("email", a, b) for a, b in emails(t)]
    for a, b in id_numbers(t):
        left = t[a - 1 : a] if a else ""
        if not (left.isalnum() or left in _LEFT) and not NOT_PERSONAL.search(t, max(0, a - 30), a):
            spans.append(("id_number", a, b))
    for m in PHONE.finditer(t):
        if not NOT_PERSONAL.search(t, max(0, m.start() - 30), m.start()):
            spans.append(("phone", m.start(), m.end()))
    for m in LOCAL_PHONE.finditer(t) if LOCAL_HINT.search(t) else ():
        if PHONE_WORD.search(t, max(0, m.start() - 40), m.start()):
            spans.append(("phone", m.start(), m.end()))
    for a, b in n.spelt:
        if not NOT_PERSONAL.search(t, max(0, a - 30), a):
            spans.append(("id_number" if ID_WORD.search(t, max(0, a - 60), a) else "phone", a, b))
    french = t.count(" les ") + t.count(" des ") + t.count(" du ") + t.count(" été ") > t.count(" the ") + t.count(" of ")
    spanish, german = any(map(n.folded.__contains__, SPANISH_ENDS)), _german(t)
    if spanish or german:
        ends = _ends(n.words)
        spanish, german = spanish and ends[0], german and ends[1]
    wanted = (True, not FRENCH_WORDS.isdisjoint(n.words), spanish, german)
    for p, used in zip(STREETS, wanted, strict=True):
        if used:
            spans += [("address", *m.span()) for m in p.finditer(t) if not m.start() or t[m.start() - 1] not in _BEFORE_STREET]
    spans += [("person", a, b) for a, b in persons(t, french)]
    out: list[tuple[str, int, int]] = []
    starts: list[int] = []  # of the disjoint items taken so far, in order, with their ends
    ends: list[int] = []
    for kind, a, b in spans:  # in order of strictness
        k = bisect_left(starts, b)
        if not k or ends[k - 1] <= a:
            starts.insert(k, a)
            ends.insert(k, b)
            out.append((kind, n.source(a), n.source(b - 1) + 1))
    return sorted(out, key=lambda x: x[1])


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each item replaced by its placeholder and the rest unchanged."""
    if not spans:
        return text
    parts, last = [], 0
    for kind, a, b in spans:
        parts += [text[last:a], PLACEHOLDER[kind]]
        last = b
    return "".join([*parts, text[last:]])


def _run(what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, begins, ends, texts = [], [], [], [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans = detect(text)
                if what == "text":
                    ids.append(i)
                    texts.append(redacted(text, spans))
                else:
                    ids += [i] * len(spans)
                    kinds += [s[0] for s in spans]
                    begins += [s[1] for s in spans]
                    ends += [s[2] for s in spans]
            id_col = pa.array(ids, batch.column("id").type)
            if what == "text":
                yield pa.RecordBatch.from_arrays([id_col, pa.array(texts, pa.string())], ["id", "text"])
            else:
                yield pa.RecordBatch.from_arrays([id_col, pa.array(kinds, pa.string()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["id", "kind", "begin_pos", "end_pos"])

    return run


def find_items(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, kind, begin_pos, end_pos)`` of every occurrence, in code points from 0, end
    exclusive. Repeated ids are handled row by row; other columns are ignored."""
    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    return d.mapInArrow(_run("spans"), f"id {kind}, kind string, begin_pos long, end_pos long").withColumnRenamed("id", id_col)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text)`` with typed placeholders; null texts stay null."""
    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    return d.mapInArrow(_run("text"), f"id {kind}, text string").withColumnRenamed("id", id_col)
