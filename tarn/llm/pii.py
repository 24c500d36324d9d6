"""Personal details in free text: found, typed and replaced.

E-mail addresses, phone numbers, identity numbers and street addresses are found by their formats and labels.  Names
are found by a lexicon of the name parts of all tickets' authors and, where the lexicon does not have them, by a small
classifier of two capitalised words: words the corpus uses otherwise are out, and the words around a pair weigh by how
much more often they stood around the lexicon's names than around other capitalised pairs.  All tickets are counted for it,
and a word is in use by its rate among them, which does not depend on how many there are.  The lexicon is broadcast up
to ``MAX_PARTS`` parts and the classifier up to its ``MAX_WORDS`` most frequent words; beyond that each ticket gets
what occurs in it of the others by a join, so it never misses one.

Replacing keeps the text readable: each detail becomes a typed placeholder with a pseudonym.  Numbers and dates are
permuted within their format by a keyed Feistel network over their digits and letters (check digits are computed
anew), everything else gets a keyed tag of 80 bits; so equal values have equal pseudonyms in all documents, and only the key
links them back.

Defined results: null texts stay null and empty ones empty; a detail found by several rules is reported once, as
the kind that comes first in ``KINDS``; overlapping finds are merged into the first; repeated rows are handled
independently; without any author names are found by their places alone.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.sources.tables import cut, spread

#: In order of precedence where finds overlap.
KINDS = ("email", "id_number", "phone", "address", "date", "name")
#: A word is in use if it is used once in so many tickets, and twice at least.
IN_USE = 10_000
#: Places from which on a word around them speaks for or against a name.
PLACES_LEAST = 3
#: What it speaks for a name that the corpus does not use a pair's words otherwise (in nats).
UNKNOWN = 2.0
#: Name parts that are broadcast, at most.
MAX_PARTS = 500_000
#: Words of the classifier that are broadcast, at most.
MAX_WORDS = 500_000
FIELDS = ("title", "text", "body")
#: Columns whose words are in use too.
OTHERS = ("organization", "product", "category")

# ---------------------------------------------------------------- e-mail addresses

_LOCAL = r"[A-Za-z0-9À-ÿ][A-Za-z0-9À-ÿ._%+'\-]*"
_AT = re.compile(r"[@＠﹫]\s?|[\[({<]\s?(?:at|AT|arroba)\s?[\])}>]\s?|(?<=\s)(?:at|AT)\s(?=[\w\-]+\s(?:dot|DOT)\s)")
_LOCAL_END = re.compile(rf"(?<![\w.+%\-]){_LOCAL}$")
_DOMAIN = re.compile(r"[A-Za-z0-9À-ÿ\-]+(?:(?:\s?[\[({<]\s?(?:dot|DOT|punkt|punto|point|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s|\s?\.\s?)[A-Za-z0-9À-ÿ\-]+)+")
_STOP = re.compile(r"\.\s")


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    for at in _AT.finditer(text):
        domain = _DOMAIN.match(text, at.end())
        if not domain:
            continue
        begin = at.start() - (at.start() > 0 and text[at.start() - 1].isspace())
        local = _LOCAL_END.search(text, max(0, begin - 70), begin)
        if not local:
            continue
        end = domain.end()
        if cut := _STOP.search(text, domain.start(), end):  # the next sentence is no part of the address
            end = cut.start()
        tail = text[domain.start() : end]
        if re.search(r"(?:\.|[\])}>]|dot|DOT)\s?[A-Za-zÀ-ÿ\-]{2,24}$", tail):
            yield local.start(), end, "email"


# ---------------------------------------------------------------- identity numbers

_GAP = r"[\s>|]*"  # where lines may be wrapped and quoted
_ID_LABEL = (
    r"(?:passport|passeport|reisepass|pasaporte|passaporto|passaporte|paspoort|paszport|s\.?i\.?n\.?|social\s+insurance|s\.?s\.?n\.?|social\s+security|sozialversicherungs?(?:nummer|nr)|rentenversicherungs?nummer|num[ée]ro\s+de\s+s[ée]curit[ée]\s+sociale|n[ií]\s?no\.?|national\s+insurance|"
    r"d\.?n\.?i\.?|n\.?i\.?e\.?|n\.?i\.?f\.?|c\.?p\.?f\.?|b\.?s\.?n\.?|pesel|codice\s+fiscale|steuer[\s\-]*(?:id|identifikations?nummer|nummer|nr)|tax\s+(?:id|identification|number|no|reference)|tin|itin|ein|num[ée]ro\s+fiscal|"
    r"driv(?:er|ing)[’'`]?s?\s+licen[cs]e|führerschein|permis\s+de\s+conduire|carn[eé]t?\s+de\s+conducir|licen[cs]e|identity\s+card|id[\s\-]card|personalausweis(?:nummer)?|carte\s+d[’']identit[ée]|national\s+id|health\s+card|insurance\s+(?:number|no|policy)|medicare|nhs)"
)
_ID_LABELLED = re.compile(rf"(?<!\w)(?:{_ID_LABEL}){_GAP}(?:(?:numbers?|nummer|num[ée]ro|n[úu]mero|no|nr|n[°º]|id|identifier)\b\.?)?{_GAP}(?:is\b|ist\b|est\b|es\b|:|=|#|-|–)?{_GAP}(?:is\b)?{_GAP}$", re.IGNORECASE)
# Letters every label has one of, for a quick look before the label is matched.
_ID_STEMS = tuple("passp passep reisep pasap pasz paspo sin s.i social ssn s.s sozial renten nino n.i national dni d.n nie nif cpf c.p bsn b.s pesel codice steuer tax tin ein fiscal lic führer permis carn ident id card personal carte health insur medicare nhs".split())
_ID_BARE = re.compile(
    r"(?<![\w.\-])(?=[A-Z]{0,2} ?\d)(?P<v>[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]"  # national insurance
    r"|QQ[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]|(?!000)\d{3}-(?!00)\d{2}-(?!0000)\d{4}|\d{8}-?[A-HJ-NP-TV-Z]|[XYZ]-?\d{7}-?[A-HJ-NP-TV-Z]|[A-Z]\d{4}-\d{5}-\d{5})(?![\w\-])"
)
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"
# What the value of a label looks like, so that words after it are left out.
_ID_SHAPES = [
    r"[A-Z]{1,3}\d[A-Z]?\d{5,8}", r"[A-Z]\d[A-Z]\d{6}", r"[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]", r"\d{3}[ \-.]\d{2}[ \-.]\d{4}", r"\d{3}[ \-.]?\d{3}[ \-.]?\d{3}", r"\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}", r"\d{2}-\d{7}", r"\d{8}[ \-]?[A-Z]", r"[XYZ][ \-]?\d{7}[ \-]?[A-Z]",
    r"[A-Z]\d{4}[ \-]\d{5}[ \-]\d{5}", r"\d{3}\.\d{3}\.\d{3}-\d{2}", r"[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]", r"[12][ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{3}[ ]?\d{3}(?:[ ]?\d{2})?", r"[A-Z0-9]*\d[A-Z0-9]*(?:-[A-Z0-9]+)*",
]
_ID_SHAPE = re.compile(r"(?<![\w\-.+@/])(?=[A-Z]{0,6} ?\d)(?:" + "|".join(f"(?:{s})(?![A-Za-z0-9])" for s in _ID_SHAPES) + ")")


def _id_numbers(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _ID_SHAPE.finditer(text):
        if sum(c.isdigit() for c in m.group()) < 4:
            continue
        before = text[max(0, m.start() - 60) : m.start()]
        low = before.lower()
        if any(stem in low for stem in _ID_STEMS) and _ID_LABELLED.search(before):
            yield m.start(), m.end(), "id_number"
    for m in _ID_BARE.finditer(text):
        v = m["v"]
        digits = re.sub(r"\D", "", v)
        if v[-1].isalpha() and len(digits) == 8 and _DNI[int(digits) % 23] != v[-1]:
            continue
        yield m.start("v"), m.end("v"), "id_number"


# ---------------------------------------------------------------- phone numbers

_EXT = r"(?:\s*,?\s*(?:ext|extension|x|poste|durchwahl|dw|anexo)\b?\.?\s*\d{1,6})?"
_PHONE = re.compile(
    rf"""(?<![\w.,/@#&\-+])(?P<v>
      \+\d{{1,3}}[\s.\-]?(?:\(0?\)\s?|\(\d{{1,4}}\)[\s.\-]?)?\d{{1,4}}(?:[\s.\-/]?\d{{2,4}}){{1,4}}
    | \(\d{{3}}\)[\s.\-]?\d{{3}}[\s.\-]?\d{{4}}
    | 1[\s.\-]\(?\d{{3}}\)?[\s.\-]\d{{3}}[\s.\-]\d{{4}}
    | \d{{3}}([.\-\s])\d{{3}}\2\d{{4}}
    | 00\d{{2}}[\s.\-]\d{{1,4}}(?:[\s.\-]?\d{{2,8}}){{1,4}}
    | 0\d(?:[\s.\-]\d{{2}}){{4}}
    | 0\d{{2,4}}[\s.\-/]\d{{3,4}}(?:[\s.\-]?\d{{3,4}}){{1,2}}
    | \(0\d{{2,4}}\)\s?\d{{3,4}}(?:[\s.\-]?\d{{3,4}}){{1,2}}
    | 9\d{{2}}(?:\s\d{{2}}){{3}}
    | [2-9]\d{{2}}[2-9]\d{{6}}
    )(?![\w\-]|[.,]\d)""",
    re.VERBOSE,
)
# What the number before it is, if it is no phone number; and what says that it is one.
_NOT_PHONE = re.compile(r"(?:deal|order|ticket|case|batch|invoice|reference|ref|id|ids|account|acct|version|build|serial|iban|number|no|nr|auftrag|rechnung|referenz|commande|facture|pedido|factura|opération|operación|geschäft|server|ip|port|card|article|art|vorgang|hrb|release|code|amount|usd|eur|gbp|cad)\.?\s*[:#=]?\s*(?:id|no|nr|number|n°|reference)?\.?\s*[:#=]?\s*$", re.IGNORECASE)
_IS_PHONE = re.compile(r"(?:phone|tel|telephone|telefon|téléphone|teléfono|telefone|telefono|mobile|mob|cell|fax|call|ring|direct|line|whatsapp|dial|reach\w*|rufnummer|durchwahl|\bt|\bm|\bp)\.?\s*(?:number|no|nr|nummer|changed|is|back)?\.?\s*(?:to|at|on)?\s*[:=]?\s*$", re.IGNORECASE)


def _phones(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _PHONE.finditer(text):
        v = m["v"]
        n = sum(c.isdigit() for c in v)
        if not 7 <= n <= 15:
            continue
        before = text[max(0, m.start() - 40) : m.start()]
        if _NOT_PHONE.search(before) and not _IS_PHONE.search(before):
            continue
        if "\n" in v:
            v = v.split("\n")[0].rstrip()
            if sum(c.isdigit() for c in v) < 7:
                v = m["v"]
        yield m.start(), m.start() + len(v), "phone"


# ---------------------------------------------------------------- street addresses

_STREET_EN = r"(?:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr|crescent|cres|row|loop|way|court|ct|place|pl|terrace|square|sq|close|gardens|mews|parkway|pkwy|highway|hwy|circle|cir|trail|alley|walk|wharf|quay|grove|rise|green|heights|vale|path|plaza|esplanade|parade)"
_UNIT = r"(?:apt|apartment|suite|ste|unit|flat|floor|room|rm|\#)"
_STREET_NUMBERED = re.compile(
    rf"""(?<![\w\-/.,+])(?=\d)(?:
      (?P<fr>\d{{1,4}}(?:\s?(?:bis|ter|quater))?,?\s(?:rue|avenue|av\.|boulevard|bd\.?|place|allée|chemin|impasse|quai|cours|square|route|passage|faubourg)\s(?:(?:de|du|des|la|le|les|d'|l')\s?)*[A-ZÀ-Þ][\w'’\-]*)
    | (?P<en>\d{{1,5}}[a-zA-Z]?,?\s(?:(?:[NSEW]\.?|North|South|East|West)\s)?(?:[A-Za-zÀ-ÿ][\w'’.\-]*\s){{1,4}}?(?i:{_STREET_EN})\b\.?(?:\s(?:[NSEW]\.?|[NS][EW]|North|South|East|West)(?=,|\s*$|\s*[\n;)]|\s(?i:{_UNIT})\b))?)
    )""",
    re.VERBOSE,
)
_STREET_NAMED = re.compile(r"(?<![\w\-/.,+])(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrera|Ronda|Travesía|Vía|Rua|Praça|Travessa|Via|Viale|Piazza|Corso|Largo|ul\.|Ulica|al\.|Aleja)\s(?:[\w'’.\-]+\s){1,6}?$")
_NAMED_FIRST = ("Calle ", "C/ ", "Av", "Plaza ", "Paseo ", "Camino ", "Carrera ", "Ronda ", "Trav", "Vía ", "Rua ", "Praça ", "Via", "Piazza ", "Corso ", "Largo ", "ul. ", "Ulica ", "al. ", "Aleja ")
_GERMAN_LAST = ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ring", "damm", "ufer", "graben", "markt", "steig", "chaussee", "promenade", "straat", "laan", "plein", "gracht", "kade", "dreef")
_AT_STREET = re.compile(r"(?<![\w\-/.,+])(?:Am|An\sder|Auf\sde[mr]|Im|In\sder|Zum|Zur|Unter\sden)\s[A-ZÄÖÜ][\w\-]+\s$")
_TOWN = re.compile(r",[\s>|]*\d{5}\s[A-ZÄÖÜ]")
_HOUSE = re.compile(r"(?<=[^\W\d_] )\d{1,4}(?:\s?[a-z])?(?![\w\-])|(?<=str\. )\d{1,4}(?:\s?[a-z])?(?![\w\-])")
_STREET_GERMAN = re.compile(
    r"""(?<![\w\-/.,+])(?:(?:Am|An\sder|An\sden|Auf\sde[mr]|Im|In\sder|Zum|Zur|Unter\sden|Hinter\sder|Obere[rn]?|Untere[rn]?|Alte[rn]?|Neue[rn]?|Große[rn]?|Kleine[rn]?|Hohe[rn]?|Lange[rn]?|[A-ZÄÖÜ][\w\-]+er)\s)*
    [A-ZÄÖÜ][\w\-]*\.?\s$""",
    re.VERBOSE,
)
_UNIT_BEFORE = re.compile(rf"(?<![\w\-])(?i:{_UNIT})\.?\s\d+[a-z]?,[\s>|]*$")
_ADDRESS_TAIL = re.compile(rf"(?:,?[\s>|]*(?i:{_UNIT})\.?\s?\d+[a-zA-Z]?)?(?:,\s?\d{{1,2}}[ºª°]\s?[A-Z]?)?(?:,[ \t]*\r?\n?[>| \t]*(?:\d{{4,5}}(?:-\d{{4}})?\s)?[A-ZÀ-Þa-zà-ÿ][^\W\d_]*(?:['’\-][^\W\d_]+)*(?:\s[A-ZÀ-Þ][a-zà-ÿ'’\-]+){{0,2}}(?:,\s[A-Z]{{2}})?(?:\s(?:\d{{5}}|[A-Z]{{1,2}}\d[\dA-Z]?\s\d[A-Z]{{2}}|[A-Z]\d[A-Z]\s\d[A-Z]\d))?)?")
# Words that make a number before a street-like word something else.
_NOT_STREET = re.compile(r"(?:template|layout|version|deal|order|error|page|step|item|row|rows|report|version|batch|chapter|section)\s$", re.IGNORECASE)
_COMMON = re.compile(r"\b(?:the|a|an|is|are|was|were|and|or|of|to|in|for|with|that|this|than|not|seconds?|minutes?|hours?|days?|times?|rows?|users?|sessions?|characters?|messages?|open|per|we|you|it|on|at|by|from|which|when)\s", re.IGNORECASE)


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    found = []
    for m in _STREET_NUMBERED.finditer(text):
        start = m.start()
        if m["en"]:
            if _COMMON.search(m["en"]) or _NOT_STREET.search(text[max(0, start - 12) : start]):
                continue
            if unit := _UNIT_BEFORE.search(text, max(0, start - 30), start):
                start = unit.start()
        found.append((start, m.end()))
    for m in _HOUSE.finditer(text):
        low = max(0, m.start() - 70)
        before = text[low : m.start()]
        last = before.rsplit(None, 1)[-1]
        street = None
        if last[0].isupper() and last.lower().endswith(_GERMAN_LAST):
            street = _STREET_GERMAN.search(before)
        elif any(w in before for w in _NAMED_FIRST):
            street = _STREET_NAMED.search(before)
        if not street and last[0].isupper() and _TOWN.match(text, m.end()):
            street = _AT_STREET.search(before)
        if street:
            found.append((low + street.start(), m.end()))
    for a, z in sorted(found):
        tail = _ADDRESS_TAIL.match(text, z)
        yield a, tail.end() if tail else z, "address"


# ---------------------------------------------------------------- dates of birth

_DATE = re.compile(r"(?<![\w.\-/])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d{2}))(?!\w)")
_BIRTH = re.compile(r"\b(?:born|date\s+of\s+birth|birth\s*date|d\.?o\.?b\.?|geb(?:oren|\.)?|geburtsdatum|née?\s+le|date\s+de\s+naissance|nacid[oa]\s+el|fecha\s+de\s+nacimiento)\.?\s*(?:am|on|is|:|=)?\s*$", re.IGNORECASE)


def _births(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _DATE.finditer(text):
        if _BIRTH.search(text, max(0, m.start() - 30), m.start()):
            yield m.start(), m.end(), "date"


# ---------------------------------------------------------------- names

_TOKEN = re.compile(r"[^\W\d_][\ẁ-ͯ]*(?:['’\-](?=[^\W\d_])[\ẁ-ͯ]*)*")
PARTICLES = frozenset("van von der den de del della di da dos du la le el al bin ibn ter ten op zu zur zum af av".split())
# Given names that are words or months too; alone they need a place where names stand.
AMBIGUOUS = frozenset(
    """april may june august will mark rose grace max drew wren hope faith joy art bill frank jack pat sue ray rob dean grant chase hunter summer dawn eve ivy lily daisy
    violet jade ruby pearl amber crystal iris rich nick miles wade lance guy gene norm dale cliff glen heath brook holly penny christian victor jean don sandy robin carol
    melody charity patience mercy olive basil reed skip page bishop king major chance kit pierce rock stone storm angel star sol luz mercedes dolores paz linda bella
    noble sage forest river sky earnest ernst wolf stern lang lange klein gross weiss schwarz braun long short young white black brown green gray grey price cash banks park
    field fields wood woods hill lake marsh bush cook baker carter cooper porter potter fisher mason miller parker shepherd smith taylor turner walker weaver""".split()
)
# What stands right before a name, and right after one.
_BEFORE = re.compile(
    r"""(?:\b(?:hi|hello|hey|dear|good\s+(?:morning|afternoon|evening)|hallo|guten\s+(?:tag|morgen|abend)|liebe[rs]?|sehr\s+geehrte[rs]?(?:\s+(?:herr|frau))?|bonjour|bonsoir|chère?|salut|hola|buen[oa]s\s+(?:días|tardes|noches),?|estimad[oa]|olá|ciao|beste|mr|mrs|ms|miss|dr|prof|herr|frau|madame|monsieur|mme|señora?|sr|sra)\.?\s+
    | \b(?:call|ring|phone|ask\s+for|contact|colleague|user|on\s+behalf\s+of|escalated\s+by|account\s+of|payee\s+is|beneficiary\s+is|verify|typed\s+in\s+by|according\s+to|reported\s+by|signed\s+by|approved\s+by|entered\s+by|created\s+by|assigned\s+to|attn:?|c/o|quoting|rappeler|appeler|rufen\s+sie|llame\s+a|llamar\s+a|konto\s+von|compte\s+de|cuenta\s+de|ansprechpartner(?:in)?\s+ist|documento\s+de|pièce\s+fournie\s+par|zur\s+prüfung:|kyc\s+file:|contact:|kontakt:|contacto:|name:|client:|customer:|kunde:|passenger:|beneficiary:)\s+
    | ^[\s>|*]*(?:from|to|cc|bcc|von|an|de|à|para|van|aan|da|a|sent\s+by)\s?:\*{0,2}\s+
    | \b(?:regards|wishes|thanks|thank\s+you|sincerely|cheers|best|salutations|cordialement|bien\s+à\s+vous|grüßen|grüße|gruß|saludos(?:\s+cordiales)?|un\s+saludo|atentamente|merci|danke|gracias|rgds|br|kr|mfg|lg|vg|yours)[,.!]?[ \t]*(?:\r?\n[\s>|]*|[ ])
    | ^[\s>|]*(?:--|__|\*\*\*|[-_=*]{4,})[ \t]*\r?\n[\s>|]*
    | \b(?:at|à|um)\s+\d{1,2}[:.]\d{2}(?:\s*[ap]m)?,?\s+(?:schrieb\s+)?|\d{1,2}[:.]\d{2}\s+-\s+|\bschrieb\s+|\bon\s.{6,40}\d{4},?\s+
    )$""",
    re.IGNORECASE | re.VERBOSE | re.MULTILINE,
)
_AFTER = re.compile(
    r"""\s*(?:<[^<>\s]+@|\(\S+\s?(?:@|＠|\(at\)|\[at\])|\(?\S+@\S+\)?|/\s*\S+\s?(?:@|＠|\(at\)|\[at\])|\s*(?:wrote|schrieb|writes|escribió|a\s+écrit|said|called|asked\s+us|will\s+be\b|moved\s+to|lives\s+at|has\s+moved|vive\s+en|wohnt|habite|unter\s+[(+\d]|on\s+[(+\d]|au\s+[(+\d]|al\s+[(+\d]|on\s+behalf)
    | ['’]s\s+(?:notes?|account|phone|mail|e-?mail|number|passport|password|login|request|desk) | ,?\s*(?:passport|sin|ssn|dni|nino|steuer|tax|national|social|driver) | \s*:\s*(?:cannot|passport|sin|ssn|dni|nino|steuer|tax|national|social|driver) | ;\s)""",
    re.IGNORECASE | re.VERBOSE,
)
_LINE_ALONE = re.compile(r"(?:^|\n)[\s>|*]*$")
_LINE_END = re.compile(r"[ \t]*(?:[,;]|[-–—]|:)?[ \t]*(?:\r?\n|$)")
_ORG = re.compile(r"\s(?:&|Trust|Capital|Holdings?|Partners|Payments?|Bank|Forex|FX|Remit|Devisen|Treasury|Financial|Change|Ltd|Limited|LLC|Inc|GmbH|AG|SA|SARL|SL|BV|Group|Corp|plc|Street|Road|Avenue|Lane|Drive|Row|Crescent|Boulevard)\b")
_PARTICLE_END = re.compile(r"(?<![\w'’\-])((?:van|von|der|den|de|del|della|di|da|dos|du|la|le)\s+)$", re.IGNORECASE)
_COMMA = re.compile(r",[ \t]*(?:\r?\n[>| \t]*)?")
_INITIAL_AFTER = re.compile(r"\s[A-ZÀ-Þ]\.(?!\w)")
_INITIAL_BEFORE = re.compile(r"(?<![\w.])([A-ZÀ-ÞŁŚŻ]\.\s*(?:[A-Z]\.\s*)?)$")
_INITIAL = re.compile(r"[A-ZÀ-ÞŁŚŻ]\.")
_SEP = re.compile(r"(?:[ \t ]+|[ \t ]*\r?\n[>| \t]*)")


@lru_cache(maxsize=200_000)
def _key(token: str) -> str:
    """A name part as compared: one form, lower case, without the possessive."""
    t = unicodedata.normalize("NFC", token).casefold().replace("’", "'")
    return t[:-2] if t.endswith("'s") else t


class Lexicon:
    """Given names and surnames, by their parts, and what tells names the lexicon lacks."""

    def __init__(self, names: Iterable[str] = (), context: Context | None = None) -> None:
        self.given: set[str] = set()
        self.last: set[str] = set()  # last parts of surnames
        self.context = context
        for name in names:
            for role, part in name_parts(name):
                (self.given if role == "given" else self.last).add(part)

    @classmethod
    def of(cls, names: Names) -> Lexicon:
        got = cls(context=names.context)
        got.given, got.last = set(names.given), set(names.last)
        return got

    def joined(self, own: pa.ListArray) -> Lexicon:
        """With what tickets bring themselves: all that occurs in them, so for them nothing is missing."""
        rows = list(zip(*(c.to_pylist() for c in own.flatten().flatten()), strict=True))
        if not rows:
            return self
        got = Lexicon(context=self.context and self.context.joined(r for r in rows if r[0] in ("w", "b", "a")))
        given, last = ({w for kind, w, *_ in rows if kind == role} for role in ("given", "last"))
        got.given, got.last = self.given | given if given else self.given, self.last | last if last else self.last
        return got


def name_parts(name: str) -> list[tuple[str, str]]:
    """(role, part) of a name's first part and of its last."""
    parts = [_key(t) for t in _TOKEN.findall(re.sub(r"<[^>]*>|\([^)]*\)|\S+@\S+", " ", name))]
    if not 2 <= len(parts) <= 6:
        return []
    return [("given", parts[0])] + [("last", parts[-1])] * (len(parts[-1]) > 1)


def clean_author(author: str | None) -> str | None:
    """The name in an author field; null for logins and everything that is not at least two words."""
    if not author:
        return None
    name = re.sub(r"<[^>]*>|\([^)]*\)|\S+@\S+", " ", author).strip()
    if "," in name:
        last, _, first = name.partition(",")
        name = f"{first.strip()} {last.strip()}"
    tokens = name.split()
    return name if 2 <= len(tokens) <= 6 and not any(c.isdigit() for c in name) else None


def _names(text: str, lex: Lexicon, taken: Callable[[int, int], bool]) -> Iterator[tuple[int, int, str]]:
    given, last = lex.given, lex.last
    tokens = [(m.start(), m.end(), k) for m in _TOKEN.finditer(text) if (k := _key(m.group())) in given or k in last]
    done = 0
    for t, (a, z, k) in enumerate(tokens):
        if a < done or taken(a, z):
            continue
        raw = text[a:z]
        if raw.lower().endswith(("'s", "’s")):
            z -= 2
            raw = raw[:-2]
        start, end, parts = a, z, 1
        first_given = k in given
        lower = raw[0].islower()
        sure = False
        if first_given:  # Given [I.] [particles] Surname
            pos = z
            m = _SEP.match(text, pos)
            if m and (i := _INITIAL.match(text, m.end())):
                pos, parts = i.end(), 2
                end = pos
                m = _SEP.match(text, pos)
            p = m.end() if m else -1
            while p > 0 and (w := _TOKEN.match(text, p)) and w.group().casefold() in PARTICLES and (nx := _SEP.match(text, w.end())):
                p = nx.end()
            if p > 0 and (w := _TOKEN.match(text, p)):
                wk = _key(w.group())
                if wk in last and not taken(p, w.end()) and (w.group()[0].isupper() or lower):
                    end = w.end() - (2 if w.group().lower().endswith(("'s", "’s")) else 0)
                    parts, sure = parts + 1, True
        if not sure and k in last:
            # [particles before]
            begin = a
            while begin and text[begin - 1].isspace() and (b := _PARTICLE_END.search(text, max(0, begin - 8), begin)):
                begin = b.start(1)
            m = _COMMA.match(text, z)
            if m and (w := _TOKEN.match(text, m.end())) and _key(w.group()) in given and (w.group()[0].isupper() or lower) and not taken(w.start(), w.end()) and not _name_starts(text, w, last):
                start, end, parts, sure = begin, w.end(), parts + 1, True
                if i := _INITIAL_AFTER.match(text, end):
                    end = i.end()
            elif "." in text[max(0, begin - 4) : begin] and (b := _INITIAL_BEFORE.search(text, max(0, begin - 7), begin)):
                start, parts, sure = b.start(1), parts + 1, True
            elif begin < a and not first_given:
                start, sure = begin, not lower
        if start < done:
            continue
        if not sure:
            if _ORG.match(text, end):
                continue
            doubtful = k in AMBIGUOUS
            if lower or doubtful or (raw.isupper() and len(raw) < 4):  # these need a place where names stand
                before, after = text[max(0, start - 60) : start], text[end : end + 40]
                opens = bool(_LINE_ALONE.search(before))
                led = (not opens or not doubtful) and bool(_BEFORE.search(before))
                if lower and (doubtful or not (led or (k in last and (_AFTER.match(after) or (opens and _LINE_END.match(after)))))):
                    continue
                if not led and not _AFTER.match(after) and not (opens and _LINE_END.match(after)):
                    continue
        done = end
        yield start, end, "name"


def _name_starts(text: str, w: re.Match[str], last: set[str]) -> bool:
    """Whether the given name after a comma begins a whole name of its own."""
    m = _SEP.match(text, w.end())
    nxt = _TOKEN.match(text, m.end()) if m else None
    return bool(nxt and _key(nxt.group()) in last)


@dataclass(frozen=True)
class Context:
    """What the classifier of unknown names knows: the words in use, and how much the words before and after a pair of
    capitalised words speak for a name (in nats); of all pairs, how many are names, and how many there are."""

    words: frozenset[str]
    before: dict[str, float]
    after: dict[str, float]
    named: int = 0
    pairs: int = 0

    def joined(self, rows: Iterable[tuple[str, str, int, int]]) -> Context:
        """With further counts: kind (w a word, b and a those before and after a pair), word, names and all there."""
        kinds: dict[str, list[tuple[str, int, int]]] = {"w": [], "b": [], "a": []}
        for kind, word, n, of in rows:
            kinds[kind].append((word, n, of))
        if not any(kinds.values()):
            return self
        named, others = self.named + 20, self.pairs - self.named + 20
        weights = lambda kind: {word: math.log((n + 1) / named) - math.log((of - n + 1) / others) for word, n, of in kinds[kind]}
        return replace(self, words=self.words.union(w for w, *_ in kinds["w"]), before=self.before | weights("b"), after=self.after | weights("a"))

    def knows(self, word: str) -> bool:
        """Whether the corpus uses a word, or one of the parts of it."""
        k = _key(word)
        return k in self.words or ("-" in k or "'" in k) and any(p in self.words for p in re.split(r"['\-]", k) if len(p) > 1)


@dataclass(frozen=True)
class Names:
    """The parts of all known names, and the classifier; ``own`` is what tickets bring of them themselves."""

    given: tuple[str, ...]
    last: tuple[str, ...]
    context: Context
    own: DataFrame | None = None


_PAIR = re.compile(r"(?<![\w'’\-.@/])(?P<a>[^\W\d_a-z][^\W\d_]+(?:['’\-][^\W\d_]+)*)(?:[ ][^\W\d_a-z]\.)?(?=(?:[ ](?:van|von|der|den|de|del|di|da|la|le))*[ ](?P<b>[^\W\d_a-z][^\W\d_]+(?:['’\-][^\W\d_]+)*)(?![\w@]|\.\w))")
_MAILBOX = re.compile(r"\s*<[^<>\s]+@")
_CALLED = re.compile(r"\b(?:call|ask for|colleague|behalf of|account of|payee is)\s$", re.IGNORECASE)
_NEAR_BEFORE = re.compile(r"([^\W\d_]+|[^\s\w>|])([\s>|]*)$")
_NEAR_AFTER = re.compile(r"[ \t]*([^\W\d_]+|\n|[^\s\w])")


def _around(text: str, a: int, z: int) -> tuple[str, str]:
    """The words or signs a stretch stands between, marked where they are on the line before; a line end after it."""
    b, f = _NEAR_BEFORE.search(text, max(0, a - 30), a), _NEAR_AFTER.match(text, z)
    return ("\n" if "\n" in b[2] else "") + b[1].casefold() if b else "\n", f[1].casefold() if f else "\n"


def _pairs(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, first word, last word) of every two capitalised words in a row, also overlapping ones."""
    for m in _PAIR.finditer(text):
        if m["a"][1:] != m["a"][1:].upper() or m["b"][1:] != m["b"][1:].upper():
            yield m.start(), m.end("b"), m["a"], m["b"]


def _unknown_names(text: str, lex: Lexicon, taken: Callable[[int, int], bool]) -> Iterator[tuple[int, int, str]]:
    """Two capitalised words the lexicon lacks: where names stand, or by the classifier."""
    ctx, done = lex.context, 0
    for a, z, first, last in _pairs(text):
        if a < done or taken(a, z):
            continue
        if not (_MAILBOX.match(text, z) or _CALLED.search(text, max(0, a - 16), a)):
            if ctx is None or ctx.knows(first) or ctx.knows(last) or _ORG.match(text, z):
                continue
            before, after = _around(text, a, z)
            if UNKNOWN + ctx.before.get(before, 0.0) + ctx.after.get(after, 0.0) < 0.0 or re.match(r"[ ][^\W\d_a-z][^\W\d_]+", text[z : z + 4]):
                continue
        done = z - 2 if text[a:z].lower().endswith(("'s", "’s")) else z
        yield a, done, "name"


def find(text: str | None, lex: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every detail, from 0, in order and without overlaps."""
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []
    used = bytearray(len(text))

    def taken(a: int, z: int) -> bool:
        return used.find(1, a, z) >= 0

    def take(found: Iterator[tuple[int, int, str]]) -> None:
        for a, z, kind in found:
            if a < z and not taken(a, z):
                used[a:z] = b"\1" * (z - a)
                spans.append((a, z, kind))

    for rule in (_emails, _id_numbers, _phones, _addresses, _births):
        take(rule(text))
    take(_names(text, lex, taken))
    take(_unknown_names(text, lex, taken))
    return sorted(spans)


# ---------------------------------------------------------------- pseudonyms


def _round(key: bytes, kind: str, n: int, value: int, modulus: int) -> int:
    mac = hmac.new(key, f"{kind}|{n}|{modulus}|{value}".encode(), hashlib.sha256).digest()
    return int.from_bytes(mac[:16], "big") % modulus


def permute(symbols: list[tuple[int, int]], key: bytes, kind: str, rounds: int = 10, back: bool = False) -> list[int]:
    """A keyed permutation of all values of one format: (value, radix) of each symbol to values of the same radices.

    An unbalanced Feistel network over the two halves of the symbols read as mixed-radix numbers."""
    if len(symbols) < 2:
        symbols = [(0, 1), *symbols]
        return permute(symbols, key, kind, rounds, back)[1:]
    half = len(symbols) // 2
    parts = [symbols[:half], symbols[half:]]
    mods, vals = [], []
    for part in parts:
        m = v = 0
        m = 1
        for s, r in part:
            v, m = v * r + s, m * r
        mods.append(m)
        vals.append(v)
    order = range(rounds) if not back else range(rounds - 1, -1, -1)
    for n in order:
        side = n % 2
        f = _round(key, kind, n, vals[1 - side], mods[side])
        vals[side] = (vals[side] + (-f if back else f)) % mods[side]
    out: list[int] = []
    for part, v in zip(parts, vals, strict=True):
        got = []
        for _, r in reversed(part):
            v, d = divmod(v, r)
            got.append(d)
        out += reversed(got)
    return out


def _luhn(digits: list[int]) -> int:
    total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _mod11(digits: list[int]) -> str:
    """The two check digits of a Brazilian CPF."""
    for _ in range(2):
        rest = sum(d * w for d, w in zip(digits, range(len(digits) + 1, 1, -1), strict=True)) * 10 % 11 % 10
        digits = [*digits, rest]
    return "".join(map(str, digits[-2:]))


def _eleven_test(digits: list[int]) -> str:
    """The check digit of a Dutch BSN; x where there is none."""
    rest = sum(d * w for d, w in zip(digits, range(9, 1, -1), strict=True)) % 11
    return str(rest) if rest < 10 else "x"


def _pesel(digits: list[int]) -> str:
    return str(-sum(d * w for d, w in zip(digits, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3), strict=True)) % 10)


def _iso7064(digits: list[int]) -> str:
    """The check digit of a German tax identifier (ISO 7064, modulus 11, 10)."""
    p = 10
    for d in digits:
        p = ((d + p) % 10 or 10) * 2 % 11
    return str((11 - p) % 10)


# What the characters at odd places of an Italian tax code count, for 0 to 9 and for A to Z.
_ODD_DIGITS = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21)
_ODD_LETTERS = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)


def _codice(core: str) -> str:
    """The check letter of an Italian tax code."""
    odd = sum(_ODD_DIGITS[int(c)] if c.isdigit() else _ODD_LETTERS[ord(c) - 65] for c in core[::2])
    even = sum(int(c) if c.isdigit() else ord(c) - 65 for c in core[1::2])
    return chr(65 + (odd + even) % 26)


def _digits(core: str) -> list[int]:
    return [int(c) for c in core]


# Shape of the whole number, how many of its last characters check it, and what they are for those before.
_CHECKS: list[tuple[re.Pattern[str], int, Callable[[str], str]]] = [
    (re.compile(r"\d{9}"), 1, lambda c: str(_luhn(_digits(c)))),
    (re.compile(r"\d{9}"), 1, lambda c: _eleven_test(_digits(c))),
    (re.compile(r"\d{8}[A-Z]"), 1, lambda c: _DNI[int(c) % 23]),
    (re.compile(r"\d{11}"), 2, lambda c: _mod11(_digits(c))),
    (re.compile(r"\d{11}"), 1, lambda c: _pesel(_digits(c))),
    (re.compile(r"\d{11}"), 1, lambda c: _iso7064(_digits(c))),
    (re.compile(r"[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]"), 1, _codice),
]


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """The same format with other digits and letters; equal digits and letters always give equal ones.

    A number whose check characters are right gets right ones; formats in which some numbers have none are walked
    through until one has, so different numbers stay different."""
    if kind == "date":
        return _date_pseudonym(value, key)
    places = [i for i, c in enumerate(value) if c.isascii() and c.isalnum()]
    fixed = 0
    if kind == "phone":
        ext = re.search(r"(?i)ext|x", value)
        places = [i for i in places if value[i].isdigit() and (not ext or i < ext.start())]
        fixed = max(0, len(places) - 7)  # country and area stay
    core = "".join(value[i] for i in places).upper()
    check = next(((n, f) for shape, n, f in _CHECKS if shape.fullmatch(core) and f(core[:-n]) == core[-n:]), None) if kind == "id_number" else None
    move = places[fixed : len(places) - check[0] if check else len(places)]
    if not move:
        return value
    symbols = [(int(value[i]), 10) if value[i].isdigit() else (ord(value[i].upper()) - 65, 26) for i in move]
    while True:
        symbols = [(new, radix) for new, (_, radix) in zip(permute(symbols, key, kind), symbols, strict=True)]
        new = "".join(str(v) if radix == 10 else chr(65 + v) for v, radix in symbols)
        if not check or (ends := check[1](new)) != "x":
            break
    out = list(value)
    for i, c in zip(places[fixed:], new + (ends if check else ""), strict=True):
        out[i] = c if value[i].isupper() or c.isdigit() else c.lower()
    return "".join(out)


def _date_pseudonym(value: str, key: bytes) -> str:
    """Another real date in the same order of parts: the day count within a century is permuted."""
    import datetime as dt

    parts = re.split(r"([./-])", value)
    sep, nums = parts[1], [parts[0], parts[2], parts[4]]
    year_first = len(nums[0]) == 4
    y, a, b = (nums[0], nums[1], nums[2]) if year_first else (nums[2], nums[1], nums[0])
    full = int(y) if len(y) == 4 else (2000 if int(y) < 30 else 1900) + int(y)
    try:
        day = dt.date(full, int(a), int(b))
    except ValueError:
        try:
            day = dt.date(full, int(b), int(a))
        except ValueError:
            return value
    base = dt.date(full - full % 100 if full >= 100 else full, 1, 1)
    span = (dt.date(base.year + 100, 1, 1) - base).days
    at = (day - base).days
    half = 191  # 191 * 192 covers every day of a century; values outside are walked over
    while True:
        hi, lo = permute([(at // half, 192), (at % half, half)], key, "date")
        at = hi * half + lo
        if at < span:
            break
    new = base + dt.timedelta(days=at)
    yy = f"{new.year:04d}" if len(y) == 4 else f"{new.year % 100:02d}"
    first, second = f"{new.month:02d}", f"{new.day:02d}"
    return sep.join((yy, first, second) if year_first else (second, first, yy))


def placeholder(value: str, kind: str, key: bytes) -> str:
    if kind in ("phone", "id_number", "date"):
        return f"[{kind.upper()} {pseudonym(value, kind, key)}]"
    norm = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value)).strip().casefold()
    return f"[{kind.upper()} {hmac.new(key, f'{kind}|{norm}'.encode(), hashlib.sha256).hexdigest()[:20]}]"


def replaced(text: str | None, spans: list[tuple[int, int, str]], key: bytes) -> str | None:
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, z, kind in spans:
        out += [text[at:a], placeholder(text[a:z], kind, key)]
        at = z
    return "".join([*out, text[at:]])


# ---------------------------------------------------------------- on tickets


PARTS = "role string, part string"
COUNTS = "kind string, word string, n bigint, of bigint"
OWN = f"array<struct<{COUNTS.replace(' ', ':').replace(',:', ',')}>>"


def _pieces(key: str) -> set[str]:
    """A word as compared and the parts of it."""
    return {key, *re.split(r"['\-]", key)}


def author_parts(tickets: DataFrame) -> DataFrame:
    """``role, part``: the distinct name parts of all authors. Authors are made distinct in the JVM first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sorted({x for a in batch.column(0).to_pylist() if (name := clean_author(a)) for x in name_parts(name)})
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.string()) for k in (0, 1)], names=["role", "part"])

    authors = tickets.select(F.explode(F.transform("comments", lambda c: c["author"])).alias("a")).where("a is not null and a rlike ' '").distinct()
    return authors.mapInArrow(run, PARTS).distinct()


def count_words(tickets: DataFrame, given: Iterable[str], last: Iterable[str], own: DataFrame | None = None) -> DataFrame:
    """``kind, word, n, of``: how often every word is used (w), how often it stands before (b) and after (a) two
    capitalised words, and how many of these there are (n); n of them are names of the lexicon. Counted on the executors."""
    shared = tickets.sparkSession.sparkContext.broadcast(Names(tuple(given), tuple(last), Context(frozenset(), {}, {})))
    made = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon(made, shared)
        for batch in batches:
            *columns, brought = batch.columns
            here = lex.joined(brought)
            firsts, lasts = here.given, here.last
            tokens: Counter[str] = Counter()
            around: Counter[tuple[bool, str, str]] = Counter()
            for k, col in enumerate(columns):
                for text in filter(None, col.to_pylist()):
                    tokens.update(_TOKEN.findall(text))
                    for a, z, x, y in _pairs(text) if k < len(FIELDS) else ():
                        kx, ky = _key(x), _key(y)
                        name = kx in firsts and ky in lasts
                        if name or not (kx in firsts or ky in lasts):
                            around[name, *_around(text, a, z)] += 1
            seen: Counter[tuple[str, str]] = Counter()
            named: Counter[tuple[str, str]] = Counter()
            for token, n in tokens.items():
                if (w := _key(token)) not in firsts and w not in lasts:
                    for p in _pieces(w):
                        seen["w", p] += n
            for (name, before, after), n in around.items():
                for key in (("b", before), ("a", after), ("n", "")):
                    seen[key] += n
                    named[key] += n * name
            rows = [(kind, w, named[kind, w], n) for (kind, w), n in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["kind", "word", "n", "of"])

    texts = _with_own(tickets, [*FIELDS, *(c for c in OTHERS if c in tickets.columns)], own).drop("rec_id")
    return texts.mapInArrow(run, COUNTS).groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))


def fit_context(tickets: DataFrame, given: Iterable[str], last: Iterable[str], own: DataFrame | None = None, max_words: int | None = None) -> tuple[Context, DataFrame | None]:
    """The classifier, from all tickets: what is broadcast of it, and the counts of its other words where it has more than
    ``MAX_WORDS``."""
    bound = MAX_WORDS if max_words is None else max_words
    used = max(2, -(-tickets.count() // IN_USE))
    counts = count_words(tickets, given, last, own).where(f"kind = 'n' or (kind = 'w' and of >= {used}) or (kind in ('b', 'a') and of >= {PLACES_LEAST})")
    rows = [tuple(r) for r in counts.limit(bound + 2).collect()]
    rest = None
    if sum(kind != "n" for kind, *_ in rows) > bound:  # the most frequent ones are broadcast, by the length of their counts
        counts, size, of_all = cut(counts), F.length(F.bin("of")), F.col("kind") == "n"
        sizes = [tuple(r) for r in counts.where(~of_all).groupBy(size).count().collect()]
        least = next(k for k in range(1, 66) if sum(n for length, n in sizes if length >= k) <= bound)
        rows = [tuple(r) for r in counts.where(of_all | (size >= least)).collect()]
        rest = counts.where(~of_all & (size < least))
    named, pairs = next(((n, of) for kind, _, n, of in rows if kind == "n"), (0, 0))
    return Context(frozenset(), {}, {}, named, pairs).joined(r for r in rows if r[0] != "n"), rest


def fit_names(tickets: DataFrame, max_parts: int | None = None, max_words: int | None = None) -> Names:
    """The parts of all authors' names and the classifier; what is not broadcast of them, for each ticket by a join."""
    bound = MAX_PARTS if max_parts is None else max_parts
    parts = author_parts(tickets)
    rows = parts.limit(bound + 1).collect()
    joined = [parts.select(F.col("role").alias("kind"), F.col("part").alias("word"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("of"))] if len(rows) > bound else []
    given, last = (tuple(sorted(r["part"] for r in rows if r["role"] == role and not joined)) for role in ("given", "last"))
    context, rest = fit_context(tickets, given, last, own_words(tickets, joined), max_words)
    return Names(given, last, context, own_words(tickets, joined, rest))


def own_words(tickets: DataFrame, parts: list[DataFrame], rest: DataFrame | None = None) -> DataFrame | None:
    """``rec_id, own``: what occurs of name parts and of the classifier's words in each ticket, however many there are in all."""
    known = [*parts, *([] if rest is None else [rest])]
    if not known:
        return None
    for_parts, for_rest = bool(parts), rest is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = set()
                for text in filter(None, texts):
                    if for_parts:
                        own |= {("p", _key(w)) for w in _TOKEN.findall(text)}
                    for a, z, x, y in _pairs(text):
                        before, after = _around(text, a, z)
                        if for_parts:
                            own |= {("p", _key(x)), ("p", _key(y))}
                        if for_rest:
                            own |= {("b", before), ("a", after), *(("w", p) for w in (x, y) for p in _pieces(_key(w)))}
                out += [(r, *x) for x in sorted(own)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["rec_id", "place", "word"])

    texts = [*FIELDS, *(c for c in OTHERS if parts and c in tickets.columns)]
    words = tickets.select(F.col("rec_id").cast("bigint").alias("rec_id"), *texts).mapInArrow(run, "rec_id bigint, place string, word string")
    all_known = reduce(DataFrame.unionByName, known).withColumn("place", F.when(F.col("kind").isin("given", "last"), "p").otherwise(F.col("kind")))
    return words.join(all_known, ["place", "word"]).groupBy("rec_id").agg(F.collect_set(F.struct("kind", "word", "n", "of")).alias("own"))


def _with_own(tickets: DataFrame, columns: list[str], own: DataFrame | None) -> DataFrame:
    """``rec_id``, the columns and ``own``."""
    df = tickets.select("rec_id", *columns)
    if own is None:
        return df.withColumn("own", F.lit(None).cast(OWN))
    own = own.withColumnRenamed("rec_id", "_rec")
    return df.join(own, df["rec_id"].eqNullSafe(own["_rec"]), "left").select("rec_id", *columns, "own")


_made: dict[str, Lexicon] = {}


def _lexicon(key: str, shared) -> Lexicon:
    """Built once per Python worker and result."""
    if key not in _made:
        _made.clear()
        _made[key] = Lexicon.of(shared.value)
    return _made[key]


SPANS = "rec_id bigint, field string, kind string, start_pos int, end_pos int"


def _inputs(tickets: DataFrame, names: Names) -> DataFrame:
    return spread(_with_own(tickets, list(FIELDS), names.own))


def _share(tickets: DataFrame, names: Names):
    """The lexicon as a broadcast, at most MAX_PARTS parts and MAX_WORDS words, and a name for it."""
    return uuid.uuid4().hex, tickets.sparkSession.sparkContext.broadcast(Names(names.given, names.last, names.context))


def find_details(tickets: DataFrame, names: Names) -> DataFrame:
    """Every detail in title, text and body: ``rec_id, field, kind, start_pos, end_pos`` (from 1, end included)."""
    key, shared = _share(tickets, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon(key, shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                *columns, own = part.columns
                here, out = lex.joined(own), []
                for rec, *texts in zip(*(c.to_pylist() for c in columns), strict=True):
                    for field, text in zip(FIELDS, texts, strict=True):
                        out += [(rec, field, kind, a + 1, z) for a, z, kind in find(text, here)]
                cols = list(zip(*out, strict=True)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["rec_id", "field", "kind", "start_pos", "end_pos"])

    return _inputs(tickets, names).mapInArrow(run, SPANS)


def redact(tickets: DataFrame, names: Names, key: bytes) -> DataFrame:
    """The texts with placeholders: ``rec_id, title, text, body``."""
    made, shared = _share(tickets, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon(made, shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                *columns, own = part.columns
                here = lex.joined(own)
                out = [(rec, *(replaced(t, find(t, here), key) for t in texts)) for rec, *texts in zip(*(c.to_pylist() for c in columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), *[pa.string()] * 3), strict=True)], names=["rec_id", *FIELDS])

    return _inputs(tickets, names).mapInArrow(run, "rec_id bigint, title string, text string, body string")
