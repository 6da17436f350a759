"""Personal data inside free text (problem 3): find it, and put typed placeholders in its place.

A text passes through transducers that keep, for every character they write, the span of source
characters it stands for: width and homoglyph folding, removal of invisible characters, digits
spelled as words, and disguised at and dot. Identifiers are detected in the normalised text and
their spans mapped back, so positions are code points of the text as it stands.

E-mail, phone and identity numbers and addresses are patterns with the words around them as
evidence. Names are found in two ways. What follows words that introduce a person (forms of
address, sign-offs, contact lines, recipients) and is built like a name is one. And the words of such
names are counted over all distinct texts of the table: how often a word leads or ends a name,
starts sentences, or stands in lower case. By these counts a name is also found where nothing
introduces it: a word that leads names before one that ends names. The same counts tell where a name
ends among capitalised words.

Defined cases: null and empty texts have nothing; spans of one text don't overlap (the earlier
kind in the order of KINDS wins); repeated rows each count.
"""

from __future__ import annotations

import re as _re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.session import spread, written

KINDS = ("email", "address", "id_number", "phone", "name")
#: What the word statistics count.
PLACES = ("small", "cap", "start", "first", "last")

# -- transducers ------------------------------------------------------------------------------------

# Cyrillic and Greek letters that look like Latin ones.
LOOK = dict(zip("АВЕЅІЈКМНОРСТХУаеорсухіјѕԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABESIJKMHOPCTXYaeopcyxijsdABEZHIKMNOPTYXo"))
# Digits as words in English, German, French and Spanish.
DIGITS = {"zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9, "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9}
_digit = "|".join(sorted(DIGITS, key=lambda w: (-len(w), w)))
SPELLED = re.compile(rf"(?i)\b(?:{_digit})(?:[ ,\-]{{1,2}}(?:{_digit})){{4,}}\b")
ONE = re.compile(rf"(?i)\b(?:{_digit})\b")
INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
LATIN_NEAR = re.compile(r"[\p{Latin}\d]")

AT = r"(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?|\s+at\s+)"
DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|punkt|point|punto)\s?[)\]}]\s?|\s+dot\s+)"
LOCAL = r"[\p{L}\d][\p{L}\d._%+\-]*(?<![.])"
DISGUISED = re.compile(rf"(?i)(?<![\p{{L}}\d._%+\-])({LOCAL})({AT})((?:[\p{{L}}\d\-]+{DOT}){{1,4}}\p{{L}}{{2,}})(?![\p{{L}}\d\-])")
DOTS = re.compile(rf"(?i){DOT}")
MAIL_CUE = re.compile(r"(?i)(?:e-?mail|mail|write to|schreiben sie an|écrivez à|escriban? a|mail me|[,(:])\s*:?\s*$")
DOT_WORDS = frozenset(("dot", "punkt", "point", "punto"))
HOST = _re.compile(r"[\w\-]\.[^\W\d_]{2}")


class Mapped:
    """A text with what it is in lower case, the set of the words of that and, per character, the start and end of the source characters it stands for (None: itself)."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None, words: set[str] | None = None):
        self.text, self.start, self.end, self.words = text, start, end, words
        self.low = ""

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])

    def rewrite(self, changes: list[tuple[int, int, str]]) -> Mapped:
        """Replace the ranges, in order and disjoint; what is written stands for the whole range."""
        if not changes:
            return self
        start = self.start or list(range(len(self.text)))
        end = self.end or list(range(1, len(self.text) + 1))
        out, s, e, at = [], [], [], 0
        for a, b, new in changes:
            out += [self.text[at:a], new]
            s += start[at:a] + [start[a]] * len(new)
            e += end[at:a] + [end[b - 1]] * len(new)
            at = b
        new = Mapped("".join(out) + self.text[at:], s + start[at:], e + end[at:], self.words)
        new.low = self.low
        return new


#: Characters outside ASCII that a rewrite may touch: all but Latin letters and what is common between them.
ODD = _re.compile("[^\\x00-\\x7f\\u00a1-\\u00ac\\u00ae-\\u024f\\u1e00-\\u1eff\\u2018\\u201a-\\u201f\\u2020-\\u2027\\u2030-\\u2058\\u20a0-\\u20bf\\u2600-\\u27bf\\U0001f000-\\U0001faff]")
SPACED_WORD = _re.compile(r"[^\W\d_]+(?:['\-][^\W\d_]+)*")


def fold(text: str) -> Mapped:
    """Characters as they are usually written: no invisible ones, Latin look-alikes, plain widths, signs and digits."""
    m = Mapped(text)
    if not text.isascii():
        changes = []
        for x in ODD.finditer(text):
            i, c = x.start(), x[0]
            if c in INVISIBLE:
                changes.append((i, i + 1, ""))
            elif c in LOOK:
                near = text[max(0, i - 1) : i] + text[i + 1 : i + 2]
                if LATIN_NEAR.search(near):
                    changes.append((i, i + 1, LOOK[c]))
            elif c in "‐‑‒–—−":
                changes.append((i, i + 1, "-"))
            elif c in "’ʼ＇":
                changes.append((i, i + 1, "'"))
            elif unicodedata.category(c) == "Zs":
                changes.append((i, i + 1, " "))
            elif unicodedata.category(c) == "Nd" or "\uff01" <= c <= "\uff5e" or "\U0001d400" <= c <= "\U0001d7ff":
                changes.append((i, i + 1, unicodedata.normalize("NFKC", c) if unicodedata.category(c) != "Nd" else str(unicodedata.digit(c))))
        m = m.rewrite(changes)
    return m


def normalise(text: str) -> Mapped:
    m = fold(text)
    low = m.low = m.text.lower()
    m.words = set(SPACED_WORD.findall(low))
    if not m.words.isdisjoint(DIGITS) and sum(map(DIGITS.__contains__, SPACED_WORD.findall(low))) >= 5:
        m = m.rewrite([(x.start(), x.end(), "".join(str(DIGITS[w.lower()]) for w in ONE.findall(x[0]))) for x in SPELLED.finditer(m.text)])
    if "@" not in m.text and "at" not in m.words:
        return m
    # a name of a host has a dot between its parts, written or as a word
    if m.words.isdisjoint(DOT_WORDS) and not HOST.search(m.text):
        return m
    changes = []
    for x in DISGUISED.finditer(m.text):
        local, at, domain = x.group(1), x.group(2), x.group(3)
        if "@" in at and at.strip() == at and not DOTS.sub("", domain) != domain.replace(".", ""):
            continue
        wordy = at.strip().isalpha()
        if "." not in domain and DOTS.split(domain)[-1].lower() in NAME_STOP:
            continue
        if wordy and not (re.search(r"(?i)\sdot\s|[(\[{]", domain) or re.search(r"[\d._+\-]", local) or MAIL_CUE.search(m.text[: x.start()])):
            continue
        changes.append((x.start(2), x.end(2), "@"))
        changes += [(x.start(3) + d.start(), x.start(3) + d.end(), ".") for d in DOTS.finditer(domain) if d[0] != "."]
    return m.rewrite(changes)


# -- patterns ---------------------------------------------------------------------------------------

EMAIL = re.compile(r"(?<![\p{L}\d._%+\-])[\p{L}\d][\p{L}\d._%+\-]*@(?:[\p{L}\d](?:[\p{L}\d\-]*[\p{L}\d])?\.)+\p{L}{2,}(?![\p{L}\d])")

NOT_A_NUMBER = re.compile(r"(?i)(?:\bean|\bisbn|tracking|sendungs\w*|serial(?: no\.?| number)?|\bno\.|\bnr\.|invoice|rechnung|facture|factura|ticket|order|bestell\w*|commande|pedido|\bref|batch|version|size|\bpart|\bsku|\bitem|expediente|dossier|\bnote|nota|[$€£])[\s:#]*\p{L}{0,2}\s*$")
NUMBER = re.compile(r"(?<![\p{L}\d.,\-/+@#$€£])(?:\(?\+\d{1,3}\)?|\(\d{2,5}\)|\d)(?:[ .\-/]{0,1}(?:\(\d{1,5}\)|\d+))*(?![\p{L}\d@]|[.,\-/]\d)")
PHONE_CUE = re.compile(r"(?i)(?:\btel(?:\.|efon|ephone|éfono|éphone)?|\bcall(?: me)?(?: at| on)?|\bphone|\bmobile|\bhandy|\bcell|call to|\bunder|\breach me (?:at|on|under)|rufen sie|anrufen?|unter|erreichbar unter|appelez(?: le)?|joignable au|rappeler au|appeler(?: le| au)?|llamen? al?|llamar al?|disponible en el|\bfax|\bsms|whatsapp)\s*:?\s*$")
TELEPHONE = _re.compile(r"(?i)\b(?:tel(?:\.|efon|ephone|éfono|éphone)?|phone|mobile|handy|fax|sms|whatsapp)\s*:?\s*(?=[\d+(])")
TELEPHONES = frozenset("tel telefon telephone teléfono téléphone phone mobile handy fax sms whatsapp".split())
SHAPE = [
    re.compile(r"^\(?\+\d{1,3}\)?[ .\-/]?(?:\(\d{1,5}\)[ .\-/]?)?\d[\d .\-/]{5,}$"),  # international
    re.compile(r"^00\d{1,3}[ .\-/]?\d[\d .\-/]{6,}$"),
    re.compile(r"^(?:1[ .\-])?(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}$"),  # North America
    re.compile(r"^\(0\d{1,4}\) ?\d[\d .\-/]{4,}$"),
    re.compile(r"^0\d{1,4}[ /.\-]\d[\d .\-/]{4,}$"),
    re.compile(r"^0\d{8,10}$"),
]

ID_CUE = re.compile(
    r"(?i)(?:\bmy ID\b[^.\n]{0,12}?|\bID (?:number|no\.?|card)[^.\n]{0,12}?|social security(?: number)?|national insurance(?: number)?|passport(?: number| no\.?)?|licen[cs]e(?: number| no\.?)?|\bSSN|tax (?:id|number)|ausweis(?:nummer|-nr\.?)?|personalausweis|reisepass(?:nummer)?|steuer-?(?:id|nummer|identifikationsnummer)|sozialversicherungsnummer|sécurité sociale|carte d'identité|pièce d'identité|passeport|permis de conduire|numéro fiscal|\bDNI|\bNIE|\bNIF|documento|pasaporte|seguridad social)"
    r"[\s:#,]*(?:(?:is|it is|lautet|ist|est|es|número|numéro|numero|nr\.?|n\.º|no\.?|n°)[\s:]+){0,2}$"
)
#: Papers with numbers of persons, named behind the number in the same sentence.
ID_AFTER = re.compile(r"(?i)^[^.!?\n]{0,30}?\b(?:ID|SSN|social security|national insurance|passport|driving licen[cs]e|driver'?s licen[cs]e|licen[cs]e|ausweis\w*|reisepass\w*|führerschein\w*|steuer-?(?:id|nummer)|passeport|carte d'identité|permis de conduire|sécurité sociale|DNI|NIE|NIF|pasaporte|documento de identidad|seguridad social)\b")
#: Words of which one stands in whatever ID_CUE or ID_AFTER finds, or beginnings of them.
PAPERS = frozenset("id ssn social insurance passport license licence tax sozialversicherungsnummer sécurité carte d'identité passeport permis fiscal dni nie nif documento pasaporte seguridad pièce".split())
PAPER_STEMS = ("ausweis", "reisepass", "steuer", "führerschein")
DIGIT = _re.compile(r"\d")
SIX_DIGITS = _re.compile(r"\d(?:[ .\-]?\d){5}")
ID = re.compile(r"(?<![\p{L}\d\-.])(?:[A-Z]{1,3}(?=[\d\-. ]))?(?:[ .\-]?(?:\d+[A-Z]{0,3}\d*|[A-Z](?=[\d.\-])\d*|[A-Z]\d+))+(?:[ .\-]?[A-Z](?![\p{L}\d]))?(?![\p{L}\d])")
ID_SURE = re.compile(r"(?<![\p{L}\d\-./])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} \d{2} \d{2} \d{2} [A-Z]|DL-[A-Z]\d{2}-\d{4}-\d{3}|[XYZ]\d{7}-?[A-Z]|\d{8}-?[A-Z]|\d{1,2}\.\d{3}\.\d{3}-?[A-Z]|[1-9] \d{2} \d{2} [\dAB]{2} \d{3} \d{3} \d{2})(?![\p{L}\d\-])")

# Kinds of streets in four languages.
EN_STREET = "street|st|road|rd|lane|ln|close|rise|avenue|ave|boulevard|blvd|terrace|drive|dr|court|ct|place|pl|way|square|sq|crescent|row|walk|gardens|grove|parkway|pkwy|highway|hwy|mews|quay|circle|trail|hill|view|park|green|yard"
DE_STREET = "straße|strasse|str\\.|weg|allee|pfad|platz|gasse|ring|damm|ufer|steig|stieg|chaussee|promenade|markt|graben|wall|hof|kamp|grund|garten|berg|tor|brücke"
FR_STREET = "rue|avenue|av\\.?|bd\\.?|boulevard|chemin|impasse|place|allée|quai|route|cours|square|passage|sentier|ruelle|faubourg|montée"
ES_STREET = "calle|c/|avenida|avda\\.?|av\\.|paseo|pº|plaza|pza\\.?|camino|carretera|ctra\\.?|ronda|travesía|glorieta|callejón|rambla|cuesta"
NOT_PLACE = "tel|telefon|apt|email|mail|thanks|gracias|merci|danke|please|bitte|the"
CAP = r"(?:(?!(?i:" + NOT_PLACE + r")\b|\p{Lu}{2} \d{5})\p{Lu}[\p{L}'\-]+(?![\p{L}\d]))"
SMALL = r"(?:am|an|an der|an den|im|in|bei|ob|vor der|auf|upon|on|under|by|of|de|del|de la|de las|de los|du|des|la|le|les|sur|sous|en|lès|aux|y|el|los|las)"
TOWN = rf"{CAP}(?:(?: {SMALL})? {CAP}){{0,3}}"
EN_ADDRESS = re.compile(
    rf"(?<![\p{{L}}\d.,$€£/\-])(?:(?i:flat|apartment|apt|unit|suite) \d*\p{{L}}?\d*,? )?\d{{1,5}}\p{{L}}? (?:(?!(?i:of|the|and|for|in|a|an|on|at|to|from|with|boxes|pieces|units|buyers|stars|out|variants|days|weeks|months|hours|minutes|years)\b)[\p{{L}}'\-]+\.? ){{1,3}}?(?:(?i:{EN_STREET})\b)"
    rf"(?:(?<=(?i:st))\.|\.(?=[,.]| (?i:apt|unit|suite|flat)\b| \p{{Ll}}))?(?:,? (?i:apt|apartment|unit|suite|flat)\.? \d*\p{{L}}?\d*|,? #\d+)?"
    rf"(?:, {TOWN}(?:,? (?:\p{{Lu}}{{1,2}}\d{{1,2}}\p{{Lu}}? \d\p{{Lu}}{{2}}|\p{{Lu}}{{2}} \d{{5}}(?:-\d{{4}})?))?)?"
)
DE_ADDRESS = re.compile(
    rf"(?<![\p{{L}}\d])(?:(?:(?:Alte|Neue|Große|Kleine|Obere|Untere|Hohe|Lange|Kurze|An der|Auf der|Auf dem|Zum|Zur|Am|Im|Unter den|In der) )?(?:\p{{Lu}}[\p{{L}}\-]*(?:{DE_STREET})|(?:\p{{Lu}}[\p{{L}}\-]+[ \-])?(?:Straße|Str\.|Weg|Allee|Platz|Gasse|Ring|Damm|Ufer))|(?:Am|Im|An der|An den|Auf der|Auf dem|Zum|Zur|Unter den|In der|In den|Hinter der|Vor dem) \p{{Lu}}[\p{{L}}\-]+)"
    rf" \d{{1,4}}(?: ?[a-z])?(?:\s?-\s?\d{{1,4}}(?: ?[a-z])?)?(?![\p{{L}}\d]|[.,]\d)(?:, (?:(?:D-)?\d{{5}} )?{TOWN})?",
)
DE_CITY_WORDS = re.compile(r"^(?:Am|Im|Zum|Zur|An|Auf|In|Unter|Hinter|Vor)\b")
FR_NAME = r"(?:(?:(?:du|de la|de l'|des|de|aux|à la|au|d'|la|le|les|l') ?)*[\p{L}][\p{L}'\-]+)"
FR_ADDRESS = re.compile(rf"(?<![\p{{L}}\d.,/\-])\d{{1,4}}(?: ?(?:bis|ter|quater)\b)?,? (?i:{FR_STREET}) (?:(?:du|de la|de l'|des|de|aux|à la|au|d'|la|le|les|l') ?){{0,2}}\p{{Lu}}[\p{{L}}'\-]+(?: (?:(?:du|de la|des|de|aux|sur|en) )?\p{{Lu}}[\p{{L}}'\-]+){{0,3}}(?:, (?:(?:F-)?\d{{5}} )?{TOWN})?")
ES_ADDRESS = re.compile(
    rf"(?<![\p{{L}}\d])(?i:{ES_STREET}) ?(?:(?:de la|de los|de las|del|de|la|el|los|las) ){{0,2}}\p{{Lu}}[\p{{L}}'\-]+(?: (?:(?:de la|de los|de las|del|de|y) )?\p{{Lu}}[\p{{L}}'\-]+){{0,3}},?(?: n\.? ?[ºo°]\.?| núm\.?| nº)? \d{{1,4}}(?![\p{{L}}\d]|[.,]\d)"
    rf"(?:, \d{{1,2}}\.?[ºª°](?: ?(?:\p{{Lu}}|izq\.?|dcha\.?)(?![\p{{L}}]))?)?(?:, (?:\d{{5}} )?{TOWN})?"
)
EN_WORDS, FR_WORDS, ES_WORDS = (frozenset(_re.findall(r"[^\W\d_]+", x)) for x in (EN_STREET, FR_STREET, ES_STREET))
DE_ENDS = tuple(x.removesuffix("\\.") for x in DE_STREET.split("|"))


def _streets(words: set[str]) -> list:
    """The address patterns that can match a text of these words."""
    got = [p for p, own in ((EN_ADDRESS, EN_WORDS), (FR_ADDRESS, FR_WORDS), (ES_ADDRESS, ES_WORDS)) if not words.isdisjoint(own)]
    placed = not words.isdisjoint(("am", "im", "zum", "zur")) or not words.isdisjoint(("an", "auf", "unter", "in", "hinter", "vor")) and not words.isdisjoint(("der", "den", "dem"))
    return [*got, DE_ADDRESS] if placed or any(w.endswith(DE_ENDS) for w in words) else got

WORD = r"\p{L}+(?:['\-]\p{L}+)*"
WORDS = re.compile(WORD)
TITLE = r"(?:(?:Mr|Mrs|Ms|Mx|Dr|Prof|Sr|Sra|Srta|Mme|Mlle)\.?|(?:M|Hr|Fr)\.|Miss|Herrn?|Frau|Monsieur|Madame|Mademoiselle|[Ee]l señor|[Ll]a señora|[Ss]eñora?|Don|Doña|Sir|Lady)"
# Words that introduce a person, in four languages.
BEFORE = re.compile(
    r"(?:(?i:\b(?:kind |best |warm )?regards|\bsincerely(?: yours)?|\byours(?: truly| faithfully| sincerely)?|\bbest wishes|\bcheers|\bmit (?:freundlichen|besten|herzlichen|lieben) grüßen|\b(?:viele|liebe|beste|herzliche) grüße|\bcordialement|\bbien à vous|\b(?:meilleures |sincères )?salutations|\bun (?:cordial )?saludo|\bsaludos(?: cordiales)?|\batentamente|\bcordialmente)\s*,?\s+"
    r"|(?i:\b(?:contact|kontakt|contacto|ansprechpartner(?:in)?|name|nom|nombre|customer|kunde|kundin|client|cliente|recipient|empfänger(?:in)?|destinataire|destinatario|signed|sender|absender|attn|attention))\s?:\s*"
    r"|(?i:\bmy name is|\bmein name ist|\bich heiße|\bje m'appelle|\bmon nom est|\bme llamo|\bmi nombre es)\s+"
    r"|(?i:\b(?:please |you can |could you |just )?ask(?: for)?|\b(?:speak|talk|spoke|talked) (?:to|with)|\b(?:ship|send|deliver|hand) (?:it|this|them) to|\bin the name of|\bcare of|\bc/o|\b(?:lieferung|liefern sie|senden sie) an|\bz\. ?hd\.|\blivrer (?:à|chez)|\bà l'attention de|\bentregar a|\bentréguen?lo a|\ba la atención de|\ba nombre de|\bpregunte(?:n)? por|\bfragen sie nach|\bdemandez)\s+"
    rf"|(?<![\p{{L}}]){TITLE}\s+)"
)
TITLED = re.compile(rf"{TITLE}\s")
CLEAR = re.compile(rf"({WORD})(?: \p{{Lu}}\.)? ({WORD})(?: ({WORD}))?(?=[,.;:)(]|\n| \p{{Ll}}|$)")
#: Of these words, in lower case, one stands in whatever BEFORE finds.
INTRODUCING = frozenset(
    "regards sincerely yours wishes cheers grüßen grüße cordialement vous salutations saludo saludos atentamente cordialmente contact kontakt contacto ansprechpartner ansprechpartnerin"
    " name nom nombre customer kunde kundin client cliente recipient empfänger empfängerin destinataire destinatario signed sender absender attn attention heiße m'appelle llamo ask speak talk spoke"
    " talked ship send deliver hand care c lieferung liefern senden hd livrer l'attention entregar entréguelo entréguenlo atención pregunte pregunten fragen demandez"
    " mr mrs ms mx dr prof sr sra srta mme mlle m hr fr miss herr herrn frau monsieur madame mademoiselle señor señora don doña sir lady".split()
)
FRENCH = frozenset("les des une est et du je nous vous pour dans sur avec mais pas qui que".split())
INTRODUCING_WORD = _re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: The first word of a sentence, a line or what follows a sign.
FIRST = _re.compile(r"(?:^|[.!?…:;]\s+|\n\s*|\s{2,}|[^\w\s,'\-()\"]\s+)([^\W\d_]+(?:['\-][^\W\d_]+)*)")
NAME_STOP = frozenset("a an and i is it the we you my our your he she they when who with from for to of in on at by or as not no so und ich ist der die das den dem ein eine wir sie er es mein unser mit von im am an zu bei et je le la les un une des du de nous vous il elle est mon notre y el los las una yo me mi su con en por al del que se".split())


class Model:
    """Word statistics."""

    def __init__(self):
        self.small, self.cap, self.start, self.first, self.last = (Counter() for _ in PLACES)
        self._ends: frozenset[str] | None = None

    @staticmethod
    def count(texts: list[str]) -> Counter:
        """Counts of (what, word ...) in texts: words by place, clear names by their parts, and as 'use' the words near introductions.

        Clear names are two or three words between an introduction and a mark or a word in lower case.
        Decisions about names ask for no words but those near introductions.
        """
        every, first, got = Counter(), Counter(), Counter()
        for text in texts:
            m = fold(text)
            t = m.text
            words = SPACED_WORD.findall(t)
            every.update(words)
            first.update(FIRST.findall(t))
            m.words = set(map(str.lower, words))
            for at in introductions(m):
                near = {w[0].lower() for w in islice(TOKEN.finditer(t, at), 6)}
                for w in near | {p for w in near for p in w.split("-")}:
                    got["use", w, "", ""] = 1
                n = CLEAR.match(t[at : at + 80])
                if n and n[1][0].isupper() and n[2][0].isupper() and min(len(n[1]), len(n[2])) > 1:
                    got["name", n[1].lower(), n[2].lower(), n[3] or ""] += 1
        for w, n in every.items():
            if w[0].islower():
                got["small", w.lower(), "", ""] += n
            else:
                starts = min(n, first.get(w, 0))
                got["start", w.lower(), "", ""] += starts
                got["cap", w.lower(), "", ""] += n - starts
        return got

    def fit(self, counts: dict[tuple[str, str, str, str], int]) -> Model:
        for (what, w, _, _), n in counts.items():
            if what in PLACES:
                getattr(self, what)[w] += n
        for (what, a, b, c), n in counts.items():
            if what != "name":
                continue
            k = c.lower()
            if c and (c[0].islower() or len(c) < 2 or self.start[k] + self.small[k] >= self.cap[k]):
                continue
            for p in a.split("-"):
                self.first[p] += n
            for p in (b, k):
                if p:
                    self.last[p] += n
        return self

    def surely_given(self, w: str) -> bool:
        """The word leads names, more than once, and is written as a name or is seldom anything else."""
        return self.given(w) and all(self.first[p] >= 2 for p in w.lower().split("-")) and self._named(w)

    def surely_family(self, w: str) -> bool:
        return self.ends_names(w) and self._named(w)

    def ends_names(self, w: str) -> bool:
        return self.family(w) and self.last[w.lower()] > self.first[w.lower()]

    def _named(self, w: str) -> bool:
        k = w.lower()
        return w[0].isupper() or 2 * (self.first[k] + self.last[k]) >= self.small[k]

    def given(self, w: str) -> bool:
        """The word leads names."""
        return all(self.first[p] > self.last[p] for p in w.lower().split("-"))

    def family(self, w: str) -> bool:
        """The word goes on or ends names."""
        w = w.lower()
        return self.last[w] >= 2 and self.last[w] >= self.first[w]

    def ends(self) -> frozenset[str]:
        """The words that end names."""
        if self._ends is None:
            self._ends = frozenset(w for w in self.last if self.last[w] >= 2 and self.last[w] > self.first[w])
        return self._ends

    def common(self, w: str) -> bool:
        """The word is one of the language: often in lower case or first in a sentence, seldom part of a name."""
        k = w.lower()
        if k in NAME_STOP:
            return True
        known = self.first[k] + self.last[k]
        return self.small[k] + self.start[k] > max(self.cap[k], 4 * known)


TOKEN = re.compile(rf"(?:{WORD})")
INITIAL = re.compile(r"\p{Lu}\.")
NAME_PART = re.compile(rf"(?<![\p{{L}}\d'\-])(?:\p{{Lu}}\.|{WORD})")


def _words_from(t: str, at: int) -> Iterator[tuple[int, int, str]]:
    """The words and initials from `at` on that single blanks divide."""
    while True:
        m = INITIAL.match(t, at) if not re.match(r"\p{L}{2}", t[at : at + 2]) else None
        m = m or TOKEN.match(t, at)
        if not m:
            return
        yield m.start(), m.end(), m[0]
        if t[m.end() : m.end() + 1] != " ":
            return
        at = m.end() + 1


def read_name(t: str, at: int, model: Model) -> tuple[int, int] | None:
    """The name that begins at `at`: given names, initials and family names, or 'family, given'."""
    ws = []
    for s, e, w in _words_from(t, at):
        ws.append((s, e, w))
        if len(ws) == 5:
            break
    if not ws:
        return None

    def fits(w: str, k: int) -> bool:
        if INITIAL.fullmatch(w):
            return True
        if len(w) < 2 or w.lower() in NAME_STOP:
            return False
        if w[0].isupper():
            return True
        return not model.common(w) or model.given(w) or model.family(w)

    # family, given
    for k in (1, 2):
        if len(ws) >= k and t[ws[k - 1][1] : ws[k - 1][1] + 2] == ", " and all(fits(w, 0) and not INITIAL.fullmatch(w) for _, _, w in ws[:k]):
            after = list(_words_from(t, ws[k - 1][1] + 2))[:2]
            if after and fits(after[0][2], 0) and (model.given(after[0][2]) or k == 1 and INITIAL.fullmatch(after[0][2])) and (k == 1 or not model.given(ws[0][2])):
                end = after[0][1]
                if len(after) > 1 and INITIAL.fullmatch(after[1][2]):
                    end = after[1][1]
                return at, end
    if not fits(ws[0][2], 0):
        return None
    end, full, given = None, 0, 0
    for k, (s, e, w) in enumerate(ws):
        if not fits(w, k) or k and BEFORE.match(t, s) and not TITLED.match(t, s):
            break  # no word of it, or another introduction, as in 'Regards, A B Lieferung an C D'
        if INITIAL.fullmatch(w):
            if k and full:
                # an initial between given and family name needs a word after it
                if k + 1 >= len(ws) or not fits(ws[k + 1][2], k + 1) or full > 1:
                    break
            given += 1
            continue
        if k == 0:
            full, end = 1, e
            given += model.given(w)
            continue
        if full + (1 if given and INITIAL.fullmatch(ws[0][2]) else 0) >= 2:  # a further family or given name
            if model.common(w) or not (model.family(w) or model.given(ws[k - 1][2]) and not model.family(ws[k - 1][2])):
                break
        elif model.common(w) and not (model.family(w) or model.given(w)):
            break
        full, end = full + 1, e
        if full == 4:
            break
    if end is None:
        return None
    one = full == 1 and not any(INITIAL.fullmatch(w) for s, _, w in ws if s < end)
    if one and (model.common(ws[0][2]) or not (model.family(ws[0][2]) or model.given(ws[0][2]))):
        return None
    return at, end


def _known_names(t: str, model: Model) -> Iterator[tuple[int, int]]:
    """Names without an introduction: given names or initials before family names, or 'family, given', all of them known from elsewhere."""
    ws = [(m.start(), m.end(), m[0]) for m in NAME_PART.finditer(t)]
    k = 0
    while k < len(ws):
        s, e, w = ws[k]
        led, j, first = 0, k, True
        # given names and initials, each a blank from the next
        while j < len(ws) and (first or t[ws[j - 1][1] : ws[j][0]] == " ") and (INITIAL.fullmatch(ws[j][2]) or model.surely_given(ws[j][2])):
            led, j, first = led + 1, j + 1, False
        end = None
        if led:
            # behind a known given name a family name may be a usual word too, written like it
            while j < len(ws) and j - k < 5 and t[ws[j - 1][1] : ws[j][0]] == " " and (model.surely_family(ws[j][2]) or j == k + 1 and w[0].islower() and model.ends_names(ws[j][2])):
                end, j = ws[j][1], j + 1
        elif model.surely_family(w):
            j = k + 1
            if j < len(ws) and t[e : ws[j][0]] == " " and model.surely_family(ws[j][2]):
                j += 1
            if j < len(ws) and t[ws[j - 1][1] : ws[j][0]] == ", " and (model.surely_given(ws[j][2]) or INITIAL.fullmatch(ws[j][2])):
                end, j = ws[j][1], j + 1
                if j < len(ws) and t[ws[j - 1][1] : ws[j][0]] == " " and INITIAL.fullmatch(ws[j][2]):
                    end, j = ws[j][1], j + 1
        if end is not None:
            yield s, end
            k = j
        else:
            k += 1


def introductions(m: Mapped) -> list[int]:
    """Where words end that introduce a person. Only the surroundings of words that do are searched."""
    if m.words.isdisjoint(INTRODUCING):
        return []
    got, low, done = set(), m.text.lower(), 0
    french = len(FRENCH & m.words) > 1  # elsewhere M. is an initial
    if len(low) != len(m.text):  # a few letters change their length
        return sorted({x.end() for x in BEFORE.finditer(m.text) if french or not x[0].startswith("M. ")})
    for x in INTRODUCING_WORD.finditer(low):
        if x[0] in INTRODUCING and x.end() > done:
            done = min(len(low), x.end() + 40)
            got.update(y.end() for y in BEFORE.finditer(m.text, max(0, x.start() - 40), done) if french or not y[0].startswith("M. "))
    return sorted(got)


def _names(m: Mapped, model: Model) -> Iterator[tuple[int, int]]:
    told = [got for at in introductions(m) if (got := read_name(m.text, at, model))]
    yield from told
    if not m.words.isdisjoint(model.ends()):
        yield from ((a, b) for a, b in _known_names(m.text, model) if all(b <= s or e <= a for s, e in told))


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def find(text: str | None, model: Model) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each piece of personal data, in order of position."""
    if not text:
        return []
    m = normalise(text)
    t = m.text
    got: list[tuple[str, int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= s or e <= a for _, s, e in got)

    def add(kind: str, a: int, b: int) -> None:
        if a < b and free(a, b):
            got.append((kind, a, b))

    if "@" in t:
        for x in EMAIL.finditer(t):
            add("email", x.start(), x.end())
    if DIGIT.search(t):
        streets = [(x.start(), x.end()) for p in _streets(m.words) for x in p.finditer(t)]
        for a, b in sorted(streets, key=lambda x: x[0] - x[1]):  # the longer of two that overlap
            add("address", a, b)
        for x in TELEPHONE.finditer(t) if not m.words.isdisjoint(TELEPHONES) else ():  # said to be a telephone, so no number of a paper named later
            n = NUMBER.match(t, x.end())
            if n and 7 <= _digits(n[0]) <= 15 and n[0].count("(") == n[0].count(")"):
                add("phone", n.start(), n.end())
        if SIX_DIGITS.search(t):
            for x in ID_SURE.finditer(t):
                if not NOT_A_NUMBER.search(t[max(0, x.start() - 24) : x.start()]) and not PHONE_CUE.search(t[max(0, x.start() - 30) : x.start()]):
                    add("id_number", x.start(), x.end())
        if not m.words.isdisjoint(PAPERS) or any(x in m.low for x in PAPER_STEMS):
            for x in ID.finditer(t):
                a, b = x.start(), x.end()
                while a < b and t[a] in " .-":
                    a += 1
                if 5 <= _digits(t[a:b]) <= 20 and (ID_CUE.search(t[max(0, a - 60) : a]) or ID_AFTER.match(t[b : b + 60])):
                    add("id_number", a, b)
        for x in NUMBER.finditer(t):
            a, b, s = x.start(), x.end(), x[0]
            if len(s) < 7 or s.count("(") != s.count(")") or not 7 <= _digits(s) <= 15:
                continue
            if NOT_A_NUMBER.search(t[max(0, a - 24) : a]):
                continue
            if PHONE_CUE.search(t[max(0, a - 30) : a]) or any(p.match(s) for p in SHAPE):
                add("phone", a, b)
            elif 9 <= _digits(s) <= 11 and re.search(r"\p{L}, $", t[max(0, a - 3) : a]) and t[b : b + 2] == ", ":
                add("phone", a, b)  # a contact line
    for a, b in sorted(_names(m, model), key=lambda x: x[0] - x[1]):  # the longer of two that overlap
        add("name", a, b)
    return sorted(((k, *m.source(a, b)) for k, a, b in got), key=lambda x: x[1])


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in place of the spans."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


# -- Spark ------------------------------------------------------------------------------------------


def fit_model(df: DataFrame, key: str, fields: list[str]) -> Model:
    """The model of all distinct texts of the fields, for finding names in these texts.

    Counts are added up and reduced to words on the workers. Only words that decisions about names
    in these texts can ask for, and for which an answer is yes, come to the driver.
    """
    texts = df.select(F.explode(F.array(*fields)).alias("t")).where("t <> ''").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(what, a, b, c.lower(), n) for (what, a, b, c), n in Model.count(list(pdf["t"])).items() if what != "name" or not c or not (c[0].islower() or len(c) < 2)]
            yield pd.DataFrame(rows, columns=["what", "a", "b", "c", "n"])

    counts = texts.mapInPandas(run, "what string, a string, b string, c string, n bigint").groupBy("what", "a", "b", "c").agg(F.sum("n").alias("n"))
    counts = written(counts, "name-words")
    of = lambda what: F.sum(F.when(F.col("what") == what, F.col("n")).otherwise(0)).alias(what)
    words = counts.where("what <> 'name'").groupBy(F.col("a").alias("w")).agg(of("small"), of("cap"), of("start"), of("use"))
    names = counts.where("what = 'name'").select("a", "b", "c", "n")
    # a third word counts where it seldom stands in lower case or first in a sentence
    ends = words.where(F.col("start") + F.col("small") < F.col("cap")).select(F.col("w").alias("c"))
    names = names.where("c = ''").unionByName(names.where("c <> ''").join(ends, "c", "left_semi"))
    part = lambda w, first, last: F.struct(w.alias("w"), first.alias("first"), last.alias("last"))
    n, no = F.col("n"), F.lit(0).cast("bigint")
    parts = F.concat(F.transform(F.split("a", "-"), lambda p: part(p, n, no)), F.array(part(F.col("b"), no, n), part(F.col("c"), no, n)))
    parts = names.select(F.explode(parts).alias("p")).select("p.*").where("w <> ''")
    total = words.unionByName(parts, allowMissingColumns=True).groupBy("w").agg(*[F.coalesce(F.sum(c), no).alias(c) for c in ("use", *PLACES)])
    small, cap, start, first, last = (F.col(c) for c in PLACES)
    told = (first > last) | (last >= 2) & (last >= first) | (small + start > F.greatest(cap, 4 * (first + last)))
    model = Model()
    for r in total.where((F.col("use") > 0) & told).collect():  # words beside words that introduce a person
        for c in PLACES:
            getattr(model, c)[r["w"]] = r[c]
    return model


def find_pii(df: DataFrame, key: str, fields: list[str], model: Model) -> DataFrame:
    """(key, field_name, pii_type, start_pos, end_pos) of each piece in the text columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            for k, f in enumerate(fields, 1):
                for i, t in zip(ids, batch.column(k).to_pylist()):
                    rows += [(i, f, kind, a, b) for kind, a, b in find(t, shared.value)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], [key, "field_name", "pii_type", "start_pos", "end_pos"])

    return spread(df.select(F.col(key).cast("bigint").alias(key), *fields)).mapInArrow(run, f"{key} bigint, field_name string, pii_type string, start_pos bigint, end_pos bigint")


def redact_pii(df: DataFrame, key: str, fields: list[str], model: Model) -> DataFrame:
    """(key, one redacted column per field)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [pa.array([redact(t, find(t, shared.value)) for t in batch.column(k).to_pylist()], pa.string()) for k in range(1, len(fields) + 1)]
            yield pa.record_batch([batch.column(0), *cols], [key, *fields])

    return spread(df.select(F.col(key).cast("bigint").alias(key), *fields)).mapInArrow(run, f"{key} bigint, " + ", ".join(f"`{f}` string" for f in fields))
