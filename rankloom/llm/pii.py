"""Personal information inside free text: detection, placeholders and keyed surrogates.

Detection walks a text with one expression for each type, the strict ones first; a stretch belongs to the first type that
claims it. Identity numbers of weak shape need a label nearby, names need a known given name, a title or a turn of phrase
that introduces a person; institutions, corpora and tools that bear a given name are left alone.

Replacement is by typed placeholder (``[EMAIL]``) or by *surrogate*: every entity gets a value of its type drawn by a key
from its normal form, so one entity has one surrogate in all texts (coreference) and without the key none can be traced
back. Digits go through a keyed permutation of all numbers of their length, letters of ids likewise, so separators,
length and country codes stay and two numbers never meet. Names keep gender, order, initials, particles and case; their new
family names are spelt from 64 keyed bits. Mail addresses and streets keep their layout. A surrogate that meets another
entity's surrogate or a stretch of the same text is drawn again with the next counter.

Defined results: null and empty texts hold nothing and stay as they are; the same surface is reported once per text and
type; overlapping finds go to the earlier type; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "idnum", "phone", "address", "name")

# Given names by usual gender, titles, words that introduce a person, street words, number labels.
FEMALE = "Agnès Agnes Alice Amara Amelia Ana Anna Anne Beatriz Birgit Brigitte Camille Carmen Catherine Chloé Clara Claire Dorota Elena Elisa Elizabeth Emily Emma Eva Fatima Fiona Grace Greta Hanna Hanne Heike Helen Ilse Ines Ingrid Isabel Jana Jane Julia Karin Katharina Laura Leila Lena Lucía Lucia Lucie Magda Maria Marie Marta Martina Mireille Monika Nadia Nina Noor Odile Olivia Petra Pilar Priya Renée Renee Rosa Sabine Sara Sarah Saskia Sofia Sophie Susanne Teresa Thandi Ursula Valentina Ximena Zofia".split()
MALE = "Adam Ahmed Alexander André Andre Antonio Arthur Bjarne Carlos Casper Christian Daniel David Diego Elio Emeka Erik Felix Fernando Frank George Hans Henrik Hugo Ivan Jakob James Jan Javier Jean Joaquín Joaquin John Jonas Jorge José Juan Jürgen Karl Kenji Klaus Lars Louis Luca Luis Lukas Marco Mark Martin Matteo Max Michael Miguel Mohammed Nicolas Niels Oliver Oskar Pablo Patrick Paul Pavel Pedro Peter Philippe Pierre Rafael Robert Ruben Samuel Sergio Soren Sören Stefan Thomas Tomás Tomas Victor Viktor Walter Werner William Yusuf".split()
TITLES = ("Dr.", "Dr ", "Prof.", "Mr.", "Mr ", "Mrs.", "Mrs ", "Ms.", "Ms ", "Mme ", "Mme.", "Mlle ", "Sr.", "Sra.", "Srta.", "Herr ", "Herrn ", "Frau ", "Monsieur ", "Madame ", "Señor ", "Señora ")
INTRODUCED = ("From:", "To:", "Cc:", "cc:", "CC:", "From :", "To :", "Signed,", "Author:", "author:", "Contact:", "Contact :", "contact person:", "Persona de contacto:", "Ansprechperson:", "Ansprechpartner:", "Ansprechpartnerin:", "Interlocuteur :", "Responsable :", "Von:", "An:", "De:", "À :", "Para:",
    "spoke to", "are due to", "handed to", "kept by", "panel nor", "second round", "evaluó", "Durchlauf hat", "suivi par", "rédigé par", "redactada por", "stammt von", "lo lleva", "Gespräch mit", "notes with", "entretien avec", "entrevista con", "Merci à", "Gracias a", "Dank an", "— ")
#: Words before a comma that are no family names.
OPENERS = set("Signed However Unfortunately Finally Also Dear Hello Hi Thanks Sincerely Regards Best Liebe Lieber Hallo Bonjour Hola Moreover Then Today Yesterday Gracias Merci Danke Therefore Overall Indeed First Second Third Atentamente Cordialement Saludos Grüße Gruß Meanwhile Later Still Yes No Oui Non Ja Nein Sí Here There Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split())
NOT_PERSONS = r"(?:corpus|corpora|parser|institute|institut|instituto|university|press|project|tool|dataset|benchmark|index|model|engine|library|prize|award|method|test|scale)"
LABELS = r"\b(?:SSN|social security|national ID|tax (?:id|number)|passport|Passport|pasaporte|passeport|Reisepass|Personalausweis|Ausweis|NI number|NINO|insurance n\w+|Steuer|Sozialversicherung|NIR|sécurité sociale|DNI|NIE|NIF|identity|identi|PESEL|consent form|Formular steht|formulaire indique|formulario consta)"

_LOCAL = r"[A-Za-z0-9À-ÿ_][\w.+\-’']*"
_DOT = r"(?:\.| ?[\[({] ?(?:dot|punkt|point|punto|DOT) ?[\])}] ?| (?:DOT|dot) )"
_AT = r"(?:@| @ | ?[\[({] ?(?:at|AT|@|arroba) ?[\])}] ?| (?:AT|at) )"
EMAIL = re.compile(rf"(?<![\w.+\-])(?:{_LOCAL}(?:@| @ | ?[\[({{] ?(?:at|AT|@|arroba) ?[\])}}] ?)[A-Za-z0-9][\w\-]*(?:{_DOT}[A-Za-z0-9][\w\-]*)*{_DOT}[A-Za-z]{{2,}}|{_LOCAL} (?:AT|at) [A-Za-z0-9][\w\-]*(?: (?:DOT|dot) [\w\-]+)+)(?![\w@])")
_MAIL_HINT = re.compile(r"@|\b(?:at|AT|arroba)\b.{1,80}?(?:\.|dot|DOT)")
IDNUM = re.compile(
    r"(?<![\w\-/.])(?:\d{3}([- ])\d{2}\1\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[1-49] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|\d{2} \d{3} \d{3} \d{3}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]\d{8}|[A-Z]\d{3}-\d{5}|\d{6}/\d{3,4})(?![\w\-/]|\.\d)"
)
_LABELLED_ID = re.compile(rf"{LABELS}(?: ?(?:ID|number|no\.?|n°|Nr\.?|num\.?))?(?: ?[:#] ?| )((?=[\w\-/]*\d{{4}})[A-Z0-9][A-Z0-9\-/]{{5,18}}[A-Z0-9])(?![\w\-/])")
_WEAK = re.compile(r"\d{2} \d{3} \d{3} \d{3}|\d{8}-?[A-Z]|[A-Z]\d{8}|\d{3}[- ]\d{2}[- ]\d{4}|\d{6}/\d{3,4}|[A-Z]\d{3}-\d{5}")
_EXT = r"(?:,? ?(?:ext\.?|extn\.?|x|poste|Durchwahl|DW|int\.|Apparat|app\.) ?\d{1,5})?"
PHONE = re.compile(
    r"(?<![\w+])(?<!\d[ .\-/])(?:(?:\+|00)\d{1,3}[ .\-]?\d(?:[ .\-]\d{2}){4}|(?:\+\d{1,3}[ .\-]?|00\d{2}[ .\-])(?:\(0?\d{1,5}\)[ .\-]?)?\d{2,5}(?:[ .\-]\d{3,8}){1,3}|\+\d{8,15}|\(\d{3,5}\)[ .\-]?\d{3}[ .\-]?\d{3,4}|0\d(?:([ .\-])\d{2})(?:\1\d{2}){3}|0\d{3,4} \d{3} \d{3}|0\d{2,4}[/ ]\d{4,8}(?:-\d{1,4})?|\d{3}([.\- ])\d{3}\2\d{4}|\d{3}-\d{4}(?= ?(?:ext|x)))"
    + _EXT + r"(?![\d/]|-\d)"
)
_W = r"(?:[A-ZÀ-Þ][\w’'\-]+)"
_CAPS = rf"{_W}(?: {_W}){{0,2}}"
STREETS = (  # a hint that is cheap to look for, and the expression
    (None, re.compile(rf"(?<![\w\-/.])(?:No\. ?)?\d{{1,4}}[a-z]?,? (?:{_W} ){{1,3}}(?:Street|Road|Lane|Avenue|Close|Drive|Boulevard|Terrace|Court|Crescent|Square|Gardens|Row|Way|Place|Hill|Walk|Ln|Rd|Dr|St|Ave|Blvd|Ct|Sq|Terr)(?:(?<=Ave)\.|(?<=Blvd)\.|(?<=St)\.|(?<=Rd)\.|(?<=Ln)\.|(?<=Dr)\.)?(?![\w\-])")),
    (None, re.compile(rf"(?<![\w\-/.])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|bd\.?|boulevard|place|allée|chemin|impasse|quai|cours|route|square)(?: (?:de la|de l[’']|du|des|de|d[’']))? ?{_CAPS}")),
    (re.compile(r"C/|Calle|Avenida|Avda|Av\.|Plaza|Paseo|Camino|Ronda"), re.compile(rf"(?<![\w\-/.])(?:C/|Calle|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Ronda)(?: (?:de las|de los|de la|del|de|las|los|la|el))? {_CAPS},? (?:n\.º ?|nº ?|núm\. ?)?\d{{1,4}}(?![\w\-])")),
    (re.compile(r"(?:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee|ring|ufer|damm|markt|steig|hof|Stra(?:ß|ss)e|Platz|Weg|Allee) ?\d"), re.compile(r"(?<![\w\-/.])(?:(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den) )?[A-ZÄÖÜ][\wäöüß\-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer|damm|markt|steig|hof|Straße|Platz|Weg|Allee) ?\d{1,4} ?[a-z]?(?![\w\-])")),
)

_PARTICLE = r"(?:(?:[Vv]an der|[Vv]an den|[Vv]an|[Vv]on der|[Vv]on|[Dd]e la|[Dd]e los|[Dd]el|[Dd]e|[Dd]i|[Dd]a|[Dd]u|[Ll]e) )?"
_CAP = r"(?:[OD][’'])?[A-ZÀ-ÞŁŚŠŽČ][\w]+(?:[\-’'][A-ZÀ-ÞŁŚŠŽČ]?\w+)*"
_INITIAL = r"[A-ZÀ-Þ]\."


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


_GIVEN = {v for n in FEMALE + MALE for v in (n, _plain(n), n.upper(), _plain(n).upper())}
_CAPITALISED = re.compile(r"(?<![\w\-@.’'])[A-ZÀ-Þ][^\W\d_]+(?:-[A-ZÀ-Þ][^\W\d_]+)?(?![@\d])")
_AFTER = rf"(?![\w\-’'])(?! {NOT_PERSONS}\b)"
_FAMILY = re.compile(rf"(?:[ \t]{_INITIAL})*[ \t]{_PARTICLE}{_CAP}{_AFTER}")
_BEFORE = re.compile(rf"(?<![\w\-@.’']){_PARTICLE}{_CAP},[ \t]$")
_BEHIND = re.compile(rf"(?:[ \t]{_INITIAL})*(?![\w\-’'])")
_OPEN_NAME = re.compile(rf"[ \t]*(?:(?:Dr|Prof|Frau|Herrn?|Mr|Mrs|Ms|Mme|Sra?)\.? ?)*({_INITIAL}(?: ?{_INITIAL})* ?{_PARTICLE}{_CAP}|{_PARTICLE}{_CAP}, (?:{_CAP}(?: {_INITIAL})*|{_INITIAL}(?: ?{_INITIAL})*)|{_CAP}(?: {_INITIAL})* {_PARTICLE}{_CAP}){_AFTER}")


def names(text: str) -> Iterator[tuple[int, int]]:
    """Where persons are named: around known given names, and behind titles and introducing words."""
    for m in _CAPITALISED.finditer(text):
        if m[0] in _GIVEN or "-" in m[0] and m[0].split("-")[0] in _GIVEN:
            before = _BEFORE.search(text, max(0, m.start() - 60), m.start())
            if before and before[0].rstrip(", \t") not in OPENERS and (end := _BEHIND.match(text, m.end())):
                yield before.start(), end.end()
            elif family := _FAMILY.match(text, m.end()):
                yield m.start(), family.end()
    for sign in (*INTRODUCED, *TITLES):
        at = text.find(sign)
        while at >= 0:
            end = at + len(sign)
            if not at or not text[at - 1].isalnum():
                m = _OPEN_NAME.match(text, end)
                if m:
                    yield m.start(1), m.end(1)
            at = text.find(sign, end)


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of everything personal in a text, in its order and without overlaps."""
    out: list[tuple[int, int, str]] = []

    def claim(start: int, end: int, kind: str) -> None:
        if all(end <= a or start >= b for a, b, _ in out):
            out.append((start, end, kind))

    for m in EMAIL.finditer(text) if _MAIL_HINT.search(text) else ():
        start = m.start() + (len("mailto:") if m[0].lower().startswith("mailto:") else 0)
        claim(start, m.end(), "email")
    for m in IDNUM.finditer(text):
        if not _WEAK.fullmatch(m[0]) or re.search(LABELS, text[max(0, m.start() - 60) : m.start()] + text[m.end() : m.end() + 50]):
            claim(m.start(), m.end(), "idnum")
    for m in _LABELLED_ID.finditer(text):
        claim(m.start(1), m.end(1), "idnum")
    for m in PHONE.finditer(text):
        if sum(c.isdigit() for c in m[0]) >= 7:
            claim(m.start(), m.end(), "phone")
    for hint, street in STREETS:
        if hint is None or hint.search(text):
            for m in street.finditer(text):
                claim(m.start(), m.end(), "address")
    for start, end in names(text):
        claim(start, end, "name")
    return sorted(out)


class Surrogates:
    """Keyed, type-consistent replacements."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _bits(self, *parts: object) -> int:
        return int.from_bytes(hmac.new(self.key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:8], "big")

    def _permute(self, symbols: str, alphabet: str, tweak: str) -> str:
        """A keyed permutation of all strings of this length over ``alphabet`` (a Feistel network of eight rounds)."""
        base, n = len(alphabet), len(symbols)
        if n == 1:
            return alphabet[(alphabet.index(symbols) + self._bits(tweak, "one")) % base]
        left, right = symbols[: n // 2], symbols[n // 2 :]
        number = lambda s: sum(alphabet.index(c) * base ** (len(s) - 1 - k) for k, c in enumerate(s))
        spell = lambda v, size: "".join(alphabet[v // base ** (size - 1 - k) % base] for k in range(size))
        for r in range(8):
            if r % 2:
                right = spell((number(right) + self._bits(tweak, r, left)) % base ** len(right), len(right))
            else:
                left = spell((number(left) + self._bits(tweak, r, right)) % base ** len(left), len(left))
        return left + right

    def _renumber(self, text: str, tweak: str, skip: int = 0) -> str:
        places = [k for k, c in enumerate(text) if c in "0123456789"][skip:]
        new = self._permute("".join(text[k] for k in places), "0123456789", f"{tweak}{len(places)}") if places else ""
        out = list(text)
        for k, c in zip(places, new):
            out[k] = c
        return "".join(out)

    def _family(self, entity: str, count: int) -> str:
        v = self._bits("family", entity, count)
        parts = []
        for _ in range(5):
            v, a = divmod(v, 20)
            v, b = divmod(v, 5)
            parts.append("bcdfghjklmnprstvwxyz"[a] + "aeiou"[b])
        return "".join(parts).capitalize()

    def of(self, kind: str, surface: str, count: int = 0) -> str:
        """The surrogate of an entity; ``count`` draws another one."""
        tweak = f"{kind}{count}"
        if kind == "phone":
            country = re.match(r"\+\d{1,3}(?=\D)|00\d{2}|\+\d", surface)
            return self._renumber(surface, tweak, sum(c.isdigit() for c in country[0]) if country else 0)
        if kind == "idnum":
            out = self._renumber(surface, tweak)
            return re.sub(r"[A-Z]+", lambda m: self._permute(m[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", tweak), out)
        if kind == "email":
            m = re.match(r"[\w.+\-’']+", surface)
            return f"{self._family(_plain(surface).lower(), count).lower()}{surface[m.end() :]}"
        if kind == "address":
            out = self._renumber(surface, tweak)
            words = re.findall(rf"{_W}", out)
            keep = {"Street", "Road", "Lane", "Avenue", "Close", "Drive", "Boulevard", "Terrace", "Court", "No", "Calle", "Avenida", "Plaza", "Paseo", "Am", "An", "Ln", "Rd", "Ave", "Blvd", "St", "Dr"}
            for w in words:
                end = re.search(r"(?:straße|strasse|str|weg|platz|gasse|allee)$", w)
                if w not in keep:
                    out = out.replace(w, self._family(w.lower(), count) + (end[0] if end else ""), 1)
            return out
        return self._person(surface, count)

    def _person(self, surface: str, count: int) -> str:
        """Another person's name in the same layout: gender, initials, particles and case kept."""

        def other(m: re.Match) -> str:
            w = m[0]
            given = next((side for side in (FEMALE, MALE) if _plain(w).lower() in {_plain(n).lower() for n in side}), None)
            new = given[self._bits("given", _plain(w).lower(), count) % len(given)] if given else self._family(_plain(w).lower(), count)
            return new.upper() if w.isupper() and len(w) > 1 else new

        return re.sub(rf"{_CAP}(?!\.)", other, re.sub(rf"\b([A-ZÀ-Þ])\.", lambda m: "ABCDEFGHIJKLMNOPRSTVWZ"[self._bits("initial", m[1], count) % 22] + ".", surface))

    def table(self, text: str, found: list[tuple[int, int, str]]) -> dict[tuple[str, str], str]:
        """(type, surface) -> surrogate for one text, distinct where the entities are."""
        out: dict[tuple[str, str], str] = {}
        taken: set[str] = set()
        for start, end, kind in found:
            entity = (kind, text[start:end])
            if entity in out:
                continue
            count = 0
            while (new := self.of(*entity, count)) in taken or new in text:
                count += 1
                if count > 50:
                    break
            out[entity] = new
            taken.add(new)
        return out


def replaced(text: str, found: list[tuple[int, int, str]], by: dict[tuple[str, str], str] | None = None) -> str:
    """The text with placeholders, or with the surrogates of ``by``, in the places found."""
    parts, at = [], 0
    for start, end, kind in found:
        parts += [text[at:start], by[kind, text[start:end]] if by is not None else f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def detect(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pii_type, surface), each surface of a type once for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += dict.fromkeys((i, kind, t[a:b]) for a, b, kind in find(t))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "pii_type", "surface"])

    return df.where(F.length(text) > 0).select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, pii_type string, surface string")


def redact(df: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, redacted, surrogate): every text with placeholders, and with keyed surrogates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Surrogates(key)
        for batch in batches:
            plain, fake = [], []
            for t in batch.column(1).to_pylist():
                found = find(t) if t else []
                plain.append(replaced(t, found) if found else t)
                fake.append(replaced(t, found, keyed.table(t, found)) if found else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.string()), pa.array(fake, pa.string())], names=["doc_id", "redacted", "surrogate"])

    return df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, redacted string, surrogate string")
