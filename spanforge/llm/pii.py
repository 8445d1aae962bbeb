"""Personal data: detection and keyed surrogates of the same kind and format.

Detected are secrets, keys, e-mail and IP addresses, account, card, social-security and telephone numbers, dates of
birth, street addresses and names of persons. A name is found by its form - a title, a cue such as "my name is", or a
known given name, followed by capitalised words, particles and initials - and its parts are then found wherever
else they stand in the document, so that "Dr. Anna Petrov", "Petrov" and "Anna" stay one person.

A surrogate is a keyed permutation of the entity's own domain: strings of the same shape (digits stay
digits, letters stay letters of the same case and script), numbers with the same check-digit state,
addresses of the same class, known given names of the same gender and script, known surnames. A permutation can't map two
entities to one surrogate and needs no table of entities, so distinctness and coreference hold over any
number of documents without a shuffle; mentions that differ only in separators or case are one entity.
The permutation is  P^-1(P(x) + 1)  for a keyed Feistel permutation P: one cycle through the domain, so
no entity is its own surrogate. Subsets of a domain (names outside the known lists, public addresses) are
kept by walking the cycle until it is back in the subset; they are most of their domains. checked() looks over a whole
table whether any surrogate stands for two entities or any entity has two surrogates, and fails if so.

The key is a secret: whoever has it can undo the surrogates. session_key() takes it from the session's setting
`spanforge.pii.key`, or draws one at random for the session.

Edge cases: null text stays null and has no entities; overlapping detections go to the earlier, then the
longer one; equal starts and lengths to the kind that is listed first; repeated rows get equal results; extra
columns are kept by pseudonymise(); an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from functools import cache, lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import aliased, parts, restored, stored

# Given names by (script, gender), surnames by script, titles by gender, words that stand before a name.
GIVEN = {
    ("latin", "f"): "Aisha Alice Amelia Anna Camille Carmen Charlotte Chloe Clara Elena Elizabeth Emily Emma Eva Fatima Giulia Hannah Ingrid Isabel Jane Jennifer Jessica Julia Karen Katarzyna Laura Leila Linda Lucia Margaret Maria Marie Mary Mei Nina Olivia Patricia Priya Sarah Sofia Susan Yuki".split(),
    ("latin", "m"): "Ahmed Andrew Anthony Antonio Carlos Charles Chen Daniel David Diego Edward Felix Francisco George Giovanni Hans Henry Hiroshi Jack James John Jorge Joseph Klaus Louis Luis Michael Mohammed Omar Paul Peter Pierre Rahul Richard Robert Stefan Thomas Wei William".split(),
    ("cyrillic", "f"): "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Андрей Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
SURNAMES = {
    "latin": "Anderson Bauer Becker Bernard Brown Clark Davis Dubois Durand Evans Fischer Garcia Gonzalez Hall Harris Hoffmann Jackson Johnson Jones Keller Lambert Lewis Lopez Martin Martinez Meyer Miller Moore Moreau Müller Nguyen Novak Patel Petit Richter Rodriguez Rossi Sanchez Schmidt Schneider Schulz Smith Taylor Thompson Wagner Walker Weber White Williams Wilson Wright Young".split(),
    "cyrillic": "Васильев Волков Иванов Козлов Кузнецов Лебедев Морозов Новиков Петров Попов Смирнов Соколов".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Mme Madame Mlle Sra Señora".split(), "m": "Mr Herr Monsieur Sr Señor Sir".split(), "": "Dr Prof Professor Doctor".split()}
CUES = ("my name is", "name:", "signed by", "signed,", "sincerely,", "regards,", "dear", "author:", "contact:", "ich heiße", "mein name ist", "je m'appelle", "me llamo", "mi nombre es")
PARTICLES = "van von der den de del della di la le bin ibn al el".split()
#: Endings of surnames that carry the gender; the longest one that leaves three letters stays.
ENDINGS = ("ская", "ский", "ова", "ева", "ина", "ová", "ova", "eva", "ska", "ski")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_UP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
_NAME = rf"(?:(?:O'|Mc|Mac|D')?[{_UP}][{_LOW}]+(?:['’-][{_UP}]?[{_LOW}]+)*)"
_SURNAME = rf"(?:(?:(?:{'|'.join(PARTICLES)})[ ]){{0,2}}{_NAME})"
_FULL = rf"(?:{_NAME}|[{_UP}]\.)(?:[ ][{_UP}]\.)?(?:[ ]{_SURNAME}){{0,2}}"
_GIVEN = "|".join(sorted((x for v in GIVEN.values() for x in v), key=len, reverse=True))
_TITLE = "|".join(sorted((x for v in TITLES.values() for x in v), key=len, reverse=True))
_CUE = "|".join(re.escape(x) for x in sorted(CUES, key=len, reverse=True))
_GROUP = "[0-9A-Fa-f]{1,4}"
_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"

_digit = re.compile("[0-9]").search


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for x in [*(x for v in TITLES.values() for x in v), *(x for v in GIVEN.values() for x in v)]:
        found.add_word(x, len(x))
    found.make_automaton()
    return found


def _names(text: str) -> bool:
    """Whether a title or given name stands in the text as a word."""
    for end, n in _automaton().iter(text):
        if not text[end - n : end - n + 1].isalnum() and not text[end + 1 : end + 2].isalnum() or end + 1 == n and not text[end + 1 : end + 2].isalnum():
            return True
    return False


def _any(*words: str):
    """Whether any of some lower-case strings stands in a text, given in lower case too."""
    return lambda t, low, digit: any(w in low for w in words)


def _both(*tests):
    return lambda t, low, digit: all(x(t, low, digit) for x in tests)


_digits = lambda t, low, digit: digit
_born = _both(_digits, _any("born", "birth", "dob", "geb", "né", "nacid"))
_street = _both(_digits, _any(" street", " st", " ave", " road", " rd", " boulevard", " blvd", " lane", " drive", "straße", "strasse", "str.", "rue ", "calle ", "allee ", "platz "))

#: kind -> (cheap test that a text - as it is, in lower case, whether it has a digit - must pass, pattern); group 1, if any, is the entity. Order breaks ties.
PATTERNS = {
    "secret": (_any("=", ":"), re.compile(r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)\b)[\"']?\s{0,4}[=:]\s{0,4}[\"']?([^\s\"'<>,;]{6,})")),
    "hex_secret": (_digits, re.compile(r"(?<![0-9A-Za-z])(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,128}(?![0-9A-Za-z])")),
    "aws_key": (lambda t, low, digit: "AKIA" in t or "ASIA" in t, re.compile(r"(?<![0-9A-Za-z])A[KS]IA([0-9A-Z]{16})(?![0-9A-Za-z])")),
    "email": (_any("@"), re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")),
    "ipv4": (_digits, re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)")),
    "ipv6": (lambda t, low, digit: "::" in t or t.count(":") >= 7, re.compile(rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{{3,4}}:|(?:{_GROUP}:){{7}})(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}}|(?:{_GROUP}:){{2,7}}:)(?![0-9A-Za-z:.])")),
    "iban": (_digits, re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d\d(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
    "card": (_digits, re.compile(r"(?<![\d.,+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d]|[.,-]\d)")),
    "ssn": (_digits, re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    "ssn_plain": (_both(_digits, _any("ssn", "social security")), re.compile(r"(?i:\bssn|social security(?: number| no\.?)?)[^\d\n]{0,12}(\d{9}|\d{3} \d{2} \d{4})(?!\d)")),
    "phone": (_digits, re.compile(r"(?<![\d.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|\(0\d{2,4}\)[ /-]?\d{3,4}[ -]?\d{3,5}|0[1-9]\d{1,3}[ /-]\d{3,4}[ -]?\d{3,5})(?!\d|[.-]\d)")),
    "birth_date": (_born, re.compile(rf"(?i:\b(?:born(?: on)?|date of birth|birth ?date|dob|geboren am|geburtsdatum|née? le|nacid[oa] el)\b)[: ]{{1,3}}(\d{{4}}-\d\d-\d\d|\d\d[./]\d\d[./]\d{{4}}|\d{{1,2}} (?:{_MONTH}) \d{{4}}|(?:{_MONTH}) \d{{1,2}}, \d{{4}})(?!\d)")),
    "address": (_street, re.compile(rf"(?<![\w.,-])(\d{{1,5}} (?:{_NAME} ){{1,2}}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Drive)\b|{_NAME}(?:straße|strasse|str\.|allee|platz) \d{{1,4}}[a-z]?\b|\d{{1,4}},? rue (?:de |du |des )?{_NAME}|[Cc]alle (?:de )?{_NAME},? \d{{1,4}}\b)")),
    "name": (lambda t, low, digit: _names(t), re.compile(rf"\b(?:(?:{_TITLE})\.?[ ]((?:{_TITLE}\.?[ ])?{_FULL})|((?:{_GIVEN})(?:[ ][{_UP}]\.)?[ ]{_SURNAME}))(?!\w)")),
    "cued_name": (_any(*CUES), re.compile(rf"(?i:\b(?:{_CUE}))[ \n]{{1,2}}({_NAME}(?:[ ][{_UP}]\.)?[ ]{_SURNAME})(?!\w)")),
}
#: Kinds that are handled as another one.
SAME = {"ssn_plain": "ssn", "cued_name": "name"}


class Entity(NamedTuple):
    kind: str
    start: int
    end: int
    text: str


def _plausible(kind: str, text: str) -> bool:
    """What a pattern can't tell: card numbers have an issuer's first digit and a right check digit, account numbers a right
    checksum, national telephone numbers nine digits at least. Other long numbers are left alone."""
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        return digits[0] in "23456" and luhn(digits[:-1]) == int(digits[-1])
    if kind == "iban":
        flat = text.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    return kind != "phone" or text[0] not in "(0" or len(re.sub(r"\D", "", text)) >= 9


def _spans(text: str):
    low, digit = text.lower(), _digit(text) is not None
    for rank, (kind, (hint, pattern)) in enumerate(PATTERNS.items()):
        if hint(text, low, digit):
            for m in pattern.finditer(text):
                g = next((i for i in range(1, (m.re.groups or 0) + 1) if m[i] is not None and kind != "card"), 0)
                if not _plausible(kind, m[g]):
                    continue
                yield m.start(g), -m.end(g), rank, SAME.get(kind, kind), m[g]


def detect(text: str | None) -> list[Entity]:
    """Entities that don't overlap, in order."""
    if not text:
        return []
    found = list(_spans(text))
    people = {w for *_, kind, s in found if kind == "name" for w in _WORD.findall(s) if len(w) > 2 and w[0].isupper() and w not in _TITLES}
    if people:  # the parts of a person's name, wherever else they stand
        again = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(people, key=len, reverse=True))) + r")(?!\w)")
        found += [(m.start(), -m.end(), len(PATTERNS), "name", m[0]) for m in again.finditer(text)]
    out, at = [], 0
    for start, end, _, kind, s in sorted(found):
        if start >= at:
            out.append(Entity(kind, start, -end, s))
            at = -end
    return out


_WORD = re.compile(rf"[{_UP}{_LOW}]+")
_TITLES = {x for v in TITLES.values() for x in v}


# ---- permutations -----------------------------------------------------------------------------------


def _rounds(key: bytes, tweak: str, half: int, x: int, back: bool) -> int:
    mask, size = (1 << half) - 1, (half + 7) // 8
    a, b = x >> half, x & mask
    for i in range(7, -1, -1) if back else range(8):
        if back:
            a, b = b, a
        f = int.from_bytes(hashlib.shake_256(b"%d|%d|%s|%s|%d" % (i, half, key, tweak.encode(), b)).digest(size + 8), "big") & mask
        a ^= f
        if not back:
            a, b = b, a
    return a << half | b


def _feistel(key: bytes, tweak: str, m: int, x: int, back: bool = False) -> int:
    half = max(1, ((m - 1).bit_length() + 1) // 2)
    while True:
        x = _rounds(key, tweak, half, x, back)
        if x < m:
            return x


def shift(key: bytes, tweak: str, m: int, x: int) -> int:
    """One step along a keyed cycle through 0..m-1."""
    return 0 if m < 2 else _feistel(key, tweak, m, (_feistel(key, tweak, m, x) + 1) % m, back=True)


DIGITS = "0123456789"
#: Country codes of two digits; 1 and 7 have one, all others three.
COUNTRIES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Letters that stand for each other, upper and lower case.
LETTERS = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя"]
VOWELS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщъь"]
HEX = "0123456789abcdef"


def _classes(groups: list[str]) -> dict[str, str]:
    return {c: g for g in [DIGITS, *groups, *(g.upper() for g in groups)] for c in g}


_SHAPE, _SPOKEN = _classes(LETTERS), _classes(VOWELS)


def encipher(key: bytes, kind: str, s: str, classes: dict[str, str] = _SHAPE, fixed: int = 0, ok=None) -> str:
    """Permute the strings of the shape of s: each character stays in its class, those without one and
    the first `fixed` ones stay as they are. ok: the subset of results (which holds s) that may be reached."""
    where = [i for i, c in enumerate(s) if c in classes and i >= fixed]
    shape = "".join(classes[c][0] if c in classes and i >= fixed else c for i, c in enumerate(s))
    m = x = 0
    m = 1
    for i in where:
        group = classes[s[i]]
        x, m = x * len(group) + group.index(s[i]), m * len(group)
    if m < 2 or ok is not None and not ok(s):
        return s
    while True:
        x = shift(key, f"{kind}|{shape}", m, x)
        out, rest = list(s), x
        for i in reversed(where):
            group = classes[s[i]]
            rest, d = divmod(rest, len(group))
            out[i] = group[d]
        if ok is None or ok("".join(out)):
            return "".join(out)


def luhn(digits: str) -> int:
    """Check digit of a number without one."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


#: Address blocks that stay apart, by their first bits; the last entry that holds an address decides.
BLOCKS = [(0, 0, "public"), (0, 8, "this network"), (10 << 24, 8, "private"), (127 << 24, 8, "loopback"), (0xA9FE0000, 16, "link"), (0xAC100000, 12, "private"), (0xC0A80000, 16, "private"), (0xE0000000, 3, "special")]


def _block(x: int) -> tuple[int, int, str]:
    return next(b for b in reversed(BLOCKS) if b[1] == 0 or x >> 32 - b[1] == b[0] >> 32 - b[1])


def _ipv4(key: bytes, text: str) -> str:
    x = int.from_bytes(bytes(map(int, text.split("."))), "big")
    base, bits, _ = block = _block(x)
    size = 1 << 32 - bits
    x -= base
    while True:  # only the public addresses, six in seven of all, have others among them
        x = shift(key, f"ipv4|{base}|{bits}", size, x)
        if _block(base + x) == block:
            return ".".join(map(str, (base + x).to_bytes(4, "big")))


def _ipv6(key: bytes, text: str) -> str:
    """The groups that are written are permuted with their lengths; the first one, which tells the kind of address, stays."""
    at = text.index(":")
    digits = "".join(c for c in text[at:].lower() if c != ":")
    new = iter(encipher(key, "ipv6" + text[:at].lower() + "".join("x" if c != ":" else c for c in text[at:]), digits, {c: HEX for c in HEX}))
    return text[:at] + "".join(c if c == ":" else next(new).upper() if c.isupper() else next(new) for c in text[at:])


_EPOCH = datetime.date(1900, 1, 1)
_DAYS = (datetime.date(2030, 1, 1) - _EPOCH).days
_MONTHS = _MONTH.split("|")


def _day(text: str) -> tuple[int | None, bool]:
    """Days since 1900 of a date, None if it is none between 1900 and 2029, and whether its month stands first."""
    numbers = list(map(int, re.findall(r"\d+", text)))
    month = next((i + 1 for i, m in enumerate(_MONTHS) if m.lower() in text.lower()), None)
    if text[:4].isdigit():
        y, m, d = numbers
    elif month:
        (d, y), m = numbers, month
    else:
        d, m, y = numbers
    swapped = m > 12 >= d and "/" in text
    if swapped:
        d, m = m, d
    try:
        x = (datetime.date(y, m, d) - _EPOCH).days
    except ValueError:
        return None, swapped
    return (x if 0 <= x < _DAYS else None), swapped


def _date(key: bytes, text: str) -> str:
    """Another day between 1900 and 2029, written alike; what is no such day stays none."""
    x, swapped = _day(text)
    if x is None:
        return encipher(key, "no_date", text, dict.fromkeys(DIGITS, DIGITS), ok=lambda z: _day(z)[0] is None)
    new = _EPOCH + datetime.timedelta(shift(key, "birth_date", _DAYS, x))
    if text[:4].isdigit():
        return new.isoformat()
    if not text[2:3] or text[2] not in "./":
        name = _MONTHS[new.month - 1]
        return f"{name} {new.day}, {new.year}" if text[0].isalpha() else f"{new.day} {name} {new.year}"
    a, b = (new.month, new.day) if swapped else (new.day, new.month)
    return f"{a:02}{text[2]}{b:02}{text[2]}{new.year}"


@cache
def _known() -> dict[str, tuple[str, list[str]]]:
    """Known name -> (its pool's name, its pool). A name of two pools belongs to the first."""
    pools = {"given|" + "|".join(k): v for k, v in GIVEN.items()} | {"surname|" + k: v for k, v in SURNAMES.items()}
    out: dict[str, tuple[str, list[str]]] = {}
    taken: set[str] = set()
    for name, pool in pools.items():
        own = [x for x in pool if x not in taken]
        taken |= set(own)
        out |= {x: (name, own) for x in own}
    return out


def country_digits(digits: str) -> int:
    """Length of the country code that an international number begins with. No code is the start of another, so
    a number and its surrogate have the same one, however they are written."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in COUNTRIES else 3


def _refill(template: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in template)


def _name_token(key: bytes, token: str) -> str:
    known = _known().get(token)
    if known:
        name, pool = known
        return pool[shift(key, name, len(pool), pool.index(token))]
    keep = next((e for e in ENDINGS if token.endswith(e) and len(token) >= len(e) + 3), token[-1:] if len(token) > 3 else "")
    head = token[: len(token) - len(keep)]
    return encipher(key, "name" + keep, head, _SPOKEN, ok=lambda x: x + keep not in _known() and x + keep not in _TITLES) + keep


@lru_cache(65536)
def _cased(key: bytes, kind: str, lower: str) -> str:
    return encipher(key, kind, lower)


@lru_cache(65536)
def _person(key: bytes, text: str) -> str:
    """Each word of a name by itself, so that any part of it has the same surrogate wherever it stands; titles, particles
    and initials stay."""
    word = lambda m: m[0] if m[0] in _TITLES or m[0] in PARTICLES or len(m[0]) < 2 else _name_token(key, m[0])
    return _WORD.sub(word, text)


_STREET = re.compile(rf"(?<![{_LOW}{_UP}'’-])(?!(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Drive|Calle)\b)[{_UP}][{_LOW}]+?(?=straße|strasse|str\.|allee|platz|[^{_LOW}]|$)")


def surrogate(kind: str, text: str, key: bytes) -> str:
    """The surrogate of one entity."""
    if kind in ("phone", "ssn"):
        digits = "".join(c for c in text if c.isdigit())
        lead = min(country_digits(digits), len(digits) - 1) if text.startswith("+") else int(kind == "phone" and digits[0] == "0")
        same = None if lead or kind == "ssn" else lambda x: x[0] != "0"  # a number with a leading zero stays one, and no other becomes one
        return _refill(text, encipher(key, f"{kind}{len(digits)}", digits, fixed=lead, ok=same))
    if kind == "card":
        digits = "".join(c for c in text if c.isdigit())
        body = encipher(key, f"card{len(digits)}", digits[:-1], fixed=1)
        return _refill(text, body + str((luhn(body) + int(digits[-1]) - luhn(digits[:-1])) % 10))
    if kind == "ipv4":
        return _ipv4(key, text)
    if kind == "ipv6":
        return _ipv6(key, text)
    if kind == "birth_date":
        return _date(key, text)
    if kind == "address":  # the number, and the words that aren't common to all addresses
        return re.sub(r"\d+", lambda m: encipher(key, f"number{len(m[0])}", m[0]), _STREET.sub(lambda m: _name_token(key, m[0]), text))
    if kind == "email":
        local, _, domain = text.rpartition("@")
        labels = domain.lower().split(".")
        names = ".".join([*(_cased(key, f"domain{i}", x) for i, x in enumerate(labels[:-1])), labels[-1]])
        new = _cased(key, "local", local.lower())
        return "".join(c.upper() if o.isupper() else c for c, o in zip(new, local)) + "@" + "".join(c.upper() if o.isupper() else c for c, o in zip(names, domain))
    if kind == "name":
        return _person(key, text)
    if kind == "iban":
        flat = text.replace(" ", "")
        body = encipher(key, "iban" + flat[:2], flat[4:])
        value = int("".join(str(int(c, 36)) for c in body + flat[:2] + "00"))
        old = int("".join(str(int(c, 36)) for c in flat[4:] + flat[:2] + "00"))
        check = (98 - value % 97 + int(flat[2:4]) - (98 - old % 97)) % 97 if 2 <= int(flat[2:4]) <= 98 else int(flat[2:4])
        it = iter(flat[:2] + f"{check + 97 if check < 2 and check + 97 <= 98 else check:02d}" + body)
        return "".join(c if c == " " else next(it) for c in text)
    if len(text) >= 8 and all(c in HEX for c in text):
        return encipher(key, "hex", text, {c: HEX for c in HEX})
    return encipher(key, kind, text)


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[Entity, str]]]:
    """The text with surrogates, and what was replaced by what."""
    found = [(e, surrogate(e.kind, e.text, key)) for e in detect(text)]
    if not found:
        return text, []
    out, at = [], 0
    for e, s in found:
        out += [text[at : e.start], s]
        at = e.end
    return "".join([*out, text[at:]]), found


_ENTITIES = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string()), ("entity", pa.string())]))
_ENTITIES_SQL = "array<struct<kind: string, start: bigint, end: bigint, surrogate: string, entity: string>>"


def plain(kind: str, text: str) -> str:
    """What mentions of one entity have in common: no separators (a leading plus is none), for email and IPv6 no case."""
    if kind == "phone":
        return re.sub(r"(?!^\+)\D", "", text)
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", text)
    return text.replace(" ", "") if kind == "iban" else text.lower() if kind in ("email", "ipv6") else text


def digest(kind: str, text: str, key: bytes) -> str:
    """A keyed name of an entity, the same for all its mentions."""
    return hashlib.blake2b(f"{kind}|{plain(kind, text)}".encode(), key=hashlib.sha256(key).digest(), digest_size=16).hexdigest()


def pseudonymise(docs: DataFrame, key: bytes, entities: str | None = None) -> DataFrame:
    """docs with surrogates in text; with `entities`, a column of that name lists kind, place in the
    original text (code points), surrogate, and a keyed digest of the entity."""
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        for b in parts(batches):
            texts, lists = [], []
            for t in b.column("text").to_pylist():
                new, found = replace(t, key)
                texts.append(new)
                lists.append([{"kind": e.kind, "start": e.start, "end": e.end, "surrogate": s, "entity": digest(e.kind, e.text, key)} for e, s in found] if entities else None)
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(lists, _ENTITIES)] if entities else [])], names=[*columns, *([entities] if entities else [])])

    return docs.mapInArrow(run, schema + (f", `{entities}` {_ENTITIES_SQL}" if entities else ""))


def _plain(kind: Column, text: Column) -> Column:
    """plain() of columns."""
    return (
        F.when(kind == "phone", F.regexp_replace(text, r"(?!^\+)[^0-9]", "")).when(kind.isin("card", "ssn"), F.regexp_replace(text, "[^0-9]", ""))
        .when(kind == "iban", F.replace(text, F.lit(" "), F.lit(""))).when(kind.isin("email", "ipv6"), F.lower(text)).otherwise(text)
    )


def _pairs(rows: DataFrame, entities: str) -> DataFrame:
    """Distinct (kind, surrogate, entity); partial aggregation keeps an entity of a million mentions small."""
    each = rows.select(F.explode(entities).alias("e")).select("e.kind", "e.surrogate", "e.entity").distinct()
    return each.select("kind", _plain(F.col("kind"), F.col("surrogate")).alias("surrogate"), "entity").distinct()


def collisions(rows: DataFrame, entities: str = "entities") -> DataFrame:
    """(kind, surrogate, n) of surrogates that stand for more than one entity, in rows of pseudonymise() with entities."""
    return _pairs(rows, entities).groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


def splits(rows: DataFrame, entities: str = "entities") -> DataFrame:
    """(kind, entity, n) of entities, by their digests, with more than one surrogate."""
    return _pairs(rows, entities).groupBy("kind", "entity").agg(F.count("*").alias("n")).where("n > 1")


def checked(docs: DataFrame, key: bytes, entities: str = "entities") -> DataFrame:
    """pseudonymise() over the whole table, once that no surrogate stands for two entities and no entity has two."""
    rows = stored(pseudonymise(docs, key, entities))
    bad = collisions(rows, entities).select("kind").union(splits(rows, entities).select("kind")).groupBy("kind").count().collect()  # a row per kind
    if bad:
        raise ValueError("surrogates that aren't one to one: " + ", ".join(f"{r['count']} of kind {r['kind']}" for r in bad))
    return rows


def session_key(spark: SparkSession) -> bytes:
    """The session's secret: its setting `spanforge.pii.key`, else 32 random bytes that stay for the session."""
    found = spark.conf.get("spanforge.pii.key", None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set("spanforge.pii.key", found)
    return found.encode()


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows of docs, columns as given, with surrogates in text; checked."""
    own = aliased(docs, "text")
    return restored(checked(own, key, "found"), own, docs)


def op2(docs: DataFrame, key: bytes) -> DataFrame:
    out = checked(docs.select("doc_id", "text"), key)
    return out.select("doc_id", "text", F.size("entities").cast("bigint").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("entities.kind")), ",").alias("kinds"), "entities")
