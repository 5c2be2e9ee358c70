"""Personal data replaced by keyed surrogates of the same type, script, gender and format.

Detected: e-mail addresses, telephone numbers, IPv4, IPv6 and MAC addresses, payment card numbers, international bank account
numbers (those whose check digits hold), social security numbers, secrets (long hexadecimal strings, keys with a known prefix)
and names of persons: a given name from a list with a surname of the same script (middle initials, particles, inner
capitals, apostrophes, hyphens and accents included; all in capitals as well), a name after a title, and then the bare given
names and surnames of those persons in the same text. Names beyond the list, street addresses, dates of birth and passport
numbers are not found; an address such as maria.schmidt@ and the name beside it get surrogates that don't show their tie.

A surrogate comes from a keyed permutation of all strings of its form, so that equal entities always get equal surrogates
(coreference, in all documents) and different entities of a form never share one (distinctness). The permutation is one
cycle, so that nothing is its own surrogate. Letters stay letters of their script, case and kind of accent, digits stay
digits, punctuation stays; card numbers keep their first digit and whether their check digit holds, telephone numbers a
valid area code, bank accounts their country and valid check digits; network addresses stay in their block (private, loopback,
multicast, public, and so on). Given names come from the list of the same script and gender; a surname has one surrogate,
whatever given name stands before it, and endings that tell the gender stay while the stem changes, so families stay
together. Letters of one language's Cyrillic stay in it.

`collisions` checks distinctness and coreference over a whole corpus by joining nothing: entities are summed by their
surrogate; `real` counts surrogates that equal an entity of the corpus. `surrogate_texts` takes the first attempt of the key
without either; if each has surrogates that are real entities (likely where a form is dense, such as telephone numbers of a
large corpus), that with the fewest: all entities are replaced, so the texts still tell all of them apart.

Null texts stay null; texts without an entity stay as they are; ids, ties, repeated rows and other columns play no part; a
column with the name of the new one is handed on as `<name>_before`. Whole texts are read and no entity is too long; an empty
table gives an empty table. Key and attempts are parameters: keep the key secret.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.base import apart, discard, kept_schema, slices, with_columns, written

# Given names by script and gender, and forms of surnames by script.
GIVEN = {
    ("latin", "f"): "Aisha Alice Ananya Anna Barbara Carmen Clara Diana Elena Emma Eva Fatima Giulia Greta Hannah Helen Ingrid Isabel Jane Julia Karen Khadija Laura Leila Linda Lucia Maria Marta Mary Mei Nina Olga Paula Priya Rosa Sakura Sara Sofia Susan Teresa Ursula Wanjiru Yuki Zainab Zeynep".split(),
    ("latin", "m"): "Abdul Ahmed Albert Amit Andrew Anton Carlos Charles Chidi Daniel David Edward Erik Felix Frank George Giovanni Hans Hassan Henry Hiroshi Hugo Ibrahim Ivan James Jean John Jorge Karl Kenji Kwame Louis Luis Mark Martin Mehmet Michael Mohammed Oliver Omar Paul Peter Rahul Raj Robert Thomas Victor Wei Yusuf".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Лариса Мария Нина Ольга Светлана Софья Татьяна".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Пётр Сергей Юрий".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
GENDER = {name: kind for kind, names in GIVEN.items() for name in names}
#: The same names in capitals, as they are written before a surname in capitals.
CAPITALS = {name.upper(): name for name in GENDER if len(name) > 2}
# Endings of surnames that tell the gender; each is kept. Letters of Russian and of Ukrainian.
ENDINGS = tuple("ский ская цкий цкая ов ова ев ева ёв ёва ин ина ын ына ová ská cká ská ski cki ska cka ską".split())
ALPHABETS = ("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя")
# Titles before a name, and particles inside one.
TITLES = set("Mr Mrs Ms Miss Dr Prof Herr Frau Sr Sra Srta Señor Señora Mme Mlle Monsieur Madame Signor Signora".split())
PARTICLES = "van von der den de la del di da dos du le bin al el".split()

#: Classes of characters that are permuted among themselves; other letters among those of their stretch of 64 code points.
CLASSES = tuple(
    "0123456789 aeiou bcdfghjklmnpqrstvwxyz AEIOU BCDFGHJKLMNPQRSTVWXYZ"
    " àáâãäåæèéêëìíîïòóôõöøùúûüāăąēęěīįōőœūůűų çćčďđğķłļñńņňŕřśşšťţźžż"
    " ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜĀĂĄĒĘĚĪĮŌŐŒŪŮŰŲ ÇĆČĎĐĞĶŁĻÑŃŅŇŔŘŚŞŠŤŢŹŽŻ"
    " аеёиіїоуыэєюя бвгґджзйклмнпрстфхцчшщ АЕЁИІЇОУЫЭЄЮЯ БВГҐДЖЗЙКЛМНПРСТФХЦЧШЩ"
    " αεηιουω βγδζθκλμνξπρστφχψ άέήίόύώ ΑΕΗΙΟΥΩ ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ ΆΈΉΊΌΎΏ".split()
)
CLASS_OF = {c: k for k in CLASSES for c in k}
HEX = {False: "0123456789abcdef", True: "0123456789ABCDEF"}


@lru_cache(1 << 16)
def class_of(c: str) -> str:
    """The characters that may stand for a character; "" where only itself may."""
    if c in CLASS_OF or not c.isalpha():
        return CLASS_OF.get(c, "")
    first, kind = ord(c) & ~63, unicodedata.category(c)
    return "".join(x for x in map(chr, range(first, first + 64)) if unicodedata.category(x) == kind and x not in CLASS_OF)


def alphabet(word: str) -> str:
    """The Cyrillic letters of the language that a word's own letters are of: Ukrainian with a letter of its own, else Russian; "" of
    words in other scripts."""
    low = word.lower()
    if not any("\u0400" <= c <= "\u04ff" for c in low):
        return ""
    return ALPHABETS[any(c in ALPHABETS[1] and c not in ALPHABETS[0] for c in low)]


def parted(surname: str) -> tuple[str, str]:
    """(stem, ending) of a surname; no ending where it has none that tells the gender, or hardly a stem."""
    for ending in sorted(ENDINGS, key=len, reverse=True):
        if surname.endswith(ending) and len(surname) - len(ending) >= 2:
            return surname[: -len(ending)], ending
    return surname, ""


@lru_cache(1 << 14)
def script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0].lower()


#: Where numbers may be: led by one class of characters, so that other text is passed over quickly.
NUMERIC = re.compile(r"[0-9+(][0-9().+\- ]{6,}")
NUMBERS = re.compile(
    r"(?<![\w.+])(?:(?P<ip>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?![\w]|\.\d)"
    r"|(?P<card>\d{13,19}|\d{4}([ -])\d{4}\3\d{4}\3\d{4}|3\d{3}([ -])\d{6}\4\d{5})(?!\w)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<phone>(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+[2-9]\d{0,2}(?:[ .-]?\d{2,4}){2,5})(?!\w))"
)
#: Addresses with colons, led by hexadecimal digits or a colon; accounts of banks, led by a country.
COLONS = re.compile(r"(?<![\w:.])(?:(?P<mac>[0-9A-Fa-f]{2}(?P<sep>[:-])(?:[0-9A-Fa-f]{2}(?P=sep)){4}[0-9A-Fa-f]{2})|(?P<ipv6>(?:[0-9A-Fa-f]{1,4})?(?::[0-9A-Fa-f]{0,4}){2,7}))(?![\w:]|\.\d)")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
# Blocks of IPv4 and IPv6 addresses that serve one purpose.
BLOCKS = tuple(map(ipaddress.ip_network, "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 224.0.0.0/4 240.0.0.0/4 fc00::/7 fe80::/10 ff00::/8 2000::/3".split()))
EMAIL_RIGHT = re.compile(r"@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")
SECRET = re.compile(r"(?<![0-9A-Za-z])(?:(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,}|(?:AKIA|ghp_|sk-|sk_live_|xox[bp]-)[0-9A-Za-z_-]{16,})(?![0-9A-Za-z])")
LONG = re.compile(r"[0-9A-Za-z_-]{20,}")
#: A capitalised word before a space, to be looked up; what may stand between a given name and a surname; a surname.
CAPITAL = re.compile(r"[A-ZА-ЯΑ-ΩΆ-Ώ][^\W\d_]+(?=\.?[ \t\n])")
SHOUTED = re.compile(r"[ \t\n]((?:[^\W\d_a-zà-ÿ]['’-]?)+[^\W\d_a-zà-ÿ])(?!\w)")
BETWEEN = re.compile(rf"[ \t\n](?:[^\W\d_]\.[ \t\n])?(?:(?:{'|'.join(PARTICLES)})[ \t\n])*")
SURNAME = re.compile(r"[^\W\d_](?:['’-]?[^\W\d_])+(?!\w)")
TYPES = ("email", "phone", "ip", "card", "ssn", "secret", "person", "ipv6", "mac", "iban")
#: Kinds of spans that count as persons.
PERSONS = ("person", "surname", "given")


def surname_end(text: str, at: int, of_script: str | None) -> int | None:
    """Where a surname that begins at a place ends; None if there is none."""
    m = SURNAME.match(text, at)
    if not m or not text[at].isupper():
        return None
    word = m[0][:-2] if m[0].endswith(("'s", "’s")) else m[0]
    letters = [c for c in word if c.isalpha()]
    wanted = of_script or script(letters[0])
    return at + len(word) if len(letters) > 1 and any(map(str.islower, letters)) and all(script(c) == wanted for c in letters) else None


def persons(text: str) -> list[tuple[int, int, str]]:
    """Full names and names after titles, then the bare names of those persons wherever they stand in the text."""
    spans, bare = [], {}
    for near in CAPITAL.finditer(text):
        word, start, end = near[0], near.start(), near.end()
        if word in GENDER:
            between = BETWEEN.match(text, end)
            stop = surname_end(text, between.end(), GENDER[word][0]) if between else None
            if stop and not text[start - 1 : start].isalnum():
                spans.append((start, stop, "person"))
                bare.setdefault(word, "given")
                bare[text[between.end() : stop]] = "surname"
        elif word in CAPITALS and not text[start - 1 : start].isalnum():
            loud = SHOUTED.match(text, end)
            if loud and loud[1].isupper() and all(script(c) == GENDER[CAPITALS[word]][0] for c in loud[1] if c.isalpha()):
                spans.append((start, loud.end(), "person"))
        elif word in TITLES and not text[start - 1 : start].isalnum():
            at = end + 1 + (text[end] == ".")
            stop = surname_end(text, at, None)
            if stop:
                bare[text[at:stop]] = "given" if text[at:stop] in GENDER else "surname"
    if bare:
        names = "|".join(map(re.escape, sorted(bare, key=len, reverse=True)))
        spans += [(m.start(), m.end(), bare[m[0]]) for m in re.finditer(rf"(?<!\w)(?:{names})(?!\w)", text)]
    return spans


def unmasked(text: str) -> ipaddress.IPv6Address | None:
    """The address that a text is; None for what only looks like one, and for the addresses of no host and of the host itself."""
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return address if int(address) > 1 else None


def account_remainder(text: str) -> int:
    """Of a bank account number by 97, its first four characters put last: 1 where the check digits hold."""
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def found(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order, apart from each other; earlier and longer ones first."""
    if not text:
        return []
    spans = []
    at, floor = text.find("@"), 0
    while at >= 0:
        right = EMAIL_RIGHT.match(text, at)
        if right:
            start = at
            while start > floor and (text[start - 1].isalnum() or text[start - 1] in "._+%-"):
                start -= 1
            while start < at and text[start] in ".+%-":
                start += 1
            if start < at:
                spans.append((start, right.end(), "email"))
        floor = at + 1
        at = text.find("@", floor)
    for near in NUMERIC.finditer(text):
        spans += [(m.start(), m.end(), m.lastgroup) for m in NUMBERS.finditer(text, near.start(), near.end() + 1)]
    if ":" in text or "-" in text:
        for m in COLONS.finditer(text):
            if m.lastgroup == "sep" or m["mac"] or unmasked(m["ipv6"]):
                spans.append((m.start(), m.end(), "mac" if m["mac"] else "ipv6"))
    spans += [(m.start(), m.end(), "iban") for m in IBAN.finditer(text) if account_remainder(m[0]) == 1]
    for near in LONG.finditer(text):
        spans += [(m.start(), m.end(), "secret") for m in SECRET.finditer(text, near.start(), near.end() + 1)]
    spans += persons(text)
    out, end = [], 0
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if s[0] >= end:
            out.append(s)
            end = s[1]
    return out


class Surrogates:
    """The keyed permutations. One attempt of a key is one function of entities."""

    def __init__(self, key: bytes, attempt: int = 0):
        self.key = hmac.digest(key, b"attempt %d" % attempt, "sha256")
        self.person = lru_cache(1 << 16)(self._person)
        self.formed = lru_cache(1 << 16)(self._formed)

    def permuted(self, x: int, size: int, tweak: bytes) -> int:
        """A permutation of range(size) of one cycle: the next number in an order that the key and the tweak deal."""
        return self._dealt((self._dealt(x, size, tweak, (0, 1, 2, 3)) + 1) % size, size, tweak, (3, 2, 1, 0))

    def _dealt(self, x: int, size: int, tweak: bytes, rounds: tuple[int, ...]) -> int:
        """Feistel rounds over enough bits, walked until the value is in range; in reverse order they undo themselves."""
        bits = max(2, (size - 1).bit_length())
        low = bits // 2
        high = bits - low
        a_mask, b_mask = (1 << high) - 1, (1 << low) - 1
        while True:
            a, b = x >> low, x & b_mask
            for r in rounds:
                if r % 2:
                    b ^= self._draw(tweak, r, a, low) & b_mask
                else:
                    a ^= self._draw(tweak, r, b, high) & a_mask
            x = a << low | b
            if x < size:
                return x

    def _draw(self, tweak: bytes, r: int, x: int, bits: int) -> int:
        seed = tweak + bytes([r]) + x.to_bytes(96, "little")
        return int.from_bytes(hashlib.blake2b(seed, key=self.key, digest_size=64).digest() * (bits // 512 + 1), "little")

    def _formed(self, text: str, kind: str, chars: str | None = None, classed: bool = False) -> str:
        """A string of the same form: each character of its class (or of `chars`; if `classed`, those of its class that are in chars),
        the others as they are."""
        if len(text) > 96:  # bounded pieces, each under the one before
            head, tail = text[:96], text[96:]
            return self.formed(head, kind, chars, classed) + self.formed(tail, kind + hashlib.sha256(head.encode()).hexdigest()[:16], chars, classed)
        if classed:
            which = ["".join(x for x in class_of(c) if not chars or x.lower() in chars) for c in text]
            which = [k if c in k else "" for c, k in zip(text, which, strict=True)]
        else:
            which = [class_of(c) if chars is None else chars if c in chars else "" for c in text]
        form = "".join(k[0] if k else c for c, k in zip(text, which, strict=True))
        x, size = 0, 1
        for c, k in zip(text, which, strict=True):
            if k:
                x, size = x * len(k) + k.index(c), size * len(k)
        x = self.permuted(x, size, hashlib.sha256(f"{kind}:{form}".encode()).digest()) if size > 1 else x
        out = []
        for c, k in zip(reversed(text), reversed(which), strict=True):
            if k:
                x, i = divmod(x, len(k))
                c = k[i]
            out.append(c)
        return "".join(reversed(out))

    def digits(self, text: str, kind: str, ok=lambda d: True) -> str:
        """Other digits that pass `ok`, for digits that pass it: walked inside the set of those that do."""
        out = self.formed(text, kind, CLASSES[0])
        while not ok(out):
            out = self.formed(out, kind, CLASSES[0])
        return out

    @staticmethod
    def refilled(text: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in text)

    def card(self, text: str) -> str:
        d = [int(c) for c in text if c.isdigit()]
        offset = (d[-1] - check_digit(d[:-1])) % 10
        body = [d[0], *map(int, self.formed("".join(map(str, d[1:-1])), f"card{d[0]}", CLASSES[0]))]
        return self.refilled(text, "".join(map(str, [*body, (check_digit(body) + offset) % 10])))

    def phone(self, text: str) -> str:
        d = "".join(c for c in text if c.isdigit())
        local = not text.startswith("+") or d.startswith("1")
        head, rest = (d[:-10], d[-10:]) if local else (d[:2], d[2:])
        fits = (lambda x: (x[0] in "01") == (rest[0] in "01")) if local else (lambda x: True)
        return self.refilled(text, head + self.digits(rest, "phone" if local else "phone" + head, fits))

    def placed(self, address: ipaddress.IPv4Address | ipaddress.IPv6Address) -> int:
        """Another address of the same block: all bits behind the block's, or, outside all blocks, walked among those outside."""
        x, bits = int(address), address.max_prefixlen
        mine = [b for b in BLOCKS if b.version == address.version]
        for b in mine:
            if address in b:
                low, size = int(b.network_address), b.num_addresses
                return low + self.permuted(x - low, size, f"ip {b}".encode())
        ends = [(int(b.network_address), int(b.broadcast_address)) for b in mine]
        x = self.permuted(x, 1 << bits, b"ip")
        while any(low <= x <= high for low, high in ends) or x < 2:
            x = self.permuted(x, 1 << bits, b"ip")
        return x

    def ip(self, text: str) -> str:
        x = int.from_bytes(bytes(map(int, text.split("."))), "big")
        return str(ipaddress.IPv4Address(self.placed(ipaddress.IPv4Address(x))))

    def ipv6(self, text: str) -> str:
        made = ipaddress.IPv6Address(self.placed(ipaddress.IPv6Address(text)))
        out = made.compressed if "::" in text else ":".join(f"{int(g, 16):x}" for g in made.exploded.split(":"))
        return out.upper() if text.upper() == text and text.lower() != text else out

    def mac(self, text: str) -> str:
        """The bits that say whether an address is of one card or many, and who has given it out, stay."""
        x = int(text.replace(text[2], ""), 16)
        kind = x >> 40 & 3
        rest = self.permuted((x >> 42) << 40 | x & ((1 << 40) - 1), 1 << 46, b"mac %d" % kind)
        x = (rest >> 40) << 42 | kind << 40 | rest & ((1 << 40) - 1)
        out = text[2].join(f"{x:012x}"[i : i + 2] for i in range(0, 12, 2))
        return out.upper() if text.upper() == text and text.lower() != text else out

    def iban(self, text: str) -> str:
        plain = text.replace(" ", "")
        body = self.formed(plain[4:], f"iban {plain[:2]}")
        check = 98 - account_remainder(f"{plain[:2]}00{body}")
        it = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in text)

    def email(self, text: str) -> str:
        low = text.lower()
        name, _, top = low.rpartition(".")
        made = f"{self.formed(name, 'email.' + top)}.{top}"
        if len(low) != len(text):
            return made
        return "".join(m.upper() if t.isupper() else m for t, m in zip(text, made, strict=True))

    def _person(self, text: str) -> str:
        parts = re.split(r"([ \t\n]+)", text)
        if parts[0] in CAPITALS:
            return self.given(CAPITALS[parts[0]]).upper() + "".join(parts[1:-1]) + self.surname(parts[-1])
        middle = "".join(self.formed(p, "initial") if p.endswith(".") else p for p in parts[1:-1])
        return self.given(parts[0]) + middle + self.surname(parts[-1])

    def given(self, name: str) -> str:
        names = GIVEN[GENDER[name]]
        return names[self.permuted(names.index(name), len(names), " ".join(GENDER[name]).encode())]

    def surname(self, name: str) -> str:
        """The stem in letters of its own language, under the ending; walked until it reads as a stem and an ending of the same kind."""
        stem, ending = parted(name)
        letters = alphabet(stem)
        new = self.formed(stem, "surname" + letters[:4], letters or None, True)
        while parted(new + ending) != (new, ending) or alphabet(new) != letters:
            new = self.formed(new, "surname" + letters[:4], letters or None, True)
        return new + ending

    def of(self, entity: str, kind: str) -> str:
        if kind == "ssn":
            return self.digits(entity, kind, lambda d: (d[0] == "9") == (entity[0] == "9"))
        return getattr(self, kind)(entity)

    def secret(self, entity: str) -> str:
        head = re.match("AKIA|ghp_|sk-|sk_live_|xox[bp]-|", entity)[0]
        if head:
            return head + self.formed(entity[len(head) :], f"secret {head}")
        mixed = entity.lower() != entity and entity.upper() != entity
        return self.formed(entity, "secret", HEX[False] + "ABCDEF" if mixed else HEX[entity.lower() != entity])


def check_digit(digits: list[int]) -> int:
    """The digit that completes a number under the Luhn rule."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def canonical(entity: str, kind: str) -> str:
    """What two mentions of one entity have in common."""
    if kind in ("email", "mac"):
        return entity.lower().replace("-", ":") if kind == "mac" else entity.lower()
    if kind == "ipv6":
        return ipaddress.IPv6Address(entity).compressed
    if kind == "iban":
        return entity.replace(" ", "")
    if kind in ("card", "phone"):
        d = "".join(c for c in entity if c.isdigit())
        if kind == "phone":
            return d[-10:] if not entity.startswith("+") or d.startswith("1") else f"+{d}"
        return d
    return " ".join(entity.split()) if kind == "person" else entity


def replaced(text: str | None, made: Surrogates) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (start, end, type, surrogate) of what was replaced, in places of the old text."""
    spans = [(s, e, kind, made.of(text[s:e], kind)) for s, e, kind in found(text)]
    if not spans:
        return text, spans
    parts, end = [], 0
    for s, e, _, new in spans:
        parts += [text[end:s], new]
        end = e
    return "".join([*parts, text[end:]]), [(s, e, "person" if kind in PERSONS else kind, new) for s, e, kind, new in spans]


def mentions(df: DataFrame, text: str = "text") -> DataFrame:
    """(type, entity, n): the distinct entities of all texts as they are written, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, text):
                tally = Counter((kind, t[s:e]) for t in texts for s, e, kind in found(t))
                rows = list(zip(*tally.keys(), strict=True)) if tally else [(), ()]
                yield pa.RecordBatch.from_arrays([*[pa.array(r, pa.string()) for r in rows], pa.array(list(tally.values()), pa.int64())], names=["type", "entity", "n"])

    listed = df.select(text).mapInArrow(run, "type string, entity string, n bigint")
    return listed.groupBy("type", "entity").agg(F.sum("n").alias("n"))


def surrogates(mentioned: DataFrame, key: bytes, attempt: int = 0) -> DataFrame:
    """(type, entity, surrogate, n) of mentions, in canonical form. Bare names are types of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key, attempt)
        for batch in batches:
            kinds, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new = [canonical(made.of(e, k), k) for e, k in zip(raw, kinds, strict=True)]
            old = [canonical(e, k) for e, k in zip(raw, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(old, pa.string()), pa.array(new, pa.string()), batch.column(2)], names=["type", "entity", "surrogate", "n"])

    listed = mentioned.select("type", "entity", "n").mapInArrow(run, "type string, entity string, surrogate string, n bigint")
    return listed.groupBy("type", "entity", "surrogate").agg(F.sum("n").alias("n"))


def entities(df: DataFrame, key: bytes, text: str = "text", attempt: int = 0) -> DataFrame:
    """(type, entity, surrogate, n): the distinct entities of all texts in canonical form, with their mentions."""
    return surrogates(mentions(df, text), key, attempt)


def collisions(listed: DataFrame) -> DataFrame:
    """Surrogates that more than one entity has, or entities with more than one surrogate: none if all is well."""
    shared = listed.groupBy("type", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("type", F.col("surrogate").alias("value"), F.lit("shared").alias("what"))
    torn = listed.groupBy("type", "entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("type", F.col("entity").alias("value"), F.lit("torn").alias("what"))
    return shared.unionByName(torn)


def real(listed: DataFrame) -> DataFrame:
    """(type, value): surrogates that are an entity of the corpus too, their own or another."""
    side = lambda c, old: listed.select("type", F.col(c).alias("value"), F.lit(old).alias("old"))
    both = side("entity", True).unionByName(side("surrogate", False)).groupBy("type", "value").agg(F.max("old").alias("old"), F.min("old").alias("all_old"))
    return both.where("old AND NOT all_old").select("type", "value")


def settled_attempt(mentioned: DataFrame, key: bytes, attempts: int) -> int:
    """The first attempt of the key without collisions and real surrogates, else that with the fewest of the latter."""
    best = None
    for attempt in range(attempts):
        listed = written(surrogates(mentioned, key, attempt))
        if collisions(listed).isEmpty():
            n = real(listed).count()
            best = min(best or (n, attempt), (n, attempt))
        discard(listed)
        if best and not best[0]:
            break
    if best is None:
        raise ValueError("surrogates collide under every attempt of this key")
    return best[1]


def surrogate_texts(df: DataFrame, key: bytes, text: str = "text", keep: list[str] | None = None, spans: str | None = "entities", attempts: int = 4) -> DataFrame:
    """The columns `keep` (all by default) with `text` replaced and, unless it is None, a column of what was replaced.

    The corpus's entities are checked first, see `settled_attempt`; if all `attempts` collide, ValueError.
    """
    names = apart(df.columns, [spans] if spans else [])
    df, keep, text = df.withColumnsRenamed(names), [names[c] for c in (df.columns if keep is None else keep)], names[text]
    mentioned = written(mentions(df, text))
    attempt = settled_attempt(mentioned, key, attempts)
    discard(mentioned)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key, attempt)
        for batch in batches:
            for part, texts in slices(batch, text):
                done = [replaced(t, made) for t in texts]
                more = {text: pa.array([d[0] for d in done], pa.string())}
                if spans:
                    more[spans] = pa.array([[dict(zip(("start", "end", "type", "surrogate"), s, strict=True)) for s in d[1]] for d in done], kind)
                out = with_columns(part, [c for c in keep if c != text], **more)
                yield out.select([*keep, *([spans] if spans else [])])

    columns = [*keep, *([text] if text not in keep else [])]
    schema = kept_schema(df, columns, *([(spans, "array<struct<start:int,end:int,type:string,surrogate:string>>")] if spans else []))
    return df.select(*columns).mapInArrow(run, schema)
