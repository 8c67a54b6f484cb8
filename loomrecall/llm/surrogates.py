"""Keyed surrogates for personal entities: of the same kind, script, gender, case and format as the original.

An entity is cut into pieces: words of a name, the local part and the labels of an email, the digits of a phone number, a paper number,
the words of an address. Each piece has a normal form, its part, so that other spellings of an entity share it; the surrogate of a part is
drawn by HMAC from a secret key, the part and the number of the attempt. What gives an entity its form stays: titles, particles, encoded
and spelled-out signs, top-level domains, country codes, trunk zeros, extension words, street types, separators and case. Bank account
numbers keep their country and get right check digits, card numbers a right last digit. Initials follow one keyed permutation of the
alphabet, with which surrogates of names begin too, so that an initial still fits its name.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from functools import lru_cache
from urllib.parse import unquote

import regex

from loomrecall.llm.words import FEMALE, MALE

PARTICLES = frozenset("van von der den de della del di da dos du le la el al bin ibn ter ten af av vom zu los".split())
_TITLES = frozenset("mr mrs ms miss mx dr prof herr hr frau fr monsieur madame mme mlle señor señora sr sra signor signora don doña sir lady mister".split())
_STREET_WORDS = frozenset(
    "street avenue lane road drive close mews rise court square terrace place crescent gardens grove boulevard parkway alley quay embankment highway walk wharf row hill gate green park way view rue chemin impasse calle avenida plaza paseo camino via viale piazza corso largo praça rua straße strasse str weg allee platz gasse ring ufer damm po p o box postfach apartado correos boîte postale b casella postbus postboks no nr flat apt apartment unit suite wohnung stock etage og of the de la los las le les des du del dei della do dos da el il l d c".split()
)
_STREET_END = re.compile(r"(?i)(straße|strasse|weg|allee|platz|gasse|ring|ufer|damm|gatan|vägen|gränd|vej|gade|veien|straat|laan|gracht|plein)$")
#: The same words in Chinese addresses.
_HAN_STREET = frozenset("省市区县路街道巷号镇村室楼")
_AT = re.compile(r"(?i)\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s|%40|&#64;|&#x40;|&commat;|\\u0040|[@＠﹫]")
_DOT = re.compile(r"(?i)\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s|%2E|&#46;|\.")
_EXTENSION = re.compile(r"(?i)\s?(?:ext\.?|x|#|durchwahl|poste|extension)\s?(\d{1,6})$")
#: Alphabets as (vowels, consonants): Latin, Cyrillic, Greek.
_ALPHABETS = (("aeiou", "bcdfghjklmnpqrstvwxyz"), ("аеиоу", "бвгдзклмнпрст"), ("αεηιο", "βγδκλμνπρστ"))
_SOFT = ("bdfgklmnprstvz", "бвгдзклмнпрст", "βγδκλμνπρστ")
_SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗"
_GIVEN_HAN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超霞平刚桂英华玉兰红建文清云"


class Draws:
    """Numbers drawn from a key, a part and an attempt."""

    def __init__(self, key: str, part: str, attempt: int):
        self.key, self.seed, self.n, self.bits = key.encode(), f"{attempt}|{part}", 0, 0

    def take(self, n: int) -> int:
        if self.bits < 1 << 32:
            self.bits = int.from_bytes(hmac.new(self.key, f"{self.n}|{self.seed}".encode(), hashlib.sha512).digest(), "big")
            self.n += 1
        self.bits, r = divmod(self.bits, n)
        return r


def _script(c: str) -> int:
    return 1 if "Ѐ" <= c <= "ӿ" else 2 if "Ͱ" <= c <= "Ͽ" else 0


@lru_cache(maxsize=64)
def _letters(key: str, script: int) -> dict[str, str]:
    """A keyed permutation of an alphabet without fixed points of its own making: a rotation of a keyed order."""
    own = sorted("".join(_ALPHABETS[script]), key=lambda c: hmac.new(key.encode(), f"letter|{c}".encode(), hashlib.sha256).digest())
    return dict(zip(own, [*own[1:], own[0]], strict=True))


def initial(letter: str, key: str) -> str:
    """The letter that stands for an initial, and with which the surrogates of names with it begin."""
    low = regex.sub(r"\p{M}", "", unicodedata.normalize("NFD", letter.lower()))[:1] or "x"
    new = _letters(key, _script(low)).get(low, "k")
    return new.upper() if letter.isupper() else new


def _word(value: str, draws: Draws, first: str, size: int) -> str:
    script = _script(value[0])
    vowels, soft = _ALPHABETS[script][0], _SOFT[script]
    out = first or soft[draws.take(len(soft))]
    while len(out) < size:
        turn = soft if out[-1] in vowels else vowels
        out += turn[draws.take(len(turn))]
    return out


def _han(value: str, draws: Draws) -> str:
    return _SURNAMES[draws.take(len(_SURNAMES))] + "".join(_GIVEN_HAN[draws.take(len(_GIVEN_HAN))] for _ in range(max(1, len(value) - 1)))


def _alike(value: str, draws: Draws, keep: int = 0) -> str:
    """Characters of the same class in place of all but the first ``keep``: digits, vowels, consonants; the first digit does not become or stop being 0."""
    out = []
    for i, c in enumerate(value):
        low = c.lower()
        if i < keep or not c.isalnum():
            out.append(c)
        elif c.isdigit():
            out.append(c if c == "0" and i == keep else str(1 + draws.take(9)) if i == keep else str(draws.take(10)))
        else:
            vowels, rest = _ALPHABETS[_script(low)]
            pool = vowels if low in vowels else rest
            new = pool[draws.take(len(pool))]
            out.append(new.upper() if c.isupper() else new)
    return "".join(out)


def _country(digits: str) -> int:
    """Digits of the country code at the start of an international number (the public numbering plan)."""
    if digits[:1] in ("1", "7"):
        return 1
    two = {20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, *range(51, 59), *range(60, 67), 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98}
    return 2 if digits[:2].isdigit() and int(digits[:2]) in two else 3


def _mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def _paper(value: str, draws: Draws) -> str:
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", value) and _mod97(value) == 1:
        new = _alike(value[4:], draws)
        return f"{value[:2]}{98 - _mod97(value[:2] + '00' + new):02d}{new}"
    if re.fullmatch(r"\d{13,19}", value) and luhn(value):
        new = _alike(value[:-1], draws, 1)
        return next(new + c for c in "0123456789" if luhn(new + c))
    return _alike(value, draws)


def draw(part: str, key: str, attempt: int) -> str:
    """The surrogate of a part for the n-th attempt. Attempts from the third on may lengthen what would else run out of forms."""
    kind, _, value = part.partition(":")
    draws = Draws(key, part, attempt)
    more = "".join(_SOFT[0][draws.take(14)] for _ in range(attempt // 3))
    if kind == "name" or kind == "street":
        if regex.match(r"\p{Han}", value):
            return _han(value, draws) + "".join(_GIVEN_HAN[draws.take(len(_GIVEN_HAN))] for _ in more)
        script = _script(value[0])
        size = max(4, min(len(value), 12)) + attempt // 3
        end = ("a", "а", "α")[script] if value in FEMALE else ("o", "о", "ο")[script] if value in MALE else ""
        stem = _word(value, draws, initial(value[0], key) if kind == "name" else "", size - 1 if end else size)
        return (stem[:-1] if end and stem[-1] in _ALPHABETS[script][0] else stem) + end
    if kind == "phone":
        plus = value.startswith("+")
        digits = value.lstrip("+")
        keep = _country(digits) if plus else len(digits) - len(digits.lstrip("0"))
        return "+" * plus + _alike(digits, draws, keep)
    if kind == "id_number":
        return _paper(value, draws)
    if kind == "mark":
        return f"[{value.partition('|')[0].upper()}_{draws.take(1 << 30) | 1 << 30:08x}]"
    return _alike(value, draws) + more


def pieces(kind: str, value: str) -> list[tuple[int, int, str, str]]:
    """(start, end, mode, part) of what is replaced in an entity. Mode ``part`` takes the part's surrogate, ``initial`` and ``digits`` are drawn in place."""
    out: list[tuple[int, int, str, str]] = []
    if kind == "name":
        for m in regex.finditer(r"\p{Han}+|[\p{L}\p{M}]+", value):
            low = m.group().lower()
            if len(low) == 1 and not regex.match(r"\p{Han}", low):
                out.append((*m.span(), "initial", low))
            elif low not in _TITLES and (low not in PARTICLES or m.group()[0].isupper() and m.start() == 0):
                out.append((*m.span(), "part", f"name:{low}"))
    elif kind == "email":
        begin = len("mailto:") if value.startswith("mailto:") else 0
        at = _AT.search(value, begin)
        if at:
            out.append((begin, at.start(), "part", f"local:{unquote(value[begin : at.start()]).lower()}"))
            a = at.end()
            for dot in _DOT.finditer(value, a):
                out.append((a, dot.start(), "part", f"label:{value[a : dot.start()].lower()}"))
                a = dot.end()
    elif kind == "phone":
        ext = _EXTENSION.search(value)
        end = ext.start() if ext else len(value)
        main = value[:end].replace("(0)", "")
        digits = re.sub(r"\D", "", main)
        abroad = main.lstrip("(").startswith(("+", "00"))
        part = f"phone:{'+' if abroad else ''}{digits[2:] if abroad and not main.lstrip('(').startswith('+') else digits}"
        out.append((0, end, "part", part))
        if ext:
            out.append((*ext.span(1), "digits", part))
    elif kind == "id_number":
        out.append((0, len(value), "part", f"id_number:{re.sub(r'[^0-9A-Za-z]', '', value).upper()}"))
    else:
        whole = "address:" + " ".join(re.findall(r"\w+", value.lower()))
        for m in regex.finditer(r"\p{Han}|[^\W\d_]+|\d+", value):
            low = m.group().lower()
            if m.group().isdigit():
                out.append((*m.span(), "digits", whole))
            elif regex.match(r"\p{Han}", low):
                if low not in _HAN_STREET:
                    out.append((*m.span(), "part", f"street:{low}"))
            elif len(low) > 1 and low not in _STREET_WORDS:
                tail = _STREET_END.search(low)
                end = m.end() - len(tail.group()) if tail and tail.start() > 1 else m.end()
                out.append((m.start(), end, "part", f"street:{value[m.start() : end].lower()}"))
    return [p for p in out if p[1] > p[0] and not p[3].endswith(":")]


def parts_of(kind: str, value: str) -> list[str]:
    """The parts of an entity, so that mentions in another spelling share them."""
    return [p for *_, mode, p in pieces(kind, value) if mode == "part"]


def mark_of(kind: str, value: str) -> str:
    """The one part of an entity that becomes a typed placeholder."""
    return f"mark:{kind}|" + "|".join(parts_of(kind, value) or [value.lower()])


def _case(like: str, new: str) -> str:
    if len(like) > 1 and like.isupper():
        return new.upper()
    return new[:1].upper() + new[1:] if like[:1].isupper() else new


def _pour(raw: str, new: str) -> str:
    """``new``'s letters and digits in place of those of ``raw``; escapes, separators, a bracketed trunk zero and an international prefix stay."""
    skip = len(raw) - len(raw.lstrip("("))
    head = raw[: skip + 2] if raw[skip:].startswith("00") and new.startswith("+") else ""
    chars = iter(c for c in new if c.isalnum())
    out = [head]
    for tok in re.findall(r"\(0\)|%[0-9A-Fa-f]{2}|&#?\w+;|.", raw[len(head) :], re.S):
        c = next(chars, "") if len(tok) == 1 and tok.isalnum() else None
        out.append(tok if c is None else c.upper() if tok.isupper() else c)
    return "".join([*out, *chars])


def rewrite(kind: str, value: str, key: str, surrogate) -> str:
    """The entity with ``surrogate(part)`` in place of its parts; titles, particles, separators and case stay."""
    out, last = [], 0
    for a, b, mode, part in pieces(kind, value):
        raw = value[a:b]
        if mode == "initial":
            new = initial(raw, key)
        elif mode == "digits":
            new = _alike(raw, Draws(key, f"{part}|{a}", 0))
            if new == raw:
                new = _alike(raw, Draws(key, f"{part}|{a}", 1))
        elif kind in ("name", "address"):
            new = _case(raw, surrogate(part))
        else:
            new = _pour(raw, surrogate(part))
        out += [value[last:a], new]
        last = b
    return "".join([*out, value[last:]])
