"""Numbers with units: a grammar for quantity texts, and units as scale, offset and a vector of dimension exponents.

    text     := [prefix] number [unit]  |  [unit] number
    number   := [sign] digits ["." digits]        sign := "-" | "+" | "M" (minus)
    unit     := factor { ("*" | "·" | "/" | " per " | " an " | " pro " | "每") factor }
    factor   := [SI prefix] symbol [exponent]     exponent := ["^"] [sign] digits | "²" | "³"

A unit's value in base units is number * scale + offset. Two units are convertible when their vectors are equal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

DIMENSIONS = ("length", "mass", "time", "temperature")


@dataclass(frozen=True)
class Unit:
    scale: float
    vector: tuple[int, ...]
    offset: float = 0.0

    def __mul__(self, other: Unit) -> Unit:
        return Unit(self.scale * other.scale, tuple(a + b for a, b in zip(self.vector, other.vector)))

    def __pow__(self, n: int) -> Unit:
        return Unit(self.scale**n, tuple(a * n for a in self.vector))


def _u(scale: float, length: int = 0, mass: int = 0, time: int = 0, temperature: int = 0, offset: float = 0.0) -> Unit:
    return Unit(scale, (length, mass, time, temperature), offset)


# Base symbols and the named units of weather reports.
MERCURY = 133.322387415  # Pa per mm of mercury
SYMBOLS = {
    "m": _u(1, length=1),
    "g": _u(0.001, mass=1),
    "s": _u(1, time=1),
    "min": _u(60, time=1),
    "h": _u(3600, time=1),
    "K": _u(1, temperature=1),
    "°C": _u(1, temperature=1, offset=273.15),
    "°F": _u(5 / 9, temperature=1, offset=459.67 * 5 / 9),
    "Pa": _u(1, -1, 1, -2),
    "bar": _u(100_000, -1, 1, -2),
    "b": _u(100_000, -1, 1, -2),  # as in mb
    "N": _u(1, 1, 1, -2),
    "kt": _u(float(Fraction(1852, 3600)), length=1, time=-1),
    "mmHg": _u(MERCURY, -1, 1, -2),
    "inHg": _u(MERCURY * 25.4, -1, 1, -2),
    "ft": _u(0.3048, length=1),
    "in": _u(0.0254, length=1),
    "nm": _u(1852, length=1),
}
PREFIXES = {"k": 1e3, "h": 1e2, "d": 1e-1, "c": 1e-2, "m": 1e-3, "M": 1e6}
# Words and signs for the above, lower case, in the languages of the notes and remarks.
WORDS = {
    "mps": "m/s",
    "m/s": "m/s",
    "ms-1": "m/s",
    "metres per second": "m/s",
    "meters per second": "m/s",
    "meter pro sekunde": "m/s",
    "米每秒": "m/s",
    "kmh": "km/h",
    "kph": "km/h",
    "km/h": "km/h",
    "kilometres an hour": "km/h",
    "kilometers an hour": "km/h",
    "kilometres per hour": "km/h",
    "kilometer pro stunde": "km/h",
    "公里每小时": "km/h",
    "kt": "kt",
    "kts": "kt",
    "kn": "kt",
    "knot": "kt",
    "knots": "kt",
    "knoten": "kt",
    "节": "kt",
    "海里每小时": "kt",
    "hpa": "hPa",
    "mb": "mb",
    "mbar": "mbar",
    "q": "hPa",
    "qnh": "hPa",
    "hectopascal": "hPa",
    "hectopascals": "hPa",
    "hektopascal": "hPa",
    "百帕": "hPa",
    "qnh tenths": "0.1 hPa",
    "tenths": "0.1 hPa",
    "kpa": "kPa",
    "kilopascal": "kPa",
    "kilopascals": "kPa",
    "千帕": "kPa",
    "mmhg": "mmHg",
    "mm of mercury": "mmHg",
    "millimetres of mercury": "mmHg",
    "毫米汞柱": "mmHg",
    "a": "inHg",
    "ins": "inHg",
    "in": "inHg",
    "inhg": "inHg",
    "inches of mercury": "inHg",
    "zoll quecksilbersäule": "inHg",
    "英寸汞柱": "inHg",
}
_FACTOR = re.compile(r"\s*(°[CF]|[A-Za-z]+)\s*(?:\^?\s*([-+]?\d+)|([²³]))?\s*")
_TEXT = re.compile(r"^\s*(?P<before>[^\d+\-.]*?)\s*(?P<sign>[-+M]?)(?P<number>\d+(?:[.,]\d+)?)\s*(?P<after>.*?)\s*$", re.DOTALL)
_LATIN = re.compile(r"[a-zäöüß/]")


def _symbol(text: str) -> Unit | None:
    if text in SYMBOLS:
        return SYMBOLS[text]
    scale, rest = PREFIXES.get(text[:1]), SYMBOLS.get(text[1:])
    return Unit(scale * rest.scale, rest.vector) if scale and rest and not rest.offset else None


@lru_cache(10_000)
def parse_unit(text: str | None) -> Unit | None:
    """The unit that a text names, or None."""
    if not text or not text.strip():
        return None
    known = WORDS.get(text.strip().lower())
    if known and known != text.strip():
        return parse_unit(known)
    lead = re.match(r"^\s*(\d+(?:\.\d+)?)\s+(.+)$", text)
    if lead and (unit := parse_unit(lead[2])):
        return Unit(unit.scale * float(lead[1]), unit.vector)
    at, sign, out = 0, 1, None
    text = re.sub(r"\s+(?:per|an|pro)\s+|每", "/", text.strip())
    while at < len(text):
        m = _FACTOR.match(text, at)
        if not m or not (unit := _symbol(m[1])):
            return None
        power = int(m[2]) if m[2] else {"²": 2, "³": 3}.get(m[3], 1)
        if unit.offset and out is None and m.end() == len(text) and power == 1:
            return unit
        part = unit ** (sign * power)
        out = part if out is None else out * part
        at = m.end()
        if at < len(text):
            if text[at] not in "*·/":
                return None
            sign = -1 if text[at] == "/" else 1
            at += 1
            if at == len(text):
                return None
    return out


@lru_cache(10_000)
def parse_quantity(text: str | None) -> tuple[float | None, Unit | None]:
    """(number, unit named with it) of a text such as `08KT`, `Q1013`, `29.90 inHg`; (None, None) if it has no number."""
    m = _TEXT.match(text or "")
    if not m:
        return None, None
    number = float(m["number"].replace(",", "."))
    unit = parse_unit(m["after"]) if m["after"] else parse_unit(m["before"])
    return (-number if m["sign"] in ("-", "M") and m["sign"] else number), unit


@lru_cache(10_000)
def units_in_text(text: str | None) -> tuple[Unit, ...]:
    """All units that a free text names, in order; the longest word wins, and a Latin word must stand alone. Words of one
    letter are too common in free text to count."""
    low = (text or "").lower()
    found: list[tuple[int, int, Unit]] = []
    for word in sorted(WORDS, key=len, reverse=True):
        if len(word) == 1 and word.isascii() or word in ("in", "ins", "qnh"):
            continue
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            bounded = not word.isascii() or not (at and _LATIN.match(low[at - 1]) or end < len(low) and _LATIN.match(low[end]))
            if bounded and not any(a < end and at < b for a, b, _ in found):
                found.append((at, end, parse_unit(word)))
            at = low.find(word, at + 1)
    return tuple(u for _, _, u in sorted(found, key=lambda x: x[:2]) if u)


SPEED = _u(1, length=1, time=-1)
PRESSURE = _u(1, -1, 1, -2)
METRES_PER_SECOND = SPEED
HECTOPASCAL = Unit(100.0, PRESSURE.vector)


def unit_of_kind(units: tuple[Unit, ...], kind: Unit) -> Unit | None:
    """The first unit with the dimensions of kind."""
    return next((u for u in units if u.vector == kind.vector), None)


def convert(number: float, unit: Unit, to: Unit) -> float:
    if unit.vector != to.vector:
        raise ValueError(f"dimensions differ: {unit.vector} and {to.vector}")
    return (number * unit.scale + unit.offset - to.offset) / to.scale
