"""Reading numbers, units and intervals of measurements."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

# Spellings of unit parts. Cyrillic first, then words, then symbols.
CYRILLIC_PARTS = {
    "мккат": "ukat", "мкмоль": "umol", "ммоль": "mmol", "нмоль": "nmol", "пмоль": "pmol", "моль": "mol",
    "мкме": "uiu", "мме": "miu", "ме": "iu", "ед": "u", "тыс": "10^3", "млн": "10^6", "кл": "cells",
    "мкг": "ug", "мг": "mg", "нг": "ng", "пг": "pg", "кг": "kg", "г": "g",
    "дл": "dl", "мкл": "ul", "мл": "ml", "л": "l",
}
WORD_PARTS = {
    "grams": "g", "gram": "g", "gm": "g", "mcg": "ug", "mcl": "ul", "units": "u", "unit": "u", "percent": "%", "pct": "%", "процент": "%",
    "millimol": "mmol", "micromol": "umol", "nanomol": "nmol", "picomol": "pmol", "litre": "l", "liter": "l", "microliter": "ul", "microlitre": "ul",
    "deciliter": "dl", "decilitre": "dl", "milliliter": "ml", "millilitre": "ml", "mm3": "ul", "cmm": "ul", "gpt": "10^9", "tpt": "10^12", "k": "10^3",
}
PREFIX = {"": 1.0, "k": 1e3, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "d": 1e-1}
MOLAR = {"mm": 1e-3, "um": 1e-6, "nm": 1e-9, "pm": 1e-12}
BASES = ("mol", "kat", "iu", "g", "u")
SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")
NUMBER = r"\d+(?:[  ]\d{3})*(?:[.,]\d+)?"
VALUE = re.compile(rf"^\s*([<>≤≥]=?)?\s*([-−+]?{NUMBER})\s*(.*?)\s*$", re.S)
INTERVAL = re.compile(rf"^\s*({NUMBER})\s*(?:-|–|—|to|до|bis|\.\.)\s*({NUMBER})\s*(.*?)\s*$", re.S | re.I)


def _number(text: str) -> float:
    return float(re.sub(r"[  \s]", "", text).replace("−", "-").replace(",", "."))


def read_value(raw: str | None) -> tuple[float | None, str | None]:
    """Number and trailing unit text of a value as written; ``(None, None)`` if none."""
    m = VALUE.match(raw.replace(" ", " ")) if raw else None
    return (_number(m[2]), m[3] or None) if m else (None, None)


def read_interval(raw: str | None) -> tuple[float | None, float | None, str | None]:
    """Lower and upper bound and unit text of a reference interval."""
    m = INTERVAL.match(raw.replace(" ", " ")) if raw else None
    return (_number(m[1]), _number(m[2]), m[3] or None) if m else (None, None, None)


def _amount(part: str) -> tuple[str, float] | None:
    """Dimension and size of a numerator such as ``mg``, ``10^9`` or ``cells``."""
    part = part.replace("cells", "").replace("cell", "")
    power = re.fullmatch(r"(?:x|×)?10[\^*](\d+)", part)
    if power:
        return "count", 10.0 ** int(power[1])
    if part in ("", "1"):
        return "count", 1.0
    for base in BASES:
        if part.endswith(base) and part[: -len(base)] in PREFIX:
            return {"iu": "u"}.get(base, base), PREFIX[part[: -len(base)]]
    return None


def _volume(part: str) -> float | None:
    m = re.fullmatch(r"(\d+)?(k|m|u|n|d)?l", part)
    return float(m[1] or 1) * PREFIX[m[2] or ""] if m else None


@lru_cache(maxsize=100_000)
def read_unit(text: str | None) -> tuple[str, float] | None:
    """Dimension and size per litre of a unit however spelled.

    Dimensions: ``g``, ``mol``, ``u``, ``kat``, ``count`` (all per litre) and
    ``part`` (a fraction of one). ``None`` for no or an unreadable unit.
    """
    if not text or len(text) > 60:
        return None
    s = re.sub(r"10([⁰¹²³⁴⁵⁶⁷⁸⁹]+)", lambda m: "10^" + m[1].translate(SUPERSCRIPTS), text)
    s = unicodedata.normalize("NFKC", s).casefold().replace("μ", "u").replace("µ", "u").replace("−", "-").strip(" .;,[]()")
    s = re.sub(r"\s*(?:[·*]|\s)\s*(d?m?u?l)\s*-\s*1\b", r"/\1", s)
    s = re.sub(r"\bper\b", "/", s)
    s = re.sub(r"[а-яё]+", lambda m: CYRILLIC_PARTS.get(m[0], m[0]), s)
    s = re.sub(r"[a-z]+\d?", lambda m: WORD_PARTS.get(m[0], m[0]), s)
    s = re.sub(r"\s+", "", s)
    if s == "%":
        return "part", 0.01
    if s in MOLAR:
        return "mol", MOLAR[s]
    if s.endswith("%"):
        s = s[:-1] + "/100ml"
    if s.count("/") != 1:
        return None
    above, below = s.split("/")
    volume = _volume(below)
    if volume is None:
        return None
    same = _volume(above)
    if same is not None:
        return "part", same / volume
    amount = _amount(above)
    return (amount[0], amount[1] / volume) if amount else None


def factor(unit: tuple[str, float] | None, common: tuple[str, float] | None, molar_mass: float | None) -> float | None:
    """What a number in ``unit`` is multiplied by to stand in ``common``."""
    if unit is None or common is None:
        return None
    (a, x), (b, y) = unit, common
    if a == b:
        return x / y
    if (a, b) == ("mol", "g") and molar_mass:
        return x * molar_mass / y
    if (a, b) == ("g", "mol") and molar_mass:
        return x / molar_mass / y
    if (a, b) == ("kat", "u"):
        return x * 6e7 / y
    if (a, b) == ("u", "kat"):
        return x / 6e7 / y
    return None


def changes(f: float | None) -> bool:
    """Whether a factor changes numbers."""
    return f is not None and abs(math.log(f)) > 1e-6
