"""Reading one written date or moment, exhaustively: every grammar is tried."""

from __future__ import annotations

import re
import unicodedata
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names by their shortest telling beginning, per month.
MONTHS = (
    ("jan", "янв", "січ"), ("feb", "fév", "фев", "лют"), ("mar", "mär", "maer", "mrz", "мар", "берез"),
    ("apr", "avr", "апр", "квіт"), ("may", "mai", "май", "мая", "трав"), ("jun", "juin", "июн", "черв"),
    ("jul", "juil", "июл", "лип"), ("aug", "aoû", "авг", "серп"), ("sep", "сен", "верес"),
    ("oct", "okt", "окт", "жовт"), ("nov", "ноя", "листоп"), ("dec", "dez", "déc", "дек", "груд"),
)
# Zone abbreviations and their minutes east of UTC.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "jst": 540, "ist": 330, "kst": 540,
}
WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*|пн|вт|ср|чт|пт|сб|вс|нд)\.?,?\s+"
CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,]\d+)?)?(?:\s*(?P<ap>[ap])\.?m\.?)?(?:\s*uhr)?"
ZONE = r"(?:\s*(?P<z>z|(?:utc|gmt)?\s*[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5})|\s*\((?P<zp>[a-z]{1,5})\))?"
LINK = r"(?:t|\s*,?\s+(?:at|um|о|об|в|в\s+|à)\s+|,\s*|\s+)"
WORD = r"(?P<w>[^\W\d_]+)\.?"
YEAR_TAIL = r"(?:\s*(?:г|р|рік|год|года|року)\b\.?)?"
DATES = {
    "year first": r"(?P<y>\d{4})(?P<sep>[-./])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})",
    "day first": r"(?P<d>\d{1,2})(?P<sep>[-.])(?P<m>\d{1,2})(?P=sep)(?P<y>\d{4}|\d{2})" + YEAR_TAIL,
    "slash": r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<y>\d{4}|\d{2})",
    "day word": r"(?P<d>\d{1,2})(?:st|nd|rd|th|\.)?[\s-]+(?:of\s+|de\s+)?" + WORD + r",?[\s-]+(?P<y>\d{4})" + YEAR_TAIL,
    "word day": WORD + r"\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})",
    "year word": r"(?P<y>\d{4})" + YEAR_TAIL + r",?\s+" + WORD + r"\s+(?P<d>\d{1,2})",
    "compact": r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})",
}
PATTERNS = {k: re.compile(rf"(?:{WEEKDAY})?{v}(?:{LINK}{CLOCK}{ZONE})?") for k, v in DATES.items()}
COMPACT = re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})t?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})?{ZONE}")
MONTH_ONLY = (re.compile(r"(?P<y>\d{4})[-./](?P<m>\d{1,2})"), re.compile(r"(?P<m>\d{1,2})[-./](?P<y>\d{4})" + YEAR_TAIL), re.compile(WORD + r",?\s+(?P<y>\d{4})" + YEAR_TAIL))
YEAR_ONLY = re.compile(r"(?P<y>\d{4})" + YEAR_TAIL)
EARLIEST, LATEST = 1900, 2100


def month_of(word: str) -> int | None:
    """The month a word names, in any of the known languages."""
    hits = {i for i, names in enumerate(MONTHS, 1) for n in names if word.startswith(n) and len(word) <= len(n) + 7}
    return hits.pop() if len(hits) == 1 else None


def _day(y: int, m: int, d: int) -> date | None:
    if y < 100:
        y += 2000
    try:
        return date(y, m, d) if EARLIEST <= y <= LATEST else None
    except ValueError:
        return None


@lru_cache(maxsize=1000)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - any bad name means no zone
        return None


def _instants(local: datetime, written: str | None, site: str | None) -> list[datetime] | None:
    """UTC instants a local time can be; ``None`` when its zone is unknown."""
    place = _zone(site) if site else None
    if written:
        text = re.sub(r"\s+", "", written)
        m = re.fullmatch(r"(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?", text)
        if m:
            minutes = int(m[2]) * 60 + int(m[3] or 0)
            return [local - timedelta(minutes=minutes if m[1] == "+" else -minutes)] if minutes <= 15 * 60 else []
        if place:  # an abbreviation the site itself uses at that time comes first
            for fold in (0, 1):
                there = local.replace(tzinfo=place, fold=fold)
                if there.tzname().lower() == text:
                    return [local - there.utcoffset()]
        return [local - timedelta(minutes=ZONES[text])] if text in ZONES else None
    if place is None:
        return None
    found = []
    for fold in (0, 1):
        there = local.replace(tzinfo=place, fold=fold)
        instant = local - there.utcoffset()
        if instant.replace(tzinfo=timezone.utc).astimezone(place).replace(tzinfo=None, fold=0) == local and instant not in found:
            found.append(instant)
    return found


def _clocked(day: date, part: dict, site: str | None) -> list[tuple[str, str]]:
    h, mi, s = int(part["h"]), int(part["mi"]), int(part.get("s") or 0)
    half = part.get("ap")
    if half:
        if not 1 <= h <= 12:
            return []
        h = h % 12 + (12 if half == "p" else 0)
    if h > 23 or mi > 59 or s > 59:
        return []
    instants = _instants(datetime(day.year, day.month, day.day, h, mi), part.get("z") or part.get("zp"), site)
    if instants is None:
        return [("unsettled", "no zone")]
    return [("minute", i.strftime("%Y-%m-%dT%H:%MZ")) for i in instants]


def _readings(text: str, site: str | None) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    if re.fullmatch(r"\d{10}|\d{13}", text):
        at = datetime(1970, 1, 1) + timedelta(seconds=int(text) // (1 if len(text) == 10 else 1000))
        return [("minute", at.strftime("%Y-%m-%dT%H:%MZ"))] if EARLIEST <= at.year <= LATEST else []
    for name, pattern in PATTERNS.items():
        m = pattern.fullmatch(text)
        if not m:
            continue
        part = m.groupdict()
        month = month_of(part["w"]) if part.get("w") else int(part.get("m") or 0)
        if name == "slash":
            a, b, y = int(part["a"]), int(part["b"]), int(part["y"])
            days = [x for x in (_day(y, a, b), _day(y, b, a)) if x]
        else:
            days = [x for x in (_day(int(part["y"]), month or 0, int(part["d"])),) if x]
        days = list(dict.fromkeys(days))
        if len(days) > 1:
            return [("day", d.isoformat()) for d in days]
        for day in days:
            out += _clocked(day, part, site) if part.get("h") else [("day", day.isoformat())]
    m = COMPACT.fullmatch(text)
    if m and (day := _day(int(m["y"]), int(m["m"]), int(m["d"]))):
        out += _clocked(day, m.groupdict(), site)
    for pattern in MONTH_ONLY:
        m = pattern.fullmatch(text)
        if m:
            part = m.groupdict()
            month = month_of(part["w"]) if part.get("w") else int(part["m"])
            if month and _day(int(part["y"]), month, 1) if 1 <= (month or 0) <= 12 else False:
                out.append(("month", f"{int(part['y']):04d}-{month:02d}"))
    m = YEAR_ONLY.fullmatch(text)
    if m and EARLIEST <= int(m["y"]) <= LATEST:
        out.append(("year", m["y"]))
    return list(dict.fromkeys(out))


def read_moment(raw: str | None, site: str | None) -> tuple[str, str | None]:
    """``(kind, value)``: a UTC ``minute``, a ``day``, ``month`` or ``year``, or
    ``unsettled`` with the reason (``two readings``, ``no reading``, ``no zone``)."""
    if not raw:
        return "unsettled", "no reading"
    text = unicodedata.normalize("NFKC", raw).casefold().replace("−", "-").replace("–", "-")
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    text = " ".join(text.split()).strip(" ;")
    found = _readings(text, site)
    if not found:
        return "unsettled", "no reading"
    if ("unsettled", "no zone") in found:
        return "unsettled", "no zone"
    return found[0] if len(found) == 1 else ("unsettled", "two readings")
