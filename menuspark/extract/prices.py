"""One price grammar for all extractors."""

from __future__ import annotations

import re
from dataclasses import dataclass

LEAST, MOST = 4_000, 1_000_000  # minor units of a plausible menu price

_AMOUNT = r"[1-9]\d{0,3}(?:[.,]\d{1,3})?"
_BEFORE, _AFTER = r"(?:nok\s*|kr\.?\s*)", r"\s*(?:,-|kr\.?|nok)"
#: A line that is a price and nothing else; ``from`` may stand in front.
LINE = re.compile(rf"(?P<from>(?:fra|from)\s*)?{_BEFORE}?(?P<amount>{_AMOUNT})(?:{_AFTER})?", re.I)
#: A name and, at its end, a price of two to four digits.
INLINE = re.compile(r"(?P<name>.{2,280}?)\s+(?P<price>(?:kr\.?\s*)?[1-9]\d{1,3}(?:[.,]\d{1,2})?(?:\s*(?:,-|kr\.?|nok))?)", re.I | re.S)
STANDALONE = re.compile(r"(?:kr\.?\s*)?[1-9]\d{1,3}(?:[.,]\d{1,2})?(?:\s*(?:,-|kr\.?|nok))?", re.I)
#: A price with its currency mark at the end of a line.
MARKED = re.compile(rf"(?P<from>(?:fra|from)\s+)?(?P<amount>[1-9]\d{{1,3}}(?:[.,]\d{{1,2}})?){_AFTER}\s*$", re.I)
INLINE_FROM = re.compile(rf"(?P<name>.{{2,180}}?)\s+(?:fra|from)\s+{_BEFORE}?(?P<amount>{_AMOUNT})(?:{_AFTER})?", re.I)


@dataclass(frozen=True)
class Price:
    minor: int
    kind: str = "exact"


def amount(text: str) -> int | None:
    """Minor units of ``225``, ``22,50`` or ``1.250``: a point before three digits parts thousands."""
    whole, mark, tail = re.fullmatch(r"(\d+)(?:([.,])(\d+))?", text).groups()
    if mark == "." and len(tail) == 3:
        return int(whole + tail) * 100
    if tail and len(tail) > 2:
        return None
    return int(whole) * 100 + int((tail or "").ljust(2, "0"))


def plausible(minor: int | None, least: int = LEAST, most: int = MOST) -> int | None:
    return minor if minor is not None and least <= minor <= most else None


def read_line(text: str) -> Price | None:
    """The price that a whole line states, if it is plausible."""
    m = LINE.fullmatch(text.strip())
    minor = plausible(amount(m["amount"])) if m else None
    return None if minor is None else Price(minor, "from" if m["from"] else "exact")


def read_compact(value: object) -> int | None:
    """A price as structured data gives it: a number, or text with or without its currency."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return round(value * 100) if 0 <= value < float("inf") else None
    if not isinstance(value, str):
        return None
    bare = re.sub(r",-$", "", re.sub(r"nok|kr\.?", "", re.sub(r"\s+", "", value), flags=re.I))
    m = re.fullmatch(r"(\d{1,5})(?:[.,](\d{1,2}))?", bare)
    return int(m[1]) * 100 + int((m[2] or "").ljust(2, "0")) if m else None


def read_inline(text: str) -> tuple[str, int] | None:
    """(name, minor) of a line that ends in a plausible price."""
    m = INLINE.fullmatch(text)
    minor = plausible(read_compact(m["price"])) if m else None
    return (m["name"].strip(), minor) if minor is not None else None
