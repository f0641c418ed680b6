"""Weekly kitchen hours from visible text.

Three readings in this order: a dinner range with its own kitchen close, weekday ranges with clock
ranges, and cutoffs that apply to those (minutes before closing, or one clock for all days). What is
ambiguous raises ``HoursError`` with a code; nothing is guessed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menuspark.extract.html import visible_lines

# Weekday names and abbreviations, by ISO number.
WEEKDAYS = {
    1: "monday mandager mandag mon man",
    2: "tuesday tirsdager tirsdag tues tue tir",
    3: "wednesday onsdager onsdag weds wed ons",
    4: "thursday torsdager torsdag thurs thur thu tors tor",
    5: "friday fredager fredag fri fre",
    6: "saturday lørdager lordager lørdag lordag sat lør lor",
    7: "sunday søndager sondager søndag sondag sun søn son",
}
# End of fixed values.
DAY_OF = {name: day for day, names in WEEKDAYS.items() for name in names.split()}
DAY = "(?:" + "|".join(sorted(DAY_OF, key=len, reverse=True)) + r")\b\.?"
TIME = r"(?:(?:1[0-2]|0?[1-9])(?:[.:][0-5]\d)?\s*(?:am|pm)|(?:2[0-3]|[01]?\d)(?:[.:][0-5]\d)?)"
AT = r"(?:(?:kl\.?|klokka)\s*)?"
TO = r"(?:[-–]|til|to)"
DAYS = rf"\b(?P<first>{DAY})(?:\s*{TO}\s*(?P<last>{DAY}))?"
RANGE = re.compile(rf"{DAYS}(?:\s*[:|]\s*|\s+){AT}(?P<opens>{TIME})\s*{TO}\s*{AT}(?P<closes>{TIME})(?!\d)(?:\s*\((?P<note>[^)]{{1,120}})\))?", re.I)
DAY_LIST = re.compile(rf"\b{DAY}(?:(?:\s*,\s*|\s+(?:og|and|&)\s+){DAY})+", re.I)
DINNER = re.compile(rf"\bdinner\s+{DAYS}\s+(?P<opens>{TIME})\s*[-–]\s*(?P<closes>late|{TIME})", re.I)
KITCHEN_CLOSE = re.compile(rf"kitchen\s+closes\s+at\s+({TIME})", re.I)
NOTE_CLOSE = re.compile(rf"(?:kitchen(?:\s+closes)?(?:\s+at)?|kjøkken(?:et)?\s+(?:til|stenger))\s*{AT}({TIME})", re.I)
DAILY_CLOSE = re.compile(rf"(?:kjøkken(?:et)?\s+stenger|kitchen\s+closes(?:\s+at)?)\s+([^.!?]{{1,260}})", re.I)
CLOSE_DAYS = re.compile(rf"{AT}({TIME})\s+{DAYS}", re.I)
BEFORE_CLOSE = re.compile(r"(?:kitchen\s+closes|kjøkken(?:et)?\s+stenger)\s+(\d{1,3})\s*(?:minutes?|minutter|min\.?)\s+(?:before(?:\s+closing)?|før(?:\s+(?:stengetid|vi\s+stenger))?)", re.I)
ONE_CLOSE = re.compile(rf"(?:kitchen\s+closes(?:\s+at)?|kjøkken(?:et)?\s+stenger)\s*{AT}({TIME})(?!\s*(?:\d|min|{DAY}))", re.I)
MARKER = re.compile(r"(?:opening\s+hours|hours|åpningstider)(?:\s+([^:]{1,80}))?:?", re.I)


class HoursError(ValueError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


@dataclass(frozen=True, order=True)
class Interval:
    weekday: int
    opens: int
    closes: int

    @property
    def next_day(self) -> bool:
        """A close at or before the opening belongs to the day after; equal times are a whole day."""
        return self.closes <= self.opens


def minute(text: str) -> int:
    m = re.fullmatch(r"(\d{1,2})(?::([0-5]\d))?(am|pm)?", re.sub(r"\s+", "", text.lower().replace(".", ":")))
    hour = int(m[1]) if m else 99
    if m and m[3]:
        hour = 99 if not 1 <= hour <= 12 else hour % 12 + (12 if m[3] == "pm" else 0)
    if hour > 23:
        raise HoursError("INVALID_CLOCK", text)
    return hour * 60 + int(m[2] or 0)


def weekday(text: str) -> int:
    return DAY_OF[text.lower().rstrip(".")]


def weekdays(first: str, last: str | None) -> list[int]:
    """From first to last, over the weekend where last comes before first."""
    a, b = weekday(first), weekday(last or first)
    return [(a - 1 + i) % 7 + 1 for i in range((b - a) % 7 + 1)]


def slug(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "-", plain.lower()).strip("-")


def _day_lists(text: str) -> str:
    """``Monday, Tuesday and Wednesday`` becomes a range where the days follow one another."""

    def joined(m: re.Match) -> str:
        names = re.findall(DAY, m[0], re.I)
        days = [weekday(n) for n in names]
        return f"{names[0]}-{names[-1]}" if all(b == a + 1 for a, b in zip(days, days[1:], strict=False)) else m[0]

    return DAY_LIST.sub(joined, text)


def dinner(text: str) -> list[Interval] | None:
    """The dinner range; ``late`` needs a kitchen close within the text that follows."""
    m = DINNER.search(text)
    if not m:
        return None
    near = text[max(0, m.start() - 40) : m.end() + 180]
    close = KITCHEN_CLOSE.search(near)
    if m["closes"].lower() == "late" and not close:
        raise HoursError("AMBIGUOUS_CLOSE_TIME")
    closes = minute(close[1] if close else m["closes"])
    return [Interval(d, minute(m["opens"]), closes) for d in weekdays(m["first"], m["last"])]


def daily_closes(text: str) -> dict[int, int]:
    """Kitchen closes that name their weekdays: ``kitchen closes 21.00 Monday-Thursday, 22.00 ...``."""
    m = DAILY_CLOSE.search(text)
    if not m or not re.search(rf"\b{DAY}", m[1], re.I) or RANGE.match(m[1]):
        return {}
    found = {d: minute(g[1]) for g in CLOSE_DAYS.finditer(m[1]) for d in weekdays(g["first"], g["last"])}
    if not found:
        raise HoursError("INVALID_GLOBAL_KITCHEN_CUTOFF")
    return found


def weekly(text: str) -> list[Interval]:
    """All weekday ranges of a text; a note in brackets or the day's kitchen close replaces the close."""
    text = _day_lists(" ".join(text.split()))
    closes = daily_closes(text)
    found = set()
    for m in RANGE.finditer(text):
        note = NOTE_CLOSE.search(m["note"] or "")
        for d in weekdays(m["first"], m["last"]):
            if closes and not note and d not in closes:
                raise HoursError("INCOMPLETE_KITCHEN_CUTOFF", f"weekday {d}")
            found.add(Interval(d, minute(m["opens"]), minute(note[1]) if note else closes.get(d, minute(m["closes"]))))
    return sorted(found)


def scoped(lines: list[str], hints: list[str]) -> list[str]:
    """The lines of the one section that applies: by hint, by the page's own name, by being the only one
    that parses, or because all sections agree."""
    at = [(i, (m[1] or "").strip()) for i, line in enumerate(lines) if (m := MARKER.fullmatch(line.strip()))]
    if not at:
        return lines
    parts = [(label, lines[i:end]) for (i, label), end in zip(at, [*[i for i, _ in at[1:]], len(lines)], strict=True)]
    if len(parts) == 1:
        return parts[0][1]
    wanted = [slug(h) for h in hints if slug(h)]
    page = " ".join(lines[: at[0][0]]).lower()
    for chosen in (
        [p for label, p in parts if label and any(slug(label) in h or h in slug(label) for h in wanted)],
        [p for label, p in parts if label and label.lower() in page],
        [p for _, p in parts if weekly(" ".join(p))],
    ):
        if len(chosen) == 1 or len(chosen) > 1 and len({tuple(weekly(" ".join(p))) for p in chosen}) == 1:
            return chosen[0]
    raise HoursError("AMBIGUOUS_HOURS_SECTION", f"{len(parts)} sections")


def clamp(item: Interval, close: int) -> Interval:
    """The interval with an absolute kitchen close inside it; a later close changes nothing."""
    end = item.closes + (1440 if item.next_day else 0)
    at = close + (1440 if item.next_day and close <= item.opens else 0)
    if at <= item.opens or item.next_day and at > end and close <= item.opens:
        raise HoursError("INVALID_GLOBAL_KITCHEN_CUTOFF")
    return item if at >= end else replace(item, closes=at % 1440)


def kitchen_hours(html: str | None, hints: list[str] | None = None) -> list[Interval]:
    """The weekly kitchen intervals of a page."""
    lines = visible_lines(html)
    found = dinner(" ".join(lines))
    if found:
        return found
    lines = scoped(lines, hints or [])
    text = " ".join(lines)
    before = {int(m[1]) for m in BEFORE_CLOSE.finditer(text)}
    rest = BEFORE_CLOSE.sub(" ", text)
    one = {minute(m[1]) for m in ONE_CLOSE.finditer(rest)}
    if len(before) > 1 or before and (one or daily_closes(rest)):
        raise HoursError("AMBIGUOUS_RELATIVE_KITCHEN_CUTOFF")
    if len(one) > 1:
        raise HoursError("AMBIGUOUS_ABSOLUTE_KITCHEN_CUTOFF")
    if before:
        minutes = before.pop()
        if not 1 <= minutes <= 180:
            raise HoursError("INVALID_RELATIVE_KITCHEN_CUTOFF", str(minutes))
        found = [replace(i, closes=(i.closes - minutes) % 1440) for i in weekly(rest)]
    elif one:
        close = one.pop()
        found = [clamp(i, close) for i in weekly(ONE_CLOSE.sub(" ", rest))]
    else:
        found = weekly(rest)
    if not found:
        raise HoursError("NO_HOURS_FOUND")
    return sorted(found)


def extract_hours(pages: DataFrame, id_col: str, html_col: str, hints_col: str | None = None) -> DataFrame:
    """(id, iso_weekday, opens, closes, next_day, error): a row per interval, or one row with the error code
    where a page's hours are missing or ambiguous."""
    schema = pa.schema([(id_col, pa.int64()), ("iso_weekday", pa.int32()), ("opens", pa.int32()), ("closes", pa.int32()), ("next_day", pa.bool_()), ("error", pa.string())])

    def rows(key: int | None, html: str | None, hints: list[str] | None) -> Iterator[tuple]:
        try:
            for i in kitchen_hours(html, hints):
                yield key, i.weekday, i.opens, i.closes, i.next_day, None
        except HoursError as e:
            yield key, None, None, None, None, e.code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in rows(*row)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in found], schema=schema)

    hints = F.col(hints_col) if hints_col else F.lit(None)
    slim = pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string"), hints.cast("array<string>").alias("hints"))
    return slim.mapInArrow(run, f"`{id_col}` long, iso_weekday int, opens int, closes int, next_day boolean, error string")
