"""Menu items from a page: independent finders over one line model, then arbitration.

Every finder is a pure function of a ``Page`` and returns items with its own confidence. ``extract``
puts them together by coverage: structured data wins, a strong layout replaces the weak reading, and
what the chosen reading lacks is supplemented by name.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menuspark.extract import prices, words
from menuspark.extract.html import VOID, annotated_lines

HEURISTIC, STRUCTURED, EMBEDDED = "html_heuristic", "json_ld", "api"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W_]+")
_CARD_PARTS = {v: k for k, v in words.CARD_IDS.items()}
_STRUCK = "product-price-before-discount"


def squeeze(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


@lru_cache(maxsize=8192)
def normal_name(text: str) -> str:
    """NFKC, lower case, everything but letters and digits as one space."""
    return " ".join(_OTHER.sub(" ", unicodedata.normalize("NFKC", text).lower()).split())


@lru_cache(maxsize=8192)
def source_key(name: str, section: str | None = None) -> str:
    return hashlib.sha256(f"{normal_name(section or '')}\0{normal_name(name)}".encode()).hexdigest()


@dataclass(frozen=True)
class Item:
    name: str
    price_minor: int | None
    position: int
    confidence: float
    description: str | None = None
    section: str | None = None
    price_kind: str = "exact"
    price_max_minor: int | None = None
    currency: str = "NOK"
    method: str = HEURISTIC
    excerpt: str | None = None

    @property
    def key(self) -> str:
        return source_key(self.name, self.section)

    @property
    def normalized(self) -> str:
        return normal_name(self.name)


class Page:
    """A page's lines and scripts, each computed once."""

    def __init__(self, html: str | None):
        self.html = _price_notation(html or "")

    @cached_property
    def annotated(self) -> list[tuple[str, int | None]]:
        return annotated_lines(self.html)

    @cached_property
    def lines(self) -> list[str]:
        return [line for line, _ in self.annotated]

    @cached_property
    def scripts(self) -> list[tuple[str, object]]:
        """(type, parsed JSON) of the JSON scripts that parse."""
        found = []
        for m in re.finditer(r"<script\b([^>]*)>(.*?)</script\s*>", self.html, re.S | re.I):
            kind = re.search(r"""type\s*=\s*["']?(application/(?:ld\+)?json)""", m[1], re.I)
            if kind and m[2].strip():
                try:
                    found.append((kind[1].lower(), json.loads(m[2])))
                except ValueError:
                    continue
        return found


def _price_notation(html: str) -> str:
    html = re.sub(r"(\b(?:kr\.?\s*)?[1-9]\d{1,3})(?:\s*,)?\s*/-", r"\1,-", html, flags=re.I)
    return re.sub(r"(\b[1-9]\d{1,3})\s*-(?=\s*(?:<|$))", r"\1,-", html, flags=re.M)


def _by_key(items: Iterable[Item], keep_first: bool = False) -> list[Item]:
    """One item per key, the last (or first) one, in position order."""
    found: dict[str, Item] = {}
    for item in items:
        if not (keep_first and item.key in found):
            found[item.key] = item
    return sorted(found.values(), key=lambda i: i.position)


def _walk(value: object, depth: int = 0, most: int = 64) -> Iterator[dict]:
    """Every object within a JSON value, outer ones first."""
    if depth > most:
        return
    if isinstance(value, dict):
        yield value
        value = list(value.values())
    if isinstance(value, list):
        for child in value:
            yield from _walk(child, depth + 1, most)


# --- structured data ----------------------------------------------------------------------------


def linked_data_items(page: Page) -> list[Item]:
    """Menu items of linked-data scripts. The key has no section; of equal keys the last wins."""

    def is_item(kind: object) -> bool:
        return any(map(is_item, kind)) if isinstance(kind, list) else isinstance(kind, str) and kind.rpartition("/")[2] == "MenuItem"

    def found() -> Iterator[Item]:
        nodes = [n for kind, value in page.scripts if kind == "application/ld+json" for n in _walk(value) if is_item(n.get("@type"))]
        for position, node in enumerate(nodes):
            raw = node.get("name")
            name = re.sub(r"^\d{1,3}\s*[.)]?\s+", "", squeeze(raw)).strip() if isinstance(raw, str) else ""
            if not name or not_a_dish(name):
                continue
            offers = node.get("offers")
            offer = next((o for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict)), {})
            currency = offer.get("priceCurrency")
            text = node.get("description")
            description = text.strip() or None if isinstance(text, str) else None
            yield Item(name, prices.read_compact(offer.get("price")), position, 0.99, description, currency=currency.upper() if isinstance(currency, str) and re.fullmatch("[A-Za-z]{3}", currency) else "NOK", method=STRUCTURED, excerpt=f"{name} — {description}" if description else name)

    return _by_key(found())


def embedded_items(page: Page, least: int = 4) -> list[Item]:
    """Items of an application's own JSON: an object with ``categories`` that list item ids and ``items``.

    At least two categories and four priced items, seven in ten of them bound to a category. The object
    that binds most items wins."""

    def text(value: object) -> str:
        return squeeze(value) if isinstance(value, str) else ""

    def identity(value: object) -> str:
        return str(value) if isinstance(value, (str, int, float)) and not isinstance(value, bool) else ""

    candidates = []
    for _, value in page.scripts:
        for node in _walk(value, most=10):
            if not (isinstance(node.get("categories"), list) and isinstance(node.get("items"), list)):
                continue
            groups = [(text(c.get("name")), [identity(i) for i in c["item_ids"] if identity(i)]) for c in node["categories"] if isinstance(c, dict) and isinstance(c.get("item_ids"), list)]
            groups = [(n, ids) for n, ids in groups if n and ids]
            dishes = {}
            rows = [r for r in node["items"] if isinstance(r, dict) and isinstance(r.get("price"), int) and not isinstance(r["price"], bool) and 3_000 <= r["price"] <= 2_000_000 and identity(r.get("id")) and text(r.get("name"))]
            for r in rows:
                dishes.setdefault(identity(r["id"]), r)
            bound = {i for _, ids in groups for i in ids if i in dishes}
            if len(groups) >= 2 and len(rows) >= least and len(bound) >= least and len(bound) >= 0.7 * len(rows):
                candidates.append((len(bound) * 100 + len(groups), groups, rows))
    for _, groups, rows in sorted(candidates, key=lambda c: -c[0]):
        home: dict[str, str] = {}
        for name, ids in groups:
            if not words.GENERIC_CATEGORY.fullmatch(name) and not words.DRINK_CATEGORY.fullmatch(name):
                for i in ids:
                    home.setdefault(i, name)
        items = []
        for r in rows:
            if section := home.get(identity(r["id"])):
                name = text(r["name"])
                items.append(Item(name, r["price"], len(items), 0.99, text(r.get("description")) or None, section, method=EMBEDDED, excerpt=f"{section} — {name} — {r['price'] / 100:g} NOK"[:1000]))
        items = [replace(i, position=n) for n, i in enumerate(_by_key(items, keep_first=True))]
        if len(items) >= least:
            return items
    return []


class _Cards(HTMLParser):
    """Sections with their title and cards, told by card ids. A field takes the text of the first element
    with its id, without what a struck-out price holds."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.sections: list[dict] = []
        self._open: list[tuple[str, tuple[dict, str] | None]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        part = _CARD_PARTS.get(dict(attrs).get("data-testid"))
        if part == "category-section":
            self.sections.append({"cards": []})
        elif part == "product" and self.sections:
            self.sections[-1]["cards"].append({})
        self._open.append((tag, self._field(part)))

    def _field(self, part: str | None) -> tuple[dict, str] | None:
        """The record that an element's text belongs to, if it is a field seen for the first time."""
        if part in (None, "category-section", "product") or not self.sections:
            return None
        if part == _STRUCK:
            return {}, part
        section = self.sections[-1]
        record = section if part == "category-section-title" else section["cards"][-1] if section["cards"] else {}
        return None if part in record else (record, part)

    def handle_endtag(self, tag):
        for at in range(len(self._open) - 1, -1, -1):
            if self._open[at][0] == tag:
                del self._open[at:]
                return

    def handle_data(self, data):
        field = next((f for _, f in reversed(self._open) if f), None)
        if field:
            record, part = field
            record[part] = record.get(part, "") + data


def card_items(page: Page) -> list[Item]:
    """Product cards under category sections, told by their test ids: two food categories, or one beside
    a drink category, and four items at least."""
    scanner = _Cards()
    scanner.feed(page.html)
    scanner.close()
    if len(scanner.sections) < 2:
        return []
    items: list[Item] = []
    names, drinks = set(), False
    for section in scanner.sections:
        title = squeeze(section.get("category-section-title", ""))
        if not title:
            continue
        if words.DRINK_SECTION.fullmatch(title):
            drinks = True
            continue
        if section["cards"]:
            names.add(normal_name(title))
        for card in section["cards"]:
            name, written = squeeze(card.get("product-name", "")), squeeze(card.get("product-price", ""))
            price = prices.read_line(written)
            if name and _LETTER.search(name) and price:
                items.append(Item(name, price.minor, len(items), 0.99, squeeze(card.get("product-description", "")) or None, title, price.kind, excerpt=f"{title} — {name} — {written}"[:1000]))
    return items if (len(names) >= 2 or names and drinks) and len(items) >= 4 else []


# --- line finders -------------------------------------------------------------------------------


def not_a_dish(name: str) -> bool:
    return name.startswith("+") or "@" in name or bool(re.search("https?://", name, re.I) or words.NOT_DISH_START.match(name) or words.NOT_DISH.fullmatch(name) or words.WEEKDAY_START.match(normal_name(name)))


def split_name(text: str) -> tuple[str, str | None]:
    """(name, description): allergen brackets and a menu number go, a comma starts the description."""
    clean = re.sub(r"^\d{1,3}\s*[.)]\s*", "", words.ALLERGEN_BRACKET.sub("", text).strip()).strip()
    at = clean.find(",")
    return (clean[:at].strip(), clean[at + 1 :].strip() or None) if 3 <= at <= 120 else (clean, None)


@dataclass(frozen=True)
class Traits:
    """What a line looks like, for telling names from what is said about them."""

    count: int  # words
    lead: bool  # begins as descriptions do
    serving: bool
    pauses: bool
    closes: bool
    joins: bool
    coded: bool  # ends in bracketed allergen codes
    starred: bool
    shouts: bool  # all letters are capitals, three at least

    @classmethod
    def of(cls, text: str) -> Traits:
        bare = re.sub(r"^\d{1,3}\s*[.)]\s*", "", text).strip()
        return cls(
            len(bare.split()),
            bool(words.DESCRIPTOR.match(bare)),
            bool(words.SERVED.search(bare)),
            bool(re.search("[,;]", bare)),
            bool(re.search(r"[.!?](?:\s|$)", bare)),
            bool(words.JOINING.search(bare)),
            bool(words.ALLERGEN_BRACKET.search(text)),
            text.startswith("*"),
            sum(map(str.isalpha, text)) >= 3 and text == text.upper(),
        )

    def has(self, shown: dict[str, int]) -> bool:
        """Whether it shows any of these traits in a line of so many words at least."""
        return any(getattr(self, trait) and self.count >= least for trait, least in shown.items())


#: Traits that mark the beginning of a description, and those that mark any line of one.
_LEADS = {"lead": 1, "serving": 4}
_DESCRIBES = _LEADS | {"pauses": 1, "closes": 1, "joins": 7}


def _descriptive(text: str) -> bool:
    """A line that reads like a description rather than a name."""
    own = Traits.of(text)
    return not own.coded and own.has(_DESCRIBES)


def _capitals(text: str) -> bool:
    own = Traits.of(text)
    return own.shouts and not own.starred and 3 <= len(text) <= 140 and not (own.has(_LEADS) or not_a_dish(text) or words.BOUNDARY.match(text))


#: Lines below a shared price that it can reach in the general reading.
_SHARED_REACH = 30


def shared_sections(lines: list[str], reach: int | None = _SHARED_REACH) -> dict[int, list[Item]]:
    """Sections priced once for at least two capitalised names within ``reach`` lines below, or up to the
    section's end if it is None, by header line.

    One pass from the last line up: a stack holds the capitalised names seen since the nearest line that
    ends a section; a priced header takes those in its reach, and then ends the section above."""
    found: dict[int, list[Item]] = {}
    names: list[int] = []  # nearest last
    stop = len(lines)
    for at in range(len(lines) - 1, -1, -1):
        line = lines[at]
        priced = None if prices.STANDALONE.fullmatch(line) else prices.read_inline(line)
        if priced and not not_a_dish(priced[0]):
            end = stop if reach is None else min(stop, at + 1 + reach)
            heads = [i for i in reversed(names) if i < end]
            (section, extra), minor = split_name(priced[0]), priced[1]
            if len(heads) >= 2 and not extra and _section_name(section):
                found[at] = [_shared_item(lines, section, minor, head, after) for head, after in zip(heads, [*heads[1:], end], strict=True)]
        if line.startswith("*") or words.BOUNDARY.match(line) or prices.INLINE.fullmatch(line) or prices.STANDALONE.fullmatch(line):
            names, stop = [], at
        elif _capitals(line):
            names.append(at)
    return dict(sorted(found.items()))


def _section_name(text: str) -> bool:
    return len(text) <= 60 and len(text.split()) <= 5 and not re.search("[,;:]", text)


def _shared_item(lines: list[str], section: str, minor: int, head: int, after: int) -> Item:
    told = [x for x in lines[head + 1 : after] if not (x.startswith("*") or words.ALLERGEN_LINE.match(x) or words.BOUNDARY.match(x))]
    rest = " ".join(told).strip() or None
    excerpt = " — ".join(x for x in (f"{section} {minor / 100:g}", lines[head], rest) if x)[:1000]
    return Item(lines[head], minor, head, 0.76, rest, section, excerpt=excerpt)


def plain_items(page: Page) -> list[Item]:
    """The general reading: shared sections, names that end in a price, and prices on their own lines
    with the nearest name at most eight lines above. Keys have no section here."""
    lines, found = page.lines, {}
    shared = shared_sections(lines)
    for items in shared.values():
        for item in items:
            found[source_key(item.name)] = item
    for at, line in enumerate(lines):
        if at in shared or prices.STANDALONE.fullmatch(line):
            continue
        priced = prices.read_inline(line)
        if priced and not not_a_dish(priced[0]):
            name, description = split_name(priced[0].lstrip("*").strip())
            if 2 <= len(name) <= 300:
                found[source_key(name)] = Item(name, priced[1], at, 0.78, description, excerpt=line[:1000])
    for at, line in enumerate(lines):
        minor = prices.plausible(prices.read_compact(line)) if prices.STANDALONE.fullmatch(line) else None
        if minor is None:
            continue
        head = None
        for i in range(at - 1, max(-1, at - 9), -1):
            if prices.STANDALONE.fullmatch(lines[i]) or prices.INLINE.fullmatch(lines[i]):
                break
            if not_a_dish(lines[i]) or _descriptive(lines[i]) or words.BOUNDARY.match(lines[i]):
                continue
            name = split_name(lines[i].lstrip("*").strip())[0]
            if 2 <= len(name) <= 180 and _LETTER.search(name):
                head = i
                break
        if head is None:
            continue
        name = split_name(lines[head].lstrip("*").strip())[0]
        if not not_a_dish(name) and source_key(name) not in found:
            rest = " ".join(x for x in lines[head + 1 : at] if not words.ALLERGEN_LINE.match(x)).strip() or None
            found[source_key(name)] = Item(name, minor, head, 0.72, rest, excerpt=" — ".join(lines[head : at + 1])[:1000])
    return sorted(found.values(), key=lambda i: i.position)


def _section_label(text: str) -> str:
    return re.sub(r"\s*\(\s*\d{1,3}\s*\)\s*$", "", text).strip()


def _boundary_label(text: str) -> bool:
    label = _section_label(text)
    return any(p.fullmatch(label) for p in (words.FOOD_SECTION, words.DRINK_SECTION, words.MENU_LABEL, words.MENU_END))


def _title(text: str, most: int = 160, most_words: int = 12) -> bool:
    """A line that may name a dish: short, with letters, no price, label, address or sentence."""
    if not 2 <= len(text) <= most or not _LETTER.search(text) or len(text.split()) > most_words or text[-1] in ".!?":
        return False
    if prices.LINE.fullmatch(text) or _boundary_label(text) or words.PAGE_LABEL.fullmatch(text) or words.WEB_LINE.match(text):
        return False
    return not (words.DESCRIPTION_LEAD.match(text) or words.ARTICLE_LEAD.match(text)) or len(text.split()) < 6


def wrapped_items(page: Page) -> list[Item]:
    """Blocks between two equal prices at most eight lines apart; three blocks at least."""
    lines = page.lines
    at = [i for i, line in enumerate(lines) if prices.STANDALONE.fullmatch(line)]
    items = []
    for start, end in zip(at, at[1:], strict=False):
        minor = prices.plausible(prices.read_compact(lines[start]))
        block = lines[start + 1 : end]
        if not block or end - start > 8 or minor is None or prices.read_compact(lines[end]) != minor:
            continue
        if _title(block[0]) and not words.DESCRIPTION_LEAD.match(block[0]):
            rest = " ".join(x for x in block[1:] if not words.PAGE_LABEL.fullmatch(x) and not _boundary_label(x)).strip() or None
            items.append(Item(block[0], minor, start + 1, 0.93, rest, excerpt=" — ".join(lines[start : end + 1])[:1000]))
    items = _by_key(items)
    return items if len(items) >= 3 else []


def marked_items(page: Page) -> list[Item]:
    """Lines that end in a price with its currency mark; three at least."""
    items = []
    for at, line in enumerate(page.lines):
        m = prices.MARKED.search(line)
        minor = prices.plausible(prices.amount(m["amount"])) if m else None
        name = re.sub(r"(?:kr\.?|nok)\s*$", "", line[: m.start()], flags=re.I).strip() if minor is not None else ""
        if name and _title(name) and not re.search(r"[1-9]\d{1,3}(?:[.,]\d{1,2})?\s*(?:,-|kr\.?|nok)", name, re.I):
            items.append(Item(name, minor, at, 0.97, price_kind="from" if m["from"] else "exact", excerpt=line[:1000]))
    items = _by_key(items)
    return items if len(items) >= 3 else []


def heading_items(page: Page) -> list[Item]:
    """Headings with a price in the four lines after. The heading level that names most dishes wins, four
    at least; headings under a drink heading do not count. A name under several sections, each with a
    heading of its own, gets its section as part of its identity."""
    rows, levels = page.annotated, defaultdict(list)
    blocked: int | None = None
    for at, (text, level) in enumerate(rows):
        if level is None:
            continue
        if blocked is not None and level <= blocked:
            blocked = None
        if words.DRINK_SECTION.fullmatch(text):
            blocked = level
            continue
        if blocked is not None or not _title(text, 180) or re.search(r"\b(?:still|sparkling)\s+(?:water|naturell)\b", text, re.I):
            continue
        for i in range(at + 1, min(len(rows), at + 5)):
            price = prices.read_line(rows[i][0])
            if price:
                levels[level].append(Item(text, price.minor, at, 0.96, price_kind=price.kind, excerpt=f"{text} — {rows[i][0]}"[:1000]))
                break
            if rows[i][1] is not None and not (rows[i][1] > level and words.PAGE_LABEL.fullmatch(rows[i][0])):
                break
    if not levels:
        return []
    level, items = max(levels.items(), key=lambda kv: len(kv[1]))
    if len(items) < 4:
        return []

    def section_of(item: Item) -> str | None:
        above = (text for text, lv in reversed(rows[: item.position]) if lv is not None and lv < level)
        return next((t for t in above if t and not words.PAGE_LABEL.fullmatch(t) and not words.DRINK_SECTION.fullmatch(t)), None)

    return _by_key(with_section_identity(items, section_of))


def with_section_identity(items: list[Item], section_of) -> list[Item]:
    """Give items of one name their sections if all have one and there are at least two."""
    groups = defaultdict(list)
    for item in items:
        groups[item.normalized].append(section_of(item))
    scoped = {name for name, hints in groups.items() if len(hints) > 1 and all(hints) and len(set(map(normal_name, hints))) > 1}
    return [replace(i, section=section_of(i)) if i.normalized in scoped else i for i in items]


def from_items(page: Page) -> list[Item]:
    """Prices that say ``from``, on the name's line or at most five lines below it."""
    lines, items = page.lines, []
    for at, line in enumerate(lines):
        alone, inline = prices.read_line(line), prices.INLINE_FROM.fullmatch(line)
        if alone:
            minor = alone.minor if alone.kind == "from" else None
        else:
            minor = prices.plausible(prices.amount(inline["amount"])) if inline else None
        if minor is None:
            continue
        head = (inline["name"].strip(), at) if not alone and inline and _title(inline["name"].strip()) else None
        for i in range(at - 1, max(-1, at - 6), -1) if head is None else ():
            if prices.LINE.fullmatch(lines[i]) or prices.INLINE_FROM.fullmatch(lines[i]):
                break
            if _title(lines[i]):
                head = (lines[i], i)
                break
        if head:
            items.append(Item(head[0], minor, head[1], 0.97, price_kind="from", excerpt=f"{head[0]} — {line}"[:1000]))
    return _by_key(items)


def first_cards(page: Page) -> list[Item]:
    """The first name with a price within 30 lines after a plain food-section label."""
    lines, items = page.lines, []
    for at, line in enumerate(lines):
        if not words.FOOD_SECTION.fullmatch(_section_label(line)):
            continue
        head = None
        for i in range(at + 1, min(len(lines), at + 30)):
            if _boundary_label(lines[i]):
                break
            price = prices.read_line(lines[i])
            if price:
                if head is not None:
                    items.append(Item(lines[head], price.minor, head, 0.95, price_kind=price.kind, excerpt=" — ".join(lines[head : i + 1])[:1000]))
                break
            if head is None and _title(lines[i], 180):
                head = i
    return _by_key(items)


# --- scoped readings ----------------------------------------------------------------------------

_NUMBERED = re.compile(r"(\d{1,3})\s*[.)]?\s+(.+)")
_TITLE_NUMBER = re.compile(r"\d{1,3}\s*[.)]\s*(?=.*[^\W\d_])")


def food_scope(rows: list[tuple[str, int | None]]) -> list[tuple[str, int | None]]:
    """The rows of food: drink headings take their whole subtree away, a closing section ends the menu
    once food was seen, and in numbered menus extras are skipped up to the next number."""
    numbered = len({normal_name(t) for t, _ in rows if _TITLE_NUMBER.match(t)}) >= 2
    out: list[tuple[str, int | None]] = []
    blocked: int | None = None
    extras = food = False
    for text, level in rows:
        if level is not None:
            extras = False
            if blocked is not None and level <= blocked:
                blocked = None
            if blocked is None and food and words.MENU_END.fullmatch(text):
                break
            if blocked is None and words.DRINK_SECTION.fullmatch(text):
                blocked = level
        if blocked is not None:
            continue
        if level is None:
            if numbered and words.EXTRAS.match(text):
                extras = True
            elif extras and _TITLE_NUMBER.match(text):
                extras = False
            if extras or words.MORE.fullmatch(text):
                continue
            food = food or bool(prices.STANDALONE.fullmatch(text) or prices.INLINE.fullmatch(text))
        out.append((text, level))
    return out


def numbered_items(rows: list[tuple[str, int | None]]) -> list[Item]:
    """Numbered titles with a price in the eight lines below. At least two titles, half of them priced."""
    lines = [t for t, _ in rows]
    at = [i for i, t in enumerate(lines) if _TITLE_NUMBER.match(t)]
    titles, items = set(), []
    for i, after in zip(at, [*at[1:], len(lines)], strict=False):
        name = _TITLE_NUMBER.sub("", words.ALLERGEN_BRACKET.sub("", lines[i])).strip()
        titles.add(normal_name(name))
        rest: list[str] = []
        for j in range(i + 1, min(after, i + 9)):
            if words.EXTRAS.match(lines[j]):
                break
            alone = prices.STANDALONE.fullmatch(lines[j])
            priced = (None, prices.plausible(prices.read_compact(lines[j]))) if alone else prices.read_inline(lines[j])
            if priced is None or priced[1] is None:
                if rows[j][1] is None:
                    rest.append(lines[j])
                continue
            rest += [priced[0]] if priced[0] else []
            items.append(Item(name, priced[1], i, 0.92, " ".join(rest).strip() or None, excerpt=" — ".join(lines[i : j + 1])[:1000]))
            break
    items = _by_key(i for i in items if is_item(i))
    return items if len(titles) >= 2 and len(items) >= 2 and 2 * len(items) >= len(titles) else []


def _script(text: str) -> str | None:
    counts = Counter(unicodedata.name(c, "?").split()[0] for c in text if c.isalpha())
    return counts.most_common(1)[0][0] if counts else None


def block_items(rows: list[tuple[str, int | None]]) -> list[Item]:
    """One item per price that stands alone, from the block since the price before: a capitalised line right
    above, else the block's last heading where a description or its repeated level supports it, else the first
    line that may be a title. A heading in another script above belongs to the title. At least three prices,
    three in four of them with an item."""
    lines = [t for t, _ in rows]
    at = [i for i, t in enumerate(lines) if prices.STANDALONE.fullmatch(t)]
    levels = Counter(lv for _, lv in rows if lv is not None)

    def title(text: str, most_words: int) -> bool:
        return _title(text.rstrip(".!?"), 180, most_words) and not not_a_dish(text) and text[-1:] not in ",;:" and not words.DESCRIPTION_LEAD.match(text)

    found: list[tuple[Item, int]] = []
    for start, end in zip([-1, *at], at, strict=False):
        minor = prices.plausible(prices.read_compact(lines[end]))
        block = range(start + 1, end)
        if minor is None or not block:
            continue
        heads = [i for i in block if rows[i][1] is not None]
        texts = [i for i in block if rows[i][1] is None]
        head = end - 1 if _capitals(lines[end - 1]) and title(lines[end - 1], 16) else None
        if head is None and heads:
            below = next((lines[i] for i in texts if i > heads[-1]), "")
            repeated = levels[rows[heads[-1]][1]] >= 2
            described = len(below.split()) >= 4 or below[-1:] in tuple(".!?")
            strong = len(below.split()) >= 6 or below[-1:] in tuple(".!?")
            if below and (described if repeated else strong) and title(lines[heads[-1]], 8) or not below and repeated and title(lines[heads[-1]], 16):
                head = heads[-1]
        if head is None:
            head = next((i for i in texts if i > (heads[-1] if heads else -1) and title(lines[i], 8)), None)
        if head is None:
            continue
        name = split_name(lines[head])[0] if "," not in lines[head] else lines[head]
        if head > start + 1 and rows[head - 1][1] is not None and title(lines[head - 1], 8) and _script(lines[head - 1]) not in (None, _script(name)):
            name = squeeze(f"{lines[head - 1]} {name}")
        rest = " ".join(lines[i] for i in texts if i > head and not words.EXTRAS.match(lines[i]) and not words.MORE.fullmatch(lines[i])).strip() or None
        found.append((Item(name, minor, head, 0.9, rest, excerpt=" — ".join(lines[head : end + 1])[:1000]), head))

    def section_of(item: Item) -> str | None:
        own = rows[item.position][1]
        above = (t for t, lv in reversed(rows[: item.position]) if lv is not None and (own is None or lv < own))
        return next((t for t in above if words.FOOD_SECTION.fullmatch(t) or words.NEXT_SCOPE.fullmatch(t)), None)

    items = _by_key(with_section_identity([i for i, _ in found], section_of))
    return items if len(at) >= 3 and len(items) >= 3 and 4 * len(items) >= 3 * len(at) else []


def trailing_items(page: Page) -> list[Item]:
    """Prices that close a card: on the title's line, or up to twelve lines below a title, a numbered title
    first. Four items at least. An explicit a-la-carte scope with four items stands for the whole menu; a
    dense ascending numbering of eight or more drops the rest and the numbers."""
    rows = page.annotated
    lines = [t for t, _ in rows]

    def closing(text: str) -> tuple[prices.Price, str] | None:
        whole = prices.read_line(text)
        if whole:
            return whole, ""
        m = prices.MARKED.search(text)
        minor = prices.plausible(prices.amount(m["amount"])) if m else None
        left = re.sub(r"(?:kr\.?|nok)\s*$", "", text[: m.start()], flags=re.I).strip() if minor is not None else ""
        if minor is None or prices.MARKED.search(left):
            return None
        return prices.Price(minor, "from" if m["from"] else "exact"), left

    items = []
    for at, line in enumerate(lines):
        end = closing(line)
        if end is None:
            continue
        price, left = end
        above = []
        for i in range(at - 1, max(-1, at - 13), -1):
            if closing(lines[i]):
                break
            if _title(lines[i]):
                above.append(i)
        numbered = next((i for i in above if _NUMBERED.fullmatch(lines[i])), None)
        head = numbered if numbered is not None else at if left and _title(left) else above[0] if above else None
        if head is None:
            continue
        name = left if head == at else lines[head]
        rest = list(dict.fromkeys([*lines[head + 1 : at], *([left] if left and head != at else [])]))
        items.append(Item(name, price.minor, head, 0.95, " ".join(rest) or None, price_kind=price.kind, excerpt=" — ".join(lines[head : at + 1])[:1000]))

    scope = next((i for i, t in enumerate(lines) if words.A_LA_CARTE.fullmatch(t)), None)
    if scope is not None:
        end = next((i for i in range(scope + 1, len(lines)) if words.NEXT_SCOPE.fullmatch(lines[i])), len(lines))
        inside = [replace(i, section=words.A_LA_CARTE_SECTION, confidence=0.99) for i in items if scope < i.position < end]
        items = inside if len(inside) >= 4 else items

    def section_of(item: Item) -> str | None:
        return item.section or next((t for t, lv in reversed(rows[: item.position]) if lv is not None and _title(t)), None)

    items = _by_key(with_section_identity(items, section_of))
    items = _dense_numbering(items) or items
    return items if len(items) >= 4 else []


def _dense_numbering(items: list[Item]) -> list[Item] | None:
    """The numbered items without their numbers, if these ascend from at most 5 and fill seven in ten of
    their span; contradicting repeats of a number spoil it."""
    by_number: dict[int, Item] = {}
    for item in items:
        m = _NUMBERED.fullmatch(item.name)
        if not m or not 1 <= int(m[1]) <= 300 or not _LETTER.search(m[2]):
            continue
        named = replace(item, name=m[2].strip())
        old = by_number.setdefault(int(m[1]), named)
        if (old.normalized, old.price_minor, old.price_kind) != (named.normalized, named.price_minor, named.price_kind):
            return None
    numbers = list(by_number)
    span = numbers[-1] - numbers[0] + 1 if numbers else 0
    if len(numbers) < 8 or any(b <= a for a, b in zip(numbers, numbers[1:], strict=False)) or numbers[0] > 5 or len(numbers) < 0.7 * span:
        return None
    return list(by_number.values())


def retitled(items: list[Item], rows: list[tuple[str, int | None]]) -> list[Item]:
    """Items that took a card's description for their name get the title right above it: a heading, or a
    short line. Only where at least two items and half of all can be retitled."""
    lines = [t for t, _ in rows]

    def title_of(item: Item) -> tuple[str, bool] | None:
        at = item.position
        if at < 1 or not (len(item.name.split()) >= 4 or item.name[-1] in ".!?" or item.description):
            return None
        above, headed = lines[at - 1], rows[at - 1][1] is not None
        if prices.INLINE.fullmatch(above) or not _title(above, 180, 8 if not headed else 16) or not_a_dish(above) or words.DESCRIPTION_LEAD.match(above) or not headed and _capitals(above):
            return None
        return (split_name(above)[0], headed) if normal_name(above) != item.normalized else None

    found = {n: t for n, i in enumerate(items) if (t := title_of(i))}
    if len(found) < 2 or 2 * len(found) < len(items):
        return items
    out = []
    for n, item in enumerate(items):
        if n in found:
            name, headed = found[n]
            text = ", ".join(x for x in (item.name, item.description) if x)
            item = replace(item, name=name, description=text, confidence=min(item.confidence, 0.86 if headed else 0.74), excerpt=f"{name} — {item.excerpt or ''}"[:1000])
        out.append(item)
    return _by_key(out)


def general_reading(page: Page) -> list[Item]:
    """The best reading of the food scope: numbered titles, else price blocks where they yield at least as
    much as plain lines, else plain lines."""
    rows = food_scope(page.annotated)
    numbered = numbered_items(rows)
    if numbered:
        return numbered
    scoped = Page("")
    scoped.__dict__["annotated"] = rows
    plain = retitled([i for i in plain_items(scoped) if not words.FOOD_SECTION.fullmatch(i.name)], rows)
    blocks = block_items(rows)
    return blocks if blocks and len(blocks) >= len(plain) else plain


# --- putting readings together ------------------------------------------------------------------


def supplement(items: list[Item], more: list[Item]) -> list[Item]:
    """``items`` and those of ``more`` whose names they lack."""
    seen, out = {i.normalized for i in items}, list(items)
    for item in more:
        if item.normalized not in seen:
            seen.add(item.normalized)
            out.append(item)
    return sorted(out, key=lambda i: i.position)


def upgrade_from(items: list[Item], found: list[Item]) -> list[Item]:
    """Names that occur once take the price that says ``from``; unknown names are added; names that occur
    several times stay as they are."""
    out = list(items)
    for item in found:
        same = [n for n, i in enumerate(out) if i.normalized == item.normalized]
        if not same:
            out.append(item)
        elif len(same) == 1:
            old = out[same[0]]
            out[same[0]] = replace(old, price_minor=item.price_minor, price_kind="from", price_max_minor=None, confidence=max(old.confidence, item.confidence), excerpt=item.excerpt or old.excerpt)
    return sorted(out, key=lambda i: i.position)


def clean_name(item: Item) -> Item:
    """Without index before a quantity, allergen codes, trailing price and delimiter."""
    name = re.sub(r"^\d{1,3}[.)]\s+(?=\d+\s+[^\W\d_])", "", item.name)
    name = re.sub(r"\s+\([A-Z0-9]{1,3}(?:\s*[,/+ ]\s*[A-Z0-9]{1,3})*\)$", "", name)
    name = re.sub(r"\s+[-–—]\s*(?:kr\.?\s*[1-9]\d{1,3}(?:[.,]\d{1,2})?|[1-9]\d{1,3}(?:[.,]\d{1,2})?\s*(?:,-|kr\.?|nok))$", "", name, flags=re.I)
    name = re.sub(r"\s*[|¦]\s*$", "", name).strip()
    return replace(item, name=name) if name else item


def is_item(item: Item) -> bool:
    name = "".join(c for c in item.name if unicodedata.category(c) != "Cf").strip()
    return bool(_LETTER.search(name)) and not any(p.search(name) for p in words.NOT_ITEM)


def outside_drinks(items: list[Item], lines: list[str]) -> list[Item]:
    """Drop items that only occur under drink headings: a running state over the lines marks each as
    food, drinks or unknown; evidence under food keeps an item."""
    state, evidence = "unknown", defaultdict(set)
    names = {i.normalized for i in items}
    for line in lines:
        label = _section_label(line)
        if words.DRINK_SECTION.fullmatch(label):
            state = "drinks"
        elif words.FOOD_SECTION.fullmatch(label) or words.MENU_LABEL.fullmatch(label):
            state = "food"
        text = normal_name(line)
        for name in names:
            if text == name or text.startswith(f"{name} "):
                evidence[name].add(state)
    return [i for i in items if evidence[i.normalized] != {"drinks"}]


def without_echoes(items: list[Item]) -> list[Item]:
    """Drop promotions that mirror at least three sections' own dishes, and the tail of a dish whose name
    starts with a number."""
    groups = defaultdict(list)
    for i in items:
        groups[i.normalized].append(i)
    priced = Counter((i.normalized, i.price_minor) for i in items if i.price_minor is not None)

    def mirrors(name: str, own: list[Item]) -> bool:
        sections = [normal_name(i.section or "") for i in own]
        return len(own) >= 3 and all(sections) and len(set(sections)) >= 3 and all(s != name and (s, i.price_minor) in priced for s, i in zip(sections, own, strict=True))

    promotions = {n for n, own in groups.items() if mirrors(n, own)}

    def tail(i: Item) -> bool:
        head = normal_name((i.excerpt or "").split(" — ")[0])
        return bool(re.match(r"\d+\s", head)) and head != i.normalized and head.endswith(f" {i.normalized}") and len(head) > len(i.normalized) + 2 and (head, i.price_minor) in priced

    return [i for i in items if i.normalized not in promotions and not tail(i)]


def extract(html: str | None) -> list[Item]:
    """All items of a page, in page order."""
    page = Page(html)
    structured = linked_data_items(page)
    if structured:
        return structured
    embedded = [i for i in embedded_items(page) if is_item(i)]
    if len(embedded) >= 4:
        return embedded
    cards = card_items(page)
    if cards:
        return without_echoes([i for i in map(clean_name, cards) if is_item(i)])
    plain, headed, wrapped, trailing = general_reading(page), heading_items(page), wrapped_items(page), trailing_items(page)
    if len(trailing) >= 8 and all(_NUMBERED.match(i.excerpt or "") for i in trailing):
        return without_echoes(outside_drinks([i for i in map(clean_name, trailing) if is_item(i)], page.lines))
    if trailing and (not plain or len(trailing) >= max(6, math.ceil(len(plain) * 1.5))):
        chosen = trailing
    elif headed and (not plain or len(headed) >= math.ceil(len(plain) * 0.75)):
        chosen = headed
    elif wrapped and len(wrapped) >= 2 * len(plain):
        chosen = wrapped
    else:
        chosen = plain
    chosen = supplement(chosen, plain)
    if len(headed) >= 4 and (not chosen or len(headed) >= math.ceil(len(chosen) * 0.5)):
        chosen = supplement(chosen, headed)
    for more in (marked_items(page), first_cards(page), wrapped):
        chosen = supplement(chosen, more)
    chosen = upgrade_from(chosen, from_items(page))
    return without_echoes(outside_drinks([i for i in map(clean_name, chosen) if is_item(i)], page.lines))


ITEM_SCHEMA = "source_key string, name string, normalized_name string, description string, section string, price_minor long, price_kind string, price_max_minor long, currency string, position int, method string, confidence double, excerpt string"


def _rows(items: list[Item]) -> list[tuple]:
    return [(i.key, i.name, i.normalized, i.description, i.section, i.price_minor, i.price_kind, i.price_max_minor, i.currency, i.position, i.method, i.confidence, i.excerpt) for i in items]


def extract_items(pages: DataFrame, id_col: str, html_col: str, finder=extract) -> DataFrame:
    """(id, item columns): one row per item of every page; pages without items give none. One Arrow
    stage, no shuffle."""
    names = [c.split()[0] for c in ITEM_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(id_col, pa.int64()), *[(c.split()[0], kinds[c.split()[1]]) for c in ITEM_SCHEMA.split(", ")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *row) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in _rows(finder(text))]
            yield pa.RecordBatch.from_pylist([dict(zip([id_col, *names], r, strict=True)) for r in rows], schema=schema)

    return pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(run, f"`{id_col}` long, {ITEM_SCHEMA}")
