"""Text functions as column expressions; pandas UDFs only for Unicode normal forms."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TRIGRAM_THRESHOLD = 0.3


def _normal_form(form: str):
    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return run


def nfkc(text: Column) -> Column:
    return _normal_form("NFKC")(text)


def nfkd(text: Column) -> Column:
    return _normal_form("NFKD")(text)


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def dish_name(text: Column, unicode: bool = True) -> Column:
    """The normalised dish name: NFKC, lower case, anything but letters and digits as one space.

    ``unicode=False`` leaves NFKC out and stays in the JVM, for text that is known to be in that form.
    """
    return F.trim(F.regexp_replace(F.lower(nfkc(text) if unicode else text), r"[^\p{L}\p{N}]+", " "))


def optional_text(text: Column, unicode: bool = True) -> Column:
    """NFKC and squeezed; blank becomes null."""
    clean = squeeze(nfkc(text) if unicode else text)
    return F.when(clean != "", clean)


def discovery_text(text: Column, unicode: bool = True) -> Column:
    """Accents stripped, lower case, anything but a-z and 0-9 as one space. Letters that have no
    decomposition (o with stroke, ae) become spaces, as classification expects."""
    base = F.coalesce(text, F.lit(""))
    plain = F.regexp_replace(nfkd(base) if unicode else base, "[̀-ͯ]", "")
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def display_text(text: Column, unicode: bool = True) -> Column:
    """The page-side normaliser: marks stripped, ae, o and a for the three Norwegian letters."""
    base = F.lower(F.coalesce(text, F.lit("")))
    mapped = F.replace(F.replace(F.replace(base, F.lit("æ"), F.lit("ae")), F.lit("ø"), F.lit("o")), F.lit("å"), F.lit("a"))
    plain = F.regexp_replace(nfkd(mapped) if unicode else mapped, r"\p{M}", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def scope_slug(text: Column, unicode: bool = True) -> Column:
    plain = F.regexp_replace(nfkd(text) if unicode else text, r"\p{M}", "")
    return F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded by two spaces in front and one behind."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")

    def grams(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def trigram_list(text: str) -> list[str]:
    """``trigrams`` of a literal, on the driver."""
    found: dict[str, None] = {}
    for w in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        padded = f"  {w} "
        found |= dict.fromkeys(padded[i : i + 3] for i in range(len(w) + 1))
    return list(found)


def trigram_overlap(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two trigram arrays; 0 where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - shared
    return F.when(whole > 0, shared / whole).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    return trigram_overlap(trigrams(a), trigrams(b))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def source_key(name: Column, section: Column, unicode: bool = True) -> Column:
    """Identity of a menu item: digest of its normalised section and name."""
    return sha256(F.concat(dish_name(F.coalesce(section, F.lit("")), unicode), F.char(F.lit(0)), dish_name(name, unicode)))


def canonical_name(name: Column) -> Column:
    """A dish name without menu number, allergen letters in brackets and portion suffix."""
    clean = F.regexp_replace(name, r"^\s*\d+[.)-]\s*", "")
    clean = F.regexp_replace(clean, r"\s*\([A-ZÆØÅ](?:\s*,\s*[A-ZÆØÅ])*\)\s*$", "")
    clean = squeeze(F.regexp_replace(clean, r"(?i)\s+\d+\s*(?:stk|biter|pieces?|g|gram)\s*$", ""))
    return F.when(clean != "", clean).otherwise(F.trim(name))


def canonical_identity(name: Column, unicode: bool = True) -> Column:
    """The normalised canonical name with two spelling variants folded."""
    base = dish_name(canonical_name(name), unicode)
    return F.regexp_replace(F.regexp_replace(base, r"^adamame\b", "edamame"), r"^marg?erita\b", "margherita")


def price_minor(text: Column) -> Column:
    """Minor units of a written price: kr or NOK and a trailing ``,-`` are ignored, comma or point
    starts the decimals; anything else is null."""
    compact = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", ""), r"(?i)NOK|kr\.?", ""), ",-$", "")
    shape = r"^(\d{1,5})(?:[.,](\d{1,2}))?$"
    whole, decimals = F.regexp_extract(compact, shape, 1), F.regexp_extract(compact, shape, 2)
    return F.when(compact.rlike(shape), whole.cast("long") * 100 + F.rpad(decimals, 2, "0").cast("long"))


def price_notation(text: Column) -> Column:
    """``/-`` and a trailing ``-`` after a digit are written ``,-``."""
    return F.regexp_replace(F.regexp_replace(text, r"(\d)\s*/-", r"$1,-"), r"(\d)-$", r"$1,-")


def plausible_price(minor: Column, low: int = 4_000, high: int = 1_000_000) -> Column:
    return minor.between(low, high)


def split_name(text: Column) -> Column:
    """struct(name, description): cut at the first comma if that lies between characters 3 and 120;
    a menu number in front goes."""
    base = F.trim(F.regexp_replace(F.trim(text), r"^\d{1,3}\s*[.)]\s*", ""))
    at = F.instr(base, ",") - 1
    cut = (at >= 3) & (at <= 120)
    rest = F.trim(F.substring(base, at + 2, F.length(base)))
    return F.struct(F.when(cut, F.trim(F.substring(base, F.lit(1), at))).otherwise(base).alias("name"), F.when(cut & (rest != ""), rest).alias("description"))


def composition(text: Column, most: int = 6) -> Column:
    """The first distinct parts of a description, cut at ``& · , ; +``, of 2 to 48 characters."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[&·,;+]"), lambda p: F.trim(p))
    return F.slice(F.array_distinct(F.filter(parts, lambda p: F.length(p).between(2, 48))), 1, most)


def phrase_match(a: Column, b: Column) -> Column:
    """True if one text equals the other or contains it as whole words."""
    return (a == b) | F.concat(F.lit(" "), a, F.lit(" ")).contains(F.concat(F.lit(" "), b, F.lit(" ")))


def dominant_script(text: Column) -> Column:
    """The script with most letters in ``text``; null without letters, ties in the order listed."""
    scripts = ("Latin", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Thai")
    counts = F.array(*[F.struct(F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")).alias("n"), F.lit(-i).alias("order"), F.lit(s).alias("script")) for i, s in enumerate(scripts)])
    top = F.array_max(counts)
    return F.when(top["n"] > 0, top["script"])


def excerpt(parts: list[Column], most: int = 1000) -> Column:
    return F.substring(F.concat_ws(" — ", *parts), 1, most)


def price_label(kind: Column, minor: Column, top: Column) -> Column:
    """``kr 225``, ``fra kr 95`` or ``kr 285-309``; null without a price."""

    def crowns(x: Column) -> Column:
        return F.when(x % 100 == 0, (x / 100).cast("long").cast("string")).otherwise(F.format_string("%.2f", x / 100.0))

    label = F.when(kind == "multiple", F.concat(F.lit("kr "), crowns(minor), F.lit("-"), crowns(top))).when(kind == "from", F.concat(F.lit("fra kr "), crowns(minor)))
    return F.when(minor.isNotNull(), label.otherwise(F.concat(F.lit("kr "), crowns(minor))))


# The blocks of addresses that are not public unicast.
RESERVED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.31.196.0/24", "192.52.193.0/24", "192.88.99.0/24", "192.168.0.0/16",
    "192.175.48.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
RESERVED_V6 = (
    "::/128", "::1/128", "::ffff:0:0/96", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "2620:4f:8000::/48", "3fff::/20", "5f00::/16", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8",
)
# End of fixed values.


def public_host(host: str) -> bool:
    """Whether a host of a URL may be fetched as far as its spelling tells: a name of several labels that
    is not local, or a public unicast address in any notation that URLs allow for it."""
    host = host.lower().rstrip(".")
    if host.startswith("["):
        try:
            address = ipaddress.IPv6Address(host.strip("[]"))
        except ValueError:
            return False
        return address in ipaddress.ip_network("2000::/3") and not any(address in ipaddress.ip_network(n) for n in RESERVED_V6)
    labels = host.split(".")
    if re.fullmatch(r"0x[0-9a-f]*|[0-9]+", labels[-1]):  # an address, however it is written
        try:
            parts = [int(x, 16) if x.startswith("0x") else int(x, 8) if x.startswith("0") and len(x) > 1 else int(x) for x in labels]
        except ValueError:
            return False
        if len(parts) > 4 or any(x > 255 for x in parts[:-1]) or parts[-1] >= 256 ** (5 - len(parts)):
            return False
        address = ipaddress.IPv4Address(sum(x << 8 * (3 - i) for i, x in enumerate(parts[:-1])) + parts[-1])
        return not any(address in ipaddress.ip_network(n) for n in RESERVED_V4)
    return len(labels) > 1 and all(labels) and labels[-1] not in ("localhost", "local", "internal")


def _public_hosts(host: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(hosts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in hosts:
            known = {h: public_host(h) for h in s.dropna().unique()}
            yield s.map(lambda h: known.get(h, False)).astype(bool)

    return run(host)


def public_url(url: Column) -> Column:
    """The checks of a fetchable URL that need no name lookup: http or https, no user part, a host that
    is neither local nor a private or reserved address. Anything that is no such URL is false."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^https?://([^/?#\\]*)", 1)
    host = F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:\[\]]*)(?::[0-9]{0,5})?$", 1)
    fine = (authority != "") & ~authority.contains("@") & (host != "")
    plain = host.rlike(r"^(?i)[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z][a-z0-9-]*$") & ~host.rlike(r"(?i)\.(localhost|local|internal)$")
    return F.when(~fine, F.lit(False)).when(plain, F.lit(True)).otherwise(_public_hosts(F.when(fine & ~plain, host)))


def json_kind(text: Column) -> Column:
    """object, array, string, number, boolean or null: the kind of a JSON value; null for what is none."""
    schema = F.schema_of_variant(F.try_parse_json(text))
    return (
        F.when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null")
        .when(schema.isNotNull(), "number")
    )
