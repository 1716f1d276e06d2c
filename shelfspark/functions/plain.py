"""Some of the column functions for single texts, where a page's tree is walked in Python."""

from __future__ import annotations

import re

from .text import CATEGORY_PREFIXES, CATEGORY_SEPARATORS, TITLE_NOISE

MONEY = re.compile(r"\$\s*\d[\d,]*(?:\.\d{2})?")


_NOISE = [re.compile(p) for p in TITLE_NOISE]
_SPACES, _COUNTED, _LAST_COUNT = re.compile(r"\s+"), re.compile(r"\d+\s*products?\b|\d+\s*items?\b"), re.compile(r"\(\d+\)\s*$")


def squeeze(s: str | None) -> str:
    return " ".join((s or "").split())


def clean_title(s: str) -> str:
    for pattern in _NOISE:
        s = pattern.sub("", s)
    return _SPACES.sub(" ", s).strip(" -|")


def is_category_name(s: str) -> bool:
    low = s.strip().lower()
    counted = _COUNTED.search(low) or _LAST_COUNT.search(s.strip())
    return bool(s) and (any(x in s for x in CATEGORY_SEPARATORS) or low.startswith(tuple(CATEGORY_PREFIXES)) or bool(counted))


def code_digits(s: str | None) -> str:
    """8 to 14 digits once white space and hyphens are gone, else ''."""
    d = re.sub(r"[\s\-]", "", s or "")
    return d if re.fullmatch(r"[0-9]{8,14}", d) else ""


def plain_dollars(s: str | None) -> str:
    """The first $ amount without commas, else ''."""
    m = re.search(r"\$\s*(\d[\d,]*(?:\.\d{2})?)", s or "")
    return f"${m[1].replace(',', '')}" if m else ""


def is_catalog_sku(s: str | None) -> bool:
    from .ids import GENERATED

    s = (s or "").strip()
    return 3 <= len(s) <= 25 and bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9\-./]*", s)) and bool(re.search(r"\d", s)) and not re.search(GENERATED, s)


def is_detail_sku(s: str | None) -> bool:
    s = (s or "").strip()
    uuid = re.fullmatch(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", s)
    return 2 <= len(s) <= 32 and not uuid and bool(re.search(r"\d", s)) and bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9\-./ ]*", s))
