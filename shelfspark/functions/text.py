"""Text cleaning, tokens and brand inference."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def squeeze(c: Column) -> Column:
    """White space of any kind as single spaces, none at the ends; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))


def strip_edges(c: Column, chars: str) -> Column:
    """Without any of `chars` at either end."""
    return F.btrim(c, F.lit(chars))


def clean_spaces(c: Column) -> Column:
    return strip_edges(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "), " -|,/")


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    """HTML entities; the table of names has no column expression."""
    return s.map(html.unescape, na_action="ignore")


def clean_string(c: Column, entities: bool = True) -> Column:
    """Entities resolved, control characters and white space as single spaces.

    Only rows that hold an ampersand reach the Python worker's work; without `entities` everything stays in the JVM.
    """
    c = F.coalesce(c.cast("string"), F.lit(""))
    c = unescape_html(c) if entities else c
    return squeeze(F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", " "))


def drop_tags(c: Column) -> Column:
    """Scripts, styles and tags as spaces."""
    for pattern in (r"(?i)<script[\s\S]*?</script>", r"(?i)<style[\s\S]*?</style>", r"<[^>]+>"):
        c = F.regexp_replace(c, pattern, " ")
    return c


def strip_html(c: Column, entities: bool = True) -> Column:
    return clean_string(drop_tags(F.coalesce(c, F.lit(""))), entities)


# What a listing puts before a title.
TITLE_NOISE = [r"(?i)^last\s+purchased\s*", r"(?i)^(?:\d+[\d,]*\s*(?:case|pack|ct|count)\s*)+", r"(?i)^(?:\d+\s+sizes?\s*)+", r"(?i)^(?:\d+\s+colors?\s*)+"]


def clean_title(c: Column) -> Column:
    """A listing title without purchase notes and leading counts."""
    for pattern in TITLE_NOISE:
        c = F.regexp_replace(c, pattern, "")
    return strip_edges(F.regexp_replace(c, r"(?U)\s+", " "), " -|")


def name_key(c: Column) -> Column:
    """Lower-case letters, digits and spaces only."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))


def word_key(c: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"(?U)[^\w\s]", " "))


def tokens(c: Column) -> Column:
    """Distinct words of at least two characters of a word key."""
    return F.array_distinct(F.filter(F.split(word_key(c), " "), lambda x: F.length(x) >= 2))


def match_tokens(c: Column) -> Column:
    """Distinct runs of lower-case letters and digits, three at least; an upper-case letter ends a run."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([a-z0-9]+)"), F.lit(1)), lambda x: F.length(x) >= 3))


def clean_markdown(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"!\[[^\]]*\]\([^)]+\)", "")
    c = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return squeeze(F.regexp_replace(c, "[*_`#>]+", " "))


def card_sku(body: Column) -> Column:
    """The first line of a card that is a code and not a button."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), r"\r\n|\r|\n"), clean_markdown)
    codes = F.filter(lines, lambda x: x.rlike(r"(?i)^[A-Z0-9][A-Z0-9._-]{1,30}$") & ~F.lower(x).isin("add to wish list", "in cart", "add to cart"))
    return F.coalesce(F.get(codes, 0), F.lit(""))


def brand_case(c: Column) -> Column:
    """Words of four characters or fewer, or all upper case, in upper case; others capitalised after each non-letter."""
    title = lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(r"((?U)\p{L}+|\P{L}+)"), F.lit(1)), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")
    words = F.filter(F.split(c, " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) <= 4) | ((F.upper(w) == w) & (F.lower(w) != w)), F.upper(w)).otherwise(title(w))), " ")


# Names of suppliers that aren't brands, and brands that open a title.
GENERIC_SUPPLIERS = ["rego trading inc", "supplier", "wholesaler"]
TITLE_BRANDS = [
    r"^(TOOTSIE ROLL(?: POP DROPS)?|TOOTSIE POPS?)\b",
    r"^(WHATCHAMACALLIT)\b",
    r"^(WHOPPERS)\b",
    r"^(WACKY WAFERS)\b",
    r"^(WACK-O-WAX)\b",
    r"^(SWEDISH FISH)\b",
    r"^(ZOTZ)\b",
    r"^(ZEBRA BARS)\b",
    r"^(SUGAR DADDY)\b",
    r"^(SUPER MARIO)\b",
    r"^(KRAFT|NESTL[EÉ]|GENERAL MILLS|KELLOGG|MONDELEZ|TYSON|HORMEL|HEINZ|PEPSI|COCA[\s\-]?COLA)\b",
    r"^(SYSCO|US FOODS|FOOD SERVICE|RESTAURANT DEPOT)\b",
    r"^(PROCTER[\s\-]?GAMBLE|P[\s\-]?&[\s\-]?G)\b",
    r"^(UNILEVER|JOHNSON[\s\-]?&[\s\-]?JOHNSON|J[\s\-]?&[\s\-]?J)\b",
    r"^(CAMPBELL|DELMONTEFOODS|CONAGRA)\b",
    r"^(CLOROX|LYSOL|BOUNTY|CHARMIN)\b",
    r"^(FRITO[\s\-]?LAY|LAY[\s\-]?S|DORITOS|CHEETOS|TOSTITOS)\b",
    r"^(RED BULL|MONSTER|ENERGY|GATORADE|POWERADE)\b",
]
SKU_BRANDS = {"SYS": "SYSCO", "USF": "US FOODS", "K-": "KRAFT", "N-": "NESTLE"}


def title_brand(title: Column) -> Column:
    """A known brand that opens the title, else its leading run of plain characters if that has four words at most."""
    t = F.upper(clean_spaces(title))
    known = F.coalesce(*(F.nullif(F.regexp_extract(t, "(?i)" + p, 1), F.lit("")) for p in TITLE_BRANDS))
    lead = clean_spaces(F.regexp_extract(t, r"^([A-Z0-9&\-\.\' ]{3,30})\b", 1))
    lead = F.when(F.size(F.filter(F.split(lead, " "), lambda w: w != "")) <= 4, lead).otherwise("")
    return brand_case(F.coalesce(F.nullif(clean_spaces(known), F.lit("")), lead))


def sku_brand(sku: Column) -> Column:
    s, out = F.upper(F.trim(F.coalesce(sku, F.lit("")))), F
    for i, (prefix, brand) in enumerate(SKU_BRANDS.items()):
        out = (F if i == 0 else out).when(s.startswith(prefix), brand)
    return out.otherwise("")


def normal_title(title: Column) -> Column:
    return clean_spaces(F.regexp_replace(clean_spaces(title), r"(?i)\bReGo Trading Inc\b", ""))


def case_count(title: Column) -> Column:
    t = F.coalesce(title, F.lit(""))
    return F.coalesce(*(F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"(?i)\b(?:case of|pack of|count of)\s*(\d+)\b", r"(?i)\b(\d+)\s*(?:pack|pk|count|ct)\b")), F.lit(""))


def ordered_texts(*parts: tuple[Column, Column]) -> Column:
    """The texts whose condition holds, trimmed, non-empty, each once, in order."""
    return F.array_distinct(F.filter(F.array(*(F.when(ok, F.trim(text)) for ok, text in parts)), lambda x: x.isNotNull() & (x != "")))


def lookup_queries(brand: Column, name: Column, size: Column, case: Column, sku: Column) -> Column:
    """Search texts for a product, most specific first."""
    b, n, p, c, s = (F.trim(F.coalesce(x, F.lit(""))) for x in (brand, name, size, case, sku))
    has = lambda *xs: F.least(*(x != "" for x in xs), F.lit(True)) if len(xs) > 1 else xs[0] != ""
    say = lambda *xs: F.concat_ws(" ", *xs)
    return ordered_texts(
        (has(b, n, p), say(b, n, p)), (has(b, n, c), say(b, n, F.lit("case"), c)), (has(b, n), say(b, n)), (has(n, p), say(n, p)),
        (has(n, c), say(n, F.lit("case"), c)), (has(b, s, n), say(b, s, n)), (has(n), n), (has(b, s), say(b, s)),
    )


def retail_queries(brand: Column, name: Column, size: Column, case: Column) -> Column:
    b, n, p, c = (F.trim(F.coalesce(x, F.lit(""))) for x in (brand, name, size, case))
    both = lambda x, y: (x != "") & (y != "")
    gap = lambda *xs: F.concat_ws(" ", *(F.nullif(x, F.lit("")) for x in xs))
    return ordered_texts((F.lit(True), gap(b, n, p)), (both(b, n), gap(b, n)), (both(n, p), gap(n, p)), (both(c, n), gap(n, c, F.lit("count"))), (n != "", n))


# What divides or opens the name of a category.
CATEGORY_SEPARATORS = [" : ", " > ", " / ", " | "]
CATEGORY_PREFIXES = ["shop all", "view all", "see all", "browse all", "shop ", "browse ", "all "]


def is_category_name(name: Column) -> Column:
    low = F.lower(F.trim(name))
    divided = F.greatest(*(F.contains(name, F.lit(s)) for s in CATEGORY_SEPARATORS))
    opened = F.greatest(*(low.startswith(p) for p in CATEGORY_PREFIXES))
    return F.coalesce((name != "") & (divided | opened | low.rlike(r"\d+\s*products?\b") | F.trim(name).rlike(r"\(\d+\)\s*$") | low.rlike(r"\d+\s*items?\b")), F.lit(False))


def detail_name(c: Column, site: str = "Nassau Candy") -> Column:
    """A detail page's title without the site's name after a bar, in single spaces."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)\s*\|\s*{site}\s*$", "")
    return strip_edges(F.regexp_replace(bare, r"(?U)\s+", " "), " -|")


def label_key(c: Column) -> Column:
    """Lower case; colons, full stops and white space as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[:.\s]+", " "))


def unit_size_or_pack(unit_size: Column, pack_size: Column) -> Column:
    """The unit size; where it is empty, a pack size that is one number and unit, in upper case."""
    pack = F.trim(F.coalesce(pack_size, F.lit("")))
    whole = pack.rlike(r"(?i)^\d+(?:\.\d+)?\s*(?:OZ|FL OZ|LB|G|CT|ML)$")
    return F.when(F.trim(F.coalesce(unit_size, F.lit(""))) != "", unit_size).when(whole, F.replace(F.upper(pack), F.lit("  "), F.lit(" "))).otherwise(F.coalesce(unit_size, F.lit("")))


def run_label(url: Column, at: Column) -> Column:
    """A run's name: the site and the time."""
    from .url import netloc

    return F.concat(F.regexp_replace(netloc(url), r"^www\.", ""), F.lit(" \u2014 "), F.date_format(at, "HH:mm dd/MM/yyyy"))
