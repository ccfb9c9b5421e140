"""Native text expressions: Column in, Column out, no Python in the executors.

White space means what Python calls white space, which Java's ``\\s`` does not;
``WS`` is that class for Java patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)[\s\x1c-\x1f]"
#: Name prefixes of inline XBRL elements.
IXBRL_PREFIXES = ("ix:", "xbrli:", "xbrldi:", "xbrldt:", "link:", "xlink:", "iso4217:", "dei:", "us-gaap:", "srt:", "country:")
_XBRL_URI = r'"[^"]*(?:xbrl|ixbrl|fasb|sec\.gov)[^"]*"'
_XMLNS = rf"(?i){WS[4:]}+xmlns(?::[a-zA-Z0-9_-]+)?={_XBRL_URI}"
#: Inline styles that hide an element.
HIDDEN_STYLES = (
    r"display\s*:\s*none",
    r"visibility\s*:\s*hidden",
    r"font-size\s*:\s*0(?:px|pt|em|rem)?(?:\s|;|$)",
    r"height\s*:\s*0(?:px)?(?:\s|;|$)",
    r"width\s*:\s*0(?:px)?(?:\s|;|$)",
    r"opacity\s*:\s*0(?:\.0+)?(?:\s|;|$)",
    r"position\s*:\s*absolute(?s:.*?)(?:left|top)\s*:\s*-\d+",
)
HIDDEN_STYLE = "(?i)" + "|".join(HIDDEN_STYLES)


def strip(c: Column) -> Column:
    """Without white space at both ends (Spark's ``trim`` knows the space only)."""
    return F.regexp_replace(c, rf"{WS[:4]}^{WS[4:]}+|{WS[4:]}+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


# -- keys -------------------------------------------------------------------------------------------------------------


def normalize_cik(c: Column) -> Column:
    """Ten digits with leading zeros; longer keys stay as they are."""
    bare = F.ltrim(c, F.lit("0"))
    return F.when(F.length(bare) < 10, F.lpad(bare, 10, "0")).otherwise(bare)


def _form(c: Column) -> tuple[Column, Column]:
    up = F.replace(F.upper(strip(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit(""))
    base = F.regexp_replace(up, r"/A\z", "")
    dashed = F.when(base.isin("10K", "10-K"), "10-K").when(base.isin("10Q", "10-Q"), "10-Q").when(base.isin("8K", "8-K"), "8-K").otherwise(base)
    return dashed, up.endswith("/A")


def normalize_form(c: Column) -> Column:
    """Form type for matching: dashed, upper case, the amendment mark kept."""
    base, amended = _form(c)
    return F.when(amended, F.concat(base, F.lit("/A"))).otherwise(base)


def section_form(c: Column) -> Column:
    """Form type for sections: the amendment mark dropped."""
    return _form(c)[0]


def dashed_accession(c: Column) -> Column:
    """Eighteen digits as 10-2-6; anything else without its dashes."""
    bare = F.replace(c, F.lit("-"), F.lit(""))
    return F.when(F.length(bare) == 18, F.concat_ws("-", F.substring(bare, 1, 10), F.substring(bare, 11, 2), F.substring(bare, 13, 6))).otherwise(bare)


def slugify(c: Column, limit: int = 30) -> Column:
    """Lower-case words joined by underscores, cut at the last underscore inside ``limit``."""
    t = F.replace(F.replace(F.lower(c), F.lit(" and "), F.lit("_")), F.lit("&"), F.lit("_"))
    t = F.regexp_replace(F.regexp_replace(t, rf"{WS[:4]}[^a-z0-9_\s\x1c-\x1f]", ""), WS + "+", "_")
    t = F.regexp_replace(F.regexp_replace(t, "^_+|_+$", ""), "_+", "_")
    head = F.substring(t, 1, limit)
    return F.when(F.length(t) <= limit, t).when(head.contains("_"), F.regexp_replace(head, "_[^_]*$", "")).otherwise(head)


def section_id(form: Column, part: Column, item: Column, title: Column) -> Column:
    """Id of a section; empty pieces leave no trace."""
    f = section_form(form)
    slug = F.nullif(slugify(F.coalesce(title, F.lit(""))), F.lit(""))
    named_part = F.concat(F.lit("part"), F.lower(F.nullif(part, F.lit(""))))
    named_item = F.concat(F.lit("item"), F.lower(item))
    periodic = F.concat_ws("_", F.when(f == "10-K", "10k").otherwise("10q"), named_part, named_item, slug)
    current = F.concat_ws("_", F.concat(F.lit("8k_item_"), F.replace(item, F.lit("."), F.lit("_"))), slug)
    other_item = F.concat(F.lit("item"), F.lower(F.nullif(item, F.lit(""))))
    other = F.concat_ws("_", F.nullif(F.regexp_replace(F.lower(f), "[^a-z0-9]+", ""), F.lit("")), named_part, other_item, slug)
    return F.when(f.isin("10-K", "10-Q"), periodic).when(f == "8-K", current).otherwise(other)


def clean_title(c: Column) -> Column:
    """One space between words, glued words parted, at most 100 characters, cut at the last space."""
    t = F.regexp_replace(collapse(c), "([a-z0-9])([A-Z])", "$1 $2")
    head = F.substring(t, 1, 100)
    return F.when(F.length(t) <= 100, t).when(head.contains(" "), F.regexp_replace(head, "(?s) [^ ]*$", "")).otherwise(head)


# -- markup -----------------------------------------------------------------------------------------------------------


def strip_ixbrl(c: Column) -> Column:
    """Inline XBRL tags and declarations removed, their text kept; the document's own prefixes join the fixed ones."""
    declared = F.transform(F.regexp_extract_all(c, F.lit(rf"(?i)xmlns:([a-zA-Z0-9_-]+)={_XBRL_URI}"), F.lit(1)), lambda p: F.concat(p, F.lit(":")))
    names = F.array_join(F.array_distinct(F.concat(F.array(*map(F.lit, IXBRL_PREFIXES)), declared)), "|")
    bare = F.regexp_replace(c, F.concat(F.lit("(?i)</?(?:"), names, F.lit(")[^>]*>")), F.lit(""))
    return F.regexp_replace(F.regexp_replace(bare, _XMLNS.replace("(?i)", "(?iU)"), ""), "  +", " ")


def has_ixbrl(c: Column) -> Column:
    """Any sign of inline XBRL; plain substrings, so ``matrix:`` counts too."""
    low = F.lower(c)
    return low.contains("ix:") | low.contains("xbrli:") | low.contains("inline xbrl") | c.rlike(_XMLNS.replace("(?i)", "(?iU)"))


def is_hidden_style(c: Column) -> Column:
    return F.coalesce(c.rlike(HIDDEN_STYLE), F.lit(False))




#: Element renames and elements whose tags are dropped.
RENAMED = (("b", "strong"), ("i", "em"), ("u", "em"), ("tt", "code"), ("kbd", "code"), ("samp", "code"), ("var", "code"))
UNWRAPPED = ("s", "strike", "del", "ins", "mark", "small", "big", "font", "center")


def semantic_tags(c: Column) -> Column:
    """Presentational tags renamed or dropped; links are left to :func:`sectora.functions.html.absolute_links`."""
    for old, new in RENAMED:
        c = F.regexp_replace(F.regexp_replace(c, rf"(?i)<\s*{old}\b", f"<{new}"), rf"(?i)</\s*{old}\s*>", f"</{new}>")
    any_tag = "|".join(UNWRAPPED)
    return F.regexp_replace(F.regexp_replace(c, rf"(?i)<\s*(?:{any_tag})\b[^>]*>", ""), rf"(?i)</\s*(?:{any_tag})\s*>", "")


def unwrap_dead_links(c: Column) -> Column:
    """Links without target or with a script as target become their text."""
    return F.regexp_replace(c, r"""(?is)<a\b[^>]*href=["'](?:\s*|javascript:[^"']*)["'][^>]*>(.*?)</a>""", "$1")






def escape_block(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attr(c: Column) -> Column:
    return F.replace(escape_block(c), F.lit('"'), F.lit("&quot;"))


def escape_html(c: Column) -> Column:
    """As :func:`html.escape` with quotes."""
    return F.replace(escape_attr(c), F.lit("'"), F.lit("&#x27;"))


# -- tokens, hashes, times --------------------------------------------------------------------------------------------


def estimate_tokens(c: Column) -> Column:
    """A quarter of the code points, rounded down."""
    return F.floor(F.length(c) / 4).cast("long")


def truncate_tokens(c: Column, tokens: int) -> Column:
    return F.substring(c, 1, 4 * tokens)


def chunk_id(section: Column, index: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", section, index.cast("string"), collapse(F.lower(text))), 256), 1, 16)


def period(start: Column, end: Column) -> Column:
    s, e = F.nullif(start, F.lit("")), F.nullif(end, F.lit(""))
    return F.when(s.isNotNull() & e.isNotNull(), F.concat_ws("/", s, e)).when(e.isNotNull(), e).otherwise("unknown")


def stable_time(filing_date: Column) -> Column:
    """Midnight of the filing date (session time zone UTC)."""
    return filing_date.cast("timestamp")


def decode_bytes(c: Column) -> Column:
    """UTF-8, and Latin-1 where the bytes are not UTF-8."""
    return F.coalesce(F.try_validate_utf8(c.cast("string")), F.decode(c, "ISO-8859-1"))
