"""Text functions as Column -> Column expressions; all stay inside code generation."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities that text columns hold in practice, and the patterns of links and handles.
BASIC_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&hellip;": "…", "&amp;": "&"}
LINK_OR_HANDLE = r"(?U)https?://\S+|@[\w_]+"
EMAIL = r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
LONG_NUMBER = r"(?U)\b(?:\d[ -]?){9,16}\b"
HANDLE = r"(?U)@[\w_]+"


def unescape_basic(text: Column) -> Column:
    """The basic entities decoded once, `&amp;` last, so that nothing is decoded twice."""
    for entity, char in BASIC_ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


#: A character reference as HTML readers take it: by number, or by a name of up to 32 characters.
REFERENCE = r"(&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?))"
#: The same, closed by its semicolon; what a cut text leaves open is no reference then.
CLOSED = REFERENCE.replace(";?", ";")
_ITEM, _PAIR = "\x01", "\x02"
#: Names of HTML 5 from Python's own table; those without a semicolon also hold as beginnings of a name, longest first.
_NAMED = _ITEM.join(f"{k}{_PAIR}{v}" for k, v in sorted(html5.items()))
_OPEN = _ITEM.join(f"{k}{_PAIR}{v}" for k, v in sorted(html5.items()) if not k.endswith(";"))
_BEGINNINGS = "^(" + "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))) + ")"
#: Numbers of the control range stand for what they are in code page 1252; 0 and 13 are themselves special.
_CONTROL = {0: "\ufffd", 13: "\r"} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


def _numbered(body: Column) -> Column:
    """The character of a reference's number, `#65` or `#x41`; what is no character is empty, what is out of range U+FFFD."""
    digits = F.regexp_replace(body, "^#[xX]?0*|;$", "")
    hexed = F.regexp_like(body, F.lit("^#[xX]"))
    n = F.when(digits == "", 0).when(F.length(digits) > 10, 1 << 40).when(hexed, F.conv(digits, 16, 10).cast("long")).otherwise(F.try_to_number(digits, F.lit("9999999999")).cast("long"))
    code = F.lpad(F.hex(n), 8, "0")
    special = F.element_at(F.str_to_map(F.lit(_ITEM.join(f"{k}{_PAIR}{v}" for k, v in _CONTROL.items())), F.lit(_ITEM), F.lit(_PAIR)), n.cast("string"))
    none = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
    outside = n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.coalesce(special, F.when(outside, "\ufffd").when(none, "").otherwise(F.decode(F.unhex(code), "UTF-32")))


def _referred(ref: Column, closed: bool) -> Column:
    """What one reference stands for; itself where it is none. Beginnings of names count unless closed."""
    name = F.substr(ref, F.lit(2))
    table = F.str_to_map(F.lit(_NAMED), F.lit(_ITEM), F.lit(_PAIR))
    head = F.regexp_extract(name, _BEGINNINGS, 1)
    out = F.when(name.startswith("#"), _numbered(name))
    for entity, char in BASIC_ENTITIES.items():
        out = out.when(ref == entity, char)
    if closed:
        return out.otherwise(F.coalesce(F.element_at(table, name), ref))
    named = F.coalesce(F.element_at(table, name), F.when(head != "", F.concat(F.element_at(F.str_to_map(F.lit(_OPEN), F.lit(_ITEM), F.lit(_PAIR)), head), F.substr(name, F.length(head) + 1))), ref)
    return out.otherwise(named)


def unescape(text: Column, closed: bool = False) -> Column:
    """All character references decoded once, by the whole table of HTML 5 and by number; only those with a semicolon if closed."""
    pattern = CLOSED if closed else REFERENCE
    rest = F.split(text, pattern, -1)
    decoded = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda r, i: F.concat(_referred(r, closed), F.get(rest, i + 1)))
    return F.when(F.contains(text, F.lit("&")), F.concat(F.get(rest, F.lit(0)), F.array_join(decoded, ""))).otherwise(text)


def bound(value: Column, use) -> Column:
    """use(value) with value worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def clean(text: Column, decode=unescape) -> Column:
    """Entities decoded; links and handles out; white space collapsed. Case is kept."""
    return collapse(F.regexp_replace(decode(text), LINK_OR_HANDLE, " "))


def tokens(text: Column, decode=unescape) -> Column:
    """Lower-cased Unicode words without links and handles."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(decode(text)), LINK_OR_HANDLE, " "), F.lit(r"(?U)(\w+)"), F.lit(1))


def normalized(text: Column, decode=unescape) -> Column:
    return F.array_join(tokens(text, decode), " ")


def shingles(words: Column, n: int = 3) -> Column:
    """Distinct word n-grams of a materialised array; a text of n words or fewer is one `short:` element."""
    size = F.size(words)
    grams = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(size < n + 1, F.array(F.concat(F.lit("short:"), F.array_join(words, " ")))).otherwise(F.array_distinct(grams))


def last_turns(context: Column, n: int = 4) -> Column:
    """The last n elements, fewer if there are fewer."""
    return F.slice(context, F.greatest(F.size(context) - (n - 1), F.lit(1)), n)


def input_text(context_texts: Column, message: Column, decode=unescape) -> Column:
    """The last four earlier texts, then the message twice, cleaned."""
    return clean(F.concat_ws(" ", F.array_join(last_turns(context_texts), " "), message, message), decode)


def privacy_redact(text: Column) -> Column:
    """E-mail addresses, then runs of 9 to 16 digits, then handles; the order matters."""
    text = F.regexp_replace(text, EMAIL, "[email redacted]")
    text = F.regexp_replace(text, LONG_NUMBER, "[number redacted]")
    return F.regexp_replace(text, HANDLE, "[user]")


#: All that counts as white space, for Spark and for SQL alike.
WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
# The patterns and the two replacement phrases of these edits, in their order, and whether the case of letters counts.
POLISH = (
    (rf"^(?:@user|\[user\]){WHITE}*[:,\-]?{WHITE}*", "", False),
    (r"\b(?:take a look|check (?:this|it) out) backstage\b", "take a closer look privately", False),
    (r"\bbackstage\b", "privately", False),
    (rf"{WHITE}+(?:/|\^|—{WHITE}*)[A-Z]{{1,3}}{WHITE}*\z", "", True),
    (r"!{2,}", "!", True),
    (r"[ \t]+", " ", True),
)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+\z", "")


def polish(text: Column) -> Column:
    """Surface edits of a draft, in order: placeholder, jargon, signature, exclamation marks, blanks."""
    text = strip(text)
    for pattern, by, case in POLISH:
        text = F.regexp_replace(text, ("(?U)" if case else "(?iU)") + pattern, by)
    return strip(text)


def was_polished(text: Column) -> Column:
    return polish(text) != strip(text)


def non_ascii_ratio(text: Column) -> Column:
    """Share of code points above 127; 0 for an empty text."""
    return F.when(F.length(text) == 0, 0.0).otherwise(F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / F.length(text))


def distinct_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """How many terms stand in the text as whole tokens."""
    hits = [F.regexp_like(text, F.lit(r"(?U)(?<!\w)\Q" + t + r"\E(?!\w)")).cast("int") for t in terms]
    return sum(hits[1:], hits[0]) if hits else F.lit(0)


def occurrences(text: Column, signs: tuple[str, ...]) -> Column:
    """All occurrences of all signs; a sign that is part of another counts for both."""
    each = [((F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))) / len(s)).cast("int") for s in signs]
    return sum(each[1:], each[0]) if each else F.lit(0)


def emphatic(text: Column) -> Column:
    return F.contains(text, F.lit("!!!")) | F.regexp_like(text, F.lit(r"(?U)\b[A-Z]{5,}\b"))


def archive_time(text: Column) -> Column:
    """`Tue Oct 31 22:10:47 +0000 2017` as a timestamp; the weekday is not parsed. Null where it does not fit."""
    return F.try_to_timestamp(F.regexp_replace(text, r"^\w{3} ", ""), F.lit("MMM dd HH:mm:ss Z yyyy"))


def id_list(text: Column) -> Column:
    """A comma-separated list, trimmed, without empty items."""
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")


def short_id(*parts: Column) -> Column:
    """First twelve hex digits of the SHA-256 of the parts joined."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 12)


def content_hash(*columns: str) -> Column:
    """SHA-256 of the named columns as JSON, names in order, so that it does not follow their place."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
