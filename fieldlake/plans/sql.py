"""Building blocks of the DuckDB check queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from fieldlake.functions import text as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function with its check query."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    """A WITH member holding literal rows."""
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def strip(x: str) -> str:
    return f"trim({x}, {lit(T.WHITESPACE)})"


def clean(x: str, entities: bool = False) -> str:
    """The cleaning chain; `entities` decodes the named entities that occur in the pages."""
    t = f"regexp_replace({x}, '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    if entities:
        for name, ch in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
            t = f"replace({t}, {lit(name)}, {lit(ch)})"
    t = f"regexp_replace({t}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')"
    t = f"regexp_replace({t}, '\\r\\n?', chr(10), 'g')"
    t = f"regexp_replace({t}, '[ \\t\\f\\x0B]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(t)


def _mapped(pairs: dict[str, str]) -> str:
    """A map literal; code points keep odd characters out of the statement."""
    def text(v: str) -> str:
        return " || ".join(lit(c) if c.isascii() and c.isprintable() else f"chr({ord(c)})" for c in v) if not v.isalnum() or not v.isascii() else lit(v)

    return f"MAP([{', '.join(text(k) for k in pairs)}], [{', '.join(text(v) for v in pairs.values())}])"


@cache
def _tables() -> str:
    """A SELECT of the maps that `clean_html` decodes by, in one row.

    `named` has the character references of HTML 5, `legacy` those that need no semicolon, `windows` the
    numbers that stand for other characters, `wide` every character with a compatibility form.
    """
    import html
    import sys
    import unicodedata
    from html.entities import html5

    named = {k: v for k, v in html5.items() if k.endswith(";")}
    legacy = {k: v for k, v in html5.items() if not k.endswith(";")}
    windows = {str(n): html.unescape(f"&#{n};") for n in [0, 13, *range(0x80, 0xA0)]}
    wide = {c: unicodedata.normalize("NFKD", c) for c in map(chr, range(128, sys.maxunicode + 1))
            if unicodedata.normalize("NFKD", c) != unicodedata.normalize("NFD", c)}
    return (f"SELECT {_mapped(named)} AS named, {_mapped(legacy)} AS legacy, "
            f"{_mapped(windows)} AS windows, {_mapped(wide)} AS wide")


def decoding(src: str) -> str:
    """A FROM item: the rows of `src` with the maps that `clean_html` decodes by."""
    return f"{src} CROSS JOIN ({_tables()})"


def _reference(p: str) -> str:
    """What follows an ampersand, decoded as in HTML 5."""
    from html.entities import html5

    decimal, hexadecimal = f"regexp_extract({p}, '^#([0-9]+);?', 1)", f"regexp_extract({p}, '^#[xX]([0-9a-fA-F]+);?', 1)"
    rest = f"regexp_replace({p}, '^#([0-9]+|[xX][0-9a-fA-F]+);?', '')"
    number = (f"coalesce(CASE WHEN {decimal} <> '' THEN TRY_CAST('0' || ltrim({decimal}, '0') AS BIGINT) "
              f"ELSE TRY_CAST('0x0' || ltrim({hexadecimal}, '0') AS BIGINT) END, 1114112)")
    dropped = (f"{number} BETWEEN 1 AND 8 OR {number} = 11 OR {number} BETWEEN 14 AND 31 OR {number} = 127 "
               f"OR {number} BETWEEN 64976 AND 65007 OR {number} % 65536 >= 65534")
    odd = f"{number} BETWEEN 55296 AND 57343 OR {number} > 1114111"
    whole = f"regexp_extract({p}, '^[^\t\n\f <&#;]{{1,32}};')"
    short = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))
    prefix = f"regexp_extract({p}, '^({short})')"
    return (
        f"CASE WHEN {decimal} <> '' OR {hexadecimal} <> '' THEN coalesce(windows[CAST({number} AS VARCHAR)], CASE WHEN {odd} THEN chr(65533) "
        f"WHEN {dropped} THEN '' ELSE chr(CAST({number} AS INTEGER)) END) || {rest} "
        f"WHEN named[{whole}] IS NOT NULL THEN named[{whole}] || {p}[length({whole}) + 1:] "
        f"WHEN {prefix} <> '' THEN legacy[{prefix}] || {p}[length({prefix}) + 1:] ELSE '&' || {p} END"
    )


def clean_html(x: str) -> str:
    """The cleaning chain with compatibility forms and all character references; its rows come from `decoding`."""
    folded = f"list_transform(string_split({x}, ''), lambda c: CASE WHEN c <= chr(127) THEN c ELSE coalesce(wide[c], c) END)"
    t = f"CASE WHEN regexp_matches({x}, '[^\x00-\x7F]') THEN nfc_normalize(array_to_string({folded}, '')) ELSE {x} END"
    t = f"regexp_replace({t}, '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    t = f"string_split(regexp_replace({t}, '<[^>]+>', ' ', 'g'), '&')"
    t = f"array_to_string(list_transform({t}, lambda p, i: CASE WHEN i = 1 THEN p ELSE {_reference('p')} END), '')"
    t = f"regexp_replace({t}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"
    t = f"regexp_replace({t}, '\r\n?', chr(10), 'g')"
    t = f"regexp_replace({t}, '[ \t\f\x0B]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(t)


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def hex_mod(h: str, digits: int, modulus: int) -> str:
    r, step = "0", (1 << 32) % modulus
    for i in range(digits // 8):
        r = f"((({r}) * {step} + CAST('0x' || substr({h}, {8 * i + 1}, 8) AS BIGINT)) % {modulus})"
    return r


def split_of(key: str) -> str:
    n = hex_mod(f"md5({key})", 32, 100)
    return f"CASE WHEN {n} < 80 THEN 'train' WHEN {n} < 90 THEN 'val' ELSE 'test' END"


DEV = "[\\x{0900}-\\x{097F}]"
TOKEN_DEV = "[\\p{L}\\p{N}_\\x{0900}-\\x{097F}]+"
TOKEN_WORD = "[\\p{L}\\p{N}_]+"


def language(x: str) -> str:
    """Language tag for Latin and Devanagari text (function words from the vocabulary)."""
    from fieldlake.functions import vocab

    def count(p):
        return f"len(regexp_extract_all({x}, '{p}'))"

    def hits(words):
        listed = "[" + ", ".join(lit(w) for w in words) + "]"
        return (f"len(list_filter(regexp_extract_all(lower({x}), '{TOKEN_DEV}'), "
                f"lambda w: list_contains({listed}, w)))")

    dev, lat = count(DEV), count("[A-Za-z]")
    return (
        f"CASE WHEN {x} IS NULL OR {dev} + {lat} = 0 THEN 'unknown' WHEN {dev} = 0 THEN 'en' "
        f"WHEN {dev} > 0.25 * ({dev} + {lat}) AND {lat} > 0.25 * ({dev} + {lat}) THEN 'mixed' "
        f"WHEN {hits(vocab.HINDI_WORDS)} > {hits(vocab.MARATHI_WORDS)} THEN 'hi' ELSE 'mr' END"
    )


def pair_language(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} = {b} THEN {a} WHEN {a} = 'unknown' AND {b} <> 'mixed' THEN {b} "
        f"WHEN {b} = 'unknown' AND {a} <> 'mixed' THEN {a} ELSE 'mixed' END"
    )


def rendered(template: str) -> str:
    """A {column} template as a concatenation; nulls print as None."""
    import re

    parts = []
    for literal, name in re.findall(r"([^{}]*)(?:\{(\w+)\})?", template):
        if literal:
            parts.append(lit(literal))
        if name:
            parts.append(f"coalesce(CAST({name} AS VARCHAR), 'None')")
    return " || ".join(parts) or "''"
