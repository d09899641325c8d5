"""Text columns: cleaning, tokens, language tags, hashes and hash splits.

Everything is a Column expression that stays in the JVM, apart from two small Arrow
UDFs (compatibility normalisation and HTML entities) that only receive the values
which can change.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from fieldlake.functions import vocab

# The patterns that define "clean" text and a "token".
SCRIPT = r"(?is)<script[^>]*>.*?</script>"
STYLE = r"(?is)<style[^>]*>.*?</style>"
TAG = r"<[^>]+>"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
BLANKS = r"[\t\f\x0B][ \t\f\x0B]*| [ \t\f\x0B]+"
NEWLINES = r"\n{3,}"
TOKEN_WITH_DEVANAGARI = r"[\p{L}\p{N}_\u0900-\u097F]+"
TOKEN_WORD = r"[\p{L}\p{N}_]+"
DEVANAGARI = r"[\u0900-\u097F]"

# Characters that str.strip() and \s treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_each(values: pd.Series) -> pd.Series:
    return values.map(
        lambda a: [None if v is None else unicodedata.normalize("NFKC", v) for v in a], na_action="ignore"
    )


@F.pandas_udf(ArrayType(StringType()))
def _unescape_each(values: pd.Series) -> pd.Series:
    return values.map(lambda a: [None if v is None else html.unescape(v) for v in a], na_action="ignore")


def _only_where(udf, needed: Column, value: Column) -> Column:
    """Send a value through a UDF only where `needed`; other rows ship a null to Python."""
    return F.coalesce(udf(F.when(needed, value)), value)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def collapse(c: Column) -> Column:
    """White-space runs to one blank, then strip."""
    return strip(F.regexp_replace(c, WHITESPACE_RUN, " "))


def clean_text(c: Column) -> Column:
    """Normalise, drop markup, decode entities, drop control characters, tidy white space."""
    t = F.coalesce(c, F.lit(""))
    t = _only_where(_nfkc, t.rlike(r"[^\x00-\x7F]"), t)
    t = drop_markup(t)
    t = _only_where(_unescape, F.contains(t, F.lit("&")), t)
    return tidy(t)


def clean_each(c: Column) -> Column:
    """`clean_text` on every element of a string array; nulls stay."""
    t = _only_where(_nfkc_each, F.exists(c, lambda x: x.rlike(r"[^\x00-\x7F]")), c)
    t = F.transform(t, drop_markup)
    t = _only_where(_unescape_each, F.exists(t, lambda x: F.contains(x, F.lit("&"))), t)
    return F.transform(t, tidy)


def clean_value(c: Column, dt: DataType) -> Column:
    """Clean every string inside a nested value, driven by its type; other values pass."""
    if isinstance(dt, StringType):
        return F.when(c.isNotNull(), clean_text(c))
    if isinstance(dt, StructType):
        rebuilt = F.struct(*[clean_value(c[f.name], f.dataType).alias(f.name) for f in dt.fields])
        return F.when(c.isNotNull(), rebuilt)
    if isinstance(dt, ArrayType) and isinstance(dt.elementType, StringType):
        return clean_each(c)
    if isinstance(dt, ArrayType) and isinstance(dt.elementType, StructType):
        # A field of an array of structs is itself an array, so clean per field and zip back.
        parts = [clean_value(c[f.name], ArrayType(f.dataType)).alias(f.name) for f in dt.elementType.fields]
        return F.when(c.isNotNull(), F.arrays_zip(*parts))
    if isinstance(dt, MapType) and isinstance(dt.valueType, StringType):
        return F.map_from_arrays(F.map_keys(c), clean_each(F.map_values(c)))
    return c


def clean_columns(df: DataFrame, *keep: str) -> DataFrame:
    """`clean_value` on every column but those in `keep`."""
    return df.select(*[
        F.col(f.name) if f.name in keep else clean_value(F.col(f.name), f.dataType).alias(f.name)
        for f in df.schema.fields
    ])


def drop_markup(c: Column) -> Column:
    t = F.regexp_replace(c, SCRIPT, " ")
    t = F.regexp_replace(t, STYLE, " ")
    return F.regexp_replace(t, TAG, " ")


def tidy(c: Column) -> Column:
    """The part of cleaning that follows entity decoding."""
    t = F.regexp_replace(c, CONTROL, "")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, BLANKS, " ")
    t = F.regexp_replace(t, NEWLINES, "\n\n")
    return strip(t)


def tokens(c: Column, pattern: str = TOKEN_WITH_DEVANAGARI) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def detect_language(c: Column) -> Column:
    """en / mr / hi / mixed / unknown from script counts and function words."""
    t = F.coalesce(c, F.lit(""))
    has_dev, has_lat = t.rlike(DEVANAGARI), t.rlike("[A-Za-z]")
    dev = F.regexp_count(t, F.lit(DEVANAGARI))
    lat = F.regexp_count(t, F.lit("[A-Za-z]"))
    words = tokens(t)
    hindi = F.size(F.filter(words, lambda w: w.isin(vocab.HINDI_WORDS)))
    marathi = F.size(F.filter(words, lambda w: w.isin(vocab.MARATHI_WORDS)))
    both = (lat / (dev + lat) > 0.25) & (dev / (dev + lat) > 0.25)
    # CASE branches run lazily, so Latin-only rows never count or tokenise.
    return (
        F.when(~has_dev, F.when(has_lat, "en").otherwise("unknown"))
        .when(has_lat & both, "mixed")
        .when(hindi > marathi, "hi")
        .otherwise("mr")
    )


def detect_language_pair(question: Column, answer: Column) -> Column:
    return combine_languages(detect_language(question), detect_language(answer))


def combine_languages(a: Column, b: Column) -> Column:
    """Same tag -> that tag; an unknown side yields to a known, unmixed one; otherwise mixed."""
    return (
        F.when(a == b, a)
        .when((a == "unknown") & (b != "mixed"), b)
        .when((b == "unknown") & (a != "mixed"), a)
        .otherwise("mixed")
    )


def _chunk(hex_digest: Column, i: int) -> Column:
    return F.conv(F.substring(hex_digest, 8 * i + 1, 8), 16, 10).cast("bigint")


def hex_mod(hex_digest: Column, digits: int, modulus: int) -> Column:
    """A hex digest as one big integer, modulo `modulus`, by 32-bit Horner steps."""
    step = (1 << 32) % modulus
    r = F.lit(0).cast("bigint")
    for i in range(digits // 8):
        r = (r * step + _chunk(hex_digest, i)) % modulus
    return r


def assign_split(key: Column) -> Column:
    """Deterministic 80/10/10 split of a key."""
    n = hex_mod(F.md5(key), 32, 100)
    return F.when(n < 80, "train").when(n < 90, "val").otherwise("test")


def standard_id(list_key: Column, question: Column, answer: Column, path: Column) -> Column:
    basis = F.concat_ws(
        "|", list_key, F.substring(question, 1, 80), F.substring(answer, 1, 80), path
    )
    return F.concat(F.lit("std_"), F.substring(F.sha2(basis, 256), 1, 16))


def synth_id(fact_key: Column, template_id: Column, language: Column) -> Column:
    basis = F.concat_ws("|", fact_key, template_id, language)
    return F.concat(F.lit("syn_"), F.substring(F.sha2(basis, 256), 1, 20))


def capitalize(c: Column) -> Column:
    """First character upper, all others lower."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 2147483647)))
