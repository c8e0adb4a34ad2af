"""Normalisation of source text as Column expressions.

Lengths and distances are counted in bytes: `byte_view` turns each byte of the UTF-8 form
into one code point. Three quirks are kept because equality of results depends on them: an unclosed
block comment leaves the last character, the text behind the last token is dropped by
renaming, and names that begin with an underscore are not renamed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that renaming leaves alone, and the token pattern.
KEYWORDS = (
    "int", "float", "double", "char", "bool", "void", "long", "short",
    "unsigned", "signed", "const", "static", "inline", "return", "if",
    "else", "for", "while", "do", "switch", "case", "break", "continue",
    "class", "struct", "public", "private", "protected", "new", "delete",
    "true", "false", "nullptr", "auto", "this", "namespace", "using",
    "include", "define", "string", "vector", "map", "cout", "cin",
    "endl", "std", "size_t", "uint8_t", "int32_t", "int64_t",
)
TOKEN = r"[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+|[+\-*/=<>!&|]+|[{}();,\[\].]"
BODY_CAP = 500
MIN_PREPARED = 80


def byte_view(c: Column) -> Column:
    """One code point for each byte."""
    return F.decode(c.cast("binary"), "ISO-8859-1")


def strip_block_comments(c: Column) -> Column:
    """Drops /* ... */; one without an end drops all but the very last character."""
    return F.regexp_replace(c, r"(?s)/\*(?:.*?\*/|.*(?=.\z)|\z)", "")


def strip_line_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"//[^\n]*", "")


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \n\t\r]+", " ")


def normalize_code(c: Column) -> Column:
    """Without comments (block comments first), white space collapsed and trimmed."""
    return F.trim(collapse_whitespace(strip_line_comments(strip_block_comments(c))))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def rename_identifiers(c: Column) -> Column:
    """Names become VAR_0, VAR_1 ... in order of first appearance.

    Tokens and names are bound once, in a one-element array: lambdas don't share sub-expressions.
    """
    pattern = F.lit(f"(?s)(.*?)({TOKEN})")
    found = F.array(F.struct(F.regexp_extract_all(c, pattern, F.lit(1)).alias("gaps"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("toks")))
    keywords = F.array(*(F.lit(k) for k in KEYWORDS))
    named = F.transform(found, lambda s: F.struct(s["gaps"].alias("gaps"), s["toks"].alias("toks"), F.array_distinct(F.filter(s["toks"], lambda t: t.rlike("^[a-zA-Z]") & ~F.array_contains(keywords, t))).alias("names")))

    def one(s: Column) -> Column:
        renamed = F.transform(s["toks"], lambda t: F.when(F.array_contains(s["names"], t), F.concat(F.lit("VAR_"), (F.array_position(s["names"], t) - 1).cast("string"))).otherwise(t))
        return F.array_join(F.zip_with(s["gaps"], renamed, lambda g, t: F.concat(g, t)), "")

    return F.transform(named, one)[0]


def prepare(c: Column, cap: int = BODY_CAP) -> Column:
    """The form that near duplicates are compared in: the first bytes, normalised and renamed."""
    return rename_identifiers(normalize_code(F.substring(byte_view(c), 1, cap)))
