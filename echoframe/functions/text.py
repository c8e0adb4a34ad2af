"""Names, paths and messages in reports, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def shorten(text: Column, root: str) -> Column:
    """Without the scanned folder's prefix, wherever it stands."""
    return F.replace(F.replace(text, F.lit(root + "\\"), F.lit("")), F.lit(root + "/"), F.lit(""))


def first_lines(body: Column, n: int = 25, chars: int = 80) -> Column:
    """The first n lines, as an array; of an empty list of lines, the first characters."""
    lines = F.slice(F.split(body, "\n"), 1, n)
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.substring(body, 1, chars)))


def escape_json(c: Column) -> Column:
    """Escapes what a JSON string needs."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def similarity_color(similarity: Column) -> Column:
    return F.when(similarity >= 95, "red").when(similarity >= 85, "yellow").otherwise("green")


def suggestion(name1: Column, file1: Column, name2: Column, file2: Column, semantic: Column | bool) -> Column:
    """What to do about a pair; the marks `copy-pasted`, `common header`, `same-file refactor` and `CodeBERT` are fixed."""
    semantic = F.lit(semantic) if isinstance(semantic, bool) else semantic
    both = F.concat(F.lit("`"), name1, F.lit("` and `"), name2, F.lit("`"))
    what = F.when(semantic, F.concat(F.lit("The CodeBERT vectors of "), both, F.lit(" lie unusually close: one function may serve for both; "))).otherwise(F.concat(F.lit("The tokens of "), both, F.lit(" agree, so one was probably copy-pasted: keep a single helper; ")))
    where = F.when(file1 == file2, F.concat(F.lit("a same-file refactor in "), file1, F.lit(" will do."))).otherwise(F.concat(F.lit("a common header can hold it for "), file1, F.lit(" and "), file2, F.lit(".")))
    return F.concat(what, where)
