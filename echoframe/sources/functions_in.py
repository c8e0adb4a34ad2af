"""Functions in C++ files, as rows.

The default finds them by matching braces below a line that looks like a function's head; the
body is the braced block, or with `whole` the declaration from its head on. Where libclang
can be imported, `clang_units` takes the definitions of free functions from its syntax tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from echoframe.plans.storage import ranked

#: Beginnings of a line, after blanks, that are no function's head.
NOT_HEADS = ("if", "else", "for", "while", "switch", "return", "//")


def is_head(line: str) -> bool:
    line = line.lstrip(" \t")
    return "(" in line and ")" in line and not line.startswith(("(", *NOT_HEADS))


def head_name(line: str) -> str:
    """The identifier right before the first parenthesis, or nothing."""
    before = line[: line.index("(")].rstrip(" ") if "(" in line else ""
    return re.search(r"[A-Za-z0-9_]*\Z", before)[0]


def closing(text: str, at: int) -> int:
    """Where the brace at `at` is closed, or -1; braces in literals count too."""
    depth = 0
    for m in re.compile("[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return -1


def functions_in(text: str, whole: bool = False) -> Iterator[tuple[str, str, int]]:
    """(name, body, start) of functions in order; functions inside others are not looked for."""
    at = 0
    while (brace := text.find("{", at)) >= 0:
        at = brace + 1
        start = text.rfind("\n", 0, brace) + 1
        head, head_start = text[start:brace], start
        # a brace at the very beginning of its line belongs to the line before
        if not head and start > 1:
            head_start = text.rfind("\n", 0, start - 1) + 1
            head = text[head_start : start - 1]
        if is_head(head) and (name := head_name(head)) and (end := closing(text, brace)) >= 0:
            first = head_start if whole else brace
            yield name, text[first : end + 1], first
            at = end + 1


@udtf(returnType="name string, body string, start long")
class FunctionsIn:
    """SELECT f.* FROM files, LATERAL functions_in(content) f"""

    def eval(self, content: str):
        yield from functions_in(content or "")


def units_of(files: DataFrame, whole: bool = False) -> DataFrame:
    """units(idx, name, body, filename) of files(path, content). idx is the position by (filename, start), from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(name, body, path, start) for path, content in zip(pdf.path, pdf.content, strict=True) for name, body, start in functions_in(content or "", whole)]
            yield pd.DataFrame(rows, columns=["name", "body", "filename", "start"])

    return _with_idx(files.select("path", "content").mapInPandas(run, "name string, body string, filename string, start long"))


def _with_idx(found: DataFrame) -> DataFrame:
    return ranked(found, F.col("filename"), F.col("start"), rank="idx").select("idx", "name", "body", "filename")


def clang_available() -> bool:
    try:
        import clang.cindex  # noqa: F401
    except ImportError:
        return False
    return True


def clang_functions(path: str) -> Iterator[tuple[str, str, int]]:
    """(name, declaration, start) of the free function definitions in the file itself, from libclang's tree."""
    from clang import cindex

    with open(path, "rb") as f:
        raw = f.read()

    def walk(node):
        if node.kind == cindex.CursorKind.FUNCTION_DECL and node.is_definition() and node.location.file and node.location.file.name == path:
            a, b = node.extent.start.offset, node.extent.end.offset
            if 0 <= a < b <= len(raw):
                yield node.spelling, raw[a:b].decode("utf-8", "replace"), a
        for child in node.get_children():
            yield from walk(child)

    try:
        tree = cindex.Index.create().parse(path)
    except cindex.TranslationUnitLoadError:
        return
    yield from walk(tree.cursor)


def clang_units(files: DataFrame) -> DataFrame:
    """As units_of, by libclang on the executors; the files are parsed where they lie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(n, b, p, s) for p in pdf.path for n, b, s in clang_functions(p)], columns=["name", "body", "filename", "start"])

    return _with_idx(files.select("path").mapInPandas(run, "name string, body string, filename string, start long"))
