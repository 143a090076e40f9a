"""Source files and their heads: imports, first docstring lines, function names, front matter, encodings."""

from __future__ import annotations

import ast
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYNTAX = "imports array<string>, docstring string, functions array<string>"


def _syntax(text: str | None) -> tuple[list[str], str | None, list[str]]:
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return [], None, []
    imports = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports.update(a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            imports.add(node.module)
    first = (ast.get_docstring(tree) or "").strip().split("\n")[0]
    return sorted(imports), first or None, [n.name for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)]


def syntax(text: Column) -> Column:
    """struct(imports, docstring, functions) of Python source; empty where it does not parse."""

    @F.pandas_udf(SYNTAX)
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_syntax(t) for t in texts], columns=["imports", "docstring", "functions"])

    return parse(text)


def repeated_functions(files: DataFrame) -> DataFrame:
    """function, paths of functions that several files (path, text) define."""
    named = files.select("path", F.explode(syntax(F.col("text"))["functions"]).alias("function")).distinct()
    return named.groupBy("function").agg(F.array_sort(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1)


def front_matter(text: Column) -> Column:
    """map of the ``key: value`` lines between leading ``---`` fences; null without a fence."""
    body = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_]\w*:"))
    entry = lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v"))
    return F.when(text.rlike(r"\A---\r?\n"), F.map_from_entries(F.transform(lines, entry)))


def decoded(content: Column, encodings: Sequence[str] = ("utf-8-sig", "cp950", "latin-1")) -> Column:
    """Text of binary content by the first encoding that fits."""

    @F.pandas_udf("string")
    def decode(contents: pd.Series) -> pd.Series:
        def one(data):
            for name in encodings if data is not None else ():
                try:
                    return bytes(data).decode(name)
                except UnicodeDecodeError:
                    continue
            return None

        return contents.map(one)

    return decode(content)


def fenced_json(text: Column, schema: str) -> Column:
    """The JSON in a fenced answer (or a bare one), null if it is none."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.from_json(F.when(inner != "", inner).otherwise(text), schema)
