"""Facts of one file, and their table. A file is a row; what it declares is nested."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

FIELD = "struct<name:string,type:string,column:string,nullable:boolean,is_pk:boolean,is_fk:boolean>"
RELATION = "struct<from_field:string,from_col:string,target:string,target_col:string>"
FACTS = (
    "path string, lang string, loc int, doc string,"
    " imports array<struct<specifier:string,kind:string,symbols:array<string>>>,"
    " symbols array<struct<name:string,symbol_kind:string,exported:boolean,start_line:int,end_line:int,doc:string>>,"
    f" entities array<struct<name:string,orm:string,table_schema:string,table_name:string,explicit:boolean,fields:array<{FIELD}>,relations:array<{RELATION}>>>"
)

#: Language of each extension that is scanned. Fixed values.
LANGUAGES = {".ts": "ts", ".tsx": "ts", ".mts": "ts", ".cts": "ts", ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".py": "py", ".prisma": "prisma"}


def language_of(path: str) -> str | None:
    dot = path.rfind(".")
    return LANGUAGES.get(path[dot:].lower()) if dot > path.rfind("/") else None


def empty(path: str, source: str, lang: str) -> dict:
    return {"path": path, "lang": lang, "loc": source.count("\n") + 1 if source else 0, "doc": None, "imports": [], "symbols": [], "entities": []}


def extract(path: str, source: str) -> dict | None:
    """Facts of a source file; None for a file of another kind. Never raises on broken source."""
    lang = language_of(path)
    if lang is None:
        return None
    from . import prisma, py, ts

    try:
        return {"py": py.extract, "prisma": prisma.extract}.get(lang, ts.extract)(path, source)
    except (SyntaxError, ValueError, RecursionError, IndexError):
        return empty(path, source, lang)


def extract_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The facts table of source files; each batch of files is parsed where it lies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [f for p, s in zip(b["path"], b["content"], strict=True) if (f := extract(p, s or "")) is not None]
            yield pd.DataFrame(rows, columns=["path", "lang", "loc", "doc", "imports", "symbols", "entities"])

    return files.selectExpr(f"{path} as path", f"{content} as content").mapInPandas(run, FACTS)
