"""Prisma schemas: models are entities, fields of model types are navigation, @relation fields give foreign keys."""

from __future__ import annotations

import re

from .facts import empty

_MODEL = re.compile(r"^\s*(model|enum|type|view)\s+(\w+)\s*\{(.*?)^\s*\}", re.S | re.M)
_STRING = r'"((?:[^"\\]|\\.)*)"'


def _list(text: str, name: str) -> list[str]:
    m = re.search(rf"{name}\s*:\s*\[([^\]]*)\]", text)
    return [x.strip() for x in m[1].split(",") if x.strip()] if m else []


def extract(path: str, source: str) -> dict:
    out = empty(path, source, "prisma")
    plain = re.sub(r"//[^\n]*", "", source)
    blocks = [m for m in _MODEL.finditer(plain)]
    models = {m[2] for m in blocks if m[1] in ("model", "view")}
    for m in blocks:
        if m[1] != "model":
            continue
        name, body = m[2], m[3]
        mapped, schema = re.search(rf"@@map\(\s*(?:name\s*:\s*)?{_STRING}\s*\)", body), re.search(rf"@@schema\(\s*{_STRING}\s*\)", body)
        ids = re.search(r"@@id\(\s*(?:fields\s*:\s*)?\[([^\]]*)\]", body)
        keys = {x.strip() for x in ids[1].split(",")} if ids else set()
        fields, navigation = [], []
        for line in body.split("\n"):
            f = re.match(r"\s*(\w+)\s+(\w+)(\[\])?(\?)?(.*)$", line)
            if not f:
                continue
            field, kind, many, optional, rest = f.groups()
            if kind in models:
                rel = re.search(r"@relation\((.*)\)", rest)
                if rel:
                    navigation += [(field, a, kind, b) for a, b in zip(_list(rel[1], "fields"), _list(rel[1], "references"), strict=False)]
                continue
            column = re.search(rf"(?<!@)@map\(\s*(?:name\s*:\s*)?{_STRING}\s*\)", rest)
            pk = re.search(r"(?<!@)@id\b", rest) is not None or field in keys
            fields.append({"name": field, "type": kind + (many or ""), "column": column[1] if column else field, "nullable": bool(optional), "is_pk": pk, "is_fk": False})
        columns = {f["name"]: f["column"] for f in fields}
        relations = []
        for field, a, kind, b in navigation:
            relations.append({"from_field": field, "from_col": columns.get(a, a), "target": kind, "target_col": b})
            for f in fields:
                f["is_fk"] |= f["name"] == a
        out["entities"].append(
            {"name": name, "orm": "prisma", "table_schema": schema[1] if schema else None, "table_name": mapped[1] if mapped else name, "explicit": bool(mapped), "fields": fields, "relations": relations}
        )
    return out
