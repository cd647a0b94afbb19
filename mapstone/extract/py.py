"""Python facts by the standard library's parser, with the two object-relational mappers that are written in Python."""

from __future__ import annotations

import ast
import re

from ..functions.text import py_doc
from .facts import empty


def _parse(source: str) -> ast.Module | None:
    """The tree, or that of the longest beginning that parses: broken files still give what stands before the fault."""
    lines = source.split("\n")
    for _ in range(20):
        try:
            return ast.parse("\n".join(lines))
        except SyntaxError as e:
            at = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
            if not lines or at <= 0 and not lines[0].strip():
                return None
            lines[at] = re.match(r"\s*", lines[at])[0] + "pass" if lines[at].strip() != "pass" else ""
        except ValueError:
            return None
    return None


def _doc(node) -> str | None:
    raw = ast.get_docstring(node, clean=False)
    return py_doc(raw) if raw else None


def _literal_names(value) -> set[str] | None:
    if isinstance(value, ast.List | ast.Tuple) and all(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in value.elts):
        return {x.value for x in value.elts}
    return None


def extract(path: str, source: str) -> dict:
    out, tree = empty(path, source, "py"), _parse(source)
    if tree is None:
        return out
    out["doc"] = _doc(tree)
    declared = None
    for node in tree.body:
        start = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) if hasattr(node, "lineno") else 0
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            out["symbols"].append([node.name, kind, node.lineno, node.end_lineno, _doc(node)])
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            for t in targets:
                if isinstance(t, ast.Name):
                    if t.id == "__all__":
                        declared = _literal_names(node.value) if node.value is not None else declared
                    else:
                        out["symbols"].append([t.id, "const", start, node.end_lineno, None])
    exported = lambda name: name in declared if declared is not None else not name.startswith("_")
    out["symbols"] = [{"name": n, "symbol_kind": k, "exported": exported(n), "start_line": a, "end_line": b, "doc": d} for n, k, a, b, d in out["symbols"]]
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out["imports"] += [{"specifier": a.name, "kind": "import", "symbols": []} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            spec = "." * node.level + (node.module or "")
            if spec != "__future__":
                out["imports"].append({"specifier": spec, "kind": "import", "symbols": [a.name for a in node.names]})
        elif isinstance(node, ast.Call) and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            name = ast.unparse(node.func)
            if name in ("importlib.import_module", "import_module", "__import__"):
                out["imports"].append({"specifier": node.args[0].value, "kind": "dynamic", "symbols": []})
    if "__tablename__" in source:
        out["entities"] += sqlalchemy_entities(tree)
    if "django" in source:
        out["entities"] += django_entities(path, tree)
    return out


def _call_name(node) -> str:
    """The last name of what is called: Column for sa.Column(...)."""
    f = node.func if isinstance(node, ast.Call) else node
    return f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else ""


def _const(node):
    return node.value if isinstance(node, ast.Constant) else None


def _kw(call: ast.Call) -> dict:
    return {k.arg: k.value for k in call.keywords if k.arg}


def _field(name, kind, column, nullable, pk, fk) -> dict:
    return {"name": name, "type": kind, "column": column, "nullable": bool(nullable), "is_pk": bool(pk), "is_fk": bool(fk)}


def _schema_of(value) -> str | None:
    for d in ast.walk(value):
        if isinstance(d, ast.Dict):
            for k, v in zip(d.keys, d.values, strict=True):
                if k is not None and _const(k) == "schema":
                    return _const(v)
    return None


def sqlalchemy_entities(tree: ast.Module) -> list[dict]:
    """Classes with a literal __tablename__: Column, mapped_column and Mapped[...] attributes, foreign keys of two or three parts."""
    out = []
    for cls in (n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)):
        table = schema = None
        fields, relations = [], []
        for node in cls.body:
            if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
                name, value, note = node.targets[0].id, node.value, None
            elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
                name, value, note = node.target.id, node.value, node.annotation
            else:
                continue
            if name == "__tablename__":
                table = _const(value)
                continue
            if name == "__table_args__" and value is not None:
                schema = _schema_of(value)
                continue
            inner = note.slice if isinstance(note, ast.Subscript) and _call_name(note.value) == "Mapped" else None
            called = _call_name(value) if isinstance(value, ast.Call) else ""
            if called == "relationship" or called not in ("Column", "mapped_column") and inner is None:
                continue
            call = value if called else None
            kw, args = (_kw(call), list(call.args)) if call else ({}, [])
            column = name
            if args and isinstance(_const(args[0]), str):
                column = args.pop(0).value
            kind, fk = None, None
            for a in args:
                if isinstance(a, ast.Call) and _call_name(a) == "ForeignKey":
                    fk = _const(a.args[0]) if a.args else None
                elif kind is None and not (isinstance(a, ast.Call) and _call_name(a) in ("Sequence", "Identity", "Computed", "CheckConstraint")):
                    kind = ast.unparse(a)
            optional = False
            if inner is not None:
                text = ast.unparse(inner).strip("'\"")
                optional = text.startswith(("Optional[", "typing.Optional[")) or re.search(r"\|\s*None\b|\bNone\s*\|", text) is not None
                bare = re.sub(r"^(?:typing\.)?Optional\[(.*)\]$", r"\1", re.sub(r"\s*\|\s*None|None\s*\|\s*", "", text))
                if kind is None:
                    kind = bare
            pk = _const(kw.get("primary_key")) is True
            if "nullable" in kw:
                nullable = _const(kw["nullable"]) is not False
            else:
                nullable = False if pk else optional if inner is not None else True
            fields.append(_field(name, kind or "unknown", column, nullable, pk, fk is not None))
            if isinstance(fk, str) and fk.count(".") in (1, 2):
                target, _, target_col = fk.rpartition(".")
                relations.append({"from_field": name, "from_col": column, "target": target, "target_col": target_col})
        if isinstance(table, str):
            for r in relations:
                if "." not in r["target"] and schema:
                    r["target"] = r["target"]
            out.append({"name": cls.name, "orm": "sqlalchemy", "table_schema": schema, "table_name": table, "explicit": True, "fields": fields, "relations": relations})
    return out


def django_entities(path: str, tree: ast.Module) -> list[dict]:
    """Subclasses of Model: table app_model unless Meta says otherwise, abstract ones left out, implicit keys added."""
    parts = path.split("/")
    app = parts[-2] if parts[-1] != "models.py" and len(parts) > 2 and parts[-2] == "models" else (parts[-2] if len(parts) > 1 else "")
    if app == "models" and len(parts) > 2:
        app = parts[-3]
    out = []
    for cls in (n for n in tree.body if isinstance(n, ast.ClassDef)):
        if not any(ast.unparse(b) in ("models.Model", "Model") for b in cls.bases):
            continue
        meta = {}
        for n in cls.body:
            if isinstance(n, ast.ClassDef) and n.name == "Meta":
                meta = {t.id: _const(a.value) for a in n.body if isinstance(a, ast.Assign) for t in a.targets if isinstance(t, ast.Name)}
        if meta.get("abstract") is True:
            continue
        fields, relations, has_pk = [], [], False
        for n in cls.body:
            if not (isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name) and isinstance(n.value, ast.Call)):
                continue
            name, kind, kw = n.targets[0].id, _call_name(n.value), _kw(n.value)
            pk = _const(kw.get("primary_key")) is True
            has_pk |= pk
            nullable = _const(kw.get("null")) is True
            if kind in ("ForeignKey", "OneToOneField"):
                column = _const(kw.get("db_column")) or f"{name}_id"
                to = n.value.args[0] if n.value.args else kw.get("to")
                target = _const(to) if isinstance(to, ast.Constant) else _call_name(to) if to is not None else None
                fields.append(_field(name, "unknown", column, nullable, pk, True))
                if target and target != "self":
                    relations.append({"from_field": name, "from_col": column, "target": target.split(".")[-1], "target_col": "id"})
            elif kind.endswith("Field") and kind != "ManyToManyField":
                fields.append(_field(name, kind, _const(kw.get("db_column")) or name, nullable, pk, False))
        if not has_pk:
            fields.insert(0, _field("id", "unknown", "id", False, True, False))
        table = meta.get("db_table")
        out.append({"name": cls.name, "orm": "django", "table_schema": None, "table_name": table or f"{app}_{cls.name.lower()}", "explicit": bool(table), "fields": fields, "relations": relations})
    return out
