"""TypeScript and JavaScript facts by a tokenizer and a statement scanner that tolerate broken source.

Only what the graph needs is recognized: module statements, top-level declarations, literal dynamic imports, doc
comments, and the declarations of two object-relational mappers.
"""

from __future__ import annotations

import re

from ..functions.text import js_doc
from .facts import empty

_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<name>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<number>\d[\w.]*)|(?P<op>=>|\.\.\.|\?\.|[^\w\s])",
    re.S,
)
#: After one of these a slash starts a regular expression.
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^<>") | {"=>", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


class Token:
    __slots__ = ("kind", "text", "line", "at", "end")

    def __init__(self, kind: str, text: str, line: int, at: int, end: int) -> None:
        self.kind, self.text, self.line, self.at, self.end = kind, text, line, at, end

    @property
    def value(self) -> str:
        return re.sub(r"\\(.)", r"\1", self.text[1:-1]) if self.kind == "string" else self.text


def _template(source: str, at: int) -> int:
    """The end of a template literal that starts at a back quote."""
    i, depth = at + 1, 0
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 2
            continue
        if depth == 0 and c == "`":
            return i + 1
        if c == "$" and source[i + 1 : i + 2] == "{" and depth == 0:
            depth, i = 1, i + 2
            continue
        if depth:
            if c == "`":
                i = _template(source, i)
                continue
            depth += (c == "{") - (c == "}")
        i += 1
    return len(source)


def tokens(source: str) -> tuple[list[Token], list[Token]]:
    """Code tokens and comments."""
    out, comments, at, line = [], [], 0, 1
    while at < len(source):
        if source[at] == "`":
            end, kind = _template(source, at), "template"
        elif source[at] == "/" and (not out or out[-1].text in _BEFORE_REGEX) and (m := _REGEX.match(source, at)):
            end, kind = m.end(), "regex"
        else:
            m = _TOKEN.match(source, at)
            if not m:
                at += 1
                continue
            end, kind = m.end(), m.lastgroup
        text = source[at:end]
        if kind in ("line", "block"):
            comments.append(Token(kind, text, line, at, end))
        elif kind != "space":
            out.append(Token(kind, text, line, at, end))
        line += text.count("\n")
        at = end
    return out, comments


_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def skip(ts: list[Token], i: int) -> int:
    """The place after a bracketed group that starts at i (or after one token)."""
    if i >= len(ts) or ts[i].text not in _OPEN or ts[i].kind != "op":
        return i + 1
    depth = 0
    while i < len(ts):
        if ts[i].kind == "op":
            depth += (ts[i].text in _OPEN) - (ts[i].text in _CLOSE)
            if depth == 0:
                return i + 1
        i += 1
    return i


def _statement_end(ts: list[Token], i: int) -> int:
    """The place after a statement that isn't a block: a semicolon, or a line that starts another statement."""
    start = i
    while i < len(ts):
        if ts[i].text == ";":
            return i + 1
        if i > start and ts[i].line > ts[i - 1].line and ts[i].kind == "name" and ts[i].text in ("import", "export", "const", "let", "var", "function", "class", "interface", "type", "enum", "async", "abstract", "declare") and ts[i - 1].text not in ("=", "(", ",", "=>", "{", "|", "&", ":", "?", "+", "extends", "of"):
            return i
        if i > start and ts[i].text == "@" and ts[i].line > ts[i - 1].line:
            return i
        i = skip(ts, i)
    return i


def _names(ts: list[Token]) -> list[tuple[str, str]]:
    """(original, local) of the names between the braces of a module clause."""
    out, i = [], 0
    while i < len(ts):
        if ts[i].text == "type" and i + 1 < len(ts) and ts[i + 1].kind == "name" and ts[i + 1].text != "as":
            i += 1
        if ts[i].kind in ("name", "string"):
            one = ts[i].value
            if i + 2 < len(ts) and ts[i + 1].text == "as":
                out.append((one, ts[i + 2].value))
                i += 3
            else:
                out.append((one, one))
                i += 1
        else:
            i += 1
    return out


def extract(path: str, source: str) -> dict:
    lang = "js" if path.lower().endswith((".js", ".jsx", ".mjs", ".cjs")) else "ts"
    out = empty(path, source, lang)
    ts, comments = tokens(source)
    docs = {c.line + c.text.count("\n"): c for c in comments if c.text.startswith("/**")}

    def doc_above(t: Token) -> str | None:
        c = docs.get(t.line - 1) or docs.get(t.line)
        return js_doc(c.text) if c and c.end <= t.at else None

    if comments and comments[0].kind == "block" and (not ts or comments[0].at < ts[0].at):
        c = comments[0]
        after = min([t.line for t in ts[:1]] + [x.line for x in comments[1:2]], default=0)
        if re.search(r"@(fileoverview|module|file)\b", c.text) or after > c.line + c.text.count("\n") + 1 or not ts:
            out["doc"] = js_doc(c.text)

    exported_locally: set[str] = set()

    def symbol(name: str, kind: str, exported: bool, first: Token, last: int, doc) -> None:
        end = ts[min(last, len(ts)) - 1]
        out["symbols"].append({"name": name, "symbol_kind": kind, "exported": exported, "start_line": first.line, "end_line": end.line + end.text.count("\n"), "doc": doc})

    def declaration(i: int, first: Token, above: Token, exported: bool, default: bool = False) -> int:
        """A declaration at i; the place after it, or i if there is none. A comment stands above the decorators, if any."""
        doc, j = doc_above(above), i
        while j < len(ts) and ts[j].text in ("declare", "async", "abstract"):
            j += 1
        if j >= len(ts):
            return i
        word = ts[j].text
        kinds = {"function": "function", "class": "class", "interface": "interface", "enum": "enum", "type": "type", "namespace": None, "module": None}
        if word == "const" and j + 1 < len(ts) and ts[j + 1].text == "enum":
            j, word = j + 1, "enum"
        if word in kinds and ts[j].kind == "name":
            k = j + 1
            if k < len(ts) and ts[k].text == "*":
                k += 1
            named = k < len(ts) and ts[k].kind == "name" and ts[k].text not in ("extends", "implements")
            if not named and not default:
                return i
            name = ts[k].text if named else "default"
            if word == "type":
                end = _statement_end(ts, k)
            else:
                while k < len(ts) and ts[k].text != "{":
                    if ts[k].text == ";":
                        break
                    if word == "function" and ts[k].text == ":":  # a return type may be braced
                        k += 1
                        if k < len(ts) and ts[k].text == "{":
                            k = skip(ts, k)
                        continue
                    k = skip(ts, k) if ts[k].text in ("(", "[") else k + 1
                end = skip(ts, k)
            if kinds[word]:
                symbol(name, kinds[word], exported, first, end, doc)
            return end
        if word in ("const", "let", "var") and ts[j].kind == "name":
            end, k, want = _statement_end(ts, j), j + 1, True
            while k < end:
                if want and ts[k].kind == "name":
                    symbol(ts[k].text, "const", exported, first, end, doc)
                want = False
                if ts[k].text == ",":
                    want = True
                    k += 1
                    continue
                k = skip(ts, k)
            return end
        return i

    i, decorated = 0, None
    while i < len(ts):
        t = ts[i]
        if t.text == "@" and t.kind == "op":
            decorated = decorated or t
            i = i + 2
            while i < len(ts) and ts[i].text in (".", "("):
                i = skip(ts, i) if ts[i].text == "(" else i + 2
            continue
        above, decorated, first = decorated or t, None, t
        nxt = ts[i + 1].text if i + 1 < len(ts) else ""
        if t.text == "import" and t.kind == "name" and nxt not in ("(", "."):
            end = next((k for k in range(i + 1, min(len(ts), i + 4000)) if ts[k].kind == "string"), None)
            if end is None:
                i += 1
                continue
            body, names = ts[i + 1 : end], []
            if body and body[0].text == "type" and len(body) > 1 and body[1].text not in ("from", ","):
                body = body[1:]
            k = 0
            while k < len(body):
                if body[k].text == "{":
                    stop = skip(body, k)
                    names += [a for a, _ in _names(body[k + 1 : stop - 1])]
                    k = stop
                elif body[k].text == "*":
                    names.append("*")
                    k += 3
                elif body[k].kind == "name" and body[k].text != "from":
                    names.append("default")
                    k += 1
                else:
                    k += 1
            out["imports"].append({"specifier": ts[end].value, "kind": "import", "symbols": names})
            i = end + 1
            if i < len(ts) and ts[i].text in ("with", "assert"):
                i = skip(ts, i + 1)
            continue
        if t.text == "export" and t.kind == "name":
            j = i + 1
            if j < len(ts) and ts[j].text == "type" and j + 1 < len(ts) and ts[j + 1].text in ("{", "*"):
                j += 1
            if j < len(ts) and ts[j].text in ("{", "*"):
                names = []
                if ts[j].text == "{":
                    stop = skip(ts, j)
                    names = _names(ts[j + 1 : stop - 1])
                    j = stop
                else:
                    j += 1
                    if j < len(ts) and ts[j].text == "as":
                        j += 2
                if j + 1 < len(ts) and ts[j].text == "from" and ts[j + 1].kind == "string":
                    out["imports"].append({"specifier": ts[j + 1].value, "kind": "reexport", "symbols": [a for a, _ in names] or ["*"]})
                    j += 2
                else:
                    exported_locally |= {a for a, _ in names}
                i = j
                continue
            default = j < len(ts) and ts[j].text == "default"
            end = declaration(j + 1 if default else j, first, above, True, default)
            if end == (j + 1 if default else j):
                end = _statement_end(ts, j)
                if default and j + 1 < len(ts) and ts[j + 1].kind == "name" and end <= j + 3:
                    exported_locally.add(ts[j + 1].text)
            i = max(end, i + 1)
            continue
        end = declaration(i, first, above, False)
        i = end if end > i else max(i + 1, skip(ts, i))
    for s in out["symbols"]:
        s["exported"] |= s["name"] in exported_locally
    for k in range(len(ts) - 2):
        if ts[k].text in ("import", "require") and ts[k].kind == "name" and ts[k + 1].text == "(" and ts[k + 2].kind == "string" and (k == 0 or ts[k - 1].text != "."):
            if k + 3 < len(ts) and ts[k + 3].text in (")", ","):
                out["imports"].append({"specifier": ts[k + 2].value, "kind": "dynamic", "symbols": []})
    specs = {x["specifier"] for x in out["imports"]}
    if "typeorm" in specs:
        out["entities"] += typeorm_entities(ts)
    if any(s.startswith("drizzle-orm") for s in specs):
        out["entities"] += drizzle_entities(ts)
    return out


def snake(name: str) -> str:
    """TypeORM's default naming: a capital starts a part, except the first."""
    return re.sub(r"(?<=[a-z])([A-Z])|(?<!^)([A-Z])(?=[a-z])", lambda m: "_" + m[0], name).lower()


def camel(*parts: str) -> str:
    head, *rest = [p for p in parts if p]
    return head[0].lower() + head[1:] + "".join(p[0].upper() + p[1:] for p in rest)


def _strings(ts: list[Token]) -> list[str]:
    return [t.value for t in ts if t.kind == "string"]


def _option(ts: list[Token], name: str) -> Token | None:
    """The value token of an option in an object literal."""
    for a, b, c in zip(ts, ts[1:], ts[2:], strict=False):
        if a.value == name and a.kind in ("name", "string") and b.text == ":":
            return c
    return None


_TYPES = {"string": "varchar", "number": "int", "boolean": "boolean", "Date": "timestamp", "Buffer": "bytea"}
_SPECIAL = {"CreateDateColumn": "timestamp", "UpdateDateColumn": "timestamp", "DeleteDateColumn": "timestamp", "VersionColumn": "int"}


def typeorm_entities(ts: list[Token]) -> list[dict]:
    """@Entity classes with their column decorators; many-to-one always owns its key, one-to-one with a join column."""
    out, i = [], 0
    while i + 1 < len(ts):
        if not (ts[i].text == "@" and ts[i + 1].text == "Entity"):
            i += 1
            continue
        args_end = skip(ts, i + 2) if i + 2 < len(ts) and ts[i + 2].text == "(" else i + 2
        args = ts[i + 3 : args_end - 1] if args_end > i + 2 else []
        k = args_end
        while k < len(ts) and ts[k].text != "class":
            k = skip(ts, k) if ts[k].text == "(" else k + 1
        if k + 1 >= len(ts):
            break
        name = ts[k + 1].text
        while k < len(ts) and ts[k].text != "{":
            k += 1
        end = skip(ts, k)
        body = ts[k + 1 : end - 1]
        table = args[0].value if args and args[0].kind == "string" else None
        opt, schema = _option(args, "name"), _option(args, "schema")
        if table is None and opt is not None and opt.kind == "string":
            table = opt.value
        fields, relations, j = [], [], 0
        while j < len(body):
            if body[j].text != "@":
                j = skip(body, j)
                continue
            decorators: dict[str, list[Token]] = {}
            while j + 1 < len(body) and body[j].text == "@":
                what, stop = body[j + 1].text, j + 2
                inner: list[Token] = []
                if stop < len(body) and body[stop].text == "(":
                    close = skip(body, stop)
                    inner, stop = body[stop + 1 : close - 1], close
                decorators[what], j = inner, stop
            while j < len(body) and body[j].text in ("public", "private", "protected", "readonly", "declare", "static"):
                j += 1
            if j >= len(body):
                break
            field, j = body[j].value, j + 1
            if j < len(body) and body[j].text in ("!", "?"):
                j += 1
            kind: list[str] = []
            if j < len(body) and body[j].text == ":":
                j += 1
                while j < len(body) and body[j].text not in (";", "=", "@") and not (kind and body[j].line > body[j - 1].line and body[j - 1].text not in ("|", "&")):
                    kind.append(body[j].text)
                    j += 1
            while j < len(body) and body[j].text not in (";", "@") and not (body[j].line > body[j - 1].line):
                j = skip(body, j)
            if j < len(body) and body[j].text == ";":
                j += 1
            base = next((x for x in kind if x not in ("|", "null", "undefined")), "unknown")
            column = next((d for d in decorators if d == "Column" or d.startswith("Primary") or d in _SPECIAL), None)
            if column:
                inner = decorators[column]
                named, typed = _option(inner, "name"), _option(inner, "type")
                sql = inner[0].value if inner and inner[0].kind == "string" else typed.value if typed is not None else None
                if column == "PrimaryGeneratedColumn":
                    sql = "uuid" if sql == "uuid" else "int" if sql in (None, "increment", "rowid", "identity") else sql
                optional = _option(inner, "nullable")
                fields.append(
                    {"name": field, "type": sql or _SPECIAL.get(column) or _TYPES.get(base, base), "column": named.value if named is not None else field,
                     "nullable": optional is not None and optional.text == "true" or optional is None and column == "DeleteDateColumn", "is_pk": column.startswith("Primary"), "is_fk": False}
                )
            owner = "ManyToOne" in decorators or "OneToOne" in decorators and "JoinColumn" in decorators
            if owner:
                inner = decorators.get("ManyToOne", decorators.get("OneToOne"))
                target = next((t.text for a, t in zip(inner, inner[1:], strict=False) if a.text == "=>" and t.kind == "name"), None) or next((t.value for t in inner if t.kind in ("string",)), base)
                join = decorators.get("JoinColumn", [])
                named, ref = _option(join, "name"), _option(join, "referencedColumnName")
                optional = _option(inner, "nullable")
                col = named.value if named is not None else camel(field, ref.value if ref is not None else "id")
                fields.append({"name": field, "type": "unknown", "column": col, "nullable": not (optional is not None and optional.text == "false"), "is_pk": False, "is_fk": True})
                relations.append({"from_field": field, "from_col": col, "target": target, "target_col": ref.value if ref is not None else "id"})
        out.append({"name": name, "orm": "typeorm", "table_schema": schema.value if schema is not None else None, "table_name": table or snake(name), "explicit": table is not None, "fields": fields, "relations": relations})
        i = end
    return out


def drizzle_entities(ts: list[Token]) -> list[dict]:
    """const x = pgTable("name", { column: type("name").primaryKey()... }) and tables of a pgSchema."""
    schemas, out = {}, []
    for a, b, c, d, e in zip(ts, ts[1:], ts[2:], ts[3:], ts[4:], strict=False):
        if b.text == "=" and c.text in ("pgSchema", "mysqlSchema") and d.text == "(" and e.kind == "string":
            schemas[a.text] = e.value
    for i in range(len(ts) - 4):
        if ts[i + 1].text != "=" or ts[i].kind != "name":
            continue
        j, schema = i + 2, None
        if ts[j].text in ("pgTable", "mysqlTable", "sqliteTable") and ts[j + 1].text == "(":
            j += 1
        elif ts[j].text in schemas and ts[j + 1].text == "." and ts[j + 2].text == "table" and j + 3 < len(ts) and ts[j + 3].text == "(":
            schema, j = schemas[ts[j].text], j + 3
        else:
            continue
        inner = ts[j + 1 : skip(ts, j) - 1]
        if not inner or inner[0].kind != "string":
            continue
        table, k = inner[0].value, 1
        while k < len(inner) and inner[k].text != "{":
            k += 1
        body = inner[k + 1 : skip(inner, k) - 1]
        fields, relations, k = [], [], 0
        while k + 2 < len(body):
            field = body[k].value
            if body[k + 1].text != ":":
                k += 1
                continue
            kind, k = body[k + 2].text, k + 3
            args: list[Token] = []
            if k < len(body) and body[k].text == "(":
                stop = skip(body, k)
                args, k = body[k + 1 : stop - 1], stop
            names = [t.value for t in args if t.kind == "string"]
            chain: dict[str, list[Token]] = {}
            while k + 1 < len(body) and body[k].text == ".":
                what, k = body[k + 1].text, k + 2
                call: list[Token] = []
                if k < len(body) and body[k].text == "(":
                    stop = skip(body, k)
                    call, k = body[k + 1 : stop - 1], stop
                chain[what] = call
            while k < len(body) and body[k].text != ",":
                k = skip(body, k)
            k += 1
            column = names[0] if names and args and args[0].kind == "string" else field
            pk = "primaryKey" in chain
            fields.append({"name": field, "type": kind, "column": column, "nullable": not (pk or "notNull" in chain), "is_pk": pk, "is_fk": "references" in chain})
            if "references" in chain:
                target = next(((a.text, c.text) for a, b, c in zip(chain["references"], chain["references"][1:], chain["references"][2:], strict=False) if a.kind == "name" and b.text == "." and c.kind == "name"), None)
                if target:
                    relations.append({"from_field": field, "from_col": column, "target": target[0], "target_col": target[1]})
        out.append({"name": ts[i].text, "orm": "drizzle", "table_schema": schema, "table_name": table, "explicit": True, "fields": fields, "relations": relations})
    return out
