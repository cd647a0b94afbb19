"""Identities of nodes and edges, as Python functions and as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix of each kind's identities. Fixed values.
PREFIX = {"module": "mod", "file": "file", "symbol": "sym", "entity": "ent", "table": "tbl", "extpkg": "pkg", "doc": "doc"}
PATTERN = r"^(mod|file|sym|ent|tbl|pkg|doc):(.+)$"


def node_id(kind: str, *parts: str) -> str:
    """node_id("symbol", path, name), node_id("table", schema, name), node_id("file", path), ..."""
    return f"{PREFIX[kind]}:{('#' if kind in ('symbol', 'entity') else '.').join(parts)}"


def node_id_col(kind: str, *parts) -> Column:
    return F.concat(F.lit(PREFIX[kind] + ":"), F.concat_ws("#" if kind in ("symbol", "entity") else ".", *parts))


def is_node_id(value: str) -> bool:
    return re.match(PATTERN, value, re.S) is not None


def is_node_id_col(value) -> Column:
    return F.col(value).rlike(PATTERN)


def parse_node_id(value: str) -> dict:
    """kind, rest and, for symbols and entities, path and name (split at the first #). Raises on anything else."""
    m = re.match(PATTERN, value, re.S)
    if not m:
        raise ValueError(f"not a node id: {value}")
    kind = next(k for k, p in PREFIX.items() if p == m[1])
    out = {"kind": kind, "rest": m[2]}
    if kind in ("symbol", "entity"):
        path, hash_, name = m[2].partition("#")
        if not hash_ or not path or not name:
            raise ValueError(f"not a node id: {value}")
        out |= {"path": path, "name": name}
    return out


def rest_col(value) -> Column:
    """What follows the prefix."""
    return F.regexp_extract(value, PATTERN, 2)


def edge_id(kind: str, src: str, dst: str) -> str:
    return f"{kind}|{src}|{dst}"


def normalize_path(path: str) -> str:
    path = path.replace("\\", "/")
    return path[2:] if path.startswith("./") else path


def normalize_path_col(path) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")
