"""Live schemas by JDBC: the catalogs of PostgreSQL and MySQL, read-only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.drift import Live

_PG_SYSTEM = "n.nspname NOT IN ('pg_catalog', 'information_schema') AND n.nspname NOT LIKE 'pg_%'"


def redact(message: str, url: str) -> str:
    """A message without the URL and its password."""
    out = message.replace(url, "<url>")
    m = re.search(r"://[^:/@]*:([^@]+)@", url)
    return out.replace(m[1], "<password>") if m else out


def _in(column: str, schemas: list[str] | None) -> str:
    if not schemas:
        return ""
    names = ", ".join("'" + s.replace("'", "''") + "'" for s in schemas)
    return f" AND {column} IN ({names})"


def postgres_queries(schemas: list[str] | None = None) -> dict[str, str]:
    """Catalog queries: tables, columns (with keys), and foreign keys paired by position."""
    tables = f"SELECT n.nspname AS schema, c.relname AS \"table\" FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind IN ('r', 'p') AND {_PG_SYSTEM}{_in('n.nspname', schemas)}"
    columns = f"""SELECT n.nspname AS schema, c.relname AS "table", a.attname AS "column", a.attnum AS pos, t.typname AS sql_type, NOT a.attnotnull AS nullable,
        EXISTS (SELECT 1 FROM pg_index i WHERE i.indrelid = c.oid AND i.indisprimary AND a.attnum = ANY (i.indkey)) AS is_pk
        FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_type t ON t.oid = a.atttypid
        WHERE c.relkind IN ('r', 'p') AND a.attnum > 0 AND NOT a.attisdropped AND {_PG_SYSTEM}{_in('n.nspname', schemas)}"""
    keys = f"""SELECT n.nspname AS schema, c.relname AS "table", a.attname AS from_col, fn.nspname AS to_schema, fc.relname AS to_table, fa.attname AS to_col
        FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid JOIN pg_namespace n ON n.oid = c.relnamespace
        JOIN pg_class fc ON fc.oid = k.confrelid JOIN pg_namespace fn ON fn.oid = fc.relnamespace
        CROSS JOIN LATERAL unnest(k.conkey, k.confkey) AS u(x, y)
        JOIN pg_attribute a ON a.attrelid = k.conrelid AND a.attnum = u.x JOIN pg_attribute fa ON fa.attrelid = k.confrelid AND fa.attnum = u.y
        WHERE k.contype = 'f' AND {_PG_SYSTEM}{_in('n.nspname', schemas)}"""
    return {"tables": tables, "columns": columns, "keys": keys}


def mysql_queries(schemas: list[str] | None, current: str) -> dict[str, str]:
    """The same from information_schema; the scope is what is asked for and the current database. tinyint(1) keeps its width."""
    scope = sorted({*(schemas or []), current})
    tables = f"SELECT table_schema AS `schema`, table_name AS `table` FROM information_schema.tables WHERE table_type = 'BASE TABLE'{_in('table_schema', scope)}"
    columns = f"""SELECT c.table_schema AS `schema`, c.table_name AS `table`, c.column_name AS `column`, c.ordinal_position AS pos,
        IF(c.column_type LIKE 'tinyint(1)%', 'tinyint(1)', c.data_type) AS sql_type, c.is_nullable = 'YES' AS nullable, c.column_key = 'PRI' AS is_pk
        FROM information_schema.columns c WHERE 1 = 1{_in('c.table_schema', scope)}"""
    keys = f"""SELECT table_schema AS `schema`, table_name AS `table`, column_name AS from_col, referenced_table_schema AS to_schema, referenced_table_name AS to_table,
        referenced_column_name AS to_col FROM information_schema.key_column_usage WHERE referenced_table_name IS NOT NULL{_in('table_schema', scope)}"""
    return {"tables": tables, "columns": columns, "keys": keys}


def introspect(spark: SparkSession, url: str, schemas: list[str] | None = None, options: dict | None = None) -> Live:
    """A live database's schema; errors are raised without the URL or its password."""
    mysql = re.match(r"(jdbc:)?mysql", url) is not None
    current = re.search(r"//[^/]+/([^?]+)", url)
    current = current[1] if current else ""
    queries = mysql_queries(schemas, current) if mysql else postgres_queries(schemas)

    def read(query: str) -> DataFrame:
        try:
            return spark.read.format("jdbc").options(url=url if url.startswith("jdbc:") else f"jdbc:{url}", query=query, **(options or {})).load()
        except Exception as e:
            raise RuntimeError(redact(str(e), url)) from None

    columns = read(queries["columns"]).withColumns({"pos": F.col("pos").cast("int") - 1, "nullable": F.col("nullable").cast("boolean"), "is_pk": F.col("is_pk").cast("boolean")})
    return Live(read(queries["tables"]), columns, read(queries["keys"]), current if mysql else "public")
