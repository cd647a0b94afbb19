"""Storage families of SQL and ORM type spellings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Family of each known spelling; what isn't here is its own family. Fixed values.
FAMILIES = {
    "text": "string text str unicode unicodetext varchar bpchar char longtext mediumtext tinytext charfield textfield emailfield urlfield"
    " slugfield filefield filepathfield imagefield genericipaddressfield",
    "integer": "int integer smallinteger int2 int4 serial smallserial smallint mediumint tinyint year integerfield positiveintegerfield"
    " smallintegerfield positivesmallintegerfield",
    "bigint": "bigint biginteger int8 bigserial bigintegerfield positivebigintegerfield",
    "double": "float double double_precision float4 float8 real doubleprecision floatfield",
    "numeric": "decimal numeric decimalfield",
    "boolean": "boolean bool tinyint(1) booleanfield",
    "timestamp": "datetime datetime.datetime timestamp timestamptz datetimefield",
    "date": "date datefield",
    "time": "time timetz timefield",
    "interval": "durationfield",
    "json": "json jsonb jsonfield",
    "uuid": "uuid uuidfield",
    "bytea": "bytes largebinary bytea binary varbinary blob longblob mediumblob tinyblob binaryfield",
}
FAMILY = {spelling: family for family, spellings in FAMILIES.items() for spelling in spellings.split()}
#: Spellings of Spark's own catalog, used when a Spark schema is the live side.
SPARK_FAMILY = {"timestamp_ntz": "timestamp"}


def sql_family(raw: str, extra: dict[str, str] | None = None) -> str:
    known = FAMILY | (extra or {})
    low = raw.lower().strip()
    base = re.sub(r"\(.*\)$", "", low).strip()
    last = base.split(".")[-1]
    return known.get(low) or known.get(base) or known.get(last, last)


def sql_family_col(raw, extra: dict[str, str] | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for kv in (FAMILY | (extra or {})).items() for x in kv])
    low = F.trim(F.lower(F.col(raw) if isinstance(raw, str) else raw))
    base = F.trim(F.regexp_replace(low, r"\(.*\)$", ""))
    last = F.element_at(F.split(base, r"\."), -1)
    return F.coalesce(known[low], known[base], known[last], last)
