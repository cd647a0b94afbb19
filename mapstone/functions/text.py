"""Line counts, Markdown facts and doc-comment paragraphs."""

from __future__ import annotations

import re
import textwrap

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest kept size of a document, and the marker at the end of one that was cut. Fixed value: the size.
DOC_MAX_BYTES = 131_072
CUT_MARKER = "\n\n… (truncated)\n"
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
DOC_MAX_CHARS = 1000


def count_lines(text) -> Column:
    """Line ends plus one; none for an empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"))) + 1)


def count_lines_py(text: str) -> int:
    return text.count("\n") + 1 if text else 0


def cut_document(text) -> Column:
    """Content of at most DOC_MAX_BYTES, cut on a character and then after the last whole line, and marked."""
    t = F.regexp_replace(text, "\r\n", "\n")
    head = F.substring(t.cast("binary"), 1, DOC_MAX_BYTES)
    # a cut within a character leaves at most three bytes of it: drop the first invalid tail
    whole = F.coalesce(*[F.try_validate_utf8(F.substring(head, 1, DOC_MAX_BYTES - k).cast("string")) for k in range(4)])
    last = F.length(whole) - F.instr(F.reverse(whole), "\n")
    kept = F.when(F.instr(whole, "\n") > 1, F.substring(whole, F.lit(1), last)).otherwise(whole)
    return F.when(F.octet_length(t) > DOC_MAX_BYTES, F.concat(kept, F.lit(CUT_MARKER))).otherwise(t)


def truncated_document(text) -> Column:
    return F.octet_length(F.regexp_replace(text, "\r\n", "\n")) > DOC_MAX_BYTES


def headings(docs: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, line_no, depth, text of Markdown headings outside fences. Fences are a running count of fence lines."""
    lines = docs.select(key, F.posexplode(F.split(content, "\n")).alias("line_no", "line"))
    fence = F.col("line").rlike("^(```|~~~)")
    inside = F.sum(fence.cast("int")).over(Window.partitionBy(key).orderBy("line_no")) % 2 == 1
    found = lines.withColumn("inside", inside).where(~F.col("inside") & ~fence & F.col("line").rlike(HEADING))
    return found.select(key, "line_no", F.length(F.regexp_extract("line", HEADING, 1)).alias("depth"), F.regexp_extract("line", HEADING, 2).alias("text"))


def titles(docs: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, title, n_headings: the first heading of depth 1, else the first heading, else the file's name."""
    found = headings(docs, key, content)
    best = found.groupBy(key).agg(
        F.min_by("text", F.struct((F.col("depth") != 1).alias("other"), "line_no")).alias("heading"), F.count("*").alias("n_headings")
    )
    name = F.element_at(F.split(key, "/"), -1)
    return docs.select(key).join(best, key, "left").select(key, F.coalesce("heading", name).alias("title"), F.coalesce("n_headings", F.lit(0)).alias("n_headings"))


def markdown_facts(path: str, source: str) -> dict:
    """The same facts of one document in plain Python, for extraction inside a partition."""
    text, cut = source.replace("\r\n", "\n"), False
    data = text.encode()
    if len(data) > DOC_MAX_BYTES:
        text = data[:DOC_MAX_BYTES].decode("utf-8", "ignore")
        at = text.rfind("\n")
        text, cut = (text[:at] if at > 0 else text) + CUT_MARKER, True
    found, inside = [], False
    for line in text.split("\n"):
        if line.startswith(("```", "~~~")):
            inside = not inside
        elif not inside and (m := re.match(HEADING, line)):
            found.append({"depth": len(m[1]), "text": m[2]})
    first = next((h for h in found if h["depth"] == 1), found[0] if found else None)
    return {"path": path, "title": first["text"] if first else path.rsplit("/", 1)[-1], "headings": found, "content": text, "truncated": cut}


def _paragraph(lines: list[str]) -> str | None:
    """The first paragraph as one line, at most DOC_MAX_CHARS long."""
    out: list[str] = []
    for line in lines:
        if line.strip():
            out.append(line.strip())
        elif out:
            break
    text = " ".join(out)
    if not text:
        return None
    return text if len(text) <= DOC_MAX_CHARS else text[: DOC_MAX_CHARS - 1] + "…"


def js_doc(raw: str) -> str | None:
    """First paragraph of a block comment; tags that label a file count as text, any other tag ends it."""
    body = re.sub(r"\*/\s*$", "", re.sub(r"^\s*/\*+", "", raw))
    lines = []
    for line in body.split("\n"):
        line = re.sub(r"^\s*\* ?", "", line).rstrip()
        m = re.match(r"\s*@(\w+)\s*(.*)", line)
        if m and m[1] in ("fileoverview", "module", "file", "description", "summary"):
            line = m[2]
        elif m:
            break
        lines.append(line)
    return _paragraph(lines)


def py_doc(body: str) -> str | None:
    first, _, rest = body.partition("\n")
    return _paragraph([first.strip(), *textwrap.dedent(rest).split("\n")])
