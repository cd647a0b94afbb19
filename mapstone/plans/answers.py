"""Answers of many modules in one plan, each cut at the budget as the writer would cut it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.budget import clamp_budget, fitted_lists, max_chars, suggest_budget, utf16_length_col
from ..schema import Graph


def module_answers(g: Graph, budget: int | None = None) -> DataFrame:
    """id, shown, total, answer: for every module its files, those of most lines first, as Markdown within the budget."""
    budget = clamp_budget(budget)
    title = F.concat(F.lit("# "), "name")
    heads = g.nodes.where("kind = 'module'").select(F.col("id").alias("key"), title.alias("title"))
    room = heads.select("key", (F.lit(max_chars(budget) + 1) - (utf16_length_col("title") + 1) - 1).alias("left"))
    files = g.nodes.where("kind = 'file'").select(F.col("parent").alias("key"), "id", F.coalesce("loc", F.lit(0)).alias("loc"))
    pos = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("loc"), "id"))
    lines = files.select("key", pos.alias("pos"), F.concat(F.lit("- "), F.expr("substring(id, 6)"), F.lit(": "), F.col("loc").cast("string"), F.lit(" lines")).alias("line"))
    hint = lambda n: F.concat(F.lit("+"), n.cast("string"), F.lit(f" more files → ask with a budget of {suggest_budget(budget)}"))
    got = fitted_lists(lines, room, hint)
    answer = F.array_join(F.concat(F.array("title", F.lit("")), F.coalesce("listed", F.array().cast("array<string>"))), "\n")
    return heads.join(got, "key", "left").select(F.col("key").alias("id"), F.coalesce("shown", F.lit(0)).cast("long").alias("shown"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), answer.alias("answer"))
