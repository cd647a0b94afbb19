"""Mixing sources to target weights by hierarchical budgeting. DataFrame and SQL functions only.

The tree is domain > language > source. A node's weight is relative to its siblings. The token budget flows down: each
node's budget is shared among its children by weight, but no child gets more than its capacity (tokens below it times
max_epochs); what a short child can't take goes to its siblings by weight (water-filling, in closed form over windows of
siblings sorted by capacity per weight), and only when all siblings are full does the parent return the rest, that is
its own capacity, summed from its leaves, is what its ancestors' water-filling sees. Integer arithmetic throughout; a
share is rounded down, which leaves less than one token per child unspent.

A leaf with budget b and supply s gives b div s whole epochs and then the prefix, in the seeded order of the next
epoch, of at most b mod s tokens. Orders are md5(seed:epoch:doc_id). Prefix sums go over hash buckets first; only the one bucket that
holds the cut is sorted, so a source with a third of all rows is never gathered in a task.

Defined results: null languages and sources are the label (none); a null text has 0 tokens; documents of 0 tokens come
with the prefix they fall in; ties in order (repeated or null identifiers) are broken by row; nodes of weight 0 get
nothing; an empty table gives an empty result; other columns are ignored, or kept whole by mix_documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, without

LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}
NONE = "(none)"
PER_BUCKET = 2_000


def default_domain(source: Column) -> Column:
    """Four domains, by the first digit of a digest of the source's name."""
    return F.concat(F.lit("d"), ((F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(source.cast("binary")), 1, 1)) - 1) % 4).cast("string"))


def default_tokens(text: Column) -> Column:
    """A token estimate: UTF-8 bytes by four, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def _weight(level: str, weights: dict) -> Column:
    known = weights.get(level) or {}
    if not known:
        return F.lit(1).cast("long")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col(level)], F.lit(weights.get("default", 1))).cast("long")


def measured(docs: DataFrame, text="text", doc_id="doc_id", lang="lang", source="source", domain=default_domain, tokens=default_tokens, rid=None) -> DataFrame:
    """One stored row per document: id, rid (a row number of its own, or the given one), domain, lang, source, n_tokens."""
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    return materialize(
        docs.select(
            F.col(doc_id).cast("long").alias("id"),
            (rid if rid is not None else F.monotonically_increasing_id()).alias("rid"),
            domain(label(source)).alias("domain"),
            label(lang).alias("lang"),
            label(source).alias("source"),
            tokens(F.col(text)).alias("n_tokens"),
        ),
        "measured",
    )


def _fill(children: DataFrame, parent: list[str], level: str) -> DataFrame:
    """children: parent keys, level, weight, cap, budget (of the parent). Adds share."""
    w = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), level)
    before, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = children.where("weight > 0").withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    c = c.withColumn("w_rest", F.sum("weight").over(rest)).withColumn("full", F.expr("cap * w_rest <= left * weight"))
    # the first child that isn't full sets the level for itself and all after it
    c = c.withColumn("cut", F.first(F.when(~F.col("full"), F.struct("left", "w_rest")), ignorenulls=True).over(everyone))
    return c.withColumn("share", F.expr("if(full, cap, weight * cut.left div cut.w_rest)"))


def budgets(rows: DataFrame, weights: dict, total_share: float, max_epochs: int) -> DataFrame:
    """domain, lang, source, supply, docs, budget of every leaf."""
    leaf = materialize(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("docs")), "leaves")
    total = leaf.agg(F.floor(F.sum("supply") * F.lit(total_share)).cast("long")).first()[0] or 0
    shares = None
    for k, level in enumerate(LEVELS):
        keys = LEVELS[: k + 1]
        nodes = leaf.groupBy(*keys).agg((F.sum("supply") * max_epochs).alias("cap")).withColumn("weight", _weight(level, weights))
        nodes = nodes.withColumn("budget", F.lit(total).cast("long")) if shares is None else nodes.join(shares, LEVELS[:k])
        parent = LEVELS[:k] or [F.lit(0)]
        shares = _fill(nodes, parent, level).select(*keys, F.col("share").alias("budget"))
    return materialize(leaf.join(shares, LEVELS, "left").na.fill({"budget": 0}), "budgets")


def select_epochs(rows: DataFrame, leaf: DataFrame, seed: int) -> DataFrame:
    """rows' columns and epoch: every document once for each whole epoch, and the prefix of the last."""
    n = leaf.agg(F.sum("docs")).first()[0] or 0
    digits = max(1, min(8, math.ceil(math.log(max(2, n / PER_BUCKET), 16))))
    columns = rows.columns
    own = rows.join(leaf.where("supply > 0").select(*LEVELS, "supply", "budget"), LEVELS)
    own = own.withColumn("whole_epochs", F.expr("budget div supply")).withColumn("rest", F.expr("budget % supply"))
    full = own.where("whole_epochs > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, whole_epochs - 1)"))).select(*columns, "epoch")
    order = F.md5(F.concat_ws(":", F.lit(seed), "whole_epochs", F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"))
    part = own.where("rest > 0").withColumn("h", order).withColumn("bucket", F.substring("h", 1, digits))
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    sums = sums.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    part = part.join(sums, [*LEVELS, "bucket"]).where("ahead <= rest")
    taken = part.where("ahead + in_bucket <= rest")
    inside = Window.partitionBy(*LEVELS, "bucket").orderBy("h", "id", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = part.where("ahead + in_bucket > rest").withColumn("upto", F.col("ahead") + F.sum("n_tokens").over(inside)).where("upto <= rest")
    chosen = [x.select(*columns, F.col("whole_epochs").alias("epoch")) for x in (taken, cut)]
    return full.unionByName(chosen[0]).unionByName(chosen[1])


def mix(docs: DataFrame, weights: dict = WEIGHTS, total_share: float = 0.8, max_epochs: int = 2, seed: int = 7, **names) -> DataFrame:
    """One row for each document and epoch chosen: doc_id, epoch, domain, lang, source, n_tokens."""
    rows = measured(docs, **names)
    got = select_epochs(rows, budgets(rows, weights, total_share, max_epochs), seed)
    return got.select(F.col("id").alias("doc_id"), "epoch", *LEVELS, "n_tokens")


def mix_documents(
    docs: DataFrame, weights: dict = WEIGHTS, total_share: float = 0.8, max_epochs: int = 1, seed: int = 7, text="text", doc_id="doc_id", lang="lang", source="source", **how
) -> DataFrame:
    """The documents chosen, all columns; one that is chosen for several epochs repeats."""
    rows = numbered(docs, doc_id)
    own = rows.select("id", "rid", *(F.col("whole").getField(c).alias(x) for x, c in (("text", text), ("lang", lang), ("source", source))))
    thin = measured(own, doc_id="id", rid=F.col("rid"), **how)
    got = select_epochs(thin, budgets(thin, weights, total_share, max_epochs), seed).select("rid")
    if max_epochs == 1:
        return without(rows, thin.select("rid").join(got, "rid", "left_anti"))
    return rows.select("rid", "whole").join(materialize(got, "chosen"), "rid").select("whole.*")


def sql(weights: dict = WEIGHTS, total_share: float = 0.8, max_epochs: int = 2, seed: int = 7) -> str:
    """mix() over documents as DuckDB SQL."""

    def weight(level: str) -> str:
        known = weights.get(level) or {}
        return "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in known.items()) + f" ELSE {weights.get('default', 1)} END" if known else "1"

    ctes = [
        f"""m AS (SELECT doc_id, 'd' || (instr('0123456789abcdef', substr(md5(coalesce(source, '{NONE}')), 1, 1)) - 1) % 4 AS domain,
            coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source, CAST((strlen(coalesce(text, '')) + 3) // 4 AS BIGINT) AS n_tokens
            FROM documents)""",
        "leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply FROM m GROUP BY ALL)",
        f"s_ AS (SELECT CAST(floor(sum(supply) * {total_share}) AS BIGINT) AS budget FROM leaf)",
    ]
    for k, level in enumerate(LEVELS):
        keys, up = LEVELS[: k + 1], LEVELS[:k]
        part = f"PARTITION BY {', '.join(up)} " if up else ""
        on = " AND ".join(f"n.{x} = p.{x}" for x in up) or "true"
        a, parent = f"s{k}", f"s{k - 1}" if k else "s_"
        cols = ", ".join(keys)
        ctes += [
            f"n{k} AS (SELECT {cols}, CAST(sum(supply) * {max_epochs} AS BIGINT) AS cap, {weight(level)} AS weight FROM leaf GROUP BY {cols})",
            f"a{k} AS (SELECT n.*, p.budget FROM n{k} n JOIN {parent} p ON {on} WHERE weight > 0)",
            f"""b{k} AS (SELECT *, CAST(budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lft,
                CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_rest,
                row_number() OVER w AS rn FROM a{k} WINDOW w AS ({part}ORDER BY cap / weight, {level}))""",
            f"""c{k} AS (SELECT *, cap * w_rest <= lft * weight AS full_,
                min(CASE WHEN cap * w_rest > lft * weight THEN rn END) OVER ({part}) AS cut FROM b{k})""",
            f"""{a} AS (SELECT {', '.join('c.' + x for x in keys)}, CASE WHEN full_ THEN cap ELSE c.weight * (SELECT x.lft FROM c{k} x WHERE x.rn = c.cut
                {' '.join(f'AND x.{y} = c.{y}' for y in up)}) // (SELECT x.w_rest FROM c{k} x WHERE x.rn = c.cut {' '.join(f'AND x.{y} = c.{y}' for y in up)}) END AS budget FROM c{k} c)""",
        ]
    ctes += [
        "o AS (SELECT m.*, s2.budget // supply AS e, s2.budget % supply AS rest FROM m JOIN leaf USING (domain, lang, source) JOIN s2 USING (domain, lang, source) WHERE supply > 0)",
        f"""r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || e || ':' || doc_id), doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o)""",
    ]
    return (
        "WITH "
        + ",\n".join(ctes)
        + """ SELECT doc_id, CAST(epoch AS BIGINT) AS epoch, domain, lang, source, n_tokens FROM
        (SELECT *, unnest(range(e)) AS epoch FROM r UNION ALL SELECT *, e AS epoch FROM r WHERE rest > 0 AND upto <= rest)"""
    )
