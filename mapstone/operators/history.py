"""The time axis: timelines of commits and tags, and differences between sampled waypoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: for how many built snapshots a timeline carries counts.
MAX_COUNTED = 20


def timeline(log: DataFrame, tags: DataFrame, built: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """pos, sha, date, subject, tags, milestone, built (and counts of the first built ones), newest first.

    log: pos, sha, date, subject, tags, in its own order, which stays. tags: name, sha, date; those outside the log go before the first
    commit that is older (dates compare as text, as they are written). built: sha.
    """
    points = log.select("pos", "sha", "date", "subject", "tags", F.lit(0).alias("part"), F.lit(0).alias("nth"))
    outside = tags.where("date IS NOT NULL").join(log.select("sha"), "sha", "left_anti").groupBy("sha").agg(F.min_by(F.struct("name", "date"), "name").alias("t"))
    ends = log.select(F.col("pos").alias("p"), F.col("date").alias("d"))
    placed = outside.select("sha", "t.*").join(ends, F.col("d") < F.col("date"), "left").groupBy("sha", "name", "date").agg(F.min("p").alias("p"))
    last = log.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))
    placed = placed.join(F.broadcast(last)).select(  # last is one row
        F.coalesce("p", F.col("last") + 1).alias("pos"), "sha", "date", F.col("name").alias("subject"), F.array("name").alias("tags"), F.lit(-1).alias("part"),
        F.row_number().over(Window.partitionBy("p").orderBy(F.desc("date"), "name")).alias("nth"),
    )
    all_ = points.unionByName(placed).join(built.select("sha", F.lit(True).alias("built")), "sha", "left").na.fill({"built": False})
    order = Window.orderBy("pos", "part", "nth")
    out = all_.withColumn("row", F.row_number().over(order) - 1).withColumn("nth_built", F.sum(F.col("built").cast("int")).over(order))
    out = out.select(F.col("row").alias("pos"), "sha", "date", "subject", "tags", (F.size("tags") > 0).alias("milestone"), "built", "nth_built")
    if counts is not None:
        out = out.join(counts, "sha", "left").withColumns({c: F.when(F.col("built") & (F.col("nth_built") <= MAX_COUNTED), F.col(c)) for c in counts.columns if c != "sha"})
    return out.drop("nth_built")


def sample_evenly(items: DataFrame, most: int, pos: str = "pos") -> DataFrame:
    """At most `most` rows, evenly spread over positions 0.. n-1, the first and last among them."""
    if most <= 0:
        return items.limit(0)
    n = items.count()
    if n <= most:
        return items
    picked = sorted({int(i * (n - 1) / max(1, most - 1) + 0.5) for i in range(most)})
    return items.where(F.col(pos).isin(picked))


def waypoints(first: str, last: str, tagged: DataFrame, most: int = 5) -> DataFrame:
    """pos, label: from the first over evenly sampled tagged commits (pos, label, oldest first) to the last."""
    spark = tagged.sparkSession
    mid = sample_evenly(tagged, max(0, most - 2)).select(F.lit(1).alias("part"), "pos", "label")
    ends = spark.createDataFrame([(0, 0, first)] + ([(2, 0, last)] if last != first else []), "part int, pos int, label string")
    return ends.unionByName(mid).select((F.row_number().over(Window.orderBy("part", "pos")) - 1).alias("pos"), "label")


def intervals(points: DataFrame) -> DataFrame:
    """pos, base, head: neighbours of the waypoints."""
    w = Window.orderBy("pos")
    return points.select("pos", F.col("label").alias("base"), F.lead("label").over(w).alias("head")).where("head IS NOT NULL")
