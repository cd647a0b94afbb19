"""The commit graph as a table: which commits lie in a range, and the waypoints of many ranges in one plan.

Histories are long and thin, so walking them parent by parent takes a round for each generation. Here commits are
dealt into chains first: of the children whose first parent a commit is, its chain goes on in the one with the most commits above
it (LOOK_BACK generations are counted), so that short branches don't cut a long trunk into pieces.
Places along the chains come from pointer doubling, in log rounds. Whoever reaches a commit reaches the rest of its chain,
so what a start reaches is one number for each chain, and a round follows all links between chains at once: there are as many
rounds as branches are nested, whatever the length of the history.

commits: sha, pos (place in the log, newest first; children before parents), parents (array, first parent first), tags, date.
Parents that are not in the table count as absent; repeated rows of a commit count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .algo import checkpointed

#: Fixed value: commits of a range, newest first, among which tags are looked for.
LOG_LIMIT = 1_000
#: How often the generations that are counted above a commit are doubled; it shapes the chains only, not what is reached.
LOOK_BACK = 4
#: After how many doublings chains whose ends have met are put aside.
PUT_ASIDE = 4


def parents(commits: DataFrame) -> DataFrame:
    """child, child_pos, parent, nth of every link between two commits of the table."""
    own = commits.select("sha", "pos", "parents").dropDuplicates(["sha"])
    each = own.select(F.col("sha").alias("child"), F.col("pos").alias("child_pos"), F.posexplode("parents").alias("nth", "parent"))
    return each.join(own.select(F.col("sha").alias("parent")), "parent", "left_semi").where("child <> parent")


def _above(first: DataFrame) -> DataFrame:
    """child, size: how many commits descend from a child over first parents within 2 ** LOOK_BACK generations, itself included."""
    at = first.select(F.col("child").alias("sha"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("size"))
    for k in range(LOOK_BACK):  # those of twice as many generations: what the commits that many generations above have counted
        more = at.where("up IS NOT NULL").groupBy(F.col("up").alias("sha")).agg(F.sum("size").alias("more"))
        at = at.join(more, "sha", "left").select("sha", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        if k < LOOK_BACK - 1:
            at = checkpointed(at)
            at = at.join(at.select(F.col("sha").alias("up"), F.col("up").alias("up2")), "up", "left").select("sha", F.col("up2").alias("up"), "size")
    return at.select(F.col("sha").alias("child"), "size")


def chains(commits: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """sha, chain (the commit that it starts with), place (from 0) of every commit."""
    links = checkpointed(parents(commits)) if links is None else links
    first = links.where("nth = 0").select("child", "child_pos", "parent")
    follows = first.join(_above(first), "child").groupBy("parent").agg(F.max_by("child", F.struct("size", -F.col("child_pos"), "child")).alias("up"))
    ends = follows.select(F.col("up").alias("sha"), F.lit(True).alias("on"))  # the chain goes on below these
    at = commits.select("sha").distinct().join(follows.withColumnRenamed("parent", "sha"), "sha", "left").join(ends, "sha", "left")
    at = checkpointed(at.select("sha", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("place"), F.coalesce("up", "sha").alias("top"), F.col("on").isNull().alias("last")))
    aside, k = [], 0
    while not at.where("up IS NOT NULL").isEmpty():  # doubles what each commit looks over
        above = at.select(F.col("sha").alias("up"), F.col("up").alias("up2"), F.col("place").alias("more"), F.col("top").alias("top2"))
        at = at.join(above, "up", "left").select("sha", F.col("up2").alias("up"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.coalesce("top2", "top").alias("top"), "last")
        at, k = checkpointed(at), k + 1
        if k % PUT_ASIDE == 0:  # a chain whose last commit knows the first is done
            done = at.where("last AND up IS NULL").select("top", F.lit(True).alias("done"))
            told = checkpointed(at.join(done, "top", "left"))
            aside.append(told.where("done").select("sha", F.col("top").alias("chain"), "place"))
            at = told.where("done IS NULL").drop("done")
    out = at.select("sha", F.col("top").alias("chain"), "place")
    for x in aside:
        out = out.unionByName(x)
    return out


class History:
    """A commit table with its chains and the links between them, made once for any number of questions."""

    def __init__(self, commits: DataFrame) -> None:
        self.commits = checkpointed(commits.dropDuplicates(["sha"]))
        links = checkpointed(parents(self.commits))
        self.chains = chains(self.commits, links)
        child, parent = (self.chains.select(F.col("sha").alias(s), F.col("chain").alias(f"{p}_chain"), F.col("place").alias(f"{p}_place")) for s, p in (("child", "from"), ("parent", "to")))
        across = links.join(child, "child").join(parent, "parent").where("from_chain <> to_chain OR to_place <> from_place + 1")
        self.links = checkpointed(across.select("from_chain", "from_place", "to_chain", "to_place"))

    def reached(self, starts: DataFrame) -> DataFrame:
        """key, chain, place: from there on a chain is reached by the starts (key, sha) of that key. A start reaches itself."""
        state = checkpointed(starts.join(self.chains, "sha").groupBy("key", "chain").agg(F.min("place").alias("place")))
        fresh = state.withColumn("until", F.lit(None).cast("long"))
        while True:
            # a chain now reached from an earlier place on: only the links between the two places are new
            on = fresh.join(self.links.withColumnRenamed("from_chain", "chain"), "chain").where("from_place >= place AND (until IS NULL OR from_place < until)")
            found = on.groupBy("key", F.col("to_chain").alias("chain")).agg(F.min("to_place").alias("place"))
            fresh = checkpointed(found.join(state.withColumnRenamed("place", "until"), ["key", "chain"], "left").where("until IS NULL OR place < until").select("key", "chain", "place", "until"))
            if fresh.isEmpty():
                return state
            state = checkpointed(state.unionByName(fresh.select("key", "chain", "place")).groupBy("key", "chain").agg(F.min("place").alias("place")))

    def _inside(self, ranges: DataFrame) -> DataFrame:
        """key, sha of the commits that head reaches and base doesn't; ranges: key, base, head."""
        ends = ranges.select("key", F.explode(F.array(F.struct(F.lit(True).alias("is_head"), F.col("head").alias("sha")), F.struct(F.lit(False).alias("is_head"), F.col("base").alias("sha")))).alias("e"))
        got = self.reached(ends.select(F.struct("key", "e.is_head").alias("key"), "e.sha")).select("key.key", "key.is_head", "chain", "place")  # both ends in the same rounds
        end, begin = got.where("is_head").drop("is_head"), got.where("NOT is_head").select("key", "chain", F.col("place").alias("stop"))
        spans = end.join(begin, ["key", "chain"], "left").where("stop IS NULL OR place < stop").withColumnRenamed("place", "start")
        inside = self.chains.join(spans, "chain").where("place >= start AND (stop IS NULL OR place < stop)")
        return inside.select("key", "sha")

    def between(self, ranges: DataFrame) -> DataFrame:
        """key and the commit's columns for the commits that head reaches and base doesn't; ranges: key, base, head."""
        return self._inside(ranges).join(self.commits, "sha")

    def is_ancestor(self, pairs: DataFrame) -> DataFrame:
        """key, ancestor: whether head reaches base; pairs: key, base, head."""
        got = self.reached(pairs.select(F.col("head").alias("key"), F.col("head").alias("sha")).distinct()).withColumnRenamed("key", "head")  # each head once, however many bases it is asked for
        at = pairs.select("key", "head", F.col("base").alias("sha")).join(self.chains, "sha", "left").withColumnRenamed("place", "own")
        return at.join(got, ["head", "chain"], "left").select("key", F.coalesce(F.col("own") >= F.col("place"), F.lit(False)).alias("ancestor"))

    def waypoints(self, ranges: DataFrame, most: int = 5, limit: int = LOG_LIMIT) -> DataFrame:
        """key, nth, sha, label, date of each range, from its base over evenly sampled tagged commits to its head.

        ranges: key, base, head, base_label, head_label. Tags are looked for among the newest `limit` commits of a range.
        """
        newest = Window.partitionBy("key").orderBy("pos")
        log = self._inside(ranges).join(self.commits.select("sha", "pos"), "sha").withColumn("row", F.row_number().over(newest)).where(F.col("row") <= limit)
        log = log.select("key", "sha").join(self.commits, "sha")
        tagged = log.where("size(tags) > 0").join(ranges.select("key", F.col("head").alias("sha")), ["key", "sha"], "left_anti")
        every = Window.partitionBy("key")
        tagged = tagged.withColumn("n", F.count("*").over(every)).withColumn("i", F.row_number().over(every.orderBy(F.desc("pos"))) - 1)
        room = max(0, most - 2)
        even = F.expr(f"exists(sequence(0, {max(0, room - 1)}), k -> i = floor(k * (n - 1) / {max(1, room - 1)} + 0.5D))") if room else F.lit(False)
        mid = tagged.where((F.col("n") <= room) | even).select("key", F.lit(1).alias("part"), "i", "sha", F.array_join("tags", ", ").alias("label"), "date")
        dates = self.commits.select("sha", "date")
        first = ranges.select("key", F.lit(0).alias("part"), F.lit(0).alias("i"), F.col("base").alias("sha"), F.col("base_label").alias("label")).join(dates, "sha", "left")
        last = ranges.where("head <> base").select("key", F.lit(2).alias("part"), F.lit(0).alias("i"), F.col("head").alias("sha"), F.col("head_label").alias("label")).join(dates, "sha", "left")
        order = Window.partitionBy("key").orderBy("part", "i")
        return first.unionByName(mid).unionByName(last).select("key", (F.row_number().over(order) - 1).alias("nth"), "sha", "label", "date")


def neighbours(points: DataFrame) -> DataFrame:
    """interval (key and number of its first point), key, nth, base, head, base_label, head_label of waypoints that follow each other."""
    w = Window.partitionBy("key").orderBy("nth")
    pairs = points.select("key", "nth", F.col("sha").alias("base"), F.lead("sha").over(w).alias("head"), F.col("label").alias("base_label"), F.lead("label").over(w).alias("head_label"))
    return pairs.where("head IS NOT NULL").withColumn("interval", F.concat_ws("/", "key", "nth"))
