"""Import edges, module weights and fans kept up to date by differences.

What an import may lead to (its candidates) doesn't depend on which files exist, so it is made once for each file that changes. When
files come, go or change, the importers to look at again are those files, and all importers one of whose candidates came or
went. Their edges are resolved again; edges of all others stay. Weights of module dependencies and fans change by the
edges that went and came. All state is four tables keyed by importer, pair and node; a round joins them with the change,
and nothing is made anew from the whole tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import edges_of
from .algo import checkpointed
from .build import FAN_TARGET, fan_metrics, merge_edges
from .resolve import candidate_files, import_candidates, resolved


@dataclass
class Resolution:
    """What specifiers are resolved with; see resolve.import_candidates."""

    aliases: dict[str, dict] | list
    workspaces: list[tuple[str, str]]
    roots: list[str]
    entries: dict[str, list[str]] | None = None


def weight_change(gone: DataFrame, come: DataFrame, modules: DataFrame) -> DataFrame:
    """src, dst, weight: by how much module dependencies change. gone, come: import edges (src, dst); modules: id, module of files, old and new."""

    def pairs(edges: DataFrame, sign: int) -> DataFrame:
        own = edges.where("kind = 'imports'").join(modules.toDF("src", "a"), "src").join(modules.toDF("dst", "b"), "dst").where("a <> b")
        return own.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(sign).cast("long").alias("weight"))

    return pairs(gone, -1).unionByName(pairs(come, 1)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def changed_weights(weights: DataFrame, change: DataFrame) -> DataFrame:
    """src, dst, weight after a change; a pair without weight is none."""
    return weights.unionByName(change).groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def changed_fans(fans: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """id, fan_in, fan_out after edges (kind, src, dst) went and came."""
    less = fan_metrics(gone).select("id", (-F.col("fan_in")).alias("fan_in"), (-F.col("fan_out")).alias("fan_out"))
    every = fans.unionByName(less).unionByName(fan_metrics(come))
    return every.groupBy("id").agg(F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out")).where("fan_in <> 0 OR fan_out <> 0")


def one_sided(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (kind, src, dst) that are only in the old, and only in the new."""
    key = ["kind", "src", "dst"]
    return old.select(*key).distinct().join(new.select(*key), key, "left_anti"), new.select(*key).distinct().join(old.select(*key), key, "left_anti")


def _dependency_edges(weights: DataFrame) -> DataFrame:
    return weights.select(F.lit("depends_on").alias("kind"), "src", "dst")


@dataclass
class Maintained:
    """files: path, module. candidates: see import_candidates. edges: raw edges of imports (kind, src, dst, symbols, registry). weights:
    src, dst, weight of module dependencies. fans: id, fan_in, fan_out over imports and module dependencies."""

    how: Resolution
    files: DataFrame
    candidates: DataFrame
    edges: DataFrame
    weights: DataFrame
    fans: DataFrame

    @staticmethod
    def start(how: Resolution, files: DataFrame, imports: DataFrame) -> Maintained:
        """Of a whole tree; files: path, module; imports: path, specifier, symbols."""
        none = [files.sparkSession.createDataFrame([], x) for x in ("path string, module string", "src string, dst string, weight long", "id string, fan_in long, fan_out long")]
        candidates = import_candidates(imports, how.aliases, how.workspaces, how.roots, how.entries)
        return Maintained(how, none[0], candidates.limit(0), resolved(candidates.limit(0), files.select("path")), none[1], none[2]).update(files, imports)

    def update(self, files: DataFrame, imports: DataFrame, removed: DataFrame | None = None) -> Maintained:
        """After a change. files: path, module of files that are new or changed; imports: all of theirs; removed: path of files that went."""
        removed = self.files.select("path").limit(0) if removed is None else removed.select("path").distinct()
        touched = checkpointed(files.select("path").unionByName(removed).distinct())
        after = checkpointed(self.files.join(touched, "path", "left_anti").unionByName(files.select("path", "module").dropDuplicates(["path"])))
        there = self.files.select("path")
        moved = after.select("path").join(there, "path", "left_anti").unionByName(there.join(after.select("path"), "path", "left_anti"))
        how = self.how
        candidates = self.candidates.join(touched, "path", "left_anti").unionByName(import_candidates(imports, how.aliases, how.workspaces, how.roots, how.entries))
        candidates = checkpointed(candidates)
        waiting = candidate_files(candidates).join(moved.select(F.col("path").alias("file")), "file", "left_semi").select("path")
        again = checkpointed(touched.unionByName(waiting).distinct())
        importer = F.concat(F.lit("file:"), "path").alias("src")
        fresh = resolved(candidates.join(again, "path", "left_semi"), after.select("path"))
        fresh, stale = checkpointed(fresh), self.edges.join(again.select(importer), "src", "left_semi")
        edges = checkpointed(self.edges.join(again.select(importer), "src", "left_anti").unionByName(fresh))
        gone, come = map(checkpointed, one_sided(stale, fresh))
        modules = self.files.unionByName(after).distinct().select(F.concat(F.lit("file:"), "path").alias("id"), F.concat(F.lit("mod:"), "module").alias("module"))
        weights = checkpointed(changed_weights(self.weights, weight_change(gone, come, modules)))
        less, more = one_sided(_dependency_edges(self.weights), _dependency_edges(weights))
        fans = checkpointed(changed_fans(self.fans, gone.unionByName(less), come.unionByName(more)))
        return Maintained(how, after, candidates, edges, weights, fans)

    def dependencies(self) -> DataFrame:
        """Module dependencies as edges."""
        return edges_of(self.weights.withColumns({"kind": F.lit("depends_on"), "source": F.lit("static"), "confidence": F.lit("certain")}))

    def merged(self) -> DataFrame:
        """One edge for each kind, source and target."""
        return merge_edges(self.edges.select("kind", "src", "dst", "symbols"))

    def fans_with(self, edges: DataFrame) -> DataFrame:
        """Fans with those of edges of other kinds (mappings, foreign keys) added."""
        other = edges.where(~F.col("kind").isin("imports", "depends_on", *FAN_TARGET))
        return self.fans.unionByName(fan_metrics(other)).groupBy("id").agg(F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out"))
