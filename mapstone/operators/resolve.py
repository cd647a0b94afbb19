"""Resolution of import specifiers to files and packages by joins; module inference.

An import becomes an array of candidate paths, in order, made of column expressions. What depends on configuration
is joined: the nearest configuration above the importer's directory (the longest of its ancestors that has one), the best of its
alias patterns, the workspace package of that name. Candidates are then joined to the files that exist, and the first one wins.
"""

from __future__ import annotations

import fnmatch
import re
import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .algo import checkpointed

#: Directories that hold packages rather than being one, and what is tried for a specifier.
CONTAINERS = ("packages", "apps", "libs", "services", "modules")
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
SWAPS = {".js": (".ts", ".tsx", ".js", ".jsx"), ".mjs": (".mts", ".mjs"), ".cjs": (".cts", ".cjs")}
#: Directories of built files. Fixed values.
BUILD_DIRS = ("dist", "build", "lib")
#: Specifiers that name a part of the runtime, as a whole. Fixed values.
NODE_BUILTINS = tuple(
    "assert assert/strict async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns dns/promises domain"
    " events fs fs/promises http http2 https inspector inspector/promises module net os path path/posix path/win32 perf_hooks process"
    " punycode querystring readline readline/promises repl stream stream/consumers stream/promises stream/web string_decoder sys timers"
    " timers/promises tls trace_events tty url util util/types v8 vm wasi worker_threads zlib".split()
)
#: Modules that left the standard library after 3.12, and still count. Fixed values.
PY_REMOVED = frozenset("aifc audioop cgi cgitb chunk crypt imghdr lib2to3 mailcap msilib nis nntplib ossaudiodev pipes sndhdr spwd sunau telnetlib uu xdrlib".split())


def glob_regex(glob: str) -> str:
    """A path glob (**, *, ?, {a,b}; dot files match) as a regular expression for the whole path."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(map(glob_regex_part, glob[i + 1 : end].split(","))) + ")", end + 1
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"


def glob_regex_part(part: str) -> str:
    return glob_regex(part)[1:-1]


def infer_modules(files: DataFrame, rules: list[tuple[str, str | None, list[str]]], workspaces: list[tuple[str, str]], root: str, path: str = "path") -> DataFrame:
    """Adds module, layer, module_source: by the first rule (name, layer, globs) that matches, else the deepest workspace
    (name, directory) above, else the first directory (after src/; one below a container), else the root module."""
    p = F.col(path)
    name, layer, source = None, None, None
    none = F.lit(None).cast("string")
    for rule, its_layer, globs in rules:
        hit = p.rlike("|".join(map(glob_regex, globs)))
        name = F.when(hit, rule) if name is None else name.when(hit, rule)
        layer = F.when(hit, F.lit(its_layer)) if layer is None else layer.when(hit, F.lit(its_layer))
        source = F.when(hit, "config") if source is None else source.when(hit, "config")
    for ws, at in sorted(workspaces, key=lambda w: -len(w[1])):
        hit = p.startswith(f"{at}/")
        name = F.when(hit, ws) if name is None else name.when(hit, ws)
        layer = F.when(hit, none) if layer is None else layer.when(hit, none)
        source = F.when(hit, "workspace") if source is None else source.when(hit, "workspace")
    parts = F.split(F.regexp_replace(p, "^src/", ""), "/")
    plain = F.when(F.size(parts) == 1, root).when(parts[0].isin(*CONTAINERS) & (F.size(parts) > 2), parts[1]).otherwise(parts[0])
    return files.withColumns(
        {
            "module": plain if name is None else name.otherwise(plain),
            "layer": none if layer is None else layer.otherwise(none),
            "module_source": F.lit("inferred") if source is None else source.otherwise("inferred"),
        }
    )


def package_of(spec: Column) -> Column:
    """@scope/name or the first segment."""
    return F.when(spec.startswith("@"), F.substring_index(spec, "/", 2)).otherwise(F.substring_index(spec, "/", 1))


def normal_path(*parts: Column) -> Column:
    """Path parts put together, without empty parts and single dots, two dots resolved; null if that leads above the root."""
    empty = F.array().cast("array<string>")
    up = lambda at: F.when(F.size(at) > 0, F.slice(at, 1, F.size(at) - 1))
    step = lambda at, x: F.when(x.isin("", "."), at).when(x == "..", up(at)).otherwise(F.array_append(at, x))
    return F.array_join(F.aggregate(F.concat(*[F.split(p, "/") for p in parts]), empty, step), "/")


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _under(at: Column, name: str) -> Column:
    """A name in a directory; the root has an empty path."""
    return F.concat(F.when(at == "", F.lit("")).otherwise(F.concat(at, F.lit("/"))), F.lit(name))


def probes(at: Column) -> Column:
    """Files that a path in a specifier may mean, in order."""
    none = F.array().cast("array<string>")
    exact = F.when(F.lit(False), none)
    for ext, others in SWAPS.items():
        exact = exact.when(at.endswith(ext), F.array(*[F.concat(F.substring(at, F.lit(1), F.length(at) - len(ext)), F.lit(x)) for x in others]))
    for ext in EXTENSIONS:
        exact = exact.when(at.endswith(ext), F.array(at))
    return F.array_distinct(F.concat(exact.otherwise(none), F.array(*[F.concat(at, F.lit(x)) for x in EXTENSIONS], *[_under(at, f"index{x}") for x in EXTENSIONS])))


def plain_probes(path: Column) -> Column:
    """The path itself, then with each extension, then an index file in it."""
    return F.array(path, *[F.concat(path, F.lit(x)) for x in EXTENSIONS], *[_under(path, f"index{x}") for x in EXTENSIONS])


def source_twin(entry: Column) -> Column:
    """The source, without extension, that a built entry is made of; the entry itself if it isn't a built one."""
    plain = F.regexp_replace(entry, r"^\./", "")
    twin = F.regexp_replace(plain, f"^({'|'.join(BUILD_DIRS)})/", "src/")
    return F.regexp_replace(F.regexp_replace(twin, r"\.d\.ts$", ""), r"\.(js|mjs|cjs)$", "")


def configured(spark: SparkSession, aliases: dict[str, dict] | list) -> tuple[DataFrame, DataFrame]:
    """Alias patterns (config, pattern, head, tail, star, targets, ord) and the base folders (config, base) of configurations by
    their directory; a plain list of (pattern, targets) is the configuration of the root."""
    if not isinstance(aliases, dict):
        aliases = {"": {"paths": aliases, "base": None}}
    rows, bases = [], []
    for at, c in aliases.items():
        for k, (pattern, targets) in enumerate(c["paths"]):
            head, star, tail = pattern.partition("*")
            rows.append((at, pattern, head, tail, bool(star), list(targets), k))
        bases.append((at, c["base"]))
    patterns = spark.createDataFrame(rows, "config string, pattern string, head string, tail string, star boolean, targets array<string>, ord int")
    return patterns, spark.createDataFrame(bases, "config string, base string")


def nearest(folders: DataFrame, configs: DataFrame) -> DataFrame:
    """folder, config: the closest directory at or above a folder that is among configs (config)."""
    up = F.transform(F.sequence(F.lit(0), F.size(F.split("folder", "/"))), lambda n: F.array_join(F.slice(F.split("folder", "/"), 1, n), "/"))
    above = folders.select("folder").distinct().select("folder", F.explode(F.array_distinct(F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(up))).alias("config"))
    return above.join(configs.select("config").distinct(), "config").groupBy("folder").agg(F.max_by("config", F.length("config")).alias("config"))


def aliased(specs: DataFrame, patterns: DataFrame, bases: DataFrame) -> DataFrame:
    """specs (folder, spec) with aliases, candidate paths of the best pattern of the nearest configuration: an exact one, else that of the
    longest beginning; where none fits, the specifier below the configuration's base folder."""
    own = specs.select("folder", "spec").distinct()
    own = own.join(nearest(own, bases), "folder")
    spec = F.col("spec")
    fits = (spec == F.col("pattern")) | F.col("star") & spec.startswith(F.col("head")) & spec.endswith(F.col("tail")) & (F.length(spec) >= F.length("head") + F.length("tail"))
    best = Window.partitionBy("folder", "spec").orderBy(F.desc(spec == F.col("pattern")), F.desc(F.length("head")), "ord")
    hit = own.join(patterns, "config").where(fits).withColumn("nth", F.row_number().over(best)).where("nth = 1")
    middle = F.when(F.col("star") & (spec != F.col("pattern")), F.expr("substring(spec, length(head) + 1, length(spec) - length(head) - length(tail))")).otherwise("")
    filled = lambda t: F.when(F.instr(t, "*") > 0, F.concat(F.substring_index(t, "*", 1), middle, F.substring(t, F.instr(t, "*") + 1, F.length(t)))).otherwise(t)
    chosen = hit.select("folder", "spec", F.transform("targets", lambda t: normal_path(filled(t))).alias("paths"))
    other = own.join(hit.select("folder", "spec"), ["folder", "spec"], "left_anti").join(bases.where("base IS NOT NULL"), "config")
    paths = chosen.unionByName(other.select("folder", "spec", F.array(normal_path(F.col("base"), spec)).alias("paths")))
    each = lambda p: F.array_distinct(F.concat(probes(p), F.array(p)))
    return paths.select("folder", "spec", F.flatten(F.transform(F.array_compact("paths"), each)).alias("aliases"))


def workspace_table(spark: SparkSession, workspaces: list[tuple[str, str]], entries: dict[str, list[str]] | None = None) -> DataFrame:
    """package, at, declared (candidate paths of its entries, built ones' sources first)."""
    rows = [(name, at, list((entries or {}).get(at, []))) for name, at in dict(workspaces).items()]
    own = spark.createDataFrame(rows, "package string, at string, entries array<string>")
    both = lambda e: F.concat(F.when(source_twin(e) != e, plain_probes(normal_path(F.col("at"), source_twin(e)))).otherwise(F.array().cast("array<string>")), plain_probes(normal_path(F.col("at"), e)))
    index = F.concat(plain_probes(_under(F.col("at"), "src/index")), plain_probes(_under(F.col("at"), "index")))
    return own.select("package", "at", F.concat(F.flatten(F.transform("entries", both)), index).alias("declared"))


def script_candidates(imports: DataFrame, aliases: dict[str, dict] | list, workspaces: list[tuple[str, str]], entries: dict[str, list[str]] | None = None) -> DataFrame:
    """rid, found (array of path, ends: nothing follows this one), otherwise, name of TypeScript and JavaScript imports (rid, path, specifier).

    otherwise: builtin, package or unresolved, where no candidate exists.
    """
    spark = imports.sparkSession
    own = imports.select("rid", folder_of(F.col("path")).alias("folder"), F.split_part("specifier", F.lit("?"), F.lit(1)).alias("spec"))
    spec = F.col("spec")
    own = own.withColumn("what", F.when(spec == "", "nothing").when(spec.startswith("node:") | spec.isin(*NODE_BUILTINS), "builtin").when(spec.startswith("."), "relative").when(spec.startswith("/"), "nothing").otherwise("named")).withColumn("package", package_of(spec))
    named = own.where("what = 'named'")
    at = normal_path(F.col("folder"), spec)
    got = own.join(aliased(named, *configured(spark, aliases)), ["folder", "spec"], "left").join(workspace_table(spark, workspaces, entries), "package", "left")
    below = F.substring(spec, F.length("package") + 2, F.length(spec))
    inside = F.when(spec == F.col("package"), F.col("declared")).otherwise(F.concat(plain_probes(F.concat("at", F.lit("/src/"), below)), plain_probes(F.concat("at", F.lit("/"), below))))
    none = F.array().cast("array<string>")
    of_named = F.concat(F.coalesce("aliases", none), F.when(F.col("at").isNotNull(), inside).otherwise(none))
    paths = F.when(F.col("what") == "relative", F.coalesce(probes(at), none)).when(F.col("what") == "named", of_named).otherwise(none)
    otherwise = F.when(F.col("what") == "builtin", "builtin").when((F.col("what") == "named") & F.col("at").isNull(), "package").otherwise("unresolved")
    name = F.when(F.col("what") == "builtin", F.regexp_replace(spec, "^node:", "")).otherwise(F.col("package"))
    return got.select("rid", F.transform(F.array_distinct(paths), lambda p: F.struct(p.alias("path"), F.lit(False).alias("ends"))).alias("found"), otherwise.alias("otherwise"), name.alias("name"))


def _module_files(at: Column) -> Column:
    """A module before a package."""
    return F.array(F.concat(at, F.lit(".py")), _under(at, "__init__.py"))


def python_candidates(imports: DataFrame, roots: list[str]) -> DataFrame:
    """The same for Python imports: relative ones from the importer's package, others from each root in turn. Where a root has
    the first name but not the whole, the search ends there. Adds packages: folders that names may be submodules of."""
    spec, folder = F.col("specifier"), folder_of(F.col("path"))
    rest = F.regexp_replace(spec, r"^\.+", "")
    dots = F.length(spec) - F.length(rest)
    up = normal_path(folder, F.repeat(F.lit("../"), dots - 1))
    inner = F.replace(rest, F.lit("."), F.lit("/"))
    relative = normal_path(up, inner)
    tell = lambda paths, ends: F.transform(paths, lambda p: F.struct(p.alias("path"), F.lit(ends).alias("ends")))
    none = F.array().cast("array<struct<path:string,ends:boolean>>")
    near = F.when(rest == "", tell(F.array(_under(up, "__init__.py")), False)).otherwise(tell(_module_files(relative), False))
    first = F.substring_index(rest, ".", 1)
    far = [x for r in roots for x in (tell(_module_files(normal_path(F.lit(r), inner)), False), tell(_module_files(normal_path(F.lit(r), first)), True))]
    is_near = spec.startswith(".")
    found = F.when(spec == "", none).when(is_near, F.coalesce(near, none)).otherwise(F.concat(*far) if far else none)
    library = first.isin(*sorted(sys.stdlib_module_names | PY_REMOVED))
    otherwise = F.when(is_near | (spec == ""), "unresolved").when(library, "builtin").otherwise("package")
    bare = F.when(is_near & (rest == ""), up)  # the package itself, which may have no file of its own
    return imports.select("rid", found.alias("found"), otherwise.alias("otherwise"), first.alias("name"), bare.alias("package"))


def first_files(candidates: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """keys, target, ends: the first candidate that exists. candidates: keys, found; files: path."""
    each = candidates.select(*keys, F.posexplode("found").alias("pos", "c")).select(*keys, "pos", "c.path", "c.ends")
    return each.join(files.select("path").distinct(), "path").groupBy(*keys).agg(F.min_by(F.struct("path", "ends"), "pos").alias("hit")).select(*keys, F.col("hit.path").alias("target"), F.col("hit.ends").alias("ends"))


def import_candidates(imports: DataFrame, aliases: dict[str, dict] | list, workspaces: list[tuple[str, str]], roots: list[str], entries: dict[str, list[str]] | None = None) -> DataFrame:
    """path, specifier, symbols, found, otherwise, name, package of imports (path, specifier, symbols), stored: all that can be said of
    an import without knowing which files exist. A null specifier or path is left out."""
    none = F.array().cast("array<string>")
    own = imports.where("path IS NOT NULL AND specifier IS NOT NULL")
    own = checkpointed(own.select(F.monotonically_increasing_id().alias("rid"), "path", "specifier", F.coalesce("symbols", none).alias("symbols")))
    python = F.col("path").endswith(".py")
    scripts = script_candidates(own.where(~python), aliases, workspaces, entries).withColumn("package", F.lit(None).cast("string"))
    return checkpointed(own.join(scripts.unionByName(python_candidates(own.where(python), roots)), "rid").drop("rid"))


def _member_files(folder: Column, symbol: Column) -> Column:
    """Where a name of a package is a submodule."""
    return _module_files(F.when(folder == "", symbol).otherwise(F.concat_ws("/", folder, symbol)))


def candidate_files(candidates: DataFrame) -> DataFrame:
    """path, file: every file whose existence may matter to an importer, names that may be submodules included."""
    plain = candidates.select("path", F.explode("found.path").alias("file"))
    inside = F.concat(F.array("package"), F.transform(F.filter("found.path", lambda p: p.rlike("(^|/)__init__[.]py$")), folder_of))
    named = candidates.where(F.col("path").endswith(".py")).select("path", F.explode("symbols").alias("symbol"), F.array_compact(inside).alias("inside"))
    named = named.where("symbol <> '*'").select("path", "symbol", F.explode("inside").alias("folder"))
    return plain.unionByName(named.select("path", F.explode(_member_files(F.col("folder"), F.col("symbol"))).alias("file"))).distinct()


def resolved(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of import_candidates to files (path) and packages: kind, src, dst, symbols, registry.

    A Python name imported from a package goes to its submodule where that is a file, the other names to the package's own
    file. What resolves to the importer itself, or to nothing, makes no edge.
    """
    none = F.array().cast("array<string>")
    python = F.col("path").endswith(".py")
    own = checkpointed(candidates.withColumn("rid", F.monotonically_increasing_id()))
    hit = first_files(own, files, "rid").withColumn("target", F.when(~F.col("ends"), F.col("target")))
    whole = checkpointed(own.drop("found").join(hit, "rid", "left"))
    inside = F.coalesce("package", F.when(python & F.col("target").rlike("(^|/)__init__[.]py$"), folder_of(F.col("target"))))
    named = whole.withColumn("inside", inside).where("inside IS NOT NULL").select("rid", "inside", F.explode("symbols").alias("symbol")).where("symbol <> '*'")
    subs = named.select("rid", "symbol", F.transform(_member_files(F.col("inside"), F.col("symbol")), lambda p: F.struct(p.alias("path"), F.lit(False).alias("ends"))).alias("found"))
    subs = first_files(subs, files, "rid", "symbol")
    left = subs.groupBy("rid").agg(F.collect_set("symbol").alias("as_sub"))
    rest = whole.join(left, "rid", "left").withColumn("kept", F.array_except("symbols", F.coalesce("as_sub", none)))
    file_id = lambda c: F.concat(F.lit("file:"), c)
    no_registry = F.lit(None).cast("string").alias("registry")
    sub_edges = subs.join(own.select("rid", "path"), "rid").select(F.lit("imports").alias("kind"), file_id(F.col("path")).alias("src"), file_id(F.col("target")).alias("dst"), none.alias("symbols"), no_registry)
    to_file = rest.where("target IS NOT NULL AND (size(kept) > 0 OR as_sub IS NULL)")
    file_edges = to_file.select(F.lit("imports").alias("kind"), file_id(F.col("path")).alias("src"), file_id(F.col("target")).alias("dst"), F.col("kept").alias("symbols"), no_registry)
    out = rest.where("target IS NULL AND ends IS NULL AND as_sub IS NULL AND otherwise IN ('package', 'builtin') AND name <> ''")
    registry = F.when(F.col("otherwise") == "builtin", "stdlib").when(python, "pypi").otherwise("npm")
    pkg_edges = out.select(F.lit("imports_pkg").alias("kind"), file_id(F.col("path")).alias("src"), F.concat(F.lit("pkg:"), "name").alias("dst"), "symbols", registry.alias("registry"))
    return sub_edges.unionByName(file_edges).unionByName(pkg_edges).where("src <> dst")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: dict[str, dict] | list, workspaces: list[tuple[str, str]], roots: list[str], entries: dict[str, list[str]] | None = None) -> DataFrame:
    """Edges of imports (path, specifier, symbols) to files (path) and packages: see import_candidates and resolved."""
    return resolved(import_candidates(imports, aliases, workspaces, roots, entries), files)


def matches(path: str, globs: list[str]) -> bool:
    """Whether a path matches one of the globs; for the driver's short lists."""
    return any(re.match(glob_regex(g), path) or fnmatch.fnmatch(path, g) for g in globs)
