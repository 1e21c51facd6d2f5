"""Definitions, references and imports of source code, and lists of working records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def definition_search(defs: DataFrame, name: str, kinds: list[str] | None = None, exported: bool | None = None, file: str | None = None, limit: int = 50) -> DataFrame:
    """Definitions whose name contains ``name`` in any case, by name."""
    out = defs.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if exported is not None:
        out = out.where(F.col("exported") == exported)
    if file is not None:
        out = out.where(F.col("file_path") == file)
    return out.orderBy("name", "id").limit(limit)


def references_to(refs: DataFrame, symbol: str) -> DataFrame:
    return refs.where((F.col("symbol_name") == symbol) | F.col("target_fqn").endswith(f"#{symbol}"))


def typed_edges(edges: DataFrame, node: object, kinds: list[str], direction: str = "both", limit: int = 200) -> DataFrame:
    ends = {"out": F.col("src") == node, "in": F.col("dst") == node}
    test = ends[direction] if direction in ends else ends["out"] | ends["in"]
    return edges.where(test & F.col("kind").isin(kinds)).orderBy("src", "dst", "kind").limit(limit)


def go_to_definition(defs: DataFrame, refs: DataFrame, imports: DataFrame, centrality: DataFrame) -> DataFrame:
    """``ref_id, id, place``: candidates for each reference: in the same file, then imported directly, then central, then by id.

    ``defs(id, name, file)``, ``refs(ref_id, name, file)``, ``imports(src, dst)`` and ``centrality(file, rank)``; a ``ref_id`` is one reference.
    References of one file to one name have the same candidates, which are ranked once.
    """
    asked = refs.select("name", "file").distinct()
    d = defs.select("id", "name", F.col("file").alias("def_file"))
    found = asked.join(d, "name")
    direct = imports.select(F.col("src").alias("file"), F.col("dst").alias("def_file"), F.lit(1).alias("direct")).distinct()
    near = F.when(F.col("file") == F.col("def_file"), 2).when(F.col("direct") == 1, 1).otherwise(0)
    rows = found.join(direct, ["file", "def_file"], "left").join(centrality.select(F.col("file").alias("def_file"), "rank"), "def_file", "left").withColumn("near", near)
    order = Window.partitionBy("name", "file").orderBy(F.col("near").desc(), F.coalesce("rank", F.lit(0.0)).desc(), "id")
    ranked = rows.select("name", F.col("file").alias("_f"), "id", F.row_number().over(order).cast("long").alias("place"))
    return refs.join(ranked, (refs["name"] == ranked["name"]) & refs["file"].eqNullSafe(F.col("_f"))).select("ref_id", "id", "place")


def resolved(asked: DataFrame, defs: DataFrame) -> DataFrame:
    """``asked, id, state``: an exact id, or else the one definition with the legacy name, or else how many there are."""
    exact = asked.join(defs.select(F.col("id").alias("asked"), F.col("id")), "asked", "left")
    legacy = defs.groupBy(F.col("legacy").alias("asked")).agg(F.min("id").alias("alias"), F.count("*").alias("n"))
    out = exact.join(legacy, "asked", "left")
    state = F.when(F.col("id").isNotNull(), "exact").when(F.col("n") == 1, "legacy").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return out.select("asked", F.coalesce("id", F.when(F.col("n") == 1, F.col("alias"))).alias("id"), state.alias("state"))


def import_targets(imports: DataFrame, files: DataFrame, aliases: dict[str, str], packages: dict[str, str] | None = None, extensions: tuple[str, ...] = ("", ".ts", ".tsx", ".js", "/index.ts", "/index.js")) -> DataFrame:
    """``src, specifier, dst``: the first candidate path of an import that is a known file; null for external ones.

    Relative specifiers start at the importing file's folder, others at the alias that they begin with, or at the folder of the
    package of the same repository that they name, longer names first.
    """
    folder = F.regexp_replace("src", "(^|/)[^/]*$", "")
    base = F.when(F.col("specifier").startswith("."), F.concat_ws("/", F.when(folder != "", folder), F.col("specifier")))
    for a, target in aliases.items():
        base = base.when(F.col("specifier").startswith(a), F.concat(F.lit(target), F.substring("specifier", len(a) + 1, 1 << 20)))
    for name, folder_of in sorted((packages or {}).items(), key=lambda x: -len(x[0])):
        base = base.when(F.col("specifier") == name, F.lit(folder_of)).when(F.col("specifier").startswith(f"{name}/"), F.concat(F.lit(folder_of), F.substring("specifier", len(name) + 1, 1 << 20)))
    clean = F.regexp_replace(F.regexp_replace(base, r"(^|/)(\./)+", "$1"), r"/\./", "/")
    for _ in range(6):  # each pass takes one level of parents away
        clean = F.regexp_replace(clean, r"(^|/)(?!\.\.)[^/]+/\.\./", "$1")
    named = imports.select("src", "specifier").distinct().withColumn("base", clean)
    tries = named.select("src", "specifier", F.posexplode(F.array(*[F.concat("base", F.lit(e)) for e in extensions])).alias("n", "path"))
    found = tries.join(files.select("path"), "path").groupBy("src", "specifier").agg(F.min_by("path", "n").alias("dst"))
    return named.select("src", "specifier").join(found, ["src", "specifier"], "left")


def layers(edges: DataFrame) -> DataFrame:
    """``node, layer``: entry points (nothing comes in), leaves (nothing goes out), or middle; ``hotspot`` is in times out."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("fan_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("fan_in"))
    both = out.join(into, "node", "full_outer").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    layer = F.when(F.col("fan_in") == 0, "entry").when(F.col("fan_out") == 0, "leaf").otherwise("middle")
    return both.withColumn("layer", layer).withColumn("hotspot", F.col("fan_in") * F.col("fan_out"))


# Folders that hold packages, names of files that start programs, and names of routes.
PACKAGES = r"^(?:packages|apps|modules|libs|services)/([^/]+)/"
STARTS = r"(?i)(^|/)(index|main|server|app|cli|bootstrap|entry)\.[tj]sx?$"
ROUTE = r"(?i)\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/\S+)"


def package_of(path: Column) -> Column:
    """The package folder of a path, or else its first folder; ``<root>`` for a bare name."""
    held = F.regexp_extract(path, PACKAGES, 1)
    return F.when(held != "", held).when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("<root>")


def packages(files: DataFrame, edges: DataFrame, limit: int = 15) -> DataFrame:
    """``name, files, fan_in, fan_out`` of the largest packages of ``files(path)``; the fans count other packages along ``edges(src, dst)``."""
    sizes = files.select(package_of(F.col("path")).alias("name")).groupBy("name").agg(F.count("*").alias("files"))
    between = edges.select(package_of(F.col("src")).alias("a"), package_of(F.col("dst")).alias("b")).where("a <> b").distinct()
    out, into = between.groupBy(F.col("a").alias("name")).agg(F.count("*").alias("fan_out")), between.groupBy(F.col("b").alias("name")).agg(F.count("*").alias("fan_in"))
    whole = sizes.join(into, "name", "left").join(out, "name", "left").select("name", "files", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    return whole.orderBy(F.col("files").desc(), F.col("fan_in").desc(), "name").limit(limit)


def entry_points(edges: DataFrame, limit: int = 20, least: int = 1) -> DataFrame:
    """``file, fan_in, fan_out, starts``: files that are imported and import little, or that are named as what starts a program; these first."""
    both = layers(edges).withColumn("starts", F.col("node").rlike(STARTS))
    quiet = (F.col("fan_in") >= least) & (F.col("fan_out") <= F.greatest(F.lit(2), F.col("fan_in")))
    return both.where(quiet | F.col("starts")).orderBy(F.col("starts").desc(), F.col("fan_in").desc(), "node").limit(limit).select(F.col("node").alias("file"), "fan_in", "fan_out", "starts")


def routes(calls: DataFrame, defs: DataFrame, limit: int = 50) -> DataFrame:
    """``method, path, file, handler``, one for each method and path: of calls first, then of definitions of routes, then of names that look like one.

    ``calls(id, file, route, method, handler)`` and ``defs(id, file, name, kind)``.
    """
    named = F.regexp_extract("name", ROUTE, 2) != ""
    method, path = F.when(named, F.upper(F.regexp_extract("name", ROUTE, 1))).otherwise("ANY"), F.when(named, F.regexp_extract("name", ROUTE, 2)).otherwise(F.col("name"))
    rows = calls.where(F.coalesce("route", F.lit("")) != "").select(F.lit(1).alias("source"), "id", F.upper(F.coalesce("method", F.lit("ANY"))).alias("method"), F.col("route").alias("path"), "file", "handler")
    own = defs.where((F.col("kind") == "route") | named).select(F.when(F.col("kind") == "route", 2).otherwise(3).alias("source"), "id", method.alias("method"), path.alias("path"), "file", F.col("name").alias("handler"))
    first = rows.unionByName(own).groupBy("method", "path").agg(F.min(F.struct("source", "id", "file", "handler")).alias("f"))
    return first.orderBy("f.source", "f.id", "method", "path").limit(limit).select("method", "path", "f.file", "f.handler")


def cohesion(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """``community, inside, touching, cohesion``: edges within a community, those that touch it, and their share."""
    a, b = groups.select(F.col("node").alias("src"), F.col("community").alias("ca")), groups.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    ends = edges.join(a, "src").join(b, "dst").select("ca", "cb")
    touched = ends.select(F.explode(F.array_distinct(F.array("ca", "cb"))).alias("community"), (F.col("ca") == F.col("cb")).alias("inner"))
    return touched.groupBy("community").agg(F.count_if("inner").alias("inside"), F.count("*").alias("touching")).withColumn("cohesion", F.round(F.col("inside") / F.col("touching"), 6))


def seeds(files: DataFrame, readme: DataFrame, limit: int = 10) -> DataFrame:
    """``place, content``: first memories of a project, by rule: what its description begins with, and its most central files.  ``files(path, rank)``, ``readme(text)``."""
    intro = readme.select(F.lit(0).alias("place"), F.concat(F.lit("Project: "), F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 200)).alias("content")).limit(1)
    top = files.orderBy(F.col("rank").desc(), "path").limit(max(0, limit - 1))
    nth = F.row_number().over(Window.orderBy(F.col("rank").desc(), "path"))  # of a few rows
    central = top.select(nth.alias("place"), F.concat(F.lit("Central file: "), "path", F.lit(" ("), F.format_string("%.3f", F.col("rank")), F.lit(")")).alias("content"))
    return intro.unionByName(central)


def tree(rows: DataFrame, group: Column, fields: list[str], order: list[Column], groups: int = 20, per_group: int = 10) -> DataFrame:
    """``place, nth, line``: rows as indented lines below a line for each group, in order of ``place`` and ``nth``; the largest groups and
    the first rows of each are shown, with how many there are."""
    keyed = rows.withColumn("_g", group)
    counts = keyed.groupBy("_g").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "_g").limit(groups)
    placed = counts.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "_g")))  # of a few rows
    head = placed.select("place", F.lit(0).alias("nth"), F.concat("_g", F.lit(" ("), F.least("n", F.lit(per_group)).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" rows)")).alias("line"))
    nth = F.row_number().over(Window.partitionBy("_g").orderBy(*order))
    shown = keyed.join(placed.select("_g", "place"), "_g").withColumn("nth", nth).where(F.col("nth") <= per_group)
    return head.unionByName(shown.select("place", "nth", F.concat(F.lit("  "), F.to_json(F.struct(*fields))).alias("line")))


def common_prefix(groups: DataFrame, key: str, path: str) -> DataFrame:
    """``key, prefix``: the longest folder that all paths of a group share, from its first and last path in order."""
    ends = groups.groupBy(key).agg(F.min(path).alias("a"), F.max(path).alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    same = F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")))
    return ends.select(key, F.array_join(F.slice(a, 1, F.least(same["n"], F.size(a) - 1)), "/").alias("prefix"))


def checkpoints(rows: DataFrame, now: Column, project: str | None = None, kind: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Checkpoints that have not expired, newest first."""
    out = rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    if project is not None:
        out = out.where(F.col("project_id") == project)
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    return out.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def open_handoffs(rows: DataFrame, me: object) -> DataFrame:
    """Open handoffs to an agent or to anyone, oldest first."""
    return rows.where((F.col("status") == "open") & (F.col("target").isNull() | (F.col("target") == me))).orderBy("created_at", "id")


def soft_deleted(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    gone = ids.select("id", F.lit(True).alias("_gone")).distinct()
    out = memories.join(gone, "id", "left")
    return out.withColumn("deleted_at", F.when(F.col("_gone"), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))).drop("_gone")


def patched(memories: DataFrame, patches: DataFrame) -> DataFrame:
    """Memories with the columns of their patch, one for each ``id``, where those are not null."""
    fields = [c for c in patches.columns if c != "id"]
    p = patches.select("id", *[F.col(c).alias(f"_p_{c}") for c in fields])
    out = memories.join(p, "id", "left")
    return out.withColumns({c: F.coalesce(f"_p_{c}", c) for c in fields}).select(*memories.columns)


def hard_deleted(memories: DataFrame, ids: DataFrame | None = None, project: object | None = None) -> DataFrame:
    """Memories without those of ``ids`` and of a project."""
    out = memories if ids is None else memories.join(ids.select("id").distinct(), "id", "left_anti")
    return out if project is None else out.where(~F.col("project_id").eqNullSafe(F.lit(project)))


def imports_of(edges: DataFrame, file: object) -> DataFrame:
    """What a file imports."""
    return edges.where(F.col("src") == F.lit(file))


def importers_of(edges: DataFrame, file: object) -> DataFrame:
    """What imports a file."""
    return edges.where(F.col("dst") == F.lit(file))


def counted(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items with the accesses of a log added to their counts, and the time of the last."""
    seen = log.groupBy("id").agg(F.count("*").alias("_n"), F.max("at").alias("_last"))
    out = items.join(seen, "id", "left")
    return out.withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).withColumn("last_accessed", F.greatest("last_accessed", "_last")).drop("_n", "_last")


def raised(edges: DataFrame, step: float, cap: float = 1.0) -> DataFrame:
    """Weights raised by ``step`` up to ``cap``, within 0 and 1."""
    return edges.withColumn("weight", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(F.col("weight") + step, F.lit(cap)))))


def cached(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts with the vector that a cache has under their hash, or null."""
    return asked.withColumn("key", F.sha2("text", 256)).join(cache.select("key", "embedding"), "key", "left")


def hydrated(hits: DataFrame, edges: DataFrame, memories: DataFrame, seeds: int = 20) -> DataFrame:
    """Memories one edge from the best hits of each query, that are no hits themselves: ``query_id, id, content``."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    top = hits.withColumn("n", nth).where(F.col("n") <= seeds).select("query_id", F.col("id").alias("src"))
    near = top.join(edges.select("src", F.col("dst").alias("id")), "src").select("query_id", "id").distinct()
    return near.join(hits, ["query_id", "id"], "left_anti").join(memories, "id").select("query_id", "id", "content")
