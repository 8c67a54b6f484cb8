"""A graph of files and symbols from source chunks, and the operators on it.

Vertices and edges are two tables with a project key. Extraction reads declarations and calls by pattern; names are resolved by joins
on (project, name), never by comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrecall.functions import text as T
from loomrecall.operators.tables import chunk_path
from loomrecall.session import materialize

#: Words that declare a symbol, and calls that are no symbols.
DECLARATION = r"\b(?:class|interface|function|def|func|type|struct|enum)\s+[A-Za-z_][A-Za-z0-9_]*"
CALL = r"\b[A-Za-z_][A-Za-z0-9_]*\("
NO_CALLS = ("if", "for", "while", "switch", "return", "function", "def", "func", "catch", "super", "constructor")
#: Module names in JavaScript and TypeScript, and in Python.
IMPORT = r"(?:from|import|require\(|import\()[ \t]*['\"]([^'\"\n]+)['\"]"
PY_IMPORT = r"(?m)^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import|import[ \t]+([.\w]+))"
#: Functions that are given to a name.
ARROW = r"\b(?:const|let|var)\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:async\s*)?(?:\([^()\n]*\)|[A-Za-z_][A-Za-z0-9_]*)\s*=>"
#: A class or interface with what it is based on.
BASED = r"\b(?:class|interface)\s+[A-Za-z_][A-Za-z0-9_]*(?:\s*<[^<>{}\n]*>)?\s*(?:\([^()\n]*\)|(?:extends|implements)\s+[^{\n]+)"
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py")


def symbols(chunks: DataFrame) -> DataFrame:
    """Declared symbols: project_key, id, label, kind, source_file, line (where the chunk begins). One row per file and name."""
    arrows = F.transform(F.regexp_extract_all("chunk_text", F.lit(ARROW), F.lit(1)), lambda x: F.concat(F.lit("function "), x))
    found = chunks.select("project_key", "file_record_id", F.coalesce("start_line", F.lit(1)).alias("line"), F.explode(F.concat(F.regexp_extract_all("chunk_text", F.lit(DECLARATION), F.lit(0)), arrows)).alias("d"))
    label = F.regexp_extract("d", r"\s+([A-Za-z_][A-Za-z0-9_]*)$", 1)
    rows = found.select("project_key", "file_record_id", label.alias("label"), F.regexp_extract("d", r"^(\w+)", 1).alias("kind"), "line")
    grouped = rows.groupBy("project_key", "file_record_id", "label").agg(F.min("kind").alias("kind"), F.min("line").alias("line"))
    return grouped.select("project_key", F.concat("file_record_id", F.lit("#"), "label").alias("id"), "label", "kind", "file_record_id", chunk_path("file_record_id").alias("source_file"), "line")


def nodes(files: DataFrame, syms: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """File and symbol vertices, and the modules of ``imported`` that are no file: project_key, id, label, kind, source_file."""
    if imported is not None:
        away = imported.where("not resolved").select("project_key", F.col("target").alias("id"), F.col("spec").alias("label"), F.lit("import").alias("kind"), F.lit(None).cast("string").alias("source_file")).distinct()
        return nodes(files, syms).unionByName(away)
    f = files.select("project_key", "id", T.base_name(F.col("path")).alias("label"), F.lit("file").alias("kind"), F.col("path").alias("source_file"))
    return f.unionByName(syms.select("project_key", "id", "label", "kind", "source_file"))


def calls(chunks: DataFrame, syms: DataFrame, limit: int = 3) -> DataFrame:
    """Calls from a file to the first ``limit`` symbols of that name in its project, calls within the file left out."""
    made = chunks.select("project_key", "file_record_id", F.explode(F.array_distinct(F.regexp_extract_all("chunk_text", F.lit(CALL), F.lit(0)))).alias("c"))
    made = made.select("project_key", F.col("file_record_id").alias("source"), F.rtrim(F.replace("c", F.lit("("), F.lit(""))).alias("label")).where(~F.col("label").isin(*NO_CALLS)).distinct()
    w = Window.partitionBy("project_key", "label").orderBy("id")
    first = syms.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).select("project_key", "label", F.col("id").alias("target"), "file_record_id")
    return made.join(first, ["project_key", "label"]).where(F.col("file_record_id") != F.col("source")).select("project_key", "source", "target", F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("weight"))


def heritage(chunks: DataFrame, syms: DataFrame) -> DataFrame:
    """``extends`` edges from a class or interface to the first symbol of each base's name in its project.

    Bases are the names behind ``extends`` and ``implements``, or in brackets behind the name (without keyword arguments); of a dotted
    name the last part counts, type arguments fall away.
    """
    found = chunks.select("project_key", "file_record_id", F.explode(F.regexp_extract_all("chunk_text", F.lit(BASED), F.lit(0))).alias("d"))
    label = F.regexp_extract("d", r"^(?:class|interface)\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    tail = F.regexp_replace(F.regexp_replace("d", r"^(?:class|interface)\s+[A-Za-z_][A-Za-z0-9_]*", ""), r"<[^<>]*>", "")
    words = F.filter(F.split(F.regexp_replace(tail, r"[()]|\b(?:extends|implements)\b", ","), ","), lambda x: ~x.contains("="))
    base = F.explode(F.transform(words, lambda x: F.regexp_extract(x, r"([A-Za-z_][A-Za-z0-9_]*)\s*$", 1)))
    named = found.select("project_key", F.concat("file_record_id", F.lit("#"), label).alias("source"), base.alias("label")).where("label <> ''").distinct()
    w = Window.partitionBy("project_key", "label").orderBy("id")
    first = syms.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).select("project_key", "label", F.col("id").alias("target"))
    met = named.join(first, ["project_key", "label"]).where("source <> target").select("project_key", "source", "target").distinct()
    return met.select("*", F.lit("extends").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("weight"))


def joined_path(folder: Column, spec: Column) -> Column:
    """The path of ``spec`` seen from ``folder``, without empty, ``.`` and ``..`` parts."""
    step = lambda at, x: F.when(x.isin("", "."), at).when(x == "..", F.regexp_replace(at, r"/?[^/]*$", "")).when(at == "", x).otherwise(F.concat(at, F.lit("/"), x))
    return F.aggregate(F.split(F.concat(folder, F.lit("/"), spec), "/"), F.lit(""), step)


def imports(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """What each file imports: project_key, source, spec, target, resolved.

    A relative module is the first of: the path itself, with an extension, an index file in the folder, a package. What is no file of the
    project is a module of its own, ``import:project:name``.
    """
    path = chunk_path("file_record_id")
    script = F.when(~path.endswith(".py"), F.regexp_extract_all("chunk_text", F.lit(IMPORT), F.lit(1)))
    python = F.when(path.endswith(".py"), F.concat(F.regexp_extract_all("chunk_text", F.lit(PY_IMPORT), F.lit(1)), F.regexp_extract_all("chunk_text", F.lit(PY_IMPORT), F.lit(2))))
    named = chunks.where(F.exists(F.array(*[F.lit(e) for e in EXTENSIONS]), lambda e: path.endswith(e))).select("project_key", F.col("file_record_id").alias("source"), path.alias("path"), F.explode(F.coalesce(script, python)).alias("spec")).where("spec <> ''").distinct()
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace("spec", r"^\.+", ""), F.lit("."), F.lit("/"))
    relative = F.when(F.col("path").endswith(".py"), F.concat(F.repeat(F.lit("../"), dots - 1), rest)).otherwise(F.col("spec"))
    base = F.when(F.col("spec").startswith("."), joined_path(F.regexp_replace("path", r"/?[^/]*$", ""), relative))
    tails = ["", *EXTENSIONS, *[f"/index{e}" for e in EXTENSIONS], "/__init__.py"]
    tried = named.withColumn("base", base).where("base is not null").select("project_key", "source", "spec", F.posexplode(F.array(*[F.concat("base", F.lit(t)) for t in tails])).alias("at", "path"))
    hit = tried.join(files.select("project_key", "path", F.col("id").alias("target")), ["project_key", "path"]).groupBy("project_key", "source", "spec").agg(F.min_by("target", F.struct("at", "target")).alias("target"))
    out = named.select("project_key", "source", "spec").join(hit, ["project_key", "source", "spec"], "left")
    return out.select("project_key", "source", "spec", F.coalesce("target", F.concat(F.lit("import:"), "project_key", F.lit(":"), "spec")).alias("target"), F.col("target").isNotNull().alias("resolved"))


def edges(chunks: DataFrame, syms: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """``contains`` edges from files to their symbols, resolved ``calls`` and ``extends``, and ``imports_from`` for ``imported`` modules."""
    own = syms.select("project_key", F.col("file_record_id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("weight"))
    out = own.unionByName(calls(chunks, syms)).unionByName(heritage(chunks, syms))
    if imported is None:
        return out
    return out.unionByName(imported.select("project_key", "source", "target", F.lit("imports_from").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("weight")).distinct())


def code_graph(chunks: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, vertices and edges, each written once."""
    syms = materialize(symbols(chunks), "graph-symbols")
    imported = materialize(imports(chunks, files), "graph-imports")
    return syms, materialize(nodes(files, syms, imported), "graph-nodes"), materialize(edges(chunks, syms, imported), "graph-edges")


def both_ways(e: DataFrame) -> DataFrame:
    """Each edge from either end: ``u`` to ``v``."""
    return e.select("project_key", F.col("source").alias("u"), F.col("target").alias("v"), "relation", "weight").unionByName(e.select("project_key", F.col("target").alias("u"), F.col("source").alias("v"), "relation", "weight"))


def degrees(e: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(project_key, id, in_degree, out_degree), from counts per end; of the vertices in ``ids`` (project_key, id) only, if given."""
    ends = e.select("project_key", F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select("project_key", F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    if ids is not None:
        ends = ends.join(ids.select("project_key", "id").distinct(), ["project_key", "id"], "left_semi")
    return ends.groupBy("project_key", "id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def match_score(label: Column, source_file: Column, text: str) -> Column:
    """100 for the label itself, 60 if the label holds the text, 35 if the file's path does, else null. The text is taken literally."""
    low = text.strip().lower()
    return F.when(F.lower(label) == low, 100).when(F.lower(label).contains(low), 60).when(F.lower(F.coalesce(source_file, F.lit(""))).contains(low), 35)


def top_adjacent(e: DataFrame, ids: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best edges of each vertex in ``ids`` (project_key, id): by weight, relation and the other end."""
    near = both_ways(e).join(ids.select("project_key", F.col("id").alias("u")), ["project_key", "u"], "left_semi")
    w = Window.partitionBy("project_key", "u").orderBy(F.desc("weight"), "relation", "v")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def labelled(near: DataFrame, n: DataFrame) -> DataFrame:
    """Rows of ``top_adjacent`` with the label and kind of the other end."""
    other = n.select("project_key", F.col("id").alias("v"), F.col("label").alias("v_label"), F.col("kind").alias("v_kind")).dropDuplicates(["project_key", "v"])
    return near.join(other, ["project_key", "v"], "left")


def shortest_path(e: DataFrame, source: Column | str, target: Column | str, ends: DataFrame, max_depth: int = 4) -> DataFrame:
    """(depth, node) along one shortest undirected path between the two ids of the one-row table ``ends``; empty if there is none in reach.

    Breadth first by joins of the frontier with the edges; each new vertex keeps its least parent. Edges are those of the source's own
    projects. Only the frontier's number of rows comes to the driver, and every level is written to the shared folder.
    """
    begins = ends.select(F.col(source).alias("_s") if isinstance(source, str) else source.alias("_s"))
    both = both_ways(e)
    projects = both.join(begins, F.col("u") == F.col("_s"), "left_semi").select("project_key").distinct()
    adj = materialize(both.join(projects, "project_key", "left_semi").select("u", "v").distinct(), "bfs-edges")
    level = ends.select(F.col(source).alias("node") if isinstance(source, str) else source.alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    goal = ends.select(F.col(target).alias("node") if isinstance(target, str) else target.alias("node"))
    seen = materialize(level, "bfs-seen")
    frontier = seen
    for depth in range(1, max_depth + 1):
        if not seen.join(goal, "node", "left_semi").isEmpty():
            break
        step = frontier.select(F.col("node").alias("u")).join(adj, "u").groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        frontier = materialize(step.join(seen.select("node"), "node", "left_anti").select("node", "parent", F.lit(depth).alias("depth")), "bfs-level")
        seen = materialize(seen.unionByName(frontier), "bfs-seen")
        if frontier.isEmpty():
            break
    path = seen.join(goal, "node", "left_semi")
    out = path.select("depth", "node", "parent")
    for _ in range(max_depth):
        path = seen.join(path.select(F.col("parent").alias("node")), "node", "left_semi")
        out = out.unionByName(path.select("depth", "node", "parent"))
    return out.select(F.col("depth").cast("long").alias("depth"), "node").distinct()


def communities(n: DataFrame, e: DataFrame) -> DataFrame:
    """Vertices grouped by the folder of their file: rank by size and name, inner edges over possible ones, and the first labels."""
    keyed = n.withColumn("folder", T.folder(F.col("source_file")))
    size = keyed.groupBy("project_key", "folder").agg(F.count(F.lit(1)).alias("node_count"))
    key = keyed.select("project_key", "id", "folder").distinct()
    a, b = key.select("project_key", F.col("id").alias("source"), F.col("folder").alias("fa")), key.select("project_key", F.col("id").alias("target"), F.col("folder").alias("fb"))
    inner = e.join(a, ["project_key", "source"]).join(b, ["project_key", "target"]).where("fa = fb").groupBy("project_key", F.col("fa").alias("folder")).agg(F.count(F.lit(1)).alias("edges"))
    first = Window.partitionBy("project_key", "folder").orderBy("id")
    preview = keyed.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= 8).groupBy("project_key", "folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "label"))), lambda x: x["label"]), ", ").alias("preview"))
    rank = Window.partitionBy("project_key").orderBy(F.desc("node_count"), "folder")
    possible = F.greatest(F.lit(1), F.col("node_count") * F.greatest(F.lit(1), F.col("node_count") - 1))
    out = size.join(inner, ["project_key", "folder"], "left").join(preview, ["project_key", "folder"])
    return out.select("project_key", (F.row_number().over(rank) - 1).cast("long").alias("community"), "folder", "node_count", F.round(F.coalesce("edges", F.lit(0)) / possible, 3).alias("cohesion"), "preview")


def guarded_replace(nodes_: DataFrame, edges_: DataFrame, path: str, project: str, allow_downgrade: bool = False, share: float = 0.8) -> str:
    """Replace one project's graph below ``path``; ``skipped`` if it would shrink below ``share`` of its nodes or edges, else ``imported``.

    Only that project's partition is overwritten, and only counts come to the driver.
    """
    spark = nodes_.sparkSession
    new = nodes_.count(), edges_.count()
    if not allow_downgrade:
        for name, n in zip(("nodes", "edges"), new, strict=True):
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
            old = spark.read.parquet(f"{path}/{name}").where(F.col("project_key") == project).count() if there else 0
            if n < share * old:
                return "skipped"
    for name, df in (("nodes", nodes_), ("edges", edges_)):
        df.drop("project_key").withColumn("project_key", F.lit(project)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_key").parquet(f"{path}/{name}")
    return "imported"
