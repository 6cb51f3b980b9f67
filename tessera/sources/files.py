"""Files as rows: globs, languages, lines, project ownership and leaves of JSON settings.

A file is a row with ``file_id``, ``path`` (relative, ``/``) and ``text``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.walk import walked

#: What is left out of every walk, and the language of a file by its extension.
DEFAULT_EXCLUDES = ("**/bin/**", "**/obj/**", "**/node_modules/**", "**/.git/**")
LANGUAGES = {".cs": "csharp", ".sql": "sql", ".csproj": "project"}


def glob_regex(glob: str) -> str:
    """An anchored, case-insensitive expression for ``**/``, ``**``, ``*`` and ``?``."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or re.escape(glob[i]))
            i += 1
    return f"(?i)^{''.join(out)}$"


def not_excluded(path: Column, globs: list[str]) -> Column:
    """Whether none of the globs matches; empty ones count for nothing."""
    keep = F.lit(True)
    for g in globs:
        if g.strip():
            keep = keep & ~path.rlike(glob_regex(g.strip()))
    return keep


def single_file(files: DataFrame, path: str) -> DataFrame:
    """A workspace of one file, whatever the case of its path."""
    return files.where(F.lower("path") == path.replace("\\", "/").lower())


def project_of(files: DataFrame, path: str) -> str:
    """The folder of the nearest project at or above a path, or the path's own folder."""
    folder = path.replace("\\", "/").rpartition("/")[0]
    above = [folder[:i] for i in range(len(folder) + 1) if i in (0, len(folder)) or folder[i : i + 1] == "/"]
    held = files.where("language = 'project'").select(directory(F.col("path")).alias("d")).where(F.col("d").isin(*above)).distinct().collect()
    return max((r.d for r in held), key=len, default=folder)


def settings_files(files: DataFrame, projects: DataFrame, additional: tuple[str, ...] = ()) -> DataFrame:
    """(project, file_id, path, text): ``appsettings*.json`` right in a project's folder, and the ``additional`` paths in it."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    mine = files.withColumn("project", directory(F.col("path"))).where(F.lower(name).rlike(r"^appsettings.*\.json$"))
    out = mine.join(projects.select("project").distinct(), "project", "left_semi").select("project", "file_id", "path", "text")
    if additional:
        wanted = F.explode(F.array(*(F.lit(a.replace("\\", "/")) for a in additional)))
        other = projects.select("project").distinct().withColumn("_path", F.concat_ws("/", F.nullif("project", F.lit("")), wanted))
        other = other.join(files, F.lower("_path") == F.lower("path")).select("project", "file_id", "path", "text")
        out = out.unionByName(other).dropDuplicates(["project", "path"])
    return out


def malformed(settings: DataFrame) -> DataFrame:
    """Rows of ``settings`` (..., text) that aren't a JSON object or array, comments and trailing commas aside."""
    plain = plain_json(F.col("text"))
    return settings.where(F.try_parse_json(plain).isNull() | ~plain.rlike(r"^\s*[\[{]"))


def language(path: Column) -> Column:
    """csharp, sql, project, settings (for ``appsettings*.json``) or null."""
    out = F.when(F.lit(False), F.lit(""))
    for ending, name in LANGUAGES.items():
        out = out.when(F.lower(path).endswith(ending), F.lit(name))
    return out.when(F.lower(path).rlike(r"(^|/)appsettings[^/]*\.json$"), F.lit("settings"))


def read_workspace(spark: SparkSession, root: str, excludes: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, path, language, text) of the sources below ``root``, or of one file and the projects below its folder.

    Bytes that aren't UTF-8 become replacement characters; files that vanish meanwhile or can't be read are left out
    (``unreadable`` tells of them). Excluded folders aren't entered.
    """
    if remote(root):
        return stored_workspace(spark, root, excludes)
    found = walked(spark, local_path(root), [*DEFAULT_EXCLUDES, *excludes]).where("problem is null")
    return found.select(F.xxhash64("path").alias("file_id"), "path", "language", "text")


def unreadable(spark: SparkSession, root: str, excludes: tuple[str, ...] = ()) -> DataFrame:
    """(path, problem) of folders and files below a local ``root`` that can't be read."""
    return walked(spark, local_path(root), [*DEFAULT_EXCLUDES, *excludes]).where("problem is not null").select("path", "problem")


def remote(root: str) -> bool:
    return re.match(r"^(?!file:)[A-Za-z][A-Za-z0-9+.-]+:", root) is not None


def local_path(root: str) -> str:
    return "/" + re.sub("^file:/*", "", root) if root.startswith("file:") else root


def stored_workspace(spark: SparkSession, root: str, excludes: tuple[str, ...] = ()) -> DataFrame:
    """``read_workspace`` for a folder of a store that only Spark reads, by Spark's own listing."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[cC][sS],[sS][qQ][lL],[cC][sS][pP][rR][oO][jJ],[jJ][sS][oO][nN]}").option("ignoreMissingFiles", True).format("binaryFile").load(root)
    # the path's own form may differ from the root's in the number of slashes
    bare = lambda x: F.regexp_replace(x, "^[A-Za-z0-9+.-]+:/*", "/")
    rel = F.substring(bare(F.col("path")), F.length(bare(F.lit(root.rstrip("/")))) + 2, F.length("path"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    out = raw.select(rel.alias("path"), F.regexp_replace(text, "^\ufeff", "").alias("text"))
    out = out.where(not_excluded(F.col("path"), [*DEFAULT_EXCLUDES, *excludes]))
    return out.select(F.xxhash64("path").alias("file_id"), "path", language(F.col("path")).alias("language"), "text").where("language is not null")


def lines(files: DataFrame) -> DataFrame:
    """(file_id, line, text): lines from 0, cut at line feeds."""
    return files.select("file_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


def directory(path: Column) -> Column:
    """What stands before the last slash; empty for a file at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder itself and all above it, the root as an empty string."""
    parts = F.split(folder, "/")
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), own))


def owners(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(file_id, project): every project folder at or above a file's folder. An equi-join on exploded ancestors."""
    each = files.select("file_id", F.explode(ancestors(directory(F.col("path")))).alias("folder"))
    return each.join(projects.select(F.col("project").alias("folder")).distinct(), "folder").select("file_id", F.col("folder").alias("project"))


def nearest_owner(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(file_id, project): the owner with the longest folder."""
    return owners(files, projects).groupBy("file_id").agg(F.max_by("project", F.length("project")).alias("project"))


def prefix_owner(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(file_id, project): the longest project folder that a file's path starts with, letter by letter and whatever the case.

    A folder ``a/b`` owns ``a/bc/x`` too, unless a longer one does.
    """
    named = projects.select("project").distinct().select("project", F.lower("project").alias("prefix"))
    ranked = named.groupBy("prefix").agg(F.min("project").alias("project")).withColumn("ord", F.lit(0))
    return longest_prefix(files.select("file_id", F.lower("path").alias("_low")), "_low", ranked).select("file_id", "project")


def longest_prefix(items: DataFrame, key: str, prefixes: DataFrame) -> DataFrame:
    """``items`` with ``prefix`` (and what comes with it): the longest row of ``prefixes`` that starts ``key``, the first on ties.

    The lengths that occur are brought to the driver, so that the join is on equal strings; Spark picks its strategy.
    """
    sizes = sorted(r.n for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect())
    starts = F.array(*(F.when(F.length(key) >= n, F.substring(key, 1, n)) for n in sizes)) if sizes else F.array().cast("array<string>")
    each = items.withColumn("_at", F.explode(F.array_compact(starts)))
    met = each.join(prefixes, F.col("_at") == F.col("prefix")).drop("_at")
    others = [c for c in met.columns if c not in items.columns]
    best = F.max_by(F.struct(*others), F.struct(F.length("prefix"), -F.col("ord"))).alias("_best")
    return met.groupBy(*items.columns).agg(best).select(*items.columns, "_best.*")


def plain_json(text: Column) -> Column:
    """JSON without comments and trailing commas; strings stay as they are."""
    quoted = r'"(?:[^"\\]++|\\.)*+"'
    bare = F.regexp_replace(text, rf"({quoted})|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/", "$1")
    return F.regexp_replace(bare, rf"({quoted})|,(?=\s*+[}}\]])", "$1")


#: Settings nested more deeply than this are an error, not cut.
DEEPEST = 1000


def json_leaves(settings: DataFrame) -> DataFrame:
    """(file_id, path, value) of all leaves: objects and arrays are followed, names joined by ``:``.

    Comments and trailing commas are allowed; malformed text has no leaves. One plan: a recursive query over variants.
    """
    spark = settings.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(DEEPEST))
    return spark.sql(
        """
        WITH RECURSIVE walk(file_id, path, v) AS (
          SELECT file_id, '', try_parse_json(text) FROM {settings}
          UNION ALL
          SELECT w.file_id, concat_ws(':', nullif(w.path, ''), coalesce(x.key, CAST(x.pos AS STRING))), x.value FROM walk w, LATERAL variant_explode(w.v) x)
        SELECT file_id, path, CAST(v AS STRING) AS value FROM walk WHERE path <> '' AND NOT schema_of_variant(v) RLIKE '^(OBJECT|ARRAY)<'
        """,
        settings=settings.select("file_id", plain_json(F.col("text")).alias("text")),
    )


def with_prefixes(paths: DataFrame) -> DataFrame:
    """``paths`` (project, path) with every section above each path, so that a lookup of a section is an equi-join."""
    parts = F.split("path", ":")
    all_of = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ":"))
    return paths.select("project", F.explode(all_of).alias("key")).distinct()
