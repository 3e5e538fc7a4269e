"""Rule files of projects and the closure of their @imports, to a depth of four.

Files are rows ``root, path, content``; paths are relative to their project. A line
that begins with ``@`` imports the path that follows, relative to the file's own
folder (``~/``: to a home folder, ``/``: as it is). Imports that lead to no file are
left out, cycles end where a file is met again. A file counts with its shortest
chain of imports; where several are as short, with the smallest importer.

Each level is one equality join of what was just reached with the edges, written to
the shared folder; a chain costs as many levels as it is long, at most the depth. A
null path or content imports nothing; repeated files count once; no files give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import saved, table

# The files that assistants load by themselves, and the folder of rules.
ENTRY_FILES = ["CLAUDE.md", "AGENTS.md", ".claude/CLAUDE.md"]
RULES = r"^\.claude/rules/[^/]+\.md$"
#: Only \n ends a line here.
IMPORT = r"(?md)^@([^\s`]+)"
DEPTH = 4


def read_files(spark: SparkSession, folder: str, root: str = "") -> DataFrame:
    """(root, path, content) of the Markdown files below a folder, each read whole by a task."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    at = F.call_function("url_decode", F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    below = F.element_at(F.split(at, r"\Q" + folder.rstrip("/") + r"/\E", 2), 2)
    return raw.select(F.lit(root).alias("root"), below.alias("path"), F.col("value").alias("content"))


def resolved(path: Column) -> Column:
    """A path without ``.`` and empty parts; ``..`` takes back the part before, where there is one to take."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    back = lambda a: (F.size(a) > 0) & (F.coalesce(F.get(a, F.size(a) - 1), F.lit("")) != "..")
    taken = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & back(a), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(taken, "/"))


def edges(files: DataFrame, home: str | None = None) -> DataFrame:
    """(root, path, target) of the imports of each file that lead to a file."""
    named = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1)))).alias("named")
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    at = F.when(F.startswith("named", F.lit("~/")), F.concat(F.lit(home), F.expr("substring(named, 2)"))).when(F.startswith("named", F.lit("/")), F.col("named")).otherwise(F.concat(folder, "named"))
    found = files.where("path is not null").select("root", "path", named).select("root", "path", resolved(at).alias("target"))
    there = files.select("root", F.col("path").alias("target"))
    return found.where("target is not null").distinct().join(there, ["root", "target"], "left_semi").select("root", "path", "target")


def import_closure(spark: SparkSession, files: DataFrame, depth: int = DEPTH, home: str | None = None) -> DataFrame:
    """(root, path, depth, by): the files that a project's assistants load, how many imports away, and the importer (null for those loaded by themselves)."""
    begin = files.where(F.col("path").isin(ENTRY_FILES) | F.col("path").rlike(RULES)).select("root", "path", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("by")).distinct()
    links = saved(spark, edges(files, home), "imports")
    reached = last = saved(spark, begin, "loaded")
    for level in range(1, depth + 1):
        met = last.select("root", "path").join(links, ["root", "path"]).groupBy("root", F.col("target").alias("path")).agg(F.min("path").alias("by"))
        fresh = met.join(reached.select("root", "path"), ["root", "path"], "left_anti")
        last = saved(spark, fresh.select("root", "path", F.lit(level).alias("depth"), "by"), "loaded")
        if last.isEmpty():
            break
        reached = reached.unionByName(last)
    return reached


def loaded_lines(spark: SparkSession, files: DataFrame, depth: int = DEPTH, home: str | None = None) -> DataFrame:
    """(file, line, value) of all files loaded, as operators.rules takes them; a file is named with its project."""
    kept = files.where("path is not null").dropDuplicates(["root", "path"]).join(import_closure(spark, files, depth, home).select("root", "path"), ["root", "path"], "left_semi")
    name = F.when(F.col("root") == "", F.col("path")).otherwise(F.concat_ws("/", "root", "path")).alias("file")
    return kept.select(name, F.posexplode(F.split("content", "\r?\n"))).select("file", (F.col("pos") + 1).alias("line"), F.col("col").alias("value"))


# --- a query over documents: each is a file of one of five projects and imports others by relative paths ---------------------------


def src9_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents 0 to 4 of each hundred are rule files. Each imports the fifth and thirty-fifth after and the tenth before (cycles), a file that isn't there, and names one within a line, which is no import."""
    path = lambda i: F.when(F.pmod(i, F.lit(100)) < 5, F.format_string(".claude/rules/%d.md", i)).otherwise(F.format_string("d%d/%d.md", F.pmod(i, F.lit(7)), i))
    i = F.col("doc_id")
    up = F.when(F.pmod(i, F.lit(100)) < 5, "../../").otherwise("../")
    # what a document says stays on one line here, so that only the lines below import
    said = F.concat(F.lit("# "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\n", " "))
    lines = [said, F.concat(F.lit("@"), up, path(i + 5)), F.concat(F.lit("@./"), up, path(i + 35)), F.concat(F.lit("@"), up, F.lit("none/../"), path(i - 10)), F.concat(F.lit("@gone/"), i.cast("string")), F.concat(F.lit("see @"), up, path(i + 15))]
    files = table(spark, sf_dir, "documents").select(F.pmod(i, F.lit(5)).cast("string").alias("root"), path(i).alias("path"), F.concat_ws("\n", *lines).alias("content"))
    return import_closure(spark, files)


QUERIES = {"src9_imports": src9_imports}
ORACLES = {
    "src9_imports": """WITH RECURSIVE f AS (SELECT DISTINCT doc_id AS i, CASE WHEN doc_id % 100 < 5 THEN '.claude/rules/' || doc_id || '.md' ELSE 'd' || doc_id % 7 || '/' || doc_id || '.md' END AS path FROM documents),
e AS (SELECT a.i AS a, b.i AS b, a.path AS by FROM (SELECT i, path, unnest([i + 5, i + 35, i - 10]) AS t FROM f) a JOIN f b ON b.i = a.t),
w AS (SELECT i, 0 AS n FROM f WHERE i % 100 < 5 UNION SELECT e.b, w.n + 1 FROM w JOIN e ON e.a = w.i WHERE w.n < 4),
d AS (SELECT i, min(n) AS n FROM w GROUP BY i),
b AS (SELECT d.i, min(e.by) AS by FROM d JOIN e ON e.b = d.i JOIN d p ON p.i = e.a AND p.n = d.n - 1 GROUP BY d.i)
SELECT CAST(f.i % 5 AS VARCHAR) AS root, f.path, CAST(d.n AS INTEGER) AS depth, b.by FROM d JOIN f USING (i) LEFT JOIN b USING (i)"""
}
