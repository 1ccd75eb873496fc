"""Queries on source code: imports, closures, extraction and masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.functions import text as T
from millrace.operators import graph
from millrace.plans.catalogue import register
from millrace.session import table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "py_files").select("sample_id", F.coalesce(F.trim("repo_id"), F.lit("")).alias("repo_id"), "file_path", "code_content")


@register("module_names", "SELECT sample_id, replace(regexp_replace(regexp_replace(file_path, '^/+', ''), '\\.py$', ''), '/', '.') AS module FROM py_files")
def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "py_files").select("sample_id", T.module_name("file_path").alias("module"))


@register("imported_packages")
def imported_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of each repository import each package; by Python's parser, so without SQL."""
    f = _files(spark, sf_dir).select("repo_id", "sample_id", F.explode(F.array_distinct(C.imports_column("code_content"))).alias("name"))
    return f.groupBy("repo_id", T.package("name").alias("package")).agg(F.count_distinct("sample_id").alias("files"))


@register("import_closure")
def import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency closures of every module with order and level."""
    mods = graph.modules(_files(spark, sf_dir), "repo_id", "file_path", "code_content")
    from millrace.session import written

    mods = written(mods, "modules")
    links = written(graph.edges(mods), "links")
    return graph.ordered(graph.closure(mods, links), links)


@register("external_packages")
def external_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct external packages by repository, and over all in the row without one."""
    out = graph.external(graph.modules(_files(spark, sf_dir), "repo_id", "file_path", "code_content"))
    return out.rollup("repo").agg(F.count_distinct("package").alias("packages"), F.grouping("repo").cast("int").alias("is_total"))


@register("masked_functions")
def masked_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function of every file that parses, with its masked file and a running id by file and place."""
    f = table(spark, sf_dir, "py_files").select("sample_id", F.posexplode(C.every_function_column("code_content")).alias("pos", "x"))
    from millrace.operators import frame
    from millrace.session import written

    return frame.positions(written(f.select("sample_id", "pos", "x.*"), "functions"), "sample_id", "pos", name="function_id")


@register("repository_reports")
def repository_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary text of each repository."""
    from millrace.session import written

    mods = written(graph.modules(_files(spark, sf_dir), "repo_id", "file_path", "code_content"), "modules")
    links = written(graph.edges(mods), "links")
    return graph.repository_summary(mods, graph.ordered(graph.closure(mods, links), links), graph.external(mods))


@register("merged_modules")
def merged_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every module with its dependencies in one text, leaves first."""
    from millrace.session import written

    f = _files(spark, sf_dir)
    mods = written(graph.modules(f, "repo_id", "file_path", "code_content"), "modules")
    links = written(graph.edges(mods), "links")
    contents = f.select(F.col("repo_id").alias("repo"), F.col("file_path").alias("path"), F.col("code_content").alias("content")).join(mods.select("repo", "path", "module"), ["repo", "path"])
    contents = contents.groupBy("repo", "module").agg(F.min("content").alias("content"))
    return graph.rendered(graph.ordered(graph.closure(mods, links), links), contents)


_SUPPLIERS = "n AS (SELECT s_suppkey AS k FROM supplier), e AS (SELECT k AS src, k // 2 AS dst FROM n UNION SELECT k, k // 3 FROM n UNION SELECT 1, max(k) FROM n)"


@register(
    "reachable_suppliers",
    f"""WITH RECURSIVE {_SUPPLIERS}, f AS (SELECT src, dst FROM e WHERE src <> dst AND src IN (SELECT k FROM n) AND dst IN (SELECT k FROM n)), c(root, module) AS (SELECT k, k FROM n UNION SELECT c.root, f.dst FROM c JOIN f ON c.module = f.src)
    SELECT CAST(root AS VARCHAR) AS root, CAST(module AS VARCHAR) AS module FROM c""",
)
def reachable_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure on a graph that SQL can hold: each supplier leads to its half and its third, and the first to the last, so
    that there are cycles."""
    n = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    top = n.agg(F.lit(1).alias("src"), F.max("k").alias("dst"))
    e = n.select(F.col("k").alias("src"), F.expr("k div 2").alias("dst")).unionByName(n.select(F.col("k").alias("src"), F.expr("k div 3").alias("dst"))).unionByName(top)
    mods = n.select(F.lit("all").alias("repo"), F.col("k").cast("string").alias("module"))
    links = e.where("src <> dst").select(F.lit("all").alias("repo"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    known = mods.select(F.col("module").alias("dst"))
    links = links.join(known, "dst", "left_semi").join(known.select(F.col("dst").alias("src")), "src", "left_semi")
    return graph.closure(mods, links).select("root", "module")
