"""Readers: catalogues, source trees, JSON arrays, Parquet sets, lists of addresses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X

#: Directories that a source walk leaves out, beside those whose name begins with a point.
PRUNED = ["__pycache__", "node_modules", "venv", "env", ".git", "build", "dist", "egg-info", ".eggs", ".tox"]

CATALOGUE = T.StructType([T.StructField(c, T.StringType()) for c in ("repo_id", "repository_url", "category", "quality_rating", "description", "stars_estimate", "notes")])
GROUPS = T.StructType([T.StructField(c, T.StringType()) for c in ("repo", "category", "priority", "size", "deps")])
FILE_RECORD = T.StructType(
    [T.StructField("sample_id", T.LongType()), T.StructField("repo_id", T.StringType()), T.StructField("repository_url", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("line_num", T.IntegerType()), T.StructField("func_num", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("category", "quality_rating", "description", "stars_estimate", "notes", "code_content")]
)


def csv(spark: SparkSession, path: str, schema: T.StructType = CATALOGUE) -> DataFrame:
    """A CSV file with a header; quotes are doubled inside quotes, fields may hold commas and line ends, all are trimmed.
    Columns are taken by name, so their order in the file is free."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    have = {c.strip(): c for c in raw.columns}
    return raw.select(*[(F.trim(F.col(f"`{have[f.name]}`")) if f.name in have else F.lit(None).cast("string")).alias(f.name) for f in schema])


def address_list(spark: SparkSession, path: str) -> DataFrame:
    """One address a line; blank lines are left out."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "\\r$", "")).alias("url")).where("url <> ''")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are, else byte by byte as Latin-1; line ends become line feeds."""
    return X.unix_lines(F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")))


def utf8_or_empty(content: Column) -> Column:
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.lit(""))


def _folders(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(name, address) of the folders right below a root."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted((f.getPath().getName(), f.getPath().toString()) for f in found if f.isDirectory())


def _opened(address: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(address if "//" in address else address.replace(":", "://", 1))


def source_tree(spark: SparkSession, root: str, pruning: str = "named", suffix: str = ".py") -> DataFrame:
    """repo_folder, file_path (below the repository, with slashes, beginning with one), content (bytes) of a folder of
    repositories. pruning 'named': folders in PRUNED or with a leading point are left out, by whole name; 'cache': only
    paths with __pycache__ are.

    Spark's own file sources pass over names that begin with an underscore, as `__init__.py` does, so the workers walk the
    repositories themselves, one a row, and read the files after they are spread evenly, so that no large repository
    stays in one task.
    """
    from pyarrow import fs

    folders = spark.createDataFrame(_folders(spark, root), "repo_folder string, address string")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, address in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, top = _opened(address)
                rest, paths = [top], []
                while rest:
                    for f in system.get_file_info(fs.FileSelector(rest.pop())):
                        if f.type == fs.FileType.Directory:
                            if f.base_name not in PRUNED and not f.base_name.startswith(".") if pruning == "named" else "__pycache__" not in f.base_name:
                                rest.append(f.path)
                        elif f.base_name.endswith(suffix) and (pruning == "named" or "__pycache__" not in f.base_name):
                            paths.append(f.path)
                n = len(paths)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([address] * n, pa.string()), pa.array(paths, pa.string()), pa.array([p[len(top) :] for p in paths], pa.string())], ["repo_folder", "address", "place", "file_path"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 200) for whole in batches for i in range(0, whole.num_rows, 200)):
            contents = []
            for address, place in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                with _opened(address)[0].open_input_stream(place) as f:
                    contents.append(f.read())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(contents, pa.binary())], ["repo_folder", "file_path", "content"])

    places = folders.repartition(max(1, min(folders.count(), 200)), "repo_folder").mapInArrow(walk, "repo_folder string, address string, place string, file_path string")
    return places.repartition(F.xxhash64("place")).mapInArrow(read, "repo_folder string, file_path string, content binary")


def repository_id(folder: Column) -> Column:
    """What stands before the first underscore of a folder's name; null without one."""
    return F.when(F.contains(folder, F.lit("_")), F.split_part(folder, F.lit("_"), F.lit(1)))


def repositories(tree: DataFrame) -> DataFrame:
    """Folders that are not hidden and hold a source file, with their number of files."""
    return tree.where(~F.startswith("repo_folder", F.lit("."))).groupBy("repo_folder").agg(F.count("*").alias("files"))


def json_array(spark: SparkSession, path: str, schema: T.StructType = FILE_RECORD) -> DataFrame:
    """A file that is one JSON array of records, by a schema; broken records give nulls."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parquet_set(spark: SparkSession, paths: list[str], columns: dict[str, str] | None = None) -> DataFrame:
    """Several Parquet files as one table with `file_no` and `row_no`, which give their order; columns may be renamed
    (name in the file: name wanted) and are then the only ones read."""
    if not paths:
        raise ValueError("no paths")
    out = None
    for n, path in enumerate(paths):
        df = spark.read.parquet(path)
        at = F.col("_metadata.row_index").alias("row_no")
        df = df.select(*([F.col(a).alias(b) for a, b in columns.items()] if columns else ["*"]), F.lit(n).alias("file_no"), at)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows by (file_no, row_no)."""
    return df.orderBy("file_no", "row_no").limit(n)
