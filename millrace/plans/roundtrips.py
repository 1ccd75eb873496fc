"""Queries that write a table through a sink and read it back through a source: what comes out must be what went in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.catalogue import register
from millrace.session import shared_dir, table
from millrace.sources import readers, writers


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_FIELDS = ("repo_id", "repository_url", "category", "quality_rating", "description", "stars_estimate", "notes")


@register("csv_read_back", "SELECT " + ", ".join(f"CASE WHEN {c} <> '' THEN trim({c}) END AS {c}" for c in _FIELDS) + " FROM repo_catalog")
def csv_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as CSV with a header, quotes doubled, columns in another order; read by name and trimmed. A field without
    a character is null in CSV."""
    at = _place(spark, "csv")
    c = table(spark, sf_dir, "repo_catalog").select(*reversed(_FIELDS))
    c.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at)
    return readers.csv(spark, at)


@register("addresses_read_back", "SELECT trim(repository_url) AS url FROM repo_catalog WHERE trim(repository_url) <> ''")
def addresses_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address a line, blank lines among them."""
    at = _place(spark, "list")
    table(spark, sf_dir, "repo_catalog").select(F.coalesce("repository_url", F.lit("")).alias("value")).write.text(at)
    return readers.address_list(spark, at)


_ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("item_id", "category", "question", "answer")])


@register("json_array_read_back", "SELECT item_id, category, question, answer FROM eval_items")
def json_array_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file that is one JSON array."""
    at = _place(spark, "array")
    writers.json_array(table(spark, sf_dir, "eval_items").select(*_ITEM.names), at, "item_id")
    return readers.json_array(spark, at, _ITEM)


@register("json_lines_read_back", "SELECT item_id, category, question, answer FROM eval_items")
def json_lines_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "lines")
    writers.json_lines(table(spark, sf_dir, "eval_items").select(*_ITEM.names), at)
    return spark.read.schema(_ITEM).json(at)


@register("splits_read_back", "SELECT item_id, CASE WHEN category < 'm' THEN 0 ELSE 1 END AS file_no FROM eval_items")
def splits_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and test rows as Parquet, read as one set in the order of its files."""
    at = _place(spark, "splits")
    i = table(spark, sf_dir, "eval_items").select("item_id", "category")
    writers.train_test(i.where("category < 'm'"), i.where("category >= 'm' or category is null"), at)
    return readers.parquet_set(spark, [f"{at}/train.parquet", f"{at}/test.parquet"], {"item_id": "item_id"}).select("item_id", "file_no")


@register("first_items", "SELECT item_id FROM eval_items ORDER BY item_id LIMIT 100")
def first_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a file by its own order: the feature is the cut."""
    at = _place(spark, "first")
    table(spark, sf_dir, "eval_items").select("item_id").orderBy("item_id").coalesce(1).write.parquet(at)
    return readers.first_rows(readers.parquet_set(spark, [at]), 100).select("item_id")


@register("responses_read_back", "SELECT p_partkey, p_name, list_sort([p_name || ' a', p_name || ' b']) AS responses FROM part")
def responses_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table enriched with an array of responses."""
    at = _place(spark, "responses")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    r = p.select("p_partkey", F.array(F.concat("p_name", F.lit(" a")), F.concat("p_name", F.lit(" b"))).alias("responses"))
    writers.with_responses(p, r, "p_partkey", at)
    return spark.read.parquet(at).select("p_partkey", "p_name", "responses")


@register("texts_read_back", "SELECT category, CAST(count(*) AS BIGINT) AS items, CAST(sum(length(answer)) AS BIGINT) AS chars FROM eval_items WHERE answer IS NOT NULL AND category IS NOT NULL GROUP BY category")
def texts_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in a folder for each key."""
    at = _place(spark, "texts")
    i = table(spark, sf_dir, "eval_items").where("answer is not null and category is not null")
    writers.texts(i.select("category", F.regexp_replace("answer", "\n", " ").alias("answer")), at, ["category"], "answer")
    back = spark.read.schema("value string, category string").text(at)
    return back.groupBy("category").agg(F.count("*").alias("items"), F.sum(F.length("value")).alias("chars"))


@register("replaced_table", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 5")
def replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is written twice; readers find the second in place of the first."""
    at = _place(spark, "replaced")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    writers.replaced(n, at)
    writers.replaced(n.where("n_nationkey >= 5"), at)
    return spark.read.parquet(at)


@register("remaining_work", "SELECT sample_id FROM py_files WHERE coalesce(func_num, 0) >= 0 AND coalesce(line_num, 0) <= 60")
def remaining_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a state table of done and failed keys leaves over."""
    f = table(spark, sf_dir, "py_files").select("sample_id", "func_num", "line_num")
    state = writers.State(spark, _place(spark, "state"), "sample_id")
    state.add(f.where("func_num < 0"), "failed")
    state.add(f.where("line_num > 60"), "done")
    return state.remaining(f).select("sample_id")


@register("copied_table", "SELECT r_regionkey, r_name FROM region")
def copied_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table copied between folders by the file system, found there and read."""
    at = _place(spark, "from")
    table(spark, sf_dir, "region").select("r_regionkey", "r_name").write.parquet(at)
    writers.make_folder(spark, f"{at}-to")
    writers.copy(spark, at, f"{at}-to/copy")
    if not writers.exists(spark, f"{at}-to/copy"):
        raise FileNotFoundError(at)
    return spark.read.parquet(f"{at}-to/copy")


@register("logged_metrics", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'acc', CAST(0.5 AS DOUBLE)), (1, 'n', 3.0), (2, 'acc', 0.75)) t(step, key, value)")
def logged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics in long form; texts and flags are no metrics."""
    at = _place(spark, "metrics")
    writers.log_metrics({"acc": 0.5, "n": 3, "note": "x", "flag": True}, 1, spark, at)
    writers.log_metrics({"acc": 0.75}, 2, spark, at)
    return spark.read.parquet(at)


@register("metric_lines", "SELECT result_id, 'step:' || CAST(result_id AS VARCHAR) || CASE WHEN len(k) > 0 THEN ' - ' || array_to_string(list_transform(k, lambda x: x || ':' || printf('%.3f', m[x])), ' - ') ELSE '' END AS line FROM (SELECT result_id, m, list_sort(map_keys(m)) AS k FROM (SELECT result_id, any_value(metrics) AS m FROM eval_results GROUP BY result_id) WHERE m IS NOT NULL)")
def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "eval_results").where("metrics is not null").select("result_id", F.map_entries("metrics").alias("m")).groupBy("result_id").agg(F.first("m").alias("m"))
    return e.select("result_id", writers.metric_line(F.map_from_entries("m"), "result_id").alias("line"))


@register("latest_steps", "SELECT CAST(max(step) AS BIGINT) AS step, 'root/global_step_' || max(step) AS folder FROM rollout")
def latest_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder of the latest checkpoint, from the steps of a manifest."""
    step = writers.latest_step(spark, table(spark, sf_dir, "rollout").select("step"))
    return spark.createDataFrame([(step, writers.step_folder("root/", step))], "step long, folder string")


@register("wide_validation", "WITH s AS (SELECT item_id, question, row_number() OVER (ORDER BY question, item_id) AS k FROM eval_items QUALIFY k <= 2) SELECT CAST(7 AS BIGINT) AS step, max(question) FILTER (k = 1) AS input_1, max(item_id) FILTER (k = 1) AS output_1, CAST(0.5 AS DOUBLE) AS score_1, max(question) FILTER (k = 2) AS input_2, max(item_id) FILTER (k = 2) AS output_2, CAST(0.5 AS DOUBLE) AS score_2 FROM s")
def wide_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two samples in one row; the feature is the cut."""
    s = table(spark, sf_dir, "eval_items").select(F.col("question").alias("input"), F.col("item_id").alias("output"), F.lit(0.5).alias("score"))
    return writers.validation_table(s, 7, 2)


@register("flat_settings", "SELECT * FROM (VALUES ('a/b', '1'), ('a/c/list_len', '2'), ('a/c/0', 'x'), ('a/c/1/d', 'None'), ('e', '0.5')) t(key, value)")
def flat_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = writers.flat_config({"a": {"b": 1, "c": ["x", {"d": None}]}, "e": 0.5})
    return spark.createDataFrame([(k, str(v)) for k, v in flat.items()], "key string, value string")
