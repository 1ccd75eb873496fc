"""Queries on catalogues, files, joins, set operations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.functions import text as T
from millrace.operators import validation as V
from millrace.plans.catalogue import register
from millrace.session import table

CATALOGUE_SQL = """c AS (SELECT trim(repo_id) AS repo_id, trim(repository_url) AS repository_url, trim(category) AS category, trim(quality_rating) AS quality_rating, row_number() OVER () AS k FROM repo_catalog),
v AS (SELECT repo_id, arg_max(repository_url, k) FILTER (true) AS u, max(k) AS last, min(k) AS first FROM c WHERE repo_id <> '' GROUP BY repo_id),
current AS (SELECT c.repo_id, repository_url, category, quality_rating, first FROM c JOIN v ON c.repo_id = v.repo_id AND c.k = v.last)"""


def current_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each id: the last in file order, at the first's place. Every field is trimmed; blank ids are dropped."""
    c = table(spark, sf_dir, "repo_catalog").select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("_k"))
    c = c.select("_k", *[F.trim(x).alias(x) for x in ("repo_id", "repository_url", "category", "quality_rating", "description", "stars_estimate", "notes")]).where("repo_id <> ''")
    fields = [x for x in c.columns if x not in ("_k", "repo_id")]
    return c.groupBy("repo_id").agg(F.max_by(F.struct(*fields), "_k").alias("_r"), F.min("_k").alias("first")).select("repo_id", "_r.*", "first")


@register("current_catalogue", f"WITH {CATALOGUE_SQL} SELECT repo_id, repository_url, category, quality_rating FROM current")
def current_catalogue_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_catalogue(spark, sf_dir).select("repo_id", "repository_url", "category", "quality_rating")


@register("catalogue_validity", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (coalesce(trim(repo_id), '') <> '' AND coalesce(trim(repository_url), '') <> '') AS BIGINT) AS valid FROM repo_catalog")
def catalogue_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return table(spark, sf_dir, "repo_catalog").agg(F.count("*").alias("n"), F.count_if(filled("repo_id") & filled("repository_url")).alias("valid"))


_PATH_SQL = "regexp_extract(trim(repository_url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


@register(
    "repository_names",
    f"""SELECT repo_id, repository_url, CASE WHEN len(p) >= 2 THEN p[-1] END AS name, regexp_replace(repository_url, '\\.git$', '').split('/')[-1] AS base, regexp_replace(repository_url, '[.git]+$', '').split('/')[-1] AS trimmed
    FROM (SELECT repo_id, repository_url, list_filter(string_split({_PATH_SQL}, '/'), lambda x: x <> '') AS p FROM (SELECT DISTINCT repo_id, repository_url FROM repo_catalog))""",
)
def repository_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every address, ssh forms and null ones included."""
    c = table(spark, sf_dir, "repo_catalog").select("repo_id", "repository_url").distinct()
    return c.select("repo_id", "repository_url", T.repo_name("repository_url").alias("name"), T.repo_base("repository_url").alias("base"), T.repo_base("repository_url", exact=False).alias("trimmed"))


@register(
    "files_with_catalogue",
    f"""WITH {CATALOGUE_SQL} SELECT f.sample_id, c.category, c.quality_rating, c.repo_id IS NOT NULL AS known FROM py_files f LEFT JOIN current c ON trim(f.repo_id) = c.repo_id""",
)
def files_with_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue is a fixed list; it is left to the planner to broadcast by its size."""
    c = current_catalogue(spark, sf_dir).select("repo_id", "category", "quality_rating")
    f = table(spark, sf_dir, "py_files").select("sample_id", F.trim("repo_id").alias("_id"))
    return f.join(c, F.col("_id") == c["repo_id"], "left").select("sample_id", "category", "quality_rating", F.col("repo_id").isNotNull().alias("known"))


@register("unknown_repositories", f"WITH {CATALOGUE_SQL} SELECT DISTINCT trim(repo_id) AS repo_id FROM py_files WHERE repo_id IS NOT NULL AND trim(repo_id) NOT IN (SELECT repo_id FROM current)")
def unknown_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "py_files").select(F.trim("repo_id").alias("repo_id")).where("repo_id is not null").distinct()
    return f.join(current_catalogue(spark, sf_dir), "repo_id", "left_anti")


@register(
    "resumed_files",
    "SELECT sample_id FROM py_files WHERE sample_id NOT IN (SELECT sample_id FROM py_files WHERE func_num < 0 UNION SELECT sample_id FROM py_files WHERE line_num > 60)",
)
def resumed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run still has to do: rows that neither state table holds."""
    f = table(spark, sf_dir, "py_files").select("sample_id", "func_num", "line_num")
    done = f.where("func_num < 0").select("sample_id").union(f.where("line_num > 60").select("sample_id")).distinct()
    return f.join(done, "sample_id", "left_anti").select("sample_id")


@register("kept_prompts", "SELECT row_idx FROM (SELECT row_idx, any_value(uid) AS uid FROM rollout GROUP BY row_idx) WHERE uid IN (SELECT uid FROM rl_rows)")
def kept_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "rollout").groupBy("row_idx").agg(F.first("uid").alias("uid"))
    return r.join(table(spark, sf_dir, "rl_rows").select("uid"), "uid", "left_semi").select("row_idx")


@register(
    "line_counts",
    """SELECT sample_id, CAST(CASE WHEN code_content = '' THEN 0 ELSE len(regexp_split_to_array(code_content, '\\r\\n|[\\n\\x0B\\x0C\\r\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]'))
    - CASE WHEN regexp_matches(code_content, '[\\n\\x0B\\x0C\\r\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]\\z') THEN 1 ELSE 0 END END AS INTEGER) AS lines FROM py_files""",
)
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "py_files").select("sample_id", T.line_count("code_content").alias("lines"))


@register("function_counts", "SELECT sample_id, func_num, func_num AS functions FROM py_files")
def function_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted by Python's parser; the table's own counts are the answer."""
    return table(spark, sf_dir, "py_files").select("sample_id", "func_num", C.function_count_column("code_content").alias("functions"))


@register(
    "extraction_summary",
    f"""WITH {CATALOGUE_SQL}, f AS (SELECT trim(repo_id) AS repo_id, func_num FROM py_files)
    SELECT (SELECT CAST(count(*) AS BIGINT) FROM current) AS repos, (SELECT CAST(count(*) AS BIGINT) FROM current WHERE repo_id IN (SELECT repo_id FROM f)) AS repos_with_files, CAST(count(*) AS BIGINT) AS files, CAST(count(*) FILTER (func_num = -1) AS BIGINT) AS unparsed FROM f""",
)
def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = current_catalogue(spark, sf_dir).select("repo_id")
    f = table(spark, sf_dir, "py_files").select(F.trim("repo_id").alias("repo_id"), "func_num")
    by = f.groupBy("repo_id").agg(F.count("*").alias("n"), F.count_if(F.col("func_num") == -1).alias("bad"))
    joined = by.join(c.withColumn("known", F.lit(1)), "repo_id", "full")
    return joined.agg(F.count("known").alias("repos"), F.count_if(F.col("known").isNotNull() & F.col("n").isNotNull()).alias("repos_with_files"), F.sum(F.coalesce("n", F.lit(0))).alias("files"), F.sum(F.coalesce("bad", F.lit(0))).alias("unparsed"))


@register("running_usage", "SELECT result_id, CAST(sum(n) OVER (ORDER BY result_id) AS BIGINT) AS running FROM (SELECT result_id, any_value(len(convo)) AS n FROM eval_results GROUP BY result_id)")
def running_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running total over all rows without one task for all: totals of ranges first, then within each range."""
    e = table(spark, sf_dir, "eval_results").groupBy("result_id").agg(F.first(F.size("convo")).alias("n"))
    e = e.withColumn("_block", F.expr("result_id div 4096"))
    sums = e.groupBy("_block").agg(F.sum("n").alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = F.sum("n").over(Window.partitionBy("_block").orderBy("result_id"))
    return e.withColumn("_in", inside).join(before, "_block").select("result_id", (F.col("_in") + F.col("_before")).alias("running"))


@register("level_histogram", "SELECT lower(trim(extra_info.level)) AS level, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT uid, extra_info FROM rl_rows) GROUP BY 1")
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "rl_rows").select("uid", "extra_info").distinct()
    return r.groupBy(F.lower(F.trim("extra_info.level")).alias("level")).agg(F.count("*").alias("n"))


@register(
    "category_accuracy",
    """WITH e AS (SELECT result_id, any_value(lower(eval_name)) AS eval_name, any_value(score) AS score FROM eval_results GROUP BY result_id), c AS (SELECT eval_name, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS "right" FROM e GROUP BY eval_name)
    SELECT false AS is_total, eval_name, n, "right", round("right" / n, 6) AS accuracy, NULL::DOUBLE AS macro FROM c UNION ALL SELECT true, NULL, CAST(sum(n) AS BIGINT), CAST(sum("right") AS BIGINT), round(sum("right") / sum(n), 6), round(avg("right" / n), 6) FROM c""",
)
def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evals(spark, sf_dir).withColumn("hit", F.col("score") >= 0.5)
    return V.accuracy(e, "eval_name", "hit").withColumn("accuracy", F.round("accuracy", 6)).withColumn("macro", F.round("macro", 6))


def _evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "eval_results").select("result_id", F.lower("eval_name").alias("eval_name"), "model", "score")
    return e.groupBy("result_id").agg(*[F.first(c).alias(c) for c in ("eval_name", "model", "score")])


@register(
    "model_pivot",
    """WITH e AS (SELECT result_id, any_value(lower(eval_name)) AS eval_name, any_value(model) AS model, any_value(score) AS score FROM eval_results GROUP BY result_id)
    SELECT model, round(avg(score) FILTER (eval_name = 'code_exec'), 6) AS code_exec, round(avg(score) FILTER (eval_name = 'hard_tasks'), 6) AS hard_tasks, round(avg(score) FILTER (eval_name = 'math_final'), 6) AS math_final, round(avg(score) FILTER (eval_name = 'mc_general'), 6) AS mc_general, round(avg(score) FILTER (eval_name = 'theorem_short'), 6) AS theorem_short FROM e GROUP BY model""",
)
def model_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["code_exec", "hard_tasks", "math_final", "mc_general", "theorem_short"]
    p = _evals(spark, sf_dir).groupBy("model").pivot("eval_name", names).agg(F.avg("score"))
    return p.select("model", *[F.round(n, 6).alias(n) for n in names])


@register(
    "metric_statistics",
    """WITH e AS (SELECT result_id, any_value(lower(eval_name)) AS eval_name, any_value(metrics) AS metrics FROM eval_results GROUP BY result_id), k AS (SELECT eval_name, unnest(map_keys(metrics)) AS k, unnest(map_values(metrics)) AS v FROM e),
    s AS (SELECT eval_name, k, avg(v) AS m, stddev_pop(v) AS s FROM k GROUP BY eval_name, k) SELECT eval_name, k AS name, round(m, 6) AS value FROM s UNION ALL SELECT eval_name, k || ':std', round(s, 6) FROM s""",
)
def metric_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "eval_results").select("result_id", F.lower("eval_name").alias("eval_name"), F.map_entries("metrics").alias("m"))
    e = e.groupBy("result_id").agg(F.first("eval_name").alias("eval_name"), F.first("m").alias("m")).withColumn("metrics", F.map_from_entries("m"))
    return V.aggregated(e, ["eval_name"], "metrics").withColumn("value", F.round("value", 6))


@register(
    "source_scores",
    """WITH r AS (SELECT row_idx, any_value(uid) AS uid, any_value(lower(data_source)) AS data_source, any_value(list_sum(token_level_scores)) AS score FROM rollout GROUP BY row_idx), p AS (SELECT data_source, uid, avg(score) AS s FROM r GROUP BY data_source, uid)
    SELECT data_source, round(avg(s), 6) AS test_score FROM p GROUP BY data_source""",
)
def source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.plans.groups import scored

    return V.mean_of_means(scored(spark, sf_dir), "data_source", "uid", "score").withColumn("test_score", F.round("test_score", 6))


@register(
    "data_metrics",
    """WITH d AS (SELECT row_idx, any_value(list_sum(token_level_scores)) AS s, any_value(list_sum(list_slice(attention_mask, 81, 240))) AS n, any_value(list_sum(list_slice(attention_mask, 1, 80))) AS p FROM rollout GROUP BY row_idx)
    SELECT round(avg(s), 6) AS score_mean, round(max(s), 6) AS score_max, round(min(s), 6) AS score_min, round(avg(n), 6) AS response_mean, CAST(max(n) AS DOUBLE) AS response_max, CAST(min(n) AS DOUBLE) AS response_min, round(avg(CASE WHEN n = 160 THEN 1.0 ELSE 0.0 END), 6) AS response_clip,
    round(avg(p), 6) AS prompt_mean, CAST(max(p) AS DOUBLE) AS prompt_max, CAST(min(p) AS DOUBLE) AS prompt_min, round(avg(CASE WHEN p = 80 THEN 1.0 ELSE 0.0 END), 6) AS prompt_clip FROM d""",
)
def data_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.functions import sequences as Q

    r = table(spark, sf_dir, "rollout").select("row_idx", Q.total("token_level_scores").alias("s"), Q.total(F.slice("attention_mask", 81, 160)).alias("n"), Q.total(F.slice("attention_mask", 1, 80)).alias("p")).groupBy("row_idx").agg(F.first("s").alias("s"), F.first("n").alias("n"), F.first("p").alias("p"))
    clip = lambda c, at: F.round(F.avg(F.when(F.col(c) == at, 1.0).otherwise(0.0)), 6)
    return r.agg(F.round(F.avg("s"), 6).alias("score_mean"), F.round(F.max("s"), 6).alias("score_max"), F.round(F.min("s"), 6).alias("score_min"), F.round(F.avg("n"), 6).alias("response_mean"), F.max("n").alias("response_max"), F.min("n").alias("response_min"), clip("n", 160).alias("response_clip"), F.round(F.avg("p"), 6).alias("prompt_mean"), F.max("p").alias("prompt_max"), F.min("p").alias("prompt_min"), clip("p", 80).alias("prompt_clip"))


@register(
    "explained_variance",
    """SELECT event_type, round(1 - var_samp(value - b) / (var_samp(value) + 1e-5), 6) AS explained FROM (SELECT event_type, value, avg(value) OVER (PARTITION BY user_id) AS b FROM events) GROUP BY event_type""",
)
def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "value")
    b = e.groupBy("user_id").agg(F.avg("value").alias("b"))
    j = e.join(b, "user_id")
    return j.groupBy("event_type").agg(F.round(1 - F.var_samp(F.col("value") - F.col("b")) / (F.var_samp("value") + 1e-5), 6).alias("explained"))


@register("throughput", "SELECT CAST(step AS INTEGER) AS step, round(sum(n) / (1.5 * 8), 6) AS tokens_per_second, round(1.5 * 1000 / sum(n), 9) AS ms_per_token FROM (SELECT row_idx, any_value(step) AS step, any_value(list_sum(attention_mask)) AS n FROM rollout GROUP BY row_idx) GROUP BY step")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens a second and worker, for a step of 1.5 s on 8 workers."""
    from millrace.functions import sequences as Q

    r = table(spark, sf_dir, "rollout").select("row_idx", "step", Q.total("attention_mask").alias("n")).groupBy("row_idx").agg(F.first("step").alias("step"), F.first("n").alias("n"))
    return r.groupBy("step").agg(F.round(F.sum("n") / 12, 6).alias("tokens_per_second"), F.round(F.lit(1500.0) / F.sum("n"), 9).alias("ms_per_token"))


@register("estimated_flops", "SELECT step, round((6 * 5e8 * sum(n) + 12 * 24 * 896 * sum(n * n)) / 1.5 / 1e12, 6) AS teraflops FROM (SELECT row_idx, any_value(step) AS step, any_value(list_sum(attention_mask)) AS n FROM rollout GROUP BY row_idx) GROUP BY step")
def estimated_flops(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.functions import sequences as Q

    r = table(spark, sf_dir, "rollout").select("row_idx", "step", Q.total("attention_mask").alias("n")).groupBy("row_idx").agg(F.first("step").alias("step"), F.first("n").alias("n"))
    return r.groupBy("step").agg(F.round((6 * 5e8 * F.sum("n") + 12 * 24 * 896 * F.sum(F.col("n") * F.col("n"))) / 1.5 / 1e12, 6).alias("teraflops"))


@register("event_properties", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(CAST(json_extract_string(props, '$.usage') AS INTEGER), 0) AS usage FROM events")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.from_json("props", "k int, usage int")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["usage"], F.lit(0)).alias("usage"))


@register(
    "rl_rows_built",
    """SELECT item_id, category AS data_source, question || ' Let us think step by step and put the final answer within \\boxed{}.' AS content, CASE WHEN len(options) > 0 THEN 'choice' ELSE 'rule' END AS style, answer AS ground_truth, 'test' AS split FROM eval_items""",
)
def rl_rows_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows from items: prompt as a chat, reward model and extra fields as structs, then flattened to compare."""
    i = table(spark, sf_dir, "eval_items")
    rows = i.select(
        "item_id",
        F.col("category").alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), T.with_instruction("question", "Let us think step by step and put the final answer within \\boxed{}.").alias("content"))).alias("prompt"),
        F.struct(F.when(F.size("options") > 0, "choice").otherwise("rule").alias("style"), F.col("answer").alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit("test").alias("split"), "answer", "question").alias("extra_info"),
    )
    return rows.select("item_id", "data_source", F.get("prompt", F.lit(0))["content"].alias("content"), "reward_model.style", "reward_model.ground_truth", "extra_info.split")


@register("options_blocks", "SELECT item_id, coalesce(array_to_string(list_transform(list_zip(options[1:10], range(len(options[1:10]))), lambda p: '(' || chr(CAST(65 + p[2] AS INTEGER)) || '): ' || p[1] || chr(10)), ''), '') AS block FROM eval_items WHERE options IS NOT NULL")
def options_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").where("options is not null").select("item_id", T.options_block("options").alias("block"))


@register("chat_rows", "SELECT result_id, i AS turn, convo[i + 1].role AS role, length(convo[i + 1].content) AS n FROM (SELECT result_id, any_value(convo) AS convo FROM eval_results GROUP BY result_id), (SELECT unnest(range(0, 8)) AS i) WHERE i < len(convo)")
def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "eval_results").groupBy("result_id").agg(F.first("convo").alias("convo"))
    return e.select("result_id", F.posexplode("convo").alias("turn", "m")).select("result_id", F.col("turn").cast("long").alias("turn"), "m.role", F.length("m.content").cast("long").alias("n"))


@register(
    "turn_loss_tokens",
    """WITH e AS (SELECT result_id, any_value(convo) AS convo FROM eval_results GROUP BY result_id), t AS (SELECT result_id, unnest(convo) AS m FROM e) SELECT result_id, CAST(sum(CASE WHEN m.role = 'assistant' THEN len(string_split(coalesce(m.content, ''), ' ')) ELSE 0 END) AS INTEGER) AS assistant, CAST(sum(len(string_split(coalesce(m.content, ''), ' '))) AS INTEGER) AS all_tokens FROM t GROUP BY result_id""",
)
def turn_loss_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss mask over the turns of a chat, tokens being words between spaces; shown as its sum and length."""
    from millrace.functions import sequences as Q

    e = table(spark, sf_dir, "eval_results").groupBy("result_id").agg(F.first("convo").alias("convo")).where("convo is not null and size(convo) > 0")
    n = F.transform("convo", lambda m: F.size(F.split(F.coalesce(m["content"], F.lit("")), " ", -1)))
    e = e.select("result_id", n.alias("n"), F.transform("convo", lambda m: m["role"] == "assistant").alias("w")).withColumn("mask", Q.turn_mask("n", "w"))
    return e.select("result_id", F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("assistant"), F.size("mask").alias("all_tokens"))


@register(
    "turn_masks",
    """WITH e AS (SELECT result_id, any_value(convo) AS convo FROM eval_results GROUP BY result_id), t AS (SELECT result_id, unnest(convo) AS m, generate_subscripts(convo, 1) AS k FROM e), f AS (SELECT result_id, list(CASE WHEN m.role = 'assistant' THEN 1 ELSE 0 END ORDER BY k, j) AS l FROM (SELECT result_id, m, k, unnest(range(len(string_split(coalesce(m.content, ''), ' ')))) AS j FROM t) GROUP BY result_id)
    SELECT result_id, list_transform(range(1, 65), lambda i: CAST(CASE WHEN i > len(l) THEN 0 ELSE l[i] END AS INTEGER)) AS mask FROM f""",
)
def turn_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As turn_loss_tokens, padded or cut to 64 tokens."""
    from millrace.functions import sequences as Q

    e = table(spark, sf_dir, "eval_results").groupBy("result_id").agg(F.first("convo").alias("convo")).where("convo is not null and size(convo) > 0")
    n = F.transform("convo", lambda m: F.size(F.split(F.coalesce(m["content"], F.lit("")), " ", -1)))
    return e.select("result_id", n.alias("n"), F.transform("convo", lambda m: m["role"] == "assistant").alias("w")).select("result_id", Q.turn_mask("n", "w", 64).alias("mask"))


@register("string_date_range", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1996-08-00' AND strftime(o_orderdate, '%Y-%m-%d') < '1997-01-00'")
def string_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open bounds that are no dates, so dates are compared as text."""
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").where((d >= "1996-08-00") & (d < "1997-01-00")).select("o_orderkey")


@register("prompt_length_filter", "SELECT item_id FROM eval_items WHERE len(string_split(question, ' ')) <= 60")
def prompt_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").where(F.size(F.split("question", " ", -1)) <= 60).select("item_id")


@register("sorted_categories", "SELECT list_sort(list(DISTINCT category)) AS categories FROM eval_items")
def sorted_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").agg(F.sort_array(F.collect_set("category")).alias("categories"))


@register("majority_category", "SELECT uid, arg_max(data_source, struct_pack(n := n, f := -f)) AS majority FROM (SELECT uid, data_source, count(*) AS n, min(row_idx) AS f FROM (SELECT row_idx, any_value(uid) AS uid, any_value(lower(data_source)) AS data_source FROM rollout GROUP BY row_idx) WHERE data_source IS NOT NULL GROUP BY uid, data_source) GROUP BY uid")
def majority_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority vote; of equal votes the one seen first."""
    r = table(spark, sf_dir, "rollout").groupBy("row_idx").agg(F.first("uid").alias("uid"), F.lower(F.first("data_source")).alias("data_source")).where("data_source is not null")
    v = r.groupBy("uid", "data_source").agg(F.count("*").alias("n"), F.min("row_idx").alias("f"))
    return v.groupBy("uid").agg(F.max_by("data_source", F.struct("n", -F.col("f"))).alias("majority"))


@register("metrics_long", "SELECT result_id, k AS name, round(v, 6) AS value FROM (SELECT result_id, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS v FROM (SELECT result_id, any_value(metrics) AS m FROM eval_results GROUP BY result_id))")
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "eval_results").select("result_id", F.map_entries("metrics").alias("m")).groupBy("result_id").agg(F.first("m").alias("m"))
    return e.select("result_id", F.explode("m").alias("e")).select("result_id", F.col("e.key").alias("name"), F.round("e.value", 6).alias("value"))


_METRIC_NAMES = ["mean@8", "std@8", "best@8/mean", "best@4/mean", "worst@8/mean", "maj@8/mean", "best@8/std"]


@register("metric_sections", f"""SELECT var, metric, CASE WHEN var = 'acc' AND regexp_matches(metric, '^(mean|std|maj|best)') AND contains(metric, '@8/') THEN 'val-core' ELSE 'val-aux' END AS section FROM (SELECT DISTINCT unnest(map_keys(metrics)) AS var FROM eval_results), (SELECT unnest({_METRIC_NAMES}) AS metric)""")
def metric_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variable of the evaluations with every form of a metric."""
    v = table(spark, sf_dir, "eval_results").select(F.explode(F.map_keys("metrics")).alias("var")).distinct()
    m = v.select("var", F.explode(F.array(*map(F.lit, _METRIC_NAMES))).alias("metric"))
    return m.select("var", "metric", V.section(F.col("var"), F.col("metric"), F.lit("acc"), F.lit(8)).alias("section"))


@register(
    "expected_best_of_n",
    """WITH r AS (SELECT row_idx, any_value(coalesce(uid, '')) AS uid, any_value(coalesce(lower(data_source), '')) AS data_source, any_value(list_sum(token_level_scores)) AS score FROM rollout GROUP BY row_idx),
    k AS (SELECT data_source, uid, score, count(*) AS n FROM r WHERE score IS NOT NULL GROUP BY ALL), g AS (SELECT *, sum(n) OVER w AS upto, sum(n) OVER (PARTITION BY data_source, uid) AS total FROM k WINDOW w AS (PARTITION BY data_source, uid ORDER BY score)),
    s AS (SELECT *, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768], lambda x: x < total), total)) AS size FROM g WHERE total > 1),
    p AS (SELECT data_source, uid, size, sum(score * ((upto / total) ** size - ((upto - n) / total) ** size)) AS best, sum(score * ((1 - (upto - n) / total) ** size - (1 - upto / total) ** size)) AS worst FROM s GROUP BY ALL)
    SELECT data_source, CAST(size AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS prompts, round(avg(best), 6) AS best, round(avg(worst), 6) AS worst FROM p GROUP BY ALL""",
)
def expected_best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact expectations of the best and worst of n runs drawn with replacement, over all runs of each prompt."""
    from millrace.plans.groups import scored

    r = scored(spark, sf_dir).select(F.coalesce("data_source", F.lit("")).alias("data_source"), F.coalesce("uid", F.lit("")).alias("uid"), "score")
    out = V.expected_extremes(r, ["data_source", "uid"], "score").groupBy("data_source", "size").agg(F.count("*").alias("prompts"), F.avg("best").alias("best"), F.avg("worst").alias("worst"))
    return out.select("data_source", "size", "prompts", F.round("best", 6).alias("best"), F.round("worst", 6).alias("worst"))


@register("best_of_n")
def best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled best, worst and majority over all runs of each prompt, meaned by source. A random generator's draws are no
    SQL; tests hold it against the exact expectation."""
    from millrace.plans.groups import scored

    r = scored(spark, sf_dir).where("score is not null").withColumn("var", F.lit("acc")).withColumn("pred", F.round("score", 1).cast("string"))
    r = r.select(F.coalesce("data_source", F.lit("")).alias("data_source"), F.coalesce("uid", F.lit("")).alias("uid"), "var", "row_idx", "score", "pred")
    metrics = V.best_of(r, "data_source", "uid", "var", "score", "row_idx", "pred")
    return V.by_source(metrics, "data_source", "var")
