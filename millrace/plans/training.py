"""Queries on assembled rows, logs, judge replies, preference losses and remaining set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.functions import sequences as Q
from millrace.functions import text as T
from millrace.operators import advantage as A
from millrace.operators import training as R
from millrace.plans.catalogue import register
from millrace.plans.groups import ROLLOUT_SQL, scored
from millrace.plans.tokens import TOKENS_SQL, once, rows
from millrace.session import table


@register(
    "assembled_rollouts",
    """WITH d AS (SELECT row_idx, any_value(prompts) AS p, any_value(responses) AS r, any_value(list_slice(attention_mask, 1, 80)) AS m FROM rollout GROUP BY row_idx), e AS (SELECT *, CASE WHEN list_position(r, 1) > 0 THEN list_position(r, 1) ELSE len(r) END AS k FROM d)
    SELECT row_idx, CAST(list_sum(p) + coalesce(list_sum(r), 0) AS BIGINT) AS ids, CAST(list_sum(m) + k AS BIGINT) AS attended, CAST(greatest(list_sum(m) - 1, 0) + len(r) AS BIGINT) AS last_position FROM e WHERE p IS NOT NULL AND r IS NOT NULL""",
)
def assembled_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows put together again from prompts and responses, shown as sums."""
    d = table(spark, sf_dir, "rollout").select("row_idx", "prompts", "responses", F.slice("attention_mask", 1, 80).alias("pm")).where("prompts is not null and responses is not null")
    full = R.rollout_rows(d, "prompts", "responses", "pm", 1)
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return once(full.select("row_idx", add("input_ids").alias("ids"), add("attention_mask").alias("attended"), F.element_at("position_ids", -1).alias("last_position")))


@register(
    "judge_replies",
    """WITH j AS (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS t FROM documents WHERE source = 'judge_reply' AND text IS NOT NULL), b AS (SELECT doc_id, nullif(regexp_extract(t, '(?s)```(?:json)?\\s*\\n?(.*?)```', 1), '') AS fenced, regexp_extract(t, '(\\{[^{}]*\\})', 1) AS free FROM j),
    o AS (SELECT doc_id, CASE WHEN starts_with(trim(fenced, ' ' || chr(10) || chr(9)), '{') THEN fenced ELSE free END AS o FROM b)
    SELECT doc_id, round(CAST(json_extract_string(o, '$.complexity_score') AS DOUBLE), 6) AS complexity, CAST(json_extract_string(o, '$.is_suitable') AS BOOLEAN) AS suitable FROM o WHERE json_valid(o) AND json_extract_string(o, '$.complexity_score') IS NOT NULL""",
)
def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of judges' replies, in a fenced block or else the first whose braces balance; replies whose object doesn't
    parse, or lacks the score that it must have, are left out."""
    d = table(spark, sf_dir, "documents").where("source = 'judge_reply'").select("doc_id", C.object_column(T.unix_lines("text")).alias("o"))
    p = F.from_json("o", "complexity_score double, is_suitable boolean, rejection_reason string")
    return d.select("doc_id", p.alias("p")).where("p.complexity_score is not null").select("doc_id", F.round("p.complexity_score", 6).alias("complexity"), F.col("p.is_suitable").alias("suitable"))


@register(
    "log_rewards",
    """WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents WHERE source = 'train_log')
    SELECT doc_id, CAST(count(*) AS BIGINT) AS steps, round(max(CAST(regexp_extract(line, 'critic/score/mean:(-?[0-9.]+)', 1) AS DOUBLE)), 6) AS best FROM l WHERE regexp_matches(line, '^step:[0-9]+ - .*critic/score/mean:-?[0-9]+\\.[0-9]+') GROUP BY doc_id""",
)
def log_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps and best score of each training log."""
    d = table(spark, sf_dir, "documents").where("source = 'train_log'").select("doc_id", F.explode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1)).alias("line"))
    d = d.where(F.col("line").rlike("^step:[0-9]+ - .*critic/score/mean:-?[0-9]+\\.[0-9]+"))
    return d.groupBy("doc_id").agg(F.count("*").alias("steps"), F.round(F.max(F.regexp_extract("line", "critic/score/mean:(-?[0-9.]+)", 1).cast("double")), 6).alias("best"))


@register(
    "preference_cross_entropy",
    f"""WITH {TOKENS_SQL}, s AS (SELECT row_idx, sum((o - f) * m) AS x FROM t WHERE o IS NOT NULL AND f IS NOT NULL GROUP BY row_idx), {ROLLOUT_SQL}
    SELECT round(avg(greatest(x * 0.05, 0) - x * 0.05 * a + ln(1 + exp(-abs(x * 0.05)))), 6) AS loss, round(avg(CASE WHEN (x > 0) = (a > 0.5) THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM (SELECT x, CASE WHEN score > 0.5 THEN 1.0 ELSE 0.0 END AS a FROM s JOIN r USING (row_idx) WHERE score IS NOT NULL)""",
)
def preference_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir, "old_log_probs", "ref_log_prob", "token_level_scores").where("old_log_probs is not null and ref_log_prob is not null and token_level_scores is not null")
    x = Q.masked_sum(Q.divergence("old_log_probs", "ref_log_prob", "kl"), "mask")
    a = F.when(Q.total("token_level_scores") > 0.5, 1.0).otherwise(0.0)
    s = once(r.select("row_idx", x.alias("x"), a.alias("a")))
    return s.agg(F.round(F.avg(R.cross_entropy(F.col("x"), F.col("a"), 0.05)), 6).alias("loss"), F.round(F.avg(R.sided_accuracy(F.col("x"), F.col("a"))), 6).alias("agreement"))


@register(
    "largest_return",
    f"WITH {TOKENS_SQL} SELECT round(max(abs(ret)), 6) AS largest FROM (SELECT sum(r) OVER (PARTITION BY row_idx ORDER BY pos DESC) AS ret FROM t WHERE r IS NOT NULL)",
)
def largest_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir, "token_level_scores")
    from millrace.functions import ragged

    back = ragged.fold(lambda x: abs(ragged.reverse_cumsum(x)), "token_level_scores")
    return r.agg(F.round(F.max(F.array_max(back)), 6).alias("largest"))


@register(
    "weighted_leave_one_out",
    f"""WITH {TOKENS_SQL}, m AS (SELECT row_idx, sum(v * m) / (sum(m) + 1e-8) AS own FROM t WHERE v IS NOT NULL GROUP BY row_idx), g AS (SELECT row_idx // 4 AS g, sum(own) AS s, count(*) AS n FROM m GROUP BY 1)
    SELECT row_idx, round(0.7 * (own - coalesce((s - own) / nullif(n - 1, 0), 0)), 6) AS advantage FROM m JOIN g ON row_idx // 4 = g""",
)
def weighted_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir, "critic_values").where("critic_values is not null")
    r = once(r.select("row_idx", Q.masked_mean("critic_values", "mask").alias("own")))
    return A.weighted_rloo(r, "row_idx", 4, {"own": 0.7}).select("row_idx", F.round("advantage", 6).alias("advantage"))


@register("preference_rows", "SELECT uid, 0 AS place, extra_info.answer AS response FROM (SELECT DISTINCT uid, extra_info, reward_model FROM rl_rows) UNION ALL SELECT uid, 1, reward_model.ground_truth FROM (SELECT DISTINCT uid, extra_info, reward_model FROM rl_rows)")
def preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "rl_rows").select("uid", "extra_info", "reward_model").distinct().select("uid", F.lit("").alias("prompt"), F.col("extra_info.answer").alias("chosen"), F.col("reward_model.ground_truth").alias("rejected"))
    return R.preference_rows(r, "prompt", "chosen", "rejected").select("uid", "place", "response")


@register("replicated_rows", "SELECT s_suppkey, CAST(k AS INTEGER) AS rank FROM supplier, (SELECT unnest(range(2)) AS k)")
def replicated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.to_all(table(spark, sf_dir, "supplier").select("s_suppkey"), 2)


@register("worker_results", "SELECT s_suppkey, round(s_acctbal * 2, 2) AS twice, (row_number() OVER (ORDER BY s_suppkey) - 1) // (SELECT count(*) // 5 FROM supplier) AS chunk_id FROM supplier")
def worker_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators import frame

    s = frame.positions(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")
    out = R.on_workers(s, lambda p: p.assign(twice=p.s_acctbal * 2)[["s_suppkey", "twice"]], 5, "row_idx", "s_suppkey long, twice double")
    return out.select("s_suppkey", F.round("twice", 2).alias("twice"), "chunk_id")


@register("hash_sample", "SELECT item_id FROM eval_items ORDER BY md5('42:' || item_id), item_id LIMIT 50")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 50 items without replacement, the same each time: the feature is a sample, so the limit stays."""
    return table(spark, sf_dir, "eval_items").orderBy(F.md5(F.concat(F.lit("42:"), "item_id")), "item_id").limit(50).select("item_id")


@register("common_sources", "SELECT DISTINCT lower(data_source) AS data_source FROM rollout WHERE lower(data_source) IN (SELECT data_source FROM token_budgets)")
def common_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "rollout").select(F.lower("data_source").alias("data_source"))
    return a.intersect(table(spark, sf_dir, "token_budgets").select("data_source"))


@register("sft_loss_tokens", "SELECT row_idx, CAST(p + n - CASE WHEN p > 1 THEN p - 1 ELSE 0 END - CASE WHEN n > 0 OR p > 0 THEN 1 ELSE 0 END AS INTEGER) AS tokens FROM (SELECT row_idx, any_value(list_sum(list_slice(attention_mask, 1, 80))) AS p, any_value(list_sum(list_slice(attention_mask, 81, 240))) AS n FROM rollout GROUP BY row_idx) WHERE n > 0 AND p > 0")
def sft_loss_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that count in supervised training: prompt then response without padding, masked by rule."""
    r = table(spark, sf_dir, "rollout").select("row_idx", Q.total(F.slice("attention_mask", 1, 80)).cast("int").alias("p"), Q.total(F.slice("attention_mask", 81, 160)).cast("int").alias("n")).dropDuplicates(["row_idx"]).where("n > 0 and p > 0")
    ones = F.array_repeat(F.lit(1), F.col("p") + F.col("n"))
    return r.withColumn("att", ones).select("row_idx", F.aggregate(Q.sft_mask("att", F.col("p"), F.col("n")), F.lit(0), lambda a, x: a + x).alias("tokens"))


@register(
    "sequence_bounds",
    f"""WITH {ROLLOUT_SQL} SELECT row_idx, uid, CAST(coalesce(sum(len) OVER (PARTITION BY uid ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins,
    CAST(coalesce(sum(len) OVER (PARTITION BY uid ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS ends FROM r""",
)
def sequence_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sequence begins and ends when those of its uid are packed one after another; those of no uid are packed
    together. Totals of ranges first, then within each range, so that a hot uid is no single task."""
    return R.packed(scored(spark, sf_dir), "uid", "row_idx", "len").select("row_idx", "uid", "begins", "ends")
