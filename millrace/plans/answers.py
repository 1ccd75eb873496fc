"""Queries on final answers and scores, over visible responses joined with what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.operators import scoring as S
from millrace.plans.catalogue import register
from millrace.session import table

#: Texts with answers: the last message of each chat, once each.
LAST_SQL = "l AS (SELECT result_id, any_value(convo[len(convo)].content) AS text FROM eval_results GROUP BY result_id)"


def last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "eval_results").where("size(convo) > 0").select("result_id", F.element_at("convo", -1)["content"].alias("text"))
    return e.groupBy("result_id").agg(F.first("text").alias("text"))


@register("hash_answers", f"WITH {LAST_SQL} SELECT result_id, nullif(regexp_replace(regexp_extract(text, '#### (\\-?[0-9\\.\\,]+)', 1), '[,$]', '', 'g'), '') AS answer FROM l")
def hash_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_messages(spark, sf_dir).select("result_id", A.hash_answer("text").alias("answer"))


@register(
    "last_numbers",
    f"""WITH {LAST_SQL}, f AS (SELECT result_id, regexp_extract_all(text, '(\\-?[0-9\\.\\,]+)', 1) AS a FROM l)
    SELECT result_id, coalesce(list_filter(a, lambda x: x <> '' AND x <> '.')[-1], a[1]) AS answer FROM f""",
)
def last_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_messages(spark, sf_dir).select("result_id", A.last_number("text").alias("answer"))


@register("boxed_answers", f"WITH {LAST_SQL} SELECT result_id, regexp_extract_all(text, '\\\\boxed\\{{([^{{}}]*)\\}}', 1)[-1] AS answer FROM l")
def boxed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No box of the table has inner braces, so SQL can say it; deeper ones are tested apart."""
    return last_messages(spark, sf_dir).select("result_id", A.box_column("text").alias("answer"))


@register("choice_letters", f"WITH {LAST_SQL} SELECT result_id, nullif(regexp_extract(text, '(?i)Answer[ \\t]*:[ \\t]*\\$?([A-D])\\$?', 1), '') AS letter, list_filter(['A','B','C','D','E','F','G','H','I','J'], lambda x: contains(text, x))[1] AS contained FROM l")
def choice_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_messages(spark, sf_dir).select("result_id", A.choice_letter("text").alias("letter"), A.contained_letter("text").alias("contained"))


@register("stated_answers", f"WITH {LAST_SQL} SELECT result_id, coalesce(regexp_extract_all(text, '(?i)Answer\\s*:\\s*([^\\n]+)', 1)[-1], '[INVALID]') AS answer FROM l")
def stated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_messages(spark, sf_dir).select("result_id", A.stated_answer("text").alias("answer"))


@register("code_blocks", f"WITH {LAST_SQL} SELECT result_id, string_split(string_split(text, '```')[2], '```')[1] AS block FROM l WHERE contains(text, '```')")
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = last_messages(spark, sf_dir).where(F.contains("text", F.lit("```")))
    return m.select("result_id", F.substring_index(F.substring_index(F.concat(F.lit(""), "text"), "```", 2), "```", -1).alias("block"))


@register(
    "loose_equality",
    """WITH r AS (SELECT DISTINCT uid, reward_model.ground_truth AS a, extra_info.answer AS b FROM rl_rows)
    SELECT uid, coalesce(a = b OR (regexp_matches(a, '^\\s*[-+]?(\\d+\\.?\\d*|\\.\\d+)$') AND regexp_matches(b, '^\\s*[-+]?(\\d+\\.?\\d*|\\.\\d+)$') AND TRY_CAST(a AS DOUBLE) = TRY_CAST(b AS DOUBLE)), false) AS same FROM r""",
)
def loose_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "rl_rows").select("uid", F.col("reward_model.ground_truth").alias("a"), F.col("extra_info.answer").alias("b")).distinct()
    return r.select("uid", A.loosely_equal("a", "b").alias("same"))


@register("minerva_spelling", f"WITH {LAST_SQL}, s AS (SELECT result_id, coalesce(regexp_extract_all(text, '(?i)Answer\\s*:\\s*([^\\n]+)', 1)[-1], '[INVALID]') AS given FROM l) SELECT result_id, {A.minerva_sql('given')} AS answer FROM s")
def minerva_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_messages(spark, sf_dir).select("result_id", A.minerva(A.stated_answer("text")).alias("answer"))


@register("box_spelling")
def box_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in one spelling, by ordered rewriting; tests hold it."""
    return last_messages(spark, sf_dir).select("result_id", A.normalised_column(A.box_column("text")).alias("box"))


@register(
    "number_scores",
    f"""WITH {LAST_SQL}, e AS (SELECT result_id, any_value(lower(eval_name)) AS eval_name FROM eval_results GROUP BY result_id), a AS (SELECT l.result_id, eval_name, nullif(regexp_replace(regexp_extract(text, '#### (\\-?[0-9\\.\\,]+)', 1), '[,$]', '', 'g'), '') AS given,
    list_filter(regexp_extract_all(text, '(\\-?[0-9\\.\\,]+)', 1), lambda x: x <> '' AND x <> '.')[-1] AS last FROM l JOIN e USING (result_id))
    SELECT result_id, CASE WHEN given IS NULL THEN 0.0::DOUBLE WHEN given = last THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS score FROM a""",
)
def number_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer behind '####' against the last number of the text."""
    return last_messages(spark, sf_dir).select("result_id", S.number_match(F.col("text"), A.last_number("text"), "strict", 0.1).alias("score"))


_LAST_NUMBER_SQL = "coalesce(list_filter(regexp_extract_all(text, '(\\-?[0-9\\.\\,]+)', 1), lambda x: x <> '' AND x <> '.')[-1], regexp_extract_all(text, '(\\-?[0-9\\.\\,]+)', 1)[1])"


@register(
    "dispatched_scores",
    f"""WITH {LAST_SQL}, e AS (SELECT result_id, any_value(lower(eval_name)) AS eval_name FROM eval_results GROUP BY result_id), a AS (SELECT l.result_id, eval_name, text, {_LAST_NUMBER_SQL} AS want, nullif(regexp_replace(regexp_extract(text, '#### (\\-?[0-9\\.\\,]+)', 1), '[,$]', '', 'g'), '') AS hashed,
    nullif(regexp_extract(text, '(?i)Answer[ \\t]*:[ \\t]*\\$?([A-D])\\$?', 1), '') AS letter, coalesce(regexp_extract_all(right(text, 300), '(?i)Answer\\s*:\\s*([^\\n]+)', 1)[-1], '[INVALID]') AS stated, regexp_extract_all(right(text, 100), '\\\\boxed\\{{([^{{}}]*)\\}}', 1)[-1] AS box FROM l JOIN e USING (result_id)), m AS (SELECT *, {A.minerva_sql('stated')} AS stated_m, {A.minerva_sql('want')} AS want_m FROM a)
    SELECT result_id, eval_name, CAST(CASE eval_name WHEN 'mc_general' THEN CASE WHEN letter = want THEN 1 ELSE 0 END WHEN 'code_exec' THEN CASE WHEN hashed = want THEN 1 ELSE 0 END WHEN 'theorem_short' THEN CASE WHEN stated_m = want_m THEN 1 ELSE -1 END ELSE CASE WHEN box = want THEN 1 ELSE -1 END END AS DOUBLE) AS score FROM m""",
)
def dispatched_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row by its source's rule, against the row's own last number."""
    rules = {"mc_general": S.letter_match, "code_exec": S.number_match, "theorem_short": S.stated_match}
    return _dispatched(spark, sf_dir, rules)


@register("dispatched_boxes")
def dispatched_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one source are compared in one spelling, which is no SQL."""
    return _dispatched(spark, sf_dir, {"math_final": S.box_match})


def _dispatched(spark: SparkSession, sf_dir: str, rules: dict[str, S.Rule]) -> DataFrame:
    names = table(spark, sf_dir, "eval_results").groupBy("result_id").agg(F.lower(F.first("eval_name")).alias("eval_name"))
    m = last_messages(spark, sf_dir).join(names, "result_id")
    return m.select("result_id", "eval_name", S.dispatch(F.col("eval_name"), F.col("text"), A.last_number("text"), rules, S.strict_box_match).alias("score"))


@register(
    "judged_rewards",
    """WITH d AS (SELECT row_idx, any_value(list_sum(list_slice(attention_mask, 81, 240))) AS n, any_value(list_sum(token_level_scores)) AS s FROM rollout GROUP BY row_idx)
    SELECT row_idx, round(CAST(CASE WHEN s IS NULL THEN -0.5 WHEN s > 0.5 THEN 1.0 - 0.05 * least(abs(n - 60), 10) ELSE 0.0 END AS DOUBLE), 6) AS reward FROM d""",
)
def judged_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reward by a judge's text, lengths for token counts and the rule score for the judge."""
    from millrace.plans.groups import scored

    r = scored(spark, sf_dir)
    solution = F.when(F.col("score").isNotNull(), F.lit("s"))
    judge = F.when(F.col("score") > 0.5, "Final Decision: Yes").otherwise("Final Decision: No")
    return r.select("row_idx", F.round(S.judged_reward(solution, judge, F.col("len"), F.lit(60)), 6).alias("reward"))


@register("test_fractions", "SELECT user_id, round(CASE WHEN bool_and(value > 0) THEN 1.0 ELSE count(*) FILTER (k <= 10 AND value > 0) / count(*) FILTER (k <= 10) END, 6) AS score FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) GROUP BY user_id")
def test_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the first ten passed tests of each program, events standing for tests."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"] > 0).alias("passed"))
    return e.select("user_id", F.round(S.tests_match(F.col("passed"), True), 6).alias("score"))


test_fractions.__test__ = False  # not a test


@register("shown_examples", "SELECT result_id FROM (SELECT result_id, row_number() OVER (PARTITION BY eval_name ORDER BY result_id) AS k FROM (SELECT result_id, any_value(lower(eval_name)) AS eval_name FROM eval_results GROUP BY result_id)) WHERE k <= 3")
def shown_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "eval_results").groupBy("result_id").agg(F.lower(F.first("eval_name")).alias("eval_name"))
    return S.shown_examples(e, "eval_name", "result_id", 3).select("result_id")


@register("prefix_rewards", "SELECT uid, round(CASE WHEN n = 0 THEN 0 ELSE n / (length(b) + 1) END, 6) AS reward FROM (SELECT uid, b, list_max(list_transform(range(0, least(length(a), length(b)) + 1), lambda i: CASE WHEN a[1:i] = b[1:i] THEN i ELSE 0 END)) AS n FROM (SELECT DISTINCT uid, reward_model.ground_truth AS a, extra_info.answer AS b FROM rl_rows) WHERE a IS NOT NULL AND b IS NOT NULL)")
def prefix_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense reward of a response that begins as the truth does."""
    from millrace.functions.sequences import common_prefix

    r = table(spark, sf_dir, "rl_rows").select("uid", F.col("reward_model.ground_truth").alias("a"), F.col("extra_info.answer").alias("b")).distinct().where("a is not null and b is not null")
    n = common_prefix(F.col("a"), F.col("b"))
    return r.select("uid", F.round(n / (F.length("b") + 1), 6).alias("reward"))


@register(
    "benchmark_scores",
    f"""WITH {LAST_SQL}, e AS (SELECT result_id, any_value(lower(eval_name)) AS eval_name FROM eval_results GROUP BY result_id), a AS (SELECT eval_name, text, regexp_extract_all(text, '\\\\boxed\\{{([^{{}}]*)\\}}', 1)[-1] AS given,
    coalesce(list_filter(regexp_extract_all(text, '(\\-?[0-9\\.\\,]+)', 1), lambda x: x <> '' AND x <> '.')[-1], regexp_extract_all(text, '(\\-?[0-9\\.\\,]+)', 1)[1]) AS want FROM l JOIN e USING (result_id))
    SELECT eval_name, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN given = want THEN 1.0 ELSE 0.0 END), 6) AS score, round(avg(length(text)), 6) AS chars FROM a GROUP BY eval_name""",
)
def benchmark_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameterised benchmark: boxes against each text's last number, by evaluation."""
    from millrace.operators import validation as V

    names = table(spark, sf_dir, "eval_results").groupBy("result_id").agg(F.lower(F.first("eval_name")).alias("eval_name"))
    m = last_messages(spark, sf_dir).join(names, "result_id").withColumn("want", A.last_number("text"))
    out = V.evaluate(m, "eval_name", "text", "want", A.box_column, lambda a, b: a == b)
    return out.select("eval_name", "n", F.round("score", 6).alias("score"), F.round("chars", 6).alias("chars"))
