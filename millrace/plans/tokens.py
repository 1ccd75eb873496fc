"""Queries on token sequences: returns, divergences, losses, masks, padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import ragged
from millrace.functions import sequences as Q
from millrace.operators import advantage as A
from millrace.plans.catalogue import register
from millrace.session import table

GAMMA, LAMBDA, BETA = 0.99, 0.95, 0.05
_ARRAYS = ("responses", "attention_mask", "position_ids", "token_level_scores", "old_log_probs", "ref_log_prob", "critic_values")

#: One row per rollout and token, from 0; arrays that are null have null tokens.
TOKENS_SQL = """d AS (SELECT row_idx, any_value(token_level_scores) AS s, any_value(old_log_probs) AS o, any_value(ref_log_prob) AS f, any_value(critic_values) AS v, any_value(list_slice(attention_mask, 81, 240)) AS m FROM rollout GROUP BY row_idx),
t AS (SELECT row_idx, i - 1 AS pos, CAST(s[i] AS DOUBLE) AS r, CAST(o[i] AS DOUBLE) AS o, CAST(f[i] AS DOUBLE) AS f, CAST(v[i] AS DOUBLE) AS v, CAST(m[i] AS DOUBLE) AS m FROM d, (SELECT unnest(range(1, 161)) AS i))"""


def rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Rollouts with `mask`, the response's part of the attention mask. Rows may repeat: what is computed from them is cut
    to `once`, so that results are shuffled and not the arrays they come from."""
    return table(spark, sf_dir, "rollout").select("row_idx", *columns, Q.response_mask("attention_mask", "responses").alias("mask"))


def once(df: DataFrame) -> DataFrame:
    """Each row_idx once; copies of a rollout are equal, and so is what comes of them."""
    return df.dropDuplicates(["row_idx"])


def per_token(df: DataFrame, value: str, digits: int = 6) -> DataFrame:
    return once(df.where(F.col(value).isNotNull()).select("row_idx", value)).select("row_idx", F.posexplode(value).alias("pos", "_v")).select("row_idx", F.col("pos").cast("long").alias("pos"), F.round("_v", digits).alias(value))


@register(
    "returns_reverse_cumsum",
    f"WITH {TOKENS_SQL} SELECT row_idx, pos, round(sum(r * m) OVER (PARTITION BY row_idx ORDER BY pos DESC), 6) AS returns FROM t WHERE r IS NOT NULL",
)
def returns_reverse_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir, "token_level_scores")
    return per_token(r.withColumn("returns", A.remax_returns("token_level_scores", "mask")), "returns")


@register(
    "discounted_return",
    f"WITH {TOKENS_SQL} SELECT row_idx, pos, round(sum(r * {GAMMA} ** pos) OVER (PARTITION BY row_idx ORDER BY pos DESC) / {GAMMA} ** pos + 1e-9, 4) AS returns FROM t WHERE r IS NOT NULL",
)
def discounted_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without cutting at the mask, so that SQL can say the same; the cut is tested on small batches."""
    r = rows(spark, sf_dir, "token_level_scores")
    return per_token(r.withColumn("returns", F.transform(ragged.fold(lambda x: ragged.discounted(x, GAMMA), "token_level_scores"), lambda x: x + 1e-9)), "returns", 4)


@register(
    "general_advantage",
    f"""WITH {TOKENS_SQL}, d2 AS (SELECT row_idx, pos, r + {GAMMA} * coalesce(lead(v) OVER (PARTITION BY row_idx ORDER BY pos), 0) - v AS delta FROM t WHERE r IS NOT NULL AND v IS NOT NULL)
    SELECT row_idx, pos, round(sum(delta * {GAMMA * LAMBDA} ** pos) OVER (PARTITION BY row_idx ORDER BY pos DESC) / {GAMMA * LAMBDA} ** pos + 1e-9, 4) AS advantages FROM d2""",
)
def general_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir, "token_level_scores", "critic_values")
    return per_token(r.withColumn("advantages", F.transform(A.general_advantage("token_level_scores", "critic_values", GAMMA, LAMBDA), lambda x: x + 1e-9)), "advantages", 4)


@register(
    "divergence_estimators",
    f"""WITH {TOKENS_SQL}, k AS (SELECT row_idx, m, o - f AS d FROM t WHERE o IS NOT NULL AND f IS NOT NULL)
    SELECT row_idx, round(sum(d * m) / (sum(m) + 1e-8), 6) AS kl, round(sum(abs(d) * m) / (sum(m) + 1e-8), 6) AS abs, round(sum(0.5 * d * d * m) / (sum(m) + 1e-8), 6) AS mse,
    round(sum(greatest(least(exp(-d) + d - 1, 10), -10) * m) / (sum(m) + 1e-8), 6) AS low_var_kl FROM k GROUP BY row_idx""",
)
def divergence_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir, "old_log_probs", "ref_log_prob").where("old_log_probs is not null and ref_log_prob is not null")
    return once(r.select("row_idx", *[F.round(Q.masked_mean(Q.divergence("old_log_probs", "ref_log_prob", k), "mask"), 6).alias(k) for k in ("kl", "abs", "mse", "low_var_kl")]))


@register(
    "penalised_rewards",
    f"""WITH {TOKENS_SQL} SELECT row_idx, round(sum(r - {BETA} * (o - f) * m), 6) AS reward, round(sum((o - f) * m) / (sum(m) + 1e-8), 6) AS kl
    FROM t WHERE r IS NOT NULL AND o IS NOT NULL AND f IS NOT NULL GROUP BY row_idx""",
)
def penalised_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir, "token_level_scores", "old_log_probs", "ref_log_prob").where("token_level_scores is not null and old_log_probs is not null and ref_log_prob is not null")
    kl = Q.divergence("old_log_probs", "ref_log_prob", "kl")
    return once(r.select("row_idx", F.round(Q.total(Q.penalised("token_level_scores", kl, "mask", BETA)), 6).alias("reward"), F.round(Q.masked_mean(kl, "mask"), 6).alias("kl")))


@register(
    "masked_statistics",
    f"""WITH {TOKENS_SQL}, s AS (SELECT row_idx, sum(v * m) AS total, sum(v * m) / (sum(m) + 1e-8) AS mean, sum(m) AS n FROM t WHERE v IS NOT NULL GROUP BY row_idx),
    q AS (SELECT t.row_idx, sum((v - mean) ** 2 * m) / (any_value(n) + 1e-8) AS var FROM t JOIN s USING (row_idx) GROUP BY t.row_idx)
    SELECT row_idx, round(total, 6) AS total, round(mean, 6) AS mean, CASE WHEN n > 1 THEN round(var * n / (n - 1), 6) END AS var FROM s JOIN q USING (row_idx)""",
)
def masked_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir, "critic_values").where("critic_values is not null")
    return once(r.select("row_idx", F.round(Q.masked_sum("critic_values", "mask"), 6).alias("total"), F.round(Q.masked_mean("critic_values", "mask"), 6).alias("mean"), F.round(Q.masked_var("critic_values", "mask"), 6).alias("var")))


@register(
    "policy_loss",
    f"""WITH {TOKENS_SQL}, x AS (SELECT m, o - f AS d, coalesce(r, 0) - 0.1 AS a FROM t WHERE o IS NOT NULL AND f IS NOT NULL AND r IS NOT NULL),
    y AS (SELECT m, d, a, -a * exp(d) AS free, -a * greatest(least(exp(d), 1.2), 0.8) AS bound FROM x),
    z AS (SELECT m, d, free, bound, greatest(free, bound) AS up, -a * 3.0 AS floor, a FROM y)
    SELECT round(sum(CASE WHEN a < 0 THEN least(up, floor) ELSE up END * m) / (sum(m) + 1e-8), 6) AS loss, round(sum(CASE WHEN bound > free THEN m ELSE 0 END) / (sum(m) + 1e-8), 6) AS clip_fraction,
    round(sum(CASE WHEN up > floor AND a < 0 THEN m ELSE 0 END) / (sum(m) + 1e-8), 6) AS clip_fraction_low, round(sum(-d * m) / (sum(m) + 1e-8), 6) AS kl FROM z""",
)
def policy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped policy loss with the policy's log-probabilities against the reference's, mean over all masked tokens."""
    r = rows(spark, sf_dir, "token_level_scores", "old_log_probs", "ref_log_prob").where("token_level_scores is not null and old_log_probs is not null and ref_log_prob is not null")
    names = ("loss", "clipped", "clipped_low", "kl")
    sums = once(r.select("row_idx", Q.policy_sums("old_log_probs", "ref_log_prob", F.transform("token_level_scores", lambda s: s - 0.1), "mask", 0.2).alias("s"))).select("s.*")
    total = sums.agg(*[(F.sum(c) / (F.sum("n") + 1e-8)).alias(c) for c in names])
    return total.select(F.round("loss", 6).alias("loss"), F.round("clipped", 6).alias("clip_fraction"), F.round("clipped_low", 6).alias("clip_fraction_low"), F.round("kl", 6).alias("kl"))


@register(
    "value_loss",
    f"""WITH {TOKENS_SQL}, x AS (SELECT m, v, v * 0.9 AS o, r AS ret FROM t WHERE v IS NOT NULL AND r IS NOT NULL), y AS (SELECT m, (v - ret) ** 2 AS a, (greatest(least(v, o + 0.05), o - 0.05) - ret) ** 2 AS b FROM x)
    SELECT round(sum(0.5 * greatest(a, b) * m) / (sum(m) + 1e-8), 6) AS loss, round(sum(CASE WHEN b > a THEN m ELSE 0 END) / (sum(m) + 1e-8), 6) AS clip_fraction FROM y""",
)
def value_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir, "token_level_scores", "critic_values").where("token_level_scores is not null and critic_values is not null")
    r = r.withColumn("terms", Q.value_terms("critic_values", F.transform("critic_values", lambda v: v * 0.9), "token_level_scores", 0.05))
    sums = once(r.select("row_idx", *[Q.masked_sum(F.col(f"terms.{c}"), "mask").alias(c) for c in ("loss", "clipped")], Q.total("mask").alias("n")))
    return sums.agg(F.round(F.sum("loss") / (F.sum("n") + 1e-8), 6).alias("loss"), F.round(F.sum("clipped") / (F.sum("n") + 1e-8), 6).alias("clip_fraction"))


@register(
    "loss_aggregation",
    f"""WITH {TOKENS_SQL}, s AS (SELECT row_idx, sum(o * m) AS total, sum(m) AS n FROM t WHERE o IS NOT NULL GROUP BY row_idx)
    SELECT round(sum(total) / (sum(n) + 1e-8), 6) AS token_mean, round(avg(total), 6) AS seq_mean_token_sum, round(avg(total / CASE WHEN n > 0 THEN n END), 6) AS seq_mean_token_mean FROM s""",
)
def loss_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three ways to a scalar loss. Rows without a masked token have no mean and are left out of the last."""
    s = once(rows(spark, sf_dir, "old_log_probs").where("old_log_probs is not null").select("row_idx", Q.masked_sum("old_log_probs", "mask").alias("total"), Q.total("mask").alias("n")))
    return s.agg(F.round(F.sum("total") / (F.sum("n") + 1e-8), 6).alias("token_mean"), F.round(F.avg("total"), 6).alias("seq_mean_token_sum"), F.round(F.avg(F.col("total") / F.nullif("n", F.lit(0.0))), 6).alias("seq_mean_token_mean"))


@register(
    "position_ids",
    """WITH d AS (SELECT row_idx, any_value(attention_mask) AS m, any_value(position_ids) AS p FROM rollout GROUP BY row_idx)
    SELECT row_idx, list_transform(range(1, 241), lambda i: CAST(greatest(list_sum(list_slice(m, 1, i)) - 1, 0) AS BIGINT)) AS positions FROM d""",
)
def position_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions from the attention mask, folded over whole batches."""
    r = once(table(spark, sf_dir, "rollout").select("row_idx", "attention_mask"))
    import numpy as np

    running = ragged.fold(lambda m: np.maximum(np.cumsum(m, 1) - 1, 0), "attention_mask")
    return r.select("row_idx", running.cast("array<long>").alias("positions"))


@register(
    "end_mask",
    """WITH d AS (SELECT row_idx, any_value(responses) AS r FROM rollout GROUP BY row_idx)
    SELECT row_idx, CAST(CASE WHEN list_position(r, 1) > 0 THEN list_position(r, 1) ELSE len(r) END AS INTEGER) AS kept FROM d WHERE r IS NOT NULL""",
)
def end_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens up to and with the first end token."""
    r = table(spark, sf_dir, "rollout").select("row_idx", "responses").where("responses is not null")
    return once(r.select("row_idx", F.aggregate(Q.end_mask("responses", 1), F.lit(0), lambda a, x: a + x).alias("kept")))


@register(
    "unpadded_ids",
    """WITH d AS (SELECT row_idx, any_value(input_ids) AS i, any_value(attention_mask) AS m FROM rollout GROUP BY row_idx)
    SELECT row_idx, CAST(len(x) AS INTEGER) AS n, CAST(list_sum(x) AS BIGINT) AS checksum FROM (SELECT row_idx, list_transform(list_filter(list_zip(i, m), lambda p: p[2] = 1), lambda p: p[1]) AS x FROM d)""",
)
def unpadded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "rollout").select("row_idx", "input_ids", "attention_mask").select("row_idx", Q.unpad("input_ids", "attention_mask").alias("x"))
    return once(r.select("row_idx", F.size("x").alias("n"), F.when(F.size("x") > 0, F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v)).alias("checksum")))


@register(
    "left_stripped_prompts",
    """WITH d AS (SELECT row_idx, any_value(prompts) AS p FROM rollout GROUP BY row_idx), s AS (SELECT row_idx, p, list_position(list_transform(p, lambda x: x <> 0), true) AS k FROM d)
    SELECT row_idx, CASE WHEN k IS NULL OR k = 0 THEN [] ELSE list_slice(p, k, len(p)) END AS ids FROM s WHERE p IS NOT NULL""",
)
def left_stripped_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "rollout").select("row_idx", "prompts").where("prompts is not null")
    return once(p.select("row_idx", Q.strip_left("prompts", 0).alias("ids")))


@register(
    "padded_questions",
    """SELECT item_id, list_slice(list_concat(w, list_transform(range(40), lambda i: 0)), 1, greatest(40, len(w)))[1:40] AS ids
    FROM (SELECT item_id, list_transform(string_split(question, ' '), lambda s: CAST(length(s) AS BIGINT)) AS w FROM eval_items)""",
)
def padded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths as ids, padded on the right and cut to 40."""
    w = F.transform(F.split("question", " ", -1), lambda s: F.length(s).cast("long"))
    return table(spark, sf_dir, "eval_items").select("item_id", Q.truncate(Q.pad(w, 40, 0), 40).alias("ids"))


@register(
    "entropy_logprob",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label FROM embeddings), m AS (SELECT vec_id, e, label, list_max(e) AS top FROM e),
    z AS (SELECT vec_id, e, label, top, list_sum(list_transform(e, lambda x: exp(x - top))) AS z FROM m)
    SELECT vec_id, round(ln(z) + top - list_sum(list_transform(e, lambda x: x * exp(x - top))) / z, 6) AS entropy, round(e[label + 1] - top - ln(z), 6) AS logprob FROM z""",
)
def entropy_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(Q.entropy("embedding"), 6).alias("entropy"), F.round(Q.log_softmax_at("embedding", F.col("label")), 6).alias("logprob"))


@register(
    "placed_rewards",
    """WITH d AS (SELECT row_idx, any_value(list_sum(token_level_scores)) AS s, any_value(list_sum(list_slice(attention_mask, 81, 240))) AS n FROM rollout GROUP BY row_idx)
    SELECT row_idx, CAST(CASE WHEN n = 0 THEN 159 ELSE n - 1 END AS INTEGER) AS place, round(s, 6) AS reward FROM d WHERE s IS NOT NULL""",
)
def placed_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row's score on its last valid token, zeros elsewhere; shown as the place and the value there."""
    r = rows(spark, sf_dir, "token_level_scores").where("token_level_scores is not null")
    n = Q.total("mask").cast("int")
    placed = r.withColumn("placed", Q.place_at(Q.total("token_level_scores"), n - 1, 160)).withColumn("at", F.when(n == 0, 159).otherwise(n - 1))
    return once(placed.select("row_idx", F.col("at").alias("place"), F.round(F.get("placed", F.col("at")), 6).alias("reward")))


@register(
    "overlong_penalty",
    """WITH d AS (SELECT row_idx, any_value(list_sum(list_slice(attention_mask, 81, 240))) AS n FROM rollout GROUP BY row_idx)
    SELECT row_idx, round(least(-(n - (160 - 40)) / 40 * 1.0, 0), 6) AS penalty FROM d""",
)
def overlong_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear from 40 tokens before the limit of 160 on."""
    n = Q.total("mask")
    return once(rows(spark, sf_dir).select("row_idx", F.round(F.least(-(n - 120) / 40, F.lit(0.0)), 6).alias("penalty")))


@register(
    "masked_whitening",
    f"""WITH {TOKENS_SQL}, x AS (SELECT row_idx, sum(v * m) AS s, sum(m) AS n, sum(v * v * m) AS q FROM t WHERE v IS NOT NULL GROUP BY row_idx),
    g AS (SELECT sum(s) / (sum(n) + 1e-8) AS mean, sum(n) AS n FROM x), h AS (SELECT any_value(mean) AS mean, sum((v - mean) ** 2 * m) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM t, g WHERE v IS NOT NULL)
    SELECT row_idx, round((s - n * mean) / sqrt(var + 1e-8), 5) AS whitened FROM x, h""",
)
def masked_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whitened over all masked tokens of the table; shown as the sum over each row."""
    r = rows(spark, sf_dir, "critic_values").where("critic_values is not null")
    s = once(r.select("row_idx", Q.masked_sum("critic_values", "mask").alias("s"), Q.total("mask").alias("n"), Q.masked_sum(F.transform("critic_values", lambda v: v * v), "mask").alias("q")))
    # moments of each row add up, so no token is read twice; the scalars are subqueries, not joins
    total, n, squares = F.sum("s"), F.sum("n"), F.sum("q")
    mean = s.agg(total / (n + 1e-8)).scalar()
    var = s.agg((squares - 2 * mean * total + mean * mean * n) / (n + 1e-8) * n / (n - 1)).scalar()
    return s.select("row_idx", F.round((F.col("s") - F.col("n") * mean) / F.sqrt(var + 1e-8), 5).alias("whitened"))


_WHITE_SQL = """m AS (SELECT sum(a * m) / (sum(m) + 1e-8) AS mean, sum(m) AS n FROM x), v AS (SELECT any_value(mean) AS mean, sum((a - mean) ** 2 * m) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM x, m)"""


def _sums(df: DataFrame) -> DataFrame:
    """Sums over each row of advantages and returns under the mask, each row once."""
    s = once(df.select("row_idx", Q.masked_sum("advantages", "mask").alias("advantages"), Q.masked_sum("returns", "mask").alias("returns")))
    return s.select("row_idx", F.round("advantages", 4).alias("advantages"), F.round("returns", 4).alias("returns"))


@register(
    "remax_advantage",
    f"""WITH {TOKENS_SQL}, x AS (SELECT row_idx, m, sum(r * m) OVER (PARTITION BY row_idx ORDER BY pos DESC) AS ret FROM t WHERE r IS NOT NULL)
    SELECT row_idx, round(sum((ret - 0.25 * m) * m), 4) AS advantages, round(sum(ret * m), 4) AS returns FROM x GROUP BY row_idx""",
)
def remax_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns less a reference score, here one quarter for every row; shown as sums over the mask."""
    r = rows(spark, sf_dir, "token_level_scores").where("token_level_scores is not null").withColumn("reference", F.lit(0.25))
    return _sums(A.token_advantage(r, "remax", "token_level_scores", "mask", reference="reference"))


@register(
    "gae_advantage",
    f"""WITH {TOKENS_SQL}, d2 AS (SELECT row_idx, pos, v, m, r + {GAMMA} * coalesce(lead(v) OVER (PARTITION BY row_idx ORDER BY pos), 0) - v AS delta FROM t WHERE r IS NOT NULL AND v IS NOT NULL),
    x AS (SELECT row_idx, m, v AS val, sum(delta * {GAMMA * LAMBDA} ** pos) OVER (PARTITION BY row_idx ORDER BY pos DESC) / {GAMMA * LAMBDA} ** pos AS a FROM d2), {_WHITE_SQL}
    SELECT row_idx, round(sum((a - v.mean) / sqrt(v.var + 1e-8) * m) + 1e-9, 4) AS advantages, round(sum((a + val) * m) + 1e-9, 4) AS returns FROM x, v GROUP BY row_idx""",
)
def gae_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalised advantages whitened over all masked tokens, and their returns; shown as sums over the mask."""
    r = rows(spark, sf_dir, "token_level_scores", "critic_values").where("token_level_scores is not null and critic_values is not null")
    made = A.whiten_tokens(A.token_advantage(once(r), "gae", "token_level_scores", "mask", values="critic_values", gamma=GAMMA, lam=LAMBDA), "advantages", "mask")
    s = made.select("row_idx", Q.masked_sum("advantages", "mask").alias("a"), Q.masked_sum("returns", "mask").alias("r"))
    return s.select("row_idx", F.round(F.col("a") + 1e-9, 4).alias("advantages"), F.round(F.col("r") + 1e-9, 4).alias("returns"))


@register(
    "token_metrics",
    f"""WITH {TOKENS_SQL}, x AS (SELECT m, v, sum(r * m) OVER (PARTITION BY row_idx ORDER BY pos DESC) AS ret FROM t WHERE r IS NOT NULL AND v IS NOT NULL), k AS (SELECT *, ret - v AS a FROM x WHERE m = 1)
    SELECT round(avg(a), 6) AS advantage_mean, round(max(a), 6) AS advantage_max, round(min(a), 6) AS advantage_min, round(avg(ret), 6) AS return_mean, round(max(ret), 6) AS return_max, round(min(ret), 6) AS return_min, round(avg(v), 6) AS value_mean, round(max(v), 6) AS value_max, round(min(v), 6) AS value_min, round(1 - var_samp(ret - v) / (var_samp(ret) + 1e-5), 5) AS explained FROM k""",
)
def token_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advantages, returns and values over all valid tokens, and how much of the returns' variance the values explain. Each row
    gives its extremes and moments, so no token leaves its row."""
    r = rows(spark, sf_dir, "token_level_scores", "critic_values").where("token_level_scores is not null and critic_values is not null")
    r = r.withColumn("returns", A.remax_returns("token_level_scores", "mask"))
    valid = F.filter(F.arrays_zip(F.col("returns").alias("r"), F.col("critic_values").alias("v"), F.col("mask").alias("m")), lambda x: x["m"] == 1)
    zero = F.lit(0.0)
    start = F.struct(*[zero.alias(k) for k in ("n", "sr", "sv", "qr", "qa")])

    def step(a, x):  # noqa: ANN001, ANN202
        v, gap = x["v"].cast("double"), x["r"] - x["v"].cast("double")
        return F.struct((a["n"] + 1).alias("n"), (a["sr"] + x["r"]).alias("sr"), (a["sv"] + v).alias("sv"), (a["qr"] + x["r"] * x["r"]).alias("qr"), (a["qa"] + gap * gap).alias("qa"))

    kept = r.select("row_idx", valid.alias("k")).where(F.size("k") > 0)
    pick = lambda f: F.transform("k", f)
    each = once(kept.select("row_idx", F.aggregate("k", start, step).alias("s"), *[f(pick(g)).alias(f"{n}_{w}") for n, g in (("a", lambda x: x["r"] - x["v"]), ("r", lambda x: x["r"]), ("v", lambda x: x["v"])) for w, f in (("max", F.array_max), ("min", F.array_min))]))
    n, sr, sv, qr, qa = (F.sum(f"s.{k}") for k in ("n", "sr", "sv", "qr", "qa"))
    var = lambda q, s: (q - s * s / n) / (n - 1)
    out = [("advantage_mean", (sr - sv) / n), ("advantage_max", F.max("a_max")), ("advantage_min", F.min("a_min")), ("return_mean", sr / n), ("return_max", F.max("r_max")), ("return_min", F.min("r_min")), ("value_mean", sv / n), ("value_max", F.max("v_max")), ("value_min", F.min("v_min"))]
    return each.agg(*[F.round(c, 6).alias(k) for k, c in out], F.round(1 - var(qa, sr - sv) / (var(qr, sr) + 1e-5), 5).alias("explained"))


@register(
    "rewarded_pairs",
    """SELECT item_id, CAST(least(len(q) + len(a), 24) AS INTEGER) AS chosen, CAST(least(len(q) + len(c), 24) AS INTEGER) AS rejected FROM (SELECT item_id, string_split(question, ' ') AS q, string_split(coalesce(answer, ''), ' ') AS a, string_split(category, ' ') AS c FROM eval_items)""",
)
def rewarded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded pairs for a reward model, each with its own mask; shown as the masks' sums."""
    from millrace.operators import training as R

    ids = lambda c: F.transform(F.split(c, " ", -1), lambda w: F.length(w).cast("long"))
    i = table(spark, sf_dir, "eval_items").select("item_id", ids(F.col("question")).alias("q"), ids(F.coalesce("answer", F.lit(""))).alias("a"), ids(F.col("category")).alias("c"))
    p = i.select("item_id", R.preference_pair(F.col("q"), F.col("a"), F.col("c"), 24, 0).alias("p"))
    mask = lambda k: Q.total(F.get("p", F.lit(k))["attention_mask"]).cast("int")
    return p.select("item_id", mask(0).alias("chosen"), mask(1).alias("rejected"))


@register(
    "response_slices",
    """WITH d AS (SELECT row_idx, any_value(attention_mask) AS m, any_value(critic_values) AS v, any_value(old_log_probs) AS o, any_value(position_ids) AS p FROM rollout GROUP BY row_idx)
    SELECT row_idx, round(list_sum(list_transform(range(1, 161), lambda i: v[i] * m[79 + i])), 5) AS values, CAST(list_sum(list_slice(p, 80, 239)) AS DOUBLE) AS shifted FROM d WHERE v IS NOT NULL AND m IS NOT NULL AND p IS NOT NULL""",
)
def response_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A critic's values under the mask one place before each token, and the slice by which log-probabilities are shifted."""
    from millrace.operators import training as R

    r = table(spark, sf_dir, "rollout").where("critic_values is not null and attention_mask is not null and position_ids is not null")
    return once(r.select("row_idx", F.round(Q.total(R.masked_values(F.col("critic_values"), F.col("attention_mask"), F.lit(160))), 5).alias("values"), Q.total(R.shifted_logprobs(F.col("position_ids"), F.lit(160))).alias("shifted")))
