"""Queries on the text functions: paths, cleaning, templates, letters and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.functions import text as T
from millrace.plans.answers import LAST_SQL, last_messages
from millrace.plans.catalogue import register
from millrace.session import table

#: White space as Python strips it, spelled out for DuckDB.
SPACE_SQL = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@register("tidied_titles", f"SELECT doc_id, replace(regexp_replace(replace({_strip_sql('text')}, ' [title]', '. '), '\\[[^\\n]*?\\]', '', 'g'), '  ', ' ') AS tidy FROM documents")
def tidied_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.tidied("text").alias("tidy"))


@register("relative_paths", "SELECT sample_id, '/' || regexp_replace(replace(file_path, chr(92), '/'), '^/*', '') AS path FROM py_files")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "py_files").select("sample_id", F.concat(F.lit("file:/data/root/"), "file_path").alias("p"))
    return f.select("sample_id", T.relative_path("p", "/data/root").alias("path"))


@register("module_suffixes", "SELECT sample_id, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[i:], '.'))) AS suffix FROM (SELECT sample_id, string_split(replace(regexp_replace(regexp_replace(file_path, '^/+', ''), '\\.py$', ''), '/', '.'), '.') AS p FROM py_files)")
def module_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "py_files").select("sample_id", F.explode(T.suffixes(T.module_name("file_path"))).alias("suffix"))


@register("first_components", "SELECT sample_id, split_part(replace(regexp_replace(regexp_replace(file_path, '^/+', ''), '\\.py$', ''), '/', '.'), '.', 1) AS package FROM py_files")
def first_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "py_files").select("sample_id", T.package(T.module_name("file_path")).alias("package"))


@register("middle_cuts", "SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE left(text, 150) || '...(truncated) ...' || right(text, 150) END AS cut FROM documents")
def middle_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.middle_cut("text", 300).alias("cut"))


@register("capitalised_names", "SELECT p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS name FROM part")
def capitalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.capitalised("p_name").alias("name"))


@register("filled_templates", "SELECT item_id, replace(replace('Question: {question}' || chr(10) || 'Category: {category}', '{question}', question), '{category}', category) AS prompt FROM eval_items")
def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select("item_id", T.filled("Question: {question}\nCategory: {category}", {"question": F.col("question"), "category": F.col("category")}).alias("prompt"))


@register("repeated_marks", "SELECT p_partkey, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i >= len(p) THEN '' WHEN i = 1 THEN '##' WHEN i = 2 THEN '###' ELSE ' ' END), '') AS name FROM (SELECT p_partkey, string_split(p_name, ' ') AS p FROM part)")
def repeated_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each blank of a name stands for a mark; the first two become as many tokens as the counts say."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.repeated_mark("p_name", " ", "#", F.array(F.lit(2), F.lit(3))).alias("name"))


@register("without_tokens", "SELECT doc_id, replace(text, '<|im_end|>', '') AS text FROM documents WHERE source = 'rollout_dump'")
def without_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where("source = 'rollout_dump'").select("doc_id", T.without("text", "<|im_end|>").alias("text"))


@register("template_questions", "SELECT item_id, question || ' Answer in one word.' AS prompt FROM eval_items")
def template_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select("item_id", T.with_instruction("question", "Answer in one word.").alias("prompt"))


@register(
    "chat_answers",
    f"""SELECT doc_id, {_strip_sql("string_split(CASE WHEN contains(text, '<|im_start|>assistant') THEN list_last(string_split(text, '<|im_start|>assistant')) ELSE list_last(string_split(text, 'Assistant:')) END, '<|im_end|>')[1]")} AS answer FROM documents WHERE source = 'rollout_dump'""",
)
def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).where("source = 'rollout_dump'")
    return d.select("doc_id", T.answer_part("text", ["<|im_end|>"]).alias("answer"))


@register("owner_names", "SELECT DISTINCT repository_url, CASE WHEN len(p) >= 2 THEN replace(p[-2] || '-' || p[-1], '.', '_') END AS owner FROM (SELECT repository_url, string_split(regexp_replace(repository_url, '/+$|\\.git/*$', '', 'g'), '/') AS p FROM repo_catalog)")
def owner_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "repo_catalog").select("repository_url", T.owner_name("repository_url").alias("owner")).distinct()


# ------------------------------------------------------------------------------------------------------ answers
_TAIL_BOX = "regexp_extract('\\boxed' || list_last(string_split(text, '\\boxed')), '^\\\\boxed\\{[^{}]*\\}')"


@register("box_parts", f"WITH {LAST_SQL} SELECT result_id, CASE WHEN contains(text, '\\boxed') THEN nullif({_TAIL_BOX}, '') END AS part, CASE WHEN contains(text, '\\boxed') THEN nullif(regexp_extract({_TAIL_BOX}, '^\\\\boxed\\{{(.*)\\}}$', 1), '') END AS inner_text FROM l")
def box_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last box by counting braces, and what is in it; empty boxes are shown as null."""
    m = last_messages(spark, sf_dir).select("result_id", A.box_part_column("text").alias("part"))
    return m.select("result_id", "part", F.nullif(A.unboxed_column("part"), F.lit("")).alias("inner_text"))


@register("line_boxes", f"WITH {LAST_SQL} SELECT result_id, nullif(regexp_extract(text, '\\\\boxed\\{{(.*)\\}}', 1), '') AS box FROM l")
def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_messages(spark, sf_dir).select("result_id", A.box_to_line_end("text").alias("box"))


@register("python_blocks", f"WITH {LAST_SQL} SELECT result_id, string_split(list_last(string_split(text, '```python')), '```')[1] AS block FROM l")
def python_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_messages(spark, sf_dir).select("result_id", A.last_python_block("text").alias("block"))


def _unmarked_sql(text: str) -> str:
    for mark in A.MARKUP:
        text = f"replace({text}, '{mark}', '')"
    return text


@register("unmarked_answers", f"WITH {LAST_SQL} SELECT result_id, {_unmarked_sql('text')} AS text FROM l")
def unmarked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_messages(spark, sf_dir).select("result_id", A.unmarked("text").alias("text"))


@register(
    "multilingual_letters",
    f"WITH {LAST_SQL} SELECT result_id, nullif(upper(translate(regexp_extract(text, '(?i)(?:{'|'.join(A.MULTILINGUAL_LEADS)})\\s*[:：][ \\t]*([A-D{''.join(A.SCRIPT_LETTERS)}])', 1), '{''.join(A.SCRIPT_LETTERS)}', '{''.join(A.SCRIPT_LETTERS.values())}')), '') AS letter FROM l",
)
def multilingual_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_messages(spark, sf_dir).select("result_id", A.multilingual_letter("text").alias("letter"))


@register("judged_yes", "SELECT item_id, coalesce(lower(trim(answer)) = 'yes', false) AS yes FROM eval_items")
def judged_yes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select("item_id", A.says_yes("answer").alias("yes"))


@register("final_answers")
def final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and statements, marked answers and answers of free-form tasks; ordered searches that SQL can't say, held by tests."""
    m = last_messages(spark, sf_dir)
    return m.select("result_id", A.answer_column("text").alias("answer"), A.marked_column("text").alias("marked"), A.free_form_column("text").alias("free_form"))
