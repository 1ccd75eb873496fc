"""Sinks: Parquet, JSON, text by key, state tables, reports."""

from __future__ import annotations

import html
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Between any two file systems that Hadoop knows; the target is replaced."""
    a, pa = _fs(spark, source)
    b, pb = _fs(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, pa, b, pb, False, True, spark._jsc.hadoopConfiguration())


def replaced(df: DataFrame, path: str) -> None:
    """Parquet written beside the target and moved into place, so readers never see half of it."""
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    df.write.parquet(aside)
    fs, target = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), target)
    fs.delete(old, True)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_array(df: DataFrame, path: str, order: str) -> None:
    """One file with one JSON array, indented by two, in order. The format has one file, so one stream writes it: rows come by
    partition and go at once, and the driver holds one partition."""
    fs, target = _fs(df.sparkSession, path)
    out = fs.create(target, True)
    try:
        rows = df.select(F.struct(*df.columns).alias("r"), order).orderBy(order).select(F.to_json("r", {"ignoreNullFields": "false"}).alias("j"))
        out.write(b"[")
        first, held = True, []

        def flush() -> None:
            out.write("".join(held).encode("utf-8"))
            held.clear()

        for r in rows.toLocalIterator():
            text = json.dumps(json.loads(r.j), ensure_ascii=False, indent=2).replace("\n", "\n  ")
            held.append(("\n  " if first else ",\n  ") + text)
            first = False
            if len(held) >= 1000:
                flush()
        flush()
        out.write(b"]" if first else b"\n]")
    finally:
        out.close()


def texts(df: DataFrame, path: str, keys: list[str], text: str) -> None:
    """Texts as files below folders by key, so that no two keys meet in one name: path/repo=r/module=m/part-*.txt."""
    df.select(*keys, F.col(text).alias("value")).write.mode("overwrite").partitionBy(*keys).option("lineSep", "\n").text(path)


def train_test(train: DataFrame, test: DataFrame, path: str) -> None:
    """Both splits as Parquet and as JSON lines."""
    for name, df in (("train", train), ("test", test)):
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        df.write.mode("overwrite").json(f"{path}/{name}.json")


def with_responses(source: DataFrame, responses: DataFrame, key: str, path: str) -> None:
    """The source's rows with their `responses` array."""
    source.join(responses.select(key, "responses"), key, "left").write.mode("overwrite").parquet(path)


class State:
    """What a resumable run has done: an append-only table of (key, status), in files that are never changed."""

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str = "long") -> None:
        self.spark, self.path, self.key, self.kind = spark, path, key, kind

    def done(self) -> DataFrame:
        """Keys with any status, each once."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], f"{self.key} {self.kind}")
        return self.spark.read.schema(f"{self.key} {self.kind}, status string").parquet(self.path).select(self.key).distinct()

    def remaining(self, df: DataFrame) -> DataFrame:
        return df.join(self.done(), self.key, "left_anti")

    def add(self, df: DataFrame, status: str | Column) -> None:
        df.select(self.key, (F.lit(status) if isinstance(status, str) else status).alias("status")).write.mode("append").parquet(self.path)


def latest_step(spark: SparkSession, manifest: DataFrame) -> int | None:
    """The largest `step` of a manifest of complete checkpoints; None for an empty one."""
    return manifest.agg(F.max("step")).first()[0]


def step_folder(root: str, step: int) -> str:
    return f"{root.rstrip('/')}/global_step_{step}"


def metric_line(metrics: Column | str, step: Column | str) -> Column:
    """'step:7 - a:0.500 - b:1.000' from a map of metrics, by name; nulls are left out."""
    m = F.col(metrics) if isinstance(metrics, str) else metrics
    s = F.col(step) if isinstance(step, str) else step
    parts = F.transform(F.array_sort(F.filter(F.map_entries(m), lambda e: e["value"].isNotNull())), lambda e: F.concat(e["key"], F.lit(":"), F.format_string("%.3f", e["value"])))
    return F.array_join(F.concat(F.array(F.concat(F.lit("step:"), s.cast("string"))), parts), " - ")


def log_metrics(metrics: dict[str, float], step: int, spark: SparkSession, path: str) -> None:
    """Appends (step, key, value); values that are no numbers are left out."""
    rows = [(step, k, float(v)) for k, v in metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    spark.createDataFrame(rows, "step long, key string, value double").coalesce(1).write.mode("append").parquet(path)


def flat_config(config: object, at: str = "") -> dict[str, object]:
    """Nested settings with keys a/b/c; a list becomes its length and its items by number."""
    if isinstance(config, dict):
        items = list(config.items())
    elif isinstance(config, (list, tuple)):
        items = [("list_len", len(config)), *((str(i), x) for i, x in enumerate(config))]
    else:
        return {at: config}
    out: dict[str, object] = {}
    for k, v in items:
        out |= flat_config(v, f"{at}/{k}" if at else str(k))
    return out


def validation_table(samples: DataFrame, step: int, most: int) -> DataFrame:
    """One wide row of the first `most` samples: step, input_1, output_1, score_1, ..."""
    rows = samples.orderBy("input", "output").limit(most).collect()
    names = [f"{n}_{i}" for i in range(1, len(rows) + 1) for n in ("input", "output", "score")]
    values = [v for r in rows for v in (r["input"], r["output"], float(r["score"]))]
    schema = ", ".join(["step long", *(f"{n} {'double' if n.startswith('score') else 'string'}" for n in names)])
    return samples.sparkSession.createDataFrame([(step, *values)], schema)


def html_report(metrics: dict[str, float], examples: list[dict[str, str]]) -> str:
    """A page of metrics and example conversations; everything is escaped."""
    head = "".join(f"<tr><td>{html.escape(k)}</td><td>{v:.6g}</td></tr>" for k, v in sorted(metrics.items()))
    body = "".join("<hr>" + "".join(f"<h4>{html.escape(k)}</h4><pre>{html.escape(str(v))}</pre>" for k, v in e.items()) for e in examples)
    return f"<!doctype html><html><head><meta charset='utf-8'></head><body><table>{head}</table>{body}</body></html>"
