import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import validation as V
from millrace.sources import readers, writers
from millrace.streaming import incremental


def test_catalogue_file(spark, tmp_path):
    (tmp_path / "c.csv").write_text('repository_url,repo_id,category,quality_rating,description,stars_estimate,notes\nhttps://h/o/n, 1 ,cat,high,"a, ""b""\nc",900+,\n', encoding="utf-8")
    r = readers.csv(spark, str(tmp_path / "c.csv")).first()
    assert r.repo_id == "1" and r.description == 'a, "b"\nc' and r.stars_estimate == "900+" and r.notes is None


def test_source_tree(spark, tmp_path):
    for p, b in (("1_x/a.py", b"x = 1\r\n"), ("1_x/p/__init__.py", b"y"), ("1_x/build/b.py", b""), ("1_x/foo.egg-info/c.py", b"\xff\xe9"), ("1_x/.hid/d.py", b""), ("2_y/__pycache__/e.py", b""), ("2_y/f.txt", b"")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    t = readers.source_tree(spark, str(tmp_path)).select("repo_folder", "file_path", readers.decoded(F.col("content")).alias("t"), readers.repository_id(F.col("repo_folder")).alias("id"))
    got = {(r.id, r.file_path): r.t for r in t.collect()}
    assert got == {("1", "/a.py"): "x = 1\n", ("1", "/p/__init__.py"): "y", ("1", "/foo.egg-info/c.py"): "ÿé"}
    other = readers.source_tree(spark, str(tmp_path), "cache")
    assert {r.file_path for r in other.collect()} == {"/a.py", "/p/__init__.py", "/build/b.py", "/foo.egg-info/c.py", "/.hid/d.py"}
    assert readers.repositories(other).first().files == 5


def test_address_list_and_json(spark, tmp_path):
    (tmp_path / "u.txt").write_text("https://a \r\n\n  \nhttps://b")
    assert [r.url for r in readers.address_list(spark, str(tmp_path / "u.txt")).collect()] == ["https://a", "https://b"]
    (tmp_path / "j.json").write_text('[{"sample_id": 3, "code_content": "x"}, {"sample_id": 4}]')
    assert [r.sample_id for r in readers.json_array(spark, str(tmp_path / "j.json")).orderBy("sample_id").collect()] == [3, 4]


def test_parquet_set(spark, tmp_path):
    for n in (1, 2):
        spark.range(n * 10, n * 10 + 3).coalesce(1).write.parquet(str(tmp_path / f"{n}"))
    df = readers.parquet_set(spark, [str(tmp_path / "2"), str(tmp_path / "1")], {"id": "key"})
    assert [r.key for r in readers.first_rows(df, 4).collect()] == [20, 21, 22, 10]
    with pytest.raises(ValueError):
        readers.parquet_set(spark, [])


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("r", "a.b_c", "one"), ("r", "a_b.c", "two"), ("r", "é", None)], "repo string, module string, text string")
    writers.texts(df, str(tmp_path / "t"), ["repo", "module"], "text")
    assert len(list((tmp_path / "t").rglob("module=*"))) == 3
    writers.replaced(df, str(tmp_path / "p"))
    writers.replaced(df.limit(1), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    writers.json_array(df, str(tmp_path / "a.json"), "module")
    assert [x["module"] for x in json.loads((tmp_path / "a.json").read_text())] == ["a.b_c", "a_b.c", "é"]
    writers.json_array(df.limit(0), str(tmp_path / "b.json"), "module")
    assert json.loads((tmp_path / "b.json").read_text()) == []
    state = writers.State(spark, str(tmp_path / "s"), "sample_id")
    rows = spark.range(5).withColumnRenamed("id", "sample_id")
    assert state.remaining(rows).count() == 5
    state.add(rows.where("sample_id < 2"), "ok")
    state.add(rows.where("sample_id = 3"), "failed")
    assert sorted(r.sample_id for r in state.remaining(rows).collect()) == [2, 4]
    writers.log_metrics({"a": 1, "b": "text", "c": 0.5}, 3, spark, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    line = spark.createDataFrame([({"b": 1.0, "a": 0.5},)], "m map<string,double>").select(writers.metric_line("m", F.lit(7)).alias("x")).first().x
    assert line == "step:7 - a:0.500 - b:1.000"
    assert writers.flat_config({"a": {"b": [1, {"c": 2}]}}) == {"a/b/list_len": 2, "a/b/0": 1, "a/b/1/c": 2}
    assert "&lt;x&gt;" in writers.html_report({"a": 1.0}, [{"text": "<x>"}])
    manifest = spark.createDataFrame([(1,), (3,)], "step int")
    assert writers.latest_step(spark, manifest) == 3 and writers.latest_step(spark, manifest.limit(0)) is None


def test_resampling_is_the_known_generator():
    rng = np.random.RandomState(42)
    want = [rng.choice(5, size=3, replace=True).tolist() for _ in range(4)]
    assert V.resampled(5, 3, 4).tolist() == want
    v = np.array([0.0, 1.0, 2.0, 5.0])
    drawn = v[V.resampled(4, 2, 20_000)].max(1).mean()
    assert abs(drawn - V.expected_best(v, 2)) < 0.05
    assert V.sizes(1) == [1] and V.sizes(8) == [2, 4, 8] and V.sizes(3) == [2, 3]


def test_majority_takes_the_first_of_equals():
    picks = np.array([[0, 1, 2, 3], [1, 0, 0, 1], [2, 2, 1, 0]])
    assert V.majority_value(np.array([1.0, 2.0, 3.0, 4.0]), np.array(["a", "b", None, "b"], object), picks).tolist() == [2.0, 2.0, 3.0]


def test_best_of(spark):
    df = spark.createDataFrame([("s", "p", "acc", i, float(i % 2), str(i % 2)) for i in range(4)] + [("s", "one", "acc", 9, 1.0, "1"), ("s", "null", "acc", 10, None, None)], "src string, prompt string, var string, k long, v double, pred string")
    out = V.best_of(df, "src", "prompt", "var", "v", "k", "pred", draws=50)
    m = {(r.prompt, r.metric): r.value for r in out.collect()}
    assert m["p", "mean@4"] == 0.5 and m["p", "std@4"] == 0.5 and m["one", "mean@1"] == 1.0 and ("one", "std@1") not in m and not [k for k in m if k[0] == "null"]
    assert m["p", "best@4/mean"] > m["p", "best@2/mean"] > m["p", "worst@2/mean"]


def test_best_of_large_prompts_by_counts(spark, monkeypatch):
    rows = [("s", p, "acc", i, float(i * 7 % 4), str(i * 7 % 4 // 2)) for p, n in (("p", 40), (None, 9), ("q", 40)) for i in range(n)] + [("s", "q", "acc", 50 + i, 3.0, None) for i in range(30)]
    df = spark.createDataFrame(rows, "src string, prompt string, var string, k long, v double, pred string")
    got = {}
    for limit in (2048, 20):
        monkeypatch.setattr(V, "RESAMPLED_RUNS", limit)
        got[limit] = {(r.prompt, r.metric): r.value for r in V.best_of(df, "src", "prompt", "var", "v", "k", "pred").collect()}
    assert got[20].keys() == got[2048].keys() and {k[1] for k in got[20] if k[0] == "q"} >= {"mean@70", "best@64/mean", "maj@70/std"}
    assert max(abs(x - got[2048][k]) for k, x in got[20].items()) < 0.15
    v = np.array([r[4] for r in rows if r[1] == "q"])
    assert abs(got[20]["q", "best@4/mean"] - V.expected_best(v, 4)) < 1e-9 and abs(got[20]["q", "mean@70"] - v.mean()) < 1e-9
    w = np.array([float(i * 7 % 4) for i in range(9)])
    picks = V.resampled(9, 4)
    assert got[20][None, "best@4/mean"] == w[picks].max(1).mean() and got[20][None, "worst@4/std"] == w[picks].min(1).std()
    votes = np.array([str(i * 7 % 4 // 2) for i in range(9)], object)
    assert got[20][None, "maj@4/mean"] == V.majority_value(w, votes, picks).mean()


def test_best_of_n_reads_all_runs_with_a_thousand_draws(spark, monkeypatch):
    from millrace.plans import catalogue

    seen = {}
    whole = V.best_of

    def best_of(df, *columns, **options):
        seen.update(options, rows=df.count())
        return whole(df, *columns, **options)

    monkeypatch.setattr(V, "best_of", best_of)
    names = {r.metric for r in catalogue.queries()["best_of_n"](spark, "/root/testdata/sf0.001").collect()}
    scores = spark.read.parquet("/root/testdata/sf0.001/rollout.parquet").where("token_level_scores is not null").select("row_idx").distinct().count()
    assert seen == {"rows": scores} and any(int(m.split("@")[1].split("/")[0]) > 16 for m in names)


def test_accuracy(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("b", False), ("b", False)], "c string, ok boolean")
    rows = {r.c: r for r in V.accuracy(df, "c", "ok").collect()}
    assert rows["a"].accuracy == 0.5 and rows[None].accuracy == 0.25 and rows[None].macro == 0.25
    empty = V.accuracy(df.limit(0), "c", "ok").collect()
    assert len(empty) == 1 and empty[0].accuracy is None
    with pytest.raises(ValueError):
        V.aggregated(df, [], "m", ("median",))


def test_accumulation(spark):
    batches = [spark.createDataFrame([(g, float(i)) for i in range(2)], "g string, v double") for g in ("a", "b", "c")]
    out = incremental.accumulated(batches, lambda b: b.where("g <> 'b'"), "g", 2, 3)
    assert {r.g for r in out.collect()} == {"a", "c"}
    with pytest.raises(ValueError):
        incremental.accumulated(batches, lambda b: b.limit(0), "g", 1, 3)


def test_stream_windows_and_duplicates(spark, tmp_path):
    rows = [("k", "2031-01-01 00:10:00", 1.0), ("k", "2031-01-01 00:50:00", 3.0), ("k", "2031-01-01 01:10:00", 5.0), ("k", "2031-01-01 00:10:00", 1.0)]
    df = spark.createDataFrame(rows, "key string, t string, v double").select("key", F.to_timestamp("t").alias("t"), "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = incremental.windowed_metrics(incremental.deduplicated(stream.withColumn("id", F.concat_ws("|", "key", "t")), "id", "t"), "t", "key", "v").writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").columns == ["start", "key", "n", "mean"]
