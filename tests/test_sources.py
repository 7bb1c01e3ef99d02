import json

import pytest

from gradeloom.operators.parity import check_parity
from gradeloom.plans.evaluation import compare_runs, run_evaluation
from gradeloom.sources import benchmark, config, pool, runs
from gradeloom.streaming.resume import scoring_stream


def solution(i, label=-1, steps=3, **more):
    return {"id": f"s{i}", "problem": f"Problem number {i} about {i % 5} things", "steps": [f"step {i} {k}" for k in range(steps)], "label": label, **more}


@pytest.fixture
def folder(tmp_path):
    for s in ("gsm8k", "math"):
        rows = [solution(i, i % 3 - 1) for i in range(12)]
        rows[0]["id"] = ""
        (tmp_path / f"{s}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    return str(tmp_path)


@pytest.fixture
def items(spark):
    rows = [(i, f"Problem number {i} about {i % 7} things", ["p"], f"step {i} done", i % 2 == 0, i % 3 != 0, None, "x") for i in range(30)]
    df = spark.createDataFrame(rows, "item_id long, question string, prev_steps array<string>, step string, math_ok boolean, consistency_ok boolean, correctness_ok boolean, source string")
    from gradeloom.functions.text import question_id

    return df.withColumn("qid", question_id("question")).withColumn("ordinal", df["item_id"])


def test_benchmark(spark, folder, tmp_path):
    df = benchmark.load_benchmark(spark, folder)
    assert df.count() == 24 and df.where("uid = 'gsm8k-0'").count() == 1 and [r[0] for r in df.select("subset").distinct().orderBy("subset").collect()] == ["gsm8k", "math"]
    assert benchmark.load_benchmark(spark, folder, limit=4).count() == 8
    with pytest.raises(RuntimeError, match="no solutions"):
        benchmark.load_benchmark(spark, str(tmp_path / "none"))
    (tmp_path / "omnimath.jsonl").write_text(json.dumps({"id": "x", "steps": ["a"]}))
    with pytest.raises(KeyError, match="label"):
        benchmark.read_subset(spark, folder, "omnimath")
    (tmp_path / "olympiadbench.jsonl").write_text(json.dumps(solution(1, 7)))
    with pytest.raises(Exception, match="label out of range"):
        benchmark.read_subset(spark, folder, "olympiadbench").collect()


def test_pool_round_trip(spark, items, tmp_path):
    pool.save_pool(items, str(tmp_path / "p"))
    assert pool.load_pool(spark, str(tmp_path / "p")).count() == 30
    with pytest.raises(FileNotFoundError):
        pool.load_pool(spark, str(tmp_path / "q"))


def test_index_is_refused_for_another_encoder(spark, items, tmp_path):
    from gradeloom.operators.encode import build_index

    questions, steps, meta = build_index(items, k=4)
    pool.save_index(questions, steps, meta, str(tmp_path))
    q, s, m = pool.load_index(spark, str(tmp_path), "hashing", items)
    assert (q.count(), s.count(), m["dim"]) == (30, 30, 4)
    with pytest.raises(ValueError, match="encoder"):
        pool.load_index(spark, str(tmp_path), "other")
    with pytest.raises(ValueError, match="holds"):
        pool.load_index(spark, str(tmp_path), "hashing", items.limit(3))


def settings(**over):
    return config.resolve({"prm": {"backend": "mock"}, "retrieval": {"enabled": False, "encoder_name": "hashing", "pca_components": 8}}, over)


def test_runs_resume_and_compare(spark, folder, items, tmp_path):
    solutions = benchmark.load_benchmark(spark, folder, ("gsm8k", "math")).select("*")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    run_evaluation(spark, solutions.where("subset = 'gsm8k'"), settings(), a)
    run_evaluation(spark, solutions, settings(**{"run.resume": True}), a)
    assert runs.read_rows(spark, a).count() == runs.read_predictions(spark, a).count()
    run_evaluation(spark, solutions, settings(**{"retrieval.enabled": True}), b, items)
    refs = runs.read_rows(spark, b, "traces")
    assert refs.where("size(reference_qids) = 2 AND n_references = 2").count() == refs.count() > 0
    out = compare_runs(spark, a, b, str(tmp_path / "out"))
    assert out["overall"]["n_solutions"] == runs.read_predictions(spark, a).count() and (tmp_path / "out" / "comparison.md").exists()
    random_ = settings(**{"retrieval.enabled": True, "retrieval.reference_mode": "random"})
    run_evaluation(spark, solutions, random_, str(tmp_path / "c"), items)
    assert runs.read_rows(spark, str(tmp_path / "c"), "traces").where("n_references = 2").count() > 0


def test_stream_scores_each_solution_once(spark, folder, tmp_path):
    from gradeloom.plans.evaluation import scored_steps

    source, out = tmp_path / "in", str(tmp_path / "run")
    source.mkdir()
    for k in range(2):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"uid": f"u{i}", "subset": "math", "problem": "p", "steps": ["a", "b"], "label": -1}) for i in range(k, k + 3)))
    for _ in range(2):
        scoring_stream(spark, str(source), out, lambda df: scored_steps(df, settings()), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["uid"] for r in runs.read_rows(spark, out).collect()) == ["u0", "u1", "u2", "u3"]


def test_last_prediction_wins(spark, tmp_path):
    from gradeloom.operators.contrast import latest

    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 3)], "uid string, predicted_label int, line_no int")
    assert sorted(tuple(r)[:2] for r in latest(df).collect()) == [("a", 2), ("b", 3)]
    assert runs.read_json(tmp_path / "none.json") is None
    (tmp_path / "bad.json").write_text("{")
    assert runs.read_json(tmp_path / "bad.json") is None
    with pytest.raises(ValueError, match="flagged_uids"):
        runs.read_excluded(spark, str(tmp_path / "bad.json"))


@pytest.mark.parametrize(
    ("given", "over"),
    [({"nope": {}}, {}), ({"prm": {"nope": 1}}, {}), ({}, {"prm.correctness_threshold": 1.0}), ({}, {"prm.backend": "x"}), ({}, {"data.subsets": ["x"]}), ({}, {"prompt.label_style": "x"}), ({}, {"retrieval.top_k_steps": 0})],
)
def test_bad_configurations(given, over):
    with pytest.raises(ValueError):
        config.resolve(given, over)


def test_configuration_choices_only_matter_with_retrieval(tmp_path):
    config.resolve({}, {"retrieval.enabled": False, "prompt.label_style": "x"})
    config.save(config.resolve(), tmp_path / "c.json")
    assert config.load(tmp_path / "c.json", {"prm.backend": "mock"})["prm"]["backend"] == "mock"


def test_parity(spark):
    a = settings()
    assert check_parity(spark, a, settings(**{"retrieval.enabled": True}))["ok"]
    assert not check_parity(spark, a, a)["ok"]
    both = {"retrieval.enabled": True, "prm.seed": 3}
    assert check_parity(spark, a, settings(**both))["problems"] == ["prm.seed: A=17 B=3"]
    assert check_parity(spark, a, settings(**both), ("prm.seed",))["ok"]
    assert not check_parity(spark, a, settings(**{"data.limit_per_subset": 3, "retrieval.enabled": True}), ("data.limit_per_subset",))["ok"]


def test_contamination_excludes(spark, folder, items, tmp_path):
    from gradeloom.plans.evaluation import check_contamination, write_pool_stats

    solutions = benchmark.load_benchmark(spark, folder, ("gsm8k", "math"))
    report = check_contamination(spark, solutions, items, settings(), str(tmp_path / "contamination.json"))
    want = {r["uid"] for r in solutions.collect() if int(r["problem"].split()[2]) % 5 == int(r["problem"].split()[2]) % 7}
    assert {u for u, x in report["flagged_uids"].items() if x["verbatim"]} == want and want
    assert {r["uid"] for r in runs.read_excluded(spark, str(tmp_path / "contamination.json")).collect()} >= want
    stats = write_pool_stats(items, str(tmp_path / "pool.stats.json"))
    assert stats["n_items"] == 30 and stats["sources"] == {"x": 30} and sum(stats["error_types"].values()) == 30


def test_smoke_and_command_line(spark, folder, items, tmp_path, capsys):
    from gradeloom.__main__ import main
    from gradeloom.plans.evaluation import smoke

    solutions = benchmark.load_benchmark(spark, folder, ("gsm8k", "math"))
    metrics = smoke(spark, solutions, items, str(tmp_path / "smoke"))
    assert set(metrics) == {"a", "b", "c"} and (tmp_path / "smoke" / "a-vs-b" / "comparison.json").exists()
    config.save(settings(), tmp_path / "x.json")
    config.save(settings(**{"retrieval.enabled": True}), tmp_path / "y.json")
    assert main(["check-parity", str(tmp_path / "x.json"), str(tmp_path / "y.json")]) == 0
    assert main(["check-parity", str(tmp_path / "x.json"), str(tmp_path / "x.json")]) == 1
    assert main(["compare-runs", str(tmp_path / "smoke" / "a"), str(tmp_path / "smoke" / "c"), "--out", str(tmp_path / "o")]) == 0
    assert "Comparison of two runs" in capsys.readouterr().out


def test_registered_grader_stops_early(spark, folder):
    from gradeloom.operators.score import register_grader, score_with
    from gradeloom.operators.sequences import explode_steps, predictions

    register_grader("second", lambda: lambda q, p, s, r: (len(p) != 1, True, 0.9))
    rows = explode_steps(benchmark.load_benchmark(spark, folder, ("gsm8k",))).selectExpr("uid", "subset", "label AS gold_label", "problem AS question", "prev_steps", "step", "step_index")
    out = score_with(rows, "second")
    assert out.groupBy("uid").count().where("count <> 2").isEmpty() and predictions(out).where("predicted_label <> 1").isEmpty()
    with pytest.raises(ValueError, match="unknown grader"):
        score_with(rows, "none")


def test_pool_keeps_its_order_and_repeats(spark, tmp_path):
    from pyspark.sql import functions as F

    from gradeloom.operators.encode import unique_questions
    from gradeloom.sources import pool

    rows = spark.range(60).select(F.concat(F.lit("q"), F.col("id") % 7).alias("qid"), F.concat(F.lit("Question "), F.col("id")).alias("question"), F.array().cast("array<string>").alias("prev_steps"), F.lit("s").alias("step"), F.lit(True).alias("math_ok"), F.lit(True).alias("consistency_ok"), F.lit(None).cast("boolean").alias("correctness_ok"), F.lit("x").alias("source"), "id").orderBy("id")
    pool.save_pool(rows.union(rows), str(tmp_path / "p"))
    got = pool.load_pool(spark, str(tmp_path / "p"))
    assert got.count() == 120 and got.select("ordinal").distinct().count() == 120
    assert {r["qid"]: r["question"] for r in unique_questions(got).collect()} == {f"q{k}": f"Question {k}" for k in range(7)}


def test_a_stored_index_is_used(spark, tmp_path):
    from pyspark.sql import functions as F

    from gradeloom.plans.evaluation import index_of
    from gradeloom.sources import pool

    items = spark.range(40).select(F.col("id").alias("item_id"), F.col("id").alias("ordinal"), F.concat(F.lit("q"), F.col("id") % 5).alias("qid"), F.concat(F.lit("question "), F.col("id") % 5).alias("question"), F.concat(F.lit("step number "), F.col("id")).alias("step"))
    r = {"encoder_name": "hashing", "pca_components": 4, "pca_whiten": False, "index_dir": str(tmp_path / "i")}
    new = index_of(items, r)
    pool.save_index(*new, r["index_dir"])
    old = index_of(items, r | {"pca_components": 3})  # not built anew
    assert old[2] == new[2] and sorted(map(str, old[1].collect())) == sorted(map(str, new[1].collect()))
    with pytest.raises(ValueError, match="holds"):
        index_of(items.limit(3), r)


def test_markdown_report():
    from gradeloom.sources.runs import markdown

    subset = {"subset": "s1", "n": 4, "ood_rank": 99, "a": {"f1": 0.5}, "b": {"f1": None}, "delta_f1": None, "delta_ci95": (None, None), "mcnemar": {"p_value": 0.04}, "significant": True}
    result = {"run_a": "x", "run_b": "y", "exclusion_label": None, "excluded_uids": 0, "per_subset": [subset], "average_f1_a": 0.5, "average_f1_b": None, "average_delta": None, "undefined_subsets": ["s1"], "overall": {"n_solutions": 4, "average_delta_ci95": (-0.1, 0.2), "mcnemar_pooled": {"p_value": 0.04, "b_only": 1, "a_only": 2, "reliable": False}}, "ood_trend": {"testable": False}}
    text = markdown(result)
    assert "| s1 | unknown | 4 | 50.0 | undefined | undefined | undefined | 0.040 * |" in text and "-10.0 to +20.0" in text and "left out" not in text


def test_positions_go_on_over_splits(spark, tmp_path):
    (tmp_path / "math.jsonl").write_text("\n".join(json.dumps({"problem": f"p{i}", "steps": ["a"], "label": -1}) for i in range(300)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2000")
    try:
        rows = benchmark.read_subset(spark, str(tmp_path), "math")
        assert spark.read.text(str(tmp_path / "math.jsonl")).rdd.getNumPartitions() > 1
        assert {r["problem"]: r["uid"] for r in rows.collect()} == {f"p{i}": f"math-{i}" for i in range(300)}
    finally:
        spark.conf.set(key, before)


def test_study_charts_and_interface(spark, folder, tmp_path, capsys):
    from gradeloom.__main__ import main
    from gradeloom.plans.evaluation import summarize_study, verify_interface
    from gradeloom.sources.config import DEFAULTS

    solutions = benchmark.load_benchmark(spark, folder, ("gsm8k", "math"))
    runs_ = [str(tmp_path / x) for x in "xy"]
    averages = [run_evaluation(spark, solutions, settings(**{"prm.seed": k}), r)["average_f1"] for k, r in zip((17, 18), runs_)]
    found = summarize_study(spark, [*runs_, str(tmp_path / "none")], str(tmp_path / "study"))
    assert found["missing"] == [str(tmp_path / "none")] and [a["average_f1"] for a in found["arms"]] == [None if a is None else 100 * a for a in averages]
    assert len(found["contrasts"]) == 1 and json.loads((tmp_path / "study" / "study.json").read_text()) == found
    if not any(a["undefined_subsets"] for a in found["arms"]):  # the interval of an average needs all subsets
        c = found["contrasts"][0]
        assert c["delta"] == pytest.approx(averages[1] - averages[0]) and c["ci95"][0] <= c["delta"] <= c["ci95"][1]
        assert found["gap"] == pytest.approx(100 * averages[0] - 69.5)
    compare_runs(spark, *runs_, str(tmp_path / "xy"))
    charts = json.loads((tmp_path / "xy" / "charts.json").read_text())
    assert len(charts["f1"]) == 2 * len(charts["trend"]) and all(r["low"] <= r["f1"] <= r["high"] for r in charts["f1"])
    assert main(["plot-arms", *runs_, "--out", str(tmp_path)]) == 0 and (tmp_path / "arms.jsonl").exists()
    assert all(ok for _, ok in verify_interface(spark, DEFAULTS["prompt"]["prompt_prefix"]))
    assert dict(verify_interface(spark, "x", lambda t: [1, 2]))["<extra> is one token"] is False
    assert main(["verify-model-interface"]) == 0 and "FAILS" not in capsys.readouterr().out


def test_flagged_solutions_are_a_table(spark, tmp_path):
    runs.write_json({"flagged_uids": {"u2": {}, "u1": {}}}, tmp_path / "old.json")
    assert [r["uid"] for r in runs.read_excluded(spark, str(tmp_path / "old.json")).collect()] == ["u1", "u2"]
    spark.createDataFrame([("u3",)], "uid string").write.json(str(tmp_path / "t.jsonl"))
    runs.write_json({"flagged_table": str(tmp_path / "t.jsonl"), "flagged_uids": {}}, tmp_path / "new.json")
    assert [r["uid"] for r in runs.read_excluded(spark, str(tmp_path / "new.json")).collect()] == ["u3"]
    runs.write_json({}, tmp_path / "none.json")
    with pytest.raises(ValueError):
        runs.read_excluded(spark, str(tmp_path / "none.json"))


def test_mean_pooling_ignores_padding():
    from gradeloom.operators.encode import mean_pooled

    tokens = lambda texts: ([[[1, 3], [3, 5], [9, 9]], [[7, 7], [7, 7], [7, 7]]], [[1, 1, 0], [0, 0, 0]])
    assert mean_pooled(tokens, unit=False)(["a", "b"]).tolist() == [[2, 4], [0, 0]]
    assert mean_pooled(tokens)(["a", "b"]).round(9).tolist() == [[round(2 / 20**0.5, 9), round(4 / 20**0.5, 9)], [0, 0]]
