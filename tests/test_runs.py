"""Runs: scored once, committed together, observed, within a token budget."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import text
from gradeloom.operators import score
from gradeloom.operators.sequences import explode_steps
from gradeloom.plans import evaluation
from gradeloom.sources import config, runs
from gradeloom.sources.pool import parse_rows
from gradeloom.schema import CHAT_ROW


def solutions(spark, n=12, steps=5):
    rows = [(f"u{k}", "gsm8k" if k % 2 else "math", f"problem {k % 7}", [f"step {k} {i}" for i in range(1 + (k + steps) % steps)], -1 if k % 3 else 0) for k in range(n)]
    return spark.createDataFrame(rows, "uid string, subset string, problem string, steps array<string>, label int")


def settings(**over):
    return config.resolve({"prm": {"backend": "mock"}, "retrieval": {"enabled": False, "encoder_name": "hashing", "pca_components": 0, "index_dir": "none"}}, over)


def pool_of(spark, n=30):
    turns = lambda k: ([{"role": "user", "content": f"Question: problem {k % 10}{' more' if k % 3 else ''}"}, {"role": "assistant", "content": f"a\n\nCurrent Step: step {k} of it Math reasoning: <extra>, Consistency: <extra>"}], [{"role": "assistant", "content": f"step Math reasoning: <{'+-'[k % 2]}>, Consistency: <+>"}])
    chats = spark.createDataFrame([(*turns(k), "made") for k in range(n)], CHAT_ROW)
    place = F.regexp_extract(F.col("inputs")[1]["content"], r"step (\d+)", 1).cast("long")
    return parse_rows(chats.withColumns({"item_id": place, "ordinal": place}))


def _rows(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.collect())


def test_one_load_a_worker_and_nothing_behind_a_flag(spark, tmp_path):
    loads, calls = str(tmp_path / "loads"), str(tmp_path / "calls")

    def make():
        with open(loads, "a") as f:
            f.write(f"{os.getpid()}\n")

        def grade(rows):
            with open(calls, "a") as f:
                f.write("".join(f"{len(rows)}\t{r['step']}\n" for r in rows))
            return [(not r["step"].endswith(" 2"), True, 0.9) for r in rows]

        return grade

    score.register_batch_grader("counted", make)
    base = solutions(spark, 40)
    out = str(tmp_path / "run")
    evaluation.run_evaluation(spark, base.repartition(8), settings(**{"prm.backend": "mock"}) | {"prm": settings()["prm"] | {"backend": "counted"}}, out)
    workers = (tmp_path / "loads").read_text().split()
    assert len(workers) == len(set(workers)) <= 4  # local[4]: four workers, however many tasks they get
    asked = [x.split("\t") for x in (tmp_path / "calls").read_text().splitlines()]
    want = sorted(s for r in base.collect() for k, s in enumerate(r["steps"]) if k <= 2)
    assert sorted(s for _, s in asked) == want  # each step once, none behind the flag
    assert max(int(n) for n, _ in asked) > 1
    traces = runs.read_rows(spark, out, "traces")
    assert sorted(r["step_index"] for r in traces.where("is_error").collect()) == [2] * traces.where("is_error").count()
    for r in runs.read_rows(spark, out).collect():
        steps = base.where(F.col("uid") == r["uid"]).first()["steps"]
        assert (r["n_steps"], r["n_steps_scored"]) == (len(steps), min(3, len(steps))) and r["predicted_label"] == (2 if len(steps) > 2 else -1)


def test_mock_traces_end_at_the_first_flag(spark, tmp_path):
    out = str(tmp_path / "run")
    evaluation.run_evaluation(spark, solutions(spark, 60), settings(), out)
    traces, preds = runs.read_rows(spark, out, "traces"), runs.read_rows(spark, out)
    scored = preds.agg(F.sum("n_steps_scored")).first()[0]
    assert traces.count() == scored < preds.agg(F.sum("n_steps")).first()[0]
    first = traces.where("is_error").groupBy("uid").agg(F.min("step_index").alias("f"))
    assert traces.join(first, "uid").where("step_index > f").isEmpty()
    late = str(tmp_path / "late")
    evaluation.run_evaluation(spark, solutions(spark, 60), settings(**{"prm.early_stop": False}), late)
    assert runs.read_rows(spark, late, "traces").count() == preds.agg(F.sum("n_steps")).first()[0]
    assert _rows(runs.read_rows(spark, late).select("uid", "predicted_label")) == _rows(preds.select("uid", "predicted_label"))


class Cut(Exception):
    pass


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    evaluation.run_evaluation(spark, solutions(spark, 14), settings(), out)
    return {what: _rows(runs.read_rows(spark, out, what)) for what in ("predictions", "traces")}


@pytest.mark.parametrize("point", ["scored", "predictions", "manifest", "rename", "after"])
def test_a_run_that_is_cut_off_resumes_to_the_same_rows(spark, whole, tmp_path, monkeypatch, point):
    base, cut = solutions(spark, 14), str(tmp_path / "cut")
    evaluation.run_evaluation(spark, base.where("uid < 'u2'"), settings(), cut)
    resumed = settings(**{"run.resume": True})
    real_commit, real_json = runs.commit, runs.write_json

    def commit(s, folder, frames, facts=None):
        if point == "scored":
            raise Cut
        if point == "predictions":

            def stop():
                raise Cut

            return real_commit(s, folder, {"predictions": frames["predictions"]}, stop)
        real_commit(s, folder, frames, facts)
        raise Cut

    def write_json(value, path):
        if "commits" in str(path):
            if point == "rename":
                real_json(value, path)
            raise Cut
        real_json(value, path)

    with monkeypatch.context() as m:
        if point in ("manifest", "rename"):
            m.setattr(runs, "write_json", write_json)
        else:
            m.setattr(runs, "commit", commit)
        with pytest.raises(Cut):
            evaluation.run_evaluation(spark, base, resumed, cut)
    if point != "after":
        assert runs.read_rows(spark, cut).count() == base.where("uid < 'u2'").count()  # nothing uncommitted is read
    evaluation.run_evaluation(spark, base, resumed, cut)
    for what in ("predictions", "traces"):
        assert _rows(runs.read_rows(spark, cut, what)) == whole[what]


def test_last_batch_wins_and_foreign_runs_are_read(spark, tmp_path):
    out = tmp_path / "run"
    out.mkdir()
    row = {"uid": "a", "subset": "math", "gold_label": -1, "predicted_label": 3, "n_steps": 5, "n_steps_scored": 4, "correct": False}
    (out / "predictions.jsonl").write_text("\n".join(json.dumps(row | {"uid": u, "predicted_label": k}) for k, u in enumerate("aab")))
    got = lambda: {r["uid"]: r["predicted_label"] for r in runs.read_predictions(spark, str(out)).collect()}
    assert got() == {"a": 1, "b": 2}
    frame = lambda k: runs.read_rows(spark, str(out)).limit(1).withColumn("predicted_label", F.lit(k))
    assert [runs.commit(spark, str(out), {"predictions": frame(k)}) for k in (7, 9)] == [0, 1]
    assert got() == {"a": 9, "b": 2}
    # a file that no manifest names is not read
    (out / "predictions" / "epoch=000005").mkdir()
    (out / "predictions" / "epoch=000005" / "part-0.json").write_text(json.dumps(row | {"uid": "c"}))
    assert got() == {"a": 9, "b": 2}


def test_summary_is_observed(spark, tmp_path):
    base, pool = solutions(spark, 10), pool_of(spark)
    for mode in ("retrieved", "random"):
        out = str(tmp_path / mode)
        evaluation.run_evaluation(spark, base, settings(**{"retrieval.enabled": True, "retrieval.reference_mode": mode, "retrieval.top_k_questions": 3}), out, pool)
        summary = runs.read_json(f"{out}/summary.json")
        traces = runs.read_rows(spark, out, "traces").collect()
        r = summary["retrieval"]
        assert (r["mode"], r["queries"], r["references_returned"]) == (mode, len(traces), sum(t["n_references"] for t in traces))
        assert r["empty_results"] == sum(t["n_references"] == 0 for t in traces) and r["references_per_query"] == r["references_returned"] / r["queries"]
        mean = sum(s for t in traces for s in t["reference_similarities"]) / r["references_returned"]
        assert abs(r["mean_step_similarity"] - mean) < 1e-9
        if mode == "retrieved":  # problems 0 to 6 stand in the pool word by word, and nothing is nearer
            assert r["filtered_exact_duplicate"] == len(traces)
        assert summary["n_scored_this_session"] == 10 and summary["n_resumed"] == 0 and summary["wall_seconds"] > 0 and summary["dropped_references_for_length"] == 0
        assert summary["condition"] == "B (retrieval)" and summary["metrics"]["subsets"]
        again = settings(**{"retrieval.enabled": True, "retrieval.reference_mode": mode, "run.resume": True, "retrieval.top_k_questions": 3})
        evaluation.run_evaluation(spark, base, again, out, pool)
        assert (runs.read_json(f"{out}/summary.json")["n_resumed"], len(runs.commits(spark, out))) == (10, 1)


def test_batches_and_progress(spark, tmp_path, caplog):
    out = str(tmp_path / "run")
    with caplog.at_level("INFO", "gradeloom"):
        evaluation.run_evaluation(spark, solutions(spark, 14), settings(), out, batch=5)
    assert len(runs.commits(spark, out)) == 3 and sum("running accuracy" in m for m in caplog.messages) == 3
    facts = [c["facts"] for c in runs.commits(spark, out)]
    assert sum(f["n_scored"] for f in facts) == 14 and sum(f["n_correct"] for f in facts) == runs.read_rows(spark, out).where("correct").count()


def test_references_of_a_plugin_stand_in_its_traces(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def make():
        def grade(q, prev, step, refs):
            with open(seen, "a") as f:
                f.write(f"{len(refs)} {len(prev)}\n")
            return True, True, 0.7

        return grade

    score.register_grader("plain", make)
    conf = settings(**{"retrieval.enabled": True}) | {"prm": settings()["prm"] | {"backend": "plain"}}
    out = str(tmp_path / "run")
    evaluation.run_evaluation(spark, solutions(spark, 6), conf, out, pool_of(spark))
    traces = runs.read_rows(spark, out, "traces")
    assert traces.where("n_references = 2 AND size(reference_qids) = 2 AND size(reference_similarities) = 2").count() == traces.count() == len((tmp_path / "seen").read_text().splitlines()) > 6


def test_two_passes(spark, tmp_path):
    seen = str(tmp_path / "second")
    stage1 = lambda: lambda prompts: [((1.0, 0.0), (0.0, 1.0) if " 1 " in p else (1.0, 1.0)) for p in prompts]

    def stage2():
        def run(prompts):
            with open(seen, "a") as f:
                f.write("".join(f"{p.count(text.MASK)} {p.count(text.POS)}\n" for p in prompts))
            return [(1.0, 0.0)] * len(prompts)

        return run

    steps = explode_steps(solutions(spark, 20)).select("uid", "subset", F.col("label").alias("gold_label"), F.col("problem").alias("question"), "prev_steps", "step", "step_index")
    rows = score.score_in_two_passes(steps, stage1, stage2).select("uid", "step_index", "math_ok", "consistency_ok", "correctness_prob", "is_error").collect()
    second = (tmp_path / "second").read_text().splitlines()
    assert len(second) == sum(r["consistency_ok"] for r in rows) < len(rows) and set(second) == {"1 2"}
    assert all((r["correctness_prob"] is None) == r["is_error"] == (not r["consistency_ok"]) for r in rows)
    # the same verdicts, solution by solution, by the grader that stops
    score.register_batch_grader("logits", lambda: score.two_stage(stage1(), stage2()))
    stopped = score.score_with(steps, "logits", stop_early=False).select("uid", "step_index", "math_ok", "consistency_ok", "correctness_prob", "is_error")
    assert _rows(stopped) == sorted(json.dumps(r.asDict(), sort_keys=True) for r in rows)


def test_two_stage_checks_masks_and_tokens():
    grade = score.two_stage(lambda p: [((1.0, 0.0), (1.0, 0.0))] * len(p), lambda p: [(0.0, 0.0)] * len(p))
    ok = {"first": "<extra> <extra>", "second": "<extra>"}
    assert grade([ok]) == [(True, True, 0.5)]
    with pytest.raises(ValueError, match="first pass"):
        grade([ok | {"first": "<extra>"}])
    with pytest.raises(ValueError, match="second pass"):
        grade([ok | {"second": ""}])
    with pytest.raises(ValueError, match="one token"):
        score.two_stage(None, None, lambda t: [1, 2])


def _budget_cases(spark):
    refs = [[(f"q{i} <extra> {'long ' * (7 * i)}", f"step {i}\n of", i % 2 == 0, True) for i in range(n)] for n in (0, 1, 2, 5)]
    rows = [(k, f"question {k} 12?", r if r or k else None, ["first", "second"], "now 3+4") for k, r in enumerate(refs * 2)]
    return spark.createDataFrame(rows, "id int, question string, references array<struct<question:string,step:string,math_ok:boolean,consistency_ok:boolean>>, prev_steps array<string>, step string")


@pytest.mark.parametrize("kind", ["characters", "bytes"])
def test_budget_equals_rendering_every_prompt(spark, kind):
    df = _budget_cases(spark)
    if kind == "characters":
        tokens, count = text._lengths, len
    else:
        import public_tokenizers
        from tokenizers import Tokenizer

        path = public_tokenizers.path("byte_bpe_50k.json")
        count = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)

        @F.pandas_udf("array<int>")
        def tokens(lists):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            return lists.map(lambda ts: [len(own.encode(t, add_special_tokens=False).ids) for t in ts])

    prompts = df.select("id", F.coalesce(F.size("references"), F.lit(0)).alias("n"), *(F.concat(text.user_turn("pre fix", "question", F.slice("references", 1, k)), text.assistant_turn("prev_steps", "step")).alias(f"p{k}") for k in range(6))).collect()
    sizes = {r["id"]: [count(r[f"p{k}"]) if r[f"p{k}"] is not None else count(r["p0"] or "") for k in range(r["n"] + 1)] for r in prompts}
    for budget in (1, 120, 200, 260, 400, 700, 5000):
        got = df.select("id", text.fit_references("pre fix", "question", "references", text.assistant_turn("prev_steps", "step"), budget, tokens).alias("r")).collect()
        for r in got:
            fits = [k for k, n in enumerate(sizes[r["id"]]) if n <= budget]
            assert len(r["r"] or []) == max(fits, default=0), (r["id"], budget)


def test_budget_is_kept_in_a_run(spark, tmp_path):
    score.register_grader("short", lambda: lambda q, p, s, r: (True, True, 0.9), text._lengths)
    base, pool = solutions(spark, 6), pool_of(spark)
    none = len(settings()["prompt"]["prompt_prefix"])
    dropped = {}
    for budget in (none, none + 400, 10**6):
        conf = settings(**{"retrieval.enabled": True}) | {"prm": settings()["prm"] | {"backend": "short", "max_input_tokens": budget}}
        out = str(tmp_path / str(budget))
        evaluation.run_evaluation(spark, base, conf, out, pool)
        traces = runs.read_rows(spark, out, "traces")
        dropped[budget] = runs.read_json(f"{out}/summary.json")["dropped_references_for_length"]
        assert dropped[budget] == 2 * traces.count() - traces.agg(F.sum("n_references")).first()[0]
    assert dropped[none] > dropped[none + 400] > dropped[10**6] == 0


def test_error_and_stage_analysis(spark, tmp_path, capsys):
    from gradeloom.__main__ import main

    base, pool = solutions(spark, 40), pool_of(spark)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    evaluation.run_evaluation(spark, base, settings(), a)
    evaluation.run_evaluation(spark, base, settings(**{"retrieval.enabled": True}), b, pool)
    assert main(["error-analysis", f"none={a}", f"some={b}", "--out", str(tmp_path), "--similarity-bins", "some", "none"]) == 0
    assert "| measure | none | some |" in capsys.readouterr().out
    found = runs.read_json(tmp_path / "error_analysis.json")
    assert found["profiles"]["none"]["n_solutions"] == found["profiles"]["some"]["n_solutions"] == 40 == sum(r["n"] for r in found["similarity_bins"])
    assert main(["stage-analysis", f"none={a}", f"some={b}", "--out", str(tmp_path)]) == 0
    stages = runs.read_json(tmp_path / "stage_analysis.json")
    t = {x: {(r["uid"], r["step_index"]): r for r in runs.read_rows(spark, f, "traces").collect()} for x, f in (("none", a), ("some", b))}
    both = t["none"].keys() & t["some"].keys()
    ok = [k for k in both if t["none"][k]["gold_label"] == -1 or k[1] < t["none"][k]["gold_label"]]
    assert stages["rates"]["some"]["steps"] == len(both) and stages["rates"]["none"]["gold_correct_steps"] == len(ok)
    late = lambda x: sum(t[x][k]["is_error"] and t[x][k]["math_ok"] and t[x][k]["consistency_ok"] for k in ok)
    point, low, high = stages["differences"]["some"]["s2"]
    assert point == pytest.approx(100 * (late("some") - late("none")) / len(ok)) and low <= point <= high
