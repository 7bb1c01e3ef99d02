"""Whole runs: from solutions and a pool to predictions, metrics and reports."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import question_id
from ..operators import contamination as guard
from ..operators.contrast import cluster_intervals, compare
from ..operators.encode import apply_projection, build_index, encode
from ..operators.metrics import cluster_flags, comparable_scores, macro_average, profile_runs, score_subsets, similarity_bins, stage_rates
from ..operators.retrieve import draw, nearest, retrieve_steps
from ..operators.score import score_with, token_counter
from ..operators.sequences import explode_steps, gapless, predictions
from ..schema import REFERENCE, TRACE
from ..sources import runs
from ..sources.config import save as save_config
from ..sources.pool import has_index, load_index, save_index

log = logging.getLogger("gradeloom")


def index_of(pool: DataFrame, retrieval: dict) -> tuple[DataFrame, DataFrame, dict]:
    """The stored index of a pool if ``index_dir`` holds one (refused if it doesn't fit), else a new one."""
    spark, folder, name = pool.sparkSession, retrieval.get("index_dir"), retrieval["encoder_name"]
    if folder and has_index(spark, folder):
        return load_index(spark, folder, name, pool)
    return build_index(pool, name, retrieval["pca_components"] or 0, retrieval["pca_whiten"])


def with_references(steps: DataFrame, pool: DataFrame, config: dict, index: tuple | None = None) -> DataFrame:
    """Step rows with their ``references``: up to top_k_steps structs each, from the pool (item_id, qid, question, step, …), and what the guard dropped (n_duplicates, n_similar).

    Questions are ranked once for each distinct problem; random ones are drawn for each question and step.
    """
    r = config["retrieval"]
    questions, items, meta = index or index_of(pool, r)
    project = lambda df, column: apply_projection(encode(df, column, r["encoder_name"]), meta["projection"])
    k, below, same = r["top_k_questions"], r["max_question_similarity"], r["drop_exact_duplicates"]
    steps = steps.withColumn("_own", question_id("question"))
    problems = project(steps.select("question", "_own").dropDuplicates(["_own"]), "question").select(F.col("_own").alias("own_id"), "vec")
    # equal normalised questions have equal ids, so the guard's duplicate check is that of ids
    seed = r["random_seed"] if r["reference_mode"] == "random" else None
    if seed is None:
        steps = steps.withColumn("query_id", F.col("_own"))
        found = nearest(problems.withColumnRenamed("own_id", "query_id"), questions.select(F.col("qid").alias("item_id"), "vec"), k, below, same)
    else:
        steps = steps.withColumn("query_id", F.md5(F.concat_ws("\x1f", "question", "step").cast("binary")))
        numbered = gapless(questions.select("qid", "vec"), F.pmod(F.xxhash64("qid"), F.lit(4096)), ["qid"], "ordinal").withColumnRenamed("qid", "item_id")
        asked = steps.select("query_id", F.col("_own").alias("own_id")).dropDuplicates(["query_id"]).join(problems, "own_id")
        found = draw(asked, numbered, k, seed, below, same)
    found = found.persist()  # a row of ids and numbers for each query, read for hits and for counts
    hits = found.select("query_id", F.inline("hits")).select("query_id", F.col("item_id").alias("qid"), F.col("similarity").alias("question_similarity"))
    own = project(steps.select("uid", "subset", "step_index", "query_id", "step"), "step").select("query_id", F.struct("uid", "subset", "step_index").alias("step_index"), "vec")
    refs = retrieve_steps(hits, items, own, r["top_k_steps"], r["step_level"], seed)
    full = refs.join(pool.select("item_id", "question", "step", "math_ok", "consistency_ok"), "item_id")
    gathered = full.groupBy(*(F.col(f"step_index.{c}").alias(c) for c in ("uid", "subset", "step_index"))).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ref_rank", F.struct("qid", "question", "step", "math_ok", "consistency_ok", "question_similarity", "step_similarity").alias("r")))), lambda x: x["r"]).alias("references")
    )
    counts = found.select("query_id", "n_duplicates", "n_similar")
    return steps.join(gathered, ["uid", "subset", "step_index"], "left").join(counts, "query_id", "left").drop("_own", "query_id")


def scored_steps(solutions: DataFrame, config: dict, pool: DataFrame | None = None, index: tuple | None = None) -> DataFrame:
    """The steps that one condition scores, in its order up to the first flag, with references and verdicts: a row of a trace, and more."""
    steps = explode_steps(solutions).select("uid", "subset", F.col("label").alias("gold_label"), F.col("problem").alias("question"), "prev_steps", "step", "step_index", F.size("steps").alias("n_steps"))
    p, q = config["prm"], config["prompt"]
    none = F.lit(0).cast("long")
    if config["retrieval"]["enabled"] and pool is not None:
        steps = with_references(steps, pool, config, index)
    else:
        steps = steps.withColumns({"references": F.lit(None).cast(f"array<{REFERENCE}>"), "n_duplicates": none, "n_similar": none})
    style = {"most": q["max_reference_chars"], "labels": q["include_reference_labels"], "style": q["label_style"]}
    if counter := token_counter(p["backend"]):
        fitted = text.fit_references(q["prompt_prefix"], "question", "references", text.assistant_turn("prev_steps", "step"), p["max_input_tokens"], counter, **style)
        steps = steps.withColumn("_asked", F.coalesce(F.size("references"), F.lit(0))).withColumn("references", fitted)
        steps = steps.withColumn("n_dropped", F.col("_asked") - F.coalesce(F.size("references"), F.lit(0))).drop("_asked")
    else:
        steps = steps.withColumn("n_dropped", F.lit(0))
    scored = score_with(steps, p["backend"], p["correctness_threshold"], p["early_stop"], prefix=q["prompt_prefix"], seed=p["seed"], **style)
    of = lambda name: F.transform("references", lambda r: r[name])
    return scored.select(
        "uid", "subset", "step_index", "gold_label", "is_error", "math_ok", "consistency_ok", "correctness_prob", "n_references", "error_type", of("qid").alias("reference_qids"), of("step_similarity").alias("reference_similarities"),
        "n_steps", of("question_similarity").alias("question_similarities"), "n_dropped", F.coalesce("n_duplicates", none).alias("n_duplicates"), F.coalesce("n_similar", none).alias("n_similar"),
    )


def parts_of(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions, traces) of scored steps."""
    return predictions(scored, stop_early=False), scored.select(*[f.split()[0] for f in TRACE.split(", ")])


def evaluate(solutions: DataFrame, config: dict, pool: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, traces) of one condition, lazily: each scores for itself. A run scores once, see :func:`score_batch`."""
    return parts_of(scored_steps(solutions, config, pool))


def score_batch(spark: SparkSession, folder: str, scored: DataFrame, traces: bool = True) -> dict:
    """Score once and commit: the scored steps go to the run's folder, predictions and traces are made of them and committed together.

    What the batch did (queries, references, drops of guard and budget, hits) is observed while the tables are
    written, so no job counts it again; it is returned and stands in the commit.
    """
    began = time.perf_counter()
    seen, hits = Observation(), Observation()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    added = lambda c: F.coalesce(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    path = f"{folder}/scored"
    scored.observe(
        seen, F.count("*").alias("queries"), total("n_references").alias("references_returned"), total("n_duplicates").alias("filtered_exact_duplicate"), total("n_similar").alias("filtered_similarity"),
        F.count_if(F.col("n_references") == 0).alias("empty_results"), total(added("question_similarities")).alias("question_similarity"), total(added("reference_similarities")).alias("step_similarity"), total("n_dropped").alias("dropped_references"),
    ).write.mode("overwrite").parquet(path)
    preds, trace = parts_of(spark.read.schema(scored.schema).parquet(path))
    preds = preds.observe(hits, F.count("*").alias("n_scored"), F.count_if("correct").alias("n_correct"))
    facts: dict = {}

    def done() -> dict:
        facts.update(seen.get | hits.get | {"seconds": time.perf_counter() - began})
        return facts

    runs.commit(spark, folder, {"predictions": preds} | ({"traces": trace} if traces else {}), done)
    return facts


def _retrieval_summary(config: dict, facts: dict) -> dict:
    if not config["retrieval"]["enabled"]:
        return {"enabled": False}
    n, q = facts.get("references_returned", 0), facts.get("queries", 0)
    return {
        "mode": config["retrieval"]["reference_mode"], "queries": q, "references_returned": n, "references_per_query": n / q if q else 0.0, "filtered_exact_duplicate": facts.get("filtered_exact_duplicate", 0),
        "filtered_similarity": facts.get("filtered_similarity", 0), "empty_results": facts.get("empty_results", 0), "mean_question_similarity": facts.get("question_similarity", 0.0) / n if n else 0.0, "mean_step_similarity": facts.get("step_similarity", 0.0) / n if n else 0.0,
    }


def run_evaluation(spark: SparkSession, solutions: DataFrame, config: dict, folder: str, pool: DataFrame | None = None, batch: int | None = None) -> dict:
    """Score what a run folder lacks (all of it unless ``run.resume``), commit it, and write metrics and a summary.

    With ``batch`` it is done in batches of about so many solutions: each is committed as it ends, so that a run
    that is cut off loses one of them, and progress (running accuracy, time left) is logged after each.
    """
    began = time.perf_counter()
    if not config["run"]["resume"]:
        runs.start_over(spark, folder)
    todo, n_before = solutions, 0
    if runs.begun(spark, folder):
        before = runs.read_rows(spark, folder).select("uid").distinct()
        todo, n_before = runs.pending(solutions, before), before.count()
    n_todo = todo.count()
    index = None
    if n_todo and config["retrieval"]["enabled"] and pool is not None:
        r = config["retrieval"]
        if not (r.get("index_dir") and has_index(spark, r["index_dir"])):
            # written once: the plan would encode the pool anew wherever it reads the index
            save_index(*index_of(pool, r), f"{folder}/index")
            r = r | {"index_dir": f"{folder}/index"}
        index = index_of(pool, r)
    n_batches = max(1, -(-n_todo // batch)) if batch else 1
    facts: dict = {}
    for k in range(n_batches if n_todo else 0):
        part = todo if n_batches == 1 else todo.where(F.pmod(F.xxhash64("uid"), F.lit(n_batches)) == k)
        own = score_batch(spark, folder, scored_steps(part, config, pool, index), config["run"]["save_traces"])
        facts = {x: facts.get(x, 0) + v for x, v in own.items()}
        n, spent = facts["n_scored"], time.perf_counter() - began
        log.info("%d/%d  running accuracy %.3f  %.2f s a solution  %.1f min left", n, n_todo, facts["n_correct"] / max(n, 1), spent / max(n, 1), (n_todo - n) * spent / max(n, 1) / 60)
    done = runs.wanted(runs.read_predictions(spark, folder), solutions)
    by_subset = score_subsets(done).persist()  # a row for each subset, read twice
    scores = [r.asDict() for r in by_subset.collect()]
    metrics = {"subsets": scores, **macro_average(by_subset).first().asDict()}
    by_subset.unpersist()
    save_config(config, f"{folder}/config.resolved.json")
    runs.write_json(metrics, f"{folder}/metrics.json")
    summary = {
        "run_name": config["run"]["name"], "condition": "B (retrieval)" if config["retrieval"]["enabled"] else "A (baseline)", "config": config, "environment": runs.environment(config["prm"]["backend"]),
        "n_solutions": sum(r["n"] for r in scores), "n_scored_this_session": n_todo, "n_resumed": n_before, "wall_seconds": round(time.perf_counter() - began, 1),
        "metrics": metrics, "retrieval": _retrieval_summary(config, facts), "dropped_references_for_length": facts.get("dropped_references", 0), **metrics,
    }
    runs.write_json(summary, f"{folder}/summary.json")
    return metrics


def compare_runs(spark: SparkSession, run_a: str, run_b: str, out: str, contamination: str | None = None, seed: int = 0) -> dict:
    """Compare two run folders, and again without contaminated solutions if a report is given."""
    a, b = runs.read_predictions(spark, run_a), runs.read_predictions(spark, run_b)
    result = compare(a, b, seed=seed, names=(run_a, run_b))
    runs.write_report(result, out)
    if contamination:
        clean = compare(a, b, runs.read_excluded(spark, contamination), seed, "contaminated solutions removed", (run_a, run_b))
        runs.write_report(clean, out, "uncontaminated-")
    return result


def check_contamination(spark: SparkSession, solutions: DataFrame, pool: DataFrame, config: dict, out: str, near: bool = True) -> dict:
    """Which problems the pool holds, verbatim and (with ``near``) by similarity; written as the report that exclusions are read from."""
    threshold, name = config["retrieval"]["max_question_similarity"], config["retrieval"]["encoder_name"]
    similar = None
    if near:
        questions, _, meta = index_of(pool, config["retrieval"])
        similar = guard.nearest(apply_projection(encode(solutions.select("uid", "problem"), "problem", name), meta["projection"]), questions)
    flagged = guard.flags(solutions.select("uid", "subset"), guard.verbatim(solutions, pool), similar, threshold).cache()
    try:
        rows = [r.asDict() for r in guard.report(flagged).collect()]
        # exclusions are read from the table; the report also lists them, which are problems of one benchmark
        table = f"{out.removesuffix('.json')}.flagged.jsonl"
        flagged.where("flagged").select("uid", "subset", "verbatim", "near_duplicate", "max_similarity").write.mode("overwrite").json(table)
        named = {r["uid"]: {k: r[k] for k in ("subset", "verbatim", "near_duplicate", "max_similarity")} for r in flagged.where("flagged").orderBy("uid").toLocalIterator()}
    finally:
        flagged.unpersist()
    n = pool.agg(F.count("*"), F.count_distinct("qid")).first()
    report = {"pool_items": n[0], "pool_unique_questions": n[1], "max_question_similarity": threshold, "per_subset": [r for r in rows if r["subset"] != "TOTAL"], "flagged_table": table, "flagged_uids": named, "n_flagged": len(named), "total": next(r for r in rows if r["subset"] == "TOTAL")}
    runs.write_json(report, out)
    return report


def summarize_study(spark: SparkSession, folders: list[str], out: str | None = None, pairs: list[tuple[str, str]] | None = None, anchor: float = 69.5, seed: int = 0) -> dict:
    """Average F1 of each finished run, the first one's gap to a published anchor, and contrasts of pairs (all, in order) with intervals.

    A run without metrics is named as missing; an average is null if some subset's F1 is undefined.
    """
    metrics = {f: runs.read_json(f"{f}/metrics.json") for f in folders}
    done = [f for f in folders if metrics[f] is not None]
    arms = [{"run": f, "average_f1": None if metrics[f]["average_f1"] is None else 100 * metrics[f]["average_f1"], "undefined_subsets": metrics[f]["undefined_subsets"]} for f in done]
    found = []
    for x, y in pairs or [(x, y) for k, x in enumerate(done) for y in done[k + 1 :]]:
        if x in done and y in done:
            r = compare(runs.read_predictions(spark, x), runs.read_predictions(spark, y), seed=seed, names=(x, y))
            found.append({"run_a": x, "run_b": y, "delta": r["average_delta"], "ci95": r["overall"]["average_delta_ci95"], "significant": r["overall"]["significant"], "reliable": r["overall"]["mcnemar_pooled"]["reliable"]})
    first = arms[0]["average_f1"] if arms else None
    result = {"arms": arms, "missing": [f for f in folders if f not in done], "anchor": anchor, "gap": None if first is None else first - anchor, "contrasts": found}
    if out:
        runs.write_json(result, f"{out}/study.json")
    return result


def arms_chart(spark: SparkSession, folders: list[str], out: str) -> DataFrame:
    """F1 by run and subset, of subsets whose F1 is defined in every run; written as a table for a chart."""
    rows = runs.read_predictions(spark, folders[0]).withColumn("arm", F.lit(folders[0]))
    for f in folders[1:]:
        rows = rows.unionByName(runs.read_predictions(spark, f).withColumn("arm", F.lit(f)))
    chart = comparable_scores(score_subsets(rows, by=("arm",)))
    chart.coalesce(1).write.mode("overwrite").json(f"{out}/arms.jsonl")
    return chart


def _labelled(folders: list[str]) -> dict[str, str]:
    """Run folders by label, from ``label=folder`` or from folders alone."""
    return {x.partition("=")[0]: x.partition("=")[2] or x for x in folders}


def _arms(spark: SparkSession, named: dict[str, str], read) -> DataFrame:
    out = None
    for label, folder in named.items():
        rows = read(spark, folder).withColumn("arm", F.lit(label))
        out = rows if out is None else out.unionByName(rows)
    return out


def error_analysis(spark: SparkSession, folders: list[str], out: str | None = None, similarity: tuple[str, str] | None = None, bins: int = 3) -> dict:
    """Profiles of runs over the solutions that all have met, by label; with ``similarity`` (treatment, baseline) also accuracies by bins of reference similarity."""
    named = _labelled(folders)
    found = {r["arm"]: r.asDict() for r in profile_runs(_arms(spark, named, runs.read_predictions), arms=[*named]).collect()}
    result: dict = {"profiles": {x: {k: v for k, v in found[x].items() if k != "arm"} for x in named}}
    if similarity:
        treated, base = (named.get(x, x) for x in similarity)
        found = similarity_bins(runs.read_predictions(spark, treated), runs.read_predictions(spark, base), runs.read_rows(spark, treated, "traces"), bins)
        result["similarity_bins"] = [r.asDict() for r in found.orderBy("bin").collect()]
    if out:
        runs.write_json(result, out)
    return result


def profile_table(profiles: dict[str, dict]) -> str:
    """A row for each measure, a column for each run, in Markdown."""
    names = [k for k in next(iter(profiles.values())) if not k.startswith("n_")]
    cell = lambda k, x: "undefined" if x is None else f"{100 * x:.1f} %" if k.endswith("_rate") else f"{x:.2f}"
    return "\n".join(runs.pipes(["measure", *profiles], [[k.replace("_", " "), *(cell(k, p[k]) for p in profiles.values())] for k in names]))


def stage_analysis(spark: SparkSession, folders: list[str], out: str | None = None, resamples: int = 2000) -> dict:
    """Flag rates by stage over the steps that all runs have scored, and how the other runs' false flags differ from the first's, with intervals over whole solutions."""
    named = _labelled(folders)
    labels = [*named]
    traces = _arms(spark, named, lambda s, f: runs.read_rows(s, f, "traces")).persist()
    try:
        rates = {r["arm"]: {k: v for k, v in r.asDict().items() if k != "arm"} for r in stage_rates(traces, arms=labels).collect()}
        differences = {x: {r["stage"]: [r["point"], r["low"], r["high"]] for r in cluster_intervals(cluster_flags(traces, labels[0], x), resamples).collect()} for x in labels[1:]}
    finally:
        traces.unpersist()
    result = {"rates": rates, "baseline": labels[0], "differences": differences}
    if out:
        runs.write_json(result, out)
    return result


def verify_interface(spark: SparkSession, prefix: str, token_ids=None) -> list[tuple[str, bool]]:
    """Checks of what a grader is sent, without a model: (what, whether it holds).

    ``token_ids`` (text -> ids) of a model's tokenizer adds the checks that mask and verdicts are one token each.
    """
    refs = F.array(F.struct(F.lit("1 <extra> 1?").alias("question"), F.lit("1 + 1 = 3 <extra>").alias("step"), F.lit(False).alias("math_ok"), F.lit(True).alias("consistency_ok")))
    row = spark.range(1).select(text.user_turn(prefix, F.lit("What is 2 + 2?"), refs).alias("user"), text.assistant_turn(F.array(F.lit("First, 2 + 1 = 3.")), F.lit("Then 3 + 1 = 4.")).alias("asked"))
    row = row.select("*", text.messages("user", "asked").alias("m"), text.advance_to_correctness("asked", [text.POS, text.NEG]).alias("second"))
    r = row.select(
        "m", text.masks("user").alias("in_user"), text.masks("asked").alias("first"), text.masks("second").alias("left"), text.current_step("asked").alias("step"), text.previous_steps("asked").alias("prev"),
        text.extract_question("user").alias("question"), F.col("second").endswith(text.CORRECTNESS).alias("ends"), (F.locate(text.POS, "second") < F.locate(text.NEG, "second")).alias("ordered"),
    ).first()
    checks = [
        ("the turns are user, then assistant", [x["role"] for x in r["m"]] == ["user", "assistant"]),
        ("references bring no mask into the user turn", r["in_user"] == 0),
        ("the first stage holds two masks", r["first"] == 2),
        ("the second stage holds one mask, at its end", r["left"] == 1 and r["ends"]),
        ("verdicts are filled in in order", r["ordered"]),
        ("the step is read back", r["step"] == "Then 3 + 1 = 4." and r["prev"] == ["First, 2 + 1 = 3."]),
        ("a question is found behind the references", r["question"] is not None and r["question"].endswith("What is 2 + 2?")),
    ]
    if token_ids:
        checks += [(f"{t} is one token", len(token_ids(t)) == 1) for t in (text.MASK, text.POS, text.NEG)]
    return checks


def write_pool_stats(pool: DataFrame, path: str) -> dict:
    """n_items, n_unique_questions and counts by error type and source, from one pass."""
    from ..operators.metrics import pool_stats

    out: dict = {"n_items": 0, "n_unique_questions": 0, "error_types": {}, "sources": {}}
    for r in pool_stats(pool).collect():
        if r["error_type"] is not None:
            out["error_types"][r["error_type"]] = r["n_items"]
        elif r["source"] is not None:
            out["sources"][r["source"]] = r["n_items"]
        else:
            out |= {"n_items": r["n_items"], "n_unique_questions": r["n_questions"]}
    runs.write_json(out, path)
    return out


def smoke(spark: SparkSession, solutions: DataFrame, pool: DataFrame, folder: str) -> dict:
    """Three conditions end to end with the deterministic scorer: none, retrieved and random references."""
    from ..sources.config import resolve

    base = {"prm": {"backend": "mock"}, "retrieval": {"encoder_name": "hashing", "pca_components": 16, "index_dir": f"{folder}/index"}}
    save_index(*build_index(pool, "hashing", 16), f"{folder}/index")  # both conditions with references read it
    arms = {"a": {"retrieval.enabled": False}, "b": {}, "c": {"retrieval.reference_mode": "random"}}
    metrics = {x: run_evaluation(spark, solutions, resolve(base, over), f"{folder}/{x}", pool) for x, over in arms.items()}
    for x, y in (("a", "b"), ("a", "c"), ("c", "b")):
        compare_runs(spark, f"{folder}/{x}", f"{folder}/{y}", f"{folder}/{x}-vs-{y}")
    return metrics
