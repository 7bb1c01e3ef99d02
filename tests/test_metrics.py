import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeloom.functions.measures import chi2_p_value, harmonic
from gradeloom.operators import contrast, metrics, sample, sequences


def preds(spark, gold, predicted, subset="gsm8k", arm="a"):
    rows = [(f"u{i:03d}", subset, g, p, 9, 9, arm) for i, (g, p) in enumerate(zip(gold, predicted))]
    return spark.createDataFrame(rows, "uid string, subset string, gold_label int, predicted_label int, n_steps int, n_steps_scored int, arm string")


@pytest.mark.parametrize(
    ("gold", "predicted", "want"),
    [([-1, -1, 1, 2], [0, 0, 1, 2], (1.0, 0.0, 0.0)), ([1, 1], [1, -1], (0.5, None, None)), ([-1], [-1], (None, 1.0, None)), ([0, 1, 2, 3, 4, -1, -1, -1, -1, -1], [0, 1, 2, -1, -1, -1, -1, 5, 5, 5], (0.6, 0.4, 0.48))],
)
def test_scores(spark, gold, predicted, want):
    r = metrics.score_subsets(preds(spark, gold, predicted)).first()
    assert (r["error_acc"], r["correct_acc"]) == want[:2]
    assert r["f1"] == (pytest.approx(want[2]) if want[2] is not None else None)


def test_no_predictions_no_rows(spark):
    assert metrics.score_subsets(preds(spark, [1], [1]).limit(0)).count() == 0


def test_macro_average_leaves_undefined_out(spark):
    both = preds(spark, [1, -1], [1, -1]).union(preds(spark, [1], [1], "math"))
    r = metrics.macro_average(metrics.score_subsets(both)).first()
    assert (r["average_f1"], r["average_over"], r["undefined_subsets"], r["subset_order"]) == (1.0, 1, ["math"], ["gsm8k", "math"])


def test_profile(spark):
    r = metrics.verdict_profile(preds(spark, [4, 4, 4, -1], [1, 6, 4, -1])).first()
    assert (r["early_rate"], r["late_rate"], r["exact_rate"]) == (pytest.approx(1 / 3),) * 3
    assert r["mean_index_offset"] == pytest.approx(-1 / 3) and r["false_alarm_rate"] == 0 and r["miss_rate"] == 0
    with pytest.raises(ValueError, match="no solutions"):
        metrics.profile_runs(preds(spark, [1], [1]).union(preds(spark, [1], [1], arm="b").withColumn("uid", F.lit("other"))))


def aligned(spark, gold, a, b, subset="gsm8k"):
    return spark.createDataFrame([(subset, f"u{i}", g, x, y) for i, (g, x, y) in enumerate(zip(gold, a, b))], "subset string, uid string, gold int, pred_a int, pred_b int")


def test_mcnemar(spark):
    r = contrast.mcnemar(aligned(spark, [0, 1, 2, -1], [0, 9, 9, -1], [0, 1, 9, 9])).first()
    assert (r["b_only"], r["a_only"], r["discordant"], r["reliable"]) == (1, 1, 2, False)
    assert r["statistic"] == 0.5 and r["p_value"] == pytest.approx(math.erfc(math.sqrt(0.25)), abs=1e-12)
    r = contrast.mcnemar(aligned(spark, [0], [0], [0])).first()
    assert (r["statistic"], r["p_value"], r["reliable"]) == (0, 1, None)


def test_p_values(spark):
    xs = [0.0, 1e-6, 0.1, 0.5, 1, 2, 3.84, 6, 7.9, 8.1, 12, 30, 60, 200]
    got = [r[0] for r in spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(chi2_p_value("x")).collect()]
    for x, p in zip(xs, got):
        assert p == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9, abs=1e-15)


def test_align_refusals(spark):
    a = preds(spark, [1, -1], [1, -1])
    with pytest.raises(ValueError, match="only"):
        contrast.align(a, a.where("uid = 'u000'"))
    with pytest.raises(ValueError, match="share no"):
        contrast.align(a, a.withColumn("uid", F.concat(F.lit("x"), "uid")))
    with pytest.raises(ValueError, match="gold"):
        contrast.align(a, a.withColumn("gold_label", F.lit(3)))
    with pytest.raises(ValueError, match="excluded"):
        contrast.align(a, a, exclude=a)
    assert contrast.align(a, a, exclude=a.where("uid = 'u000'")).count() == 1


@pytest.mark.parametrize(
    ("deltas", "want"),
    [
        ([0.0, 0.0, 0.0, 0.0], {"degenerate": True, "spearman": 0.0, "monotonic_increasing": False}),
        ([0.0, 0.02, 0.05, 0.09], {"degenerate": False, "spearman": 1.0, "monotonic_increasing": True, "interpretation": "rises with severity"}),
        ([0.09, 0.05, 0.02, -0.01], {"spearman": -1.0, "monotonic_increasing": False, "interpretation": "does not rise with severity"}),
        ([0.1, 0.2], {"testable": False, "spearman": None}),
    ],
)
def test_trend(spark, deltas, want):
    df = spark.createDataFrame([(i, d, str(i)) for i, d in enumerate(deltas)], "ood_rank int, delta_f1 double, subset string")
    r = contrast.ood_trend(df).first().asDict()
    assert {k: (round(v, 9) if isinstance(v, float) else v) for k, v in r.items() if k in want} == want


def test_compare_and_report(spark, tmp_path):
    from gradeloom.sources import runs

    gold = [0, 1, 2, 3, -1, -1, -1, -1] * 5
    a = preds(spark, gold, [0, 9, 2, 9, -1, -1, 0, -1] * 5)
    b = preds(spark, gold, [0, 1, 2, 9, -1, 0, 0, -1] * 5)
    r = contrast.compare(a, b)
    assert r["average_f1_a"] == pytest.approx(0.6) and r["average_f1_b"] == pytest.approx(0.6) and r["average_delta"] == pytest.approx(0.0)
    low, high = r["per_subset"][0]["delta_ci95"]
    assert low < 0 < high and not r["overall"]["significant"] and r["ood_trend"]["testable"] is False
    runs.write_report(r, tmp_path)
    text = (tmp_path / "comparison.md").read_text()
    assert "| gsm8k | in-dist | 40 | 60.0 | 60.0 | +0.0 |" in text and runs.read_json(tmp_path / "comparison.json")["overall"]["n_solutions"] == 40


def test_bootstrap_covers_the_point(spark):
    c = contrast.cells(aligned(spark, [0, -1] * 50, [0, -1] * 25 + [9, 9] * 25, [0, -1] * 50)).collect()
    out = contrast.bootstrap_cis(c)
    low, high = out["subsets"]["gsm8k"]["f1_a"]
    assert 0.3 < low < 0.5 < high < 0.7 and out["subsets"]["gsm8k"]["f1_b"] == (1.0, 1.0) and out == contrast.bootstrap_cis(c)


def test_cluster_bootstrap(spark):
    df = spark.createDataFrame([("u1", 10, 1, 3, 0, 0), ("u2", 10, 1, 1, 0, 2)], "uid string, n int, s1_a int, s1_x int, s2_a int, s2_x int")
    out = contrast.cluster_bootstrap(df)
    assert out["s1"][0] == pytest.approx(10.0) and out["s1"][1] <= 10 <= out["s1"][2] and out["s2"][0] == pytest.approx(10.0)


def test_cluster_replicates_equal_a_loop(spark):
    import hashlib

    rows = [(None if k == 5 else f"u{k}", k % 4, k % 3, k % 2, 0, k % 5) for k in range(40)]
    df = spark.createDataFrame(rows, "uid string, n int, s1_a int, s1_x int, s2_a int, s2_x int").repartition(3)
    steps = contrast.poisson_steps()
    for r in contrast.cluster_replicates(df, 10, seed=3).collect():
        sums = [0, 0, 0]
        for uid, n, a, x, b, y in rows:
            own = hashlib.md5(":".join([str(3), *([uid] if uid else []), str(r["replicate"] // 4)]).encode()).hexdigest()
            u = int(own[8 * (r["replicate"] % 4) :][:8], 16) / 2**32
            sums = [s + sum(u >= t for t in steps) * v for s, v in zip(sums, (n, x - a, y - b), strict=True)]
        assert (r["s1"], r["s2"]) == pytest.approx((100 * sums[1] / sums[0], 100 * sums[2] / sums[0]))
    plan = contrast.cluster_intervals(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan  # one pass: solutions are not made again for the points
    assert contrast.cluster_intervals(df.limit(0)).isEmpty() and contrast.cluster_intervals(df.where("n = 0")).isEmpty()


@pytest.mark.parametrize("block_values", [7, 10**6])
def test_hash_bootstrap_equals_a_loop(spark, block_values):
    import hashlib

    own = [None if k == 4 else float(k * k) for k in range(23)]
    got = contrast.hash_bootstrap(spark.createDataFrame([*enumerate(own)], "i long, value double"), resamples=70, seed=3, block_values=block_values)
    # draws are many more than values: none of them may be gathered for a broadcast
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        drawn = [own[int(hashlib.md5(f"3:{r['resample']}:{p}".encode()).hexdigest()[:8], 16) % 23] for p in range(23)]
        assert r["mean"] == pytest.approx(sum(x for x in drawn if x is not None) / sum(x is not None for x in drawn))
    assert got.count() == 70 and contrast.hash_bootstrap(spark.createDataFrame([], "i long, value double")).isEmpty()


def test_digests_are_md5():
    import hashlib

    from gradeloom.functions.digests import Digests

    texts = [b"", b"7", b"12345", b"\xc3\xa9t", b"x" * 30, b"abc", b"y" * 70] * 2
    frames = [(b"", b""), (b"17:", b":3"), (b"18:", b":4"), (b"p" * 20, b"s" * 9)]
    for (prefix, suffix), found in zip(frames, Digests(texts).words(frames).transpose(1, 2, 0).tolist(), strict=True):
        for text, own in zip(texts, found, strict=True):
            assert "".join(f"{x:08x}" for x in own) == hashlib.md5(prefix + text + suffix).hexdigest()


def test_similarity_bins(spark):
    t = preds(spark, [1] * 6, [1, 1, 1, 0, 0, 0])
    sims = spark.createDataFrame([(f"u{i:03d}", [i / 10]) for i in range(6)], "uid string, reference_similarities array<double>")
    got = metrics.similarity_bins(t, t, sims).orderBy("bin").collect()
    assert [r["n"] for r in got] == [2, 2, 2] and [r["delta"] for r in got] == [0, 0, 0]
    with pytest.raises(Exception, match="similarities"):
        metrics.similarity_bins(t, t, sims.limit(2)).collect()


def _allocation(limit, e, n):
    if limit >= n:
        return e, n - e
    k = min(e, max(1 if e else 0, round(limit * e / n)))
    c = min(n - e, limit - k)
    return (limit - 1, 1) if n - e and c <= 0 else (k, c)


@settings(max_examples=12, deadline=None)
@given(st.integers(0, 30), st.integers(0, 30), st.integers(2, 40))
def test_samples_nest(spark, errors, clean, limit):
    if errors + clean == 0:
        return
    rows = spark.createDataFrame([(f"u{i:03d}", "s", 0 if i < errors else -1) for i in range(errors + clean)], "uid string, subset string, label int")
    small, large = (sample.stratified_sample(rows, k).collect() for k in (limit, limit + 7))
    got = sum(r["label"] == 0 for r in small), sum(r["label"] == -1 for r in small)
    assert got == _allocation(limit, errors, errors + clean)
    assert {r["uid"] for r in small} <= {r["uid"] for r in large}


def test_steps(spark):
    df = spark.createDataFrame([("u", ["a", "b", "c"])], "uid string, steps array<string>")
    rows = sequences.explode_steps(df).orderBy("step_index").collect()
    assert [(r["step_index"], r["prev_steps"], r["step"]) for r in rows] == [(0, [], "a"), (1, ["a"], "b"), (2, ["a", "b"], "c")]


def test_predictions_and_early_stop(spark):
    rows = [("u", "s", 1, i, i == 2, "math error" if i == 2 else "no error", i) for i in range(4)] + [("v", "s", -1, 0, False, "no error", 5)]
    tr = spark.createDataFrame(rows, "uid string, subset string, gold_label int, step_index int, is_error boolean, error_type string, n_references int")
    got = {r["uid"]: r for r in sequences.predictions(tr).collect()}
    assert (got["u"]["predicted_label"], got["u"]["n_steps_scored"], got["u"]["n_references_used"], got["u"]["predicted_error_type"], got["u"]["correct"]) == (2, 3, 3, "math error", False)
    assert (got["v"]["predicted_label"], got["v"]["predicted_error_type"], got["v"]["correct"]) == (-1, None, True)
    assert sequences.early_stop(tr).count() == 4


def test_harmonic(spark):
    got = [r[0] for r in spark.createDataFrame([(0.6, 0.4), (0.0, 1.0), (None, 1.0)], "a double, b double").select(harmonic("a", "b")).collect()]
    assert got == [pytest.approx(0.48), 0.0, None]


def test_medians_match_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"a": rng.random(501).tolist(), "b": [0.25] * 400 + rng.random(200).tolist(), "c": [0.1, 0.9], "d": [1.0], "e": [0.0, 0.0, 1.0, 1.0]}
    rows = spark.createDataFrame([(k, v) for k, own in groups.items() for v in own] + [("a", None), ("f", None)], "g string, p double")
    got = {r["g"]: r["m"] for r in metrics.median_of_shares(rows, "g", "p", "m").collect()}
    assert got == {k: pytest.approx(float(np.median(v)), abs=1e-15) for k, v in groups.items()}


@pytest.mark.parametrize("slots", [2, 7, 1000])
def test_ecdf_does_not_depend_on_slots(spark, slots):
    values = [("x", float(i % 13), i) for i in range(200)] + [("y", 5.0, i) for i in range(50)] + [("x", None, 900)]
    rows = spark.createDataFrame(values, "g string, v double, i int")
    got = {(r["g"], r["i"]): r["share"] for r in metrics.ecdf(rows, "v", ("g",), "i", slots).collect()}
    for g, n in (("x", 200), ("y", 50)):
        order = sorted((v, i) for k, v, i in values if k == g and v is not None)
        assert [got[g, i] for _, i in order] == [pytest.approx((k + 1) / n) for k in range(n)]


def test_gapless_positions(spark):
    rows = spark.createDataFrame([(k * 7 % 100,) for k in range(100)] + [(None,)], "x int")
    got = {r["x"]: r["at"] for r in sequences.gapless(rows, F.floor(F.col("x") / 9), ["x"], "at").collect()}
    assert got == {None: 0} | {k: k + 1 for k in range(100)}


def test_profiles_need_shared_solutions(spark):
    a, b = preds(spark, [1, -1], [1, 0]), preds(spark, [1, -1], [1, 0], arm="b")
    one = {r["arm"]: r["n_solutions"] for r in metrics.profile_runs(a.union(b.limit(1)), arms=["a", "b"]).collect()}
    assert one == {"a": 1, "b": 1}
    with pytest.raises(ValueError, match="share no"):
        metrics.profile_runs(a.union(b.withColumn("uid", F.concat("uid", F.lit("x")))))
