"""Per-subset accuracies, F1 and behaviour profiles, each from one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import gold_ok_step, harmonic, has_error, is_clean, rate
from ..functions.text import error_type as error_type_of
from ..schema import severity


def score_subsets(predictions: DataFrame, subset: str = "subset", gold: str = "gold_label", predicted: str = "predicted_label", by: tuple[str, ...] = ()) -> DataFrame:
    """n, n_error, n_correct, error_acc, correct_acc, f1 for each subset; null wherever nothing was measured."""
    hit = F.col(gold) == F.col(predicted)
    out = predictions.groupBy(*by, subset).agg(
        F.count("*").alias("n"),
        F.count_if(has_error(gold)).alias("n_error"),
        F.count_if(is_clean(gold)).alias("n_correct"),
        rate(hit, has_error(gold)).alias("error_acc"),
        rate(hit, is_clean(gold)).alias("correct_acc"),
    )
    return out.withColumn("f1", harmonic("error_acc", "correct_acc"))


def macro_average(scores: DataFrame, subset: str = "subset", ranks: dict[str, int] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """average_f1 over subsets with a defined F1, how many those are, and which are not (in order of severity)."""
    order = F.struct(severity(subset, ranks).alias("rank"), F.col(subset).alias("subset"))
    names = lambda c: F.transform(F.sort_array(c), lambda x: x["subset"])
    return scores.groupBy(*by).agg(
        F.avg("f1").alias("average_f1"),
        F.count("f1").alias("average_over"),
        names(F.collect_list(F.when(F.col("f1").isNull(), order))).alias("undefined_subsets"),
        names(F.collect_list(order)).alias("subset_order"),
    )


def verdict_profile(predictions: DataFrame, by: tuple[str, ...] = (), gold: str = "gold_label", predicted: str = "predicted_label") -> DataFrame:
    """How a run behaves: false alarms, misses, and where flags fall on erroneous solutions."""
    g, p = F.col(gold), F.col(predicted)
    flagged = (g != -1) & (p != -1)
    return predictions.groupBy(*by).agg(
        F.count("*").alias("n_solutions"),
        F.count_if(g == -1).alias("n_clean"),
        F.count_if(g != -1).alias("n_error"),
        rate(p != -1, g == -1).alias("false_alarm_rate"),
        rate(p == -1, g != -1).alias("miss_rate"),
        rate(p == g, flagged).alias("exact_rate"),
        rate(p < g, flagged).alias("early_rate"),
        rate(p > g, flagged).alias("late_rate"),
        F.avg(F.when(flagged, (p - g).cast("double"))).alias("mean_index_offset"),
        F.avg("n_steps_scored").alias("mean_steps_scored"),
        F.avg("n_steps").alias("mean_steps_available"),
    )


def profile_runs(runs: DataFrame, arm: str = "arm", uid: str = "uid", arms: list | None = None) -> DataFrame:
    """Profiles of all arms over the solutions that every arm has met; an error if there are none.

    With ``arms`` (their names, where the caller knows them) the runs are read once; the profiles, one row
    for each arm, are collected so that the check needs no second pass.
    """
    n = len(arms) if arms is not None else runs.select(arm).distinct().count()
    whole = F.collect_list(F.struct(*runs.columns))
    met = runs.groupBy(F.col(uid).alias("_uid")).agg(whole.alias("_rows"), F.count_distinct(arm).alias("_arms")).where(F.col("_arms") == n)
    found = verdict_profile(met.select(F.inline("_rows")), (arm,))
    rows = found.collect()
    if not rows:
        raise ValueError("the runs share no solutions")
    return runs.sparkSession.createDataFrame(rows, found.schema)


def pool_stats(pool: DataFrame) -> DataFrame:
    """Item and question counts, in all and by error type and by source, from one pass (grouping sets)."""
    kind = error_type_of("math_ok", "consistency_ok")
    rows = pool.select("qid", kind.alias("error_type"), F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source"))
    sets = rows.groupingSets([[F.col("error_type")], [F.col("source")], []], "error_type", "source")
    return sets.agg(F.grouping_id().alias("grouping"), F.count("*").alias("n_items"), F.count_distinct("qid").alias("n_questions"))


def similarity_bins(treatment: DataFrame, baseline: DataFrame, traces: DataFrame, bins: int = 3) -> DataFrame:
    """Accuracies of both arms by equal-frequency bins of mean reference similarity; an error below ``bins`` solutions.

    Bin edges are i * n / bins, halves to even, which differs from ``ntile``; similarities are compared to
    nine decimals, ties in order of uid.
    """
    sims = traces.select("uid", F.explode("reference_similarities").alias("s")).groupBy("uid").agg(F.avg("s").alias("similarity"))
    hit = lambda df, name: df.select("uid", (F.col("predicted_label") == F.col("gold_label")).cast("double").alias(name))
    scored = sims.join(hit(treatment, "t"), "uid").join(hit(baseline, "b"), "uid")
    scored = scored.withColumns({"similarity": F.round("similarity", 9), "_slot": F.floor(F.round("similarity", 9) * 10_000)})
    # ranks inside slots of similarity, shifted by the sizes of lower slots (at most 20,001 rows): no global sort
    lower = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = scored.groupBy("_slot").agg(F.count("*").alias("_n")).select("_slot", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_lower"), F.sum("_n").over(Window.partitionBy()).alias("n_all"))
    place = scored.join(slots, "_slot").withColumn("place", F.col("_lower") + F.row_number().over(Window.partitionBy("_slot").orderBy("similarity", "uid")))
    place = place.withColumn("_fits", F.when(F.col("n_all") < bins, F.raise_error(F.concat(F.lit("only "), F.col("n_all").cast("string"), F.lit(" solutions carry similarities")))).otherwise(True))
    edge = lambda i: F.bround(F.lit(i) * F.col("n_all") / bins)
    own = F.lit(bins)
    for i in reversed(range(1, bins)):
        own = F.when(F.col("place") <= edge(i), i).otherwise(own)
    return place.where("_fits").groupBy(own.alias("bin")).agg(F.count("*").alias("n"), F.avg("similarity").alias("mean_similarity"), F.avg("b").alias("baseline_accuracy"), F.avg("t").alias("treatment_accuracy"), F.avg(F.col("t") - F.col("b")).alias("delta"))


def median_of_counts(counts: DataFrame, by: str, value: str, n: str, name: str) -> DataFrame:
    """Exact medians by group of values in [0, 1] that occur ``n`` times (repeated rows add up), without gathering a group in one task.

    Counts by slot of a ten-thousandth (at most 10,001 a group) tell which slots hold the one or two middle
    places, and only these slots' distinct values are ranked.
    """
    counted = counts.groupBy(by, F.col(value).cast("double").alias("_v")).agg(F.sum(n).alias("_n")).withColumn("_slot", F.floor(F.col("_v") * 10_000))
    own = Window.partitionBy(by)
    slots = counted.groupBy(by, "_slot").agg(F.sum("_n").alias("_size"))
    slots = slots.select(by, "_slot", "_size", F.sum("_size").over(own).alias("_all"), (F.sum("_size").over(own.orderBy("_slot")) - F.col("_size")).alias("_lower"))
    first, second = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    middle = slots.where((F.col("_lower") < second) & (F.col("_lower") + F.col("_size") >= first))
    inside = counted.join(F.broadcast(middle), [by, "_slot"])  # at most two slots a group
    upto = F.col("_lower") + F.sum("_n").over(Window.partitionBy(by, "_slot").orderBy("_v"))
    placed = inside.withColumn("_upto", upto)
    holds = lambda place: F.max(F.when((F.col("_upto") - F.col("_n") < place) & (F.col("_upto") >= place), F.col("_v")))
    return placed.groupBy(by).agg(((holds(first) + holds(second)) / 2).alias(name))


def median_of_shares(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Exact medians of values in [0, 1] by group, null ones left out; see :func:`median_of_counts`."""
    return median_of_counts(rows.where(F.col(value).isNotNull()).withColumn("_one", F.lit(1)), by, value, "_one", name)


def shared_steps(traces: DataFrame, arms: int, arm: str = "arm") -> DataFrame:
    """The rows of steps that ``arms`` arms have scored: a window over each step, one exchange and no join."""
    step = Window.partitionBy("uid", "step_index")
    return traces.withColumn("_arms", F.size(F.collect_set(arm).over(step))).where(F.col("_arms") == arms).drop("_arms")


def cluster_flags(traces: DataFrame, baseline: str, treatment: str, arm: str = "arm") -> DataFrame:
    """(uid, n, s1_a, s1_x, s2_a, s2_x): flags by stage in two arms, over each solution's correct steps that both have scored."""
    rows = shared_steps(traces.where(F.col(arm).isin(baseline, treatment)), 2, arm).where(gold_ok_step("gold_label", "step_index"))
    passed = F.col("math_ok") & F.col("consistency_ok")
    of = lambda x, c: F.count_if((F.col(arm) == x) & c)
    late = F.col("is_error") & passed
    return rows.groupBy("uid").agg(of(baseline, F.lit(True)).alias("n"), of(baseline, ~passed).alias("s1_a"), of(treatment, ~passed).alias("s1_x"), of(baseline, late).alias("s2_a"), of(treatment, late).alias("s2_x"))


def stage_rates(traces: DataFrame, arm: str = "arm", arms: list | None = None) -> DataFrame:
    """Flag rates by stage over the steps that every arm has scored, and the score's mean, median and share below a half.

    With ``arms`` (their names, where the caller knows them) the traces are not read for them first. Shared steps
    are counted by (arm, verdicts, score) once: rates, and the middle scores of the median, come from these counts.
    """
    n = len(arms) if arms is not None else traces.select(arm).distinct().count()
    rows = shared_steps(traces, n, arm)
    passed = F.col("math_ok") & F.col("consistency_ok")
    cells = rows.groupBy(
        arm, gold_ok_step("gold_label", "step_index").alias("_ok"), "math_ok", "consistency_ok", "is_error", F.when(passed, F.col("correctness_prob").cast("double")).alias("_p"),
    ).agg(F.count("*").alias("_n"))
    ok, k, prob = F.col("_ok"), F.col("_n"), F.col("_p")
    share = lambda hit, among: F.try_divide(F.sum(F.when(among & hit, k).otherwise(0)), F.sum(F.when(among, k).otherwise(0)))
    every, scored = F.lit(True), prob.isNotNull()
    cells = cells.persist()  # read for rates, and for the median's slots and places
    rates = cells.groupBy(arm).agg(
        F.sum("_n").alias("steps"),
        F.sum(F.when(ok, k).otherwise(0)).alias("gold_correct_steps"),
        share(~passed, every).alias("stage1_flag_rate_all"),
        share(~F.col("math_ok"), every).alias("math_flag_rate_all"),
        share(~F.col("consistency_ok"), every).alias("consistency_flag_rate_all"),
        share(~passed, ok).alias("false_flag_stage1"),
        share(F.col("is_error") & passed, ok).alias("false_flag_stage2"),
        F.try_divide(F.sum(prob * k), F.sum(F.when(scored, k).otherwise(0))).alias("p_correct_mean"),
        share(prob < 0.5, scored).alias("p_correct_below_half"),
    )
    median = median_of_counts(cells.where(scored), arm, "_p", "_n", "p_correct_median")
    names = [*rates.columns[:-1], "p_correct_median", rates.columns[-1]]
    return rates.join(median, arm, "left").select(*names)


def ecdf(rows: DataFrame, value: str, by: tuple[str, ...], tie: str, slots: int = 1_000) -> DataFrame:
    """Cumulative shares i / n in sorted order; equal values get increasing shares, in the order of ``tie``.

    Places are ranked inside ``slots`` ranges of each group's values and shifted by the sizes of the lower
    ranges. The ranges' edges are approximate quantiles; which rows they part changes the work, not the shares.
    """
    known = rows.where(F.col(value).isNotNull())
    number = F.col(value).cast("double")
    group = F.struct(*by)
    edges = known.groupBy(group.alias("_by")).agg(F.array_distinct(F.percentile_approx(number, [i / slots for i in range(1, slots)], 10 * slots)).alias("_edges"), F.count("*").alias("_all"))
    placed = known.withColumn("_by", group).join(edges, "_by")
    placed = placed.withColumn("_slot", F.size(F.filter("_edges", lambda e: e < number))).drop("_edges")
    sizes = placed.groupBy("_by", "_slot").agg(F.count("*").alias("_size"))
    lower = F.coalesce(F.sum("_size").over(Window.partitionBy("_by").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_by", "_slot", lower.alias("_lower"))
    place = F.row_number().over(Window.partitionBy("_by", "_slot").orderBy(value, tie)) + F.col("_lower")
    return placed.join(sizes, ["_by", "_slot"]).withColumn("share", place / F.col("_all")).drop("_by", "_slot", "_lower", "_all")


def arm_table(scores: DataFrame, arm: str = "arm", anchor: float = 69.5) -> DataFrame:
    """Average F1 of each arm on the 0-100 scale and its gap to a published anchor."""
    return scores.groupBy(arm).agg((100 * F.avg("f1")).alias("average_f1")).withColumn("gap", F.col("average_f1") - anchor)


def comparable_scores(scores: DataFrame, arm: str = "arm", subset: str = "subset", ranks: dict[str, int] | None = None) -> DataFrame:
    """What a chart of arms shows: F1 by arm and subset, only of subsets whose F1 is defined in every arm."""
    arms = scores.select(arm).distinct().count()
    defined = scores.groupBy(subset).agg(F.count("f1").alias("_n")).where(F.col("_n") == arms)
    return scores.join(defined, subset, "left_semi").select(arm, subset, severity(subset, ranks).alias("ood_rank"), "f1")


def pivot_metrics(profiles: DataFrame, arm: str, arms: list[str], metrics: list[str]) -> DataFrame:
    """A row for each metric, a column for each arm."""
    long = profiles.unpivot([arm], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    return long.groupBy("metric").pivot(arm, arms).agg(F.first("value"))
