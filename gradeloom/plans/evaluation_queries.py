"""Queries over orders as solutions: first errors, metrics, paired contrasts, profiles. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import average_rank
from ..operators import contrast, metrics, sample, sequences
from ..sources.runs import pending
from .tables import ARMS_SQL, F1_SQL, RANKS, SOLUTIONS_SQL, STEPS_SQL, arm, both_arms, first_flags, severity_sql, solutions, steps, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _r(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


_SCORED = "count(*) AS n, count(*) FILTER (gold_label <> -1) AS n_error, count(*) FILTER (gold_label = -1) AS n_correct, avg(CASE WHEN gold_label <> -1 THEN CASE WHEN {p} = gold_label THEN 1.0 ELSE 0.0 END END) AS ea, avg(CASE WHEN gold_label = -1 THEN CASE WHEN {p} = gold_label THEN 1.0 ELSE 0.0 END END) AS ca"
_SCORES_SQL = SOLUTIONS_SQL + ", m AS (SELECT subset, " + _SCORED.format(p="pred_a") + " FROM j GROUP BY subset)"


@query("WITH " + _SCORES_SQL + f" SELECT subset, n, n_error, n_correct, round(ea, 6) AS error_acc, round(ca, 6) AS correct_acc, round({F1_SQL}, 6) AS f1 FROM m")
def first_error_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: first-error F1 of arm a by subset."""
    return metrics.score_subsets(arm(solutions(spark, sf_dir), "a")).select("subset", "n", "n_error", "n_correct", _r("error_acc"), _r("correct_acc"), _r("f1"))


@query("WITH " + _SCORES_SQL + f""", d AS (SELECT subset, {severity_sql()} AS rank, CASE WHEN subset = '1-URGENT' THEN NULL ELSE {F1_SQL} END AS f1 FROM m)
SELECT round(avg(f1), 6) AS average_f1, count(f1) AS average_over, coalesce(string_agg(CASE WHEN f1 IS NULL THEN subset END, ',' ORDER BY rank), '') AS undefined_subsets, string_agg(subset, ',' ORDER BY rank) AS subset_order FROM d""")
def macro_f1_undefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro average over defined subsets; one subset keeps its erroneous solutions only, so its F1 is undefined."""
    rows = arm(solutions(spark, sf_dir), "a")
    scores = metrics.score_subsets(rows.where((F.col("subset") != "1-URGENT") | (F.col("gold_label") != -1)))
    out = metrics.macro_average(scores, ranks=RANKS)
    return out.select(_r("average_f1"), "average_over", F.array_join("undefined_subsets", ",").alias("undefined_subsets"), F.array_join("subset_order", ",").alias("subset_order"))


@query("WITH " + SOLUTIONS_SQL + " SELECT uid, CAST(gold_label AS BIGINT) AS gold_label, CAST(pred_a AS BIGINT) AS predicted_label, n_steps FROM f")
def first_error_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_flags(spark, sf_dir)
    return rows.select("uid", F.col("gold_label").cast("long").alias("gold_label"), F.col("pred_a").cast("long").alias("predicted_label"), "n_steps")


@query("WITH " + STEPS_SQL + ", w AS (SELECT *, min(CASE WHEN bad_a THEN step_index END) OVER (PARTITION BY uid) AS f FROM s) SELECT uid, CAST(step_index AS BIGINT) AS step_index, bad_a FROM w WHERE f IS NULL OR step_index <= f")
def early_stop_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps that a grader scores that stops at its first flag."""
    return sequences.early_stop(steps(spark, sf_dir), flag="bad_a").select("uid", F.col("step_index").cast("long").alias("step_index"), "bad_a")


_PROFILE = """count(*) AS n_solutions, count(*) FILTER (gold_label = -1) AS n_clean, count(*) FILTER (gold_label <> -1) AS n_error,
round(avg(CASE WHEN gold_label = -1 THEN CASE WHEN predicted_label <> -1 THEN 1.0 ELSE 0.0 END END), 6) AS false_alarm_rate,
round(avg(CASE WHEN gold_label <> -1 THEN CASE WHEN predicted_label = -1 THEN 1.0 ELSE 0.0 END END), 6) AS miss_rate,
round(avg(CASE WHEN gold_label <> -1 AND predicted_label <> -1 THEN CASE WHEN predicted_label = gold_label THEN 1.0 ELSE 0.0 END END), 6) AS exact_rate,
round(avg(CASE WHEN gold_label <> -1 AND predicted_label <> -1 THEN CASE WHEN predicted_label < gold_label THEN 1.0 ELSE 0.0 END END), 6) AS early_rate,
round(avg(CASE WHEN gold_label <> -1 AND predicted_label <> -1 THEN CASE WHEN predicted_label > gold_label THEN 1.0 ELSE 0.0 END END), 6) AS late_rate,
round(avg(CASE WHEN gold_label <> -1 AND predicted_label <> -1 THEN CAST(predicted_label - gold_label AS DOUBLE) END), 6) AS mean_index_offset,
round(avg(n_steps_scored), 6) AS mean_steps_scored, round(avg(n_steps), 6) AS mean_steps_available"""
_PROFILE_COLUMNS = ["false_alarm_rate", "miss_rate", "exact_rate", "early_rate", "late_rate", "mean_index_offset", "mean_steps_scored", "mean_steps_available"]


def _rounded_profile(df: DataFrame) -> DataFrame:
    return df.select("arm", "n_solutions", "n_clean", "n_error", *map(_r, _PROFILE_COLUMNS))


@query("WITH " + ARMS_SQL + f" SELECT arm, {_PROFILE} FROM r GROUP BY arm")
def verdict_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_profile(metrics.verdict_profile(both_arms(solutions(spark, sf_dir)), ("arm",)))


# arm a has met unfinished orders too, arm b only dear ones
_MET_SQL = ARMS_SQL + ", met AS (SELECT * FROM r WHERE CASE WHEN arm = 'a' THEN o_orderstatus <> 'P' ELSE o_totalprice > 50000 END), shared AS (SELECT uid FROM met GROUP BY uid HAVING count(DISTINCT arm) = 2)"


@query("WITH " + _MET_SQL + f" SELECT arm, {_PROFILE} FROM met WHERE uid IN (SELECT uid FROM shared) GROUP BY arm")
def shared_uids_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles over the solutions that both arms have met."""
    met = both_arms(solutions(spark, sf_dir)).where(F.when(F.col("arm") == "a", F.col("o_orderstatus") != "P").otherwise(F.col("o_totalprice") > 50000))
    return _rounded_profile(metrics.profile_runs(met))


def _aligned(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    rows = solutions(spark, sf_dir)
    return contrast.align(arm(rows, "a"), arm(rows, "b"), **more)


@query("WITH " + SOLUTIONS_SQL + " SELECT subset, uid, CAST(gold_label AS BIGINT) AS gold, CAST(pred_a AS BIGINT) AS pred_a, CAST(pred_b AS BIGINT) AS pred_b FROM j")
def align_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms side by side, after the check that they hold the same solutions and gold labels."""
    return _aligned(spark, sf_dir).select("subset", "uid", *(F.col(c).cast("long").alias(c) for c in ("gold", "pred_a", "pred_b")))


@query("WITH " + SOLUTIONS_SQL + " SELECT subset, uid, CAST(gold_label AS BIGINT) AS gold, CAST(pred_a AS BIGINT) AS pred_a, CAST(pred_b AS BIGINT) AS pred_b FROM j WHERE uid NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def exclude_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned solutions without excluded uids."""
    bad = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("uid"))
    return _aligned(spark, sf_dir, exclude=bad, check=False).select("subset", "uid", *(F.col(c).cast("long").alias(c) for c in ("gold", "pred_a", "pred_b")))


_PAIR = "count(*) FILTER (pred_b = gold_label AND pred_a <> gold_label) AS b_only, count(*) FILTER (pred_a = gold_label AND pred_b <> gold_label) AS a_only"


@query("WITH " + SOLUTIONS_SQL + f""", c AS (SELECT subset, {_PAIR} FROM j GROUP BY subset)
SELECT subset, b_only, a_only, b_only + a_only AS discordant, round(CASE WHEN b_only + a_only = 0 THEN 0.0 ELSE power(abs(b_only - a_only) - 1, 2) / (b_only + a_only) END, 6) AS statistic, CASE WHEN b_only + a_only > 0 THEN b_only + a_only >= 25 END AS reliable FROM c""")
def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """McNemar's counts and statistic; the p-value, which DuckDB has no function for, is tested apart."""
    rows = solutions(spark, sf_dir).select("subset", F.col("gold_label").alias("gold"), "pred_a", "pred_b")
    return contrast.mcnemar(rows, ("subset",)).select("subset", "b_only", "a_only", "discordant", _r("statistic"), "reliable")


_EACH = "avg(CASE WHEN gold_label <> -1 THEN CASE WHEN pred_{x} = gold_label THEN 1.0 ELSE 0.0 END END) AS e{x}, avg(CASE WHEN gold_label = -1 THEN CASE WHEN pred_{x} = gold_label THEN 1.0 ELSE 0.0 END END) AS c{x}"
_F1X = "CASE WHEN e{x} IS NULL OR c{x} IS NULL THEN NULL WHEN e{x} <= 0 OR c{x} <= 0 THEN 0 ELSE 2 * e{x} * c{x} / (e{x} + c{x}) END"
_DELTA_SQL = SOLUTIONS_SQL + f""", c AS (SELECT subset, count(*) AS n, {_EACH.format(x="a")}, {_EACH.format(x="b")}, {_PAIR} FROM j GROUP BY subset),
d AS (SELECT subset, n, {severity_sql()} AS ood_rank, {_F1X.format(x="a")} AS f1_a, {_F1X.format(x="b")} AS f1_b, b_only, a_only FROM c),
e AS (SELECT *, f1_b - f1_a AS delta_f1 FROM d),
k AS (SELECT *, rank() OVER (ORDER BY ood_rank) + (count(*) OVER (PARTITION BY ood_rank) - 1) / 2.0 AS rx, rank() OVER (ORDER BY delta_f1) + (count(*) OVER (PARTITION BY delta_f1) - 1) / 2.0 AS ry,
        lag(delta_f1) OVER (ORDER BY ood_rank) AS before FROM e WHERE delta_f1 IS NOT NULL)"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = solutions(spark, sf_dir).select("subset", F.col("gold_label").alias("gold"), "pred_a", "pred_b")
    return contrast.subset_contrast(rows, RANKS)


@query("WITH " + _DELTA_SQL + " SELECT subset, n, CAST(ood_rank AS BIGINT) AS ood_rank, round(f1_a, 6) AS f1_a, round(f1_b, 6) AS f1_b, round(delta_f1, 6) AS delta_f1, b_only, a_only FROM e")
def subset_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir).select("subset", "n", F.col("ood_rank").cast("long").alias("ood_rank"), _r("f1_a"), _r("f1_b"), _r("delta_f1"), "b_only", "a_only")


@query("WITH " + _DELTA_SQL + """ SELECT count(*) >= 3 AS testable, round(regr_slope(delta_f1, ood_rank), 6) AS slope_per_ood_rank, round(regr_intercept(delta_f1, ood_rank), 6) AS intercept,
round(CASE WHEN stddev_pop(ry) = 0 OR stddev_pop(rx) = 0 THEN 0.0 ELSE corr(rx, ry) END, 6) AS spearman, round(max(delta_f1) - min(delta_f1), 6) AS delta_spread, max(delta_f1) - min(delta_f1) < 1e-9 AS degenerate,
NOT coalesce(bool_or(delta_f1 < before), false) AND NOT max(delta_f1) - min(delta_f1) < 1e-9 AS monotonic_increasing FROM k""")
def ood_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contrast.ood_trend(_deltas(spark, sf_dir))
    return out.select("testable", _r("slope_per_ood_rank"), _r("intercept"), _r("spearman"), _r("delta_spread"), "degenerate", "monotonic_increasing")


@query("SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS DOUBLE) AS size_rank FROM part")
def spearman_avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks: parts by size inside their brand."""
    return table(spark, sf_dir, "part").select("p_partkey", average_rank("p_size", "p_brand").cast("double").alias("size_rank"))


@query("WITH " + SOLUTIONS_SQL + " SELECT subset, gold_label <> -1 AS is_error, pred_a = gold_label AS hit_a, pred_b = gold_label AS hit_b, count(*) AS n FROM j GROUP BY ALL")
def contrast_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that bootstrap intervals need."""
    return contrast.cells(solutions(spark, sf_dir).select("subset", F.col("gold_label").alias("gold"), "pred_a", "pred_b"))


@query()
def multinomial_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap intervals of both F1s and their delta, by multinomial draws of the cells."""
    cis = contrast.bootstrap_cis(contrast_cells(spark, sf_dir).collect())  # at most eight rows for each subset
    rows = [(s, k, *v) for s, own in cis["subsets"].items() for k, v in own.items()] + [("average", "delta", *cis["average_delta"])]
    return spark.createDataFrame(rows, "subset string, measure string, low double, high double")


@query("""WITH v AS (SELECT row_number() OVER (ORDER BY doc_id, quality) - 1 AS i, quality FROM labels), n AS (SELECT count(*) AS n FROM v),
d AS (SELECT r.range AS resample, p.range AS place, n FROM n, range(2000) r, range((SELECT n FROM n)) p),
k AS (SELECT resample, CAST(('0x' || substr(md5('0:' || resample || ':' || place), 1, 8)) AS BIGINT) % n AS i FROM d),
m AS (SELECT resample, avg(quality) AS mean FROM k JOIN v USING (i) GROUP BY resample)
SELECT count(*) AS resamples, round(quantile_cont(mean, 0.025), 6) AS low, round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")
def hash_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95 % interval of the labels' mean quality, from 2,000 hash-indexed resamples of all labels."""
    rows = sequences.gapless(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("value")), F.floor(F.col("doc_id") / 10_000), ["doc_id", "value"], "i")
    draws = contrast.hash_bootstrap(rows)
    at = lambda q: F.round(F.percentile("mean", F.lit(q)), 6)
    return draws.agg(F.count("*").alias("resamples"), at(0.025).alias("low"), F.round(F.avg("mean"), 6).alias("mean"), at(0.975).alias("high"))


@query("WITH " + ARMS_SQL + f", m AS (SELECT arm, subset, {_SCORED.format(p='predicted_label')} FROM r GROUP BY arm, subset), a AS (SELECT arm, avg({F1_SQL}) AS f FROM m GROUP BY arm) SELECT arm, round(100 * f, 6) AS average_f1, round(100 * f - 69.5, 6) AS gap FROM a")
def arm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average F1 of each arm and its gap to the anchor."""
    scores = metrics.score_subsets(both_arms(solutions(spark, sf_dir)), by=("arm",))
    return metrics.arm_table(scores).select("arm", _r("average_f1"), _r("gap"))


@query("WITH " + ARMS_SQL + f", m AS (SELECT arm, subset, {_SCORED.format(p='predicted_label')} FROM r GROUP BY arm, subset), v AS (SELECT arm, avg({F1_SQL}) AS f FROM m GROUP BY arm) SELECT x.arm AS a, y.arm AS b, round(y.f - x.f, 6) AS delta FROM v x JOIN v y ON (x.arm, y.arm) IN (('a', 'b'), ('b', 'a'))")
def arm_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrast.contrasts(both_arms(solutions(spark, sf_dir)), [("a", "b"), ("b", "a")]).select("a", "b", _r("delta"))


@query("WITH " + ARMS_SQL + f""", p AS (SELECT arm, {_PROFILE} FROM r GROUP BY arm), u AS (UNPIVOT (SELECT arm, false_alarm_rate, miss_rate, exact_rate, mean_steps_scored FROM p) ON false_alarm_rate, miss_rate, exact_rate, mean_steps_scored INTO NAME metric VALUE value)
SELECT metric, max(CASE WHEN arm = 'a' THEN value END) AS a, max(CASE WHEN arm = 'b' THEN value END) AS b FROM u GROUP BY metric""")
def metric_pivot_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pivot_metrics(verdict_profile(spark, sf_dir), "arm", ["a", "b"], ["false_alarm_rate", "miss_rate", "exact_rate", "mean_steps_scored"])


@query("SELECT o_orderkey AS uid, o_orderpriority AS subset FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions still to be scored: all but the finished ones."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("subset"), "o_orderstatus")
    return pending(orders.select("uid", "subset"), orders.where("o_orderstatus = 'F'"))


@query("WITH e AS (SELECT user_id, max(struct_pack(ts := ts, id := event_id, t := event_type)) AS m, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, m.id AS event_id, m.t AS event_type, n FROM e")
def latest_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of repeated keys the last row wins: each user's latest event."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    out = contrast.latest(rows.withColumn("line_no", F.struct("ts", "event_id")), uid="user_id")
    n = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    return out.join(n, "user_id").select("user_id", "event_id", "event_type", "n")


_SAMPLE_SQL = SOLUTIONS_SQL + """, t AS (SELECT subset, count(*) AS total, count(*) FILTER (gold_label <> -1) AS errors FROM j GROUP BY subset),
q0 AS (SELECT *, least(errors, greatest(CASE WHEN errors > 0 THEN 1 ELSE 0 END, CAST(round_even(100.0 * errors / total, 0) AS BIGINT))) AS e0 FROM t),
q AS (SELECT *, CASE WHEN 100 >= total THEN errors WHEN total - errors > 0 AND least(total - errors, 100 - e0) <= 0 THEN 99 ELSE e0 END AS ne FROM q0),
o AS (SELECT j.subset, uid, gold_label, gold_label <> -1 AS is_error, row_number() OVER (PARTITION BY j.subset, gold_label <> -1 ORDER BY md5('17:' || j.subset || ':' || uid), uid) AS place FROM j)
SELECT o.subset, uid, CAST(gold_label AS BIGINT) AS gold_label FROM o JOIN q USING (subset) WHERE place <= CASE WHEN is_error THEN ne WHEN 100 >= total THEN total ELSE greatest(least(total - errors, 100 - ne), 0) END"""


@query("WITH " + _SAMPLE_SQL)
def stratified_nested_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred solutions of each subset, in proportion (sampling is the feature)."""
    rows = solutions(spark, sf_dir).select("subset", "uid", "gold_label")
    return sample.stratified_sample(rows, 100, label="gold_label").select("subset", "uid", F.col("gold_label").cast("long").alias("gold_label"))


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace rows of both arms, each up to its early stop."""
    rows, gold = steps(spark, sf_dir), first_flags(spark, sf_dir).select("uid", "gold_label")
    two = F.explode(F.array(*(F.struct(F.lit(x).alias("arm"), F.col(f"bad_{x}").alias("is_error")) for x in "ab")))
    rows = rows.select("*", two.alias("_x")).select("*", "_x.*").drop("_x")
    rows = sequences.early_stop(rows, ("uid", "arm"))
    rows = rows.withColumns({"math_ok": F.col("l_quantity") <= 45, "consistency_ok": F.col("l_quantity") >= 4, "correctness_prob": 1 - F.col("l_discount") * 6, "reference_similarities": F.array("l_discount", "l_tax")})
    return rows.join(gold, "uid")


_TRACES_SQL = SOLUTIONS_SQL + """, x AS (SELECT *, 'a' AS arm, bad_a AS is_error FROM s UNION ALL SELECT *, 'b', bad_b FROM s),
w AS (SELECT *, min(CASE WHEN is_error THEN step_index END) OVER (PARTITION BY uid, arm) AS first FROM x),
tr AS (SELECT w.uid, arm, step_index, is_error, gold_label, l_quantity <= 45 AS math_ok, l_quantity >= 4 AS consistency_ok, 1 - l_discount * 6 AS prob, l_discount, l_tax FROM w JOIN f USING (uid) WHERE first IS NULL OR step_index <= first)"""


@query("WITH " + _TRACES_SQL + """, c AS (SELECT uid, step_index FROM tr GROUP BY ALL HAVING count(DISTINCT arm) = 2), z AS (SELECT tr.*, math_ok AND consistency_ok AS passed, gold_label = -1 OR step_index < gold_label AS ok FROM tr SEMI JOIN c USING (uid, step_index))
SELECT arm, count(*) AS steps, count(*) FILTER (ok) AS gold_correct_steps, round(avg(CASE WHEN NOT passed THEN 1.0 ELSE 0.0 END), 6) AS stage1_flag_rate_all, round(avg(CASE WHEN NOT math_ok THEN 1.0 ELSE 0.0 END), 6) AS math_flag_rate_all,
round(avg(CASE WHEN NOT consistency_ok THEN 1.0 ELSE 0.0 END), 6) AS consistency_flag_rate_all, round(avg(CASE WHEN ok THEN CASE WHEN NOT passed THEN 1.0 ELSE 0.0 END END), 6) AS false_flag_stage1,
round(avg(CASE WHEN ok THEN CASE WHEN is_error AND passed THEN 1.0 ELSE 0.0 END END), 6) AS false_flag_stage2, round(avg(CASE WHEN passed THEN prob END), 6) AS p_correct_mean,
round(quantile_cont(CASE WHEN passed THEN prob END, 0.5), 6) AS p_correct_median, round(avg(CASE WHEN passed THEN CASE WHEN prob < 0.5 THEN 1.0 ELSE 0.0 END END), 6) AS p_correct_below_half FROM z GROUP BY arm""")
def stage_flag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.stage_rates(_traces(spark, sf_dir), arms=["a", "b"])
    return out.select("arm", "steps", "gold_correct_steps", *(_r(c) for c in out.columns[3:]))


@query("WITH " + _TRACES_SQL + """, m AS (SELECT uid, avg(v) AS similarity FROM (SELECT uid, unnest([l_discount, l_tax]) AS v FROM tr WHERE arm = 'b') GROUP BY uid),
h AS (SELECT m.uid, similarity, CASE WHEN pred_b = gold_label THEN 1.0 ELSE 0.0 END AS t, CASE WHEN pred_a = gold_label THEN 1.0 ELSE 0.0 END AS b FROM m JOIN f USING (uid)),
k AS (SELECT *, row_number() OVER (ORDER BY round(similarity, 9), uid) AS place, count(*) OVER () AS n FROM h)
SELECT CAST(CASE WHEN place <= round_even(n / 3.0, 0) THEN 1 WHEN place <= round_even(2 * n / 3.0, 0) THEN 2 ELSE 3 END AS BIGINT) AS bin, count(*) AS n, round(avg(similarity), 6) AS mean_similarity, round(avg(b), 6) AS baseline_accuracy, round(avg(t), 6) AS treatment_accuracy, round(avg(t - b), 6) AS delta FROM k GROUP BY 1""")
def similarity_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = solutions(spark, sf_dir)
    traces = _traces(spark, sf_dir).where("arm = 'b'").select("uid", "reference_similarities")
    out = metrics.similarity_bins(arm(rows, "b"), arm(rows, "a"), traces)
    return out.select(F.col("bin").cast("long").alias("bin"), "n", *(_r(c) for c in out.columns[2:]))


@query("SELECT p_partkey, p_brand, round(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) / count(*) OVER (PARTITION BY p_brand), 6) AS share FROM part WHERE p_retailprice IS NOT NULL")
def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ecdf(table(spark, sf_dir, "part"), "p_retailprice", ("p_brand",), "p_partkey").select("p_partkey", "p_brand", _r("share"))


_CLUSTERS_SQL = _TRACES_SQL + """, c AS (SELECT uid, step_index FROM tr GROUP BY ALL HAVING count(DISTINCT arm) = 2),
cl AS (SELECT uid, count(*) FILTER (arm = 'a') AS n, count(*) FILTER (arm = 'a' AND NOT (math_ok AND consistency_ok)) AS s1_a, count(*) FILTER (arm = 'b' AND NOT (math_ok AND consistency_ok)) AS s1_x,
count(*) FILTER (arm = 'a' AND is_error AND math_ok AND consistency_ok) AS s2_a, count(*) FILTER (arm = 'b' AND is_error AND math_ok AND consistency_ok) AS s2_x FROM tr SEMI JOIN c USING (uid, step_index) WHERE gold_label = -1 OR step_index < gold_label GROUP BY uid)"""


@query("WITH " + _CLUSTERS_SQL + " SELECT * FROM cl")
def cluster_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cluster bootstrap resamples: flags by stage and arm of each solution's correct steps."""
    return metrics.cluster_flags(_traces(spark, sf_dir), "a", "b")


_WEIGHT = " + ".join(f"CAST(u >= {t!r} AS INTEGER)" for t in contrast.poisson_steps())


@query("WITH " + _CLUSTERS_SQL + f""", hh AS (SELECT n, s1_x - s1_a AS d1, s2_x - s2_a AS d2, b, md5('17:' || uid || ':' || b) AS h FROM cl, (SELECT range AS b FROM range(500))),
ee AS (SELECT 4 * b + j AS replicate, n, d1, d2, CAST(('0x' || substr(h, CAST(8 * j + 1 AS INTEGER), 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM hh, (SELECT range AS j FROM range(4))),
wt AS (SELECT replicate, n, d1, d2, {_WEIGHT} AS w FROM ee),
rr AS (SELECT replicate, 100.0 * sum(w * d1) / sum(w * n) AS s1, 100.0 * sum(w * d2) / sum(w * n) AS s2 FROM wt GROUP BY replicate)
SELECT 's1' AS stage, (SELECT round(100.0 * sum(s1_x - s1_a) / sum(n), 6) FROM cl) AS point, round(quantile_cont(s1, 0.025), 6) AS low, round(quantile_cont(s1, 0.975), 6) AS high FROM rr
UNION ALL SELECT 's2', (SELECT round(100.0 * sum(s2_x - s2_a) / sum(n), 6) FROM cl), round(quantile_cont(s2, 0.025), 6), round(quantile_cont(s2, 0.975), 6) FROM rr""")
def cluster_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of stage flag differences from 2,000 replicates, resampling whole solutions."""
    return contrast.cluster_intervals(cluster_flags(spark, sf_dir)).select("stage", _r("point"), _r("low"), _r("high"))
