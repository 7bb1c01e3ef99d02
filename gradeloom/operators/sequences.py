"""Step sequences: exploding, prefix contexts, first errors and early stops.

All that orders steps inside a solution uses one window specification (uid, step_index), so a plan that
chains these operators needs one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_steps(solutions: DataFrame, steps: str = "steps") -> DataFrame:
    """A row for each step, with its index and the steps before it."""
    return solutions.select("*", F.posexplode(steps).alias("step_index", "step")).withColumn("prev_steps", F.slice(F.col(steps), F.lit(1), F.col("step_index")))


def prefix_contexts(steps: DataFrame, uid: str = "uid", order: str | list[str] = "step_index", step: str = "step") -> DataFrame:
    """The same for steps that are already rows: ``prev_steps`` gathers the earlier rows of the sequence."""
    orders = [order] if isinstance(order, str) else order
    before = Window.partitionBy(uid).orderBy(*orders).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("prev_steps", F.collect_list(step).over(before))


def numbered(rows: DataFrame, uid: str, order: list[str], name: str = "step_index") -> DataFrame:
    """0-based positions inside each sequence; ``order`` must tell rows of a sequence apart."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(uid).orderBy(*order)) - 1)


def gapless(rows: DataFrame, slot: Column, order: list[str], name: str) -> DataFrame:
    """0-based positions over all rows in the order of ``slot``, then ``order``: ranked inside slots, shifted by the lower slots' sizes."""
    rows = rows.withColumn("_slot", slot)
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_slot").agg(F.count("*").alias("_n")).select("_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lower"))
    place = F.row_number().over(Window.partitionBy("_slot").orderBy(*order)) - 1 + F.col("_lower")
    own = sizes.withColumnRenamed("_slot", "_of")
    return rows.join(own, F.col("_slot").eqNullSafe(F.col("_of"))).withColumn(name, place).drop("_slot", "_of", "_lower")


def first_where(condition: Column, index: str = "step_index") -> Column:
    """The first index where the condition holds, -1 if nowhere. An aggregate."""
    return F.coalesce(F.min(F.when(condition, F.col(index))), F.lit(-1))


def first_error(steps: DataFrame, uid: str = "uid", flag: str = "is_error", index: str = "step_index", error_type: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per solution: predicted_label, n_steps and the flagged step's error type (null if none is)."""
    flagged = F.when(F.col(flag), F.col(index))
    more = [F.min_by(error_type, flagged).alias("predicted_error_type")] if error_type else []
    return steps.groupBy(uid, *keep).agg(F.coalesce(F.min(flagged), F.lit(-1)).alias("predicted_label"), F.count("*").alias("n_steps"), *more)


def early_stop(steps: DataFrame, uid: str | tuple[str, ...] = "uid", flag: str = "is_error", index: str = "step_index") -> DataFrame:
    """The steps that a grader that stops at its first flag has scored."""
    first = F.min(F.when(F.col(flag), F.col(index))).over(Window.partitionBy(*([uid] if isinstance(uid, str) else uid)))
    return steps.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(index) <= F.col("_first"))).drop("_first")


def predictions(scored: DataFrame, stop_early: bool = True) -> DataFrame:
    """Predictions from trace rows (uid, subset, gold_label, step_index, is_error, error_type, n_references).

    ``n_steps``, if the rows have it, is how many steps the solution has; else all of them have to be there.
    """
    whole = F.first("n_steps") if "n_steps" in scored.columns else F.count("*")
    flagged = F.when(F.col("is_error"), F.col("step_index"))
    one = ("uid", "subset")
    rows = early_stop(scored, one) if stop_early else scored
    if stop_early and "n_steps" not in scored.columns:
        rows = early_stop(scored.withColumn("n_steps", F.count("*").over(Window.partitionBy(*one))), one)
        whole = F.first("n_steps")
    out = rows.groupBy("uid", "subset", "gold_label").agg(
        F.coalesce(F.min(flagged), F.lit(-1)).alias("predicted_label"),
        whole.cast("int").alias("n_steps"),
        F.count("*").cast("int").alias("n_steps_scored"),
        F.min_by("error_type", flagged).alias("predicted_error_type"),
        F.sum("n_references").cast("int").alias("n_references_used"),
    )
    return out.withColumn("correct", F.col("gold_label") == F.col("predicted_label"))
