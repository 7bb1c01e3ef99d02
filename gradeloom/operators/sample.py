"""Stratified, seeded, nested samples of solutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def allocation(limit: int, errors, total):
    """How many erroneous rows a sample of ``limit`` takes: in proportion, halves to even, none of both kinds left out."""
    clean = total - errors
    share = F.bround(F.lit(limit) * errors / total).cast("long")
    took = F.least(errors, F.greatest(F.when(errors > 0, 1).otherwise(0).cast("long"), share))
    left = F.least(clean, F.lit(limit).cast("long") - took)
    return F.when(F.lit(limit) >= total, errors).when((clean > 0) & (left <= 0), F.lit(limit).cast("long") - 1).otherwise(took)


def stratified_sample(solutions: DataFrame, limit: int, seed: int = 17, subset: str = "subset", uid: str = "uid", label: str = "label") -> DataFrame:
    """``limit`` solutions of each subset, erroneous and clean in proportion (all of a subset that has no more).

    The order of a stratum is that of md5(seed:subset:uid), so samples are nested in one another and do
    not depend on the order of rows. One shuffle by stratum; the counts come from partial ones.
    """
    if limit <= 0:
        raise ValueError("the limit must be positive")
    rows = solutions.withColumn("_error", F.col(label) != -1)
    counts = rows.groupBy(subset).agg(F.count("*").alias("_total"), F.count_if("_error").alias("_errors"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(subset), F.col(uid).cast("string")).cast("binary"))
    place = F.row_number().over(Window.partitionBy(subset, "_error").orderBy("_key", uid))
    quota = allocation(limit, F.col("_errors"), F.col("_total"))
    clean_quota = F.when(F.lit(limit) >= F.col("_total"), F.col("_total")).otherwise(F.greatest(F.least(F.col("_total") - F.col("_errors"), F.lit(limit) - quota), F.lit(0)))
    # a stratum never gives more than the limit, so ranks beyond it are dropped before counts are joined
    ranked = rows.withColumn("_key", key).withColumn("_place", place).where(F.col("_place") <= limit)
    picked = ranked.join(counts, subset).where(F.col("_place") <= F.when(F.col("_error"), quota).otherwise(clean_quota))
    return picked.select(*solutions.columns)
