"""The configuration-parity gate: two runs may differ in what makes their arms, and in nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: what must be equal between two arms, and what makes an arm
LOCKED_SECTIONS = ("prm", "prompt")
LOCKED_DATA = ("subsets", "limit_per_subset", "processbench_id", "fixtures_dir", "sample_seed")
ARM_KEYS = ("enabled", "reference_mode")
FREE_RETRIEVAL = ("enabled", "reference_mode", "random_seed")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys whose values differ between two flattened configurations (section, key, value), nulls and absences included."""
    x, y = a.withColumnRenamed("value", "value_a"), b.withColumnRenamed("value", "value_b")
    return x.join(y, ["section", "key"], "full_outer").where(~F.col("value_a").eqNullSafe(F.col("value_b")))


def problems(differences: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """Differences that break parity. ``allow`` declares ``section.key`` of an ablation, in locked sections only."""
    section, key = F.col("section"), F.col("key")
    locked = section.isin(*LOCKED_SECTIONS) & ~F.concat_ws(".", section, key).isin(*(allow or ("",)))
    data = (section == "data") & key.isin(*LOCKED_DATA)
    retrieval = (section == "retrieval") & ~key.isin(*FREE_RETRIEVAL)
    return differences.where(locked | data | retrieval)


def check_parity(spark: SparkSession, config_a, config_b, allow: tuple[str, ...] = ()) -> dict:
    """{ok, problems, arm_differences, ablations} for two configurations; the same arm twice is a problem too."""
    from ..sources.config import flatten

    rows = diff(flatten(spark, config_a), flatten(spark, config_b)).cache()
    try:
        bad = [f"{r['section']}.{r['key']}: A={r['value_a']} B={r['value_b']}" for r in problems(rows, allow).orderBy("section", "key").collect()]
        named = [tuple(r) for r in rows.select("section", "key").collect()]
    finally:
        rows.unpersist()
    arms = [k for k in ARM_KEYS if ("retrieval", k) in named]
    ablated = sorted(f"{s}.{k}" for s, k in named if s in LOCKED_SECTIONS and f"{s}.{k}" in allow)
    if not arms and not ablated:
        bad.append("both configurations describe the same arm")
    return {"ok": not bad, "problems": bad, "arm_differences": arms, "ablations": ablated}
