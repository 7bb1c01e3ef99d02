"""Schemas of the engine's tables, and the conventions that hold in all of them.

``label`` is the 0-based index of the first wrong step, -1 for a clean solution (never null). A rate over
no rows is null, not zero. Subsets are ordered by how far they lie from the training data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOLUTION = "uid string, subset string, problem string, steps array<string>, label int, final_answer_correct boolean, generator string"
POOL_ITEM = "qid string, question string, prev_steps array<string>, step string, math_ok boolean, consistency_ok boolean, correctness_ok boolean, source string"
CHAT_ROW = "inputs array<struct<role:string,content:string>>, labels array<struct<role:string,content:string>>, source string"
PREDICTION = "uid string, subset string, gold_label int, predicted_label int, n_steps int, n_steps_scored int, predicted_error_type string, n_references_used int, correct boolean"
TRACE = (
    "uid string, subset string, step_index int, gold_label int, is_error boolean, math_ok boolean, consistency_ok boolean, "
    "correctness_prob double, n_references int, error_type string, reference_qids array<string>, reference_similarities array<double>"
)
REFERENCE = "struct<qid:string,question:string,step:string,math_ok:boolean,consistency_ok:boolean,question_similarity:double,step_similarity:double>"

# fixed values: the subsets of the benchmark, from in-distribution to extreme
SEVERITY = {"gsm8k": 0, "math": 1, "olympiadbench": 2, "omnimath": 3}
SEVERITY_NAMES = {0: "in-dist", 1: "moderate", 2: "severe", 3: "extreme"}
UNKNOWN_SEVERITY = 99


def severity(subset: Column | str, ranks: dict[str, int] | None = None) -> Column:
    """The rank of a subset; unknown ones come last."""
    subset = F.col(subset) if isinstance(subset, str) else subset
    out = F.lit(UNKNOWN_SEVERITY)
    for name, rank in (SEVERITY if ranks is None else ranks).items():
        out = F.when(subset == name, F.lit(rank)).otherwise(out)
    return out
