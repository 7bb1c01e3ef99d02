"""Scoring step rows: the deterministic scorer natively, costly graders through a plug-in that stops early."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.measures import is_error, stage1_error
from ..functions.text import MASK, NEG, POS, advance_to_correctness, assistant_turn, error_type, messages, user_turn
from ..functions.vectors import mock_verdict
from ..schema import REFERENCE
from .sequences import early_stop

_GRADERS: dict[str, tuple[str, Callable]] = {}
_COUNTERS: dict[str, Callable] = {}
#: solutions that a task has open at once: the size of a grader's batches
OPEN = 32
_VERDICT = "math_ok boolean, consistency_ok boolean, correctness_prob double"


def register_grader(name: str, make: Callable[[], Callable[[str, list[str], str, list], tuple[bool, bool, float | None]]], count_tokens: Callable | None = None) -> None:
    """Make a grader of single steps known: ``make`` returns score(question, prev_steps, step, references). See :func:`register_batch_grader`."""

    def batches():
        score = make()
        return lambda rows: [score(r["question"], r["prev_steps"], r["step"], r["references"]) for r in rows]

    register_batch_grader(name, batches, count_tokens)


def register_batch_grader(name: str, make: Callable[[], Callable[[list[dict]], list[tuple[bool, bool, float | None]]]], count_tokens: Callable | None = None) -> None:
    """Make a grader known. ``make`` runs once in each Python worker and returns a function of a batch of steps.

    Steps are dictionaries of question, prev_steps, step, references, and the prompts ``first`` and ``second`` (the
    one that asks for the correctness of a step that the first pass did not flag). ``count_tokens`` gives the tokens
    of each text of an array column, for runs with a token budget.
    """
    _GRADERS[name] = f"{name}-{uuid.uuid4().hex}", make
    _COUNTERS.pop(name, None)
    if count_tokens:
        _COUNTERS[name] = count_tokens


def token_counter(name: str) -> Callable | None:
    """How a grader's prompts are counted, if it has said so."""
    return _COUNTERS.get(name)


def two_stage(stage1: Callable[[list[str]], list], stage2: Callable[[list[str]], list], token_ids: Callable[[str], list[int]] | None = None) -> Callable[[list[dict]], list[tuple]]:
    """A batch grader from a model's logits: for each prompt ``(yes, no)`` at both masks of the first pass, then at the correctness mask.

    A step that the first pass flags gets no score and is not in the second pass; the score of the others is the
    softmax over both logits. Prompts whose masks are not where they have to be are errors, and so is a tokenizer
    (``token_ids``) for which a mask or verdict is not one token.
    """
    for t in (MASK, POS, NEG) if token_ids else ():
        if len(token_ids(t)) != 1:
            raise ValueError(f"{t} is not one token of this model")

    def asked(rows: list[dict], which: str, masks: int) -> list[str]:
        prompts = [r[which] for r in rows]
        if any(p.count(MASK) != masks for p in prompts):
            raise ValueError(f"a prompt of the {which} pass does not hold {masks} mask tokens")
        return prompts

    def score(rows: list[dict]) -> list[tuple]:
        import math

        first = [tuple(bool(yes >= no) for yes, no in x) for x in stage1(asked(rows, "first", 2))]
        rest = [k for k, x in enumerate(first) if all(x)]
        out: list[tuple] = [(*x, None) for x in first]
        if rest:
            for k, (yes, no) in zip(rest, stage2(asked([rows[k] for k in rest], "second", 1)), strict=True):
                out[k] = (True, True, 1 / (1 + math.exp(min(700.0, no - yes))))
        return out

    return score


def score_mock(steps: DataFrame, threshold: float = 0.5, seed: int = 17, prefix: str = "", check_prompts: bool = True, **style) -> DataFrame:
    """Trace columns for ``steps(uid, subset, gold_label, question, prev_steps, step, step_index, references)``.

    Prompts are built and their masks checked as for a real grader; the verdict is a hash and means nothing.
    """
    n = F.coalesce(F.size("references"), F.lit(0)) if "references" in steps.columns else F.lit(0)
    refs = F.col("references") if "references" in steps.columns else None
    out = steps.withColumn("n_references", n)
    if check_prompts:
        out = out.withColumn("messages", messages(user_turn(prefix, "question", refs, **style), assistant_turn("prev_steps", "step")))
    out = out.withColumn("_v", mock_verdict("question", "step", "n_references", seed)).select("*", "_v.*").drop("_v")
    return out.withColumns({"is_error": is_error("math_ok", "consistency_ok", "correctness_prob", threshold), "error_type": error_type("math_ok", "consistency_ok")})


_MADE: dict = {}


def _made(key: str, make: Callable):
    """``make()``, once in a Python worker for each ``key``: a model is loaded once for all tasks that the worker gets."""
    if key not in _MADE:
        _MADE.clear()  # one model fits at a time
        _MADE[key] = make()
    return _MADE[key]


def wave(solutions, score: Callable, threshold: float, stop_early: bool, most: int):
    """(solution's steps so far, verdict) of each step that is scored, in batches of the next step of every open solution.

    ``solutions`` yields lists of a solution's steps in order; as soon as one is done (flagged, or at its end) the
    next is opened, so that batches stay full and nothing behind a flag is ever scored.
    """
    solutions, open_ = iter(solutions), []
    while True:
        while len(open_) < most and (steps := next(solutions, None)):
            open_.append((steps, 0))
        if not open_:
            return
        batch = [steps[at] for steps, at in open_]
        verdicts = score(batch)
        if len(verdicts) != len(batch):
            raise ValueError(f"the grader gave {len(verdicts)} verdicts for {len(batch)} steps")
        going = []
        for (steps, at), (m, c, p) in zip(open_, verdicts, strict=True):
            bad = not (m and c) or (p is not None and p < threshold)
            yield steps[at], (bool(m), bool(c), None if p is None else float(p), bad)
            if at + 1 < len(steps) and not (bad and stop_early):
                going.append((steps, at + 1))
        open_ = going


def score_with(steps: DataFrame, backend: str, threshold: float = 0.5, stop_early: bool = True, open_solutions: int = OPEN, prefix: str = "", seed: int = 17, **style) -> DataFrame:
    """Trace rows of the steps that a grader that stops at its first flag scores, with all columns of ``steps``.

    ``mock`` is the native scorer; any other name must be registered, there is no fallback. A solution's steps meet
    in one task in their order; a worker loads its model once and scores batches of the next step of each of
    ``open_solutions`` solutions.
    """
    if backend == "mock":
        scored = score_mock(steps, threshold, seed, prefix, **style)
        return early_stop(scored, ("uid", "subset")) if stop_early else scored
    if backend not in _GRADERS:
        raise ValueError(f"unknown grader {backend!r}; known: {sorted(['mock', *_GRADERS])}")
    key, make = _GRADERS[backend]
    if "references" not in steps.columns:
        steps = steps.withColumn("references", F.lit(None).cast(f"array<{REFERENCE}>"))
    user, asked = user_turn(prefix, "question", F.col("references"), **style), assistant_turn("prev_steps", "step")
    rows = steps.withColumn("_m", messages(user, asked))
    turns = lambda last: F.concat(F.col("_m")[0]["content"], F.lit("\n"), last)
    rows = rows.withColumns({"first": turns(F.col("_m")[1]["content"]), "second": turns(advance_to_correctness(F.col("_m")[1]["content"], [POS, POS]))})
    ready = rows.select("uid", "subset", "step_index", F.struct("question", "prev_steps", "step", "references", "first", "second").alias("step"), F.struct(*(c for c in steps.columns)).alias("kept"))

    def run(batches):
        import pyarrow as pa

        def solutions():
            uid, own = None, []
            for b in batches:
                kept = b.column("kept")
                names = zip(b.column("uid").to_pylist(), b.column("subset").to_pylist(), strict=True)
                for k, (u, s) in enumerate(zip(names, b.column("step").to_pylist(), strict=True)):
                    if own and u != uid:
                        yield own
                        own = []
                    uid = u
                    own.append({**s, "references": s["references"] or [], "kept": kept.slice(k, 1)})
            if own:
                yield own

        out: list[tuple] = []

        def batch():
            verdicts = [v for _, v in out]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([s["kept"] for s, _ in out]), *(pa.array([v[k] for v in verdicts], t) for k, t in enumerate((pa.bool_(), pa.bool_(), pa.float64(), pa.bool_())))], names=["kept", "math_ok", "consistency_ok", "correctness_prob", "is_error"])

        for x in wave(solutions(), _made(key, make), threshold, stop_early, open_solutions):
            out.append(x)
            if len(out) >= 512:
                yield batch()
                out.clear()
        if out:
            yield batch()

    schema = f"kept {ready.schema['kept'].dataType.simpleString()}, {_VERDICT}, is_error boolean"
    scored = ready.repartition("uid", "subset").sortWithinPartitions("uid", "subset", "step_index").mapInArrow(run, schema).select("kept.*", "math_ok", "consistency_ok", "correctness_prob", "is_error")
    return scored.withColumns({"n_references": F.coalesce(F.size("references"), F.lit(0)), "error_type": error_type("math_ok", "consistency_ok")})


def score_in_two_passes(steps: DataFrame, stage1: Callable, stage2: Callable, threshold: float = 0.5, prefix: str = "", **style) -> DataFrame:
    """All steps (no early stop), each pass of a model over a whole table: the second reads only the steps that the first did not flag.

    ``stage1`` and ``stage2`` make, once a worker, functions of a list of prompts; see :func:`two_stage` for what they return.
    """
    if "references" not in steps.columns:
        steps = steps.withColumn("references", F.lit(None).cast(f"array<{REFERENCE}>"))
    rows = steps.withColumn("_m", messages(user_turn(prefix, "question", F.col("references"), **style), assistant_turn("prev_steps", "step")))

    def passed(df: DataFrame, last, make: Callable, columns: str, verdict: Callable) -> DataFrame:
        """``df`` with the columns that ``verdict`` makes of the model's logits; the worker's model is asked for a batch at a time."""
        key, kept = uuid.uuid4().hex, df.columns
        rows = df.withColumn("_p", F.concat(F.col("_m")[0]["content"], F.lit("\n"), last))

        def run(batches):
            import pyarrow as pa

            model = _made(key, make)
            for b in batches:
                if b.num_rows:
                    new = zip(*(verdict(x) for x in model(b.column("_p").to_pylist())), strict=True)
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *map(pa.array, new)], names=[*kept, *(c.split()[0] for c in columns.split(", "))])

        return rows.mapInArrow(run, T.StructType([*df.schema.fields, *T.StructType.fromDDL(columns).fields]))

    def softmax(logits) -> tuple[float]:
        import math

        yes, no = logits
        return (1 / (1 + math.exp(min(700.0, no - yes))),)

    turn = F.col("_m")[1]["content"]
    first = passed(rows, turn, stage1, "math_ok boolean, consistency_ok boolean", lambda x: tuple(bool(yes >= no) for yes, no in x))
    flagged = stage1_error("math_ok", "consistency_ok")
    ok = passed(first.where(~flagged), advance_to_correctness(turn, [POS, POS]), stage2, "correctness_prob double", softmax)
    out = first.where(flagged).withColumn("correctness_prob", F.lit(None).cast("double")).unionByName(ok).drop("_m")
    return out.withColumns({"n_references": F.coalesce(F.size("references"), F.lit(0)), "is_error": is_error("math_ok", "consistency_ok", "correctness_prob", threshold), "error_type": error_type("math_ok", "consistency_ok")})
