"""The retrieval pool: step exemplars parsed from graded chat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import current_step, extract_question, first_turn, judgement, last_turn, previous_steps, question_id
from ..schema import POOL_ITEM
from .benchmark import _exists


def parse_rows(chats: DataFrame) -> DataFrame:
    """Pool items of chat rows (inputs, labels, source, …); rows that lack any part give none. Other columns are kept."""
    user, asked = first_turn("inputs", "user"), last_turn("inputs", "assistant")
    out = chats.withColumns({"question": extract_question(user), "prev_steps": previous_steps(asked), "step": current_step(asked), "_j": judgement(last_turn("labels", "assistant"))})
    out = out.where(F.col("question").isNotNull() & F.col("step").isNotNull() & F.col("_j").isNotNull())
    rest = [c for c in chats.columns if c not in ("inputs", "labels", "source")]
    return out.select(question_id("question").alias("qid"), "question", "prev_steps", "step", "_j.math_ok", "_j.consistency_ok", "_j.correctness_ok", "source", *rest)


def build_pool(chats: DataFrame, most: int | None = 50_000, order: str = "ordinal") -> DataFrame:
    """The first ``most`` parsable rows in the order of ``order`` (an explicit column: Spark has no row order of its own)."""
    items = parse_rows(chats)
    if items.isEmpty():
        raise RuntimeError("no row could be parsed")
    return items.orderBy(order) if most is None else items.orderBy(order).limit(most)


def save_pool(pool: DataFrame, folder: str) -> None:
    """Write the items with their ``ordinal``, the place in the pool's order, by which they can be told apart and ordered again."""
    pool.select(*[f.split()[0] for f in POOL_ITEM.split(", ")], F.monotonically_increasing_id().alias("ordinal")).write.mode("overwrite").json(f"{folder.rstrip('/')}/pool.jsonl")


def load_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The items of a pool, all of them, with their ``ordinal`` (places in the files if the pool was written without)."""
    path = f"{folder.rstrip('/')}/pool.jsonl"
    if not _exists(spark, path):
        raise FileNotFoundError(f"no pool at {path}")
    rows = spark.read.schema(f"{POOL_ITEM}, ordinal long").option("mode", "FAILFAST").json(path)
    return rows.withColumn("ordinal", F.coalesce("ordinal", F.monotonically_increasing_id()))


def save_index(questions: DataFrame, steps: DataFrame, meta: dict, folder: str) -> None:
    """Vectors as Parquet, the model and encoder name as one JSON row."""
    import json

    questions.write.mode("overwrite").parquet(f"{folder}/questions")
    steps.write.mode("overwrite").parquet(f"{folder}/steps")
    questions.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def has_index(spark: SparkSession, folder: str) -> bool:
    return _exists(spark, f"{folder}/meta")


def load_index(spark: SparkSession, folder: str, encoder: str, pool: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """An index, refused if another encoder made it or if it does not match the pool's size."""
    import json

    meta = json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/meta").collect()))
    if meta["encoder"] != encoder:
        raise ValueError(f"the index was made by encoder {meta['encoder']!r}, not {encoder!r}")
    questions, steps = spark.read.parquet(f"{folder}/questions"), spark.read.parquet(f"{folder}/steps")
    if pool is not None and (n := pool.count()) != (m := steps.count()):
        raise ValueError(f"the index holds {m} steps, the pool {n}")
    return questions, steps, meta
