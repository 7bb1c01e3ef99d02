"""Benchmark solutions: JSON Lines or JSON arrays, one file for each subset."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sample import stratified_sample
from ..operators.sequences import gapless
from ..schema import SEVERITY, SOLUTION, severity

REQUIRED = ("problem", "steps", "label")
_RAW = "id string, problem string, steps array<string>, label int, final_answer_correct boolean, generator string"


def _exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def read_subset(spark: SparkSession, folder: str, subset: str, array: bool = False) -> DataFrame:
    """Solutions of ``<folder>/<subset>.jsonl`` (or ``.json``, one array); a missing file has no rows, blank lines are skipped."""
    path = f"{folder.rstrip('/')}/{subset}.{'json' if array else 'jsonl'}"
    if not _exists(spark, path):
        return spark.createDataFrame([], SOLUTION)
    if array:
        found = spark.read.option("multiLine", True).json(path).columns
        raw = spark.read.option("multiLine", True).schema(_RAW).json(path)
    else:
        lines = spark.read.text(path).where(F.trim("value") != "")
        first = lines.first()
        found = [*json.loads(first[0])] if first else [*REQUIRED]
        raw = lines.select(F.from_json("value", _RAW).alias("r")).select("r.*")
    if missing := [c for c in REQUIRED if c not in found]:
        raise KeyError(f"{path} lacks {missing}; it has {sorted(found)}")
    # ids count rows inside each split of the file in their low 33 bits: positions go on from split to split
    placed = gapless(raw.withColumn("_id", F.monotonically_increasing_id()), F.shiftright("_id", 33), ["_id"], "_at")
    return normalise(placed, subset, "_at")


def normalise(raw: DataFrame, subset: str, position: str) -> DataFrame:
    """Rows as solutions; an empty or missing id becomes ``<subset>-<position>``, a label out of range is an error."""
    uid = F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit(f"{subset}-"), F.col(position).cast("string")))
    label = F.col("label").cast("int")
    bad = label.isNull() | (label < -1) | (F.coalesce(F.size("steps"), F.lit(0)) <= 0) | (label >= F.size("steps"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("label out of range or no steps in "), uid))).otherwise(label)
    return raw.select(uid.alias("uid"), F.lit(subset).alias("subset"), "problem", "steps", checked.cast("int").alias("label"), "final_answer_correct", "generator")


def load_benchmark(spark: SparkSession, folder: str, subsets: tuple[str, ...] = tuple(SEVERITY), limit: int | None = None, seed: int = 17, array: bool = False) -> DataFrame:
    """All subsets, sampled if ``limit`` is given, in order of severity; an error if nothing is found."""
    out = read_subset(spark, folder, subsets[0], array)
    for s in subsets[1:]:
        out = out.unionByName(read_subset(spark, folder, s, array))
    if out.isEmpty():
        raise RuntimeError(f"no solutions in {folder} for {list(subsets)}")
    out = stratified_sample(out, limit, seed) if limit else out
    return out.orderBy(severity("subset"), "uid")
