"""Run folders: predictions and traces as JSON Lines, appended batch by batch, and small driver files."""

from __future__ import annotations

import json
import platform
import subprocess
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contrast import latest
from ..schema import PREDICTION, SEVERITY_NAMES, TRACE
from .benchmark import _exists


def _files(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def commits(spark: SparkSession, folder: str) -> list:
    """The committed batches of a run in their order: (epoch, files, facts)."""
    path = f"{folder}/commits"
    if not _exists(spark, path):
        return []
    fs, own = _files(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(own))
    return [read_json(f"{path}/{n}") for n in names if n.endswith(".json")]


def commit(spark: SparkSession, folder: str, frames: dict[str, DataFrame], facts: Callable[[], dict] | None = None) -> int:
    """Add a batch to a run: write each frame (``predictions``, ``traces``) under the next epoch, then commit all of them at once.

    A batch counts from the moment its manifest has its name, a rename of one small file that names the others;
    readers take committed files only. What a batch leaves behind that was cut off before is overwritten by the
    next one, which has the same epoch. A run has one writer at a time. ``facts`` is asked once the frames are written.
    """
    epoch = max((c["epoch"] for c in commits(spark, folder)), default=-1) + 1
    files = {}
    for what, df in frames.items():
        path = f"{folder}/{what}/epoch={epoch:06d}"
        df.write.mode("overwrite").json(path)
        fs, own = _files(spark, path)
        files[what] = sorted(f"{what}/epoch={epoch:06d}/{s.getPath().getName()}" for s in fs.listStatus(own) if s.getPath().getName().startswith("part-"))
    draft, final = f"{folder}/commits/_{epoch:06d}.tmp", f"{folder}/commits/{epoch:06d}.json"
    write_json({"epoch": epoch, "files": files, "facts": facts() if facts else {}}, draft)
    fs, own = _files(spark, draft)
    if not fs.rename(own, _files(spark, final)[1]):
        raise RuntimeError(f"{final} is there already: another writer has committed this batch")
    return epoch


def begun(spark: SparkSession, folder: str) -> bool:
    """Whether a run has any predictions, of its own batches or made elsewhere."""
    return bool(commits(spark, folder)) or _exists(spark, f"{folder}/predictions.jsonl")


def start_over(spark: SparkSession, folder: str) -> None:
    """Forget all batches of a run; their files are overwritten as new batches come."""
    for what in ("commits", "predictions.jsonl", "traces.jsonl"):
        fs, own = _files(spark, f"{folder}/{what}")
        fs.delete(own, True)


def _ordered(spark: SparkSession, folder: str, what: str) -> DataFrame:
    """All committed rows with ``_line``, their order: by batch, file and place; a plain ``<what>.jsonl`` (a run made elsewhere) comes first."""
    schema = PREDICTION if what == "predictions" else TRACE
    out = spark.createDataFrame([], f"{schema}, _line struct<epoch:int,file:string,start:long,place:long>")
    found = [(c["epoch"], f"{folder}/{f}") for c in commits(spark, folder) for f in c["files"].get(what, [])]
    plain = f"{folder}/{what}.jsonl"
    for paths, epoch in (([plain], F.lit(-1)), ([p for _, p in found], F.regexp_extract("_metadata.file_path", r"epoch=(\d+)", 1).cast("int"))):
        if paths and (paths[0] != plain or _exists(spark, plain)):
            rows = spark.read.schema(schema).json(paths)
            line = F.struct(epoch.alias("epoch"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
            out = out.union(rows.select("*", line.alias("_line")))
    return out


def read_rows(spark: SparkSession, folder: str, what: str = "predictions") -> DataFrame:
    """All rows of committed batches, repeated uids included; no rows if nothing was written yet."""
    return _ordered(spark, folder, what).drop("_line")


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each uid: of repeated ones that of the last batch, and in it the last."""
    return latest(_ordered(spark, folder, "predictions"), "_line").drop("_line")


def pending(solutions: DataFrame, done: DataFrame) -> DataFrame:
    """Solutions without a prediction yet."""
    return solutions.join(done.select("uid"), "uid", "left_anti")


def wanted(predictions: DataFrame, solutions: DataFrame) -> DataFrame:
    """The predictions of ``solutions``, by uid and subset."""
    return predictions.join(solutions.select("uid", "subset"), ["uid", "subset"], "left_semi")


def read_excluded(spark: SparkSession, path: str) -> DataFrame:
    """(uid) of a contamination report: of the table that it names, or of its flagged_uids; an error if it has neither."""
    raw = read_json(path)
    if raw is None or not {"flagged_table", "flagged_uids"} & set(raw):
        raise ValueError(f"{path} has no flagged_uids")
    if raw.get("flagged_table"):
        return spark.read.schema("uid string").json(raw["flagged_table"])
    return spark.createDataFrame([(u,) for u in sorted(raw["flagged_uids"])], "uid string")


def _shared(path: str | Path):
    """(file system, Hadoop path) of a path that lies elsewhere than on the driver's disk, where a session can tell; else None."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    own = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    return None if fs.getScheme() == "file" else (fs, own)


def _local(path: str | Path) -> Path:
    return Path(str(path).removeprefix("file://"))


def read_text(path: str | Path) -> str:
    """A small file's text, from wherever Spark would read it."""
    if not (far := _shared(path)):
        return _local(path).read_text(encoding="utf-8")
    stream = far[0].open(far[1])
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(text: str, path: str | Path) -> None:
    if not (far := _shared(path)):
        _local(path).parent.mkdir(parents=True, exist_ok=True)
        _local(path).write_text(text, encoding="utf-8")
        return
    stream = far[0].create(far[1], True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_json(path: str | Path):
    """A JSON file's content; None if it is missing or damaged."""
    from py4j.protocol import Py4JJavaError

    try:
        return json.loads(read_text(path))
    except (OSError, ValueError):
        return None
    except Py4JJavaError as e:
        if "FileNotFoundException" in str(e.java_exception):
            return None
        raise


def write_json(value, path: str | Path) -> None:
    write_text(json.dumps(value, indent=2, ensure_ascii=False, default=str), path)


def environment(backend: str) -> dict:
    """What a run's summary says about where it was made."""
    git = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True)
    return {"backend": backend, "git": git.stdout.strip() or None, "python": platform.python_version(), "platform": platform.platform()}


def _number(x, scale: float = 100, form: str = ".1f") -> str:
    return "undefined" if x is None else format(scale * x, form)


def _interval(pair) -> str:
    return "undefined" if None in pair else " to ".join(_number(x, form="+.1f") for x in pair)


#: columns of a report's table of subsets: heading, and the cell of a subset's row
_SUBSET_COLUMNS = (
    ("subset", lambda r: r["subset"]),
    ("severity", lambda r: SEVERITY_NAMES.get(r["ood_rank"], "unknown")),
    ("solutions", lambda r: str(r["n"])),
    ("F1 of first", lambda r: _number(r["a"]["f1"])),
    ("F1 of second", lambda r: _number(r["b"]["f1"])),
    ("gain", lambda r: _number(r["delta_f1"], form="+.1f")),
    ("gain, 95 %", lambda r: _interval(r["delta_ci95"])),
    ("McNemar's p", lambda r: _number(r["mcnemar"]["p_value"], 1, ".3f") + (" *" if r["significant"] else "")),
)


def pipes(header: list[str], rows: list[list[str]]) -> list[str]:
    return ["|".join(["", *(f" {c} " for c in cells), ""]) for cells in (header, ["---"] * len(header), *rows)]


def markdown(result: dict) -> str:
    """A comparison (see ``operators.contrast.compare``) in Markdown; F1 from 0 to 100, a star marks p below the level."""
    whole, pooled, trend = result["overall"], result["overall"]["mcnemar_pooled"], result["ood_trend"]
    facts = {
        "first run": result["run_a"], "second run": result["run_b"], "solutions in both": whole["n_solutions"],
        "left out": f"{result['excluded_uids']} ({result['exclusion_label']})" if result["exclusion_label"] else None,
        "mean F1": f"{_number(result['average_f1_a'])}, then {_number(result['average_f1_b'])}",
        "mean gain": f"{_number(result['average_delta'], form='+.1f')} (95 %: {_interval(whole['average_delta_ci95'])})",
        "right in one run only": f"{pooled['a_only']} in the first, {pooled['b_only']} in the second; McNemar's p {pooled['p_value']:.4f}" + ("" if pooled["reliable"] else ", too few to rely on"),
        "without a defined F1": ", ".join(result["undefined_subsets"]) or None,
        "gain over severity": f"{_number(trend['slope_per_ood_rank'], form='+.2f')} a rank, Spearman {trend['spearman']:+.2f}; {trend['interpretation']}" if trend["testable"] else "not tested (fewer than 3 subsets)",
    }
    table = pipes([h for h, _ in _SUBSET_COLUMNS], [[cell(r) for _, cell in _SUBSET_COLUMNS] for r in result["per_subset"]])
    return "\n".join(["# Comparison of two runs", "", *(f"* {k}: {v}" for k, v in facts.items() if v is not None), "", *table, ""])


def chart_rows(result: dict) -> dict[str, list[dict]]:
    """What charts of a comparison show: ``f1`` (subset, run, value, interval) and ``trend`` (gain over severity, with its line)."""
    runs = (("a", result["run_a"], "a_f1_ci95"), ("b", result["run_b"], "b_f1_ci95"))
    f1 = [{"subset": r["subset"], "ood_rank": r["ood_rank"], "run": name, "f1": r[x]["f1"], "low": r[ci][0], "high": r[ci][1]} for r in result["per_subset"] if r["well_defined"] for x, name, ci in runs]
    fit = result["ood_trend"]
    line = lambda x: fit["intercept"] + fit["slope_per_ood_rank"] * x if fit["testable"] else None
    trend = [{"subset": r["subset"], "ood_rank": r["ood_rank"], "gain": r["delta_f1"], "low": r["delta_ci95"][0], "high": r["delta_ci95"][1], "line": line(r["ood_rank"])} for r in result["per_subset"] if r["well_defined"]]
    return {"f1": f1, "trend": trend}


def write_report(result: dict, folder: str | Path, prefix: str = "") -> None:
    write_json(result, f"{folder}/{prefix}comparison.json")
    write_json(chart_rows(result), f"{folder}/{prefix}charts.json")
    write_text(markdown(result), f"{folder}/{prefix}comparison.md")
