"""Command line: ``python -m gradeloom COMMAND ...``; each command is one of the plans."""

from __future__ import annotations

import argparse
import json
import sys

from .operators.parity import check_parity
from .plans import evaluation
from .session import build_session
from .sources import benchmark, config, pool, runs


def _overrides(pairs: list[str]) -> dict:
    out = {}
    for p in pairs:
        key, _, value = p.partition("=")
        try:
            out[key] = json.loads(value)
        except ValueError:
            out[key] = value
    return out


def _solutions(spark, c: dict):
    return benchmark.load_benchmark(spark, c["data"]["fixtures_dir"], tuple(c["data"]["subsets"]), c["data"]["limit_per_subset"], c["data"]["sample_seed"])


def _pool(spark, c: dict):
    rows = pool.load_pool(spark, c["data"]["pool_dir"])
    return rows.withColumn("item_id", rows["ordinal"])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gradeloom", description=__doc__)
    parser.add_argument("command", choices=["build-pool", "build-index", "run-eval", "compare-runs", "check-contamination", "check-parity", "error-analysis", "stage-analysis", "plot-arms", "summarize-study", "verify-model-interface", "smoke"])
    parser.add_argument("paths", nargs="*", help="configuration files, run folders or input, as the command needs")
    parser.add_argument("--set", action="append", default=[], metavar="SECTION.KEY=VALUE")
    parser.add_argument("--allow", action="append", default=[], metavar="SECTION.KEY")
    parser.add_argument("--out", default="out")
    parser.add_argument("--contamination")
    parser.add_argument("--batch", type=int, help="solutions of one committed batch of run-eval")
    parser.add_argument("--similarity-bins", nargs=2, metavar=("TREATMENT", "BASELINE"), help="runs or labels, for error-analysis")
    a = parser.parse_args(argv)
    spark = build_session("gradeloom")
    over = _overrides(a.set)
    if a.command == "compare-runs":
        print(runs.markdown(evaluation.compare_runs(spark, *a.paths[:2], a.out, a.contamination)))
    elif a.command == "check-parity":
        result = check_parity(spark, config.load(a.paths[0], over), config.load(a.paths[1], over), tuple(a.allow))
        print("\n".join(result["problems"]) or "parity holds: " + ", ".join(result["arm_differences"] + result["ablations"]))
        return int(not result["ok"])
    elif a.command == "summarize-study":
        print(json.dumps(evaluation.summarize_study(spark, a.paths, a.out), indent=2))
    elif a.command == "plot-arms":
        evaluation.arms_chart(spark, a.paths, a.out).orderBy("ood_rank", "subset", "arm").show(truncate=False)
    elif a.command == "verify-model-interface":
        c = config.load(a.paths[0], over) if a.paths else config.resolve({}, over)
        checks = evaluation.verify_interface(spark, c["prompt"]["prompt_prefix"])
        print("\n".join(f"{'holds' if ok else 'FAILS'}: {what}" for what, ok in checks))
        return int(not all(ok for _, ok in checks))
    elif a.command == "error-analysis":
        found = evaluation.error_analysis(spark, a.paths, f"{a.out}/error_analysis.json", a.similarity_bins)
        print(evaluation.profile_table(found["profiles"]))
        print("\n".join(json.dumps(r) for r in found.get("similarity_bins", [])))
    elif a.command == "stage-analysis":
        print(json.dumps(evaluation.stage_analysis(spark, a.paths, f"{a.out}/stage_analysis.json"), indent=2))
    else:
        c = config.load(a.paths[0], over)
        if a.command == "build-pool":
            from pyspark.sql import functions as F

            from .schema import CHAT_ROW

            chats = spark.read.schema(CHAT_ROW).json(a.paths[1]).withColumn("ordinal", F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")))
            pool.save_pool(pool.build_pool(chats, c["data"]["pool_max_items"]), c["data"]["pool_dir"])
            print(json.dumps(evaluation.write_pool_stats(pool.load_pool(spark, c["data"]["pool_dir"]), f"{c['data']['pool_dir']}/pool.stats.json")))
        elif a.command == "build-index":
            r = c["retrieval"]
            pool.save_index(*evaluation.build_index(_pool(spark, c), r["encoder_name"], r["pca_components"] or 0, r["pca_whiten"]), r["index_dir"])
        elif a.command == "run-eval":
            folder = f"{c['run']['out_dir']}/{c['run']['name']}"
            print(json.dumps(evaluation.run_evaluation(spark, _solutions(spark, c), c, folder, _pool(spark, c) if c["retrieval"]["enabled"] else None, a.batch)))
        elif a.command == "check-contamination":
            print(json.dumps(evaluation.check_contamination(spark, _solutions(spark, c), _pool(spark, c), c, f"{a.out}/contamination.json")["total"]))
        else:
            print(json.dumps(evaluation.smoke(spark, _solutions(spark, c), _pool(spark, c), a.out)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
