"""Run configurations: nested dictionaries over known keys, read from YAML or JSON on the driver."""

from __future__ import annotations

import copy
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..schema import SEVERITY
from .runs import read_text, write_text

# fixed values: all keys and their defaults, as existing configuration files use them
DEFAULTS: dict[str, dict] = {
    "run": {"name": "unnamed", "out_dir": "runs", "save_traces": True, "log_every": 25, "resume": False},
    "data": {
        "processbench_id": "Qwen/ProcessBench", "subsets": [*SEVERITY], "limit_per_subset": None, "fixtures_dir": None, "sample_seed": 17,
        "pool_id": "declare-lab/PathFinder-600K", "pool_split": "train", "pool_max_items": 50_000, "pool_dir": "data/pool",
    },
    "retrieval": {
        "enabled": True, "encoder_name": "sentence-transformers/all-MiniLM-L6-v2", "encoder_batch_size": 128, "normalize": True, "pca_components": 128, "pca_whiten": False,
        "top_k_questions": 8, "top_k_steps": 2, "step_level": True, "reference_mode": "retrieved", "random_seed": 17,
        "max_question_similarity": 0.95, "drop_exact_duplicates": True, "index_dir": "artifacts/index",
    },
    "prm": {
        "backend": "hf", "int4_group_size": 64, "int4_packing_format": "tile_packed_to_4d", "model_name": "declare-lab/PathFinder-PRM-7B", "dtype": "bfloat16", "device_map": "auto",
        "attn_implementation": "auto", "trust_remote_code": True, "max_memory": None, "offload_folder": None, "correctness_threshold": 0.5, "early_stop": True, "max_input_tokens": 8192, "seed": 17,
    },
    "prompt": {
        "prompt_prefix": "You are a Math Teacher. Given a question and a student's solution, evaluate the mathemetical correctness, logic consistency of the current step and whether it will lead to the correct final solution",
        "include_reference_labels": True, "label_style": "tokens", "max_reference_chars": 600,
    },
}
CHOICES = {("prm", "backend"): ("mock", "hf", "hf4bit", "int4")}
#: checked only where retrieval is on
RETRIEVAL_CHOICES = {("prompt", "label_style"): ("tokens", "words"), ("retrieval", "reference_mode"): ("retrieved", "random")}


def resolve(given: dict | None = None, overrides: dict | None = None) -> dict[str, dict]:
    """Defaults, then the given values, then ``section.key`` overrides; unknown names are errors."""
    out = copy.deepcopy(DEFAULTS)
    layers = [(s, k, v) for s, own in (given or {}).items() for k, v in ((own or {}).items() if isinstance(own, dict) or own is None else [(None, own)])]
    for s in given or {}:
        if s not in out:
            raise ValueError(f"unknown configuration section {s!r}; known: {sorted(out)}")
    layers += [(*dotted.split(".", 1), v) for dotted, v in (overrides or {}).items()]
    for section, key, value in layers:
        if section not in out:
            raise ValueError(f"unknown configuration section {section!r}; known: {sorted(out)}")
        if key not in out[section]:
            raise ValueError(f"unknown key {key!r} in section {section!r}; known: {sorted(out[section])}")
        out[section][key] = list(value) if isinstance(value, tuple) else value
    check(out)
    return out


def check(config: dict[str, dict]) -> None:
    """Raise ValueError for values that no run can have."""
    choices = dict(CHOICES)
    for s in config["data"]["subsets"]:
        if s not in SEVERITY:
            raise ValueError(f"unknown subset {s!r}; known: {[*SEVERITY]}")
    if not 0 < config["prm"]["correctness_threshold"] < 1:
        raise ValueError("prm.correctness_threshold must lie between 0 and 1, both excluded")
    if config["retrieval"]["enabled"]:
        choices |= RETRIEVAL_CHOICES
        for key in ("top_k_questions", "top_k_steps"):
            if config["retrieval"][key] < 1:
                raise ValueError(f"retrieval.{key} must be at least 1")
        if not 0 < config["retrieval"]["max_question_similarity"] <= 1:
            raise ValueError("retrieval.max_question_similarity must lie in (0, 1]")
    for (section, key), allowed in choices.items():
        if config[section][key] not in allowed:
            raise ValueError(f"{section}.{key} must be one of {', '.join(allowed)}, not {config[section][key]!r}")


def load(path: str | Path, overrides: dict | None = None) -> dict[str, dict]:
    """A configuration file: JSON, or YAML where its library is installed."""
    text = read_text(path)
    if str(path).endswith(".json"):
        return resolve(json.loads(text), overrides)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml library; JSON files need none") from e
    return resolve(yaml.safe_load(text), overrides)


def save(config: dict[str, dict], path: str | Path) -> None:
    write_text(json.dumps(config, indent=2, ensure_ascii=False), path)


def flatten(spark: SparkSession, config: dict[str, dict]) -> DataFrame:
    """(section, key, value) rows, values as JSON."""
    return spark.createDataFrame([(s, k, json.dumps(v, sort_keys=True)) for s, own in config.items() for k, v in own.items()], "section string, key string, value string")
