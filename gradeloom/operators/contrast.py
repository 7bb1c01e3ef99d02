"""Paired comparison of two runs: alignment, McNemar's test, bootstraps, the trend over severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import average_rank, chi2_p_value, harmonic, mcnemar_statistic, rate, safe_corr
from ..schema import severity
from .metrics import score_subsets


def latest(predictions: DataFrame, line: str = "line_no", uid: str = "uid") -> DataFrame:
    """One row for each uid, the one with the greatest line number."""
    own = predictions.groupBy(uid).agg(F.max_by(F.struct(*predictions.columns), line).alias("_row"))
    return own.select("_row.*")


def align(run_a: DataFrame, run_b: DataFrame, exclude: DataFrame | None = None, check: bool = True) -> DataFrame:
    """aligned(subset, uid, gold, pred_a, pred_b), without the uids in ``exclude``.

    With ``check``, one full outer join's counts must show the same uids and golds on both sides.
    """
    side = lambda df, x: df.select("uid", F.col("subset").alias(f"subset_{x}"), F.col("gold_label").alias(f"gold_{x}"), F.col("predicted_label").alias(f"pred_{x}"))
    a, b = side(run_a, "a"), side(run_b, "b")
    if check:
        n = a.join(b, "uid", "full_outer").agg(
            F.count_if(F.col("gold_a").isNotNull() & F.col("gold_b").isNotNull()).alias("both"),
            F.count_if(F.col("gold_b").isNull()).alias("only_a"),
            F.count_if(F.col("gold_a").isNull()).alias("only_b"),
            F.count_if(F.col("gold_a") != F.col("gold_b")).alias("mismatched"),
        ).first()
        if not n["both"]:
            raise ValueError("the runs share no solutions")
        if n["only_a"] or n["only_b"]:
            raise ValueError(f"{n['only_a']} solutions are in the first run only, {n['only_b']} in the second only")
        if n["mismatched"]:
            raise ValueError(f"{n['mismatched']} solutions have different gold labels in the two runs")
    both = a.join(b, "uid")
    if exclude is not None:
        both = both.join(exclude.select("uid"), "uid", "left_anti")
        if check and both.isEmpty():
            raise ValueError("every shared solution is excluded")
    return both.select(F.col("subset_a").alias("subset"), "uid", F.col("gold_a").alias("gold"), "pred_a", "pred_b")


def mcnemar(aligned: DataFrame, by: tuple[str, ...] = (), needed: int = 25) -> DataFrame:
    """b_only, a_only, discordant, statistic, p_value; ``reliable`` from ``needed`` discordant pairs on (null without any)."""
    a, b = F.col("pred_a") == F.col("gold"), F.col("pred_b") == F.col("gold")
    out = aligned.groupBy(*by).agg(F.count_if(b & ~a).alias("b_only"), F.count_if(a & ~b).alias("a_only"))
    out = out.withColumn("discordant", F.col("b_only") + F.col("a_only")).withColumn("statistic", mcnemar_statistic("b_only", "a_only"))
    return out.withColumns({"p_value": F.when(F.col("discordant") > 0, chi2_p_value("statistic")).otherwise(1.0), "reliable": F.when(F.col("discordant") > 0, F.col("discordant") >= needed)})


def cells(aligned: DataFrame, by: tuple[str, ...] = ("subset",)) -> DataFrame:
    """Counts of the at most eight cells (erroneous, hit by A, hit by B) that both F1s depend on."""
    return aligned.groupBy(*by, (F.col("gold") != -1).alias("is_error"), (F.col("pred_a") == F.col("gold")).alias("hit_a"), (F.col("pred_b") == F.col("gold")).alias("hit_b")).agg(F.count("*").alias("n"))


def _draw(rows: list, resamples: int, rng):
    """F1s of both arms in each resample of one subset's cells; a resample of n rows is a multinomial draw."""
    import numpy as np

    n = np.array([r["n"] for r in rows])
    error, a, b = (np.array([r[c] for r in rows]) for c in ("is_error", "hit_a", "hit_b"))
    draws = rng.multinomial(n.sum(), n / n.sum(), size=resamples).astype(float)

    def f1(hit):
        with np.errstate(invalid="ignore", divide="ignore"):
            e = draws[:, error & hit].sum(1) / draws[:, error].sum(1)
            c = draws[:, ~error & hit].sum(1) / draws[:, ~error].sum(1)
            out = np.where((e <= 0) | (c <= 0), 0.0, 2 * e * c / (e + c))
        return np.where(np.isnan(e) | np.isnan(c), np.nan, out)

    return f1(a), f1(b)


def _interval(x, alpha: float) -> tuple[float | None, float | None]:
    import numpy as np

    return (None, None) if np.isnan(x).all() else (float(np.nanquantile(x, alpha / 2)), float(np.nanquantile(x, 1 - alpha / 2)))


def bootstrap_cis(cell_rows: list, resamples: int = 2000, alpha: float = 0.05, seed: int = 0) -> dict:
    """Percentile intervals from collected cells (subset, is_error, hit_a, hit_b, n).

    ``subsets``: f1_a, f1_b and paired delta for each; ``average_delta``: resampled inside subsets, a draw
    with an undefined subset is void.
    """
    import numpy as np

    rng, by, deltas = np.random.default_rng(seed), {}, []
    for subset in sorted({r["subset"] for r in cell_rows}):
        a, b = _draw([r for r in cell_rows if r["subset"] == subset], resamples, rng)
        by[subset] = {"f1_a": _interval(a, alpha), "f1_b": _interval(b, alpha), "delta": _interval(b - a, alpha)}
        deltas.append(b - a)
    average = np.mean(deltas, axis=0) if deltas else np.array([np.nan])
    return {"subsets": by, "average_delta": _interval(average, alpha)}


#: values that a task of :func:`hash_bootstrap` holds (more are cut into blocks, for each of which all draws are made again), and parts that the resamples are cut into
BLOCK_VALUES = 1 << 22
RESAMPLE_PARTS = 64


def hash_bootstrap(values: DataFrame, statistic: str = "value", resamples: int = 2000, seed: int = 0, block_values: int = BLOCK_VALUES) -> DataFrame:
    """Means of resamples that md5 draws instead of a generator: the same on every engine.

    ``values`` has a gapless ``i`` from 0. Each of n places of a resample reads row
    md5(seed:resample:place) mod n: n times ``resamples`` draws, so for small tables; intervals of large
    ones come from :func:`bootstrap_cis`. A task makes the draws of some resamples beside the values of a block;
    only a sum and a count for each resample and block leave it.
    """
    n = values.count()
    parts = min(resamples, RESAMPLE_PARTS)

    def run(key, rows):
        import numpy as np
        import pyarrow as pa

        from ..functions.digests import AT_ONCE, Digests

        block, part = (k.as_py() for k in key)
        low = block * block_values
        held, known = np.zeros(min(block_values, n - low)), np.zeros(min(block_values, n - low), bool)
        at = rows.column("i").to_numpy() - low
        found = rows.column("value").combine_chunks()
        held[at], known[at] = found.fill_null(0.0).to_numpy(zero_copy_only=False), found.is_valid().to_numpy(zero_copy_only=False)
        own = range(part, resamples, parts)
        total, count = np.zeros(len(own)), np.zeros(len(own), "i8")
        for first in range(0, n, AT_ONCE):
            places = Digests([b"%d" % k for k in range(first, min(n, first + AT_ONCE))])
            for k, drawn in enumerate(places.words([(b"%d:%d:" % (seed, resample), b"") for resample in own], n=1)[0]):
                picked = drawn % np.int64(n) - low
                if n > block_values:
                    picked = picked[(picked >= 0) & (picked < len(held))]
                total[k] += held[picked].sum()
                count[k] += known[picked].sum()
        return pa.table([pa.array([*own], pa.int64()), pa.array(total), pa.array(count)], names=["resample", "total", "n"])

    rows = values.select(F.col("i").cast("long").alias("i"), F.col(statistic).cast("double").alias("value"))
    rows = rows.withColumns({"block": F.floor(F.col("i") / block_values), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    sums = rows.groupBy("block", "part").applyInArrow(run, "resample long, total double, n long")
    return sums.groupBy("resample").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean"))


#: replicates that one md5 draws weights for: 32 bits each
DRAWS = 4


def poisson_steps(most: int = 12) -> list[float]:
    """Cumulative probabilities of a Poisson variable of mean 1: a weight is how many of them a uniform number has reached (beyond ``most``: less than 1e-10 of all)."""
    import math

    out, total = [], 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
    return out


def cluster_replicates(per_solution: DataFrame, resamples: int = 2000, seed: int = 17, key: str = "uid") -> DataFrame:
    """(replicate, s1, s2): percentage-point differences of two step rates when whole solutions are resampled; see :func:`_replicates`."""
    return _replicates(per_solution, resamples, seed, key).where("replicate >= 0").drop("n")


def _replicates(per_solution: DataFrame, resamples: int, seed: int, key: str) -> DataFrame:
    """(replicate, n, s1, s2): weighted numbers of steps and differences of two step rates; replicate -1 has each solution once.

    ``per_solution``: uid, n, and counts s1_a, s1_x, s2_a, s2_x of flags in the two arms. A replicate gives each
    solution a Poisson weight that a hash draws (the limit of drawing with replacement), so solutions need not be
    known together: weighted sums are added up in the tasks, in numpy, and what leaves a task is a row for each
    ``DRAWS`` replicates, however many solutions there are and however different they are.
    """
    import math

    blocks = -(-resamples // DRAWS)
    columns = ["n", "_1", "_2"]
    names = [f"{c}{j}" for j in range(DRAWS) for c in columns]
    least = [math.ceil(t * 2**32) for t in poisson_steps()]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from ..functions.digests import AT_ONCE, Digests

        steps = [np.uint32(x) for x in least if x < 2**32]
        sums, once = np.zeros((blocks, DRAWS, len(columns)), "i8"), np.zeros(len(columns), "i8")

        def add(held):
            # a null key leaves no text between seed and block
            drawn = Digests([b"" if k is None else b":" + str(k).encode() for b in held for k in b.column("key").to_pylist()])
            counts = np.concatenate([np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns], 1) for b in held]).astype(float)
            once[:] += counts.sum(0).astype("i8")
            few = max(1, AT_ONCE // len(counts))
            for first in range(0, blocks, few):
                own = range(first, min(blocks, first + few))
                numbers = drawn.words([(b"%d" % seed, b":%d" % k) for k in own], n=DRAWS)
                weights = np.zeros(numbers.shape, "u1")
                for x in steps:
                    weights += numbers >= x
                # whole numbers far below 2 ** 53: exact in doubles
                sums[first : own.stop] += (weights.transpose(1, 0, 2).astype(float) @ counts).astype("i8")

        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held, rows = [*held, b], rows + b.num_rows
            if rows >= AT_ONCE:
                add(held)
                held, rows = [], 0
        if held:
            add(held)
        if once[0]:
            rows = np.concatenate([np.tile(once, DRAWS)[None], sums.reshape(blocks, -1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, blocks)), *map(pa.array, np.ascontiguousarray(rows.T))], names=["_block", *names])

    whole = lambda x: F.coalesce(x.cast("long"), F.lit(0).cast("long"))
    rows = per_solution.select(F.col(key).cast("string").alias("key"), whole(F.col("n")).alias("n"), whole(F.col("s1_x") - F.col("s1_a")).alias("_1"), whole(F.col("s2_x") - F.col("s2_a")).alias("_2"))
    added = rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("_block", *names))).groupBy("_block").agg(*(F.sum(c).alias(c) for c in names))
    place = lambda j: F.when(F.col("_block") >= 0, F.col("_block") * DRAWS + j).when(F.lit(j == 0), -1)
    each = F.explode(F.array(*(F.struct(place(j).alias("replicate"), F.col(f"n{j}").alias("n"), *(F.try_divide(100.0 * F.col(f"{c}{j}"), F.col(f"n{j}")).alias(name) for c, name in (("_1", "s1"), ("_2", "s2")))) for j in range(DRAWS))))
    return added.select(each.alias("r")).select("r.*").where(F.col("replicate") < resamples)


def cluster_intervals(per_solution: DataFrame, resamples: int = 2000, seed: int = 17, alpha: float = 0.05, key: str = "uid") -> DataFrame:
    """(stage, point, low, high): the differences and their percentile intervals, from one pass over the solutions; no rows without solutions."""
    drawn, once = _replicates(per_solution, resamples, seed, key), F.col("replicate") < 0
    at = lambda c, q: F.percentile(F.when(~once, F.col(c)), F.lit(q))
    ends = [at(c, q).alias(f"{c}{x}") for c in ("s1", "s2") for x, q in (("low", alpha / 2), ("high", 1 - alpha / 2))]
    both = drawn.agg(F.max(F.when(once, F.col("n"))).alias("n"), *(F.max(F.when(once, F.col(c))).alias(c) for c in ("s1", "s2")), *ends).where("n > 0")
    return both.select(F.inline(F.array(*(F.struct(F.lit(c).alias("stage"), F.col(c).alias("point"), F.col(f"{c}low").alias("low"), F.col(f"{c}high").alias("high")) for c in ("s1", "s2")))))


def cluster_bootstrap(per_solution: DataFrame, resamples: int = 2000, seed: int = 17) -> dict[str, tuple[float, float, float]]:
    """Point and 95 % interval of each stage, as a dictionary."""
    return {r["stage"]: (r["point"], r["low"], r["high"]) for r in cluster_intervals(per_solution, resamples, seed).collect()}


def subset_contrast(aligned: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """Both arms' metrics for each subset, in one aggregation, with the F1 delta and McNemar's counts."""
    a, b, e = F.col("pred_a") == F.col("gold"), F.col("pred_b") == F.col("gold"), F.col("gold") != -1
    out = aligned.groupBy("subset").agg(
        F.count("*").alias("n"), rate(a, e).alias("ea"), rate(a, ~e).alias("ca"), rate(b, e).alias("eb"), rate(b, ~e).alias("cb"),
        F.count_if(b & ~a).alias("b_only"), F.count_if(a & ~b).alias("a_only"),
    )
    out = out.select("subset", "n", severity("subset", ranks).alias("ood_rank"), harmonic("ea", "ca").alias("f1_a"), harmonic("eb", "cb").alias("f1_b"), "b_only", "a_only")
    return out.withColumn("delta_f1", F.col("f1_b") - F.col("f1_a"))


def ood_trend(deltas: DataFrame, rank: str = "ood_rank", delta: str = "delta_f1", subset: str = "subset") -> DataFrame:
    """Slope, intercept, Spearman (average ranks), spread and reading of deltas over severity; null columns below 3 subsets.

    One row per subset goes in, so its global windows are over a handful of rows.
    """
    from pyspark.sql import Window

    rows = deltas.where(F.col(delta).isNotNull()).select(F.col(rank).cast("double").alias("x"), F.col(delta).alias("y"), F.col(subset).alias("s"))
    rows = rows.select("*", average_rank("x").alias("rx"), average_rank("y").alias("ry"), (F.col("y") - F.lag("y").over(Window.orderBy("x", "s")) < 0).alias("falls"))
    out = rows.agg(
        F.count("*").alias("n_subsets"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        safe_corr("rx", "ry").alias("spearman"), (F.max("y") - F.min("y")).alias("spread"), F.coalesce(F.bool_or("falls"), F.lit(False)).alias("falls"),
    )
    testable, flat = F.col("n_subsets") >= 3, F.col("spread") < 1e-9
    only = lambda c: F.when(testable, c)
    reading = F.when(flat, "equal in all subsets").when((F.col("slope") > 0) & (F.col("spearman") > 0.5), "rises with severity").otherwise("does not rise with severity")
    return out.select(
        testable.alias("testable"), only(F.col("slope")).alias("slope_per_ood_rank"), only(F.col("intercept")).alias("intercept"), only(F.coalesce("spearman", F.lit(0.0))).alias("spearman"),
        only(F.col("spread")).alias("delta_spread"), only(flat).alias("degenerate"), only(~F.col("falls") & ~flat).alias("monotonic_increasing"), only(reading).alias("interpretation"),
    )


def compare(run_a: DataFrame, run_b: DataFrame, exclude: DataFrame | None = None, seed: int = 0, label: str | None = None, names: tuple[str, str] = ("a", "b")) -> dict:
    """The whole comparison as a dictionary: a handful of collected rows, everything else stays distributed."""
    aligned = align(run_a, run_b, exclude).cache()
    try:
        subsets = subset_contrast(aligned).orderBy("ood_rank", "subset")
        own = {r["subset"]: r.asDict() for r in mcnemar(aligned, ("subset",)).collect()}
        pooled = mcnemar(aligned).first().asDict()
        cis = bootstrap_cis(cells(aligned).collect(), seed=seed)
        sides = {x: {r["subset"]: r.asDict() for r in score_subsets(aligned, gold="gold", predicted=f"pred_{x}").collect()} for x in "ab"}
        rows = []
        for r in subsets.collect():
            ci = cis["subsets"][r["subset"]]
            defined = r["delta_f1"] is not None
            low, high = ci["delta"] if defined else (None, None)
            rows.append({"subset": r["subset"], "n": r["n"], "ood_rank": r["ood_rank"], "a": sides["a"][r["subset"]], "b": sides["b"][r["subset"]], "well_defined": defined, "delta_f1": r["delta_f1"], "delta_ci95": [low, high], "significant": bool(defined and (low > 0 or high < 0)), "mcnemar": own[r["subset"]], "a_f1_ci95": list(ci["f1_a"]), "b_f1_ci95": list(ci["f1_b"])})
        usable = [r for r in rows if r["well_defined"]]
        mean = lambda x: sum(r[x]["f1"] for r in usable) / len(usable) if usable else None
        low, high = cis["average_delta"]
        return {
            "run_a": names[0], "run_b": names[1], "excluded_uids": 0 if exclude is None else exclude.select("uid").distinct().count(), "exclusion_label": label, "per_subset": rows,
            "average_f1_a": mean("a"), "average_f1_b": mean("b"), "average_delta": mean("b") - mean("a") if usable else None,
            "overall": {"n_solutions": sum(r["n"] for r in rows), "average_delta_ci95": [low, high], "significant": low is not None and (low > 0 or high < 0), "mcnemar_pooled": pooled},
            "undefined_subsets": [r["subset"] for r in rows if not r["well_defined"]],
            "ood_trend": ood_trend(subsets).first().asDict(),
        }
    finally:
        aligned.unpersist()


def contrasts(predictions: DataFrame, pairs: list[tuple[str, str]], arm: str = "arm") -> DataFrame:
    """Average F1 deltas of many arm pairs, from one aggregation of all arms: the pair list joins arm averages."""
    average = score_subsets(predictions, by=(arm,)).groupBy(arm).agg(F.avg("f1").alias("f1"))
    listed = predictions.sparkSession.createDataFrame(pairs, "a string, b string")
    x, y = average.toDF("a", "f1_a"), average.toDF("b", "f1_b")
    return listed.join(x, "a").join(y, "b").select("a", "b", (F.col("f1_b") - F.col("f1_a")).alias("delta"))
