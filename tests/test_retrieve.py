import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.functions.vectors import l2_normalise
from gradeloom.operators import contamination, encode, retrieve


def vectors(spark, n, d=8, seed=1):
    v = np.random.default_rng(seed).normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")


@pytest.mark.parametrize("block_rows", [1 << 20, 6])
def test_topk_is_exact_in_any_number_of_blocks(spark, block_rows):
    p, pool = vectors(spark, 40)
    q, queries = vectors(spark, 9, seed=2)
    got = retrieve.topk_by_cosine(queries.withColumnRenamed("id", "query_id"), pool.withColumnRenamed("id", "item_id"), 5, below=0.7, block_rows=block_rows)
    sims = q @ p.T
    for i in range(9):
        want = [j for j in np.argsort(-sims[i], kind="stable") if sims[i, j] < 0.7][:5]
        assert [r["item_id"] for r in got.where(F.col("query_id") == i).orderBy("rank").collect()] == want


def test_drop_same(spark):
    _, pool = vectors(spark, 20)
    q = pool.withColumnRenamed("id", "query_id")
    p = pool.withColumnRenamed("id", "item_id")
    assert retrieve.topk_by_cosine(q, p, 1).where("query_id <> item_id").isEmpty()
    assert retrieve.topk_by_cosine(q, p, 1, drop_same=True).where("query_id = item_id").isEmpty()
    assert retrieve.topk_by_cosine(q, p.limit(0), 3).count() == 0


def test_guard_walk_matches_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(q, i, float(rng.random()), bool(rng.random() < 0.2)) for q in range(20) for i in range(12)]
    df = spark.createDataFrame(rows, "query_id long, item_id long, similarity double, is_duplicate boolean")
    got = {}
    for r in retrieve.guard_walk(df, 3, 0.7).collect():
        got.setdefault(r["query_id"], []).append((r["item_id"], r["verdict"]))
    for q in range(20):
        kept, want = 0, []
        for _, i, s, d in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])):
            if kept == 3:
                break
            v = "duplicate" if d else "similar" if s >= 0.7 else "kept"
            kept += v == "kept"
            want.append((i, v))
        assert sorted(got[q]) == sorted(want)


def test_counters_count_empty_queries(spark):
    walked = spark.createDataFrame([(1, 1, "kept", 0.5), (1, 2, "similar", 0.9)], "query_id long, item_id long, verdict string, similarity double")
    r = retrieve.guard_counters(walked, spark.createDataFrame([(1,), (2,)], "query_id long")).first()
    assert tuple(r) == (2, 1, 0, 1, 1, 0.5)


def test_projection_matches_svd(spark):
    v, df = vectors(spark, 50)
    m = encode.fit_projection(df, 4)
    x = v - v.mean(0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    for mine, theirs in zip(np.array(m["components"]), axes[:4]):
        assert abs(mine @ theirs) == pytest.approx(1, abs=1e-8) and mine[np.abs(mine).argmax()] > 0
    got = np.array([r["vec"] for r in encode.apply_projection(df, m).orderBy("id").collect()])
    want = x @ np.array(m["components"]).T
    np.testing.assert_allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-9)
    assert encode.fit_projection(df.limit(1), 4) is None and encode.fit_projection(df.limit(0), 4) is None


def test_wide_projection_matches_the_exact_one(spark):
    rng = np.random.default_rng(5)
    d = 700  # several slices
    v = rng.standard_normal((300, 12)) * np.geomspace(20, 1, 12) @ rng.standard_normal((12, d)) + 0.05 * rng.standard_normal((300, d)) + 3
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>").repartition(5)
    for whiten in (False, True):
        exact, wide = encode.fit_projection(df, 6, whiten=whiten), encode.fit_projection_wide(df, 6, whiten=whiten)
        assert wide["residual"] <= 1e-9 and len(wide["components"]) == 6
        for key in ("mean", "components", "explained"):
            np.testing.assert_allclose(wide[key], exact[key], atol=1e-6)
    full = encode.fit_projection_wide(df.limit(4), 10)  # fewer vectors than axes asked for
    np.testing.assert_allclose(full["explained"], encode.fit_projection(df.limit(4), 10)["explained"], atol=1e-6)
    assert encode.fit_projection_wide(df.limit(1), 4) is None and encode.fit_projection_wide(df.limit(0), 4) is None


def test_unknown_encoder_is_an_error():
    with pytest.raises(ValueError, match="no encoder"):
        encode.build_encoder("other")


def test_containment(spark):
    texts = spark.createDataFrame([(1, "xa b c dz and more words"), (2, "a b  c d"), (3, "nothing"), (4, None)], "t long, text string")
    items = spark.createDataFrame([(1, "a b c d"), (2, "noth"), (3, ""), (4, None), (5, "e words")], "i long, item string")
    assert sorted(map(tuple, contamination.containment(texts, items, "t", "text", "i", "item").collect())) == [(1, 1), (1, 5), (3, 2)]


def test_containment_by_brute_force(spark):
    import random

    rng = random.Random(3)
    make = lambda most: "".join(rng.choice("aab  \n") for _ in range(rng.randint(0, most)))
    texts, items = [(i, make(25)) for i in range(60)] + [(60, None)], [(i, make(7)) for i in range(80)] + [(80, None), (81, " "), (82, "ab"), (82, "b a")]
    got = contamination.containment(spark.createDataFrame(texts, "t long, text string"), spark.createDataFrame(items, "i long, item string"), "t", "text", "i", "item")
    assert sorted(map(tuple, got.collect())) == sorted({(t, i) for t, x in texts for i, y in items if x is not None and y and y in x})


def test_contamination_report(spark):
    problems = spark.createDataFrame([("a", "gsm8k", "What is  1+1"), ("b", "gsm8k", "other"), ("c", "math", "third")], "uid string, subset string, problem string")
    pool = spark.createDataFrame([("what IS 1+1",)], "question string")
    flagged = contamination.flags(problems, contamination.verbatim(problems, pool), spark.createDataFrame([("b", 0.97)], "uid string, max_similarity double"))
    got = {r["subset"]: tuple(r)[1:] for r in contamination.report(flagged).collect()}
    assert got == {"gsm8k": (2, 1, 50.0, 1), "math": (1, 0, 0.0, 0), "TOTAL": (3, 1, 33.3, 1)}


def test_normalising_is_linear_in_the_dimension(spark):
    import time

    def seconds(d):
        df = spark.range(2000).select(F.transform(F.sequence(F.lit(1), F.lit(d)), lambda k: (k + F.col("id")).cast("double")).alias("v"))
        times = []
        for _ in range(3):
            start = time.time()
            df.select(l2_normalise("v").alias("u")).agg(F.sum(F.col("u")[0])).collect()
            times.append(time.time() - start)
        return min(times)

    assert seconds(512) < 10 * seconds(64) + 1
